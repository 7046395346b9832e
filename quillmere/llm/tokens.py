"""Tokenizer access inside tasks, with a bounded cache of encoded words.

Both public BPE vocabularies used here split a text before any merge is made, and always between a
character that is no white space and a following ASCII blank. A text is therefore cut at those places,
each piece is encoded once and its ids are reused. Texts with any rarer white space or control character,
next to which that rule could differ between libraries, are encoded whole by the tokenizers library, and
so are pieces with characters from U+0180 on or with the string of a special token. The other pieces go
through tiktoken's merge loop with the ranks of the same vocabulary, which gives the same ids faster.
With the vocabulary that drops white space, pieces are words, and a slice of a column is encoded at once
(`encode_array`).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Blanks after which, or before which, a cut is not provably neutral: these texts are not cut.
_RARE_BLANKS = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]")
_WITH_BLANKS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
_WORDS_ONLY = re.compile(r"[^ \t-\r]+")
#: Letters of these code points are lower-cased, normalised and classed alike by all libraries.
_PLAIN = re.compile("[\\t-~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017e]+")
#: Pieces met since the last turn of the cache; as many of the turn before stay at hand (about 600 bytes each).
#: Tasks that encode beside others that decode keep the smaller number.
CACHE_PIECES, FEW_PIECES = 200_000, 25_000
#: Longer pieces are encoded but not kept.
CACHE_PIECE_CHARS = 48


def byte_alphabet() -> dict[str, int]:
    """Character by which byte-level vocabularies write each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCache:
    """Encodes texts to little-endian unsigned 32-bit ids exactly as the tokenizers library encodes them whole."""

    def __init__(self, path: str):
        import tiktoken

        self.room = CACHE_PIECES
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        self.pieces = _WORDS_ONLY if self.words else _WITH_BLANKS
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        #: The end of a word is written as character 0, which no plain piece has.
        self.end = "\0" if self.words else ""

        def spelled(token: str) -> bytes:
            mark = bool(suffix) and token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if mark else token)) + self.end.encode() * mark

        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {spelled(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        first = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in first]
        #: Ranks stand for merges only where ids follow the order of the merges.
        self.ranked = all(x < y for x, y in zip(order, order[1:], strict=False)) and all(bytes([b]) in ranks for b in range(256))
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary if self.ranked else None
        if self.words:
            # One call merges many words: a line each, every part of a word closed by character 0.
            self.merge_lines = tiktoken.Encoding("lines", pat_str=r"\n|[^\x00\n]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary if self.ranked else None
            self.line = ranks.get(b"\n")
            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
            self.close = regex.compile(r"(?:'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)").sub
        else:
            self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def trim(self) -> None:
        """Forget all pieces, keep the tokenizer."""
        self.known, self.older = {}, {}

    def raw(self, texts: list[str]) -> list[bytes]:
        """By the tokenizers library."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, text: str) -> bytes:
        if self.merge is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.raw([text])[0]
        ids: list[int] = []
        for part in self.split(text.lower() if self.words else text):
            ids += self.merge(part + self.end)
        return np.array(ids, "<u4").tobytes()

    def fresh_words(self, words: list[str]) -> list[bytes]:
        """Ids of words not met before: plain ones in one call, the others by the tokenizers library."""
        def merged(text: str) -> bool:
            return self.merge is not None and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

        # Ends of lines are plain too, so all words may be tested at once.
        plain = [True] * len(words) if merged("\n".join(words)) else [merged(w) for w in words]
        lines = [w for w, p in zip(words, plain, strict=True) if p]
        coded = iter(())
        if lines:
            ids = np.array(self.merge_lines(self.close("\\g<0>\0", "\n".join(lines).lower() + "\n")), "<u4")
            ends = np.flatnonzero(ids == self.line)
            data, stops = ids.tobytes(), (4 * ends).tolist()
            coded = iter([data[a:b] for a, b in zip([0, *(x + 4 for x in stops)], stops, strict=False)])
        others = iter(self.raw([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(coded) if p else next(others) for p in plain]

    def lookup_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the cache where it has them."""
        found = [self.known.get(w) for w in words]
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.older.get(words[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self.fresh_words([words[i] for i in new]), strict=True):
            found[i] = ids
        for i in missing:
            if len(words[i]) <= CACHE_PIECE_CHARS:
                if len(self.known) >= self.room:
                    self.known, self.older = {}, self.known
                self.known[words[i]] = found[i]
        return found

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """encode() of a slice of a column without nulls. With a vocabulary that drops white space, the slice's
        distinct words are looked up once each and their ids gathered."""
        if not self.words:
            return self.encode(texts.to_pylist())
        as_str = texts.to_pylist()
        rare = [i for i, text in enumerate(as_str) if _RARE_BLANKS.search(text)]
        whole = dict(zip(rare, self.raw([as_str[i] for i in rare]), strict=True))
        if rare:
            texts = pa.array(["" if i in whole else text for i, text in enumerate(as_str)], texts.type)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = self.lookup_words(coded.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.array([len(p) for p in parts], np.int64) // 4
        at = coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - counts), counts)
        place += np.arange(len(place))
        data = ids[place].tobytes()
        # Lists of a sliced array start at their own offset.
        offsets = split.offsets.to_numpy().astype(np.int64)
        stops = (4 * np.concatenate([[0], ends])[offsets - offsets[0]]).tolist()
        return [whole[i] if i in whole else data[a:b] for i, (a, b) in enumerate(zip(stops, stops[1:], strict=False))]

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if _RARE_BLANKS.search(text):
                out += self.raw([text])
                continue
            pieces = self.pieces.findall(text)
            try:
                out.append(b"".join([known[p] for p in pieces]))
                continue
            except KeyError:
                pass
            parts = []
            for p in pieces:
                found = known.get(p)
                if found is None:
                    found = self.older.get(p)
                    if found is None:
                        found = self.piece(p)
                    if len(p) <= CACHE_PIECE_CHARS:
                        if len(known) >= self.room:
                            self.known, self.older = {}, known
                            known = self.known
                        known[p] = found
                parts.append(found)
            out.append(b"".join(parts))
        return out


_caches: dict[str, WordCache] = {}


def word_cache(path: str, room: int = CACHE_PIECES) -> WordCache:
    """The Python worker's own cache for a tokenizer file; a worker keeps one file's at a time."""
    if path not in _caches:
        _caches.clear()
        _caches[path] = WordCache(path)
    _caches[path].room = room
    return _caches[path]


def trim_caches(tokenizers: bool = False) -> None:
    """Give back the memory of pieces, and of tokenizers too if asked. Spark hands a Python worker on from one
    stage's tasks to another's, so tasks that encode nothing call this first."""
    for cache in _caches.values():
        cache.trim()
    if tokenizers:
        _caches.clear()
        _decoders.clear()


class ByteDecoder:
    """Turns ids of a byte-level vocabulary into bytes, vectorised over many ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        table = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for i, t in names.items()}
        table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        return b"".join(self._decode(ids[i : i + block]) for i in range(0, len(ids), block))

    def _decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        shift += np.arange(len(shift))
        return self.data[shift].tobytes()


_decoders: dict[str, ByteDecoder] = {}


def byte_decoder(path: str) -> ByteDecoder:
    if path not in _decoders:
        _decoders[path] = ByteDecoder(path)
    return _decoders[path]
