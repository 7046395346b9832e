"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A token's features are its
word and its first 4, 6 and 8 bytes. Two states, clean and toxic, one weight a feature (the log-odds
of toxic), and a 2 x 2 matrix of transitions.

Labels exist for documents only, so tokens of the training sample are labelled first: a feature that toxic
documents hold far more often than clean ones (likelihood ratio beyond what the number of features tried
would give by chance) marks its tokens in toxic documents as toxic. The field is fitted to these tagged
sequences by gradient ascent on the log-likelihood; scoring runs forward-backward over whole texts. A
document's score is a logistic function of its marginals (expected toxic tokens, the largest marginal, their
share), fitted on the same sample.

The sample is bounded: at most `positives` toxic and `negatives` clean labelled documents, those with the
smallest hash of doc_id, of at most `chars` characters each. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bytes_of, resting, text_slices
from .tokens import trim_caches
from .words import ALNUM, LOWER, find_words, hash_starts, hash_words, mix, shingles

POSITIVES, NEGATIVES, CHARS = 1000, 1500, 20_000
#: Beginnings of a token that are features, in bytes.
STARTS = (4, 6, 8)
#: Forward-backward runs over strips of so many tokens, each begun so many tokens early. The transitions'
#: cross ratio is held to MAX_PULL, so what lies further back changes a log-odds by less than 1e-9.
STRIP, WARM, MAX_PULL = 1024, 96, 4.0
LEAST = 0.1
_FILTER_BITS = 20


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    transitions: np.ndarray  # log potentials [from, to]
    start: float
    bias: float
    document: np.ndarray  # intercept, then a weight for each aggregate

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Odds of each token from its row of feature hashes."""
        out = np.full(len(features), self.bias)
        if len(self.keys):
            for column in features.T:
                some = np.flatnonzero(self.maybe[(column >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, column[some]), len(self.keys) - 1)
                hit = self.keys[at] == column[some]
                out[some[hit]] += self.weights[at[hit]]
        return np.exp(np.clip(out, -50, 50))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, token starts and ends, first token of each text (one more at the end), text offsets."""
    data, offsets = bytes_of(texts)
    starts, ends, first = find_words(LOWER[data], offsets, ALNUM)
    return data, starts, ends, first, offsets


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of feature hashes for each token."""
    if not len(starts):
        return np.zeros((0, len(STARTS) + 1), np.uint64)
    data = LOWER[data]
    return np.stack([hash_words(data, starts, ends), *hash_starts(data, starts, ends, STARTS)], axis=1)


def forward_backward(e: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of toxic for every token, from emission odds e; their product is the
    marginal's odds. Odds stay within exp(-60) and exp(60)."""
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros(0)
    t = np.exp(transitions)
    full = np.diff(first) > 0
    heads, tails = np.zeros(n, bool), np.zeros(n, bool)
    heads[first[:-1][full]] = True
    tails[first[1:][full] - 1] = True
    strips = -(-n // STRIP)
    size = strips * STRIP
    # Padded on both sides, strip by strip in columns: row k of `wide` holds token k - WARM of each strip.
    index = np.clip(np.arange(-WARM, STRIP + WARM)[:, None] + (np.arange(strips) * STRIP)[None, :], 0, n - 1)
    f, b = np.empty(size), np.empty(size)
    f_rows, b_rows = f.reshape(strips, STRIP), b.reshape(strips, STRIP)
    u = np.ones(strips)
    for k in range(STRIP + WARM):
        at = index[k]
        u = e[at] * np.where(heads[at], np.exp(start), (t[0, 1] + u * t[1, 1]) / (t[0, 0] + u * t[1, 0]))
        np.clip(u, 1e-26, 1e26, out=u)
        if k >= WARM:
            f_rows[:, k - WARM] = u
    q = np.ones(strips)
    for k in range(STRIP + 2 * WARM - 1, WARM - 1, -1):
        at = index[k]
        v = np.where(tails[at], 1.0, (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q))
        q = np.clip(e[at] * v, 1e-26, 1e26)
        if k < STRIP + WARM:
            b_rows[:, k - WARM] = v
    return f[:n], b[:n]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def aggregates(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: log of expected toxic tokens, largest marginal, chance of any, share. Marginals under
    LEAST count as none, or thousands of clean tokens would add up in a long text."""
    out = np.zeros((len(first) - 1, 4))
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        p, at, n = odds / (1 + odds), first[full], np.diff(first)[full]
        p[p < LEAST] = 0
        total = np.add.reduceat(p, at)
        out[full, 0] = np.log1p(total)
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), at))
        out[full, 3] = np.sqrt(total / n)
    return out


def _adagrad(weights: np.ndarray, gradient: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += gradient * gradient
    weights += rate * gradient / (np.sqrt(seen) + 1e-8)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 25, ridge: float = 1e-3) -> Model:
    """Fit a model on the sample. Without a toxic or a clean text it knows nothing and scores all alike, at
    the (smoothed) share of toxic texts."""
    alone = _unlike(texts)
    texts, toxic = [texts[i] for i in alone], toxic[alone]
    data, starts, ends, first, _ = tokens(pa.array(texts, pa.string()))
    found = features(data, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    share = (n_pos + 0.5) / (n_pos + n_neg + 1)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((2, 2)), 0.0, -10.0, np.array([np.log(share / (1 - share)), 0, 0, 0, 0]))
    if not n_pos or not n_neg or not len(doc):
        return none
    keys, where = np.unique(found, return_inverse=True)
    where = where.reshape(found.shape)
    once = np.unique(where * len(texts) + doc[:, None])  # a feature counts once a document
    pos = np.bincount(once[toxic[once % len(texts)]] // len(texts), minlength=len(keys)).astype(float)
    neg = np.bincount(once[~toxic[once % len(texts)]] // len(texts), minlength=len(keys)).astype(float)
    ratio = _likelihood_ratio(pos, neg, n_pos, n_neg)
    telling = (ratio > 2 * np.log(20 * len(keys))) & ((pos + 0.5) / (n_pos + 1) > 8 * (neg + 0.5) / (n_neg + 1))
    tag = telling[where].any(axis=1) & toxic[doc]
    # Features of tagged tokens get a weight; what no tagged token has can only say "clean", as the bias does.
    use = np.flatnonzero((np.bincount(where[tag].ravel(), minlength=len(keys)) > 0) & (pos + neg >= 2))
    number = np.full(len(keys), -1)
    number[use] = np.arange(len(use))
    active = np.flatnonzero((number[where] >= 0).any(axis=1))
    column = number[where[active]]
    column[column < 0] = len(use)
    weights, seen = np.zeros(len(use) + 1), np.zeros(len(use) + 1)  # the last takes features without a weight
    share_of_tokens = (tag.sum() + 0.5) / (len(tag) + 1)
    transitions, start, bias = np.zeros((2, 2)), 0.0, float(np.log(share_of_tokens / (1 - share_of_tokens))) - 2
    seen_t, seen_s, seen_b = np.zeros((2, 2)), np.zeros(1), np.zeros(1)
    heads = np.zeros(len(doc), bool)
    heads[first[:-1][np.diff(first) > 0]] = True
    pair = np.flatnonzero(~heads)  # tokens with one before
    truth = np.zeros((2, 2))
    np.add.at(truth, (tag[pair - 1].astype(int), tag[pair].astype(int)), 1)
    for _ in range(rounds):
        odds = np.full(len(doc), bias)
        odds[active] += weights[column].sum(axis=1)
        odds = np.exp(np.clip(odds, -50, 50))
        f, b = forward_backward(odds, first, transitions, start)
        p = f * b / (1 + f * b)
        miss = tag - p
        gradient = np.bincount(column.ravel(), np.repeat(miss[active], column.shape[1]), len(weights)) - ridge * weights
        gradient[-1] = 0
        _adagrad(weights, gradient, seen, 0.5)
        ahead, t = odds[pair] * b[pair], np.exp(transitions)
        both = np.stack([np.full(len(pair), t[0, 0]), t[0, 1] * ahead, t[1, 0] * f[pair - 1], t[1, 1] * f[pair - 1] * ahead])
        guess = (both / both.sum(axis=0)).sum(axis=1).reshape(2, 2)
        _adagrad(transitions, truth - guess, seen_t, 0.1)
        pull = transitions[0, 0] + transitions[1, 1] - transitions[0, 1] - transitions[1, 0]
        if abs(pull) > MAX_PULL:
            transitions *= MAX_PULL / abs(pull)
        s, t = np.array([start]), np.array([bias])
        _adagrad(s, np.array([miss[heads].sum()]), seen_s, 0.1)
        _adagrad(t, np.array([miss.sum()]), seen_b, 0.2)
        start, bias = float(s[0]), float(t[0])
    kept = np.flatnonzero(np.abs(weights[:-1]) > 0.02)
    model = Model(keys[use[kept]], weights[kept], transitions, start, bias, none.document)
    f, b = forward_backward(model.emissions(found), first, transitions, start)
    x = np.column_stack([np.ones(len(texts)), aggregates(f * b, first)])
    document, seen_d = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(600):
        _adagrad(document, x.T @ (toxic - _sigmoid(x @ document)) - 0.01 * document, seen_d, 0.5)
    model.document = document
    return model


def _unlike(texts: list[str]) -> list[int]:
    """Leave one of each group of copies: texts that share none of 4 minima of their 5-word shingles with a
    text before. A group of thousands of copies would else make all its words telling."""
    data, starts, ends, first, _ = tokens(pa.array(texts, pa.string()))
    runs, at = shingles(hash_words(LOWER[data], starts, ends), first, 5)
    met, out = set(), []
    for i in range(len(texts)):
        mine = runs[at[i] : at[i + 1]]
        least = {(k, int(mix(mine ^ np.uint64(k)).min())) for k in range(1, 5)} if len(mine) else set()
        if not least & met:
            out.append(i)
            met |= least
    return out


def _likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Twice the log ratio of two rates against one, over presence and absence in documents."""
    n = n_pos + n_neg
    rate = (pos + neg) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda seen, expected: np.where(seen > 0, seen * np.log(seen / expected), 0.0)
        return 2 * (term(pos, n_pos * rate) + term(neg, n_neg * rate) + term(n_pos - pos, n_pos * (1 - rate)) + term(n_neg - neg, n_neg * (1 - rate)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, chars: int = CHARS) -> Model:
    """Fit on labelled documents outside the held-out fifth (crc32 of the id as text mod 5 = 0).

    A document with several labels counts as toxic if any says so; null ids, texts and labels are left out. The sample has at
    most `positives` toxic and `negatives` clean ids; where ids repeat with several texts, it has twice as many texts at most.
    """
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id")).withColumn("h", F.xxhash64("doc_id"))
    # Some more ids than texts are wanted: the longest texts are left out of the sample.
    some = marks.where("toxic > 0").orderBy("h", "doc_id").limit(positives).unionByName(marks.where("toxic <= 0").orderBy("h", "doc_id").limit(negatives))
    ids = F.broadcast(some.select("doc_id", "toxic"))  # at most positives + negatives rows
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= chars))
    # Ids that repeat with several texts could make the sample longer: those of the smallest hash count.
    most = 2 * (positives + negatives)
    sample = sorted(rows.join(ids, "doc_id").select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(most).collect())
    return fit([r["text"] for r in sample], np.array([r["toxic"] > 0 for r in sample], bool))


def held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """Return the key as `doc_id`, `score` (0 to 1), `predicted` (1 from 0.5 on), and `spans`: offsets in
    characters (from, to) of runs of tokens whose marginal is at least one half, with the largest marginal.

    Null and empty texts have no tokens and get the score of a text without any sign. Repeated rows get a
    row each. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = pickle.dumps(model)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    @resting
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        model = pickle.loads(known)
        for batch in batches:
            for some in text_slices(batch):
                found, points = _points(some.column("text"), model)
                columns = [some.column("doc_id"), pa.array(points), pa.array((points >= 0.5).astype(np.int32))]
                names = ["doc_id", "score", "predicted"]
                if spans:
                    columns.append(pa.array(_spans(*found), span))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", spans array<struct<begin:int,end:int,p:double>>" if spans else ""
    return rows.mapInArrow(tag, f"doc_id {kind}, score double, predicted int{extra}")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted toxic."""
    known = pickle.dumps(model)

    @resting
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_caches(tokenizers=True)
        model = pickle.loads(known)
        for batch in batches:
            for some in text_slices(batch, text):
                _, points = _points(some.column(text), model)
                yield some.filter(pa.array(points < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def _points(texts: pa.Array, model: Model) -> tuple[tuple, np.ndarray]:
    """Tokens with their marginals' odds, and the score of each text."""
    found = tokens(texts)
    data, starts, ends, first, _ = found
    f, b = forward_backward(model.emissions(features(data, starts, ends)), first, model.transitions, model.start)
    x = np.column_stack([np.ones(len(texts)), aggregates(f * b, first)])
    return (*found, f * b), _sigmoid(x @ model.document)


def _spans(data, starts, ends, first, offsets, odds) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    hot = np.flatnonzero(odds >= 1)
    if len(hot):
        chars = np.cumsum((data & 0xC0) != 0x80)  # characters up to and with each byte
        doc = np.searchsorted(first, hot, "right") - 1
        for i, d in zip(hot.tolist(), doc.tolist(), strict=True):
            base = int(chars[offsets[d] - 1]) if offsets[d] else 0
            begin, end, p = int(chars[starts[i]]) - 1 - base, int(chars[ends[i] - 1]) - base, float(odds[i] / (1 + odds[i]))
            if out[d] and out[d][-1]["last"] == i - 1:
                out[d][-1] |= {"end": end, "p": max(p, out[d][-1]["p"]), "last": i}
            else:
                out[d].append({"begin": begin, "end": end, "p": p, "last": i})
        for d in set(doc.tolist()):
            out[d] = [{k: v for k, v in s.items() if k != "last"} for s in out[d]]
    return out
