"""License scans with a positional index of licence templates, asked for each file's rarest licence words.

1. One pass over the texts keeps, for each file, the places of words that any template or phrase has. Document
   frequencies of these words (a fixed, small vocabulary) are counted over all files.
2. The index has two posting lists for a word: the (template, place) pairs of all templates that hold it, and those of the
   templates among whose rarest words it is. An accepted alignment covers all but a few words of its template, so a
   template's rarest words are one more than those few, by inverse document frequency: each accepted alignment
   covers one of them at least. The postings of a file's words, counted, tell which templates the file has words
   enough for; in these, each occurrence of a rarest word, at place p of the file and t of the template, votes for the
   alignment p - t and those within SLACK of it. Nothing else is aligned, so the work grows with the postings met.
3. The postings of all words of such a template are intersected at the alignments voted for: an alignment counts if the words
   cover it well enough, each within SLACK of its place.
4. Last, alignments that count are verified: every mandatory key phrase of the template must stand, word by word, within
   the aligned stretch. Votes are gone through ANCHORS at a time, so a text that repeats a notice a million times
   takes no more memory than its places do.

Places where a base phrase stands are found by the same places (words next to each other), always.
Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bytes_of, resting, saved, text_slices
from .words import ALNUM, LOWER, find_words, hash_words

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, notice, mandatory key phrases. Notices are sentences of the public texts of the licences.
TEMPLATES = [
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["copy of the gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["distributed on an as is basis without warranties or conditions"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["copy of the gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["the author disclaims all warranties with regard to this software"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["copy of the gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed with this file"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ["in no event will the authors be held liable"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["the origin of this software must not be misrepresented"]),
]
#: Share of a template's words that an alignment must cover in order, and how far a word may be off its place.
COVER, SLACK = 0.6, 3
#: Alignments that are looked at at once, and licence words a task matches, about.
ANCHORS, TASK_WORDS = 4096, 1 << 20


def _vocabulary() -> list[str]:
    return sorted({w for text in [*BASE, *(t for _, t, _ in TEMPLATES), *(k for _, _, ks in TEMPLATES for k in ks)] for w in text.split()})


class _Index:
    """Vocabulary, templates and phrases as numbers, and the templates' postings."""

    def __init__(self, idf: np.ndarray | None = None, cover: float = COVER):
        words = _vocabulary()
        self.number = {w: i for i, w in enumerate(words)}
        data = "".join(words).encode()
        ends = np.cumsum([len(w.encode()) for w in words])
        hashes = hash_words(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = [np.array([self.number[w] for w in t.split()]) for _, t, _ in TEMPLATES]
        self.keys = [[np.array([self.number[w] for w in k.split()]) for k in ks] for _, _, ks in TEMPLATES]
        self.phrases = [(np.array([self.number[w] for w in p.split()]), label) for p, label in BASE.items()]
        #: How often each template (row) has each word, and the fewest words of it that cover it well enough.
        self.counts = np.zeros((len(self.templates), len(words)), np.int32)
        for row, t in zip(self.counts, self.templates, strict=True):
            np.add.at(row, t, 1)
        self.enough = np.array([next(h for h in range(1, len(t) + 1) if h / len(t) >= cover) for t in self.templates])
        #: Template and place of each rarest word, lists of all words one after the other.
        rare = []
        for t, words_ in enumerate(self.templates if idf is not None else []):
            asked = np.lexsort((words_, -idf[words_]))[: len(words_) - self.enough[t] + 1]
            rare += [(int(words_[i]), t, int(i)) for i in asked]
        rare = np.array(sorted(rare), np.int64).reshape(-1, 3)
        self.rare_at = np.searchsorted(rare[:, 0], np.arange(len(words) + 1))
        self.rare_template, self.rare_place = rare[:, 1], rare[:, 2]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def phrase_places(phrase: np.ndarray, doc: np.ndarray, place: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Rows of (doc, place, term), in order, at which a phrase's words stand next to each other."""
    n = len(term) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, int)
    ok = np.ones(n, bool)
    for i, w in enumerate(phrase):
        ok &= (term[i : n + i] == w) & (place[i : n + i] == place[:n] + i) & (doc[i : n + i] == doc[:n])
    return np.flatnonzero(ok)


def licence_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, and the places and numbers of licence words in each text, in order."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @resting
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index()
        for batch in batches:
            for some in text_slices(batch):
                data, offsets = bytes_of(some.column("text"))
                data = LOWER[data]
                starts, ends, first = find_words(data, offsets, ALNUM)
                term = index.terms(hash_words(data, starts, ends))
                known = np.flatnonzero(term >= 0)
                cut = pa.array(np.searchsorted(known, first), pa.int32())
                doc = np.searchsorted(first, known, "right") - 1
                lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int32))) for v in (known - first[doc], term[known])]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n_words", "places", "terms"])

    return rows.mapInArrow(look, f"doc_id {kind}, n_words long, places array<int>, terms array<int>")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", cover: float = COVER) -> DataFrame:
    """Return the key as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null, empty and blank texts have no words: counts are 0, first_word and last_word null, labels "" and
    score 0. The score is 1 where a base phrase stands, else the best cover of an accepted template. Repeated
    rows get a row each. Very long texts are read whole. Other columns are not read.
    """
    found = saved(licence_words(docs, key, text), "licence-words")
    kind = found.schema["doc_id"].dataType.simpleString()
    facts = found.agg(F.count("*").alias("files"), F.sum(F.size("terms")).alias("words")).first()
    total = facts["files"]
    counted = found.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counted.collect()}  # a row a word of the vocabulary at most
    idf = np.array([np.log((total + 1) / (df.get(i, 0) + 0.5)) for i in range(len(_vocabulary()))])

    @resting
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(idf, cover)
        for batch in batches:
            places, terms = batch.column("places"), batch.column("terms")
            cut = places.offsets.to_numpy()
            place = places.values.to_numpy(zero_copy_only=False)[cut[0] : cut[-1]]
            term = terms.values.to_numpy(zero_copy_only=False)[terms.offsets[0].as_py() : terms.offsets[-1].as_py()]
            cut = cut - cut[0]
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(cut))
            count, low, high = np.zeros(n, int), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in index.phrases:
                at = phrase_places(phrase, doc, place, term)
                np.add.at(count, doc[at], 1)
                np.minimum.at(low, doc[at], place[at])
                np.maximum.at(high, doc[at], place[at])
                for d in set(doc[at].tolist()):
                    base[d].add(label)
            own, best = [set(b) for b in base], np.zeros(n)
            held = np.zeros((n, len(idf)), np.int32)
            held[doc, term] = 1
            able = held @ index.counts.T >= index.enough
            # The postings of each word among the rarest; those of templates for which a file has words enough are votes.
            lists = np.diff(index.rare_at)[term]
            row = np.repeat(np.arange(len(term)), lists)
            posting = np.repeat(index.rare_at[term] - (np.cumsum(lists) - lists), lists) + np.arange(len(row))
            useful = able[doc[row], index.rare_template[posting]]
            row, posting = row[useful], posting[useful]
            # By file and template.
            pair = doc[row] * len(index.templates) + index.rare_template[posting]
            order = np.argsort(pair, kind="stable")
            pair, shift = pair[order], (place[row] - index.rare_place[posting])[order]
            begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else []
            for first, last in zip(begins, [*begins[1:], len(pair)], strict=False):
                d, t = divmod(int(pair[first]), len(index.templates))
                mine = slice(cut[d], cut[d + 1])
                hit = align(index, t, place[mine], term[mine], shift[first:last], cover)
                if hit >= cover:
                    own[d].add(TEMPLATES[t][0])
                    best[d] = max(best[d], hit)
            labels = [",".join(sorted(o)) for o in own]
            points = np.where([bool(b) for b in base], 1.0, best)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(count, pa.int64()), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(points, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    # Places are small next to the texts: read as files they would make a few large tasks.
    dealt = found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, (facts["words"] or 0) // TASK_WORDS))
    return dealt.mapInArrow(match, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def align(index: _Index, t: int, place: np.ndarray, term: np.ndarray, votes: np.ndarray, cover: float) -> float:
    """The best cover of one template in a file, over the alignments near those voted for that hold its key phrases; 0
    if none is accepted."""
    words, best = index.templates[t], 0
    votes = np.unique(votes)
    for begin in range(0, len(votes), ANCHORS):
        some = votes[begin : begin + ANCHORS]
        # Only places within reach of these alignments can be part of one.
        left, right = np.searchsorted(place, some[0] - 2 * SLACK), np.searchsorted(place, some[-1] + len(words) + 2 * SLACK, "right")
        here, what = place[left:right], term[left:right]
        shift = np.unique(some[:, None] + np.arange(-SLACK, SLACK + 1))
        hits = np.zeros(len(shift), int)
        at = {w: here[what == w] for w in set(words.tolist())}
        for i, w in enumerate(words.tolist()):
            hits += np.searchsorted(at[w], shift + i - SLACK) < np.searchsorted(at[w], shift + i + SLACK, "right")
        well = (hits >= index.enough[t]) & (hits > best)
        shift, hits = shift[well], hits[well]
        for key in index.keys[t] if len(shift) else []:
            first = here[phrase_places(key, np.zeros(len(here), int), here, what)]
            stands = np.searchsorted(first, shift - SLACK) < np.searchsorted(first, shift + len(words) + SLACK - len(key), "right")
            shift, hits = shift[stands], hits[stands]
        best = max(best, int(hits.max(initial=0)))
    return best / len(words)
