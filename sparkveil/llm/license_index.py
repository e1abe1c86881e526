"""Licence scan with a positional index of rare tokens.

The templates below make one index: word to postings of (template, position). Document frequencies of the templates' words are
counted over the whole corpus (a table as large as the templates' vocabulary). A file's licence words are looked up from the
highest IDF down, and each template takes the postings of its first ``probes`` words; every place of such a word votes for the place
where the template would begin, which intersects the postings by relative position. Votes for places at most ``band`` words apart
count together, so that an inserted or dropped word does not part them. Where there are enough, the template is aligned in order
(a longest common subsequence), and it counts if its ``coverage`` is reached and its mandatory key phrase stands in the stretch.

Defined cases: null text is empty; a file without a licence has empty labels and score 0; repeated rows get equal results, null ids
are like any other; a very long text is read whole, in memory in proportion to it; an empty table gives none; only the id and the
text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Chunk, Hasher, chunks, text_column

#: (label, template, mandatory key phrase); "*" matches any one word.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version *", "general public license"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright"),
    ("epl", "under the terms of the eclipse public license v * 0", "eclipse public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0", "license identifier apache"),
    ("gpl", "spdx license identifier gpl * 0", "license identifier gpl"),
    ("bsd", "spdx license identifier bsd * clause", "license identifier bsd"),
    ("cc-by", "creative commons attribution * 0 international", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike * 0 international", "attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial * 0 international", "attribution noncommercial"),
    ("cc-by-nd", "creative commons attribution noderivatives * 0 international", "attribution noderivatives"),
    ("cc-by", "licensed under cc by * 0", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc * 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa * 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd * 0", "cc by nd"),
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

_OTHER = np.zeros(256, bool)
_OTHER[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index:
    """Templates by word and position; words are numbered, 0 stands for any other."""

    def __init__(self, idf: dict[str, float] | None = None):
        self.vocabulary = sorted({w for _, t, k in TEMPLATES for w in f"{t} {k}".split() if w != "*"})
        number = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        data = np.frombuffer("".join(self.vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary])
        hashes = Hasher(data).ranges(ends - [len(w) for w in self.vocabulary], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = [(label, np.array([number.get(w, -1) for w in t.split()]), [number[w] for w in k.split()]) for label, t, k in TEMPLATES]
        self.base = {label: [number[w] for w in p.split()] for label, p in BASE.items()}
        self.idf = np.array([0.0, *((idf or {}).get(w, 1.0) for w in self.vocabulary)])
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, template, _) in enumerate(self.templates):
            for q, w in enumerate(template.tolist()):
                if w > 0:
                    self.postings[w].append((t, q))
        self.distinct = [len({w for w in t.tolist() if w > 0}) for _, t, _ in self.templates]
        rare = {max(k, key=lambda w: self.idf[w]) for _, _, k in self.templates}
        self.is_rare = np.isin(np.arange(len(self.vocabulary) + 1), sorted(rare))

    def numbered(self, c: Chunk) -> np.ndarray:
        c.data = _LOWER[c.data]
        c.words(_OTHER)
        h = Hasher(c.data).ranges(c.starts, c.ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at] + 1, 0)


def _runs(words: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Places where the phrase's words stand in a row."""
    at = np.flatnonzero(words == phrase[0])
    at = at[at + len(phrase) <= len(words)]
    for i, w in enumerate(phrase[1:], 1):
        at = at[words[at + i] == w]
    return at


def _aligned(words: list[int], template: list[int]) -> int:
    """How many of the template's words stand in order among ``words``; a negative one matches any."""
    row = [0] * (len(words) + 1)
    for t in template:
        before = 0
        for i, w in enumerate(words, 1):
            before, row[i] = row[i], before + 1 if w == t or t < 0 else max(row[i], row[i - 1])
    return row[-1]


def _score(index: Index, words: np.ndarray, probes: int, coverage: float, band: int) -> tuple[set[str], float]:
    """Labels found in one file, and the best coverage among them."""
    places = defaultdict(list)
    for p in np.flatnonzero(words).tolist():
        places[int(words[p])].append(p)
    votes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # template to (begin, word)
    taken: Counter = Counter()
    for w in sorted(places, key=lambda w: (-index.idf[w], w)):
        for t in {t for t, _ in index.postings[w]}:
            taken[t] += 1
        for t, q in index.postings[w]:
            if taken[t] <= probes:
                votes[t] += [(p - q, w) for p in places[w]]
    labels, best = set(), 0.0
    for t, found in votes.items():
        label, template, key = index.templates[t]
        if not all(w in places for w in key):
            continue
        found.sort()
        need, at = min(2, index.distinct[t]), 0
        while at < len(found):
            upto = at
            while upto < len(found) and found[upto][0] - found[at][0] <= band:
                upto += 1
            if len({w for _, w in found[at:upto]}) >= need:
                lo, hi = max(0, found[at][0]), min(len(words), found[upto - 1][0] + len(template) + band)
                stretch = words[lo:hi]
                share = _aligned(stretch.tolist(), template.tolist()) / len(template)
                if share >= coverage and len(_runs(stretch, key)):
                    labels.add(label)
                    best = max(best, share)
            first = found[at][0]
            while at < len(found) and found[at][0] == first:
                at += 1
    return labels, best


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each template word, and (as "") all documents, of a partition."""
    index, found, rows = Index(), np.zeros(0, np.int64), 0
    found = np.zeros(len(index.vocabulary) + 1, np.int64)
    for batch in batches:
        rows += batch.num_rows
        for c in chunks(text_column(batch)):
            words = index.numbered(c)
            owner = np.repeat(np.arange(c.n), np.diff(c.word_offsets))
            found += np.bincount(np.unique(owner * len(found) + words) % len(found), minlength=len(found))
    yield pa.RecordBatch.from_arrays([pa.array(["", *index.vocabulary]), pa.array([rows, *found[1:].tolist()], pa.int64())], ["word", "n"])


def _scan(batches: Iterator[pa.RecordBatch], idf: dict[str, float], probes: int, coverage: float, band: int) -> Iterator[pa.RecordBatch]:
    index = Index(idf)
    for batch in batches:
        n = batch.num_rows
        n_words, n_base, first, last, score = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros(n)
        base_labels, labels = [""] * n, [""] * n
        for c in chunks(text_column(batch)):
            words = index.numbered(c)
            n_words[c.first : c.first + c.n] = np.diff(c.word_offsets)
            hit = np.unique(np.searchsorted(c.word_offsets, np.flatnonzero(index.is_rare[words]), "right") - 1)
            for i in hit.tolist():
                own, row = words[c.word_offsets[i] : c.word_offsets[i + 1]], c.first + i
                at = {label: _runs(own, phrase) for label, phrase in index.base.items()}
                everywhere = np.concatenate(list(at.values()))
                base = {label for label, x in at.items() if len(x)}
                found, best = _score(index, own, probes, coverage, band)
                if len(everywhere):
                    n_base[row], first[row], last[row] = len(everywhere), int(everywhere.min()), int(everywhere.max())
                base_labels[row], labels[row], score[row] = ",".join(sorted(base)), ",".join(sorted(base | found)), best
        columns = [pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, probes: int = 6, coverage: float = 0.8, band: int = 4) -> DataFrame:
    """A row per row of ``docs``; see the module's docstring. ``score`` is the best coverage of a template found, in [0, 1]."""
    texts = docs.select("doc_id", "text")
    counts = texts.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"]: r["n"] for r in counts.collect()}  # the templates' vocabulary, whatever the corpus
    idf = {w: float(np.log((df.get("", 0) + 1) / (n + 1))) for w, n in df.items() if w}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda b: _scan(b, idf, probes, coverage, band), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_index(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
