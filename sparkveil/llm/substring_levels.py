"""Substring dedup by level-wise doubling over word windows.

A window of ``width`` words is a repeat if its words also start in a document with a smaller id. Level one looks at windows
of half the width, and only at one in each full window: the one whose hash is smallest, which equal windows share. Half
windows that occur in one document alone end there. The rest are extended to the full width: first all windows around one
half window together (its *reach*), and only where a reach is new in the smallest document that has it, window by window.
Rows that a smaller document of the same Arrow batch already settles skip the search, so a large group of copies is thinned
out before the shuffle. Half windows, reaches and windows are counted with partial aggregation and joined, so that no task
holds all places of a very common one.

Defined cases: a null text is empty; a document with a null id takes no part in matching (no id is smaller or larger) and
is returned whole; rows that share an id are not repeats of each other, and each is judged by its own text (a row's key is its id and
its text's hash); ids are integers; a very long text is read whole, in memory in proportion to it; an empty table gives an empty
result; columns other than the id and the text are not read, whatever their names. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, stored
from .textops import Chunk, Hasher, chunks, mixed, sliding_argmin, spans_to_mask, text_column

_U = np.uint64
_TOGETHER = 12 << 20  # bytes of text whose runs are compared before the shuffle


def _pack(lo: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A run of windows in one long: first start, further starts (8 bits)."""
    return (lo << 8) | more


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> 8, x & 0xFF


def _word_hashes(c: Chunk) -> Hasher:
    c.words()
    return Hasher(Hasher(c.data).ranges(c.starts, c.ends))


def _reaches(c: Chunk, width: int) -> tuple[np.ndarray, ...]:
    """Text, first start, further starts, half-window hash and reach hash of each run of windows that share a half window."""
    h, half = _word_hashes(c), (width + 1) // 2
    n = len(c.starts)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    i = np.arange(n - half + 1)
    grams = h.ranges(i, i + half)
    at = sliding_argmin(grams, width - half + 1)
    text = np.repeat(np.arange(c.n), np.diff(c.word_offsets))
    start = np.flatnonzero(np.arange(n - width + 1) + width <= c.word_offsets[1:][text[: n - width + 1]])
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else lo
    of = text[lo]
    return of, lo - c.word_offsets[of], hi - lo, grams[at[new]], h.ranges(lo, hi + width)


def _settled_here(parts: list[tuple]) -> pa.RecordBatch:
    """Runs of some texts; those that a smaller document among them settles are marked, and spread, as nothing compares them any more."""
    doc, text, run, core, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = mixed(core.view(_U) ^ (reach.view(_U) * _U(0x9E3779B97F4A7C15)))
    order = np.lexsort((doc, key))
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    least = doc[order][first][np.cumsum(first) - 1]
    sure = np.zeros(len(doc), bool)
    sure[order] = doc[order] > least
    core = np.where(sure, mixed(text.view(_U) * _U(31) + run.view(_U)), core.view(_U))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, text, run, core.view(np.int64), reach.view(np.int64), sure)], ["k", "h", "run", "core", "reach", "sure"])


def _first_level(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, parts, size = [batch.column(i).to_numpy() for i in range(2)], [], 0
        for c in chunks(text_column(batch)):
            of, lo, more, core, reach = _reaches(c, width)
            if len(of):
                parts.append((*(x[c.first + of] for x in keys), _pack(lo, more), core, reach))
            size += len(c.data)
            if size > _TOGETHER and parts:
                yield _settled_here(parts)
                parts, size = [], 0
        if parts:
            yield _settled_here(parts)


def _window_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of the runs in ``open``."""
    for batch in batches:
        keys, opened = [batch.column(i).to_numpy() for i in range(2)], batch.column(3)
        for c in chunks(text_column(batch)):
            h, out = _word_hashes(c), []
            for i in range(c.n):
                lo, more = _unpack(np.array(opened[c.first + i].as_py(), np.int64))
                starts = np.repeat(lo, more + 1) + np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                at = starts + c.word_offsets[i]
                out.append((*(np.full(len(starts), x[c.first + i]) for x in keys), _pack(starts, 0 * starts), h.ranges(at, at + width).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k", "h", "run", "window"])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_column(batch, "text")
        counts, removed, spans, kept = [], [], [], []
        for text, cuts in zip(texts, zip(batch.column(2), batch.column(3), strict=True), strict=True):
            text = text.as_py()
            words = text.split()
            cuts = np.array([x for c in cuts for x in c.as_py() or ()], np.int64)
            mask = None
            if len(cuts):
                lo, more = _unpack(cuts)
                mask = spans_to_mask(len(words), lo, more + width)
            counts.append(len(words))
            if mask is None or not mask.any():
                removed.append(0)
                spans.append([])
                kept.append(b" ".join(words))
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                removed.append(int(mask.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
        )


def remove_repeated_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words) and kept_text (kept words, joined by one space), a row per row of ``docs``.

    ``width`` is at least 2 and at most 255 words.
    """
    key = ["k", "h"]
    base = docs.select("doc_id", F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), "text")
    able = base.where("k IS NOT NULL").select(*key, "text")
    runs = able.mapInArrow(lambda b: _first_level(b, width), "k long, h long, run long, core long, reach long, sure boolean")
    # level one: half windows of one document alone end here
    tally = runs.where("NOT sure").groupBy("core").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("reach").alias("a"), F.max("reach").alias("b"))
    cores = stored(tally.where("lo < hi").select("core", (F.col("a") != F.col("b")).alias("varied")), "cores")
    release(docs.sparkSession)
    some = stored(runs.join(cores, "core", "left").where("sure OR varied IS NOT NULL"), "repeats")
    release(docs.sparkSession)
    reaches = some.where("NOT sure").groupBy("core", "reach").agg(F.min("k").alias("first"))
    judged = some.where("NOT sure").join(reaches, ["core", "reach"]).select(*key, "run", (F.col("k") > F.col("first")).alias("settled"), "varied")
    sure = some.where("sure").select(*key, "run", F.lit(True).alias("settled"), F.lit(False).alias("varied"))
    found = judged.where("settled OR varied").union(sure).groupBy(*key)
    found = stored(found.agg(F.collect_set(F.when(F.col("settled"), F.col("run"))).alias("gone"), F.collect_set(F.when(~F.col("settled"), F.col("run"))).alias("open")), "windows")
    # level two: window by window, where a reach is new in the smallest document that has it
    windows = able.join(found.where(F.size("open") > 0).select(*key, "open"), key).mapInArrow(lambda b: _window_rows(b, width), "k long, h long, run long, window long")
    windows = stored(windows, "level")
    first = windows.groupBy("window").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("window", "first")
    late = windows.join(first, "window").where("k > first").groupBy(*key).agg(F.collect_set("run").alias("late"))
    cuts = found.select(*key, "gone").join(late, key, "left")
    out = base.join(cuts, key, "left").select("doc_id", "text", "gone", "late")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(lambda b: _cut(b, width), f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")


def op10_substring_levels(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The contract, window by window.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT doc_id, list(i) AS starts FROM g JOIN f USING (s) WHERE doc_id > first GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS gone FROM r),
e AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE [w[i] for i in list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)))] END, ' ')) AS kept_sha256
FROM e
"""
