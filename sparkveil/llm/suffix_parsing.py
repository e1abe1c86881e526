"""Suffix-array dedup by prefix-free parsing.

A byte is removed if a string of ``width`` bytes that covers it also starts elsewhere. A rolling hash over 16 bytes triggers: of
the triggers in the first half of a window, the one with the smallest hash (the first of equal ones) begins a phrase of
half the width, so equal windows have equal phrases at equal places. Consecutive windows with one phrase form its *reach*.

The dictionary is the table of phrases with their reaches, counted over the corpus. A phrase with one occurrence ends there:
none of its windows repeats. A reach that occurs twice is repeated as a whole. What is left are phrases that occur in
different reaches: one occurrence of each such reach goes, by phrase, to a shard. There the suffixes that begin at phrases
are sorted (suffix array and LCP of the parse), and the bytes before the phrases are ranked by one more byte at a time
(suffixes of the dictionary's phrases). A window that starts b bytes before its phrase repeats if a neighbour in the joint
order shares width - b bytes after, and b bytes before.

A phrase with more than ``crowded`` reaches forms no shard: the windows of its reaches are counted by their hashes. Phrases,
reaches and such windows are counted with partial aggregation and joined, and identical reaches in one Arrow batch are merged
before the shuffle, so no task has to hold what a very common passage brings.

Defined cases: null text is empty; nulls among ids are fine, their texts count; two rows with one text repeat each other, also if
they share an id or have none (a row's key is its id and its text's hash); ids are integers; texts shorter than ``width`` stay whole;
a very long text is read whole, in memory in proportion to it; an empty table gives none; only the id and the text are read,
whatever other columns there are. Phrases, reaches and crowded windows are compared by 64-bit hashes, everything in a shard byte
by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, release, stored
from .textops import Chunk, Hasher, chunks, mixed, sliding_argmin, spans_to_mask, text_column

_U = np.uint64
_TRIGGER = 16
_SHARD_ROWS = 20_000


def _pack(lo, more, lead) -> np.ndarray:
    """First window (40 bits), further windows (8), phrase after the first window's start (8)."""
    return ((lo.astype(_U) << _U(16)) | (more.astype(_U) << _U(8)) | lead.astype(_U)).view(np.int64)


def _unpack(x: np.ndarray) -> tuple[np.ndarray, ...]:
    x = x.view(_U)
    return tuple(((x >> _U(s)) & _U(m)).astype(np.int64) for s, m in ((16, 0xFFFFFFFFFF), (8, 0xFF), (0, 0xFF)))


def _reaches(c: Chunk, width: int) -> tuple[np.ndarray, ...]:
    """Text, first window, further windows, lead, phrase hash and reach hash of each reach."""
    n, half = len(c.data), width // 2
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    h = Hasher(c.data)
    i = np.arange(n - half + 1)
    at = sliding_argmin(h.ranges(i, i + _TRIGGER), width - half + 1)
    text = np.repeat(np.arange(c.n), np.diff(c.offsets))[: n - width + 1]
    start = np.flatnonzero(np.arange(n - width + 1) + width <= c.offsets[1:][text])
    at, text = at[start], text[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    lo, at, of = start[new], at[new], text[new]
    hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else lo
    return of, lo - c.offsets[of], hi - lo, at - lo, h.ranges(at, at + half), mixed(h.ranges(lo, hi + width) + (at - lo).astype(_U))


def _parse(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, parts = [batch.column(i).to_numpy() for i in range(2)], []

        def merged(parts: list) -> pa.RecordBatch:
            doc, text, run, phrase, reach = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(mixed(phrase ^ (reach * _U(0x9E3779B97F4A7C15))), kind="stable")
            p, r = phrase[order], reach[order]
            first = np.ones(len(order), bool)
            first[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
            times = np.diff(np.append(np.flatnonzero(first), len(order)))
            n = np.zeros(len(order), np.int64)
            n[order[first]] = times  # the others' is 0: they are merged into the first, and spread
            phrase = np.where(n == 0, mixed(text.view(_U) * _U(31) + run.view(_U)), phrase)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, text, run, phrase.view(np.int64), reach.view(np.int64), n)], ["k", "h", "run", "phrase", "reach", "n"])

        size = 0
        for c in chunks(text_column(batch)):
            of, lo, more, lead, phrase, reach = _reaches(c, width)
            if len(of):
                parts.append((*(x[c.first + of] for x in keys), _pack(lo, more, lead), phrase, reach))
            size += len(c.data)
            if size > 16 << 20 and parts:
                yield merged(parts)
                parts, size = [], 0
        if parts:
            yield merged(parts)


def _word_hashes(c: Chunk) -> Hasher:
    c.words()
    return Hasher(Hasher(c.data).ranges(c.starts, c.ends))


def _word_parse(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Reaches in words: first window, further windows, and hashes of the phrase of half a window and of the reach."""
    half = size // 2
    for batch in batches:
        k, h = (batch.column(i).to_numpy() for i in range(2))
        for c in chunks(text_column(batch)):
            words, n = _word_hashes(c), len(c.starts)
            if n < size:
                continue
            i = np.arange(n - half + 1)
            phrase = words.ranges(i, i + half)
            at = sliding_argmin(phrase, size - half + 1)
            text = np.repeat(np.arange(c.n), np.diff(c.word_offsets))[: n - size + 1]
            start = np.flatnonzero(np.arange(n - size + 1) + size <= c.word_offsets[1:][text])
            if not len(start):
                continue
            at, text = at[start], text[start]
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            lo, of = start[new], text[new]
            hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
            row = c.first + of
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[row], h[row], lo - c.word_offsets[of], hi - lo, phrase[at[new]].view(np.int64), words.ranges(lo, hi + size).view(np.int64))], ["k", "h", "lo", "more", "phrase", "reach"])


def _word_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The hash of each window of the reaches in ``open``, with what the reach carries."""
    for batch in batches:
        opened = batch.column(1)
        for c in chunks(text_column(batch)):
            words, own = _word_hashes(c), opened.slice(c.first, c.n)
            lo, more, reach, x, y = (own.flatten().field(i).to_numpy() for i in range(5))
            of, times = np.repeat(np.arange(c.n), own.value_lengths().to_numpy()), more + 1
            at = np.repeat(lo + c.word_offsets[of], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(words.ranges(at, at + size).view(np.int64)), *(pa.array(np.repeat(v, times)) for v in (reach, x, y))], ["window", "reach", "x", "y"])


def shared_passages(base: DataFrame, size: int) -> DataFrame:
    """k, h and n_shared_windows, for each text of ``base`` (k, h, text) with windows of ``size`` words that another document also has, however its words are spaced.

    The same parse as of bytes, by words: a phrase that one document has ends there, a reach that several have is shared as a whole, and of
    the other phrases with different reaches, one occurrence of each reach has its windows compared.
    """
    key, own = ["k", "h"], F.xxhash64("k", "h")
    runs = stored(base.mapInArrow(lambda b: _word_parse(b, size), "k long, h long, lo long, more long, phrase long, reach long"), "word-runs")
    tally = runs.groupBy("phrase").agg(F.min(own).alias("x"), F.max(own).alias("y"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
    # written, so that the join below reads two plain shuffles: of a very common phrase, Spark can then split the task
    tally = stored(tally.where("x <> y").select("phrase", (F.col("lo") != F.col("hi")).alias("varied")), "word-phrases")
    some = stored(runs.join(tally, "phrase").drop("phrase"), "word-repeats")
    discard(runs)
    reaches = some.groupBy("reach").agg(F.first("varied").alias("varied"), F.first("more").alias("more"), F.min(own).alias("x"), F.max(own).alias("y"), F.min(F.struct(*key, "lo")).alias("at"))
    reaches = stored(reaches, "word-reaches")
    opened = reaches.where("varied").groupBy("at.k", "at.h").agg(F.collect_list(F.struct("at.lo", "more", "reach", "x", "y")).alias("open"))
    windows = base.join(opened, key).select("text", "open").mapInArrow(lambda b: _word_windows(b, size), "window long, reach long, x long, y long")
    windows = stored(windows, "word-windows")
    several = windows.groupBy("window").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("window")
    met = windows.where("x = y").join(several, "window").groupBy("reach").agg(F.count(F.lit(1)).alias("n"))
    whole = reaches.where("x <> y").select("reach", (F.col("more") + 1).alias("n"))
    counted = some.join(whole.union(met), "reach").repartition(*key).groupBy(*key, "lo").agg(F.max("n").alias("n"))
    out = stored(counted.groupBy(*key).agg(F.sum("n").alias("n_shared_windows")), "passages")
    for done in (tally, some, reaches, windows):
        discard(done)
    return out


def _surroundings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of the reaches in ``open``: the bytes before (from the last one back) and after the phrase's start, or, of a crowded phrase, each window's hash."""
    for batch in batches:
        rows: list[tuple] = []
        for k, h, text, opened in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_column(batch), batch.column(3).to_pylist(), strict=True):
            text, hasher = text.as_py(), None
            for o, (lo, more, lead) in zip(opened, zip(*(x.tolist() for x in _unpack(np.array([o["run"] for o in opened], np.int64))), strict=True), strict=True):
                if o["crowded"]:
                    hasher = hasher or Hasher(np.frombuffer(text, np.uint8))
                    start = np.arange(lo, lo + more + 1)
                    rows += [(None, w, k, h, r, o["settled"], None, None) for w, r in zip(hasher.ranges(start, start + width).view(np.int64).tolist(), _pack(start, 0 * start, 0 * start).tolist(), strict=True)]
                else:
                    at = lo + lead
                    rows.append((o["phrase"], None, k, h, o["run"], o["settled"], text[lo:at][::-1], text[at : lo + more + width]))
            if len(rows) > 4000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_SURROUNDINGS = pa.schema([("shard", pa.int64()), ("window", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("run", pa.int64()), ("settled", pa.bool_()), ("before", pa.binary()), ("after", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SURROUNDINGS.types, strict=True)], schema=_SURROUNDINGS)


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows, padded with zeros, and their lengths."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    out = np.zeros((len(column), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(column), np.uint8)
    return out, sizes


def repeated_windows(shard: np.ndarray, before: list[bytes], after: list[bytes], near: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
    """By occurrence and b: is the window that starts b bytes before the phrase also in another occurrence of the same shard.

    ``before`` is reversed. An occurrence has windows for b from ``near`` to ``far``.
    """
    m = len(shard)
    right, right_size = _matrix(after, width)
    left, left_size = _matrix(before, max(1, int(far.max(initial=0))))
    # suffix array of the parse within the shards, and the common prefixes of neighbours
    order = np.lexsort((right_size, np.ascontiguousarray(right).view(f"S{width}").ravel(), shard))
    right, right_size, left, left_size, shard = right[order], right_size[order], left[order], left_size[order], shard[order]
    near, far = near[order], far[order]
    same = right[1:] == right[:-1]
    lcp = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(right_size[1:], right_size[:-1]))
    lcp[shard[1:] != shard[:-1]] = -1
    out = np.zeros((m, 256), bool)
    rank = np.zeros(m, np.int64)  # of the b bytes before, among equal ones
    for b in range(int(far.max(initial=-1)) + 1):
        if b:
            # one byte more before the phrase; a text that begins there ranks alone
            step = np.where(left_size >= b, left[:, b - 1].astype(np.int64), 256 + np.arange(m))
            _, rank = np.unique(rank * (257 + m) + step, return_inverse=True)
        run = np.concatenate([[0], np.cumsum(lcp < width - b)])  # neighbours that share width - b bytes
        has = np.flatnonzero((near <= b) & (b <= far))
        key = run[has] * m + rank[has]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        out[order[has], b] = times[which] > 1
    return out


def _in_shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; whole shards are gathered up to about _SHARD_ROWS rows."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        k, h = table["k"].to_numpy(), table["h"].to_numpy()
        lo, more, lead = _unpack(table["run"].to_numpy())
        hit = repeated_windows(table["shard"].to_numpy(), table["before"].to_pylist(), table["after"].to_pylist(), lead - more, lead, width)
        hit[table["settled"].to_numpy()] = False
        row, b = np.nonzero(hit)
        if not len(row):
            return None
        zero = np.zeros_like(row)
        return pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(h[row]), pa.array(_pack(lo[row] + lead[row] - b, zero, zero))], ["k", "h", "run"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < _SHARD_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table["shard"].to_numpy()
        cut = int(np.searchsorted(shard, shard[-1], "left"))
        if cut and (out := solve(table.slice(0, cut).combine_chunks())):
            yield out
        held = table.slice(cut).combine_chunks().to_batches()
    if held and (out := solve(pa.Table.from_batches(held).combine_chunks())):
        yield out


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, cuts in zip(text_column(batch), zip(batch.column(2), batch.column(3), strict=True), strict=True):
            text = text.as_py()
            cuts = np.array([x for c in cuts for x in c.as_py() or ()], np.int64)
            sizes.append(len(text))
            if len(cuts):
                lo, more, _ = _unpack(cuts)
                mask = spans_to_mask(len(text), lo, more + width)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)
                removed.append(int(mask.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
            else:
                removed.append(0)
                spans.append([])
                kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), batch.column(4), batch.column(5)], ["doc_id", "n_bytes", "n_removed", "spans", "kept", "n_shared_phrases", "n_shared_windows"])


def remove_repeated_bytes(docs: DataFrame, width: int = 400, crowded: int = 1024, passage: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (the other bytes), a row per row of ``docs``.

    n_shared_phrases: how many reaches' phrases, of half the width, also occur elsewhere; a passage that is shorter than ``width``, and so stays,
    may show there. n_shared_windows: how many windows of ``passage`` words another document also has, which shows every passage of so many words,
    however many bytes it has. ``width`` is at least 32 and at most 510 bytes.
    """
    key = ["k", "h"]
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    passages = shared_passages(base.select(*key, "text"), passage)
    runs = base.select(*key, "text").mapInArrow(lambda b: _parse(b, width), "k long, h long, run long, phrase long, reach long, n long")
    tally = runs.where("n > 0").groupBy("phrase").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("rows"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
    phrases = stored(tally.where("times > 1").select("phrase", (F.col("lo") != F.col("hi")).alias("varied"), (F.col("rows") > crowded).alias("crowded")), "phrases")
    release(docs.sparkSession)
    some = stored(runs.join(phrases, "phrase", "left").where("n = 0 OR varied IS NOT NULL"), "repeats")
    release(docs.sparkSession)
    own = F.struct(*key, "run")
    reaches = some.where("n > 0").groupBy("phrase", "reach").agg(F.sum("n").alias("times"), F.min(own).alias("first"))
    judged = some.where("n > 0").join(reaches, ["phrase", "reach"]).select(*key, "run", "phrase", "crowded", (F.col("times") > 1).alias("settled"), (F.col("varied") & (own == F.col("first"))).alias("opened"))
    merged = some.where("n = 0").select(*key, "run", "phrase", "crowded", F.lit(True).alias("settled"), F.lit(False).alias("opened"))
    found = judged.where("settled OR opened").union(merged).groupBy(*key)
    found = found.agg(F.collect_set(F.when(F.col("settled"), F.col("run"))).alias("gone"), F.collect_set(F.when(F.col("opened"), F.struct("run", "phrase", "settled", "crowded"))).alias("open"))
    found = stored(found, "reaches")
    kind = "shard long, window long, k long, h long, run long, settled boolean, before binary, after binary"
    around = base.select(*key, "text")
    around = stored(around.join(found.where(F.size("open") > 0).select(*key, "open"), key).mapInArrow(lambda b: _surroundings(b, width), kind), "surroundings")
    release(docs.sparkSession)
    late = around.where("window IS NULL").repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda b: _in_shards(b, width), "k long, h long, run long")
    windows = around.where("window IS NOT NULL").select("window", *key, "run", "settled")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window")
    late = late.union(windows.where("NOT settled").join(often, "window").select(*key, "run"))
    late = late.groupBy(*key).agg(F.collect_set("run").alias("late"))
    shared = F.size("gone") + F.size(F.filter("open", lambda o: ~o["settled"]))
    cuts = found.select(*key, "gone", shared.cast("long").alias("shared")).join(late, key, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("shared", "n_shared_windows")]
    out = base.join(cuts, key, "left").join(passages, key, "left").select("doc_id", "text", "gone", "late", *counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(lambda b: _cut(b, width), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, n_shared_phrases long, n_shared_windows long")


def op8_suffix_parsing(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), "n_shared_phrases", "n_shared_windows")
