"""Near copies by the exact Jaccard similarity of their word-shingle sets; MinHash bands find the candidates.

A text is the set of its shingles (lower-cased words, a shorter text is one shingle). Texts with equal sets are one node. A node
has ``BANDS`` keys of ``ROWS`` minima each; two sets of Jaccard similarity s share a key with probability 1 - (1 - s**5)**16, which is
0.998 at 0.8 and 0.9999 at 0.85. Each candidate pair is verified by its sets before it is linked.

Pairs are taken in rounds, so that a large group of close copies costs as many pairs as it has members: in each bucket all are
compared with one pivot, links are joined to components, and only buckets that still hold several components go on. After
``PIVOTS`` rounds all pairs of different components in a bucket are compared. Before sets are fetched, a bound rules pairs out within
the join: each set has a bitmap of ``BITS`` places that its shingles' hashes name; a place that only one of two sets names holds a shingle
that the other lacks, so the bitmaps give the most that the sets can share. Nothing is capped or left out: what is not compared
is in one component already, or not similar enough. Only members of shared buckets have their sets built. Joins merge, whatever size
the planner expects: keys, pairs and sets are exploded or compressed, and many times what it takes them to be.

Defined cases: null or wordless text is the empty set, and all empty sets are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import stored
from .textops import Hasher, chunks, mixed, seeded, text_column

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BANDS, ROWS, PIVOTS, BITS = 16, 5, 2, 1024


def _sets(text_rows: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk: sorted distinct shingles of its texts in a row, and how many each text has."""
    for c in chunks(text_rows):
        c.data = _LOWER[c.data]
        c.words()
        n = np.diff(c.word_offsets)
        k = np.minimum(n, shingle)
        number = np.where(n > 0, n - k + 1, 0)
        owner = np.repeat(np.arange(c.n), number)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number - c.word_offsets[:-1], number)
        h = Hasher(Hasher(c.data).ranges(c.starts, c.ends)).ranges(start, start + k[owner])
        order = np.lexsort((h, owner))
        h = h[order]  # owner is sorted as it is
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield h[new], np.bincount(owner[new], minlength=c.n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _names(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(h), dtype=_U)])
    ends = np.cumsum(sizes)
    return mixed(sums[ends] - sums[ends - sizes] + sizes.astype(_U))


def with_bands(docs: DataFrame, keep: list[str], shingle: int, seed: int) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``_print`` (the set's hash), ``_size``, ``_keys`` (none for the empty set) and ``_bits``."""
    factors = seeded(BANDS * ROWS, seed) | _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, keys, bits = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), _U)], [np.zeros((0, BITS // 64), _U)]
            for h, sizes in _sets(text_column(batch), shingle):
                some = np.flatnonzero(sizes)
                begins = (np.cumsum(sizes) - sizes)[some]
                own = np.zeros((len(some), BANDS), _U)
                for i in range(BANDS * ROWS if len(some) else 0):
                    own[:, i // ROWS] = mixed(own[:, i // ROWS] + np.minimum.reduceat(h * factors[i], begins) + _U(i))
                places = np.zeros((len(sizes), BITS), bool)
                places[np.repeat(np.arange(len(sizes)), sizes), (mixed(h) >> _U(54)).astype(np.int64)] = True
                bits.append(np.packbits(places, axis=1, bitorder="little").view(_U))
                names.append(_names(h, sizes))
                counts.append(sizes)
                keys.append(own)
            sizes = np.concatenate(counts)
            offsets = np.concatenate([[0], np.cumsum(BANDS * (sizes > 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(keys).ravel()))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (BITS // 64)), _signed(np.concatenate(bits).ravel()))
            yield pa.RecordBatch.from_arrays([*kept, _signed(np.concatenate(names)), pa.array(sizes, pa.int64()), lists, maps], [*keep, "_print", "_size", "_keys", "_bits"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema]
    return source.mapInArrow(run, ", ".join([*kinds, "_print long, _size long, _keys array<long>, _bits array<long>"]))


def _with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """_print and _set for ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, sizes in _sets(text_column(batch), shingle):
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([_signed(_names(h, sizes)), pa.ListArray.from_arrays(offsets, _signed(h))], ["_print", "_set"])

    return texts.select("text").mapInArrow(run, "_print long, _set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    left = pairs.join(sets.select(F.col("_print").alias("a"), F.col("_set").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("_print").alias("b"), F.col("_set").alias("sb")).hint("merge"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def near_copy_classes(docs: DataFrame, rows: DataFrame, key: list[str], shingle: int, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """_print and component for each node that is linked to another. ``rows``: what ``with_bands`` gives for ``docs``, whose rows ``key`` names.

    ``more``: further keys (_print, key) of nodes; those that share one are candidates, too.
    """
    nodes = stored(rows.groupBy("_print").agg(F.min(F.struct(*key)).alias("first"), F.first("_size").alias("_size"), F.first("_keys").alias("_keys"), F.first("_bits").alias("_bits")), "nodes")
    keyed = nodes.select("_print", "_size", F.explode("_keys").alias("key"))
    if more is not None:
        keyed = keyed.union(nodes.select("_print", "_size").join(more.hint("merge"), "_print").select("_print", "_size", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = stored(keyed.join(shared.hint("merge"), "key"), "buckets")
    members = nodes.join(buckets.select("_print").distinct().hint("merge"), "_print", "left_semi").select("first.*")
    sets = stored(_with_sets(docs.select("text", *key).join(members.hint("merge"), key, "left_semi"), shingle).dropDuplicates(["_print"]), "sets")
    maps = nodes.select(F.col("_print").alias("_p"), "_bits")
    links, classes = None, None
    for turn in range(PIVOTS + 1):
        if classes is not None:
            buckets = buckets.drop("component").join(classes.withColumnRenamed("node", "_print").hint("merge"), "_print", "left")
            buckets = buckets.withColumn("component", F.coalesce("component", "_print"))
            open_ = buckets.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
            buckets = stored(buckets.join(open_.hint("merge"), "key", "left_semi"), "buckets")
            if not buckets.take(1):
                break
        else:
            buckets = buckets.withColumn("component", F.col("_print"))
        small = buckets.join(maps.hint("merge"), F.col("_print") == F.col("_p")).select("key", "_print", "_size", "component", "_bits")
        if turn < PIVOTS:
            other = small.groupBy("key").agg(F.min_by(F.struct("_print", "_size", "component", "_bits"), F.xxhash64("_print", F.lit(turn))).alias("p")).select("key", "p.*")
        else:
            other = small
        other = other.select("key", F.col("_print").alias("b"), F.col("_size").alias("nb"), F.col("component").alias("cb"), F.col("_bits").alias("bb"))
        own = sum((F.bit_count(F.get("_bits", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("bb", F.lit(i))))) for i in range(BITS // 64)), F.lit(0))
        others = sum((F.bit_count(F.get("bb", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("_bits", F.lit(i))))) for i in range(BITS // 64)), F.lit(0))
        most = F.least(F.col("_size") - own, F.col("nb") - others)  # that both can have
        apart = (F.col("component") != F.col("cb")) & (F.least("_size", "nb") >= similarity * F.greatest("_size", "nb")) & (most >= similarity * (F.col("_size") + F.col("nb") - most))
        if turn == PIVOTS:
            apart &= F.col("_print") < F.col("b")
        pairs = small.join(other.hint("merge"), (small["key"] == other["key"]) & apart).select(F.greatest("_print", "b").alias("a"), F.least("_print", "b").alias("b")).distinct()
        found = stored(_verified(pairs, sets, similarity), "links")
        links = found if links is None else links.union(found)
        classes = stored(components(links), "classes")
    return classes.withColumnRenamed("node", "_print")
