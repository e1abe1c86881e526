"""SimHash near-duplicates with vantage-point trees.

A fingerprint's 64 bits are cut into blocks, and the tree's level j has its vantage point in block j: that block of one fingerprint
of the table, the one with the smallest hash. A node's children are the Hamming distances to its vantage point, so a root-to-leaf path is a vector of distances and each
leaf a shard. By the triangle inequality, a query within ``radius`` of a point differs from the point's path by at most
``radius`` over all levels together: what a level's distance differs by is taken off the budget for the levels below, and a
branch is pruned when nothing is left. A fingerprint visits its own shard and the shards across the boundaries that the budget
still reaches, one way round, so every pair meets exactly once and is verified by its own bits.

Fingerprints are made distinct first, so that copies cost one row. A shard with more than ``crowded`` fingerprints
(a cluster of near copies) is not compared: all fingerprints that visit it go through a second, deeper tree (twice as many
blocks). Distinct 64-bit patterns within two bits of one another number at most 2,080, so links stay in proportion to
fingerprints whatever the groups' sizes. Joins merge at any size, as the planner takes what an explode makes to be about as large
as what went into it; only the list of crowded shards, a row for 4,096 fingerprints at most, may be sent to all.

Defined cases: null or wordless text has fingerprint zero and is linked like any other; rows with a null id are fingerprinted,
and their group's component is the smallest id that is there (null if none); repeated rows share a fingerprint; a very long text is
hashed shingle by shingle, in memory in proportion to it; an empty table gives none; only the id and the text are read, whatever
other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import shingle_sets
from .graph import components
from .storage import stored
from .textops import chunks, text_column

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_ID = -(2**63)


def _fingerprints(text_rows: pa.Array, shingle: int, seed: int) -> np.ndarray:
    out = np.zeros(len(text_rows), np.uint64)
    for c in chunks(text_rows):
        c.data = _LOWER[c.data]
        c.words()
        for i in range(c.n):
            a, b = c.word_offsets[i], c.word_offsets[i + 1]
            n = int(b - a)
            if not n:
                continue
            joined = b" ".join(c.bytes_of(i).split())
            ends = np.cumsum(c.ends[a:b] - c.starts[a:b] + 1) - 1  # of words in joined
            begins = np.concatenate([[0], ends[:-1] + 1])
            k = min(shingle, n)
            h = np.fromiter((xxh64_intdigest(joined[x:y], seed) for x, y in zip(begins[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 14):
                ones += np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[c.first + i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``_print``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _fingerprints(text_column(batch), shingle, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(prints.view(np.int64))], [*keep, "_print"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema]
    return source.mapInArrow(run, ", ".join([*kinds, "_print long"]))


def _path(fingerprint: str, blocks: int, vantage: int):
    """The distances to each level's vantage point, packed in one long."""
    width = 64 // blocks
    apart = F.col(fingerprint).bitwiseXOR(F.lit(vantage))
    ones = [F.bit_count(F.shiftrightunsigned(apart, j * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for j in range(blocks)]
    step = 64 // blocks  # a distance is at most the block's width, so it fits the block's own place with room for +-2
    return sum((F.shiftleft(x, j * step) for j, x in enumerate(ones)), F.lit(0).cast("long"))


def _visits(blocks: int, radius: int) -> list[int]:
    """Differences of packed paths that the triangle bounds leave, one of each pair of opposite ones, without zero."""
    step, found = 64 // blocks, set()
    frontier = {(0,) * blocks}
    for _ in range(radius):
        frontier |= {v[:j] + (v[j] + s,) + v[j + 1 :] for v in frontier for j in range(blocks) for s in (1, -1)}
    for v in frontier:
        packed = sum(x << (j * step) for j, x in enumerate(v))
        if packed > 0:
            found.add(packed)
    return sorted(found)


def _compared(prints: DataFrame, blocks: int, radius: int, crowded: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a, b), and the fingerprints that visit a crowded shard."""
    vantage = prints.agg(F.min_by("_print", F.xxhash64("_print", F.lit(blocks))).alias("v")).first()["v"] or 0
    points = prints.select("_print", _path("_print", blocks, vantage).alias("shard"))
    skip = None
    if crowded is not None:
        sizes = points.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)
        skip = stored(sizes.select("shard"), "crowded")
        if not skip.take(1):
            skip = None
    visits = points.select("_print", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(v).cast("long") for v in _visits(blocks, radius)))).alias("step"), "shard")
    visits = visits.select(F.col("_print").alias("a"), "step", F.try_add("shard", "step").alias("shard"))
    shards, deep = points.withColumnRenamed("_print", "b"), None
    if skip is not None:
        deep = visits.join(skip, "shard", "left_semi").select(F.col("a").alias("_print")).union(shards.join(skip, "shard", "left_semi").select(F.col("b").alias("_print"))).distinct()
        visits, shards = visits.join(skip, "shard", "left_anti"), shards.join(skip, "shard", "left_anti")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & ((F.col("step") != 0) | (F.col("a") < F.col("b")))
    return visits.join(shards.hint("merge"), (visits["shard"] == shards["shard"]) & near).select("a", "b"), deep


def near_links(prints: DataFrame, radius: int = 2, crowded: int = 4096) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in ``prints`` (_print) at most ``radius`` bits apart."""
    links, deep = _compared(prints, 8, radius, crowded)
    return links if deep is None else links.union(_compared(stored(deep, "deep"), 16, radius, None)[0])


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """_print, component (its class's smallest fingerprint) and component_id for the distinct fingerprints of ``rows``."""
    least = stored(rows.groupBy("_print").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(near_links(least.select("_print"), radius))
    linked = least.join(classes.withColumnRenamed("node", "_print").hint("merge"), "_print", "left").withColumn("component", F.coalesce("component", "_print"))
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    return linked.join(roots.hint("merge"), "component").select("_print", "component", "component_id")


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, _print, component_id (the smallest id that links reach) for each row of ``docs``."""
    rows = stored(with_fingerprint(docs, ["doc_id"], shingle, seed), "prints")
    return rows.join(_classes(rows, radius).hint("merge"), "_print").select("doc_id", "_print", "component_id")


def tree_keys(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """_print and key: nodes (_print, _finger) share a key if their fingerprints are equal, or a link of the trees.

    A link has a key of its own, so a node has as many as its fingerprint has links, and no pairs of nodes are made here.
    """
    links = near_links(nodes.select(F.col("_finger").alias("_print")).distinct(), radius)
    named = links.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("_finger"))
    same = nodes.select("_finger").groupBy("_finger").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("_finger", F.lit(0)).alias("key"), "_finger")
    return nodes.join(named.union(same).hint("merge"), "_finger").select("_print", "key")


def keep_one_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates: the one with the smallest id, then the smallest hash of its text.

    Classes are the components of pairs whose shingle sets have at least that Jaccard similarity. Candidates are what the trees over
    fingerprints find within ``radius`` bits, and, as such pairs may lie further apart, what MinHash bands find (``shingle_sets``); each is
    verified by its sets.
    A row with a null id stays only if its class has no row with an id. Rows that are equal in id and text count as one.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_k"), F.xxhash64("text").alias("_h")]
    named = docs.select("doc_id", "text", *key)
    rows = stored(shingle_sets.with_bands(named, ["doc_id", "_k", "_h"], shingle, seed), "prints")
    firsts = rows.where("_size > 0").groupBy("_print").agg(F.min(F.struct("_k", "_h")).alias("first")).select("_print", "first.*")
    fingers = with_fingerprint(named, ["_k", "_h"], shingle, seed).withColumnRenamed("_print", "_finger").dropDuplicates(["_k", "_h"])
    nodes = stored(fingers.join(firsts.hint("merge"), ["_k", "_h"]).select("_print", "_finger"), "fingers")
    classes = shingle_sets.near_copy_classes(named, rows, ["_k", "_h"], shingle, similarity, stored(tree_keys(nodes, radius), "trees"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "_k", "_h")
    firsts = rows.groupBy("_print").agg(F.min(order).alias("first")).join(classes.hint("merge"), "_print", "left")
    firsts = firsts.groupBy(F.coalesce("component", "_print").alias("component")).agg(F.min("first").alias("first")).select("first._k", "first._h")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # out of the way of the names below
    return docs.select(whole, *key).join(firsts.hint("merge"), ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select("row.*")


def op3_simhash_trees(spark, sf_dir: str) -> DataFrame:
    out = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2, 42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")
