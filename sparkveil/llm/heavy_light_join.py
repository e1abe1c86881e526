"""Size-aware heavy-light join of shingle sets by exact Jaccard similarity.

Two sets of m and l shingles are similar enough if they share ``need(m, l)`` of them. Equal sets are one node, named by 128 bits.

* Light: sets of at most ``boundary`` shingles give all their subsets of exactly need(m, l) shingles, for each size l that a partner can have.
  Sets that share such a subset are similar, so each member of a subset is linked to one set of the other size, not to all.
* Heavy: of a larger set (and of those that can be its partners) the inverted lists of its first shingles are scanned. Shingles are
  ordered by hash, frequent ones last; of its first m - ceil(percent * m / 100) + spare(m), a set shares spare(m) at least with any similar
  one that is not smaller in this, so pairs that meet in fewer lists are out. First each set is compared with one other, its hub: the most
  central of its lists (whose shingles are in the longest lists). Links are joined to components, and only lists that still hold several
  components go on. Sets that are near the same hub, though not both similar to it, are similar only if they share a deviation from it
  (a shingle that both add, or that both lack), so they meet in lists of deviations, which are short where copies of one text changed in
  different places, and the number that they share gives their similarity. All others are counted list by list. Sizes, counts and
  bitmaps rule pairs out before their sets are fetched; each pair that remains is verified by its sets.
* The boundary is chosen by cost: rows of subsets against postings, and scans of the lists measured over the small sets themselves.

Nothing is capped or sampled: the frequent shingles (the ``HEAVY`` most frequent, as counted within chunks) only change the order, and
with it the cost. No list, subset or set of copies is ever collected; they are counted by partial aggregation and joined.

Defined cases: a null or wordless text is the empty set, which is linked with nothing; a text with fewer words than a shingle is one shingle;
rows that share an id are judged by their own texts; a null id is never the smallest, so a component of null ids alone has a null id;
an empty table gives no rows; columns other than doc_id and text are not read. A very long text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import discard, stored
from .textops import mixed, text_column
from .wordsets import set_names, shingle_sets, signed

_U = np.uint64
BITS, HEAVY, SMALL, SPARE = 1024, 1 << 16, 64, 50
_NEAR = 20  # per cent by which a set that is near a hub may fall short of the similarity
_OFTEN = 3  # texts of a chunk that must hold a shingle for it to count as frequent there


def need(m: int, l: int, percent: int) -> int:  # noqa: E741
    """Shared shingles that make sets of m and l similar: 100 * shared >= percent * (m + l - shared)."""
    return -(-percent * (m + l) // (100 + percent))


def _spare(m):
    return 1 + m // SPARE


def _first(m, percent: int):
    """How many shingles from the beginning of the order are looked at: any similar set shares ``_spare`` of them, by the smaller of both."""
    return m - -(-percent * m // 100) + _spare(m)


def _classes(m: int, percent: int, boundary: int) -> list[tuple[int, int, int]]:
    """Subsets that a set of m shingles gives: sizes of the smaller and the larger set of a pair, and of the subset."""
    low, high = -(-percent * m // 100), min(boundary, 100 * m // percent)
    return [(min(m, l), max(m, l), need(m, l, percent)) for l in range(max(low, 1), high + 1)]  # noqa: E741


def subset_rows(m: int, percent: int, boundary: int = SMALL) -> int:
    return sum(comb(m, c) for _, _, c in _classes(m, percent, boundary))


@lru_cache(maxsize=256)
def _left_out(m: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(m), d)), np.int64).reshape(comb(m, d), d)


def _slices(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(sizes)
    return (values[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def _surveyed(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Each text's set (name, size, bits), the frequent shingles of a chunk with their counts (in ``more``), and the first shingles of small sets (``more``: which set)."""
    bits_type = pa.list_(pa.int64())
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for c, values, sizes in shingle_sets(text_column(batch), shingle):
            one, two = set_names(values, sizes)
            names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), c.n, [None, pa.py_buffer(np.ascontiguousarray(np.stack([one, two], 1)))]).cast(pa.binary())
            owner = np.repeat(np.arange(c.n), sizes)
            places = np.zeros((c.n, BITS), bool)
            places[owner, (mixed(values) >> _U(54)).astype(np.int64)] = True
            bits = pa.ListArray.from_arrays(pa.array(np.arange(c.n + 1, dtype=np.int32) * (BITS // 64)), signed(np.packbits(places, axis=1, bitorder="little").view(_U).ravel()))
            shingles, counts = np.unique(values, return_counts=True)
            often = counts >= _OFTEN
            small = (sizes[owner] <= SMALL) & (np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owner] < _first(sizes, percent)[owner])
            extra = np.concatenate([shingles[often], values[small]])
            n, k = c.n, len(extra)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids.slice(c.first, n), pa.nulls(k, ids.type)]), pa.concat_arrays([names, pa.nulls(k, pa.binary())]),
                    pa.array(np.concatenate([one.view(np.int64), extra.view(np.int64)])), pa.array(np.concatenate([sizes, np.zeros(often.sum(), np.int64), sizes[owner][small]])),
                    pa.concat_arrays([bits, pa.nulls(k, bits_type)]), pa.array(np.concatenate([np.zeros(n, np.int64), counts[often], one[owner[small]].view(np.int64)])),
                    pa.array(np.repeat([0, 1, 2], [n, int(often.sum()), int(small.sum())]).astype(np.int32)),
                ],
                ["doc_id", "name", "token", "size", "bits", "more", "kind"],
            )


def _light_rows(tokens: np.ndarray, percent: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets of one small set, and its side in their class: 0 the smaller set, 1 the larger, 2 either."""
    m, own, keys, sides = len(tokens), mixed(tokens + _U(7)), [], []
    total = own.sum(dtype=_U)
    for a, b, c in _classes(m, percent, boundary):
        gone = own[_left_out(m, m - c)].sum(axis=1, dtype=_U)
        keys.append(mixed(mixed(total - gone) + _U(a << 16 | b)))
        sides.append(np.full(len(gone), 2 if a == b else int(m == b), np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def _indexed(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, boundary: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of first shingles (key, set, size) and subsets of small sets (key, set, size, side)."""
    reaches = -(-percent * (boundary + 1) // 100)  # sets of this size can have a partner beyond the boundary
    for batch in batches:
        for _, values, sizes in shingle_sets(text_column(batch), shingle):
            sets, _ = set_names(values, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            late = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] == values if len(frequent) else np.zeros(len(values), bool)
            order = np.lexsort((late, owner)) if late.any() else slice(None)  # by hash within both, as the sort is stable
            place = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owner]
            take = (place < _first(sizes, percent)[owner]) & (sizes[owner] >= max(reaches, 1))
            keys, of, sides = [values[order][take]], [owner[take]], [np.full(int(take.sum()), -1)]
            for i in np.flatnonzero((sizes > 0) & (sizes <= boundary)).tolist():
                end = int(sizes[: i + 1].sum())
                key, side = _light_rows(values[end - sizes[i] : end], percent, boundary)
                keys.append(key)
                of.append(np.full(len(key), i))
                sides.append(side)
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays(
                [signed(np.concatenate(keys)), signed(sets[of]), pa.array(sizes[of].astype(np.int32)), pa.array(np.concatenate(sides).astype(np.int32))],
                ["key", "token", "size", "side"],
            )


def _sets_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, values, sizes in shingle_sets(text_column(batch), shingle):
            one, two = set_names(values, sizes)
            names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), c.n, [None, pa.py_buffer(np.ascontiguousarray(np.stack([one, two], 1)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), signed(values))], ["name", "shingles"])


def choose_boundary(sizes: dict[int, int], scans: dict[int, int], percent: int) -> int:
    """The size up to which subsets cost less than lists. ``sizes``: sets of each small size; ``scans``: rows that their lists hold together.

    A set costs its rows; each row of a list that is scanned is compared once at least, and a comparison reads the set.
    """
    best, least, light = 0, None, 0
    heavy = {m: n * _first(m, percent) + scans.get(m, 0) * (1 + m) for m, n in sizes.items()}
    rest = sum(heavy.values())
    for x in range(SMALL + 1):
        light = sum(n * subset_rows(m, percent, x) for m, n in sizes.items() if m <= x)
        rest -= heavy.get(x, 0)
        if least is None or light + rest < least:
            best, least = x, light + rest
    return best


def _boundary(survey: DataFrame, percent: int) -> int:
    small = survey.where("kind = 2").select("token", "more", "size").distinct()  # copies are one set
    sizes = survey.where(f"kind = 0 AND size BETWEEN 1 AND {SMALL}").groupBy("name").agg(F.first("size").alias("size")).groupBy("size").count()
    lists = small.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    scans = small.join(lists, "token", "left_semi").groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return choose_boundary({r["size"]: r["count"] for r in sizes.collect()}, {r["size"]: r["n"] for r in scans.collect()}, percent)  # at most SMALL rows each


def _may_share(percent: int) -> Column:
    """Whether sets (size, bits) and (size2, bits2) can share enough: a place of one bitmap alone holds a shingle that the other lacks."""
    less = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, v: s + v)
    most = F.least(F.col("size") - less("bits", "bits2"), F.col("size2") - less("bits2", "bits"))
    return (100 + percent) * most >= percent * (F.col("size") + F.col("size2"))


def _judged(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int, least: int) -> DataFrame | None:
    """Those of ``pairs`` (a, b: names, a > b) whose bitmaps allow ``least`` per cent: a, b, whether they are ``linked`` (similar) or at least
    ``near``, and then the shingles that only one of them has. None if there are none."""
    maps = nodes.select("name", "size", "bits")
    other = maps.select(F.col("name").alias("b"), F.col("size").alias("size2"), F.col("bits").alias("bits2"))
    able = stored(pairs.join(maps.withColumnRenamed("name", "a"), "a").join(other, "b").where(_may_share(least)).select("a", "b"), "pairs")
    if not able.take(1):
        return None
    members = able.select(F.col("a").alias("name")).union(able.select("b")).distinct()
    # a table of its own, so that its size is known: where it is small, no text is shuffled
    shown = stored(nodes.join(members, "name").select("doc_id").distinct(), "shown")
    texts = docs.join(shown, docs["doc_id"].eqNullSafe(shown["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(lambda b: _sets_of(b, shingle), "name binary, shingles array<long>").join(members, "name", "left_semi").dropDuplicates(["name"])
    sets = stored(sets, "sets")
    both = able.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
    shared, joined = F.col("n"), F.size("x") + F.size("y") - F.col("n")
    both = both.withColumn("n", F.size(F.array_intersect("x", "y")))
    near = 100 * shared >= (percent - _NEAR) * joined
    only = lambda p, q: F.when(near, F.array_except(p, q))
    out = stored(both.select("a", "b", (100 * shared >= percent * joined).alias("linked"), near.alias("near"), only("x", "y").alias("only_a"), only("y", "x").alias("only_b")), "judged")
    discard(sets)
    discard(shown)
    discard(able)
    return out


def _deviations(judged: DataFrame, hubs: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, hub, size, added, missing of sets that are near their hub (hubs: token, token2)."""
    of = nodes.select("name", "token", "size")
    rows = judged.where("near").join(of.withColumnsRenamed({"name": "a", "token": "ta", "size": "na"}), "a").join(of.withColumnsRenamed({"name": "b", "token": "tb", "size": "nb"}), "b")
    one = rows.select(F.col("ta").alias("token"), F.col("tb").alias("hub"), F.col("na").alias("size"), F.col("only_a").alias("added"), F.col("only_b").alias("missing"))
    two = rows.select(F.col("tb").alias("token"), F.col("ta").alias("hub"), F.col("nb").alias("size"), F.col("only_b").alias("added"), F.col("only_a").alias("missing"))
    return one.union(two).join(hubs.select("token", F.col("token2").alias("hub")), ["token", "hub"])


def _alike_by_deviations(deviations: DataFrame, classes: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b: tokens) of sets near one hub, of different components, that are similar. Two sets differ in as many shingles as they deviate, less twice what they share of it.

    So a pair must share at least a known number c of marks, and the first mark that both have, rare ones first, is among the first n - c + 1 of either.
    Only those meet; what a pair shares is counted afterwards, once for each pair.
    """
    marks = F.concat(F.transform("added", lambda v: F.struct(F.lit(1).alias("kind"), v.alias("value"))), F.transform("missing", lambda v: F.struct(F.lit(0).alias("kind"), v.alias("value"))))
    rows = deviations.withColumn("n_marks", F.size("added") + F.size("missing"))
    rows = rows.withColumn("component", F.col("token")) if classes is None else rows.join(classes, "token", "left").withColumn("component", F.coalesce("component", "token"))
    lists = stored(rows.select("hub", "token", "size", "n_marks", "component", F.inline(marks)), "deviations")
    key, own = ["hub", "kind", "value"], ["hub", "token", "size", "n_marks", "component"]
    sizes = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("x"), F.max("component").alias("y"))
    ranked = lists.join(sizes, key).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "kind", "value", (F.col("x") != F.col("y")).alias("open")))).alias("marks"))
    most = F.floor((100 - percent) * F.col("size") / percent).cast("int")  # that a similar set can differ by
    first = ranked.select(*own, F.posexplode(F.slice("marks", 1, most + 1)).alias("place", "mark")).where("mark.open")
    first = stored(first.select(*own, "place", "mark.kind", "mark.value"), "first")
    other = first.select(*key, *(F.col(c).alias(f"{c}2") for c in ("token", "size", "n_marks", "component", "place")))
    total = F.col("size") + F.col("size2")
    must = F.greatest(F.lit(1), F.ceil((F.col("n_marks") + F.col("n_marks2") - F.floor((100 - percent) * total / (100 + percent))) / 2))
    able = (F.col("place") <= F.col("n_marks") - must) & (F.col("place2") <= F.col("n_marks2") - must)
    met = first.join(other, key).where((F.col("component") != F.col("component2")) & (F.col("token") > F.col("token2")) & able)
    pairs = stored(met.select("hub", F.col("token").alias("a"), F.col("token2").alias("b")).distinct(), "met")
    side = lambda token, n: deviations.select("hub", F.col("token").alias(token), *(F.col(c).alias(f"{c}{n}") for c in ("size", "added", "missing")))
    both = pairs.join(side("a", 1), ["hub", "a"]).join(side("b", 2), ["hub", "b"])
    shared = F.size(F.array_intersect("added1", "added2")) + F.size(F.array_intersect("missing1", "missing2"))
    apart = F.size("added1") + F.size("missing1") + F.size("added2") + F.size("missing2") - 2 * shared
    total = F.col("size1") + F.col("size2")
    return both.where(100 * (total - apart) >= percent * (total + apart)).select("a", "b").distinct()  # twice the intersection, twice the union


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def _often(met: DataFrame) -> DataFrame:
    """Those pairs (a, b, n, size, size2) that meet in as many lists as similar sets must."""
    spare = lambda c: 1 + F.floor(F.col(c) / SPARE)
    return met.where(F.col("n") >= F.least(spare("size"), spare("size2"))).select("a", "b")


def _meeting(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The same for pairs (a, b): their lists are counted."""
    of = lists.select("key", F.col("token").alias("a"), "size")
    other = lists.select("key", F.col("token").alias("b"), F.col("size").alias("size2"))
    met = pairs.join(of, "a").join(other, ["key", "b"])
    return _often(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("size2").alias("size2")))


def _light_pairs(index: DataFrame, nodes: DataFrame) -> DataFrame:
    subsets = index.where("side >= 0").select("key", "token", "side").distinct()
    both = subsets.groupBy("key").agg(F.min(F.when(F.col("side") != 1, F.col("token"))).alias("p"), F.min(F.when(F.col("side") != 0, F.col("token"))).alias("q"), F.count(F.lit(1)).alias("n"))
    linked = subsets.join(both.where("n > 1 AND p IS NOT NULL AND q IS NOT NULL"), "key").select("token", F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p")).alias("other"))
    return _with_names(linked.where("token <> other").select(*_pair("token", "other")).distinct(), nodes)


def _with_names(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of tokens as pairs of names: a token is half of a name, so in the rare case of equal halves all that it can mean are taken."""
    named = nodes.select("token", "name")
    both = pairs.join(named.select(F.col("token").alias("a"), "name"), "a").join(named.select(F.col("token").alias("b"), F.col("name").alias("name2")), "b")
    return both.select(*_pair("name", "name2")).distinct()


def _on_tokens(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, component of classes (node, component) of names; equal halves of names are in the classes of both."""
    of = nodes.select("name", "token")
    rows = classes.join(of, F.col("node") == F.col("name")).select("token", "component")
    return stored(rows.join(of.select(F.col("name").alias("component"), F.col("token").alias("_c")), "component").select("token", F.col("_c").alias("component")), "classes")


def linked_sets(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text): components of sets whose similarity is ``percent`` or more."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    survey = stored(docs.mapInArrow(lambda b: _surveyed(b, shingle, percent), f"doc_id {kind}, name binary, token long, size long, bits array<long>, more long, kind int"), "survey")
    nodes = survey.where("kind = 0 AND size > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("token").alias("token"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    nodes = stored(nodes, "nodes")
    top = survey.where("kind = 1").groupBy("token").agg(F.sum("more").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).select("token").collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(_U))
    boundary = _boundary(survey, percent)
    index = stored(docs.select("text").mapInArrow(lambda b: _indexed(b, shingle, percent, boundary, frequent), "key long, token long, size int, side int"), "index")
    judge = lambda pairs, least=percent: _judged(docs, nodes, pairs, shingle, percent, least)
    links = named = classes = None

    def add(found: DataFrame | None) -> None:
        """More links: components follow."""
        nonlocal links, named, classes
        if found is not None and found.take(1):
            links = found if links is None else links.union(found)
            named = stored(components(links), "classes")
            classes = _on_tokens(named, nodes)

    def linked(judged: DataFrame | None) -> DataFrame | None:
        return None if judged is None else judged.where("linked").select("a", "b")

    if boundary:
        add(linked(judge(_light_pairs(index, nodes))))
    postings = index.where("side < 0").select("key", "token", "size")
    open_keys = postings.groupBy("key").agg(F.min("token").alias("x"), F.max("token").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", "n")
    lists = stored(postings.join(open_keys, "key").distinct(), "lists")
    discard(index)
    central = stored(lists.groupBy("token").agg(F.sum("n").alias("central")), "central")
    lists = stored(lists.drop("n").join(central, "token"), "weighed")
    alike = 100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")
    as_other = lambda rows: rows.select("key", *(F.col(c).alias(f"{c}2") for c in rows.columns if c != "key"))

    def still_open() -> DataFrame:
        """Rows of lists that hold several components."""
        now = lists.withColumn("component", F.col("token")) if classes is None else lists.join(classes, "token", "left").withColumn("component", F.coalesce("component", "token"))
        still = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return stored(now.join(still, "key", "left_semi"), "open")

    now = still_open()
    lead = now.groupBy("key").agg(F.max_by(F.struct("token", "size", "component", "central"), F.struct("central", "token")).alias("p")).select("key", "p.*")
    met = now.join(as_other(lead), "key").where((F.col("component") != F.col("component2")) & alike)
    hubs = stored(met.groupBy("token").agg(F.max_by("token2", F.struct("central2", "token2")).alias("token2")), "hubs")
    judged = judge(_with_names(_meeting(hubs.select(*_pair("token", "token2")).distinct(), lists), nodes), percent - _NEAR)
    discard(now)
    add(linked(judged))
    hub = None
    if judged is not None:
        deviations = stored(_deviations(judged, hubs, nodes), "near")
        add(_with_names(_alike_by_deviations(deviations, classes, percent), nodes))
        hub = deviations.select("token", "hub")
    now = still_open()
    now = now.withColumn("hub", F.lit(None).cast("long")) if hub is None else now.join(hub, "token", "left")
    apart = (F.col("component") != F.col("component2")) & (F.col("token") > F.col("token2")) & alike & F.coalesce(F.col("hub") != F.col("hub2"), F.lit(True))
    met = now.join(as_other(now), "key").where(apart)
    pairs = _often(met.groupBy(F.col("token").alias("a"), F.col("token2").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("size2").alias("size2")))
    add(linked(judge(_with_names(pairs, nodes))))
    least = nodes.select("name", "doc_id")
    if links is not None:
        grouped = nodes.join(named.select(F.col("node").alias("name"), "component"), "name", "left").select("name", "doc_id", F.coalesce("component", "name").alias("component"))
        firsts = grouped.groupBy("component").agg(F.min("doc_id").alias("first"))
        least = grouped.join(firsts, "component").select("name", F.col("first").alias("doc_id"))
    rows = survey.where("kind = 0").select("doc_id", "name", F.col("size").alias("n_shingles"))
    out = rows.join(least.withColumnRenamed("doc_id", "component_id"), "name", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_heavy_light_join(spark, sf_dir: str) -> DataFrame:
    return linked_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


#: The contract: sets that share a shingle are compared; labels spread along links until nothing changes.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, z.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) z ON z.d = w.doc_id
"""
