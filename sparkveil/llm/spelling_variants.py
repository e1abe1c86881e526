"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Words are runs of letters. The polynomial hash of a word without its i-th code point comes from a prefix hash and a suffix hash, so all
deletions of a batch of words are made by NumPy at once. Two words of one length are one replacement apart if they agree without
the same place; a word is one insertion from each word that has it as a deletion. So one family of keys, a word's own hash and its
deletions', finds every near pair exactly once: keys are dealt out by their leading bits (a radix digit), sorted, and equal ones are
compared as strings. A key's group is bounded by alphabet and word length, and each word takes only counts and its best partner from it,
never the pairs.

Defined cases: a null text has no words, a null doc_id counts as the empty string in the hash that damages words; repeated rows count
as often as they occur; ties of frequency go to the smaller word in code-point order; an empty table gives no rows; other columns are
not read. Whole texts are read, however long. Hash collisions are told apart by the strings; strings of ``LONG`` code points or more are
not copied to every deletion (that would take the square of their length) but told apart by two more rolling hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored
from .textops import Chunk, chunks, mixed, text_column

_U = np.uint64
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOGETHER = 16 << 20  # bytes of text whose words are counted before they are sent
_PRIME = np.uint64((1 << 31) - 1)
_BASES = tuple(np.uint64(b) for b in (1_103_515_245, 1_664_525_013))
_MORE_BASES = tuple(np.uint64(b) for b in (950_706_376, 742_938_285))
LONG = 64
_RADIX_BITS = 12


def _runs(c: Chunk) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and lower-cased bytes of each run of letters A-Z, a-z and U+00C0 to U+00FF (two bytes, the first 0xC3)."""
    latin = c.data == 0xC3
    inside = _ALPHA[c.data] | latin
    inside[1:] |= latin[:-1]
    flat = np.zeros(len(inside) + 1, bool)
    flat[1:] = inside
    edge = np.zeros(len(inside) + 1, bool)
    edge[c.offsets] = True
    first = inside & (~flat[:-1] | edge[:-1])
    starts = np.flatnonzero(first)
    owner = np.searchsorted(c.offsets, starts, "right") - 1
    offsets = np.append(np.cumsum(inside)[starts] - 1, inside.sum()) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[c.data[inside]])])
    return owner, np.diff(offsets), words


def _counted(ids: list, texts: pa.Array, modulus: int, least: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and how often they occur in some texts; where ``modulus`` divides the CRC-32 of ``id:word``, one code point is missing."""
    for c in chunks(texts):
        owner, sizes, words = _runs(c)
        if not len(sizes):
            continue
        coded = words.dictionary_encode()
        known, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        # CRC-32 is linear: that of a joined text is the first part's, carried over as many zero bytes as the second is long, xor the second's
        zeros = bytes(int(sizes.max()))
        blank = {n: zlib.crc32(zeros[:n]) for n in set(map(len, known))}
        tail = np.array([zlib.crc32(w) ^ blank[len(w)] for w in known], np.uint32)
        pair, place = np.unique(owner << 32 | sizes, return_inverse=True)
        heads = [zlib.crc32(b"%s:" % str("" if ids[c.first + i] is None else ids[c.first + i]).encode()) for i in range(c.n)]
        carried = np.array([zlib.crc32(zeros[: p & 0xFFFFFFFF], heads[p >> 32]) for p in pair.tolist()], np.uint32)
        h = carried[place] ^ tail[index]
        hit = h % np.uint32(modulus) == 0
        counts = np.bincount(index[~hit], minlength=len(known))
        yield coded.dictionary, counts
        cut = []
        for w, x in zip(index[hit].tolist(), h[hit].tolist(), strict=True):
            word = known[w].decode()
            at = x % len(word)
            cut.append((word[:at] + word[at + 1 :]).encode())
        if cut:
            tally = pa.array(cut, pa.large_binary()).value_counts()
            yield tally.field("values"), tally.field("counts").to_numpy()


def word_counts(docs: DataFrame, modulus: int = 97, least: int = 5) -> DataFrame:
    """word, n: the damaged words of ``docs`` (doc_id, text) with ``least`` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0

        def sent() -> pa.RecordBatch:
            both = pa.table({"word": pa.chunked_array(words, pa.large_binary()), "n": np.concatenate(counts)}).group_by("word").aggregate([("n", "sum")])
            both = both.set_column(both.schema.get_field_index("word"), "word", both["word"].cast(pa.large_string()))
            both = both.filter(pc.and_(pc.greater_equal(pc.utf8_length(both["word"]), least), pc.greater(both["n_sum"], 0)))
            return pa.RecordBatch.from_arrays([both["word"].combine_chunks().cast(pa.string()), both["n_sum"].combine_chunks().cast(pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for w, n in _counted(ids, text_column(batch), modulus, least):
                words.append(w)
                counts.append(n)
            size += batch.nbytes
            if size > _TOGETHER and words:
                yield sent()
                words, counts, size = [], [], 0
        if words:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _PRIME) + (x >> _U(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _deletion_keys(words: pa.Array, bases: tuple = _BASES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its own key (place -1) and one for each code point that can go: row of the word, place, key."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(_U) + _U(1)
    n, longest = len(lengths), int(lengths.max(initial=0))
    table = np.zeros((n, longest), _U)
    table[np.arange(longest) < lengths[:, None]] = points
    rows, keys = [np.arange(n)], None
    row, place = np.nonzero(np.arange(longest) < lengths[:, None])
    for base in bases:
        power = np.ones(longest + 1, _U)
        for i in range(longest):
            power[i + 1] = _mod(power[i : i + 1] * base)[0]
        prefix, suffix = np.zeros((n, longest + 1), _U), np.zeros((n, longest + 1), _U)  # suffix[:, i]: of the code points from i on
        for i in range(longest):
            prefix[:, i + 1] = _mod(prefix[:, i] * base + table[:, i])
        for i in reversed(range(longest)):
            suffix[:, i] = np.where(i < lengths, _mod(table[:, i] * power[np.maximum(lengths - i - 1, 0)] + suffix[:, i + 1]), 0)
        whole = prefix[np.arange(n), lengths]
        less = _mod(prefix[row, place] * power[lengths[row] - place - 1] + suffix[row, place + 1])
        part = np.concatenate([whole, less])
        keys = part if keys is None else keys << _U(32) | part
    size = np.concatenate([lengths, lengths[row] - 1]).astype(_U)
    return np.concatenate([*rows, row]), np.concatenate([np.full(n, -1), place]), mixed(keys ^ (size << _U(56)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words, counts = batch.columns
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        order = np.argsort(lengths, kind="stable")  # alike in length, so tables are dense
        short = order[lengths[order] < LONG]
        parts = [*np.array_split(short, max(1, int(lengths[short].sum()) // 200_000)), *(order[i : i + 1] for i in range(len(short), len(order)))]
        for part in parts:
            some = words.take(pa.array(part))
            row, place, key = _deletion_keys(some)
            rest = pa.nulls(len(row), pa.string())
            if len(part) and lengths[part[0]] >= LONG:
                shown = lengths[part[0]] - (place >= 0) < LONG
                rest = pa.array(_deletion_keys(some, _MORE_BASES)[2].astype(str), pa.string(), mask=shown)
            take = lambda x: x.take(pa.array(part)).take(pa.array(row))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), take(ids), pa.array(place.astype(np.int32)), take(counts), rest], ["key", "word", "place", "n", "rest"])


def _without(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _best(of: list[tuple[int, str]]) -> tuple[tuple[int, str], tuple[int, str] | None]:
    """The two first of (-n, word)."""
    of = sorted(of)
    return of[0], of[1] if len(of) > 1 else None


def _group(members: list[tuple[str, int, int]], out: list[tuple[str, int, int, str]]) -> None:
    """What each member of one deletion (word, place, n) learns from the others: (word, number of near words, -n and word of the best)."""
    places: dict[int, list[tuple[int, str]]] = {}
    for word, place, n in members:
        places.setdefault(place, []).append((-n, word))
    own = places.pop(-1, None)
    longer = set()
    for same in places.values():
        longer |= set(same)
        if len(same) > 1:  # they differ in this place alone
            first, second = _best(same)
            out += [(w, len(same) - 1, *(second if (n, w) == first else first)) for n, w in same]
    if own and longer:
        out.append((own[0][1], len(longer), *min(longer)))
        out += [(w, 1, *own[0]) for _, w in longer]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group may go on in the next batch, so the last one waits."""
    rest = None
    names = ["id", "near", "minus_n", "best"]

    def results(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(key) else np.zeros(0, np.int64)
        table, out, groups = table.take(pa.array(some)), [], {}
        last = None
        for k, word, place, n, rest in zip(*(table[c].to_pylist() for c in ("key", "word", "place", "n", "rest")), strict=True):
            if k != last:
                for members in groups.values():
                    if len(members) > 1:
                        _group(members, out)
                last, groups = k, {}
            groups.setdefault(_without(word, place) if rest is None else (rest,), []).append((word, place, n))  # the strings tell collisions apart
        for members in groups.values():
            if len(members) > 1:
                _group(members, out)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = table.slice(cut)
        if cut:
            yield results(table.slice(0, cut))
    if rest is not None:
        yield results(rest)


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, form, form_n for those ``words`` (id, word, n) that have a word one edit away; ``form`` is the id of the most frequent of these.

    An id stands for its word in every deletion; ids sort as their words do.
    """
    keyed = words.select("id", "word", "n").mapInArrow(_keyed, "key long, word string, place int, n long, rest string")
    digit = F.shiftrightunsigned("key", 64 - _RADIX_BITS)
    found = keyed.repartition(digit).sortWithinPartitions("key").mapInArrow(_matched, "id string, near long, minus_n long, best string")
    best = F.min(F.struct("minus_n", "best")).alias("b")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("b.best").alias("form"), (-F.col("b.minus_n")).alias("form_n"))


def _named(words: DataFrame) -> DataFrame:
    """``words`` with an ``id``: the word, or, for a longer one than ``LONG``, its beginning and its place among the long words in order."""
    long = words.where(F.length("word") > LONG).repartitionByRange("word").sortWithinPartitions("word")
    place = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    named = long.select(F.concat(F.substring("word", 1, LONG), F.lit("\0"), place).alias("id"), "word", "n")
    return words.where(F.length("word") <= LONG).select(F.col("word").alias("id"), "word", "n").union(named)


def _roots(forms: DataFrame) -> DataFrame:
    """id, root for ``forms`` (id, form). Frequencies grow from word to form, so pointer doubling ends within a few rounds."""
    now = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("_further"))
        moved = now.select("id", "root").join(ahead, "root", "left").select("id", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved"))
        after = stored(moved, "roots")
        discard(now)
        if not after.where("moved").take(1):
            return after.select("id", "root")
        now = after


def group_variants(docs: DataFrame, modulus: int = 97, least: int = 5, occurrences: int = 3, dominance: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words of ``docs``; ``form`` is null unless it is ``dominance`` (2 or more) times as frequent."""
    words = stored(_named(stored(word_counts(docs, modulus, least).where(F.col("n") >= occurrences), "counts")), "words")
    both = words.join(near_words(words), "id", "left")
    leads = F.col("form_n") >= dominance * F.col("n")
    both = both.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("form")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n"))
    both = stored(both, "forms")
    out = both.join(_roots(both.where("form IS NOT NULL")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    long = words.where(F.length("word") > LONG)  # only their ids differ from them
    for c in ("form", "root"):
        out = out.join(long.select(F.col("id").alias(c), F.col("word").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select("word", "n", "n_near", "form", "form_n", "root")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract; near words meet in the strings that one deletion leaves. The CRC-32 goes over UTF-8 bytes (two for U+00C0 to U+00FF).
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
o AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM t GROUP BY ALL),
table8 AS (SELECT list(c ORDER BY i) AS v FROM (SELECT i, list_reduce(CAST(range(8) AS BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS c FROM range(256) AS g(i))),
b AS (SELECT doc_id, r, c, flatten(list_transform(range(1, length(k) + 1), lambda i: CASE WHEN ord(k[i]) < 128 THEN [CAST(ord(k[i]) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(k[i]) - 64 AS BIGINT)] END)) AS bytes
      FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS k FROM o)),
h AS (SELECT r, c, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, v[1 + (xor(a, x) & 255)]), 4294967295), 4294967295) AS h FROM b, table8),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substring(r, 1, CAST(h % length(r) AS INTEGER)) || substring(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, substring(word, 1, CAST(i AS INTEGER) - 1) || substring(word, CAST(i AS INTEGER) + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.s = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.s = w.word),
f AS (SELECT word, count(*) AS n_near, min({'m': -other_n, 'w': other}) AS best FROM p GROUP BY word),
g AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root, form AS further FROM g UNION ALL SELECT z.word, g.word, g.form FROM z JOIN g ON g.word = z.further)
SELECT g.word, n, n_near, form, form_n, z.root FROM g JOIN z ON z.word = g.word AND z.further IS NULL
"""
