"""Quality rules: robust multivariate outliers among document statistics.

Each document gets a vector of transformed statistics. For every (language, source) the minimum-covariance-determinant
estimate is found by concentration steps over *all* its rows, none sampled: distances under the current estimate go into
fine logarithmic bins, the bins that hold the nearest ``share`` of the rows give the next mean and covariance. One step is
one partially aggregated pass over a narrow table, so a source with a third of all rows costs no single task more. There are
two deterministic starts (median and MAD; covariance of the tanh of robust z-scores); the smaller determinant wins. The
covariance is regularised by a floor on each statistic's scatter, since several are zero almost everywhere. A document is
rejected if its Mahalanobis distance, scaled so that its group's median distance is that of a chi-square, is beyond
``cutoff_z`` (a normal quantile). Groups of fewer than ``least`` rows are pooled by language; a pool that is still smaller
rejects nothing.

Defined cases: null text is empty and fails the base rule; null language or source is a group of its own; equal rows get equal
verdicts; a very long text is counted whole, in memory in proportion to it; a table without rows gives none; other columns, whatever
their names, pass through ``keep_good`` and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, stored
from .textops import Chunk, Hasher, chunks, mixed, spans_to_mask, text_column

_U = np.uint64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Least scatter of each statistic in ``_vector``: log words, log word length, root of symbol share, share of repeated lines, share of repeated words.
FLOORS = (0.5, 0.15, 0.045, 0.14, 0.1)
P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_BINS_PER_OCTAVE = 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _grouped_duplicates(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (text, key): is it a later one of equal items; does it have an equal one."""
    both = mixed(key + text.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    later, shared = np.zeros(len(both), bool), np.zeros(len(both), bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return later, shared


def chunk_statistics(c: Chunk) -> list[np.ndarray]:
    c.words()
    bytes_ = Hasher(c.data)
    in_word = _LEADS[c.data]
    in_word[np.isin(c.data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))] = False
    newline = np.flatnonzero(c.data == 0x0A)
    begins = np.sort(np.concatenate([c.offsets[:-1], newline + 1]))
    text = np.searchsorted(c.offsets, begins, "right") - 1
    ends = np.concatenate([begins[1:], [len(c.data)]])  # with the newline, if there is one
    # a text may end in "\n": then the line that begins there is empty and belongs to it, which a search by place can't tell
    has_word = np.searchsorted(c.starts, ends) > np.searchsorted(c.starts, begins)
    begins, ends, text = begins[has_word], ends[has_word], text[has_word]
    ends = ends - (c.data[ends - 1] == 0x0A)
    dup, _ = _grouped_duplicates(text, bytes_.ranges(begins, ends))
    lines = np.bincount(text, minlength=c.n)
    dups = np.bincount(text[dup], minlength=c.n)
    n = len(c.starts)
    words = Hasher(bytes_.ranges(c.starts, c.ends))
    owner = np.repeat(np.arange(c.n), np.diff(c.word_offsets))
    i = np.arange(max(0, n - 4))
    i = i[i + 5 <= c.word_offsets[1:][owner[: len(i)]]]
    _, shared = _grouped_duplicates(owner[i], words.ranges(i, i + 5))
    repeated = spans_to_mask(n, i[shared], 5)
    return [np.diff(c.word_offsets), c.sums(in_word), c.sums(_SYMBOL[c.data]), lines, dups, np.bincount(owner[repeated], minlength=c.n)]


def _count(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [chunk_statistics(c) for c in chunks(text_column(batch, text))]
        if parts:
            new = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(x) for x in new], keep + [f"_{k}" for k in COUNTS])


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then the counts of COUNTS with a leading underscore."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema]
    return source.mapInArrow(lambda b: _count(b, "text", keep), ", ".join(schema + [f"`_{k}` long" for k in COUNTS]))


def _base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


def _vector() -> list[Column]:
    w = F.col("_n_words")
    return [F.log1p(w), F.log((F.col("_word_chars") + 1) / (w + 1)), F.sqrt(F.col("_n_symbols") / (F.col("_word_chars") + 1)), F.col("_n_dup_lines") / (F.col("_n_lines") + 1), F.col("_n_repeat_words") / (w + 1)]


def _group() -> tuple[Column, Column]:
    """Names of a row's own group and of its language's pool; a null is a value of its own, and no group has a pool's name."""
    nulls = {"ignoreNullFields": "false"}
    return F.to_json(F.struct("lang", "source"), nulls), F.to_json(F.struct("lang"), nulls)


def _distance() -> Column:
    """Squared, of x0.. from the estimate's mean under its whitening matrix (lower triangle ``white``)."""
    z = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    rows = [sum((z[j] * F.col("white")[i * (i + 1) // 2 + j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _bin() -> Column:
    return F.least(F.floor(F.log2(1 + _distance()) * _BINS_PER_OCTAVE), F.lit(2**14)).cast("int")


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a subset to mean, whitening matrix and log determinant."""
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            n, mean = r.n, np.array(r.sums) / r.n
            cov = np.zeros((P, P))
            for (i, j), s in zip(_PAIRS, r.products, strict=True):
                cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
            cov += np.diag(np.square(FLOORS))
            white = np.linalg.inv(np.linalg.cholesky(cov))
            out.append((r.grp, r.start, mean.tolist(), [white[i, j] for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["grp", "start", "mean", "white", "logdet"])


_ESTIMATE = "grp string, start int, mean array<double>, white array<double>, logdet double"


def _moments(x: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def _fitted(moments: DataFrame) -> DataFrame:
    rows = moments.select("grp", "start", "n", F.array(*(f"s{i}" for i in range(P))).alias("sums"), F.array(*(f"p{i}_{j}" for i, j in _PAIRS)).alias("products"))
    return rows.coalesce(4).mapInPandas(_fit, _ESTIMATE)  # a row for each group and start


def _concentrated(x: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step for each group and start."""
    cols = [F.col(f"x{i}") for i in range(P)]
    bins = x.join(estimate, "grp").groupBy("grp", "start", _bin().alias("bin")).agg(*_moments(cols))
    w = Window.partitionBy("grp", "start")
    inner = bins.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total")).where(F.col("upto") - F.col("n") < share * F.col("total"))
    sums = [c for c in bins.columns if c not in ("grp", "start", "bin")]
    return _fitted(inner.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in sums)))


def _chi_square(z: float) -> float:
    """Wilson-Hilferty quantile with P degrees of freedom."""
    return P * (1 - 2 / (9 * P) + z * (2 / (9 * P)) ** 0.5) ** 3


def estimates(counts: DataFrame, share: float = 0.75, least: int = 50, steps: int = 8) -> tuple[DataFrame, DataFrame]:
    """(groups, estimate). groups: own, grp; which estimate a (language, source) uses. estimate: grp, mean, white, scale.

    Concentration ends when no determinant changes any more, or after ``steps``.
    """
    own, pool = _group()
    fine = counts.where(~_base_failed()).select(own.alias("own"), pool.alias("pool"), *(c.alias(f"x{i}") for i, c in enumerate(_vector())))
    sizes = fine.groupBy("own", "pool").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(sizes.select("own", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("pool")).alias("grp")), "groups")
    cols = [F.col(f"x{i}") for i in range(P)]
    x = stored(fine.join(groups, "own").select("grp", *cols), "vectors")
    median = x.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), *(F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(cols))).where(F.col("rows") >= least)
    median = stored(median, "medians")
    mad = x.join(median, "grp").groupBy("grp").agg(*(F.percentile_approx(F.abs(cols[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(P)))
    robust = stored(median.join(mad, "grp"), "robust")
    sd = [F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2) for i in range(P)]
    first = robust.select(
        "grp", F.lit(0).alias("start"), F.array(*(f"m{i}" for i in range(P))).alias("mean"),
        F.array(*(1 / sd[i] if i == j else F.lit(0.0) for i, j in _PAIRS)).alias("white"), F.lit(0.0).alias("logdet"),
    )
    curved = [F.col(f"m{i}") + sd[i] * F.tanh((cols[i] - F.col(f"m{i}")) / sd[i]) for i in range(P)]
    second = _fitted(x.join(robust, "grp").groupBy("grp", F.lit(1).alias("start")).agg(*_moments(curved)))
    now = stored(first.unionByName(second), "estimate")
    for _ in range(steps):
        last, now = now, stored(_concentrated(x, now, share), "estimate")
        changed = now.join(last.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]).where(F.abs(F.col("logdet") - F.col("was")) > 1e-9)
        over = not changed.take(1)
        discard(last)
        if over:
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "white"), F.struct("logdet", "start")).alias("best")).select("grp", "best.*")
    best = stored(best, "best")
    bins = x.join(best, "grp").groupBy("grp", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp")
    half = bins.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total")).where(2 * F.col("upto") >= F.col("total"))
    half = half.groupBy("grp").agg(F.min("bin").alias("bin"))
    scale = F.greatest((F.pow(2.0, (F.col("bin") + 0.5) / _BINS_PER_OCTAVE) - 1) / _chi_square(0.0), F.lit(1.0))
    return groups, stored(best.join(half, "grp").select("grp", "mean", "white", scale.alias("scale")), "mcd")


def judged(counts: DataFrame, groups: DataFrame, estimate: DataFrame, cutoff_z: float = 4.75) -> DataFrame:
    """``counts`` with _base_failed, _distance (squared, scaled; null without an estimate) and _kept."""
    own, _ = _group()
    rows = counts.select("*", own.alias("_own"), *(c.alias(f"x{i}") for i, c in enumerate(_vector())))
    known = groups.join(estimate, "grp").select(F.col("own").alias("_own"), "mean", "white", "scale")
    rows = rows.join(known, "_own", "left").select("*", _base_failed().alias("_base_failed"), (_distance() / F.col("scale")).alias("_distance"))
    return rows.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_distance") <= _chi_square(cutoff_z), F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. No text is shuffled: the counts are taken once for the estimates and once for the verdict."""
    groups, estimate = estimates(stored(with_counts(docs, ["lang", "source"]), "counts"))
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), *(F.col(c) for c in ("text", "lang", "source")))
    kept = judged(with_counts(inner, ["_row", "lang", "source"]), groups, estimate).where("_kept")
    return kept.select("_row.*")


def op1_quality_mcd(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = stored(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    out = judged(counts, *estimates(counts))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.round("_distance", 6).alias("distance"))
