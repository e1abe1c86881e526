"""Mixing sources to target weights by Poisson replication.

A source with share n/N of the documents and target share t gets the mean repetition rate  r = t * N / n. Each document draws
a uniform number from a hash of its id and the seed, and the inverse of the Poisson distribution with mean r turns it into the
number of its copies. Copies get a hash each, and the rows are ordered by it over the whole cluster.

By default the targets are proportional to documents ** ``tempering``. Rates are capped by nothing; the inverse is searched up
to a count whose tail probability is below 2**-52, the resolution of the uniform number.

Defined cases: a null source is a source of its own; a row with a null id draws by its text; repeated rows draw the
same count, each gets its copies; sources without a target get none if targets are given; an empty table gives none;
very long texts are carried along; all other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shuffle_width, stored


def uniform(*key: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 over the parts of the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) > u; the distribution function is summed once, term by term."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * rate / i
        return F.when(u < acc["sum"], acc).otherwise(F.struct(i.alias("k"), term.alias("term"), (acc["sum"] + term).alias("sum")))

    # exp(-rate) would underflow beyond 700: ``replicate`` splits such a rate into equal parts
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def rates(docs: DataFrame, tempering: float = 0.5, targets: DataFrame | None = None) -> DataFrame:
    """(source, rate) for each source of ``docs``; ``targets`` (source, weight) replaces the tempered weights."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), tempering))
    else:
        t = targets.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        n = n.join(t, n["source"].eqNullSafe(t["_s"]), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = n.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w")).first()
    all_n, all_w = (total["all_n"] or 0), (total["all_w"] or 1.0)
    return n.select("source", (F.col("weight") * F.lit(float(all_n)) / F.lit(float(all_w)) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, tempering: float = 0.5, seed: int = 17, targets: DataFrame | None = None) -> DataFrame:
    """row (a struct of the columns of ``docs``), rate, copies, copy (from 1) and place (the order's key): a row per copy, in no order yet."""
    # the rates are a written table, so that its size is known before the plan is made: small, and the documents stay where they are
    table = stored(rates(docs, tempering, targets), "rates").select(F.col("source").alias("of"), "rate")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # out of the way of the columns that are added
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(whole, F.col("source").alias("own"), key.alias("key"))
    rows = rows.join(table, F.col("own").eqNullSafe(F.col("of"))).drop("own", "of")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson_inverse(uniform(F.col("key"), F.lit(seed), i), F.col("rate") / parts))
    rows = rows.withColumn("copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("row", "rate", "copies", "copy", F.xxhash64("key", F.lit(seed), "copy").alias("place"))


def shuffled(copies: DataFrame) -> DataFrame:
    """``copies`` in the order of their hashes over the whole cluster.

    Hashes are spread evenly, so the bounds of the parts are known beforehand, and no pass over the rows is needed to find them.
    """
    n = shuffle_width(copies.sparkSession)
    part = F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(2**63))), 33) * n  # the high 31 bits, from 0
    dealt = copies.withColumn("part", F.shiftrightunsigned(part, 31).cast("int"))
    return dealt.repartitionById(n, "part").sortWithinPartitions("place", "row.doc_id", "copy").drop("part")


def mix(docs: DataFrame, tempering: float = 0.5, seed: int = 17, targets: DataFrame | None = None) -> DataFrame:
    """Copies in a global random order, with the columns of ``docs``."""
    return shuffled(replicate(docs, tempering, seed, targets)).select("row.*")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = replicate(docs).select(F.struct("row.doc_id", "row.source").alias("row"), "rate", "copies", "copy", "place")
    return shuffled(rows).select("row.doc_id", "row.source", F.round("rate", 9).alias("rate"), F.col("copies").cast("long").alias("copies"), F.col("copy").cast("long").alias("copy"))


OP5_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) * (SELECT sum(n) FROM n) / (SELECT sum(sqrt(n)) FROM n) / n AS rate FROM n),
d AS (SELECT doc_id, documents.source, rate, CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), '17', '1')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
      FROM documents JOIN r ON r.source IS NOT DISTINCT FROM documents.source),
t AS (SELECT source, rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1.0) AS p FROM r, range(0, 60) x(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM t),
m AS (SELECT d.doc_id, d.source, d.rate, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.upto <= d.u) AS copies FROM d)
SELECT doc_id, source, round(rate, 9) AS rate, CAST(copies AS BIGINT) AS copies, unnest(range(1, copies + 1)) AS copy FROM m
"""
