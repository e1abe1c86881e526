import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkveil.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, FOLDER).toPandas()) == rows_of(duck.sql(ORACLES[name]).df())


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """The tables with documents that are blank, wordless, or all one redaction."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    texts = ["", " ", "   " * 60, " " * 6000, "\n\n", "...", "!?\n--", "\t", "a@b.org " * 40, "4111111111111111" * 6]
    first = con.sql("SELECT max(doc_id) + 1 FROM documents").fetchall()[0][0]
    con.executemany("INSERT INTO documents(doc_id, text, lang, source, n_chars) VALUES (?, ?, 'en', 'src0', 0)", [(first + i, t) for i, t in enumerate(texts * 3)])
    for t in TABLES:
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["fts_backfill_missing", "production_print", "production_places", "production_manifest"])
def test_blank_and_wordless_texts_against_sql(spark, odd, name):
    folder, con = odd
    assert rows_of(QUERIES[name](spark, folder).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_texts_made_of_a_few_keys_are_searched_on_all_cores(spark):
    """A table of a few MB is one partition, and what is rendered from its keys is many times as much."""
    made = QUERIES["pii_builtin_spans"](spark, FOLDER).rdd
    assert made.getNumPartitions() >= spark.sparkContext.defaultParallelism and sum(n > 0 for n in made.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
