import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def values(df, columns):
    df = df[columns].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).astype(str).values.tolist()))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n != "pipeline"))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name in entry.oracle_sql():
        want = oracle.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got, sorted(got.columns)) == values(want, sorted(got.columns))
    else:
        assert len(got.columns)


@pytest.mark.parametrize("long", [False, True])
def test_word_times_of_all_turns(spark, sf_dir, tmp_path, long):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    if long:
        turns = spark.createDataFrame([(1, 0, "user", "a bb " * 4000 + "ccc"), (1, 1, "system", "x")], turns.schema)
        turns.write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for r in turns.collect():
        sizes = [max(1, len(w)) for w in (r["text"] or "").split(" ")] if r["text"] is not None else []
        for i in range(len(sizes)):
            want[r["conv_id"], r["turn"], i] = 5 * sum(sizes[:i]) / sum(sizes), 5 * sum(sizes[: i + 1]) / sum(sizes)
    got = {(r["conv_id"], r["turn"], r["pos"]): (r["t_start"], r["t_end"]) for r in entry.queries()["win12_word_times_all"](spark, str(tmp_path) if long else sf_dir).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def check_odd(spark, tmp_path, name, **tables):
    """The query against its SQL on these tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert len(want) and values(got, sorted(want.columns)) == values(want, sorted(want.columns))


def test_containment_of_odd_parts(spark, tmp_path):
    """Parts without type, and keys so far apart that the SQL takes an earlier parent before a longer one."""
    parts = [(1, "ab#1", None, 5), (2, "ab#1", "x", 5), (4, "ab#1", None, 7), (5, None, "x", 5), (6, "ab#1", None, None), (3000001, "ab#1", "xy", 5), (3000003, "ab#1", "q", 1)]
    check_odd(spark, tmp_path, "jon10_containment", part=spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int"))


def test_citations_of_equal_lines(spark, sf_dir, tmp_path):
    """Lines that agree in all that makes up their cite_id, with another supplier or not, and a nation without region."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier", "customer", "orders", "lineitem")}
    lines = tables["lineitem"]
    tables["lineitem"] = lines.union(lines.filter("l_linenumber = 1")).union(lines.withColumn("l_suppkey", F.lit(1).cast("long")))
    tables["nation"] = tables["nation"].withColumn("n_regionkey", F.expr("nullif(n_nationkey, 3) - n_nationkey + n_regionkey"))
    check_odd(spark, tmp_path, "jon01_resolve", **tables)


def test_titles_of_odd_texts(spark, tmp_path):
    """No letter before the cut, none at all, signs beyond 16 bits, blanks and line separators of many kinds, loose signs, cuts in blanks."""
    texts = ["Ü, " * 26 + "Üa", "Ü, " * 26 + "Ü. A" + "Ü" * 90, "Ü" * 99, "😀😀 one. Two", "😀" * 81 + "x", "a. B\u2028", "a.\u2028", "a \u2029", "a.\x85", "\x0ba\x0b", "a.\x0bB", "One?\n\n\tTwo", " \r\n", "", None]
    texts += ["([{ a)]}.", "([. A", "...", "x" * 76 + " " * 9 + "y", "x" * 76 + "\u2028" + "y" * 9, "x" * 75 + " \x0b" + "y" * 9, "x" * 80, "x" * 81, "e\u0301" * 41, "ab.\n A" * 30, "a " * 20000, "a" + " " * 20000 + "b.  C"]
    check_odd(spark, tmp_path, "str10_titles", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
