import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import prose
from tessera.operators import hooks
from tessera.operators import lookups as L
from tessera.sources import graphs
from tessera.streaming import boards


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_long_sentences_are_cut_at_separators():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(["word", "a.", "b;", "c,", "longerword"]) for _ in range(rng.randint(0, 60)))
        got = prose.pieces_of(text, 40)
        assert all(len(p) <= 41 for p in got) and "".join(got).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize(("clause", "want"), [("168 5.", True), ("162", True), ("1,024 - 3", False), ("abc 5", False), ("", False), ("1234567890123", False), ("-5", True), ("1-2", True)])
def test_number_clauses(spark, clause, want):
    assert spark.range(1).select(prose.is_number_clause(F.lit(clause)).alias("x")).first()["x"] is want


def test_blocks(spark):
    text = "Intro\nTheorem 1.2. All is well.\nIt is.\nProof. Easy.\nProof. Again.\n  Lemma 3 Small.\nTheorem 1.2. Again\n" + "x" * 2000
    got = L.blocks(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "nid string, body_text string")).collect()
    starts = [m.start() for m in re.finditer(r"(?m)^[ \t]*(?:Theorem|Proof|Lemma)", text)]
    by = {r["start"]: r for r in got}
    assert sorted(by) == starts[:4]
    assert by[starts[0]]["body"] == text[starts[0] : starts[1]] and by[starts[1]]["proof_of"] == starts[0] == by[starts[2]]["proof_of"] and by[starts[3]]["number"] == "3"
    long = L.blocks(spark.createDataFrame([("a", "Remark 1\n" + "y" * 3000)], "nid string, body_text string")).first()
    assert len(long["body"]) == L.BLOCK_CHARS


def test_formula_edges(spark):
    df = spark.createDataFrame([("f1", r"g(x) = \sum_{i=1}^n a_i x", ["Equation 2.1"]), ("f2", None, [])], "id string, latex string, cite_labels array<string>")
    got = rows(L.formula_edges(df).filter("src = 'f1'").select("type", "dst"))
    assert ("defines", "v:g") in got and ("binds", "v:i") in got and ("uses", "v:x") in got and any(t == "references" for t, _ in got)


def test_mentions_again(spark):
    passages = spark.createDataFrame([(1, "h", "by Eq. (2.1) and Equation 9"), (2, "k", "see equation 2.1")], "pid long, home_nid string, text string")
    formulas = spark.createDataFrame([("a", "x", "2.1", 1), ("b", "k", "2.1", 2)], "id string, home_nid string, cite string, seq long")
    assert rows(L.mentions_again(passages, formulas)) == [(1, "a"), (2, "b")]


def test_boards_step_by_step(spark):
    def play(n, cap):
        board = []  # [number, fading], oldest first
        for i in range(1, n + 1):
            board.append([i, False])
            excess = len(board) - cap
            if excess > 0:
                looked, gone, fresh = board[: excess + 1], [], 0
                for s in looked:
                    if s[1]:
                        gone.append(s)
                    elif fresh < excess:
                        s[1], fresh = True, fresh + 1
                board = [s for s in board if s not in gone]
        return [tuple(s) for s in board]

    sizes = [*range(1, 40), 100]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(1, n + 1)], "board long, i long")
    got = {}
    for r in boards.on_board(df, "board", "i", 5).orderBy("i").collect():
        got.setdefault(r["board"], []).append((r["i"], r["fading"]))
    assert got == {n: play(n, 5) for n in sizes}


def test_first_mentions_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("s", "1.1", "2024-01-01 00:00:00"), ("s", "1.1", "2024-01-01 00:01:00"), ("t", "1.1", "2024-01-01 00:02:00")], "session string, cite string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = boards.first_mentions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "session", "cite")
    q = stream.writeStream.format("memory").queryName("first_mentions").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_mentions").count() == 2 == boards.first_mentions(df, "session", "cite").count()


def test_hooks(spark):
    df = spark.range(3)
    default = lambda x: x.withColumn("by", F.lit("default"))
    assert hooks.call("intro", df, default).first()["by"] == "default"
    with hooks.installed("intro", lambda x: x.withColumn("by", F.lit("own"))):
        assert hooks.call("intro", df, default).first()["by"] == "own"
    with hooks.installed("aliases", df):
        assert hooks.call("aliases", df, default).columns == ["id"]
    with pytest.raises(ValueError, match="no such point"):
        hooks.install("nowhere", None)


def test_graphs_and_sidecars(spark, tmp_path):
    assert graphs.read_graph(spark, f"{tmp_path}/g") == {}
    one, two = spark.createDataFrame([("a", "uses", "b")], "src string, type string, dst string"), spark.createDataFrame([("x", "y")], "id string, latex string")
    graphs.write_graph({"edges": one}, f"{tmp_path}/g")
    graphs.write_graph({"edges": one.unionByName(one), "formulas": two}, f"{tmp_path}/g")
    got = graphs.read_graph(spark, f"{tmp_path}/g")
    assert set(got) == {"edges", "formulas"} and got["edges"].count() == 2
    (tmp_path / "levels.json").write_text('{"b/ch1": {"L0": "short", "L1": "", "Z": "no"}, "b/ch2": {"L4": "long"}}')
    assert rows(graphs.section_levels(spark, f"{tmp_path}/levels.json")) == [("b/ch1", "L0", "short"), ("b/ch2", "L4", "long")]
    (tmp_path / "eq.json").write_text('{"2.1": "a=b"}')
    assert rows(graphs.read_equations(spark, f"{tmp_path}/eq.json")) == [("2.1", "a=b")]
    graphs.write_json_lines(spark.createDataFrame([("b1", "T", None)], "id string, title string, more string"), f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").first()["value"] == '{"id":"b1","title":"T"}'
    assert graphs.read_registry(spark, f"{tmp_path}/r").first()["id"] == "b1"


def test_loose_and_unique_topics(spark):
    df = spark.createDataFrame([("about a", "x"), ("none", "b and b"), ("a b", "x"), ("none", "b")], "q string, body string")
    topics = {"A": r"\ba\b", "B": r"\bb\b"}
    assert [r["topic"] for r in L.loose_topic(df, F.col("q"), F.col("body"), topics).collect()] == ["A", "B", "A", None]
    assert [r["topic"] for r in L.unique_topic(df, F.col("q"), topics).collect()] == ["A", None, None, None]
