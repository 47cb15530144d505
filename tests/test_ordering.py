import pytest
from pyspark.sql import functions as F

from tessera.functions import mathtext as M
from tessera.operators import ordering as O


@pytest.mark.parametrize(
    ("latex", "want"),
    [(r"\frac{a}{b}", "a over b"), (r"\frac{\frac{a}{b}}{c}", "a over b over c"), (r"\sqrt{x^2}", "square root of x squared"), (r"f(x) = \alpha_i", "f of x equals alpha sub i"), (r"\frac{a", "frac a"), (r"X^T", "X transpose")],
)
def test_spoken(latex, want):
    assert M.spoken(latex) == want


def test_symbols(spark):
    assert M.unicode_text(r"\lambda x^2_1 \Omega \foo") == "λ x²₁ Ω \\foo"
    assert M.latex_spans("a $x$ b \\[y\\]") == [(2, 5, "x"), (8, 13, "y")]
    assert M.matrix_literal(r"\begin{pmatrix}1 & 2 \\ 3\end{pmatrix}") == (2, 2, [["1", "2"], ["3", ""]], "(") and M.matrix_literal("x") is None
    rows = spark.createDataFrame([(r"\lambda",), ("f(x)",), ("3.5",), ("x_i",), ("kernel",)], "s string").select(M.label_class(F.col("s")).alias("c"), M.column(M.spoken, "string")(F.col("s")).alias("w")).collect()
    assert [r["c"] for r in rows] == ["greek", "function", "number", "symbol", "word"] and rows[0]["w"] == "lambda"


def test_orders(spark):
    nodes = spark.createDataFrame([("g", n, p) for n, p in zip("abcd", (4, 3, 2, 1), strict=True)], "g string, nid string, page int")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "a", "c")], "g string, src string, dst string")
    assert {r["nid"]: r["level"] for r in O.longest_levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert [r["nid"] for r in O.topological(nodes, edges).orderBy("place").collect()] == ["d", "a", "b", "c"]
    loop = edges.union(spark.createDataFrame([("g", "c", "a")], "g string, src string, dst string"))
    assert [r["nid"] for r in O.topological(nodes, loop).orderBy("place").collect()] == ["d", "c", "a", "b"]


def test_levels_of_long_paths_and_cycles(spark):
    nodes = spark.createDataFrame([("g", f"n{i}") for i in range(68)] + [("h", "n0")], "g string, nid string").coalesce(1)
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(67)], "g string, src string, dst string").coalesce(1)
    assert {(r["g"], r["nid"]): r["level"] for r in O.longest_levels(nodes, edges).collect()} == {("g", f"n{i}"): i for i in range(68)} | {("h", "n0"): 0}
    few = nodes.filter("nid IN ('n0', 'n1', 'n2')")
    with pytest.raises(ValueError, match="cycle"):
        O.longest_levels(few, edges.filter("src IN ('n0', 'n1')").union(spark.createDataFrame([("g", "n1", "n0")], edges.schema)))
    assert O.longest_levels(nodes.limit(0), edges).count() == 0


def test_clusters_and_spans(spark):
    items = spark.createDataFrame([("g", "causes", 5, [1.0, 0.0]), ("g", "makes", 3, [0.99, 0.1]), ("g", "is", 9, [0.0, 1.0])], "g string, phrase string, n int, vec array<double>")
    assert {r["phrase"]: r["cluster"] for r in O.greedy_clusters(items).collect()} == {"is": 0, "causes": 1, "makes": 1}
    spans = spark.createDataFrame([(1, 0, 5, 1), (1, 3, 8, 0), (1, 8, 9, 2)], "doc int, start int, end int, priority int")
    assert sorted((r["start"], r["end"]) for r in O.spans_by_priority(spans).collect()) == [(3, 8), (8, 9)]
