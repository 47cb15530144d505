import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import citations as C
from tessera.operators import evaluation as E
from tessera.operators import extraction as X
from tessera.operators import hierarchy as H
from tessera.operators import mathgraph as G
from tessera.operators import retrieval as R
from tessera.operators import sequence as S
from tessera.operators import spatial as P
from tessera.plans import router

REFS_A = [
    ("b/ch3", "b/ch5", "Chapter 5", 0), ("b/ch5/s5_8", "b/ch12", "Chapter 12", 10), ("b/ch5/s5_8", "b/ch12", "Chapter 12", 400), ("b/ch5/s5_8", "b/ch5/s5_8/ss5_8_1", "Section 5.8.1", 200),
    ("b/ch5/s5_8/ss5_8_1", "b/ch5/s5_8", "Section 5.8", 50), ("b/ch12", "b/ch5/s5_8", "Section 5.8", 20), ("b/ch12/s12_3", "b/ch5/s5_8", "Section 5.8", 30),
]
REFS_B = [("b/ch3", "b/ch5"), ("b/ch3", "b/ch5"), ("b/ch12/s12_3", "b/ch5/s5_8"), ("b/ch12", "b/ch3"), ("b/ch5", "b/ch5/s5_8"), ("b/ch3", "b/ch3")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REFS_A)], "seq long, from_nid string, to_nid string, label string, char_offset int")


def test_citations(refs):
    assert rows(C.group_by_label(C.outgoing(refs, "b/ch5/s5_8"))) == [("Chapter 12", 2)]
    assert rows(C.group_by_end(C.incoming(refs, "b/ch5/s5_8"), "from_nid")) == [("b/ch12", 1, "Section 5.8"), ("b/ch12/s12_3", 1, "Section 5.8")]
    assert ("b/ch5/s5_8", 2) in [r[:2] for r in rows(C.most_cited(refs, 5))]


def test_citation_paths(refs, spark):
    pairs = spark.createDataFrame([("b/ch3", "b/ch12"), ("b/ch3", "b/ch5/s5_8/ss5_8_1"), ("b/ch5/s5_8/ss5_8_1", "b/ch3")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["path"] for r in C.citation_paths(refs, pairs).collect()}
    assert got == {("b/ch3", "b/ch12"): ["b/ch3", "b/ch5", "b/ch12"], ("b/ch3", "b/ch5/s5_8/ss5_8_1"): ["b/ch3", "b/ch5"]}


def test_chapter_graph(spark):
    refs = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(REFS_B)], "seq long, from_nid string, to_nid string, label string")
    chapters = spark.createDataFrame([("b/ch3", "3"), ("b/ch5", "5"), ("b/ch12", "12"), ("b/ch9", "9")], "nid string, title string")
    assert rows(C.chapter_edges(refs, chapters)) == [("b/ch12", "b/ch3", 1), ("b/ch12", "b/ch5", 1), ("b/ch3", "b/ch5", 2)]
    assert {r["nid"]: (r["in_n"], r["out_n"]) for r in C.chapter_degrees(refs, chapters).collect()} == {"b/ch5": (3, 0), "b/ch3": (1, 2), "b/ch12": (0, 2), "b/ch9": (0, 0)}


def test_resolution_prefers_the_kind(spark):
    nodes = spark.createDataFrame([("b/a", "section", "1.1", 0), ("b/t", "theorem", "1.1", 1), ("b/u", "section", "2", 2)], "nid string, kind string, number string, preorder long")
    cites = spark.createDataFrame([(1, "b/x", "theorem", "1.1"), (2, "b/x", "lemma", "1.1"), (3, "b/u", "section", "2"), (4, "b/x", "figure", "9")], "cite_id long, from_nid string, kind string, number string")
    assert {r["cite_id"]: r["to_nid"] for r in C.resolve(cites, nodes).collect()} == {1: "b/t", 2: "b/a", 3: None, 4: None}


def test_tree(spark):
    n = [("b", "book", None, "B", 1, 9, "root", 0), ("b/ch1", "chapter", "1", "C", 1, 4, "one", 1), ("b/ch1/thm1", "theorem", "1.1", "T", 2, 2, "thm", 2), ("b/ch1/thm1/proof", "proof", None, "P", 2, 2, None, 3)]
    nodes = spark.createDataFrame(n, "nid string, kind string, number string, title string, page_start int, page_end int, body_text string, preorder long")
    assert rows(H.tree_depth(nodes)) == [("b", 3), ("b/ch1", 2), ("b/ch1/thm1", 1), ("b/ch1/thm1/proof", 0)]
    assert {r["nid"]: r["all_text"] for r in H.all_text(nodes).collect()}["b/ch1"] == "one\n\nthm"
    assert {r["page"]: r["nid"] for r in H.pages_owner(nodes).collect()}[2] == "b/ch1/thm1/proof"
    toc = spark.createDataFrame([("d", 0, 1, 1), ("d", 1, 2, 2), ("d", 2, 2, 5), ("d", 3, 1, 8)], "doc string, seq int, level int, page int")
    assert [r["page_end"] for r in H.toc_ranges(toc).orderBy("seq").collect()] == [7, 4, 7, 8]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "eigenvalues are roots of the characteristic polynomial"), (2, "python is a programming language"), (3, "the determinant equals the product of eigenvalues")], "nid long, body_text string")
    queries = spark.createDataFrame([(0, "eigenvalues"), (1, ""), (2, "eigenvalues eigenvalues")], "qid long, query string")
    got = {(r["qid"], r["did"]): r["bm25"] for r in R.bm25(docs, queries).collect()}
    assert set(got) == {(0, 1), (0, 3), (2, 1), (2, 3)} and got[2, 1] == pytest.approx(2 * got[0, 1])
    low = R.low_similarity(spark.createDataFrame([(0, 0.6, 0.1), (1, 0.0, 2.0), (2, 0.4, 9.0)], "qid long, dense double, bm25 double"), spark.range(4).withColumnRenamed("id", "qid"))
    assert {r["qid"]: r["low"] for r in low.collect()} == {0: False, 1: False, 2: True, 3: True}


def test_fusion(spark):
    a = spark.createDataFrame([(0, "x", 0), (0, "y", 1)], "qid long, did string, rank int")
    b = spark.createDataFrame([(0, "y", 0)], "qid long, did string, rank int")
    assert {r["did"]: r["rrf"] for r in R.fused([a, b]).collect()} == pytest.approx({"x": 1 / 60, "y": 1 / 61 + 1 / 60})
    assert [r["did"] for r in R.spliced(b, a, 2).orderBy("place").collect()] == ["y", "x"]


def test_evaluation(spark):
    g = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, pred string")
    got = {r["label"]: (r["precision"], r["recall"]) for r in E.per_class(g).collect()}
    assert got == {"a": (0.5, 0.5), "b": (0.5, 1.0), "c": (0.0, 0.0)}
    m = E.macro(E.per_class(g)).first()
    assert m["macro_f1"] == pytest.approx(2 * (1 / 3) * 0.5 / (1 / 3 + 0.5))
    pairs = spark.createDataFrame([(1, list("abcde"), list("ace")), (2, [], ["a"])], "pair_id long, reference array<string>, hypothesis array<string>")
    assert [r["lcs"] for r in E.rouge_l(pairs).orderBy("pair_id").collect()] == [3, 0]


def test_extraction(spark):
    text = ["We use the radial basis function (RBF) kernel.", "the support vector machine, also known as SVM, is", "the linear discriminant analysis, or LDA, is", "the kernel matrix (RBF) is", "the kernel matrix, also known as matrix, is"]
    docs = spark.createDataFrame(list(enumerate(text)), "nid long, body_text string")
    found = {r["alias"]: r["head"] for r in X.aliases(docs).collect()}
    assert found["svm"].endswith("support vector machine") and found["rbf"].endswith("radial basis function") and "matrix" not in found and found["lda"].endswith("linear discriminant analysis")
    deps = spark.createDataFrame([(0, "ridge regression is built on linear regression by adding a penalty term."), (1, "we use a complicated method to derive the matrix.")], "nid long, body_text string")
    known = spark.createDataFrame([("ridge regression",), ("linear regression",), ("regression",)], "term string")
    assert rows(X.dependencies(deps, known)) == [("ridge regression", "linear regression", 1)]
    cites = spark.createDataFrame([(0, "see Theorem 3.2 and Fig. 4; cf. Eq. 5.1")], "nid long, body_text string")
    assert rows(X.citations(cites).select("kind", "number")) == [("equation", "5.1"), ("figure", "4"), ("theorem", "3.2")]


@pytest.mark.parametrize(("raw", "want"), [("f", "f"), (r"\lambda", "lambda"), ("x_i", "x"), ("f^{T}", "f"), ("123", ""), (r"\sum", ""), ("HK", "HK")])
def test_variables(raw, want):
    assert X.variable(raw) == want


def test_formula_roles(spark):
    used, bound, defined = X.formula_roles(r"f(x) = \int k(x,y) \phi(y) dy")
    assert defined == ["f"] and "y" in bound and {"f", "x", "k", "y", "phi"} <= set(used)
    got = spark.range(1).select(X.formula_variables(F.lit(r"k(x,y) = \sum_{i=1}^n \alpha_i k(x_i, y_i)")).alias("v")).first()["v"]
    assert got["defined"] == ["k"] and "i" in got["bound"]


def test_math_graph(spark):
    log = spark.createDataFrame([("a", "uses", "x", 1.0, "m1", 1), ("a", "uses", "x", 2.0, "m2", 2), ("b", "uses", "x", 1.0, "m", 3)], "src string, type string, dst string, weight double, meta string, seq long")
    edges = G.upsert_edges(log)
    assert rows(edges) == [("a", "uses", "x", 3.0, "m2", 1), ("b", "uses", "x", 1.0, "m", 3)]
    assert rows(G.shared_vars(edges)) == [("a", "b", 1)]
    with pytest.raises(Exception, match="unknown edge type"):
        G.upsert_edges(log.withColumn("type", F.lit("likes"))).collect()
    f = spark.createDataFrame([("p", 1, r"L(y) + \lambda J(f)", ["5.1"]), ("q", 2, "J(f)", ["5.1"]), ("r", 3, "xy", [])], "id string, seq long, latex string, cite_labels array<string>")
    assert rows(G.containment_parents(f)) == [("q", "p")] and rows(G.shared_labels(f)) == [("q", "p", "5.1")]
    v = spark.createDataFrame([("x", "scalar", 1), ("x", "matrix", 2), ("x", "vector", 3), ("y", "scalar", 1)], "name string, role string, seq long")
    assert {r["name"]: r["role"] for r in G.merge_vars(v).collect()} == {"x": "matrix", "y": "scalar"}


def test_sequence(spark):
    w = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abcd"), (1, 2, "ab")], "c int, pos int, word string")
    assert [(r["t_start"], r["t_end"]) for r in S.word_times(w, ["c"], F.lit(8.0)).orderBy("pos").collect()] == [(0, 2), (2, 6), (6, 8)]
    ops = spark.createDataFrame([(1.0, 0, "add", "a", "1"), (2.0, 1, "add", "b", "1"), (3.0, 2, "remove", "a", None), (4.0, 3, "update", "b", "2")], "t double, seq int, kind string, nid string, payload string")
    assert rows(S.replayed(ops)) == [("b", "2", 4.0)] and len(rows(S.replayed(ops, 2.5))) == 2


def test_boxes(spark):
    b = spark.createDataFrame([(0, 1, 0.0, 0.0, 100.0, 10.0), (0, 2, 95.0, 5.0, 50.0, 50.0), (0, 3, 1.0, 1.0, 2.0, 2.0), (0, 4, 500.0, 500.0, 1.0, 1.0)], "scene int, nid int, x double, y double, w double, h double")
    assert rows(P.overlaps(b, 30.0)) == [(0, 1, 2)] and rows(P.overlaps(b, 7.0, drop_contained=False)) == [(0, 1, 2), (0, 1, 3)]
    boxes = P.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert sum(w * h for _, _, w, h in boxes) == pytest.approx(24) and boxes[0] == pytest.approx((0, 0, 3, 2))


@pytest.mark.parametrize(
    ("text", "intent"),
    [
        ("what is this book about", "book_overview"), ("explain chapter 5", "chapter_overview"), ("pause please", "control"), ("what have we covered", "recap"), ("see also", "xref_explore"),
        ("what are the prerequisites", "dependencies"), ("show me ridge regression again", "reshow"), ("section 5.8", "section_overview"), ("section 9.9", "topic_qa"), ("more", "follow_up"),
        ("tell me more", "follow_up"), ("what is a kernel", "topic_qa"), ("", "topic_qa"), ("Again!", "reshow"),
    ],
)
def test_router(spark, text, intent):
    sections = spark.createDataFrame([("5.8",)], "number string")
    assert router.route(spark.createDataFrame([(text,)], "text string"), sections).first()["intent"] == intent


def joined(df):
    """Rows that the joins of a query, once run, have put out."""
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(node.plan())
        else:
            total += node.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
            stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_containment_of_copies(spark):
    n = 1500
    f = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 1, "abc").otherwise("abc+de").alias("latex"))
    found = G.containment_parents(f)
    assert rows(found) == sorted([(f"f{i}", "f0") for i in range(1, n, 2)], key=str)
    assert 0 < joined(found) <= 4 * n  # pairs of all copies: n * n / 8


@pytest.mark.parametrize("long", [False, True])
def test_containment_equals_brute_force(spark, long):
    rng = random.Random(7)
    unit = "abcdefghijklmnopqrstuvwxyzäβ𝛼" if long else "ab"
    texts = ["".join(rng.choices(unit, k=rng.randint(1, 130 if long else 9))) for _ in range(90)]
    for _ in range(160):
        t = rng.choice(texts)
        i = rng.randrange(len(t))
        texts.append(rng.choice([t, t[i : i + rng.randint(1, 99)], t[:i] + " " + t[i:], t + rng.choice(texts)]))
    rng.shuffle(texts)
    keys = [t.replace(" ", "") for t in texts]
    for rank, score in ((None, lambda n, seq: (n, -seq)), (lambda n, seq: n * 4 - seq, lambda n, seq: n * 4 - seq)):
        want = {}
        for i, key in enumerate(keys):
            over = [j for j in range(i) if len(keys[j]) > len(key) >= 3 and key in keys[j]]
            if over:
                want[i] = max(score(len(keys[j]), j) for j in over)
        f = spark.createDataFrame(list(enumerate(texts)), "id int, latex string").withColumn("seq", F.col("id").cast("long"))
        got = {r["id"]: score(len(keys[r["parent"]]), r["parent"]) for r in G.containment_parents(f, rank).collect()}
        assert want and got == want


def test_every_citation_resolves_once(spark):
    """Ids that repeat, a number of two kinds and of two nodes, an unknown kind and number, and nulls."""
    nodes = spark.createDataFrame(
        [("b/b", "section", "1", 5), ("b/a", "theorem", "1", 9), ("b/c", "theorem", "1", 7), ("b/d", None, "1", 8), ("b/e", "section", None, 1), ("b/f", "figure", "2", 2)], "nid string, kind string, number string, preorder long"
    )
    cites = [(1, "b/x", "theorem", "1"), (1, "b/y", "theorem", "1"), (1, "b/y", "theorem", "1"), (2, "b/c", "theorem", "1"), (3, None, "theorem", "1"), (4, "b/x", "table", "1"), (4, "b/x", None, "2"), (5, "b/x", "table", "9"), (None, "b/x", "section", None), (None, "b/x", "section", "1")]
    cites = spark.createDataFrame(cites, "cite_id long, from_nid string, kind string, number string")
    found = [(1, "b/x", "b/c"), (1, "b/y", "b/c"), (1, "b/y", "b/c"), (2, "b/c", None), (3, None, None), (4, "b/x", "b/b"), (4, "b/x", "b/f"), (None, "b/x", "b/b")]
    assert rows(C.resolve(cites, nodes, found_only=True)) == sorted(found, key=str)
    assert rows(C.resolve(cites, nodes)) == sorted([*found, (5, "b/x", None), (None, "b/x", None)], key=str)
