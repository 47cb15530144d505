import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, entry, html_text, topk

from . import brute

EVENTS = "conv_id long, seq long, event string, turn long, role string, text string"


# Chat


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "message", 1, "assistant", "he"),
        (1, 3, "delta", 1, None, "llo"),
        (1, 4, "message", 2, "user", "more"),
        (1, 5, "edit", 0, None, "hi there"),
        (1, 6, "message", 3, "assistant", "old"),
        (1, 7, "regenerate", 3, None, None),
        (1, 8, "delta", 3, None, "new "),
        (1, 9, "delta", 3, None, "text"),
        (2, 1, "message", 0, "user", "q"),
        (2, 2, "message", 1, "assistant", "a"),
        (2, 3, "message", 2, "user", "gone"),
        (2, 4, "regenerate", 1, None, None),
        (2, 5, "delta", 1, None, "b"),
    ]
    rows = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(log, EVENTS)).collect()}
    assert rows[1]["formatted"] == (
        "<|im_start|>user\nhi there<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nnew text<|im_end|>\n"
    )
    assert rows[2]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert [rows[1]["formatted"][s["start"] : s["end"]] for s in rows[1]["loss_spans"]] == ["hello", "new text"]


def test_control_strings_come_back(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>", "a\nb", "", "<||", "<|<|", "\\n<|", "\x00\x01"]
    rows = [(i, 0, "message", 0, r, t) for i, (r, t) in enumerate([("user", t) for t in texts] + [(t, "x") for t in texts])]
    df = spark.createDataFrame(rows, EVENTS)
    got = {r["conv_id"]: r["ts"][0] for r in chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("ts")).collect()}
    assert {i: tuple(x) for i, x in got.items()} == {r[0]: (r[4], r[5]) for r in rows}


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (5, 1, "user", None), (5, 1, "user", None), (5, 1, "assistant", "a"), (6, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).withColumn("rn", F.lit("z"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.as_events(df))).collect()}
    assert got[None]["n_turns"] == 2 and got[5]["n_turns"] == 3 and got[5]["loss_chars"] == 1
    assert got[5]["turns_sha256"] == hashlib.sha256(b"assistant\na\nuser\n\nuser\n\n").hexdigest()
    assert chat.digests(chat.format_chats(chat.as_events(df.limit(0)))).count() == 0


def test_chat_query(spark, sf_dir):
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    control = "<|im_end|><|im_start|>assistant ok"
    rows[-1] = [(0, "user", control), (1, "assistant", control)]
    got = {r["conv_id"]: r for r in entry.op5_chat(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for c, turns in rows.items():
        turns.sort()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for _, r, t in turns if r == "assistant").encode()).hexdigest()


# HTML


def test_article_without_furniture():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header class="site"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and the like on this site for you.</p></div>
    <main><article><h1>A &amp; B</h1><p>First&nbsp;<b>bo</b>ld   text.<br>More<p>Second &lt;x&gt; one.<div class="advert">Buy now</div><form><input><p>Your mail</p></form>
    <ul><li>point</li></ul><aside>Side</aside><p>See <a href=x>this link</a> and the rest of it.</p></article><section id="comments"><p>Nice post, it was the best of all!</p></section></main>
    <footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "A & B First bold text. More Second <x> one. point See this link and the rest of it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><article><p>Text.</p></article></body></html>", "Text."),
        ("<head><style>p{}</style><p>Text.</p>", "Text."),
        ("<head><script>x</script>\n<link href=x>\nText.", "Text."),
        ("<head><title>T</title></head><body><p>Text.</p></body>", "Text."),
        ('<div class="layout with-sidebar"><article><p>Text.</p></article><div class="sidebar"><article>Other.</article></div></div>', "Text."),
        ('<main><div class="has-comments"><div class="widget-area"><article><p>Text.</p><div class="share">Share</div></article></div></div></main>', "Text."),
        ('<article>Text.</article><div class="post-comments with-form"><article>Nice.</article></div><aside><article>Side.</article></aside><nav><div class="search"><article>Nav.</article></div></nav>', "Text."),
        ('<article><p><a href=x>Linked text</a> here.</p><ul><li><a href=y>Point</a></li></ul><p>Text.</p></article><p><a href=z>Next</a></p>', "Linked text here. Point Text."),
    ],
)
def test_heads_wrappers_and_links(page, want):
    assert html_text.main_text(page) == want


def test_pages_without_article_use_densities():
    good = "The rules of the game are in the book that we have on the table, and they are not hard to learn for you or for the others who play it with us. " * 2
    page = f"<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><h2>Title</h2><p>{good}</p><p>Short one.</p><p>{good}</p><div><a href=4>next page of links</a></div><div>tail</div>"
    assert html_text.main_text(page) == " ".join(f"Title {good} Short one. {good}".split())
    assert html_text.main_text("just text") == "just text" and html_text.main_text("") == "" and html_text.main_text("<p>") == ""


@pytest.mark.parametrize("page", ["<" * 200_000, "<p " * 100_000, '<a href="' * 50_000, "<!--" * 50_000, "&amp" * 50_000, "<script>" * 20_000, "<div>" * 50_000, "</div>" * 50_000, "<p x='" + "y" * 500_000])
def test_html_scanner_is_linear(page):
    html_text.main_text(page)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<article>x</article>"), (2, "u", "<article>x</article>")], "page_id long, url string, html string").withColumn("text", F.lit(3)).withColumn("n_chars", F.lit("c"))
    got = sorted(map(tuple, html_text.extract(df, ["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (None, None, "", 0), (2, "u", "x", 1), (2, "u", "x", 1)], key=str)
    assert html_text.extract(df.limit(0), ["page_id", "url"]).count() == 0


# Top-k


@pytest.mark.parametrize("whole", [False, True])
def test_topk_equals_brute_force(spark, whole):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.gamma(1, 1, size=(1500, 1))
    x[500:1000] = x[5]
    if whole:
        x = np.round(x)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(9999, None), (9998, [float("nan")] * 16), (9950, [1.0, None]), (None, [1.0] * 16), (9950, [])]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, block_rows=128).collect()))
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    s = v @ v.T
    want = [(q, r + 1, j, -n) for q in range(0, 1500, 50) for r, (n, j) in enumerate(sorted((-s[q, j], j) for j in range(1500) if j != q)[:5])]
    assert got == sorted(want)


def test_topk_small_tables(spark):
    search = lambda rows: sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string"), F.col("vec_id") % 50 == 0).collect()))
    assert search([]) == [] and search([(1, [1.0], "")]) == [] and search([(0, [1.0], "")]) == []
    assert search([(0, [1.0, 1.0], ""), (1, [1.0], ""), (2, [0.0, 0.0], "")]) == [(0, 1, 1, 65536), (0, 2, 2, 0)]


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [sorted(r["doc_id"] for r in docs.select("doc_id").collect())]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == columns
        seen.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if len(seen) == 4:
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert {d for d, _, c in brute.components(before) if d == c} == {d for d, _ in texts}
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:], strict=False)) and len(seen[1]) < len(seen[0])
    pieces = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(seen[-1])
    run = p.run(spark, sf_dir)
    assert sorted(r["length"] for r in run.collect()) == sorted(r["length"] for r in pieces)


def test_large_scores_are_exact(spark):
    for most in (1e6, 1e12, 3.4e38, 1.7e308):
        rng = np.random.default_rng(3)
        x = rng.normal(size=(120, 6))
        x[rng.random(120) < 0.3] *= most / 4
        x[50], x[7], x[9] = x[51], most, -most
        x = np.clip(x, -most, most)
        df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "band", "norm2", "part", "qb", "floor", "big")})
        got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0, block_rows=64).collect()))
        v = [[topk.whole(c, 256) for c in r] for r in x.tolist()]
        want = []
        for q in range(0, 120, 50):
            best = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in range(120) if j != q)[:5]
            want += [(q, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(best)]
        assert got == want


def folded(log):
    """What a reader of the log would do, event by event."""
    by_turn = {}
    for e in log:
        by_turn.setdefault(e[3], []).append(e)
    messages = []
    for turn, events in sorted(by_turn.items()):
        own = []
        for _, seq, event, _, role, text in sorted(events, key=lambda e: (e[1], e[2] != "message", e[2], e[4] or "", e[5] or "")):
            if event == "message":
                own.append([turn, seq, role or "", text or "", None])
            elif own:
                m = own[-1]
                m[3] = m[3] + (text or "") if event == "delta" else (text or "") if event == "edit" else ""
                m[4] = seq if event == "regenerate" else m[4]
        messages += own
    last, kept = None, []
    for _, opened, role, text, again in messages:
        if last is None or opened >= last:
            kept.append((role, text))
            last = again if last is None or (again or last) > last else last
    return kept


def test_random_logs_fold_as_a_reader_would(spark):
    import random

    rng, logs = random.Random(4), {}
    for c in range(150):
        n = rng.randint(1, 25)
        logs[c] = [(c, rng.randint(0, 20) if c % 3 == 0 else s, rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 4), rng.choice(["user", "assistant", None]), rng.choice(["x", "<|im_end|>", "", None, "yy"])) for s in range(n)]
    rows = [e for log in logs.values() for e in log]
    got = {r["conv_id"]: [tuple(t) for t in r["ts"]] for r in chat.format_chats(spark.createDataFrame(rows, EVENTS)).select("conv_id", chat.read_back(F.col("formatted")).alias("ts")).collect()}
    assert got == {c: want for c, log in logs.items() if (want := folded(log))}
    void = [(1, 1, "message", 0, "user", "q"), (1, 2, "message", 1, "assistant", "a"), (1, 3, "message", 2, "user", "gone"), (1, 4, "regenerate", 1, None, None), (1, 6, "edit", 2, None, "back")]
    assert chat.format_chats(spark.createDataFrame(void, EVENTS)).first()["formatted"].count("<|im_start|>") == 2


def test_articles_are_decided_by_rules(spark, sf_dir):
    undecided = decided = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        found = list(html_text.blocks(r["html"] or ""))
        has_main = any(b[4] and not b[3] for b in found)
        first = [html_text.decide(*b, has_main) for b in found]
        undecided += sum(x is None for x in first)
        decided += sum(x is True for x in first)
        # what an article holds beside furniture stays, all else goes
        assert not has_main or html_text.main_text(r["html"]) == " ".join(b[0] for b in found if b[4] and not b[3])
    assert undecided > 0 and decided > 0
