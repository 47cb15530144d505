import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, external, jaccard, mixing, packing, pii, quality, repeats, tokens

from . import brute


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


# PII


def test_base_spans_are_those_of_the_patterns(docs):
    rng = random.Random(3)
    texts = [r.text for r in docs.collect()] + ["".join(rng.choice("a_.@-+ 1234 5(9)%") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    for t in texts:
        assert brute.base_spans(t) == pii.base_spans(t)


def test_pii_scans_are_linear():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "1-" * 100_000):
        pii.candidates(t)


def test_pii_query_columns(spark, docs):
    rows = pii.digest(pii.find(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        spans = brute.base_spans(r["text"])
        listed = [f"{pii.BASE[k]}:{s}:{e}" for s, k, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert set(listed) <= set(r["spans"].split(","))


def test_pii_adds_spans_and_leaves_decoys(spark):
    text = [f'Call (555) 010-{i:04d}; token = "{hashlib.sha1(bytes([i])).hexdigest()}" but 4111111111111112 is no card, 4111111111111111 is, v1.2' for i in range(200)]
    got = pii.find(spark.createDataFrame(enumerate(text), "doc_id long, text string")).first()
    kinds = [s["kind"] for s in got["spans"]]
    assert kinds == ["phone", "secret", "card"]
    assert "4111111111111112" in pii.redact(text[0], got["spans"]) and "[SECRET]" in pii.redact(text[0], got["spans"])


@pytest.mark.parametrize("text", ["JOE (AT) EXAMPLE (DOT) COM", "joe@example[.]com", "joe [at] example(.)com", "Joe AT Example DOT Com", "joe at example dot com"])
def test_pii_spelled_addresses(text):
    assert pii.candidates(f"x, {text}!") == [(3, 0, 3 + len(text), False)]


@pytest.mark.parametrize("text", ["f0" * 16, "f0" * 64, "f0" * 65, "f0" * 50_000, "sk-" + "aZ9_" * 4, "sk-" + "aZ9_" * 25, "ghp_" + "aZ9_" * 26, "xoxb-" + "aZ9-" * 50_000])
def test_pii_secrets_of_any_length(text):
    assert pii.candidates(f"key {text}, x") == [(4, 6, 4 + len(text), False)]
    assert pii.candidates(f"key {text}/x") == []


def test_pii_odd_rows(odd_docs, no_docs):
    assert pii.digest(pii.find(odd_docs)).count() == odd_docs.count()
    assert pii.digest(pii.find(no_docs)).count() == 0


# Packing


def test_chunked_ids_equal_the_tokenizer(docs):
    code = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    odd = ["It's they'RE we'd ²½ x_y á İ ﬁ 中文字 😀!! \x1c a \xa0bar <|endoftext|> 'Sfoo o'dell ŉ ΑΣ σς", "", "   ", "a" * 5000, "1234 ١٢ Ⅷ", "é ñ"]
    for t in [r.text for r in docs.collect()] + odd:
        assert np.frombuffer(code.encode(t), "<u4").tolist() == code.whole.encode(t, add_special_tokens=False).ids


def check_pieces(rows, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return by_doc, by_seq


def test_packing_round_trip(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_seq = check_pieces(rows, 4096)
    code = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    total = padding = 0
    for d in docs.collect():
        ids = [x for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == code.whole.encode(d["text"], add_special_tokens=False).ids + [2]
        total += len(ids)
    for s in by_seq.values():
        n = sum(r["length"] for r in s)
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding < 0.02 * total


def test_plan_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 14))])
        fees, size = rng.integers(0, 9, 15), 9
        cost = [0] + [10**9] * 14
        for j in range(1, 15):
            for i in range(j):
                if places[j] - places[i] <= size:
                    cost[j] = min(cost[j], cost[i] + size - (places[j] - places[i]) + fees[j])
        cuts, c, last = packing.plan(places, fees, size, True), 0, 0
        for j in cuts:
            assert places[j] - places[last] <= size
            c += size - (places[j] - places[last]) + fees[j]
            last = j
        assert c == cost[14]


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, size=64).collect()
    check_pieces(rows, 64)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
    assert packing.pack(no_docs).count() == 0


# Exact dedup


def test_dedup_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.dedup_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    groups = {}
    for r in odd_docs.collect():
        groups.setdefault(hashlib.sha256((r["text"] or "").translate(brute.A_TO_Z).encode()).hexdigest(), []).append(r["doc_id"])
    for h, ids in groups.items():
        own = [r for r in rows if r["text_sha256"] == h]
        win = max(ids, key=lambda i: -1 if i is None else i)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(win, len(ids))}
        assert [r["doc_id"] for r in own if r["kept"]] == [win]
    kept = exact_dedup.dedup_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup_report(no_docs).count() == 0 and exact_dedup.dedup_rows(no_docs).count() == 0


def test_dedup_heavy_hitters_agree_with_the_ordinary_path(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    few = collected(exact_dedup.dedup_report(df, k=1, max_items=8))
    assert few == collected(exact_dedup.dedup_report(df)) and sum(r[3] for r in few) == exact_dedup.dedup_rows(df).count()


# Jaccard


def variants(seed=7, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 30, 100, 300]))] for _ in range(15)]
    rows = []
    for i in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            b += rng.choice(bases)[:40]
        rows.append((i, rng.choice(["\t", " ", "\n "]).join(b)))
    return rows


def test_components_equal_brute_force(spark, docs):
    rows = variants()
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == brute.components(rows)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for ordered in (docs, docs.orderBy(F.xxhash64("doc_id")).coalesce(1)):
        assert sorted(map(tuple, jaccard.link(ordered).collect())) == brute.components(rows)


def test_r_tree_bound_misses_nothing():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 2**64, 60, np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), False), rng.integers(0, 2**64, 5, np.uint64)])) for _ in range(60)]
    n, vectors = np.array(list(map(len, sets))), [jaccard.count_vector(s) for s in sets]
    found = {tuple(sorted(map(int, p))) for p in jaccard.candidate_pairs(n, np.arange(60), vectors, 75)}
    assert all((i, j) in found for i in range(60) for j in range(i + 1, 60) if jaccard.linked(sets[i], sets[j], 75))


def test_jaccard_odd_rows(odd_docs, no_docs):
    got = collected(jaccard.link(odd_docs))
    assert len(got) == odd_docs.count()
    by_id = {r[0]: r[2] for r in got}
    assert by_id[4] == by_id[5] == 3 and by_id[7] == 6 and by_id[9] == 8 and by_id[0] == 0 and by_id[None] is None and by_id[2] == 2
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {None, 0, 1, 2, 3, 6, 8, 10, 11, 12}
    assert jaccard.link(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_texts_of_shared_ids_stay_or_go_by_themselves(spark, odd_docs):
    rows, rng = [(d, t, i) for i, (d, t) in enumerate(variants())], random.Random(9)
    rows = [(rng.choice([None, d // 3, d // 40]), t, i) for d, t, i in rows] + [(None, t, 1000 + i) for _, t, i in rows[:50]]
    rows += [(d, t, 2000 + i) for d, t, i in rows[:20]]
    got = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, i int"), None).collect()
    parts = sorted({(-1 if d is None else d, t or "") for d, t, _ in rows})
    groups = {}
    for j, n, c in brute.components([(j, t) for j, (_, t) in enumerate(parts)]):
        groups.setdefault(c, []).append((parts[j], n))
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got)
    for members in groups.values():
        held = [x for x in kept if x in {m for m, _ in members}]
        if members[0][1]:
            assert len(held) == 1 and held[0][0] == min(m[0] for m, _ in members)
        else:
            assert len(held) == sum((-1 if d is None else d, t or "") == members[0][0] for d, t, _ in rows)
    odd = corpus_pipeline.jaccard_stage(spark, odd_docs, None)
    assert odd.columns == odd_docs.columns and collected(odd.filter("doc_id IN (5, 9) OR doc_id IS NULL").select("doc_id", "text")) == sorted([(9, "other text of the same id here"), (None, "no id at all in this row"), (None, None)], key=str)


def test_long_words_and_segments():
    text = b"abc " * 700_000 + b"x" * 3_000_000 + b" end"
    one = jaccard.shingle_sets([text])[0]
    assert len(one) == len(set(zip(*[text.split()[i:] for i in range(5)], strict=False)))


# Mixing


def test_mixing_targets_and_rows(docs, spark):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in sorted(docs.collect(), key=lambda r: r["source"]):
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in own) == pytest.approx(want[s], rel=0.02, abs=60)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert collected(mixing.mix(docs)) == sorted(map(tuple, rows), key=str)
    taken = mixing.mixed_rows(docs)
    assert taken.columns == docs.columns and sum(len(brute.words(r["text"])) for r in taken.collect()) == sum(r["taken"] for r in rows)


def test_mixing_caps_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, "w " * (1000 if i < 50 else 1), "a" if i < 50 else "b" if i < 60 else None) for i in range(70)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = brute.targets({"a": 50_000, "b": 10, None: 10})
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)
    assert len(mixing.mix(odd_docs).collect()) == odd_docs.count() and mixing.mixed_rows(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


# Quality


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert r[0] > 0.98 and r[1] > 0.99


def test_trees_as_arrays_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.fit(x, y, n_trees=20)
    for row, s in zip(x[:50], t.score(x[:50]), strict=True):
        z = t.base
        for f, c, v in zip(t.feature, t.threshold, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            z += v[node - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-z)))
    assert ((t.score(x) > 0.5) == y).mean() > 0.95


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (8, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(odd_docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.classify(no_docs, labels).count() == 0


# Repeats


def test_repeats_equal_brute_force(spark, docs):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.choice([50, 99, 100, 101, 140, 300, 1000]))) for _ in range(20)]
    rows = []
    for i in range(150):
        t = ""
        for _ in range(rng.randint(0, 5)):
            r = rng.random()
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            t += x if r < 0.5 else x[a : a + rng.randint(0, 250)] if r < 0.7 else rng.choice("ab") * rng.randint(0, 400) if r < 0.8 else "".join(rng.choice("hijklmno") for _ in range(rng.randint(0, 150)))
        rows.append((i * 7 % 1000, t if i % 40 else None))
    got = {r[0]: tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=5000).collect()}
    assert got == brute.repeats(rows)
    small = docs.filter("length(text) < 3000").orderBy(F.xxhash64("doc_id")).coalesce(2)
    assert {r[0]: tuple(r) for r in repeats.remove_repeats(small).collect()} == brute.repeats([(r["doc_id"], r["text"]) for r in small.collect()])


def test_marks_of_a_long_hash_group_among_small_ones():
    rng, length = np.random.default_rng(4), 100
    side = length - repeats.GRAM
    sizes = [3] * 5000 + [70_000] + [3] * 20_000 + [2, 4, 6] * 500
    rows = np.zeros(sum(sizes), repeats.around(2 * side + repeats.GRAM))
    rows["hash"] = np.repeat(np.arange(len(sizes)), sizes)
    rows["doc"] = np.arange(len(rows))
    rows["pos"] = 1000
    rows["left"] = rng.integers(side - 2, side + 1, len(rows))
    rows["right"] = rng.integers(0, 4, len(rows))
    rows["bytes"][:, [1, side + 10, length + 2]] = rng.integers(0, [3, 2, 3], (len(rows), 3))
    want, seen = {}, set()
    for r in rows:
        held = [s for s in range(side + 1) if r["left"] >= side - s and r["right"] >= s]
        strings = [(r["hash"], s, r["bytes"][s : s + length].tobytes()) for s in held]
        if hits := [x[1] for x in strings if x in seen]:
            want[int(r["doc"])] = (1000 - side + hits[0], 1000 - side + hits[-1] + length)
        seen.update(strings)
    got = repeats.induced_marks(rows, side, length)
    assert {int(d): (int(s), int(e)) for d, _, s, e in got} == want and len(got) == len(want)


def test_repeats_odd_rows(odd_docs, no_docs):
    rows = repeats.remove_repeats(odd_docs, with_bytes=True).collect()
    assert len(rows) == odd_docs.count()
    assert {tuple(r)[:4] for r in rows if r["doc_id"] == 5} == {(5, 3, 0, 0)}
    x = next(r for r in rows if r["doc_id"] == 11)
    assert bytes(x["kept"]) == b"x" and x["n_spans"] == 1
    assert repeats.remove_repeats(no_docs).count() == 0


def test_sorter_spills_and_keeps_hashes_whole():
    kind = repeats.SUFFIX
    sorter, rng, every = external.Sorter(kind, 500), np.random.default_rng(1), []
    for _ in range(30):
        x = np.zeros(300, kind)
        x["hash"], x["pos"] = rng.integers(0, 40, 300), rng.integers(0, 10**6, 300)
        sorter.add(x)
        every.append(x)
    every = np.concatenate(every)
    blocks = list(sorter.blocks(37))
    assert (np.concatenate(blocks) == every[np.lexsort((every["pos"], every["hash"]))]).all()
    assert all(a["hash"][-1] < b["hash"][0] for a, b in zip(blocks, blocks[1:], strict=False)) and len(blocks) > 5
    assert (external.expand(external.squeeze(every), kind) == every).all()


def test_linking_sets_share_the_cells_they_need():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 200))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.75, 1))), False), rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), np.uint64)]))
        if jaccard.linked(a, b, 75):
            level = np.zeros(jaccard.COUNTERS, np.uint8)
            both = len(np.intersect1d(jaccard.prefix(a, level, 75), jaccard.prefix(b, level, 75)))
            assert both >= jaccard.least_cells(len(a), len(b), 75) >= 1
            need = jaccard.cells_needed(np.zeros(3, int), np.array([len(a), len(b), 10**6]), 75)
            assert 1 <= need[0] <= both and 1 <= need[1] <= both and need[2] == 0
    assert jaccard.enough(np.array([1, 3, 3, 9])).tolist() == [True, True, True, False] and jaccard.enough(np.array([2, 3, 3, 9, 9])).tolist() == [True, True, True, False, False]
    assert jaccard.enough(np.array([2, 5])).tolist() == [False, False]


def test_rates_equal_brute_force(docs):
    rows = mixing.mix(docs).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        size, target = np.array([r["size"] for r in own], float), own[0]["target"]
        low, high = -50.0, 1.1
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (size * np.minimum(3, np.exp(middle * size))).sum() < target else (low, middle)
        assert np.allclose([r["rate"] for r in own], np.where(size > 0, np.minimum(3, np.exp(low * size)), 0), atol=1e-6)
        assert abs(sum(r["taken"] for r in own) - target) <= max(0.01 * target, size.max())


def test_packing_follows_from_the_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    seen = {str(collected(packing.pack(docs.repartition(n)))) for n in (1, 7, 64)}
    assert len(seen) == 1
    rows = packing.pack(docs.repartition(64)).collect()
    assert sum(r["start"] == 0 for r in rows) == docs.count()  # repeated rows are packed twice
    assert len({r["sequence_id"] for r in rows}) <= sum(r["length"] for r in rows) / 4096 * 1.02 + 13


def test_families_of_near_copies_keep_their_links(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for family in range(3):
        base = [rng.choice(words) for _ in range(60)]
        for i in range(120):  # about as many pairs link as do not
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(60)] = rng.choice(words)
            rows.append((family * 1000 + i, " ".join(text)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=20_000)
    assert sorted(map(tuple, got.collect())) == sorted(brute.components(rows))


def test_added_spans_precision_and_recall(spark):
    rng = random.Random(5)
    token = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    good = [lambda: f"name: Mr. Émile Zölä{rng.choice('abc')}", lambda: f"contact {rng.choice(['Anna', 'Paul', 'Klaus'])} Schmidt", lambda: f"token = {token()}", lambda: f"call 555 010 {rng.randint(1000, 9999)}"]
    bad = [lambda: f"card {rng.randint(10**15, 10**16 - 1)}", lambda: f"see page {rng.randint(100, 999)}", lambda: "the quick Brown fox", lambda: f"isbn {rng.randint(10**12, 10**13 - 1)}"]
    rows, want = [], {}
    for i in range(400):
        planted = i % 2 == 0
        text = rng.choice(good if planted else bad)()
        rows.append((i, f"Some words before {text} and after."))
        want[i] = planted
    got = {r["doc_id"]: any(not s["base"] for s in r["spans"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(got[i] and want[i] for i in want)
    assert hits / sum(want.values()) >= 0.95 and hits / max(1, sum(got.values())) >= 0.95
