"""More of the catalog: predicates, lookups, upserts, picks, layout and session queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import settle
from ..functions import prose as N
from ..operators import hooks
from ..operators import lookups as L
from ..operators import retrieval as R
from ..operators import spatial as P
from ..streaming import boards
from .catalog import BM25, bm25_scores, query, r6
from .views import load, with_views

NOISE = r"(s = '' OR regexp_matches(s, '(?i)^(?:this is page\b|printer\s*:\s*opaq\w*|springer series\b|isbn\b|copyright\b|to (?:my|our) (?:parents|families|wife|husband|teachers)\b|library of congress\b|all rights reserved\b)') OR regexp_matches(s, '^\d+\.?$') OR regexp_matches(s, '^(?:[A-Z][a-z]+\s+[A-Z][a-z]+,?\s*){3,}$'))"
STRIPPED = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"

# Predicates and text


@query("flt01_candidates", r"SELECT nid FROM passages WHERE regexp_matches(body_text, '\S')", ("passages",))
def flt01_candidates(spark, d):
    return L.candidates(load(spark, d, "passages")).select("nid")


@query("flt02_kinds", "SELECT nid, kind FROM nodes WHERE kind IN ('chapter', 'section')", ("nodes",))
def flt02_kinds(spark, d):
    return L.candidates(load(spark, d, "nodes"), exclude=["theorem"]).select("nid", "kind")


@query("flt06_kind_flags", "SELECT nid, kind IN ('chapter', 'section') AS structural, kind = 'theorem' AS environment FROM nodes", ("nodes",))
def flt06_kind_flags(spark, d):
    return load(spark, d, "nodes").select("nid", F.col("kind").isin(N.STRUCTURAL).alias("structural"), F.col("kind").isin(N.ENVIRONMENTS).alias("environment"))


@query("flt07_noise", f"SELECT conv_id, turn, {NOISE} AS noise FROM (SELECT conv_id, turn, {STRIPPED.format('text')} AS s FROM conversations)")
def flt07_noise(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", N.is_noise(F.col("text")).alias("noise"))


@query(
    "flt08_clean_lines",
    f"""SELECT doc_id, sha256({STRIPPED.format("array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: NOT (regexp_matches(trim(x, ' '), '(?i)^(?:this is page\\b|printer\\s*:\\s*opaq\\w*|springer series\\b|isbn\\b|copyright\\b|to (?:my|our) (?:parents|families|wife|husband|teachers)\\b|library of congress\\b|all rights reserved\\b)') OR lower(trim(x, ' ')) IN ('to our parents', 'dedication', 'preface'))), chr(10))")}) AS cleaned FROM documents""",
)
def flt08_clean_lines(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(N.without_noise_lines(F.col("text")), 256).alias("cleaned"))


@query("flt10_number_clauses", "SELECT event_id, event_type <> 'click' AND length(user_id || ' 5.') <= 12 AS skipped FROM events")
def flt10_number_clauses(spark, d):
    clause = F.when(F.col("event_type") == "click", F.concat(F.col("user_id"), F.lit(" clicks"))).otherwise(F.concat(F.col("user_id"), F.lit(" 5.")))
    return load(spark, d, "events").select("event_id", N.is_number_clause(clause).alias("skipped"))


@query("flt14_figure_area", "SELECT scene, nid, w * h AS area FROM boxes WHERE w * h >= 500", ("boxes",))
def flt14_figure_area(spark, d):
    area = N.box_area(F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    return load(spark, d, "boxes").select("scene", "nid", area.alias("area")).filter("area >= 500")


@query("flt27_relevant", "SELECT a.vec_id AS id FROM embeddings a, embeddings q WHERE q.vec_id = 0 AND list_cosine_similarity(list_transform(a.embedding, lambda x: cast(x AS DOUBLE)), list_transform(q.embedding, lambda x: cast(x AS DOUBLE))) >= 0.05")
def flt27_relevant(spark, d):
    vectors = load(spark, d, "embeddings")
    return L.relevant(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), vectors.filter("vec_id = 0").select(F.col("embedding").alias("qvec")), 0.05).select("id")


@query("flt28_deltas", "SELECT nid, kind, t FROM ops WHERE t > 500", ("ops",))
def flt28_deltas(spark, d):
    return load(spark, d, "ops").filter("t > 500").select("nid", "kind", "t")


@query(
    "str10_titles",
    r"""SELECT doc_id, CASE WHEN regexp_matches(t, '[A-Za-z]') THEN CASE WHEN length(t) > 80 THEN regexp_replace(substr(t, 1, 77), '\s+$', '') || '…' ELSE t END ELSE '' END AS title FROM (
    SELECT doc_id, CASE WHEN regexp_matches(t, '[.?!]\s+[A-Z]') THEN regexp_extract(t, '^((?s:.*?)[.?!])\s+[A-Z]', 1) ELSE t END AS t FROM (SELECT doc_id, regexp_replace(regexp_replace("""
    + STRIPPED.format("text")
    + r""", '[.,;:)\]} ]+$', ''), '^[(\[{ ]+', '') AS t FROM documents))""",
)
def str10_titles(spark, d):
    return load(spark, d, "documents").select("doc_id", N.clean_title(F.col("text")).alias("title"))


@query("str08_pieces")
def str08_pieces(spark, d):
    """A scan for the last separator in reach, piece by piece; tests hold it against a step-by-step version."""
    return load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(N.sentence_pieces(F.col("text"), 200)).alias("pos", "piece"))


@query("str12_join_nid", "SELECT nid, CASE WHEN parent = '' THEN nid ELSE parent || '/' || regexp_extract(nid, '([^/]+)$', 1) END AS joined FROM (SELECT nid, regexp_extract(nid, '^(.*)/[^/]+$', 1) AS parent FROM nodes)", ("nodes",))
def str12_join_nid(spark, d):
    return load(spark, d, "nodes").select("nid", N.join_nid(F.regexp_extract("nid", "^(.*)/[^/]+$", 1), F.regexp_extract("nid", "([^/]+)$", 1)).alias("joined"))


@query("str14_concepts", "SELECT DISTINCT p_brand AS surface, CASE WHEN p_size_ok THEN regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') END AS cid FROM (SELECT p_brand, regexp_extract(p_brand, '([0-9])$', 1) <> '1' AS p_size_ok FROM part)")
def str14_concepts(spark, d):
    brands = load(spark, d, "part").select(F.col("p_brand").alias("surface")).distinct()
    key = N.concept_key(F.col("surface"))
    return L.canonical_concepts(brands, brands.filter("surface NOT LIKE '%1'").select(key.alias("alias"), key.alias("cid")))


@query("str59_escaped", "SELECT conv_id, turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM conversations")
def str59_escaped(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", N.xml_escaped(F.col("text")).alias("escaped"))


@query("src28_markers", "SELECT nid, number AS label FROM nodes WHERE kind = 'section'", ("nodes",))
def src28_markers(spark, d):
    line = F.concat(F.lit("as in ("), F.col("number"), F.lit(") and (x)"))
    return load(spark, d, "nodes").select("nid", F.explode(N.equation_markers(line)).alias("label"))


@query("src03_blocks")
def src03_blocks(spark, d):
    """Blocks of texts made of the tree's theorems, each with a proof after it; offsets need a scanner, so tests hold them against a line-by-line version."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("preorder", "number", "title"))), lambda x: F.concat(F.lit("Theorem "), x["number"], F.lit(". "), x["title"], F.lit("\nProof. By "), x["number"], F.lit("\n")))
    pages = load(spark, d, "nodes").filter("kind = 'theorem'").groupBy(F.regexp_extract("nid", "^(.*)/[^/]+$", 1).alias("nid")).agg(F.array_join(lines, "").alias("body_text"))
    return L.blocks(pages)


@query("mth12_text_boxes", "SELECT nid, round(CASE nid % 3 WHEN 0 THEN x - wd / 2 WHEN 1 THEN x - wd ELSE x END, 6) AS x0, round(y - 0.85 * h, 6) AS y0 FROM (SELECT *, greatest(1, length('n' || nid)) * h * 0.55 AS wd FROM boxes)", ("boxes",))
def mth12_text_boxes(spark, d):
    anchor = F.element_at(F.array(F.lit("middle"), F.lit("end"), F.lit("start")), (F.col("nid") % 3 + 1).cast("int"))
    box = N.text_box(F.col("x"), F.col("y"), F.col("h"), anchor, F.concat(F.lit("n"), F.col("nid")))
    return load(spark, d, "boxes").select("nid", box.alias("b")).select("nid", r6(F.col("b.x0")).alias("x0"), r6(F.col("b.y0")).alias("y0"))


@query("mth13_clip", "SELECT nid, round(x + w / 2 + t * (1000 - x - w / 2), 6) AS px, round(y + h / 2 + t * (1000 - y - h / 2), 6) AS py FROM (SELECT *, greatest(0.0, least(1.0, CASE WHEN 1000 > x + w / 2 THEN (w / 2) / (1000 - x - w / 2) WHEN 1000 < x + w / 2 THEN (-w / 2) / (1000 - x - w / 2) ELSE 1.0 END, CASE WHEN 1000 > y + h / 2 THEN (h / 2) / (1000 - y - h / 2) WHEN 1000 < y + h / 2 THEN (-h / 2) / (1000 - y - h / 2) ELSE 1.0 END)) AS t FROM boxes)", ("boxes",))
def mth13_clip(spark, d):
    x, y, w, h = map(F.col, "xywh")
    at = N.clipped(x + w / 2, y + h / 2, F.lit(1000.0), F.lit(1000.0), x, y, w, h)
    return load(spark, d, "boxes").select("nid", at.alias("p")).select("nid", r6(F.col("p.x")).alias("px"), r6(F.col("p.y")).alias("py"))


@query("mth14_ids", "SELECT nid, substr(sha256(nid || '|' || kind), 1, 12) AS id FROM nodes", ("nodes",))
def mth14_ids(spark, d):
    return load(spark, d, "nodes").select("nid", N.stable_id(F.col("nid"), F.col("kind")).alias("id"))


@query("dat01_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def dat01_iso(spark, d):
    return load(spark, d, "events").select("event_id", N.iso_utc(F.col("ts")).alias("at"))


@query("jsn05_levels", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS text FROM part")
def jsn05_levels(spark, d):
    level = {"L1": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), "L0": F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(""), "L2": F.col("p_name"), "L3": F.lit("x"), "L4": F.lit("")}
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), N.level_text(level, "L1").alias("text"))


# Lookups


@query("jon06_figures_concepts", "SELECT DISTINCT p.p_brand AS cid, f.p_partkey AS fid FROM part p JOIN part f ON p.p_size = f.p_size")
def jon06_figures_concepts(spark, d):
    part = load(spark, d, "part")
    return L.together(part.select(F.col("p_size").alias("home"), F.col("p_brand").alias("cid")), part.select(F.col("p_size").alias("home"), F.col("p_partkey").alias("fid")), "home", "cid", "fid")


KEY = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query("jon08_passages_by_text", f"SELECT c.conv_id * 1000 + c.turn AS cid, coalesce(min(p.turn), -1) AS pid FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND {KEY.format('p.text')} = {KEY.format('c.text')} AND {KEY.format('p.text')} <> '' GROUP BY 1")
def jon08_passages_by_text(spark, d):
    turns = load(spark, d, "conversations")
    home = F.col("conv_id").cast("string").alias("home_nid")
    clauses = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("cid"), home, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit("\n")).alias("text"))
    return L.passages_by_text(clauses, turns.select(F.col("turn").alias("pid"), home, "text", F.col("turn").alias("seq"))).na.fill(-1, ["pid"])


@query("jon09_formulas_of_passages", "SELECT DISTINCT dst AS pid, src AS id FROM edges_log JOIN formulas ON id = src WHERE type = 'about'", ("edges_log", "formulas"))
def jon09_formulas_of_passages(spark, d):
    edges = load(spark, d, "edges_log").select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))
    return L.formulas_of_passages(edges, load(spark, d, "formulas"))


@query("jon15_environments", "SELECT kind, number, nid FROM (SELECT DISTINCT 'theorem' AS kind, regexp_extract(label, '([0-9.]+)$', 1) AS number FROM refs) LEFT JOIN (SELECT kind, number, arg_min(nid, preorder) AS nid FROM nodes GROUP BY 1, 2) USING (kind, number)", ("nodes", "refs"))
def jon15_environments(spark, d):
    wanted = load(spark, d, "refs").select(F.lit("theorem").alias("kind"), F.regexp_extract("label", "([0-9.]+)$", 1).alias("number")).distinct()
    return L.environment(wanted, load(spark, d, "nodes"))


@query("jon22_references", "SELECT from_nid AS home_nid, label, arg_max(to_nid, seq) AS to_nid FROM refs GROUP BY 1, 2 UNION ALL SELECT nid, 'Figure 1', NULL FROM nodes", ("nodes", "refs"))
def jon22_references(spark, d):
    refs = load(spark, d, "refs")
    mentions = refs.select(F.col("from_nid").alias("home_nid"), "label").unionByName(load(spark, d, "nodes").select(F.col("nid").alias("home_nid"), F.lit("Figure 1").alias("label")))
    return L.references_here(mentions, refs)


@query("jon23_narrations", "SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE length(a.text) >= 40 AND length(b.text) BETWEEN 40 AND 400")
def jon23_narrations(spark, d):
    turns = load(spark, d, "conversations")
    after = turns.filter(F.length("text").between(40, 400)).select("conv_id", (F.col("turn") - 1).alias("turn"))
    return turns.filter(F.length("text") >= 40).select("conv_id", "turn").join(after, ["conv_id", "turn"])


@query(
    "jon24_attribution",
    """WITH s AS (SELECT conv_id AS qid, max(turn) AS pos, arg_max(substr(text, 5, 12), turn) AS sentence, min(turn) AS top FROM conversations GROUP BY conv_id)
    SELECT qid, pos, coalesce((SELECT min(turn) FROM conversations c WHERE c.conv_id = qid AND contains(c.text, sentence)), top) AS did FROM s""",
)
def jon24_attribution(spark, d):
    turns = load(spark, d, "conversations")
    sentences = turns.groupBy(F.col("conv_id").alias("qid")).agg(F.max("turn").alias("pos"), F.max_by(F.substring("text", 5, 12), "turn").alias("sentence"))
    return L.attributed(sentences, turns.select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("turn").alias("did"), "text"))


@query("jon25_explanations", "SELECT p_partkey AS rid, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE coalesce((SELECT min(q.p_partkey) FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_size = p.p_size), -1) END AS eid FROM part p")
def jon25_explanations(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.concat(F.lit("f:"), F.col("p_partkey")).alias("formula_id"), F.col("p_size").cast("string").alias("cite"))
    return L.explanations(rows, rows.filter("rid % 2 = 0").select(F.col("rid").alias("eid"), "formula_id", "cite", F.col("rid").alias("seq"))).na.fill(-1, ["eid"])


@query("str52_by_number", "SELECT number, coalesce(arg_min(nid, preorder) FILTER (kind = 'section'), arg_min(nid, preorder)) AS nid FROM nodes GROUP BY number", ("nodes",))
def str52_by_number(spark, d):
    return L.by_number(load(spark, d, "nodes"))


@query("str58_labels", "SELECT cast(p_size AS VARCHAR) AS cite, min(p_partkey) AS id FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_size")
def str58_labels(spark, d):
    latex = F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_type"))
    return L.label_index(load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), latex.alias("latex"), F.concat(F.lit("Equation ("), F.col("p_size"), F.lit(")")).alias("cite")))


# Folds, picks and upserts


@query("agg10_concepts", "SELECT cid, string_agg(alias, '|' ORDER BY s) AS aliases, any_value(n) AS templates FROM (SELECT p_brand AS cid, p_type AS alias, min(p_partkey) AS s FROM part GROUP BY 1, 2) JOIN (SELECT p_brand AS cid, count(*) AS n FROM part GROUP BY 1) USING (cid) GROUP BY cid")
def agg10_concepts(spark, d):
    rows = load(spark, d, "part").select(F.col("p_brand").alias("cid"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("alias"), F.col("p_name").alias("template"))
    return L.concept_index(rows).select("cid", F.array_join("aliases", "|").alias("aliases"), F.size("templates").cast("bigint").alias("templates"))


@query("agg25_dominant", "SELECT grp, relation, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN relation = 'uses' THEN 0 ELSE 1 END, n DESC, relation) AS rn FROM (SELECT src AS grp, type AS relation, count(*) AS n FROM edges_log GROUP BY 1, 2)) WHERE rn = 1", ("edges_log",))
def agg25_dominant(spark, d):
    return L.dominant_relation(load(spark, d, "edges_log").select(F.col("src").alias("grp"), F.col("type").alias("relation")), ["uses"])


@query("agg29_state", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'theorem') AS theorems, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM formulas) AS formulas, (SELECT count(*) FROM graph_passages) AS passages", ("nodes", "refs", "formulas", "graph_passages"))
def agg29_state(spark, d):
    counts = [("nodes", load(spark, d, "nodes")), ("theorems", load(spark, d, "nodes").filter("kind = 'theorem'")), ("refs", load(spark, d, "refs")), ("formulas", load(spark, d, "formulas")), ("passages", load(spark, d, "graph_passages"))]
    rows = None
    for name, rows_of in counts:
        one = rows_of.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("metric") == name, F.col("n"))).alias(name) for name, _ in counts])


@query("agg30_topics", "SELECT user_id, event_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(topic) ORDER BY event_id) AS rn FROM (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS topic FROM events)) WHERE rn = 1")
def agg30_topics(spark, d):
    rows = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("topic"))
    return L.distinct_topics(rows, ["user_id"], "event_id", "topic")


@query("agg31_outcomes", "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS runs FROM events GROUP BY 1")
def agg31_outcomes(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("runs"))


@query(
    "win08_canonical",
    """WITH f AS (SELECT p_size AS home_nid, CASE WHEN p_partkey % 4 = 0 THEN 'n_offline_' ELSE 'f:' END || p_partkey AS id, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'c' || p_partkey % 20 END AS cite, p_type AS latex FROM part),
    once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY home_nid, cite, latex ORDER BY NOT starts_with(id, 'n_offline_'), length(latex) DESC, seq) = 1)
    SELECT home_nid, id FROM (SELECT * FROM once WHERE cite <> '' QUALIFY row_number() OVER (PARTITION BY home_nid, cite ORDER BY NOT starts_with(id, 'n_offline_'), length(latex) DESC, seq) = 1)
    UNION ALL SELECT home_nid, id FROM (SELECT * FROM once WHERE cite = '' QUALIFY row_number() OVER (PARTITION BY home_nid ORDER BY seq) <= 3)""",
)
def win08_canonical(spark, d):
    rows = load(spark, d, "part").select(
        F.col("p_size").alias("home_nid"),
        F.concat(F.when(F.col("p_partkey") % 4 == 0, "n_offline_").otherwise("f:"), F.col("p_partkey")).alias("id"),
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("p_partkey") % 20)).alias("cite"),
        F.col("p_type").alias("latex"),
    )
    return L.canonical_formulas(rows)


@query("win13_recent_other", "SELECT event_id, (SELECT arg_max(p.event_type, p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type <> e.event_type) AS other FROM events e")
def win13_recent_other(spark, d):
    return L.recent_other(load(spark, d, "events"), ["user_id"], "event_id", "event_type").select("event_id", "other")


@query("win14_inherited", "SELECT n.nid, arg_max(v.title, length(v.nid)) AS value FROM nodes n LEFT JOIN (SELECT * FROM nodes WHERE kind = 'chapter' OR (kind = 'section' AND regexp_matches(number, '[02468]$'))) v ON n.nid = v.nid OR starts_with(n.nid, v.nid || '/') GROUP BY n.nid", ("nodes",))
def win14_inherited(spark, d):
    nodes = load(spark, d, "nodes")
    return L.inherited(nodes, nodes.filter("kind = 'chapter' OR (kind = 'section' AND number RLIKE '[02468]$')").select("nid", F.col("title").alias("value")))


@query("top02_threshold", with_views("SELECT 1", "passages", "questions").removesuffix("SELECT 1").rstrip() + f", {BM25} SELECT qid, did, round(bm25, 6) AS bm25, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, did) - 1 AS INTEGER) AS rank FROM bm) WHERE rank < 5 AND round(bm25, 6) >= 8.0")
def top02_threshold(spark, d):
    return R.ranked(bm25_scores(spark, d).withColumn("bm25", r6(F.col("bm25"))), "bm25", ["did"], 5).filter("bm25 >= 8.0")


TOPICS = {"en": r"\bthe\b", "fr": r"\bles\b", "de": r"\bder\b", "es": r"\blos\b"}


@query("top06_unique_topic", r"SELECT doc_id, CASE WHEN cast(a AS INT) + cast(b AS INT) + cast(c AS INT) + cast(e AS INT) = 1 THEN CASE WHEN a THEN 'en' WHEN b THEN 'fr' WHEN c THEN 'de' ELSE 'es' END END AS topic FROM (SELECT doc_id, contains(w, ' the ') AS a, contains(w, ' les ') AS b, contains(w, ' der ') AS c, contains(w, ' los ') AS e FROM (SELECT doc_id, ' ' || coalesce(text, '') || ' ' AS w FROM documents))")
def top06_unique_topic(spark, d):
    padded = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" "))
    return L.unique_topic(load(spark, d, "documents"), padded, {"en": " the ", "fr": " les ", "de": " der ", "es": " los "}).select("doc_id", "topic")


@query("top07_loose_topic", "SELECT doc_id, CASE WHEN contains(source, '1') THEN 'one' WHEN contains(source, '2') THEN 'two' WHEN len(regexp_extract_all(h, '1')) >= 2 THEN 'one' WHEN len(regexp_extract_all(h, '2')) >= 2 THEN 'two' END AS topic FROM (SELECT doc_id, source, lower(substr(coalesce(text, ''), 1, 1500)) AS h FROM documents)")
def top07_loose_topic(spark, d):
    return L.loose_topic(load(spark, d, "documents"), F.col("source"), F.col("text"), {"one": "1", "two": "2"}).select("doc_id", "topic")


@query("top08_chapter_order", "SELECT nid, cast(number AS INTEGER) AS place FROM nodes WHERE kind = 'chapter' UNION ALL SELECT nid, 10000 FROM nodes WHERE kind = 'section'", ("nodes",))
def top08_chapter_order(spark, d):
    whole = F.when(F.col("number").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("number").cast("int"))
    return load(spark, d, "nodes").filter("kind <> 'theorem'").select("nid", F.coalesce(whole, F.lit(10000)).alias("place"))


@query("set03_missing", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS missing FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id")
def set03_missing(spark, d):
    rows = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("needs"))
    missing = F.array_join(F.array_sort(F.array_except("needs", F.array(F.lit("click"), F.lit("view")))), ",")
    return rows.select("user_id", missing.alias("missing")).filter("missing <> ''")


@query("set06_edge_spans", "SELECT src || '>' || dst AS id, string_agg(DISTINCT meta, ',' ORDER BY meta) AS spans FROM edges_log GROUP BY 1", ("edges_log",))
def set06_edge_spans(spark, d):
    return L.edge_spans(load(spark, d, "edges_log").select(F.concat("src", F.lit(">"), "dst").alias("id"), F.col("meta").alias("span"))).withColumn("spans", F.array_join("spans", ","))


@query("set07_node_params", "SELECT nid, string_agg(key || '=' || value, ',' ORDER BY key) AS params FROM (SELECT 'u' || user_id AS nid, event_type AS key, arg_max(cast(event_id AS VARCHAR), event_id) AS value FROM events GROUP BY 1, 2) GROUP BY nid")
def set07_node_params(spark, d):
    rows = load(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("nid"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    params = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return L.node_params(rows).select("nid", params.alias("params"))


@query("set08_edges_once", "SELECT DISTINCT src, dst, type FROM edges_log", ("edges_log",))
def set08_edges_once(spark, d):
    return load(spark, d, "edges_log").select("src", "dst", "type").distinct()


# Graphs and layout


@query("grf14_formula_edges")
def grf14_formula_edges(spark, d):
    """Formulas made of the parts' names; roles need a scanner, so tests hold it against one."""
    latex = F.concat(F.lit("f_{"), F.col("p_size"), F.lit(r"}(x) = \sum_{i=1}^n x_i + \beta "), F.substring("p_brand", 7, 1))
    return L.formula_edges(load(spark, d, "part").select(F.col("p_partkey").alias("id"), latex.alias("latex"), F.array(F.concat(F.lit("Equation "), F.col("p_size"))).alias("cite_labels")))


@query("grf20_lifted", "SELECT DISTINCT src, dst FROM (SELECT array_to_string(list_slice(string_split(from_nid, '/'), 1, 2), '/') AS src, array_to_string(list_slice(string_split(to_nid, '/'), 1, 2), '/') AS dst FROM refs) WHERE src <> dst", ("refs",))
def grf20_lifted(spark, d):
    return L.lifted_edges(load(spark, d, "refs"))


@query("grf21_parents", "SELECT child, arg_min(parent, seq) AS parent FROM (SELECT CASE WHEN type = 'uses' THEN dst ELSE src END AS child, CASE WHEN type = 'uses' THEN src ELSE dst END AS parent, seq FROM edges_log WHERE type <> 'about') GROUP BY child", ("edges_log",))
def grf21_parents(spark, d):
    relation = F.when(F.col("type") == "uses", "contains").when(F.col("type") == "references", "part_of").otherwise("other")
    return L.container_parents(load(spark, d, "edges_log").select("src", "dst", relation.alias("relation"), "seq"))


GROUPS = "(SELECT scene, nid % 10 AS nid, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1, 2)"


@query("grf23_violations", f"SELECT a.scene, a.nid AS a, b.nid AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy FROM {GROUPS} a JOIN {GROUPS} b ON a.scene = b.scene AND a.nid < b.nid WHERE ox > -12 AND oy > -12", ("boxes",))
def grf23_violations(spark, d):
    boxes = load(spark, d, "boxes")
    groups = P.group_boxes(boxes, boxes.select("scene", "nid", (F.col("nid") % 10).alias("parent"), F.col("nid").alias("seq"))).withColumnRenamed("parent", "nid")
    return P.violations(groups, 12.0, 500.0)


@query("grf24_scene", "SELECT n.nid, regexp_extract(n.nid, '^(.*)/[^/]+$', 1) AS parent_nid FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes s WHERE s.kind = 'section' AND regexp_matches(s.number, '[13579]$') AND (n.nid = s.nid OR starts_with(n.nid, s.nid || '/')))", ("nodes",))
def grf24_scene(spark, d):
    nodes = load(spark, d, "nodes").withColumn("kind", F.when((F.col("kind") == "section") & F.col("number").rlike("[13579]$"), "index").otherwise(F.col("kind")))
    return L.visible(nodes, ["bibliography", "index", "glossary"]).select("nid", "parent_nid")


# Retrieval


@query(
    "ret04_hybrid",
    with_views("SELECT 1", "passages", "questions").removesuffix("SELECT 1").rstrip() + f""", {BM25},
  a AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, did) - 1 AS rank FROM bm),
  dn AS (SELECT qid, e.vec_id AS did, round(list_dot_product(list_transform(e.embedding, lambda x: cast(x AS DOUBLE)), list_transform(v.embedding, lambda x: cast(x AS DOUBLE))), 6) AS dense FROM questions JOIN embeddings v ON v.vec_id = qid, embeddings e),
  b AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, did) - 1 AS rank FROM dn WHERE dense > 0)
  SELECT qid, did, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM a WHERE rank < 50 UNION ALL SELECT * FROM b WHERE rank < 50) GROUP BY qid, did""",
)
def ret04_hybrid(spark, d):
    return hybrid(spark, d).withColumn("rrf", r6(F.col("rrf")))


def hybrid(spark, d):
    """BM25 and dense scores fused by rank; a question's vector is the embedding with its id."""
    vectors = load(spark, d, "embeddings")
    asked = vectors.join(load(spark, d, "questions").select(F.col("qid").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    dense = R.dense(vectors.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec")), asked)
    lists = [R.ranked(x.withColumn(c, r6(F.col(c))), c, ["did"], 50) for x, c in ((bm25_scores(spark, d), "bm25"), (dense, "dense"))]
    return R.fused(lists)


@query("ret06_answer_plan")
def ret06_answer_plan(spark, d):
    """Each question's sentences in order, with the passage they come from and whether all passages are weak; its parts have SQL of their own (ret04, jon24)."""
    docs, questions = load(spark, d, "passages"), load(spark, d, "questions")
    return R.answer_plan(settle(hybrid(spark, d)), bm25_scores(spark, d), docs.select(F.col("nid").alias("did"), "body_text"), questions)


@query("ret09_vector_stats", "SELECT count(*) AS n, count(DISTINCT len(embedding)) AS dims, max(len(embedding)) AS dim, count(*) FILTER (list_dot_product(embedding, embedding) = 0) AS empty FROM embeddings")
def ret09_vector_stats(spark, d):
    rows = load(spark, d, "embeddings").select(F.size("embedding").alias("k"), F.forall("embedding", lambda x: x == 0).alias("zero"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("dims"), F.max("k").cast("bigint").alias("dim"), F.count_if("zero").alias("empty"))


# Sessions


@query("stm04_focus", "SELECT user_id, count(*) AS turns, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS focus FROM events GROUP BY user_id")
def stm04_focus(spark, d):
    return boards.focus(load(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")))


@query("stm07_chunks", "SELECT conv_id, turn, k AS chunk, CASE WHEN k = (length(text) + 99) // 100 THEN 'complete' ELSE 'chunk' END AS kind FROM conversations, generate_series(0, 5000) g(k) WHERE k <= (length(text) + 99) // 100")
def stm07_chunks(spark, d):
    return boards.chunked(load(spark, d, "conversations"), ["conv_id", "turn"], F.col("text"), 100).select("conv_id", "turn", "chunk", "kind")


@query("stm15_index", "SELECT lower(event_type) AS key, string_agg(DISTINCT 'n' || user_id, ',' ORDER BY 'n' || user_id) AS nids FROM events GROUP BY 1")
def stm15_index(spark, d):
    rows = load(spark, d, "events").select(F.concat(F.lit("n"), F.col("user_id")).alias("nid"), F.array("event_type", F.lit(" ")).alias("keys"))
    return L.inverted(rows).withColumn("nids", F.array_join("nids", ","))


@query("stm16_first_references", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stm16_first_references(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("stm18_progress", "SELECT user_id AS job, arg_max(event_type, event_id) AS phase, count(DISTINCT event_type) AS phases FROM events GROUP BY 1")
def stm18_progress(spark, d):
    return load(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("phase"), F.count_distinct("event_type").alias("phases"))


@query("stm11_board")
def stm11_board(spark, d):
    """What stays on each user's board of eight shapes; tests hold the closed form against a step-by-step board."""
    return boards.on_board(load(spark, d, "events"), "user_id", "event_id", 8).select("user_id", "event_id", "fading")


# Quality and hooks


@query("dq01_inputs", """SELECT 'documents' AS "table", 'pass' AS status WHERE (SELECT count(*) FROM documents) > 0 UNION ALL SELECT 'labels', 'pass' WHERE (SELECT count(*) FROM labels) > 0 UNION ALL SELECT 'missing', 'fail'""")
def dq01_inputs(spark, d):
    rows = [load(spark, d, n).limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), F.when(F.col("n") > 0, "pass").otherwise("fail").alias("status")) for n in ("documents", "labels")]
    return rows[0].unionByName(rows[1]).unionByName(spark.sql("SELECT 'missing' AS `table`, 'fail' AS status"))


@query("udf01_backend", "SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'user'")
def udf01_backend(spark, d):
    """A synthesis backend that declines, so the default (the passage itself) answers."""
    with hooks.installed("synthesis", lambda rows: None):
        rows = load(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
        return hooks.call("synthesis", rows, lambda x: x.select("conv_id", "turn", F.col("text").alias("answer")))

