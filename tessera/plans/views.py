"""The driver's tables seen as a corpus: a document tree, citations, passages, graph edges, boxes and logs.

Each view is SQL that Spark and DuckDB both run; {name} stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # chapters are regions, sections nations, theorems suppliers
    "nodes": """
        SELECT 'b/ch' || (r_regionkey + 1) AS nid, 'chapter' AS kind, '' || (r_regionkey + 1) AS number, r_name AS title, r_name AS body_text,
          r_regionkey * 100 + 1 AS page_start, r_regionkey * 100 + 100 AS page_end, cast(r_regionkey AS bigint) * 1000000000 AS preorder FROM {region}
        UNION ALL
        SELECT 'b/ch' || (n_regionkey + 1) || '/s' || n_nationkey, 'section', (n_regionkey + 1) || '.' || n_nationkey, n_name, n_name,
          n_regionkey * 100 + n_nationkey * 4 + 1, n_regionkey * 100 + n_nationkey * 4 + 3, cast(n_regionkey AS bigint) * 1000000000 + (n_nationkey + 1) * 10000000 FROM {nation}
        UNION ALL
        SELECT 'b/ch' || (n_regionkey + 1) || '/s' || n_nationkey || '/thm' || s_suppkey, 'theorem', (n_regionkey + 1) || '.' || n_nationkey || '.' || s_suppkey, s_name, s_name,
          n_regionkey * 100 + n_nationkey * 4 + 2, n_regionkey * 100 + n_nationkey * 4 + 2, cast(n_regionkey AS bigint) * 1000000000 + (n_nationkey + 1) * 10000000 + s_suppkey + 1 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
    """,
    # each order line cites, from its customer's section, its supplier's theorem (odd lines) or section
    "refs": """
        SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, 'b/ch' || (cn.n_regionkey + 1) || '/s' || cn.n_nationkey AS from_nid,
          CASE WHEN l_linenumber % 2 = 1 THEN 'b/ch' || (sn.n_regionkey + 1) || '/s' || sn.n_nationkey || '/thm' || s_suppkey ELSE 'b/ch' || (sn.n_regionkey + 1) || '/s' || sn.n_nationkey END AS to_nid,
          CASE WHEN l_linenumber % 2 = 1 THEN 'Theorem ' || (sn.n_regionkey + 1) || '.' || sn.n_nationkey || '.' || s_suppkey ELSE 'Section ' || (sn.n_regionkey + 1) || '.' || sn.n_nationkey END AS label,
          cast(l_quantity AS int) AS char_offset
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey
          JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey
    """,
    "passages": "SELECT doc_id AS nid, text AS body_text, substr(text, 1, 60) AS title FROM {documents}",
    "questions": "SELECT item_id AS qid, text AS query FROM {benchmark}",
    "edges_log": """
        SELECT 'f:' || l_suppkey AS src, CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'about' ELSE 'references' END AS type, 'p:' || l_partkey AS dst,
          l_quantity AS weight, l_linestatus AS meta, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + cast(l_quantity AS bigint) AS seq FROM {lineitem}
    """,
    "graph_passages": "SELECT 'p:' || p_partkey AS id, 'b/ch' || (p_size % 7) || '/x' AS home_nid FROM {part}",
    "formulas": "SELECT 'f:' || s_suppkey AS id, s_suppkey AS seq FROM {supplier}",
    "ops": "SELECT cast(event_id AS double) AS t, event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' ELSE 'add' END AS kind, 'n' || user_id AS nid, event_type AS payload FROM {events}",
    "boxes": """
        SELECT p_size AS scene, p_partkey AS nid, cast(p_partkey * 7919 % 1000 AS double) AS x, cast(p_partkey * 104729 % 1000 AS double) AS y,
          cast(5 + p_partkey % 37 AS double) AS w, cast(5 + p_partkey % 23 AS double) AS h FROM {part}
    """,
}


def sql_of(name: str) -> str:
    """The view's SQL for DuckDB, with the views it uses put in."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({sql_of(m[1])})" if m[1] in VIEWS else m[1], VIEWS[name])


def with_views(query: str, *names: str) -> str:
    """A DuckDB query with the named views as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({sql_of(n)})" for n in names) + " " + query


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{u: load(spark, sf_dir, u) for u in used})
