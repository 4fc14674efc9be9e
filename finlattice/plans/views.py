"""Text views over the star-schema tables, in SQL that Spark and DuckDB both read.

ASCII only; numbers are rendered from whole BIGINT values so that both engines print the same.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import told_apart
from ..session import table

VIEWS = {
    "questions": """SELECT o_orderkey AS question_id, c_mktsegment AS collection,
        CASE o_orderkey % 9
            WHEN 0 THEN concat('Show revenue by segment for ', c_mktsegment)
            WHEN 1 THEN concat('Compare the order ratio of ', c_name, ' vs the market')
            WHEN 2 THEN concat('Revenue growth trend over time for ', c_name)
            WHEN 3 THEN concat('Who are the suppliers and partners of ', c_name, '?')
            WHEN 4 THEN concat('Who is the CEO of ', c_name, '?')
            WHEN 5 THEN concat('Explain the overview of order ', CAST(o_orderkey AS STRING))
            WHEN 6 THEN concat('Plain words about ', c_name)
            WHEN 7 THEN 'growth of acquisition'
            ELSE concat('What is the quarter breakdown by product for US$5 table ', c_name) END AS text,
        CASE o_orderkey % 9 WHEN 0 THEN 'numerical_table' WHEN 1 THEN 'comparison' WHEN 2 THEN 'trend' WHEN 3 THEN 'relationship'
            WHEN 4 THEN 'entity' WHEN 7 THEN 'relationship' WHEN 8 THEN 'numerical_table' ELSE 'general_knowledge' END AS expected_intent
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "facts": """SELECT o_orderkey AS answer_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey % 5 AS v FROM orders""",
    "contexts": """SELECT answer_id, 0 AS ctx_pos, concat('Order total was $', CAST(k AS STRING), 'K for fiscal year ', CAST(y AS STRING), '.') AS text FROM facts
        UNION ALL SELECT answer_id, 1, 'As a public company, the customer files reports with the SEC.' FROM facts
        UNION ALL SELECT answer_id, 2, concat('The revenue ', CAST(k AS STRING), ' and cogs ', CAST(k - v * 10 AS STRING), ' were booked.') FROM facts WHERE v <> 3""",
    "answers": """SELECT answer_id, concat('Order total was $',
            CAST(CASE v WHEN 0 THEN k WHEN 1 THEN CAST(floor(k * 103 / 100) AS BIGINT) WHEN 2 THEN k * 2 ELSE k END AS STRING), 'K. The order was placed in fiscal year ',
            CAST(CASE WHEN v = 4 THEN y + 1 ELSE y END AS STRING), '. ',
            CASE v WHEN 0 THEN 'Order value increased 5% since then.' WHEN 1 THEN 'Order value grew again lately.' WHEN 2 THEN 'Order value declined again lately.' ELSE 'Short.' END,
            ' the customer files reports with the SEC. Gross margin equals 0.', CAST(v AS STRING), ' overall. The buyer is pleasant.') AS text FROM facts""",
    "md_tables": """SELECT r_regionkey AS doc_id, concat('| Nation | Key |', chr(10), '| --- | --- |', chr(10), rows_text) AS markdown FROM (
            SELECT n_regionkey, {join} AS rows_text FROM nation GROUP BY n_regionkey) n JOIN region ON n_regionkey = r_regionkey""",
    "md_docs": """SELECT doc_id, concat('Prose about the region.', chr(10), markdown, chr(10), chr(10), 'More prose here.', chr(10), '| a | b |', chr(10), 'End | of', chr(10), 'text.') AS text FROM md_tables
        UNION ALL SELECT doc_id + 100, concat(chr(10), 'Intro', chr(10), markdown) FROM md_tables
        UNION ALL SELECT doc_id + 200, concat('One | pipe', chr(10), 'x | y') FROM md_tables""",
    "points": """SELECT 'main' AS collection, CAST(vec_id AS BIGINT) AS point_id, 0 AS ingest_seq, embedding AS dense, label FROM embeddings
        UNION ALL SELECT 'main', CAST(vec_id AS BIGINT) - 100, 1, embedding, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 200""",
    "vector_queries": "SELECT CAST(vec_id AS BIGINT) AS question_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0",
    "ticker_questions": "SELECT q.question_id, q.embedding, q.label, b.text FROM vector_queries q CROSS JOIN (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON b.item_id = CAST(floor(q.question_id / 50) AS BIGINT) % c.n",
    "ticker_documents": "SELECT CAST(doc_id AS BIGINT) AS doc_id, text, CAST(doc_id % 10 AS INT) AS label FROM documents",
    "table_contexts": """SELECT l_orderkey AS question_id, l_linenumber AS ctx_pos, CASE WHEN l_quantity > 10 THEN concat('| part | quantity |', chr(10), '| --- | --- |', chr(10), '| part ', CAST(l_partkey AS STRING), ' | ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' |') END AS text FROM lineitem""",
    "graph_contexts": """SELECT l_orderkey AS question_id, l_linenumber AS ctx_pos, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('supplier ', CAST(s_suppkey AS STRING), ' located in ', n_name) END AS text
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "graph_questions": """SELECT CAST(s_suppkey AS BIGINT) AS question_id, CASE s_suppkey % 3 WHEN 0 THEN concat('Where is Supplier ', CAST(s_suppkey AS STRING), ' located?') WHEN 1 THEN concat('What of ', n_name, ', then?') ELSE 'Nobody named here' END AS text
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "told_answers": """SELECT answer_id, text, CASE v WHEN 0 THEN concat('Here: [{"claim": "Total was $', CAST(k AS STRING), 'K.", "type": "Numerical"}, {"claim": "In fiscal year ', CAST(y AS STRING), '.", "type": "temporal"}] done')
            WHEN 1 THEN concat('[{"claim": "Total was $', CAST(k AS STRING), 'K.", "type": "guess"}]') WHEN 2 THEN 'no list' WHEN 3 THEN '[{"claim": broken' END AS response FROM answers JOIN facts USING (answer_id)""",
    "told_texts": """SELECT answer_id, CASE v WHEN 0 THEN concat('The total was $', CAST(k AS STRING), 'K. Confidence: 0.9') WHEN 4 THEN 'No number here' WHEN 1 THEN 'Confidence: 7' END AS response FROM facts""",
    "cases": """SELECT answer_id, CASE WHEN v < 3 THEN 6 END AS expected_claims, CASE v WHEN 0 THEN 3 WHEN 1 THEN 2 END AS expected_verified, CASE WHEN v = 2 THEN 4 END AS expected_unverified FROM facts""",
    "odd_docs": """SELECT doc_id, concat('Intro text.', chr(10), '| Nation [merged] | Key |', chr(10), '| --- | --- |', chr(10), '| a | 1 |', chr(10), 'Between.', chr(10), '| Top |  |', chr(10), '| Left | Right |', chr(10), '| 1 | 2 |', chr(10), '| 3 | 4 |', chr(10),
            repeat('Far down the text. ', CAST(170 * (doc_id + 1) AS INT)), chr(10), markdown, chr(10), 'End.') AS text FROM md_tables""",
    "text_queries": "SELECT CAST(item_id AS BIGINT) AS question_id, text FROM benchmark",
    "graph_edges": """SELECT concat('supplier ', CAST(s_suppkey AS STRING)) AS src, 'Supplier' AS src_type, n_name AS dst, 'Nation' AS dst_type, 'LOCATED_IN' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'Nation', r_name, 'Region', 'PART_OF' FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT DISTINCT concat('supplier ', CAST(l_suppkey AS STRING)), 'Supplier', concat('part ', CAST(l_partkey AS STRING)), 'Part', 'SUPPLIES' FROM lineitem""",
    "feedback": """SELECT event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'entity' WHEN 'view' THEN 'trend' WHEN 'purchase' THEN 'numerical_table' ELSE
            CASE WHEN user_id % 2 = 0 THEN 'comparison' ELSE 'relationship' END END AS intent, value > 20 AS was_helpful FROM events""",
    "graph_json": """SELECT s_suppkey AS doc_id, CASE s_suppkey % 4
            WHEN 0 THEN concat('{"nodes":[{"id":"S', CAST(s_suppkey AS STRING), '","type":"Supplier"},{"id":"', n_name, '","label":"Nation"}],"relationships":[{"source":"S', CAST(s_suppkey AS STRING), '","target":"', n_name, '","type":"LOCATED_IN"}]}')
            WHEN 1 THEN concat('```json', chr(10), '{"entities":[{"name":"S', CAST(s_suppkey AS STRING), '"},{"id":"', n_name, '","type":"Nation"}],"edges":[{"source":"S', CAST(s_suppkey AS STRING), '","target":"nowhere"}]}', chr(10), '```')
            WHEN 2 THEN concat('{"nodes":[{"name":"A","label":"T"}],"edges":[{"source_node_id":"A","target_node_id":"', n_name, '","label":"SELLS"}]}')
            ELSE 'no json' END AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "broken_graphs": """SELECT s_suppkey AS doc_id, CASE s_suppkey % 7
            WHEN 0 THEN concat('Sure, here it is: {"nodes":[{"id":"S', CAST(s_suppkey AS STRING), '","type":"Supplier"} {"id":"', n_name, '","label":"Nation"}], "relationships":[{"source":"S', CAST(s_suppkey AS STRING), '","target":"', n_name, '","type":"LOCATED_IN"}')
            WHEN 1 THEN concat('```json', chr(10), '{nodes: [{id: S', CAST(s_suppkey AS STRING), ', type: Supplier,}, {"id": "', n_name, '", "type": "Nation"},], "edges": [{"source": "S', CAST(s_suppkey AS STRING), '", "target": "', n_name, '"},],}', chr(10), '```')
            WHEN 2 THEN concat('{"entities":[{"name":"S', CAST(s_suppkey AS STRING), '"}, {"id":"', n_name, '","type":"Nation"}, "edges":[{"source":"S', CAST(s_suppkey AS STRING), '","target":"', n_name, '","type":"LOCATED_IN"}]} Let me know!')
            WHEN 3 THEN concat('{"nodes":[{"id":"S', CAST(s_suppkey AS STRING), ', "type":"Supplier"}], "edges":[]}')
            WHEN 4 THEN concat('{"nodes":[{"id":"S', CAST(s_suppkey AS STRING), '","type":"Supplier')
            WHEN 5 THEN 'nothing [of use'
            ELSE concat('{"nodes":[{"id":"S', CAST(s_suppkey AS STRING), '","type":"Supplier"}]}') END AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "order_rows": """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CAST(o_orderkey AS STRING) AS k, o_orderpriority AS p, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS t FROM orders""",
    "page_words": """SELECT doc_id, 1 AS page, 50.0 AS x0, 100.0 + 14 * r AS top, 50.0 + 6 * length(k) AS x1, 110.0 + 14 * r AS bottom, k AS text FROM order_rows
        UNION ALL SELECT doc_id, 1, 200.0 + r % 3, 101.0 + 14 * r, 205.0, 109.0 + 14 * r, substr(p, 1, 1) FROM order_rows
        UNION ALL SELECT doc_id, 1, 209.0, 100.0 + 14 * r, 260.0, 110.0 + 14 * r, substr(p, 3) FROM order_rows
        UNION ALL SELECT doc_id, 1, 400.0 - 6 * length(t), 99.0 + 14 * r, 400.0, 110.0 + 14 * r, t FROM order_rows WHERE r % 5 <> 0
        UNION ALL SELECT doc_id, 1, x, 100.0, x + 40, 110.0, w FROM order_rows CROSS JOIN (VALUES (50.0, 'Order'), (200.0, 'Priority'), (360.0, 'Total')) v(x, w) WHERE r = 1
        UNION ALL SELECT doc_id, 1, x, 50.0, x + 95, 60.0, w FROM order_rows CROSS JOIN (VALUES (50.0, 'Orders'), (150.0, 'of'), (250.0, 'one'), (350.0, 'customer')) v(x, w) WHERE r = 1
        UNION ALL SELECT doc_id, 2, 50.0, 50.0 + 14 * r, 70.0, 60.0 + 14 * r, 'Prose' FROM order_rows""",
    "responses": """SELECT doc_id, 1 AS page, concat('```markdown', chr(10), markdown, chr(10), '```', chr(10), '---TABLE BREAK---', chr(10), 'NO TABLES FOUND', chr(10), '---TABLE BREAK---', chr(10), '| x |', chr(10), '---TABLE BREAK---', chr(10), 'nothing') AS response FROM md_tables""",
    "statements": """SELECT answer_id AS doc_id, concat('Confidence: 0.', CAST(v AS STRING), ' for ', CAST(k AS STRING), ' percent [', CAST(k AS STRING), ', ', CAST(y AS STRING), '] in Q', CAST(v + 1 AS STRING), ' ', CAST(y AS STRING), ' or $', CAST(k AS STRING), ',500.5M and ', CAST(v AS STRING), '.5%') AS text FROM facts""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_JOIN = {
    "spark": "array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), r -> concat('| ', r.n_name, ' | ', CAST(r.n_nationkey AS STRING), ' |')), chr(10))",
    "duckdb": "string_agg(concat('| ', n_name, ' | ', CAST(n_nationkey AS STRING), ' |'), chr(10) ORDER BY n_nationkey)",
}
#: Keys that Spark tells apart before a view writes them out as text, one text for each key, in place of the view's DISTINCT.
_APART = {"graph_edges": ("lineitem", ("l_suppkey", "l_partkey"))}


def uses(sql: str) -> list[str]:
    return [name for name in (*VIEWS, *BASE) if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I)]


def needed(names: list[str]) -> list[str]:
    """The views behind some names, each after those it uses."""
    out: list[str] = []
    for name in names:
        if name in VIEWS:
            for x in [*needed([u for u in uses(VIEWS[name]) if u in VIEWS and u != name]), name]:
                if x not in out:
                    out.append(x)
    return out


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it uses as common table expressions."""
    names = needed([n for n in uses(sql) if n in VIEWS])
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('{join}', _JOIN['duckdb'])})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[len('WITH'):]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name].replace("{join}", _JOIN["spark"])
    inputs = {n: view(spark, sf_dir, n) for n in uses(sql) if n != name}
    if name in _APART:
        source, keys = _APART[name]
        sql = sql.replace("SELECT DISTINCT", "SELECT")
        inputs[source] = told_apart(inputs[source].select(*keys))
    for n in inputs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql, flags=re.I)
    return spark.sql(_escaped(sql, inputs), **inputs)


def _escaped(sql: str, inputs: dict) -> str:
    """Braces in literals doubled, for the formatter that fills in the tables."""
    marks = {f"{{{n}}}": f"\0{n}\1" for n in inputs}
    for k, v in marks.items():
        sql = sql.replace(k, v)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for k, v in marks.items():
        sql = sql.replace(v, k)
    return sql
