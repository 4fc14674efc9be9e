"""DuckDB SQL for the queries, written apart from the Spark plans; only fixed values and the text views are shared."""

from __future__ import annotations

from ..functions import text as T
from ..operators import claims as C
from ..operators import routing as R
from ..operators import tables as B
from .views import with_views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


# ---- routing

_hits = {name: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}) THEN {q(R.display(p))} END" for p in patterns) + "], lambda k: k IS NOT NULL)" for name, (_, _, patterns) in R.INTENTS.items()}
_union = " UNION ALL ".join(
    f"SELECT question_id, {i} AS ord, '{name}' AS intent, '{strategy}' AS strategy, {_hits[name]} AS kws, {len(patterns)}::DOUBLE AS n, {weight}::DOUBLE AS w, {q(R.REASONS[name])} AS reason FROM questions"
    for i, (name, (weight, strategy, patterns)) in enumerate(R.INTENTS.items())
)
_ROUTED = f"""scored AS (SELECT *, len(kws)::DOUBLE / n * w AS score FROM ({_union})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ord) AS r, sum(score) OVER (PARTITION BY question_id) AS total FROM scored WHERE len(kws) > 0),
    routed AS (SELECT qs.question_id, qs.expected_intent, coalesce(b.intent, 'general_knowledge') AS intent, coalesce(b.strategy, 'simple_rag') AS strategy,
        coalesce(round_even(CASE WHEN b.score IS NULL THEN NULL WHEN b.score > 0.3::DOUBLE THEN least(1, least(1, b.score / b.total) + 0.2::DOUBLE) ELSE least(1, b.score / b.total) END, 2), 0.5)::DOUBLE AS confidence,
        coalesce(replace(b.reason, '{{keywords}}', array_to_string(b.kws[1:3], ', ')), {q(R.NO_MATCH)}) AS reasoning, coalesce(array_to_string(b.kws, '|'), '') AS keywords
        FROM questions qs LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b USING (question_id))""".replace("{{", "{").replace("}}", "}")
_PAIRS = "WITH " + _ROUTED + ", pairs AS (SELECT expected_intent AS e, intent AS p FROM routed)"
_CLASS = _PAIRS + """, labels AS (SELECT unnest(['numerical_table','trend','comparison','relationship','entity','general_knowledge']) AS label),
    counts AS (SELECT label, count(*) FILTER (e = label AND p = label) AS tp, count(*) FILTER (e <> label AND p = label) AS fp, count(*) FILTER (e = label AND p <> label) AS fn FROM labels, pairs GROUP BY label),
    pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pp, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS rr FROM counts),
    f AS (SELECT *, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END AS ff FROM pr)"""

# ---- claims


def _numbers(column: str) -> str:
    pairs = f"list_zip(regexp_extract_all({column}, {q(T.NUMBER)}, 1), regexp_extract_all({column}, {q(T.NUMBER)}, 2))"
    factor = "CASE upper(coalesce(z[2], '')) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1.0::DOUBLE END"
    return f"list_filter(list_transform({pairs}, lambda z: TRY_CAST(replace(z[1], ',', '') AS DOUBLE) * {factor}), lambda x: x IS NOT NULL)"


def _extract(column: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({column}, {q(pattern)}, {group}), '')"


_PERCENT = f"coalesce(TRY_CAST({_extract('text', T.PERCENT_SIGN, 1)} AS DOUBLE), TRY_CAST({_extract('text', T.PERCENT_WORD, 1)} AS DOUBLE)) / 100"
_DATE = f"coalesce({_extract('text', T.YEAR, 0)}, {_extract('text', T.QUARTER, 0)}, 'FY' || {_extract('text', T.FISCAL, 1)})"
_SPLIT = r"string_split(regexp_replace(trim(text, chr(10) || chr(9) || chr(13) || ' '), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"
_TYPE = f"""CASE WHEN {_any('lower(text)', C.T.COMPUTATIONAL)} THEN 'computational' WHEN {_any('lower(text)', T.COMPARATIVE)} THEN 'comparative' WHEN {_any('lower(text)', T.REGULATORY)} THEN 'regulatory'
    WHEN regexp_matches(lower(text), {q(T.TEMPORAL)}) THEN 'temporal' WHEN regexp_matches(lower(text), '\\d') THEN 'numerical' ELSE 'entity' END"""
_CLAIMS = f"""sent AS (SELECT answer_id, list_filter({_SPLIT}, lambda s: length(trim(s)) >= 10) AS parts FROM answers),
    cl AS (SELECT answer_id, i - 1 AS claim_pos, trim(parts[i]) AS text FROM sent, generate_series(1, 20) g(i) WHERE i <= len(parts)),
    typed AS (SELECT *, {_TYPE} AS claim_type, regexp_matches(text, '\\d') AS has_numbers, regexp_matches(text, {q(T.DATE_HINT)}) AS has_dates FROM cl)"""
_FORMULA = "CASE " + " ".join(f"WHEN contains(lower(text), {q(w)}) THEN {q(f)}" for w, f in C.FORMULAS) + " END"


def _part(variable: str) -> str:
    raw = f"list_filter(list_transform(ctx, lambda c: nullif(regexp_extract(c, {q(f'(?i){variable.replace('_', ' ')}.*?({T.RAW_NUMBER})')}, 1), '')), lambda x: x IS NOT NULL)[1]"
    return f"({_numbers(f'({raw})')})[1]"


_VARS = sorted({v for vs in C.VARIABLES.values() for v in vs})
_VALUE = """CASE f WHEN '(revenue-cogs)/revenue' THEN (revenue - cogs) / nullif(revenue, 0) WHEN 'operating_income/revenue' THEN operating_income / nullif(revenue, 0) WHEN 'net_income/revenue' THEN net_income / nullif(revenue, 0)
    WHEN 'net_income/shares_outstanding' THEN net_income / nullif(shares_outstanding, 0) WHEN 'total_debt/total_assets' THEN total_debt / nullif(total_assets, 0) WHEN 'current_assets/current_liabilities' THEN current_assets / nullif(current_liabilities, 0) END"""
_NONE = "CASE f " + " ".join(f"WHEN {q(f)} THEN " + " AND ".join(f"{v} IS NULL" for v in vs) for f, vs in C.VARIABLES.items()) + " ELSE TRUE END"
_VERIFIED = f"""{_CLAIMS},
    ctxs AS (SELECT answer_id, list(text ORDER BY ctx_pos) AS ctx FROM contexts GROUP BY answer_id),
    parts AS (SELECT t.*, coalesce(ctx, []) AS ctx, {_numbers('text')}[1] AS n, {_PERCENT} AS p, {_DATE} AS dt, flatten(list_transform(coalesce(ctx, []), lambda c: {_numbers('c')})) AS vals, CASE WHEN claim_type = 'computational' THEN {_FORMULA} END AS f
        FROM typed t LEFT JOIN ctxs USING (answer_id)),
    comp AS (SELECT *, {', '.join(f'CASE WHEN f IS NOT NULL THEN {_part(v)} END AS {v}' for v in _VARS)} FROM parts),
    vals AS (SELECT *, list_min(list_transform(vals, lambda v: abs(v - n) / greatest(n, 1.0::DOUBLE))) AS near, vals[1] AS a, vals[2] AS b, {_VALUE} AS value,
        list_bool_or(list_transform(ctx, lambda c: contains(lower(c), lower(dt)))) AS dated, list_bool_or(list_transform(ctx, lambda c: contains(lower(c), lower(text)))) AS known FROM comp),
    grown AS (SELECT *, abs(CASE WHEN a = 0 THEN 0 ELSE (b - a) / abs(a) END - p) AS off, CASE WHEN contains(lower(text), 'increase') OR contains(lower(text), 'grew') THEN 'up' WHEN contains(lower(text), 'decrease') OR contains(lower(text), 'declined') THEN 'down' END AS way FROM vals),
    meth AS (SELECT *, CASE claim_type
        WHEN 'numerical' THEN CASE WHEN n IS NULL THEN 'no_number_found' WHEN near IS NULL THEN 'numerical_no_match' WHEN near < 0.01 THEN 'numerical_exact_match' WHEN near < 0.05 THEN 'numerical_near_match' ELSE 'numerical_mismatch' END
        WHEN 'comparative' THEN CASE WHEN p IS NOT NULL THEN CASE WHEN b IS NULL THEN 'comparative_not_found' WHEN off < 0.01 THEN 'comparative_calculated' WHEN off < 0.05 THEN 'comparative_near_match' ELSE 'comparative_mismatch' END
            ELSE CASE WHEN b IS NULL THEN 'directional_not_found' WHEN way = CASE WHEN b > a THEN 'up' ELSE 'down' END THEN 'directional_verified' ELSE 'directional_mismatch' END END
        WHEN 'computational' THEN CASE WHEN f IS NULL THEN NULL WHEN {_NONE} THEN 'computational_missing_components' WHEN value IS NULL THEN 'computational_error' WHEN n IS NULL THEN NULL WHEN abs(value - n) / greatest(n, 1.0::DOUBLE) < 0.01 THEN 'computational_verified' ELSE 'computational_mismatch' END
        WHEN 'temporal' THEN CASE WHEN dt IS NULL THEN NULL WHEN dated THEN 'temporal_match' ELSE 'temporal_not_found' END
        ELSE CASE WHEN known THEN 'generic_keyword_match' ELSE 'generic_not_found' END END AS method FROM grown),
    ver AS (SELECT answer_id, claim_pos, text, claim_type, coalesce(method IN ('numerical_exact_match', 'comparative_calculated', 'directional_verified', 'computational_verified', 'temporal_match', 'generic_keyword_match'), FALSE) AS verified, method,
        CASE method WHEN 'numerical_exact_match' THEN 0.95 WHEN 'numerical_near_match' THEN 0.3 WHEN 'directional_verified' THEN 0.8 WHEN 'computational_verified' THEN 0.9 WHEN 'temporal_match' THEN 0.85 WHEN 'generic_keyword_match' THEN 0.8 ELSE 0 END::DOUBLE AS confidence_after FROM meth)"""
_ANSWERED = f"""{_VERIFIED}, done AS (SELECT answer_id, CASE WHEN count(*) FILTER (verified) = 0 THEN {q(C.REFUSAL)} ELSE string_agg(text, ' ' ORDER BY claim_pos) FILTER (verified) END AS answer,
    round(coalesce(avg(confidence_after) FILTER (verified), 0), 6) AS confidence, count(*) AS n_claims, count(*) FILTER (verified) AS n_verified FROM ver GROUP BY answer_id)"""

# ---- retrieval

_LATEST = "pts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, point_id ORDER BY ingest_seq DESC) AS rr FROM points) WHERE rr = 1)"
_COS = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.dense AS DOUBLE[])), 9)"


def _dense(k: int, where: str = "TRUE") -> str:
    return f"{_LATEST}, dsc AS (SELECT v.question_id, p.point_id, {_COS} AS score FROM vector_queries v, pts p WHERE {where}), den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM dsc WHERE score IS NOT NULL) WHERE rank <= {k})"


def _terms(name: str, source: str, key: str) -> str:
    return f"{name}_w AS (SELECT {key} AS k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {source}), {name} AS (SELECT k, n AS len, t AS term, count(*) AS tf FROM (SELECT k, len(w) AS n, unnest(w) AS t FROM {name}_w) GROUP BY 1, 2, 3)"


def _lexical(idf: bool, where: str = "TRUE") -> str:
    weight = "d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.len / s.avg_len))" + (" * ln(1 + (s.n_docs - f.df + 0.5) / (f.df + 0.5))" if idf else "")
    freq = ", fr AS (SELECT term, count(*) AS df FROM td GROUP BY term)" if idf else ""
    return f"""{_terms('tq', f'(SELECT * FROM text_queries WHERE {where})', 'question_id')}, {_terms('td', 'documents', 'doc_id')}{freq},
        st AS (SELECT avg(len) AS avg_len, count(*) AS n_docs FROM (SELECT DISTINCT k, len FROM td)),
        lsc AS (SELECT q.k AS question_id, d.k AS point_id, round(sum({weight} * q.tf), 9) AS score FROM tq q JOIN td d USING (term) {'JOIN fr f USING (term)' if idf else ''}, st s GROUP BY 1, 2),
        lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM lsc) WHERE rank <= 20)"""


def _fused(a: float, b: float) -> str:
    return f"""WITH {_dense(20)}, {_lexical(False)}, fs AS (SELECT question_id, point_id, round(sum(part), 12) AS score FROM (
        SELECT question_id, point_id, {a}::DOUBLE / (60 + rank) AS part FROM den UNION ALL SELECT question_id, point_id, {b}::DOUBLE / (60 + rank) FROM lex) GROUP BY 1, 2)
        SELECT question_id, point_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM fs) WHERE rank <= 20"""


# ---- tables

_BLOCKS = """ln AS (SELECT doc_id, i AS line, parts[i] AS s, contains(parts[i], '|') AS pipe, trim(parts[i]) = '' AS blank FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM md_docs), generate_series(1, 200) g(i) WHERE i <= len(parts)),
    isl AS (SELECT *, count(*) FILTER (NOT pipe AND NOT blank) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM ln),
    beg AS (SELECT *, count(*) FILTER (pipe) OVER (PARTITION BY doc_id, island ORDER BY line) AS begun FROM isl WHERE pipe OR blank),
    grp AS (SELECT b.doc_id, b.island, string_agg(s, chr(10) ORDER BY line) AS markdown, count(*) AS n, any_value(last_island) AS last_island FROM beg b JOIN (SELECT doc_id, max(island) AS last_island FROM isl GROUP BY 1) l USING (doc_id) WHERE begun > 0 GROUP BY 1, 2),
    blk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS table_pos, markdown FROM grp WHERE island < last_island OR n > 2)"""
_WS = "' ' || chr(10) || chr(9) || chr(13)"
_LINES = f"string_split(trim(markdown, {_WS}), chr(10))"
_CELLS = f"list_transform(string_split({_LINES}[1], '|'), lambda c: trim(c, {_WS}))"
_DESC = f"""dsc1 AS (SELECT *, {_LINES} AS li, {_CELLS} AS ce FROM blk), dsc2 AS (SELECT *, CASE WHEN ce[1] = '' THEN ce[2:] ELSE ce END AS c2 FROM dsc1),
    described AS (SELECT doc_id, table_pos, markdown, CASE WHEN len(li) < 2 THEN [] WHEN len(c2) > 0 AND c2[-1] = '' THEN c2[:-2] ELSE c2 END AS headers, greatest(0, len(li) - 2) AS num_rows,
        len(list_filter(ce, lambda c: c <> '')) AS num_cols, CASE WHEN contains(lower(markdown), '[merged]') THEN 'merged' WHEN len(li) > 3 AND NOT contains(li[2], '---') THEN 'hierarchical' ELSE 'simple' END AS table_type FROM dsc2)"""
_GRID = """gr AS (SELECT n_regionkey AS doc_id, count(*) AS num_rows, string_agg(CASE WHEN n_nationkey % 3 = 0 THEN concat('| ', n_name, ' |  |') ELSE concat('| ', n_name, ' | ', CAST(n_nationkey AS VARCHAR), ' |') END, chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1),
    grid AS (SELECT doc_id, 0 AS table_no, concat('| Nation |  |', chr(10), '| --- | --- |', chr(10), body) AS markdown, num_rows, 2 AS num_cols, (num_rows + 1) * 800.0::DOUBLE / 50 AS height FROM gr)"""
_MODEL = f"""mr AS (SELECT doc_id, i - 1 AS i, trim(parts[i], {_WS}) AS raw FROM (SELECT doc_id, string_split(response, '---TABLE BREAK---') AS parts FROM responses), generate_series(1, 20) g(i) WHERE i <= len(parts)),
    mm AS (SELECT doc_id, i, CASE WHEN contains(raw, '```markdown') THEN trim(regexp_extract(raw, '(?s)```markdown(.*?)```', 1), {_WS}) ELSE raw END AS markdown FROM mr WHERE NOT contains(raw, 'NO TABLES FOUND')),
    model AS (SELECT doc_id, 'table_vision_' || CAST(i AS VARCHAR) AS table_id, markdown, CASE WHEN len({_LINES}) < 2 THEN [] ELSE list_filter({_CELLS}, lambda c: c <> '') END AS headers, greatest(0, len({_LINES}) - 2) AS num_rows, len(list_filter({_CELLS}, lambda c: c <> '')) AS num_cols, 0.85::DOUBLE AS confidence FROM mm WHERE contains(markdown, '|'))"""
_TQ = """tqs AS (SELECT CAST(r_regionkey AS BIGINT) * 10 + i AS question_id, CAST(r_regionkey AS BIGINT) AS collection, t AS text FROM region, (VALUES (0, 'table of nation key'), (1, 'nation key'), (2, 'prose'), (3, '| nation | key |'), (4, 'how much prose is in the figure')) x(i, t))"""
_NUM = _any("lower(text)", B.NUMERICAL)
_NODES = r"""gj AS (SELECT doc_id, TRY_CAST(regexp_replace(regexp_replace(trim(json, ' ' || chr(10)), '^```(?:json)?\s*', '', 'i'), '\s*```$', '') AS JSON) AS j FROM graph_json),
    nd AS (SELECT doc_id, i AS pos, coalesce(json_extract(j, '$.nodes'), json_extract(j, '$.entities')) -> i AS n FROM gj, generate_series(0, 5) g(i) WHERE j IS NOT NULL AND i < json_array_length(coalesce(json_extract(j, '$.nodes'), json_extract(j, '$.entities')))),
    nodes AS (SELECT doc_id, pos, coalesce(n ->> '$.id', n ->> '$.name', '') AS id, coalesce(n ->> '$.type', n ->> '$.label', 'Entity') AS type FROM nd)"""
_EDGES = _NODES + r""", ty AS (SELECT doc_id, id, arg_max(type, pos) AS type FROM nodes GROUP BY 1, 2),
    ed AS (SELECT doc_id, i AS pos, coalesce(json_extract(j, '$.relationships'), json_extract(j, '$.edges')) -> i AS e FROM gj, generate_series(0, 5) g(i) WHERE j IS NOT NULL AND i < json_array_length(coalesce(json_extract(j, '$.relationships'), json_extract(j, '$.edges')))),
    eds AS (SELECT doc_id, pos, coalesce(e ->> '$.source', e ->> '$.source_node_id', '') AS src, coalesce(e ->> '$.target', e ->> '$.target_node_id', '') AS dst, coalesce(e ->> '$.type', e ->> '$.label', 'RELATED_TO') AS type FROM ed)"""

_RAW = {
    "route_intents": f"WITH {_ROUTED} SELECT question_id, intent, strategy, confidence, reasoning, keywords FROM routed",
    "route_gate": f"WITH {_ROUTED} SELECT question_id, CASE WHEN confidence < 0.55 THEN 'general_knowledge' ELSE intent END AS intent, CASE WHEN confidence < 0.55 THEN 'simple_rag' ELSE strategy END AS strategy, confidence FROM routed",
    "route_distribution": f"WITH {_ROUTED} SELECT intent, strategy, count(*) AS n FROM routed GROUP BY 1, 2",
    "intent_metrics": f"{_CLASS} SELECT label, tp, fp, fn, round(pp, 6) AS precision, round(rr, 6) AS recall, round(ff, 6) AS f1 FROM f",
    "intent_accuracy": f"{_CLASS} SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT avg((e = p)::INT::DOUBLE) FROM pairs), 6) AS accuracy, round(avg(ff), 6) AS macro_f1 FROM f WHERE tp + fn > 0",
    "intent_failures": f"WITH {_ROUTED} SELECT question_id, expected_intent AS expected, intent AS predicted FROM routed WHERE expected_intent <> intent",
    "latency_summary": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95 FROM orders GROUP BY 1",
    "claim_decomposition": f"WITH {_CLAIMS} SELECT answer_id, CAST(claim_pos AS INT) AS claim_pos, text, claim_type, has_numbers, has_dates FROM typed",
    "document_sentences": f"WITH s AS (SELECT doc_id, unnest(list_filter({_SPLIT}, lambda s: length(trim(s)) >= 10)) AS x FROM documents) SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id",
    "verify_claims": f"WITH {_VERIFIED} SELECT answer_id, CAST(claim_pos AS INT) AS claim_pos, claim_type, verified, method, confidence_after FROM ver",
    "verified_answers": f"WITH {_ANSWERED} SELECT answer_id, answer, confidence, n_claims, n_verified FROM done",
    "method_distribution": f"WITH {_VERIFIED} SELECT method, count(*) AS n FROM ver WHERE method IS NOT NULL GROUP BY 1",
    "type_distribution": f"WITH {_VERIFIED} SELECT claim_type, count(*) AS n FROM ver GROUP BY 1",
    "verification_totals": f"WITH {_VERIFIED} SELECT count(*) AS n_claims, count(*) FILTER (verified) AS n_verified, round(avg(verified::INT::DOUBLE), 6) AS rate FROM ver",
    "faithfulness": f"WITH {_VERIFIED} SELECT answer_id, round(avg(verified::INT::DOUBLE), 6) AS faithfulness FROM ver GROUP BY 1",
    "extractions": f"""SELECT doc_id, round({_numbers('text')}[1], 4) AS first_number, round({_PERCENT}, 6) AS percentage, {_DATE} AS date_text,
        round(CASE WHEN TRY_CAST({_extract('text', T.CONFIDENCE, 1)} AS DOUBLE) IS NULL THEN 0.5 ELSE greatest(0, least(1, TRY_CAST({_extract('text', T.CONFIDENCE, 1)} AS DOUBLE))) END, 6) AS confidence, {_extract('text', T.JSON_ARRAY, 0)} AS json_array,
        array_to_string(regexp_extract_all(text, {q(T.RAW_NUMBER)}), '|') AS raw_numbers, CAST(len({_numbers('text')}) AS INT) AS n_numbers, round(list_max({_numbers('text')}), 4) AS max_number FROM statements""",
    "document_extractions": f"SELECT doc_id, CAST(len(regexp_extract_all(text, {q(T.RAW_NUMBER)})) AS INT) AS n_numbers, CAST(len({_numbers('text')}) AS INT) AS n_scaled FROM documents",
    "dense_top_k": f"WITH {_dense(20)} SELECT question_id, point_id, round(score, 6) AS score, rank FROM den",
    "scoped_search": f"WITH {_dense(5, 'v.label = p.label')} SELECT question_id, point_id, round(score, 6) AS score, rank FROM den",
    "upsert_points": f"WITH {_LATEST} SELECT collection, point_id, ingest_seq, label FROM pts",
    "lexical_top_k": f"WITH {_lexical(False)} SELECT question_id, point_id, round(score, 6) AS score, rank FROM lex",
    "lexical_idf_top_k": f"WITH {_lexical(True)} SELECT question_id, point_id, round(score, 6) AS score, rank FROM lex",
    "text_index_top_k": f"WITH {_lexical(False)} SELECT question_id, point_id, round(score, 6) AS score, rank FROM lex",
    "text_index_idf_top_k": f"WITH {_lexical(True)} SELECT question_id, point_id, round(score, 6) AS score, rank FROM lex",
    "repaired_nodes": """WITH b AS (SELECT s_suppkey AS doc_id, 'S' || s_suppkey AS s, n_name AS n, s_suppkey % 7 AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT doc_id, 0 AS pos, s AS id, CASE WHEN m = 2 THEN 'Entity' ELSE 'Supplier' END AS type FROM b WHERE m <> 5 UNION ALL SELECT doc_id, 1, n, 'Nation' FROM b WHERE m < 3""",
    "repaired_relationships": """SELECT s_suppkey AS doc_id, 0 AS pos, 'S' || s_suppkey AS src, CASE WHEN s_suppkey % 7 = 2 THEN 'Entity' ELSE 'Supplier' END AS src_type, n_name AS dst, 'Nation' AS dst_type, CASE WHEN s_suppkey % 7 = 1 THEN 'RELATED_TO' ELSE 'LOCATED_IN' END AS type
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 < 3""",
    "graph_paths": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst, type FROM graph_edges WHERE type IN ('LOCATED_IN', 'PART_OF')),
        w AS (SELECT 'supplier ' || s_suppkey AS start, 'supplier ' || s_suppkey AS node, 'supplier ' || s_suppkey AS nodes, '' AS types, 0 AS n FROM supplier
            UNION ALL SELECT w.start, e.dst, w.nodes || '|' || e.dst, CASE WHEN n = 0 THEN e.type ELSE w.types || '|' || e.type END, n + 1 FROM w JOIN e ON e.src = w.node WHERE n < 3)
        SELECT start, nodes, types FROM w WHERE n > 0""",
    "graph_path_pattern": """WITH p AS (SELECT 'supplier ' || a.s_suppkey AS start, 'supplier ' || a.s_suppkey || '|' || m.n_name || '|' || r_name || '|' || n.n_name || '|supplier ' || b.s_suppkey AS nodes, n.n_name AS x, 'supplier ' || b.s_suppkey AS y
            FROM supplier a JOIN nation m ON a.s_nationkey = m.n_nationkey JOIN region ON m.n_regionkey = r_regionkey JOIN nation n ON n.n_regionkey = r_regionkey AND n.n_nationkey <> m.n_nationkey JOIN supplier b ON b.s_nationkey = n.n_nationkey)
        SELECT start, nodes, 'LOCATED_IN|PART_OF|PART_OF|LOCATED_IN' AS types FROM p QUALIFY row_number() OVER (PARTITION BY start ORDER BY x, y) <= 3""",
    "detected_tables": """SELECT doc_id, 1 AS page, 0 AS table_no, md5('| Order | Priority | Total |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || substr(p, 1, 1) || ' ' || substr(p, 3) || ' | ' || CASE WHEN r % 5 = 0 THEN '' ELSE t END || ' |', chr(10) ORDER BY r)) AS markdown_md5, CAST(count(*) AS INT) AS num_rows, 3 AS num_cols FROM order_rows GROUP BY doc_id""",
    "store_points": """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS p, CAST(label AS VARCHAR) AS ticker, embedding[1] AS x FROM embeddings WHERE embedding IS NOT NULL),
        a AS (SELECT p AS point_id, 1 AS o, 'first' AS text, ticker, x FROM e UNION ALL SELECT 2 * p, 2, 'second', ticker, x FROM e UNION ALL SELECT 3 * p, 3, 'third', ticker, x FROM e)
        SELECT point_id, text, ticker, round(x::FLOAT::DOUBLE, 5) AS first_value FROM a QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY o DESC) = 1""",
    "hybrid_search": _fused(1.0, 1.0),
    "weighted_hybrid_search": _fused(0.7, 0.3),
    "rerank": f"""WITH {_lexical(False)}, ov AS (SELECT q.k AS question_id, d.k AS point_id, count(*)::DOUBLE AS ce FROM tq q JOIN td d USING (term) GROUP BY 1, 2)
        SELECT question_id, point_id, ce AS score, r AS rank FROM (SELECT l.question_id, l.point_id, ce, row_number() OVER (PARTITION BY l.question_id ORDER BY ce DESC, l.rank, l.point_id) AS r FROM lex l JOIN ov USING (question_id, point_id)) WHERE r <= 5""",
    "diverse_top_k": f"""WITH RECURSIVE {_dense(10)}, cand AS (SELECT d.*, CAST(p.dense AS DOUBLE[]) AS e FROM den d JOIN pts p USING (point_id)),
        pick AS (SELECT question_id, 0 AS step, []::BIGINT[] AS picked FROM (SELECT DISTINCT question_id FROM cand)
            UNION ALL SELECT question_id, step + 1, list_append(picked, (SELECT c.point_id FROM cand c WHERE c.question_id = pick.question_id AND NOT list_contains(pick.picked, c.point_id)
                ORDER BY round(0.7::DOUBLE * c.score - 0.3::DOUBLE * coalesce((SELECT max(list_cosine_similarity(c.e, o.e)) FROM cand o WHERE o.question_id = c.question_id AND list_contains(pick.picked, o.point_id)), 0), 9) DESC, c.rank LIMIT 1)) FROM pick WHERE step < 5)
        SELECT p.question_id, CAST(i AS INT) AS rank, p.picked[i] AS point_id, round(c.score, 6) AS score FROM pick p, generate_series(1, 5) g(i), cand c WHERE step = 5 AND c.question_id = p.question_id AND c.point_id = p.picked[i]""",
    "table_blocks": f"WITH {_BLOCKS} SELECT doc_id, CAST(table_pos AS INT) AS table_pos, markdown FROM blk",
    "table_description": f"WITH {_BLOCKS}, {_DESC} SELECT doc_id, CAST(table_pos AS INT) AS table_pos, array_to_string(headers, '|') AS headers, CAST(num_rows AS INT) AS num_rows, CAST(num_cols AS INT) AS num_cols, table_type, CASE WHEN strpos(text, markdown) = 0 THEN 1 ELSE least((strpos(text, markdown) - 1) // 3000 + 1, 100) END::INT AS page FROM described JOIN md_docs USING (doc_id)",
    "grid_tables": f"WITH {_GRID} SELECT doc_id, table_no, markdown, CAST(num_rows AS INT) AS num_rows, num_cols, height FROM grid",
    "model_tables": f"WITH {_MODEL} SELECT doc_id, table_id, markdown, array_to_string(headers, '|') AS headers, CAST(num_rows AS INT) AS num_rows, CAST(num_cols AS INT) AS num_cols, confidence FROM model",
    "table_retrieval": f"""WITH {_BLOCKS}, {_DESC}, {_TQ},
        th AS (SELECT question_id, 'table' AS type, 0 AS o, doc_id // 100 * 10 + table_pos AS pos, markdown AS content, 0.3::DOUBLE * len(list_filter(headers, lambda h: contains(lower(text), lower(h)))) + CASE WHEN contains(lower(markdown), lower(text)) THEN 0.5 ELSE 0 END + 0.2::DOUBLE AS score FROM tqs JOIN described ON collection = doc_id % 100 WHERE {_NUM}),
        ch AS (SELECT question_id, 'text' AS type, 1 AS o, m.doc_id // 100 AS pos, substr(m.text, 1, 500) AS content, 0.5::DOUBLE AS score FROM tqs JOIN md_docs m ON collection = doc_id % 100 WHERE contains(lower(m.text), lower(tqs.text))),
        un AS (SELECT * FROM th WHERE round(score, 9) > 0.3 UNION ALL SELECT * FROM ch)
        SELECT question_id, type, CAST(pos AS INT) AS pos, content, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, o, pos) AS r FROM un) WHERE r <= 5""",
    "source_cascade": f"""WITH {_BLOCKS}, {_GRID}, {_MODEL}, un AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, 0 AS priority, markdown FROM blk UNION ALL SELECT doc_id + x, 1, markdown FROM grid, (VALUES (0), (200)) s(x) UNION ALL SELECT doc_id + x, 2, markdown FROM model, (VALUES (0), (200), (300)) s(x))
        SELECT CAST(doc_id AS INT) AS doc_id, priority, markdown FROM (SELECT *, min(priority) OVER (PARTITION BY doc_id) AS best FROM un) WHERE priority = best""",
    "token_chunks": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT *, greatest(1, CAST(ceil((len(w) - 1000) / 800.0) AS INT) + 1) AS n FROM t WHERE len(w) > 0)
        SELECT doc_id, CAST(i AS INT) AS chunk_pos, md5(array_to_string(w[i * 800 + 1 : i * 800 + 1000], ' ')) AS text_md5 FROM c, generate_series(0, 2000) g(i) WHERE i < n""",
    "char_chunks": """WITH c AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 1200) / 800.0) AS INT) + 1) AS n FROM documents WHERE text <> '')
        SELECT doc_id, CAST(i AS INT) AS chunk_pos, md5(substr(text, CAST(i * 800 + 1 AS INT), 1200)) AS text_md5 FROM c, LATERAL (SELECT unnest(range(0, n)) AS i)""",
    "graph_input_chunks": """WITH c AS (SELECT doc_id, text, least(30, greatest(1, CAST(ceil((length(text) - 1200) / 800.0) AS INT) + 1)) AS n FROM documents WHERE text <> '')
        SELECT doc_id, CAST(i AS INT) AS chunk_pos, md5(substr(text, CAST(i * 800 + 1 AS INT), 1200)) AS text_md5 FROM c, generate_series(0, 29) g(i) WHERE i < n""",
    "graph_nodes": f"WITH {_NODES} SELECT doc_id, CAST(pos AS INT) AS pos, id, type FROM nodes",
    "graph_relationships": f"WITH {_EDGES} SELECT e.doc_id, CAST(pos AS INT) AS pos, src, coalesce(a.type, 'Entity') AS src_type, dst, coalesce(b.type, 'Entity') AS dst_type, e.type FROM eds e LEFT JOIN ty a ON a.doc_id = e.doc_id AND a.id = src LEFT JOIN ty b ON b.doc_id = e.doc_id AND b.id = dst",
    "graph_mentions": f"WITH {_NODES} SELECT DISTINCT doc_id, id AS node_id FROM nodes",
    "graph_neighbours": "SELECT src AS start, type, count(*) AS n, max(dst) AS last_node FROM graph_edges WHERE src_type = 'Supplier' GROUP BY 1, 2",
    "graph_two_hops": "SELECT a.src, a.dst AS mid, b.dst FROM graph_edges a JOIN graph_edges b ON a.dst = b.src WHERE a.type = 'LOCATED_IN' AND b.type = 'PART_OF'",
    "graph_reachable": """WITH RECURSIVE w AS (SELECT concat('supplier ', CAST(s_suppkey AS VARCHAR)) AS start, concat('supplier ', CAST(s_suppkey AS VARCHAR)) AS node, 0 AS hops FROM supplier
            UNION SELECT w.start, e.dst, w.hops + 1 FROM w JOIN graph_edges e ON e.src = w.node WHERE w.hops < 3)
        SELECT start, hops, count(*) AS n FROM (SELECT start, node, min(hops) AS hops FROM w GROUP BY 1, 2) GROUP BY 1, 2""",
    "feedback_success": "SELECT intent, count(*) AS n, round(avg(was_helpful::INT::DOUBLE), 6) AS success_rate FROM feedback GROUP BY 1",
    "adaptive_thresholds": """WITH f AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS place FROM feedback), ints AS (SELECT DISTINCT intent FROM f),
        grid AS (SELECT i.intent, f.place, count(*) FILTER (f.intent = i.intent) OVER w AS n, count(*) FILTER (f.intent = i.intent AND f.was_helpful) OVER w AS good FROM ints i, f WINDOW w AS (PARTITION BY i.intent ORDER BY f.place)),
        moves AS (SELECT intent, place, CASE WHEN n > 0 AND good::DOUBLE / n < 0.7 THEN 0.05::DOUBLE WHEN n > 0 AND good::DOUBLE / n > 0.9 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END AS way FROM grid WHERE place >= 10)
        SELECT i.intent, round(coalesce(list_reduce(list(m.way ORDER BY place), lambda t, x: CASE WHEN x > 0 THEN least(0.9::DOUBLE, t + x) WHEN x < 0 THEN greatest(0.1::DOUBLE, t + x) ELSE t END, 0.3::DOUBLE), 0.3), 6) AS threshold FROM ints i LEFT JOIN moves m USING (intent) GROUP BY i.intent""",
    "metric_drift": """WITH r AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS p0, avg(l_extendedprice * (1 - l_discount)) AS p1, avg(l_quantity) AS q0, avg(l_quantity / 2) AS q1 FROM lineitem GROUP BY 1),
        m AS (SELECT f || ' price' AS metric, (p0 - p1) / p0 AS d FROM r UNION ALL SELECT f || ' quantity', (q0 - q1) / q0 FROM r)
        SELECT metric, round(d, 6) AS drop, d > 0.10 AS alert FROM m""",
    "document_scope": """SELECT question_id, CAST(label AS VARCHAR) AS ticker, 2024 AS year, CASE WHEN question_id % 3 = 0 THEN '10-Q' ELSE '10-K' END AS type, question_id % 3 <> 0 AS known,
        CASE WHEN question_id % 3 <> 0 THEN 'income' ELSE '' END AS sections, CASE WHEN question_id % 3 <> 0 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM vector_queries""",
    "document_scoped_search": f"WITH {_dense(5, '(v.question_id % 3 = 0 OR v.label = p.label)')} SELECT question_id, point_id, round(score, 6) AS score, rank FROM den",
    "section_scoped_search": f"WITH {_dense(10, '(v.question_id % 3 = 0 OR v.label = p.label AND p.point_id % 3 = 1)')} SELECT question_id, point_id, round(score, 6) AS score, rank FROM den WHERE rank <= 5 OR question_id % 3 <> 0",
    "answer_questions": f"WITH {_ROUTED}, {_ANSWERED} SELECT question_id, intent, strategy, coalesce(answer, {q(C.REFUSAL)}) AS answer, coalesce(done.confidence, 0) AS confidence, coalesce(n_claims, 0) AS n_claims, coalesce(n_verified, 0) AS n_verified FROM routed LEFT JOIN done ON answer_id = question_id",
}
_TYPES = "('numerical', 'comparative', 'computational', 'temporal', 'entity', 'regulatory')"
_RERANKED = """rr AS (SELECT f.question_id, f.point_id, ce, row_number() OVER (PARTITION BY f.question_id ORDER BY ce DESC, f.rank, f.point_id) AS r FROM fu f JOIN ces USING (question_id, point_id))"""
_FUSE = "fs AS (SELECT question_id, point_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT question_id, point_id, rank FROM {0} UNION ALL SELECT question_id, point_id, rank FROM {1}) GROUP BY 1, 2), fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM fs) WHERE rank <= {2})"
_TICKER = f"""{_LATEST}, dsc AS (SELECT v.question_id, p.point_id, {_COS} AS score FROM ticker_questions v JOIN pts p ON v.label = p.label), den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM dsc WHERE score IS NOT NULL) WHERE rank <= 20),
    {_terms('tq', 'ticker_questions', 'question_id')}, {_terms('td', 'ticker_documents', 'doc_id')}, st AS (SELECT avg(len) AS avg_len, count(*) AS n_docs FROM (SELECT DISTINCT k, len FROM td)),
    lsc AS (SELECT q.k AS question_id, d.k AS point_id, round(sum(d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.len / s.avg_len)) * q.tf), 9) AS score FROM tq q JOIN td d USING (term) JOIN ticker_questions a ON a.question_id = q.k JOIN ticker_documents b ON b.doc_id = d.k AND a.label = b.label, st s GROUP BY 1, 2),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM lsc) WHERE rank <= 20), {_FUSE.format('den', 'lex', 10)}, ces AS (SELECT question_id, point_id, (point_id % 11)::DOUBLE AS ce FROM fu)"""
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9#]+', ' ', 'g'))"
_CONFIDENCE = f"TRY_CAST({_extract('response', '(?i)confidence[:' + chr(92) + 's]*([0-9.]+)', 1)} AS DOUBLE)"

_RAW |= {
    "hybrid_rerank": f"""WITH {_dense(20)}, {_lexical(False)}, {_FUSE.format('den', 'lex', 20)}, ov AS (SELECT q.k AS question_id, d.k AS point_id, count(*)::DOUBLE AS ce FROM tq q JOIN td d USING (term) GROUP BY 1, 2),
        ces AS (SELECT f.question_id, f.point_id, coalesce(ce, 0) AS ce FROM fu f LEFT JOIN ov USING (question_id, point_id)), {_RERANKED} SELECT question_id, point_id, ce AS score, CAST(r AS INT) AS rank FROM rr WHERE r <= 5""",
    "hybrid_rerank_diverse": f"""WITH RECURSIVE {_dense(20)}, dsc2 AS (SELECT v.question_id, p.point_id, round(list_cosine_similarity(list_reverse(CAST(v.embedding AS DOUBLE[])), CAST(p.dense AS DOUBLE[])), 9) AS score FROM vector_queries v, pts p),
        den2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM dsc2 WHERE score IS NOT NULL) WHERE rank <= 20), {_FUSE.format('den', 'den2', 20)}, ces AS (SELECT question_id, point_id, (point_id % 7)::DOUBLE AS ce FROM fu), {_RERANKED},
        cand AS (SELECT r.question_id, r.point_id, ce, r, CAST(p.dense AS DOUBLE[]) AS e, coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.dense AS DOUBLE[])), 0) AS rel FROM rr r JOIN pts p USING (point_id) JOIN vector_queries v USING (question_id) WHERE r <= 10),
        pick AS (SELECT question_id, 0 AS step, []::BIGINT[] AS picked FROM (SELECT DISTINCT question_id FROM cand)
            UNION ALL SELECT question_id, step + 1, list_append(picked, (SELECT c.point_id FROM cand c WHERE c.question_id = pick.question_id AND NOT list_contains(pick.picked, c.point_id)
                ORDER BY round(0.7::DOUBLE * c.rel - 0.3::DOUBLE * coalesce((SELECT max(list_cosine_similarity(c.e, o.e)) FROM cand o WHERE o.question_id = c.question_id AND list_contains(pick.picked, o.point_id)), 0), 9) DESC, c.r LIMIT 1)) FROM pick WHERE step < 5)
        SELECT p.question_id, CAST(i AS INT) AS rank, p.picked[i] AS point_id, c.ce AS score FROM pick p, generate_series(1, 5) g(i), cand c WHERE step = 5 AND c.question_id = p.question_id AND c.point_id = p.picked[i]""",
    "ticker_hybrid_search": f"WITH {_TICKER}, {_RERANKED} SELECT question_id, point_id, ce AS score, CAST(r AS INT) AS rank FROM rr WHERE r <= 5",
    "answer_payload": f"""WITH {_lexical(False)}, x AS (SELECT question_id, score, rank, text, concat(coalesce(source, '-'), '/', coalesce(lang, '-')) AS cited FROM lex JOIN documents ON doc_id = point_id WHERE rank <= 5)
        SELECT question_id, round(max(score) FILTER (rank = 1), 6) AS score, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 3)) AS context_md5, CAST(count(*) AS INT) AS n_nodes, string_agg(cited, '|' ORDER BY rank) FILTER (rank <= 3) AS citations FROM x GROUP BY 1""",
    "answer_claims": f"WITH {_VERIFIED} SELECT answer_id, string_agg(concat_ws(':', substr(text, 1, 80), claim_type, CAST(verified AS VARCHAR), method), '|' ORDER BY claim_pos) AS claims FROM ver GROUP BY 1",
    "strategy_contexts": f"""WITH {_ROUTED}, un AS (SELECT question_id, 'graph' AS branch, 0 AS o, ctx_pos, text FROM graph_contexts JOIN routed USING (question_id) WHERE strategy = 'graphrag' AND text <> ''
        UNION ALL SELECT question_id, 'table', 0, ctx_pos, text FROM table_contexts JOIN routed USING (question_id) WHERE strategy = 'multimodal_rag' AND text <> '' UNION ALL SELECT answer_id, 'simple', 1, ctx_pos, text FROM contexts JOIN routed ON answer_id = question_id WHERE text <> '')
        SELECT question_id, branch, CAST(ctx_pos AS BIGINT) AS ctx_pos, text FROM (SELECT *, min(o) OVER (PARTITION BY question_id) AS best FROM un) WHERE o = best""",
    "told_claims": f"""WITH {_CLAIMS}, tj AS (SELECT answer_id, TRY_CAST(nullif(regexp_extract(response, '(?s)\\[.*\\]', 0), '') AS JSON) AS j FROM told_answers),
        tf AS (SELECT answer_id, j FROM tj WHERE j IS NOT NULL AND list_bool_and(list_transform(json_extract_string(j, '$[*].type'), lambda x: lower(x) IN {_TYPES}))),
        tc AS (SELECT answer_id, i AS claim_pos, trim(json_extract_string(j, '$[' || i || '].claim')) AS text, lower(json_extract_string(j, '$[' || i || '].type')) AS claim_type FROM tf, generate_series(0, 9) g(i) WHERE i < json_array_length(j))
        SELECT answer_id, CAST(claim_pos AS INT) AS claim_pos, text, claim_type, regexp_matches(text, '\\d') AS has_numbers, regexp_matches(text, {q(T.DATE_HINT)}) AS has_dates FROM tc
        UNION ALL SELECT answer_id, CAST(claim_pos AS INT), text, claim_type, has_numbers, has_dates FROM typed WHERE answer_id NOT IN (SELECT answer_id FROM tf)""",
    "told_answers": f"""WITH {_ANSWERED} SELECT answer_id, CASE WHEN n_verified > 0 AND response IS NOT NULL THEN response ELSE answer END AS answer,
        CASE WHEN n_verified > 0 AND response IS NOT NULL THEN CASE WHEN {_CONFIDENCE} IS NULL THEN 0.5 ELSE greatest(0, least(1, {_CONFIDENCE})) END ELSE confidence END::DOUBLE AS confidence, n_claims, n_verified FROM done LEFT JOIN told_texts USING (answer_id)""",
    "semantic_claims": """WITH b AS (SELECT v.label AS answer_id, v.question_id AS claim_pos, greatest(0, coalesce(max(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), list_reverse(CAST(e.embedding AS DOUBLE[])))), 0)) AS s FROM vector_queries v LEFT JOIN embeddings e ON v.label = e.label GROUP BY 1, 2)
        SELECT answer_id, claim_pos, round(s, 6) AS similarity, s > 0.85 AS verified, CASE WHEN s > 0.85 THEN 'generic_semantic_match' ELSE 'generic_no_semantic_match' END AS method, round(CASE WHEN s > 0.85 THEN s ELSE 0 END, 6) AS confidence_after FROM b""",
    "verifier_checks": f"""WITH {_VERIFIED}, n AS (SELECT answer_id, count(*) AS n_claims, count(*) FILTER (verified) AS n_verified FROM ver GROUP BY 1)
        SELECT answer_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_verified, 0) AS n_verified, coalesce(coalesce(n_claims, 0) = expected_claims, TRUE) AS decomposition_ok,
        coalesce(coalesce(n_verified, 0) = expected_verified, TRUE) AND coalesce(coalesce(n_claims, 0) - coalesce(n_verified, 0) = expected_unverified, TRUE) AS verification_ok FROM cases LEFT JOIN n USING (answer_id)""",
    "verifier_totals": f"""WITH {_VERIFIED}, n AS (SELECT answer_id, count(*) AS n_claims, count(*) FILTER (verified) AS n_verified FROM ver GROUP BY 1),
        c AS (SELECT coalesce(n_claims, 0) AS a, coalesce(n_verified, 0) AS b, * FROM cases LEFT JOIN n USING (answer_id))
        SELECT count(*) AS n_cases, CAST(sum(a) AS BIGINT) AS n_claims, CAST(sum(b) AS BIGINT) AS n_verified, round(sum(b)::DOUBLE / sum(a), 6) AS rate, count(*) FILTER (coalesce(a = expected_claims, TRUE)) AS decomposition_passed,
        count(*) FILTER (coalesce(b = expected_verified, TRUE) AND coalesce(a - b = expected_unverified, TRUE)) AS verification_passed FROM c""",
    "e2e_summary": f"""WITH {_ROUTED}, {_ANSWERED} SELECT count(*) AS n, round(avg((intent = expected_intent)::INT::DOUBLE), 6) AS intent_accuracy, round(avg((strategy <> 'simple_rag')::INT::DOUBLE), 6) AS strategy_accuracy,
        round(avg(coalesce(n_verified::DOUBLE / n_claims, 0)), 6) AS faithfulness, bool_and(coalesce(trim(answer), '') <> '') AS all_answered FROM routed LEFT JOIN done ON answer_id = question_id""",
    "graph_questions": f"""WITH e AS (SELECT {_PLAIN.format('src')} AS name, concat_ws(' ', src, lower(replace(type, '_', ' ')), dst) AS text FROM graph_edges),
        f AS (SELECT DISTINCT question_id, e.text FROM graph_questions g JOIN e ON contains(' ' || {_PLAIN.format('g.text')} || ' ', ' ' || e.name || ' '))
        SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY text) - 1 AS INT) AS ctx_pos, text FROM f""",
    "odd_tables": f"WITH {_BLOCKS.replace('md_docs', 'odd_docs')}, {_DESC} SELECT doc_id, CAST(table_pos AS INT) AS table_pos, array_to_string(headers, '|') AS headers, CAST(num_rows AS INT) AS num_rows, CAST(num_cols AS INT) AS num_cols, table_type, 0.9::DOUBLE AS confidence, CASE WHEN strpos(text, markdown) = 0 THEN 1 ELSE least((strpos(text, markdown) - 1) // 3000 + 1, 100) END::INT AS page FROM described JOIN odd_docs USING (doc_id)",
}
SQL = {name: with_views(sql) for name, sql in _RAW.items()}
