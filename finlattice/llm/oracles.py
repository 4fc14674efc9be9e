"""DuckDB SQL for the corpus queries that SQL can express on whole tables.

Language ID, packing, HTML extraction and SentencePiece have none, nor has PII: its added kinds depend on checksums and context words.
"""

from __future__ import annotations

SUFFIX = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, array_slice(b, p + 1, p + 50) AS w FROM n, LATERAL (SELECT unnest(range(0, greatest(n - 49, 0))) AS p)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING count(*) > 1),
g AS (SELECT w.doc_id, p FROM w JOIN f USING (w) WHERE w.doc_id > first),
i AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, n, n FROM n),
k AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) AS begin FROM e),
h AS (SELECT doc_id, string_agg(CASE WHEN a > begin THEN hex(array_slice(b, begin + 1, a)) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN n USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)"""


# kind, pattern, group that must be long enough, its least length, group that is the finding. RE2 has no look-behind: the
# character before a jwt is in its match, but not in the finding, which ends where the match ends.
_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 0),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", r"[0-9a-f]+", 0, 24, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, 0),
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 0, 1),
]
_BASE = ("assign", "access", "hex")


def _secrets() -> str:
    parts = []
    for k, (kind, pattern, group, least, finding) in enumerate(_RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {k} AS rule, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS secrets, regexp_extract_all(text, {p}, {finding}) AS found FROM t WHERE regexp_matches(text, {p})")
    kinds = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in _BASE)
    base = ", ".join(f"'{k}'" for k in _BASE)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, rule, kind, length(found[i]) AS len, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda g: length(g))) AS z, length(secrets[i]) >= least AS fine
    FROM m, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)),
s AS (SELECT doc_id, rule, kind, CAST(z - len AS BIGINT) AS a, concat_ws(':', kind, CAST(z - len AS BIGINT), CAST(z AS BIGINT)) AS span FROM x WHERE fine),
g AS (SELECT doc_id, {kinds}, string_agg(span, ',' ORDER BY a, rule) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, rule) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT *, label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AS fine FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""

_KEY = "translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS x FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)), k AS (SELECT *, {_KEY} AS k FROM l),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, f.k IS NULL OR doc_id = last AS keep FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256 FROM g GROUP BY doc_id"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
BENCHMARK = f"""WITH b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
bm AS (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM bm, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM d, ms, LATERAL (SELECT unnest(range(1, greatest(len(w) - m + 2, 1))) AS i)),
o AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

MINHASH = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN c ON s.doc_id = c.a"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# The checksum of a decimal id, bit by bit: DuckDB has no crc32.
_CRC = "list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), range(0, 8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"


def _tree(base: str, key: str) -> str:
    """Recursive: the nodes of all levels of the trees over base (key, i, n, h)."""
    return f"SELECT 0 AS level, {key}, i, n, h FROM {base} UNION ALL SELECT level + 1, {key}, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {{0}} WHERE n > 1 GROUP BY level, {key}, i // 3, n"


def _fold(base: str, tree: str) -> str:
    """Recursive: (row, level, key, i, n, h, p): what h becomes with its siblings on each level; p: the siblings so far."""
    return f"""SELECT r, 0 AS level, key, i, n, h, p FROM {base} UNION ALL SELECT f.r, f.level + 1, f.key, f.i // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)), f.p || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> f.i), '')
    FROM {{0}} f JOIN {tree} t ON t.key IS NOT DISTINCT FROM f.key AND t.level = f.level AND t.i // 3 = f.i // 3 WHERE f.n > 1 GROUP BY f.r, f.level, f.key, f.i, f.n, f.h, f.p"""


MERKLE = f"""WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents),
c AS (SELECT *, coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) AS hit FROM d),
l AS (SELECT doc_id, source AS key, sha256({_LEAF} || {_FIELD.format("text")}) AS h, sha256({_LEAF} || {_FIELD.format("CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END")}) AS t FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, h) AS r, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM l),
t AS ({_tree("o", "key").format("t")}),
u AS (SELECT key, h, row_number() OVER (ORDER BY encode(key) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
ut AS ({_tree("(SELECT 0 AS key, i, n, h FROM u)", "key").format("ut")}),
f AS ({_fold("(SELECT r, key, i, n, t AS h, '' AS p FROM o)", "t").format("f")}),
g AS ({_fold("(SELECT f.r, 0 AS key, u.i, u.n, f.h, f.p FROM f JOIN u ON f.key IS NOT DISTINCT FROM u.key WHERE f.n = 1)", "ut").format("g")}),
z AS (SELECT h AS root FROM ut WHERE n = 1)
SELECT o.doc_id, o.h AS leaf, u.h AS subroot, root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = root AS verified FROM o JOIN g ON o.r = g.r AND g.n = 1 JOIN u ON o.key IS NOT DISTINCT FROM u.key, z"""

RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT count(*) AS all_docs, CAST(sum(len(w)) AS BIGINT) AS all_words FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_WORDS.format("coalesce(text, '')")}) AS t FROM benchmark)),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_words)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t), s GROUP BY ALL),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50"""

SQL: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX,
    "op3_secret_ledger": _secrets(),
    "op5_embedding_dedup": EMBEDDINGS,
    "op6_line_dedup": LINES,
    "op7_decontamination": BENCHMARK,
    "op8_minhash": MINHASH,
    "op11_merkle_manifest": MERKLE,
    "op13_ranked_search": RANKED,
}
