"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob addressed by the SHA-256 of its bytes. An anti-join with the ledger leaves the pairs of
blob and rule version that it doesn't hold; only these are scanned, once per blob however many paths (document ids) carry
it, and added to the ledger. Findings are then joined back to all paths. The text of a blob comes from one row that carries
it, matched on blob and id, so copies of a hot text stay spread.

Defined cases: null text counts as empty; a null doc_id is a path like any other; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A pattern; `secret` is the group that must have `least` characters (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    secret: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}:{self.version}"


# For access and hex a match is a maximal run, so the least length can stand in the pattern without changing the result.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    # entered once for each run of its characters and never backed up in, so linear
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
)
BASE = ("assign", "access", "hex")
LEDGER_SCHEMA = "blob binary, rule string, findings array<struct<start:bigint,end:bigint>>"


class Ledger:
    """A ledger kept as Parquet files in a folder (made in the shared one by default); it is only ever added to."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.scratch_path(spark, "ledger")
        self.empty = path is None

    def read(self) -> DataFrame | None:
        return None if self.empty else self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(self.path)
        self.empty = False


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(rule: Rule, number: int) -> str:
    """SQL for the matches of a rule in `text`: position in the list, length of the gap before, of the match, of the secret."""
    p = _lit(rule.pattern)
    return f"""CASE WHEN array_contains(need, '{rule.tag}') AND text RLIKE {p} THEN
        transform(arrays_zip(regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {rule.secret}), split(text, {p}, -1)),
            (x, i) -> named_struct('rule', {number}, 'i', i, 'gap', char_length(x['2']), 'len', coalesce(char_length(x['0']), 0), 'secret', coalesce(char_length(x['1']), 0)))
        ELSE cast(array() as array<struct<rule:int,i:int,gap:int,len:int,secret:int>>) END"""


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): for each row of docs its doc_id, blob and findings; and the new ledger rows, to be appended.

    entries holds a row for every (blob, rule version) scanned now, findings or not, so that the next scan skips it.
    """
    every = F.array(*[F.lit(r.tag) for r in rules])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = common.written(rows.select("doc_id", "blob"), "paths")
    pairs = paths.groupBy("blob").agg(F.min("doc_id").alias("rep")).select("blob", "rep", F.explode(every).alias("rule"))
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule").distinct(), ["blob", "rule"], "left_anti")
    blobs = common.written(pairs.groupBy(F.col("blob").alias("b_blob")).agg(F.first("rep").alias("rep"), F.collect_set("rule").alias("need")), "unseen")
    texts = rows.join(blobs, (F.col("blob") == F.col("b_blob")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("blob", "need", "text")
    lists = ", ".join(_matches(r, n) for n, r in enumerate(rules))
    raw = texts.select("blob", F.explode(F.expr(f"concat({lists})")).alias("m")).select("blob", "m.*").distinct()
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    ends = raw.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).where((F.col("len") > 0) & (F.col("secret") >= least))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    hit = F.struct((F.col("end") - F.col("len")).alias("start"), "rule", "end", F.element_at(kinds, F.col("rule") + 1).alias("kind"))
    found = common.written(ends.groupBy("blob").agg(F.array_sort(F.collect_list(hit)).alias("hits")), "findings")
    entries = blobs.join(found.withColumnRenamed("blob", "b_blob"), "b_blob", "left").select(F.col("b_blob").alias("blob"), F.explode("need").alias("rule"), "hits")
    number = F.array_position(every, F.col("rule")) - 1
    mine = F.filter(F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)), lambda h: h["rule"] == number)
    entries = entries.select("blob", "rule", F.transform(mine, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("findings"))
    return joined(paths, found, ledger, rules), entries


def scan_arrivals(arrivals: list[DataFrame], ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan batches of documents one after the other against a ledger that each adds to: the paths of all with their findings."""
    out = None
    for docs in arrivals:
        paths, entries = scan(docs, ledger.read(), rules)
        ledger.append(entries)
        out = paths if out is None else out.unionByName(paths)
    return out


def joined(paths: DataFrame, found: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of this scan and of the ledger, joined to all paths: doc_id, blob, findings in order of start, then rule."""
    hits = found
    if ledger is not None:
        tags = F.array(*[F.lit(r.tag) for r in rules])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        old = ledger.withColumn("n", F.array_position(tags, F.col("rule")).cast("int")).where("n > 0 and size(findings) > 0")
        old = old.select("blob", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), (F.col("n") - 1).alias("rule"), x["end"].alias("end"), F.element_at(kinds, F.col("n")).alias("kind"))).alias("hits"))
        hits = found.unionByName(old).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    empty = F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("hits", empty).alias("findings"))


def digest(paths: DataFrame) -> DataFrame:
    """The columns of the query, from the findings."""
    join = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(findings, x -> x.kind in ('assign', 'access', 'hex'))"
    count = [F.expr(f"cast(size(filter(findings, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return paths.select("doc_id", *count, F.sha2(F.expr(join.format(base)), 256).alias("base_sha256"), F.expr(join.format("findings")).alias("spans"))
