"""Graphs: JSON from a model to nodes and edges, loading with merge semantics, and fixed traversals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.repair import repaired

ENTITY, RELATED = "Entity", "RELATED_TO"
#: Facts told of the nodes that a question names.
FACTS = 50
#: Edges that one task tells apart.
APART = 500_000
_NODE = "struct<id:string,name:string,type:string,label:string>"
_EDGE = "struct<source:string,source_node_id:string,target:string,target_node_id:string,type:string,label:string>"
_SHAPE = f"struct<nodes:array<{_NODE}>,entities:array<{_NODE}>,relationships:array<{_EDGE}>,edges:array<{_EDGE}>>"


def strip_fences(text: Column) -> Column:
    """Text without a code fence around it."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return trim(F.regexp_replace(F.regexp_replace(trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def message_text(message: Column) -> Column:
    """The text of a model's message: of JSON with content or text, alone or in lists, else the message itself."""
    paths = ("$.content[0].text", "$.content", "$[0].text", "$.text")
    return F.coalesce(*[F.get_json_object(message, p) for p in paths], message)


def normalise(documents: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each document's JSON, whichever field names it uses; text without JSON gives none.

    The JSON may stand in a code fence, or in a model's message around it. What isn't valid is mended first; only such texts
    go through Python.

    Endpoint types come from a join with the document's nodes, the last of an id winning; unknown endpoints are entities.
    """
    clean = documents.select("doc_id", strip_fences(message_text(F.col(column))).alias("j"))
    fine = F.try_parse_json("j").isNotNull()
    mended = clean.where(~fine & F.col("j").rlike(r"[{\[]")).select("doc_id", repaired("j").alias("j"))
    parsed = clean.where(fine).unionByName(mended).select("doc_id", F.from_json("j", _SHAPE).alias("g"))
    nodes = parsed.select("doc_id", F.posexplode(F.coalesce("g.nodes", "g.entities")).alias("pos", "n"))
    nodes = nodes.select("doc_id", "pos", F.coalesce("n.id", "n.name", F.lit("")).alias("id"), F.coalesce("n.type", "n.label", F.lit(ENTITY)).alias("type"))
    types = nodes.groupBy("doc_id", "id").agg(F.max_by("type", "pos").alias("type"))
    edges = parsed.select("doc_id", F.posexplode(F.coalesce("g.relationships", "g.edges")).alias("pos", "e"))
    edges = edges.select("doc_id", "pos", F.coalesce("e.source", "e.source_node_id", F.lit("")).alias("src"), F.coalesce("e.target", "e.target_node_id", F.lit("")).alias("dst"), F.coalesce("e.type", "e.label", F.lit(RELATED)).alias("type"))
    source = types.select("doc_id", F.col("id").alias("src"), F.col("type").alias("src_type"))
    target = types.select("doc_id", F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    typed = edges.join(source, ["doc_id", "src"], "left").join(target, ["doc_id", "dst"], "left")
    typed = typed.select("doc_id", "pos", "src", F.coalesce("src_type", F.lit(ENTITY)).alias("src_type"), "dst", F.coalesce("dst_type", F.lit(ENTITY)).alias("dst_type"), "type")
    return nodes, typed


def load(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge semantics: (nodes, edges, mentions) without repeats."""
    return nodes.select("id", "type").dropDuplicates(), edges.select("src", "src_type", "dst", "dst_type", "type").dropDuplicates(), nodes.select("doc_id", F.col("id").alias("node_id")).dropDuplicates()


def told_apart(ends: DataFrame) -> DataFrame:
    """The different rows of the ends of edges, source first.

    They are told apart in ranges of some APART rows, so a task holds no more when there are more edges. Equal rows share a
    range, and a node's edges lie in one or few, however many it has. Counting the rows beforehand reads no column.
    """
    parts = max(ends.sparkSession.sparkContext.defaultParallelism, -(-ends.count() // APART))
    return ends.repartitionByRange(parts, *ends.columns).distinct()


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, type, node one hop along the edges. starts: one column `start`."""
    return starts.join(edges.select(F.col("src").alias("start"), "type", F.col("dst").alias("node")), "start")


def neighbour_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, type, n, last_node: how many neighbours of each start an edge type leads to, and the last of them by name.

    The same as counting `neighbours`, but edges are counted where they lie, and only a row for each node and type meets the
    starts. starts: one column `start`.
    """
    ends = edges.groupBy(F.col("src").alias("start"), "type").agg(F.count(F.lit(1)).alias("_n"), F.max("dst").alias("last_node"))
    asked = starts.groupBy("start").agg(F.count(F.lit(1)).alias("_m"))
    return asked.join(ends, "start").select("start", "type", (F.col("_n") * F.col("_m")).alias("n"), "last_node")


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """src, mid, dst along an edge of the first type and one of the second."""
    a = edges.where(F.col("type") == first).select("src", F.col("dst").alias("mid"))
    return a.join(edges.where(F.col("type") == second).select(F.col("src").alias("mid"), "dst"), "mid").select("src", "mid", "dst")


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 4, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """start, node, hops: every node within `depth` hops and its least distance; each step joins only the new frontier.

    kept writes a frontier and reads it back, so that a step's plan doesn't repeat the steps before.
    """
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        frontier = kept(step) if kept else step
        seen = seen.unionByName(frontier)
    return seen


@dataclass(frozen=True)
class Step:
    """One element of a path pattern: `least` to `most` edges of some types, along them or against, to nodes of a type."""

    types: tuple[str, ...] = ()
    least: int = 1
    most: int = 1
    against: bool = False
    node_type: str | None = None


def _along(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Paths made longer by each link from their last node that isn't on them."""
    both = paths.join(links, F.element_at("nodes", -1) == F.col("_h")).where(~F.array_contains("_e", F.col("_k")))
    return both.select("start", F.array_append("nodes", F.col("_n")).alias("nodes"), F.array_append("types", F.col("_y")).alias("types"), F.array_append("_e", F.col("_k")).alias("_e"), F.col("_nt").alias("_t"))


def paths(edges: DataFrame, starts: DataFrame, steps: list[Step], limit: int | None = None, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """start, nodes, types: every path that matches the steps in order, as the nodes on it (start first) and its edges' types.

    No edge occurs twice on a path, as in a graph database's patterns; a step's node type holds for its last node. Each edge
    of a step is a join of the paths so far with the edges of its types alone. With a limit, the first paths of each start by
    length and then nodes and types; the last edge is then taken from the first edges of each node only, as many as the limit
    and the edges that a path may have used before. kept writes a frontier and reads it back. starts: one column `start`.
    """
    used = 0
    found = starts.select("start", F.array("start").alias("nodes"), F.array().cast("array<string>").alias("types"), F.array().cast("array<string>").alias("_e"), F.lit(None).cast("string").alias("_t"))
    for place, step in enumerate(steps):
        if not 0 <= step.least <= step.most:
            raise ValueError("a step needs 0 <= least <= most")
        mine = edges.where(F.col("type").isin(list(step.types))) if step.types else edges
        here, there = ("dst", "src") if step.against else ("src", "dst")
        key = F.to_json(F.array("src", "type", "dst"))
        links = mine.select(F.col(here).alias("_h"), F.col(there).alias("_n"), F.col(f"{there}_type").alias("_nt"), F.col("type").alias("_y"), key.alias("_k")).distinct()
        reached, frontier = (found if step.least == 0 else None), found
        last = limit is not None and place == len(steps) - 1
        for n in range(1, step.most + 1):
            if last and n >= step.least:  # a used edge takes one place of the rank, whatever types its ends are told to have
                ends = links if step.node_type is None else links.where(F.col("_nt") == step.node_type)
                first = Window.partitionBy("_h").orderBy("_n", "_y")
                ends = ends.withColumn("_r", F.dense_rank().over(first)).where(F.col("_r") <= limit + used).drop("_r")
                done = _along(frontier, ends)
                reached = done if reached is None else reached.unionByName(done)
            if last and n == step.most:
                break
            frontier = _along(frontier, links)
            frontier = kept(frontier) if kept else frontier
            used += 1
            if n >= step.least and not last:
                reached = frontier if reached is None else reached.unionByName(frontier)
        found = reached
        if step.node_type is not None:
            found = found.where(F.col("_t") == step.node_type)
    out = found.select("start", "nodes", "types")
    if limit is None:
        return out
    first = Window.partitionBy("start").orderBy(F.size("types"), "nodes", "types")
    return out.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit).drop("_r")


def entity_context(edges: DataFrame, mentions: DataFrame, chunks: DataFrame, starts: DataFrame, entity_type: str) -> DataFrame:
    """start, node, doc_id, text, page: the chunks that mention an entity of a type one hop from each start, in order of page.

    mentions: doc_id, node_id. chunks: doc_id, text, page. starts: one column `start`.
    """
    near = starts.join(edges.where(F.col("dst_type") == entity_type).select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct(), "start")
    found = near.join(mentions.select(F.col("node_id").alias("node"), "doc_id").distinct(), "node").join(chunks, "doc_id")
    return found.select("start", "node", "doc_id", "text", "page").orderBy("start", "page")


def _run(n: int) -> Callable[[Column], Column]:
    return lambda k: F.array_join(F.slice("_w", k + 1, F.lit(n)), " ")


def ask(questions: DataFrame, edges: DataFrame, limit: int | None = FACTS) -> DataFrame:
    """question_id, ctx_pos, text: the edges, as sentences, of each node that a question names; the first `limit` by text, or all.

    A node is named by a run of the question's words that is its whole name, of any length, without punctuation; case doesn't
    count. Runs are made in the lengths that node names have, and meet the nodes before their edges do, so that a run that is
    no name goes early; a node of many edges keeps `limit` of them in each task.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}#]+", " "))
    told = edges.select(plain(F.col("src")).alias("name"), F.concat_ws(" ", "src", F.regexp_replace(F.lower("type"), "_", " "), "dst").alias("text")).where("name <> ''")
    size = F.size(F.split("name", " "))
    lengths = sorted(r[0] for r in told.select(size.alias("n")).distinct().collect())  # as many rows as names have lengths
    if not lengths:
        return questions.select("question_id", F.lit(0).alias("ctx_pos"), F.col("text").cast("string").alias("text")).where("false")
    words = questions.where("text is not null").select("question_id", F.split(plain(F.col("text")), " ").alias("_w"))
    starts = lambda n: F.filter(F.sequence(F.lit(0), F.size("_w")), lambda k: k + n <= F.size("_w"))
    runs = F.flatten(F.array(*[F.transform(starts(n), _run(n)) for n in lengths]))
    named = words.select("question_id", F.explode(F.array_distinct(runs)).alias("name"))
    named = named.join(told.select("name").distinct(), "name", "left_semi")
    found = named.join(told, "name").select("question_id", "text").distinct()
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("text")))
    ranked = ranked if limit is None else ranked.where(F.col("_r") <= limit)
    return ranked.select("question_id", (F.col("_r") - 1).alias("ctx_pos"), "text")
