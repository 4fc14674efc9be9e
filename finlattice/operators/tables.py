"""Tables in markdown: segmentation of documents, description, grids, model responses, scoring and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that mark a question as numerical, and the scores of a table.
NUMERICAL = ["revenue", "profit", "margin", "growth", "increase", "decrease", "compare", "vs", "breakdown", "by segment", "by product", "table", "figure", "show me the numbers", "how much", "what %"]
HEADER_SCORE, CONTENT_SCORE, NUMERICAL_SCORE, LEAST_SCORE, TEXT_SCORE = 0.3, 0.5, 0.2, 0.3, 0.5
PAGE_CHARS, LAST_PAGE, BREAK, FENCE = 3000, 100, "---TABLE BREAK---", "```markdown"


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, table_pos, markdown: runs of lines with a pipe or blank, begun by a line with a pipe.

    A run that other text ends counts at any length; one that the end of the document ends needs more than two lines.
    Gaps and islands within the document: every line knows how many other lines came before it.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.withColumns({"pipe": F.contains("s", F.lit("|")), "blank": T.strip(F.col("s")) == ""})
    run = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("island", F.count_if(~F.col("pipe") & ~F.col("blank")).over(run))
    inside = Window.partitionBy("doc_id", "island").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = lines.where(F.col("pipe") | F.col("blank")).withColumn("begun", F.count_if("pipe").over(inside)).where("begun > 0")
    last = lines.groupBy("doc_id").agg(F.max("island").alias("last_island"))
    groups = kept.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line", "s"))).alias("rows")).join(last, "doc_id")
    groups = groups.where((F.col("island") < F.col("last_island")) | (F.size("rows") > 2))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return groups.select("doc_id", number.alias("table_pos"), F.array_join(F.transform("rows", lambda r: r["s"]), "\n").alias("markdown"))


def _lines(markdown: Column) -> Column:
    return F.split(T.strip(markdown), "\n")


def headers(markdown: Column) -> Column:
    """Trimmed cells of the first line without one empty cell at each edge; empty for fewer than two lines."""
    cells = F.transform(F.split(F.get(_lines(markdown), F.lit(0)), r"\|"), T.strip)
    left = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    both = F.when((F.size(left) > 0) & (F.element_at(left, -1) == ""), F.slice(left, F.lit(1), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    return F.when(F.size(_lines(markdown)) < 2, F.array().cast("array<string>")).otherwise(both)


def n_rows(markdown: Column) -> Column:
    return F.greatest(F.lit(0), F.size(_lines(markdown)) - 2)


def n_cols(markdown: Column) -> Column:
    return F.size(F.filter(F.split(F.get(_lines(markdown), F.lit(0)), r"\|"), lambda c: T.strip(c) != ""))


def table_type(markdown: Column) -> Column:
    lines = _lines(markdown)
    odd = (F.size(lines) > 3) & ~F.contains(F.get(lines, F.lit(1)), F.lit("---"))
    return F.when(F.contains(F.lower(markdown), F.lit("[merged]")), "merged").when(odd, "hierarchical").otherwise("simple")


def page_of(markdown: Column, text: Column) -> Column:
    """A page guessed from the position in the text; 1 if it isn't there."""
    at = F.instr(text, markdown)
    return F.when(at == 0, 1).otherwise(F.least(F.floor((at - 1) / PAGE_CHARS) + 1, F.lit(LAST_PAGE))).cast("int")


def describe(tables: DataFrame) -> DataFrame:
    md = F.col("markdown")
    return tables.withColumns({"headers": headers(md), "num_rows": n_rows(md), "num_cols": n_cols(md), "table_type": table_type(md)})


def parsed(documents: DataFrame) -> DataFrame:
    """The described tables of documents that a parsing service has made markdown of: sure, without a place on the page."""
    zero = F.lit(0.0)
    return describe(blocks(documents)).withColumns({"confidence": F.lit(0.9), "bbox": F.struct(zero.alias("x1"), zero.alias("y1"), zero.alias("x2"), zero.alias("y2"))})


def grid_markdown(grid: Column) -> Column:
    """Markdown of an array of rows of cells: header, rule, rows padded or cut to the header's width, empty rows left out."""
    clean = lambda row: F.transform(row, lambda c: T.strip(F.coalesce(c, F.lit(""))))
    head = clean(F.get(grid, F.lit(0)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fitted = lambda row: F.slice(F.concat(clean(row), F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))
    body = F.transform(F.filter(F.slice(grid, F.lit(2), F.size(grid)), lambda r: F.size(r) > 0), lambda r: line(fitted(r)))
    rule = line(F.array_repeat(F.lit("---"), F.size(head)))
    return F.when((F.size(grid) < 1) | (F.size(F.get(grid, F.lit(0))) < 1), "").otherwise(F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def grids(tables: DataFrame) -> DataFrame:
    """Tables from cell grids of two rows or more: a running table number, markdown, size, confidence and estimated box."""
    good = tables.where(F.size("grid") >= 2)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "grid_pos")) - 1
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("page_width").alias("x2"), (F.size("grid") * F.col("page_height") / 50).alias("y2"))
    return good.select("doc_id", "page", number.alias("table_no"), grid_markdown(F.col("grid")).alias("markdown"), (F.size("grid") - 1).alias("num_rows"), F.size(F.get("grid", F.lit(0))).alias("num_cols"), F.lit(0.75).alias("confidence"), F.lit("simple").alias("table_type"), box.alias("bbox"))


def parse_response(responses: DataFrame) -> DataFrame:
    """Tables in the answers of an image model: doc_id, page, response -> one row a table, numbered with the blocks left out."""
    rows = responses.select("doc_id", "page", F.posexplode(F.split("response", BREAK)).alias("i", "raw")).withColumn("raw", T.strip(F.col("raw")))
    rows = rows.where(~F.contains("raw", F.lit("NO TABLES FOUND")))
    fenced = F.contains("raw", F.lit(FENCE))
    inner = T.strip(F.regexp_extract("raw", r"(?s)```markdown(.*?)```", 1))
    rows = rows.withColumn("markdown", F.when(fenced, inner).otherwise(F.col("raw"))).where(F.contains("markdown", F.lit("|")))
    cells = F.filter(F.transform(F.split(F.get(_lines(F.col("markdown")), F.lit(0)), r"\|"), T.strip), lambda c: c != "")
    heads = F.when(F.size(_lines(F.col("markdown"))) < 2, F.array().cast("array<string>")).otherwise(cells)
    return rows.select("doc_id", "page", F.concat(F.lit("table_vision_"), F.col("i")).alias("table_id"), "markdown", heads.alias("headers"), n_rows(F.col("markdown")).alias("num_rows"), n_cols(F.col("markdown")).alias("num_cols"), F.lit("complex").alias("table_type"), F.lit(0.85).alias("confidence"))


def is_numerical(query: Column) -> Column:
    return T.contains_any(F.lower(query), NUMERICAL)


def score(query: Column, heads: Column, markdown: Column) -> Column:
    """0.3 for each header within the question (an empty one always is), 0.5 for the question within the table, 0.2 if numerical."""
    matched = F.filter(heads, lambda h: F.contains(F.lower(query), F.lower(h)))
    total = F.aggregate(matched, F.lit(0.0), lambda s, _: s + HEADER_SCORE)
    total = total + F.when(F.contains(F.lower(markdown), F.lower(query)), CONTENT_SCORE).otherwise(0.0)
    return total + F.when(is_numerical(query), NUMERICAL_SCORE).otherwise(0.0)


def retrieve(questions: DataFrame, tables: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The best tables and chunks of each question's collection: tables first on ties, then in order of position.

    questions: question_id, collection, text. tables: collection, table_pos, markdown, headers. chunks: collection, chunk_pos, text.
    """
    q = questions.select("question_id", "collection", F.col("text").alias("_q"))
    t = q.where(is_numerical(F.col("_q"))).join(tables, "collection").withColumn("score", score(F.col("_q"), F.col("headers"), F.col("markdown")))
    t = t.where(F.col("score") > LEAST_SCORE).select("question_id", F.lit("table").alias("type"), F.lit(0).alias("_o"), F.col("table_pos").alias("pos"), F.col("markdown").alias("content"), "score")
    c = q.join(chunks.withColumnRenamed("text", "_c"), "collection").where(F.contains(F.lower("_c"), F.lower("_q")))
    c = c.select("question_id", F.lit("text").alias("type"), F.lit(1).alias("_o"), F.col("chunk_pos").alias("pos"), F.substring("_c", 1, 500).alias("content"), F.lit(TEXT_SCORE).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "_o", "pos")
    return t.unionByName(c).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_o")


def first_source(tables: DataFrame) -> DataFrame:
    """Of tables tagged with the priority of their source, those of the first source that gave any for the document."""
    best = F.min("priority").over(Window.partitionBy("doc_id"))
    return tables.withColumn("_best", best).where("priority = _best").drop("_best")
