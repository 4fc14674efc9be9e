"""A query for each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, claims, feedback, graph, grids, metrics, retrieval, routing, scoping, tables
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..session import cut, new_path
from ..sources.store import PointStore
from .views import view

V = view


def _joined(column: str) -> F.Column:
    return F.array_join(column, "|")


def route_intents(s: SparkSession, d: str) -> DataFrame:
    routed = routing.classify(V(s, d, "questions").where(F.trim("text") != ""))
    return routed.select("question_id", "intent", "strategy", "confidence", "reasoning", _joined("keywords_matched").alias("keywords"))


def route_gate(s: SparkSession, d: str) -> DataFrame:
    limits = dict.fromkeys(routing.THRESHOLDS, 0.55)
    return routing.gate(routing.classify(V(s, d, "questions")), limits).select("question_id", "intent", "strategy", "confidence")


def route_distribution(s: SparkSession, d: str) -> DataFrame:
    return routing.classify(V(s, d, "questions")).groupBy("intent", "strategy").agg(F.count(F.lit(1)).alias("n"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return routing.classify(V(s, d, "questions")).select("question_id", F.col("expected_intent").alias("expected"), F.col("intent").alias("predicted"))


def intent_metrics(s: SparkSession, d: str) -> DataFrame:
    out = metrics.per_class(_labelled(s, d), list(routing.INTENTS))
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def intent_accuracy(s: SparkSession, d: str) -> DataFrame:
    return metrics.overall(_labelled(s, d)).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def intent_failures(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d).where("expected <> predicted")


def latency_summary(s: SparkSession, d: str) -> DataFrame:
    out = metrics.latency(V(s, d, "orders"), "o_totalprice", "o_orderpriority")
    return out.select("o_orderpriority", F.round("mean", 4).alias("mean"), "p95")


def claim_decomposition(s: SparkSession, d: str) -> DataFrame:
    return claims.decompose(V(s, d, "answers")).withColumn("claim_pos", F.col("claim_pos").cast("int"))


def document_sentences(s: SparkSession, d: str) -> DataFrame:
    docs = V(s, d, "documents").select("doc_id", "text")
    return claims.sentences(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.char_length("text")).alias("n_chars"))


def _verified(s: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return claims.verify_answers(V(s, d, "answers"), V(s, d, "contexts"), strict=strict)


def verify_claims(s: SparkSession, d: str) -> DataFrame:
    return _verified(s, d).select("answer_id", "claim_pos", "claim_type", "verified", "method", "confidence_after")


def verified_answers(s: SparkSession, d: str) -> DataFrame:
    return claims.regenerate(_verified(s, d)).withColumn("confidence", F.round("confidence", 6))


def method_distribution(s: SparkSession, d: str) -> DataFrame:
    return metrics.distribution(_verified(s, d), "method")


def type_distribution(s: SparkSession, d: str) -> DataFrame:
    return metrics.distribution(_verified(s, d), "claim_type")


def verification_totals(s: SparkSession, d: str) -> DataFrame:
    rows = _verified(s, d)
    return rows.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("verified").alias("n_verified"), F.round(F.avg(F.col("verified").cast("double")), 6).alias("rate"))


def faithfulness(s: SparkSession, d: str) -> DataFrame:
    return metrics.faithfulness(_verified(s, d)).withColumn("faithfulness", F.round("faithfulness", 6))


def extractions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return V(s, d, "statements").select(
        "doc_id", F.round(T.primary_number(t), 4).alias("first_number"), F.round(T.percentage(t), 6).alias("percentage"), T.date_text(t).alias("date_text"), F.round(T.confidence(t), 6).alias("confidence"),
        T.json_array(t).alias("json_array"), _joined(T.raw_numbers(t)).alias("raw_numbers"), F.size(T.numbers(t)).alias("n_numbers"), F.round(F.array_max(T.numbers(t)), 4).alias("max_number"),
    )


def document_extractions(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return V(s, d, "documents").select("doc_id", F.size(T.raw_numbers(t)).alias("n_numbers"), F.size(T.numbers(t)).alias("n_scaled"))


def dense_top_k(s: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(V(s, d, "vector_queries"), retrieval.upsert_latest(V(s, d, "points")), 20).withColumn("score", F.round("score", 6))


def scoped_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(V(s, d, "vector_queries"), retrieval.upsert_latest(V(s, d, "points")), 5, ticker="label").withColumn("score", F.round("score", 6))


def upsert_points(s: SparkSession, d: str) -> DataFrame:
    out = retrieval.upsert_latest(V(s, d, "points"))
    return out.select("collection", "point_id", "ingest_seq", "label")


def lexical_top_k(s: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_top_k(V(s, d, "text_queries"), V(s, d, "documents"), 20).withColumn("score", F.round("score", 6))


def lexical_idf_top_k(s: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_top_k(V(s, d, "text_queries"), V(s, d, "documents"), 20, use_idf=True).withColumn("score", F.round("score", 6))


def vector_index_top_k(s: SparkSession, d: str) -> DataFrame:
    """Approximate top-k from an index of all points; its recall against dense_top_k is tested."""
    points = cut(retrieval.upsert_latest(V(s, d, "points")))
    index = VectorIndex(s, new_path(s, "vector-index"))
    index.build(points, len(points.where("dense is not null").select("dense").first()[0]))
    index.calibrate(points)
    return index.search(V(s, d, "vector_queries"), 20).withColumn("score", F.round("score", 6))


def text_index_top_k(s: SparkSession, d: str) -> DataFrame:
    index = TextIndex(s, new_path(s, "text-index"))
    index.build(V(s, d, "documents"))
    return index.search(V(s, d, "text_queries"), 20).withColumn("score", F.round("score", 6))


def text_index_idf_top_k(s: SparkSession, d: str) -> DataFrame:
    index = TextIndex(s, new_path(s, "text-index"))
    index.build(V(s, d, "documents"))
    return index.search(V(s, d, "text_queries"), 20, use_idf=True).withColumn("score", F.round("score", 6))


def store_points(s: SparkSession, d: str) -> DataFrame:
    """Three ingests of a store, the second compacted: what a scan then gives."""
    rows = V(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("long").alias("point_id"), F.col("label").cast("string").alias("ticker"), F.col("embedding").alias("dense"))
    store = PointStore(s, new_path(s, "points"), len(rows.first().dense))
    store.ingest("main", rows.withColumn("text", F.lit("first")))
    store.ingest("main", rows.withColumns({"text": F.lit("second"), "point_id": F.col("point_id") * 2}))
    store.compact("main")
    store.ingest("main", rows.withColumns({"text": F.lit("third"), "point_id": F.col("point_id") * 3}))
    return store.scan("main").select("point_id", "text", "ticker", F.round(F.get("dense", F.lit(0)).cast("double"), 5).alias("first_value"))


def _two_rankings(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dense = retrieval.dense_top_k(V(s, d, "vector_queries"), retrieval.upsert_latest(V(s, d, "points")), 20)
    sparse = retrieval.lexical_top_k(V(s, d, "text_queries"), V(s, d, "documents"), 20)
    return dense, sparse


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(*_two_rankings(s, d)).withColumn("score", F.round("score", 9))


def weighted_hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(*_two_rankings(s, d), alpha=0.7).withColumn("score", F.round("score", 9))


def _overlap(s: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    """A deterministic scorer in place of a cross-encoder: distinct terms that a candidate's text shares with its question."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    asked = V(s, d, "text_queries").select("question_id", words(F.col("text")).alias("_q"))
    docs = V(s, d, "documents").select(F.col("doc_id").cast("long").alias("point_id"), F.col("text").alias("_t"))
    both = candidates.select("question_id", "point_id").join(asked, "question_id").join(docs, "point_id", "left")
    shared = F.coalesce(F.size(F.array_intersect("_q", words(F.col("_t")))), F.lit(0))
    return both.select("question_id", "point_id", F.when(F.col("_t").isNull(), 0).otherwise(shared).cast("double").alias("ce"))


def rerank(s: SparkSession, d: str) -> DataFrame:
    found = cut(retrieval.lexical_top_k(V(s, d, "text_queries"), V(s, d, "documents"), 20))
    return retrieval.rerank(found, _overlap(s, d, found), 5)


def _scored(s: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    """ce of every candidate; 0 without a question or a text."""
    return fused.select("question_id", "point_id").join(_overlap(s, d, fused), ["question_id", "point_id"], "left").fillna(0.0, ["ce"])


def hybrid_rerank(s: SparkSession, d: str) -> DataFrame:
    dense, sparse = _two_rankings(s, d)
    return retrieval.search(dense, sparse, V(s, d, "points"), lambda fused: _scored(s, d, fused))


def hybrid_rerank_diverse(s: SparkSession, d: str) -> DataFrame:
    points, asked = retrieval.upsert_latest(V(s, d, "points")), V(s, d, "vector_queries")
    dense = retrieval.dense_top_k(asked, points, 20)
    second = retrieval.dense_top_k(asked.withColumn("embedding", F.reverse("embedding")), points, 20)
    ce = lambda fused: fused.select("question_id", "point_id", (F.col("point_id") % 7).cast("double").alias("ce"))
    return retrieval.search(dense, second, points, ce, asked, 5, 20, 0.7)


def ticker_hybrid_search(s: SparkSession, d: str) -> DataFrame:
    asked, docs = V(s, d, "ticker_questions"), V(s, d, "ticker_documents")
    ce = lambda fused: fused.select("question_id", "point_id", (F.col("point_id") % 11).cast("double").alias("ce"))
    return retrieval.ticker_search(asked, retrieval.upsert_latest(V(s, d, "points")), docs, ce, "label")


def answer_payload(s: SparkSession, d: str) -> DataFrame:
    docs = V(s, d, "documents").select(F.col("doc_id").cast("long").alias("point_id"), "text", "source", F.col("lang").alias("section"))
    out = retrieval.payload(retrieval.lexical_top_k(V(s, d, "text_queries"), V(s, d, "documents"), 5), docs, ["source", "section"])
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("/", F.coalesce(c["source"], F.lit("-")), F.coalesce(c["section"], F.lit("-")))), "|")
    return out.select("question_id", F.round("score", 6).alias("score"), F.md5("context").alias("context_md5"), F.size("nodes").alias("n_nodes"), cited.alias("citations"))


def answer_claims(s: SparkSession, d: str) -> DataFrame:
    rows = claims.payload(_verified(s, d))
    told = F.transform("claims", lambda c: F.concat_ws(":", F.substring(c["text"], 1, 80), c["type"], c["verified"].cast("string"), c["method"]))
    return rows.select("answer_id", F.array_join(told, "|").alias("claims"))


def strategy_contexts(s: SparkSession, d: str) -> DataFrame:
    from .pipeline import dispatch

    simple = V(s, d, "contexts").withColumnRenamed("answer_id", "question_id")
    found = dispatch(routing.classify(V(s, d, "questions")), simple, V(s, d, "table_contexts"), V(s, d, "graph_contexts"))
    return found.withColumn("ctx_pos", F.col("ctx_pos").cast("long"))


def told_claims(s: SparkSession, d: str) -> DataFrame:
    return claims.decompose_told(V(s, d, "told_answers")).withColumn("claim_pos", F.col("claim_pos").cast("int"))


def told_answers(s: SparkSession, d: str) -> DataFrame:
    return claims.answer_told(V(s, d, "answers"), V(s, d, "contexts"), V(s, d, "told_texts")).withColumn("confidence", F.round("confidence", 6))


def semantic_claims(s: SparkSession, d: str) -> DataFrame:
    told = V(s, d, "vector_queries").select(F.col("label").alias("answer_id"), F.col("question_id").alias("claim_pos"), "embedding")
    shown = V(s, d, "embeddings").where("label is not null").select(F.col("label").alias("answer_id"), F.reverse("embedding").alias("embedding"))
    return claims.verify_semantic(told, shown).withColumns({c: F.round(c, 6) for c in ("similarity", "confidence_after")})


def verifier_checks(s: SparkSession, d: str) -> DataFrame:
    return metrics.case_checks(V(s, d, "cases"), _verified(s, d))


def verifier_totals(s: SparkSession, d: str) -> DataFrame:
    return metrics.check_totals(metrics.case_checks(V(s, d, "cases"), _verified(s, d))).withColumn("rate", F.round("rate", 6))


def e2e_summary(s: SparkSession, d: str) -> DataFrame:
    routed = routing.classify(V(s, d, "questions"))
    verified = _verified(s, d)
    rows = routed.select("question_id", (F.col("intent") == F.col("expected_intent")).alias("intent_ok"), (F.col("strategy") != "simple_rag").alias("strategy_ok"))
    for part in (metrics.faithfulness(verified), claims.regenerate(verified).select("answer_id", "answer")):
        rows = rows.join(part.withColumnRenamed("answer_id", "question_id"), "question_id", "left")
    out = metrics.end_to_end(rows.fillna(0.0, ["faithfulness"]))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("intent_accuracy", "strategy_accuracy", "faithfulness")], "all_answered")


def graph_questions(s: SparkSession, d: str) -> DataFrame:
    return graph.ask(V(s, d, "graph_questions"), V(s, d, "graph_edges"), limit=None)


def odd_tables(s: SparkSession, d: str) -> DataFrame:
    docs = V(s, d, "odd_docs")
    out = tables.parsed(docs).join(docs, "doc_id")
    return out.select("doc_id", "table_pos", _joined("headers").alias("headers"), "num_rows", "num_cols", "table_type", "confidence", tables.page_of(F.col("markdown"), F.col("text")).alias("page"))


def diverse_top_k(s: SparkSession, d: str) -> DataFrame:
    points = retrieval.upsert_latest(V(s, d, "points"))
    found = retrieval.dense_top_k(V(s, d, "vector_queries"), points, 10)
    both = found.withColumn("relevance", F.col("score")).join(points.select("point_id", F.col("dense").cast("array<double>").alias("dense")), "point_id")
    return retrieval.mmr(both, 5).withColumn("score", F.round("score", 6))


def table_blocks(s: SparkSession, d: str) -> DataFrame:
    return tables.blocks(V(s, d, "md_docs"))


def table_description(s: SparkSession, d: str) -> DataFrame:
    docs = V(s, d, "md_docs")
    out = tables.describe(tables.blocks(docs)).join(docs, "doc_id")
    return out.select("doc_id", "table_pos", _joined("headers").alias("headers"), "num_rows", "num_cols", "table_type", tables.page_of(F.col("markdown"), F.col("text")).alias("page"))


def _grids(s: SparkSession, d: str) -> DataFrame:
    cells = V(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.transform("r", lambda x: F.when(x["n_nationkey"] % 3 == 0, F.array(x["n_name"])).otherwise(F.array(F.concat(F.lit(" "), x["n_name"]), x["n_nationkey"].cast("string"), F.lit("extra"))))
    grid = F.concat(F.array(F.array(F.lit("Nation "), F.lit(None).cast("string"))), body)
    return cells.select(F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("grid_pos"), grid.alias("grid"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


def grid_tables(s: SparkSession, d: str) -> DataFrame:
    return tables.grids(_grids(s, d)).select("doc_id", "table_no", "markdown", "num_rows", "num_cols", F.col("bbox.y2").alias("height"))


def detected_tables(s: SparkSession, d: str) -> DataFrame:
    """Tables found from the words of pages: a customer's orders below a line of prose, and a page without a table."""
    words = V(s, d, "page_words").select("doc_id", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom")], "text", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    found = tables.grids(grids.detect(words))
    return found.select("doc_id", F.col("page").cast("int").alias("page"), F.col("table_no").cast("int").alias("table_no"), F.md5("markdown").alias("markdown_md5"), "num_rows", "num_cols")


def model_tables(s: SparkSession, d: str) -> DataFrame:
    out = tables.parse_response(V(s, d, "responses"))
    return out.select("doc_id", "table_id", "markdown", _joined("headers").alias("headers"), "num_rows", "num_cols", "confidence")


def _table_questions(s: SparkSession, d: str) -> DataFrame:
    regions = V(s, d, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    texts = F.array(F.lit("table of nation key"), F.lit("nation key"), F.lit("prose"), F.lit("| nation | key |"), F.lit("how much prose is in the figure"))
    return regions.select((F.col("k") * 10).alias("_b"), F.col("k").alias("collection"), F.posexplode(texts).alias("_i", "text")).select((F.col("_b") + F.col("_i")).alias("question_id"), "collection", "text")


def table_retrieval(s: SparkSession, d: str) -> DataFrame:
    docs = V(s, d, "md_docs")  # a collection is a region's documents, whose ids end in its key
    collection, order = F.pmod("doc_id", F.lit(100)).cast("long").alias("collection"), F.floor(F.col("doc_id") / 100).cast("int")
    found = tables.describe(tables.blocks(docs)).select(collection, (order * 10 + F.col("table_pos")).alias("table_pos"), "markdown", "headers")
    chunks = docs.select(collection, order.alias("chunk_pos"), "text")
    return tables.retrieve(_table_questions(s, d), found, chunks).withColumn("score", F.round("score", 6))


def source_cascade(s: SparkSession, d: str) -> DataFrame:
    # documents from 200 on have no parsed table, those from 300 on no grid either
    more = lambda df, *shifts: df.withColumn("doc_id", F.explode(F.array(*[F.col("doc_id") + x for x in shifts])))
    parsed = tables.blocks(V(s, d, "md_docs")).select("doc_id", F.lit(0).alias("priority"), "markdown")
    read = more(tables.grids(_grids(s, d)), 0, 200).select("doc_id", F.lit(1).alias("priority"), "markdown")
    seen = more(tables.parse_response(V(s, d, "responses")), 0, 200, 300).select("doc_id", F.lit(2).alias("priority"), "markdown")
    return tables.first_source(parsed.unionByName(read).unionByName(seen))


def token_chunks(s: SparkSession, d: str) -> DataFrame:
    out = chunking.token_windows(V(s, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_pos", F.md5("text").alias("text_md5"))


def char_chunks(s: SparkSession, d: str) -> DataFrame:
    out = chunking.char_windows(V(s, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_pos", F.md5("text").alias("text_md5"))


def graph_input_chunks(s: SparkSession, d: str) -> DataFrame:
    """What a graph model is fed: the first MAX_DOCS windows of each document, which is the feature."""
    out = chunking.char_windows(V(s, d, "documents").select("doc_id", "text"), max_docs=chunking.MAX_DOCS)
    return out.select("doc_id", "chunk_pos", F.md5("text").alias("text_md5"))


def text_splits(s: SparkSession, d: str) -> DataFrame:
    return chunking.text_splits(V(s, d, "documents").select("doc_id", "text"))


def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.normalise(V(s, d, "graph_json"))[0].withColumn("pos", F.col("pos").cast("int"))


def graph_relationships(s: SparkSession, d: str) -> DataFrame:
    return graph.normalise(V(s, d, "graph_json"))[1].withColumn("pos", F.col("pos").cast("int"))


def repaired_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.normalise(V(s, d, "broken_graphs"))[0].withColumn("pos", F.col("pos").cast("int"))


def repaired_relationships(s: SparkSession, d: str) -> DataFrame:
    return graph.normalise(V(s, d, "broken_graphs"))[1].withColumn("pos", F.col("pos").cast("int"))


def graph_paths(s: SparkSession, d: str) -> DataFrame:
    """From every supplier one to three edges to places, as nodes and types."""
    starts = V(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("start"))
    found = graph.paths(V(s, d, "graph_edges"), starts, [graph.Step(("LOCATED_IN", "PART_OF"), 1, 3)])
    return found.select("start", _joined("nodes").alias("nodes"), _joined("types").alias("types"))


def graph_path_pattern(s: SparkSession, d: str) -> DataFrame:
    """Up to three other suppliers of each supplier's region: along to the region, and back to suppliers."""
    starts = V(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("start"))
    steps = [graph.Step(("LOCATED_IN", "PART_OF"), 1, 2, node_type="Region"), graph.Step(("PART_OF",), against=True), graph.Step(("LOCATED_IN",), against=True, node_type="Supplier")]
    return graph.paths(V(s, d, "graph_edges"), starts, steps, limit=3, kept=cut).select("start", _joined("nodes").alias("nodes"), _joined("types").alias("types"))


def graph_mentions(s: SparkSession, d: str) -> DataFrame:
    return graph.load(*graph.normalise(V(s, d, "graph_json")))[2]


def graph_neighbours(s: SparkSession, d: str) -> DataFrame:
    starts = V(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("start"))
    return graph.neighbour_counts(V(s, d, "graph_edges"), starts)


def graph_two_hops(s: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(V(s, d, "graph_edges"), "LOCATED_IN", "PART_OF")


def graph_reachable(s: SparkSession, d: str) -> DataFrame:
    starts = V(s, d, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("start"))
    return graph.reachable(V(s, d, "graph_edges"), starts, 3, cut).groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n"))


def feedback_success(s: SparkSession, d: str) -> DataFrame:
    return feedback.success(V(s, d, "feedback")).withColumn("success_rate", F.round("success_rate", 6))


def adaptive_thresholds(s: SparkSession, d: str) -> DataFrame:
    return feedback.thresholds(feedback.numbered(V(s, d, "feedback"), "ts", "seq"))


def metric_drift(s: SparkSession, d: str) -> DataFrame:
    """Two measures of each return flag's lines: the price after discount against the list price, and half of the quantity."""
    rows = V(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_extendedprice").alias("p0"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p1"),
        F.avg("l_quantity").alias("q0"), F.avg(F.col("l_quantity") / 2).alias("q1"))
    told = lambda p, q: rows.select(F.inline(F.array(*[F.struct(F.concat("l_returnflag", F.lit(f" {n}")).alias("metric"), F.col(c).alias("value")) for n, c in (("price", p), ("quantity", q))])))
    out = metrics.drift(told("p1", "q1"), told("p0", "q0"), "metric")
    return out.select("metric", F.round("drop", 6).alias("drop"), "alert")


def _scoped(s: SparkSession, d: str) -> DataFrame:
    asked = V(s, d, "vector_queries").select("question_id", F.col("label").cast("string").alias("ticker"), F.lit(2024).alias("year"), F.when(F.col("question_id") % 3 == 0, "10-Q").otherwise("10-K").alias("type"), F.array(F.lit("risk"), F.lit("income")).alias("sections"), F.lit(0.9).alias("confidence"))
    known = V(s, d, "embeddings").select(F.col("label").cast("string").alias("ticker")).distinct().select("ticker", F.lit(2024).alias("year"), F.lit("10-K").alias("type"), F.array(F.lit("income"), F.lit("notes")).alias("known_sections"))
    return scoping.scope(asked, known)


def document_scope(s: SparkSession, d: str) -> DataFrame:
    return _scoped(s, d).withColumn("sections", _joined("sections"))


def document_scoped_search(s: SparkSession, d: str) -> DataFrame:
    points = retrieval.upsert_latest(V(s, d, "points")).select("point_id", "dense", F.col("label").cast("string").alias("ticker"))
    return scoping.scoped_top_k(_scoped(s, d), V(s, d, "vector_queries"), points).withColumn("score", F.round("score", 6))


def section_scoped_search(s: SparkSession, d: str) -> DataFrame:
    """Within a sure scope's sections twice as many as without, for a reranker; over all points where the scope is unsure."""
    section = F.element_at(F.array(F.lit("risk"), F.lit("income"), F.lit("notes")), (F.pmod("point_id", F.lit(3)) + 1).cast("int"))
    points = retrieval.upsert_latest(V(s, d, "points")).select("point_id", "dense", F.col("label").cast("string").alias("ticker"), section.alias("section"))
    return scoping.scoped_top_k(_scoped(s, d), V(s, d, "vector_queries"), points, 5, within=10).withColumn("score", F.round("score", 6))


def answer_questions(s: SparkSession, d: str) -> DataFrame:
    """Route, pick contexts by strategy, decompose a draft, verify, and answer from what was verified."""
    from .pipeline import answer

    return answer(V(s, d, "questions"), V(s, d, "answers"), V(s, d, "contexts"))


QUERIES = {f.__name__: f for f in (
    route_intents, route_gate, route_distribution, intent_metrics, intent_accuracy, intent_failures, latency_summary, claim_decomposition, document_sentences, verify_claims, verified_answers,
    method_distribution, type_distribution, verification_totals, faithfulness, extractions, document_extractions, dense_top_k, scoped_search, upsert_points, lexical_top_k, lexical_idf_top_k,
    hybrid_search, weighted_hybrid_search, rerank, diverse_top_k, table_blocks, table_description, grid_tables, model_tables, table_retrieval, source_cascade, token_chunks, char_chunks,
    hybrid_rerank, hybrid_rerank_diverse, ticker_hybrid_search, answer_payload, answer_claims, strategy_contexts, told_claims, told_answers, semantic_claims, verifier_checks, verifier_totals, e2e_summary,
    graph_questions, odd_tables, graph_input_chunks, text_splits, graph_nodes, graph_relationships, graph_mentions, graph_neighbours, graph_two_hops, graph_reachable, feedback_success, adaptive_thresholds, metric_drift, document_scope, document_scoped_search, answer_questions, vector_index_top_k, text_index_top_k, text_index_idf_top_k, store_points, repaired_nodes, repaired_relationships, graph_paths, graph_path_pattern, detected_tables, section_scoped_search,
)}
