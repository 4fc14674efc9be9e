"""The engine: ingest documents into a collection, answer questions from it by their strategy, take feedback, evaluate."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import Config, embed, generate, rerank_scores
from ..operators import chunking, claims, graph, metrics, retrieval, routing, tables
from ..sources.store import FeedbackLog, GraphStore, PointStore, positions
from .pipeline import NO_CONTEXT, dispatch

PROMPT = "Answer only from the context.\n\nContext:\n{}\n\nQuestion:\n{}\n\nAnswer:"
#: Results whose texts make up the context and that are cited.
CITED = 3


class Engine:
    """Set-based: questions, documents and claims are DataFrames throughout."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config, self.path = spark, config or Config(), path.rstrip("/")
        self.store = PointStore(spark, f"{self.path}/points", self.config.dim)
        self.graph = GraphStore(spark, f"{self.path}/graph")
        self.feedback = FeedbackLog(spark, f"{self.path}/feedback")
        self._tables = f"{self.path}/tables/collection={self.config.collection}"

    def _keep(self, rows: DataFrame) -> DataFrame:
        """rows as a table in the engine's folder, as several parts of an answer read them; `release` deletes these."""
        path = f"{self.path}/work/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def release(self) -> None:
        """Delete what answers given so far were made from; they can't be read any more."""
        self.store.files.delete(f"{self.path}/work")

    # ---- ingest

    def ingest(self, documents: DataFrame, batch: str | None = None) -> dict[str, str]:
        """Chunk, embed and store; extract tables; load a graph if a generator is set. Parts fail apart from each other.

        batch: a name under which these documents may come again, from a stream; a part that is done isn't done again. Points
        of batches are known by document and place, so a document that comes in a later batch replaces its own.
        """
        status = {}
        for name, part in (("vector", self._ingest_vectors), ("table", self._ingest_tables), ("graph", self._ingest_graph)):
            try:
                part(documents, batch)
                status[name] = "ok"
            except Exception as e:  # noqa: BLE001
                status[name] = f"failed: {str(e)[:200]}"
        return status

    def _ingest_vectors(self, documents: DataFrame, batch: str | None) -> None:
        chunks = chunking.as_documents(chunking.token_windows(documents))
        chunks = positions(chunks) if batch is None else chunks.withColumn("point_id", F.xxhash64("doc_id", "chunk_pos"))
        self.store.ingest(self.config.collection, embed(chunks, self.config.embedder), batch)

    def _ingest_tables(self, documents: DataFrame, batch: str | None) -> None:
        """Without a batch the collection's tables are these alone; a batch has a folder, which it writes anew if it comes again."""
        if batch is None:
            self.store.files.delete(self._tables)
        found = tables.parsed(documents).withColumn("doc_id", F.col("doc_id").cast("string"))
        found.write.mode("overwrite").parquet(f"{self._tables}/batch={quote(batch or 'all', safe='')}")

    def _ingest_graph(self, documents: DataFrame, batch: str | None) -> None:
        if self.config.generator is None:
            return
        chunks = chunking.char_windows(documents, max_docs=self.config.max_graph_chunks)
        told = generate(chunks.withColumnRenamed("text", "prompt"), self.config.generator)
        self.load_graph(told.withColumn("json", F.col("response")))  # repeats merge when read

    def load_graph(self, documents: DataFrame) -> None:
        """Merge the graphs of documents (doc_id, json) into the collection's."""
        self.graph.ingest(self.config.collection, *graph.load(*graph.normalise(documents)))

    # ---- retrieve

    def _search(self, questions: DataFrame, points: DataFrame, k: int, diversity: float | None, ticker: str | None = None) -> DataFrame:
        asked = embed(questions.where("text is not null"), self.config.embedder, to="embedding")
        docs = points.select(F.col("point_id").alias("doc_id"), "text", *([ticker] if ticker else []))

        def scores(fused: DataFrame) -> DataFrame:
            if self.config.reranker is None:  # the fused order stays
                return fused.select("question_id", "point_id", F.col("score").alias("ce"))
            texts = fused.select("question_id", "point_id").join(questions.select("question_id", F.col("text").alias("question")), "question_id").join(points.select("point_id", "text"), "point_id")
            return rerank_scores(texts, self.config.reranker)

        if ticker:
            return retrieval.ticker_search(asked, points, docs, scores, ticker, k)
        dense = retrieval.dense_top_k(asked, points, retrieval.CANDIDATES)
        sparse = retrieval.lexical_top_k(asked, docs, retrieval.CANDIDATES)
        return retrieval.search(dense, sparse, points, scores, asked, k, retrieval.CANDIDATES, diversity)

    def retrieve(self, questions: DataFrame, k: int | None = None, diversity: float | None = -1.0) -> DataFrame:
        """question_id, rank, point_id, score, text: dense and lexical candidates, fused, reranked, and diversified unless that is None."""
        points = self.store.scan(self.config.collection)
        found = self._search(questions, points, k or self.config.top, self.config.diversity if diversity == -1.0 else diversity)
        return found.join(points.select("point_id", "text"), "point_id").select("question_id", "rank", "point_id", "score", "text")

    def retrieve_by_ticker(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The same within each question's ticker (a column of questions), not diversified."""
        points = self.store.scan(self.config.collection)
        found = self._search(questions, points, k or self.config.top, None, "ticker")
        return found.join(points.select("point_id", "text"), "point_id").select("question_id", "rank", "point_id", "score", "text")

    def _table_contexts(self, questions: DataFrame) -> DataFrame:
        if not self.store.files.names(self._tables):
            return self.spark.createDataFrame([], "question_id long, ctx_pos int, text string")
        mine = self.spark.read.parquet(self._tables)
        found = mine.select(F.lit(0).alias("collection"), F.xxhash64("doc_id", "table_pos").alias("table_pos"), "markdown", "headers")
        none = self.spark.createDataFrame([], "collection int, chunk_pos long, text string")
        out = tables.retrieve(questions.select("question_id", F.lit(0).alias("collection"), "text"), found, none, self.config.top)
        return out.select("question_id", F.col("rank").alias("ctx_pos"), F.col("content").alias("text"))

    def contexts(self, questions: DataFrame, simple: DataFrame) -> DataFrame:
        """question_id, branch, ctx_pos, text: from graph or tables by each question's strategy, else from the search."""
        told = graph.ask(questions, self.graph.read("edges", self.config.collection))
        routed = routing.classify(questions).select("question_id", "strategy")
        return dispatch(routed, simple.select("question_id", F.col("rank").alias("ctx_pos"), "text"), self._table_contexts(questions), told)

    # ---- answer

    def query(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """A row for each question with text.

        question_id, intent, strategy, confidence, reasoning, branch, draft, answer, answer_confidence, claims, contexts, score,
        citations. The draft is the generator's, or the first contexts themselves; the answer is what of it was verified.
        """
        asked = questions.where(F.trim("text") != "")
        found = self._keep(self.retrieve(asked, k))
        contexts = self._keep(self.contexts(asked, found).withColumnRenamed("question_id", "answer_id"))
        kept = claims.gather_contexts(contexts).join(contexts.groupBy("answer_id").agg(F.first("branch").alias("branch")), "answer_id")
        head = F.array_join(F.slice("contexts", 1, CITED), "\n\n")
        drafts = kept.select("answer_id", head.alias("text"))
        if self.config.generator is not None:
            prompts = kept.join(asked.select(F.col("question_id").alias("answer_id"), F.col("text").alias("_q")), "answer_id")
            prompts = prompts.select("answer_id", head.alias("_h"), F.format_string(PROMPT.replace("{}", "%s"), F.array_join("contexts", "\n\n"), F.col("_q")).alias("prompt"))
            drafts = generate(prompts, self.config.generator).select("answer_id", F.coalesce("response", F.lit("")).alias("text"))
        drafts = self._keep(drafts)
        verified = self._keep(claims.verify_answers(drafts, contexts))
        done = claims.regenerate(verified).select("answer_id", F.col("answer"), F.col("confidence").alias("answer_confidence"))
        cited = retrieval.payload(found.select("question_id", "point_id", "rank", "score"), self.store.scan(self.config.collection).select("point_id", "text", "ticker"), ["point_id", "ticker"], CITED)
        out = routing.classify(asked).select("question_id", "intent", "strategy", "confidence", "reasoning")
        for part in (kept, drafts.withColumnRenamed("text", "draft"), done, claims.payload(verified)):
            out = out.join(part.withColumnRenamed("answer_id", "question_id"), "question_id", "left")
        out = out.join(cited.select("question_id", "score", "citations"), "question_id", "left")
        answer = F.when(F.col("contexts").isNull(), NO_CONTEXT).otherwise(F.coalesce("answer", F.lit(claims.REFUSAL)))
        return out.select(
            "question_id", "intent", "strategy", "confidence", "reasoning", "branch", F.coalesce("draft", F.lit("")).alias("draft"), answer.alias("answer"), F.coalesce("answer_confidence", F.lit(0.0)).alias("answer_confidence"),
            "claims", "contexts", F.coalesce("score", F.lit(0.0)).alias("score"), "citations",
        )

    def query_until_verified(self, questions: DataFrame, retries: int = 2) -> DataFrame:
        """query, and again with twice the results, up to `retries` times, for questions of whose draft nothing was verified."""
        done, left, k = None, questions, self.config.top
        for turn in range(retries + 1):
            answers = self._keep(self.query(left, k))
            fine = F.lit(True) if turn == retries else F.col("answer_confidence") > 0
            done = answers.where(fine) if done is None else done.unionByName(answers.where(fine))
            if turn < retries:
                left, k = left.join(answers.where(~fine).select("question_id"), "question_id", "left_semi"), 2 * k
                if not left.take(1):
                    break
        return done

    # ---- feedback and evaluation

    def record_feedback(self, routed: DataFrame) -> None:
        """routed: question_id, intent, confidence, was_helpful, and correct_strategy where known."""
        self.feedback.append(routed)

    def evaluate(self, labelled: DataFrame, component: str = "intent") -> DataFrame:
        """name, value: measures of intent (question_id, text, expected), verifier or e2e, or of all.

        The verifier takes the answers that questions get; e2e what they get against `expected` and, if there, `expected_strategy`.
        """
        out = answers = None
        for name in metrics.chosen(component):
            if name == "intent":
                row = metrics.overall(routing.classify(labelled).withColumnRenamed("intent", "predicted"))
            else:
                answers = answers or self._keep(self.query(labelled.select("question_id", "text")))
                rows = answers.join(labelled.drop("text"), "question_id")
                share = F.coalesce(F.try_divide(F.size(F.filter("claims", lambda c: c["verified"])).cast("double"), F.size("claims").cast("double")), F.lit(0.0))
                if name == "verifier":
                    row = rows.agg(F.sum(F.size("claims")).alias("n_claims"), F.avg(share).alias("verification_rate"))
                else:
                    strategy = F.col("strategy") == F.col("expected_strategy") if "expected_strategy" in labelled.columns else F.lit(True)
                    row = metrics.end_to_end(rows.select("question_id", (F.col("intent") == F.col("expected")).alias("intent_ok"), strategy.alias("strategy_ok"), share.alias("faithfulness"), "answer"))
            pairs = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns]))
            part = row.select(pairs.alias("m")).select("m.*")
            out = part if out is None else out.unionByName(part)
        return out
