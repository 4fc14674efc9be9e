"""Sources, sinks, providers and the engine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from finlattice.functions import providers
from finlattice.plans.engine import Engine
from finlattice.sources import files
from finlattice.sources.store import PointStore, positions


def test_pdfs_through_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one|two")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 trailer /Encrypt 5 0 R")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parser(content: bytes) -> list[str]:
        if b"/Encrypt" in content:
            raise ValueError("locked")
        return content.decode().split("|")

    got = {r.path[-5:]: r.text for r in files.read_pdfs(spark, str(tmp_path), parser).collect()}
    assert got == {"a.pdf": "%PDF-1.4 onetwo", "b.pdf": None}
    locked = {r.path[-5:]: r.encrypted for r in files.encrypted(spark, str(tmp_path)).collect()}
    assert locked == {"a.pdf": False, "b.pdf": True, "c.txt": None}


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "second"), (1, 0, "first")], "doc_id int, chunk_pos int, text string")
    files.save_chunks(chunks, str(tmp_path / "chunks"))
    assert [r.value for r in spark.read.text(str(tmp_path / "chunks")).collect()] == ["first", "second"]
    files.save_json(chunks, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert files.choose_table_source(False, False, True) == "vision" and files.choose_table_source(True, True, True) == "local"


def test_store_replaces_by_id(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"), 2)
    rows = lambda n, mark: spark.createDataFrame([(k, f"{mark}{k}", [1.0, float(k)]) for k in range(n)], "point_id long, text string, dense array<float>")
    store.ingest("c", rows(4, "old"))
    store.ingest("c", rows(2, "new"))
    store.ingest("d", rows(1, "d"))
    assert sorted(r.text for r in store.scan("c").collect()) == ["new0", "new1", "old2", "old3"]
    chunks = spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (9, 0, "c")], "doc_id int, chunk_pos int, text string")
    assert sorted((r.point_id, r.text) for r in positions(chunks).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_positions_of_string_ids(spark, monkeypatch):
    from finlattice.sources import store

    monkeypatch.setattr(store, "SPAN", 3)
    chunks = spark.createDataFrame([(f"/same/prefix/{k:02}", j, f"{k}-{j}") for k in range(20) for j in range(k % 3 + 1)], "doc_id string, chunk_pos int, text string").repartition(4)
    got = [r.text for r in positions(chunks).orderBy("point_id").collect()]
    assert got == [f"{k}-{j}" for k in range(20) for j in range(k % 3 + 1)]
    assert sorted(r.point_id for r in positions(chunks).collect()) == list(range(len(got)))


def test_store_base_deltas_and_replay(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"), 1)
    rows = lambda ids, mark: spark.createDataFrame([(k, f"{mark}{k}", [1.0]) for k in ids], "point_id long, text string, dense array<float>")
    texts = lambda: sorted(r.text for r in store.scan("a/b").collect())
    assert texts() == [] and store.scan().count() == 0
    store.compact("a/b")
    assert store.ingest("a/b", rows(range(4), "x"), "s-0") == 0
    assert store.ingest("a/b", rows(range(4), "again"), "s-0") is None  # a replay of what is done
    assert texts() == ["x0", "x1", "x2", "x3"]
    store.compact("a/b")
    plan = store.scan("a/b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    store.ingest("a/b", rows([1, 9], "y"))
    store.ingest("a/b", rows([9], "z"))
    assert texts() == ["x0", "x2", "x3", "y1", "z9"]
    assert "SortMergeJoin" not in store.scan("a/b")._jdf.queryExecution().executedPlan().toString()
    store.compact("a/b")
    store.compact("a/b")
    assert texts() == ["x0", "x2", "x3", "y1", "z9"]
    # a batch that was cut off after it took its number writes the same folder again
    store.files.write(f"{tmp_path}/points/batches/collection=a%2Fb/s-1", "3")
    assert store.ingest("a/b", rows([0], "p"), "other") == 4
    assert store.ingest("a/b", rows([0, 2], "q"), "s-1") == 3
    assert texts() == ["p0", "q2", "x3", "y1", "z9"]
    assert store.collections() == ["a/b"] and store.scan().count() == 5
    with pytest.raises(Exception, match="vectors must have 1"):
        store.ingest("a/b", spark.createDataFrame([(1, "x", [1.0, 2.0])], "point_id long, text string, dense array<float>"))


def test_stream_ingest_and_replay(spark, tmp_path):
    from finlattice.streaming import ingest

    engine = Engine(spark, str(tmp_path / "e"), providers.Config(generator=Model()))
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in DOCS:
        (folder / f"{k}.txt").write_text(text)
    (folder / "no.md").write_text("left out")
    run = lambda: ingest.into(engine, ingest.text_files(spark, str(folder)), str(tmp_path / "check")).awaitTermination()
    run()
    state = lambda: (sorted(r.text for r in engine.store.scan("default").collect()), sorted(map(tuple, engine.graph.read("edges", "default").collect())), engine.spark.read.parquet(engine._tables).count())
    first = state()
    assert len(first[0]) == 3 and first[2] == 1 and len(first[1]) == 1
    run()
    assert state() == first  # nothing new
    batch = spark.createDataFrame([(f"file:{folder}/{k}.txt", t) for k, t in DOCS], "doc_id string, text string")
    assert set(engine.ingest(batch, "files-0").values()) == {"ok"}  # the batch comes again
    assert state() == first
    (folder / "4.txt").write_text("Cherries are red and grow on trees in spring.")
    run()
    assert len(state()[0]) == 4
    broken = Engine(spark, str(tmp_path / "e2"), providers.Config(dim=3))
    with pytest.raises(Exception, match="batch 0"):
        ingest.into(broken, ingest.text_files(spark, str(folder)), str(tmp_path / "check2")).awaitTermination()


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, text string")
    got = {r.id: r.dense for r in providers.embed(rows, providers.HashingEmbedder(8)).collect()}
    assert got[1] == got[2] and sum(got[1]) == 2 and sum(got[3]) == 0

    def model(prompt: str) -> str:
        if prompt == "bad":
            raise RuntimeError
        return prompt.upper()

    asked = providers.generate(spark.createDataFrame([("x",), ("bad",)], "prompt string"), model)
    assert {r.prompt: r.response for r in asked.collect()} == {"x": "X", "bad": None}


DOCS = [(1, "Apple reported revenue of $383B in fiscal year 2024. The buyer files reports with the SEC."), (2, "Bananas are yellow fruit. They grow in warm places."), (3, "x\n| segment revenue | b |\n|---|---|\n| 1 | 2 |\nend")]


class Model:
    """Graph JSON for chunks, a fixed answer for questions."""

    def generate(self, prompt: str) -> str:
        if "Question:" in prompt:
            return "Apple reported revenue of $383B in fiscal year 2024. The moon is made of cheese."
        return '{"content": "```json {\\"nodes\\":[{\\"id\\":\\"Apple\\",\\"type\\":\\"Company\\"},{\\"id\\":\\"Banana Inc\\",\\"type\\":\\"Company\\"}],\\"relationships\\":[{\\"source\\":\\"Apple\\",\\"target\\":\\"Banana Inc\\",\\"type\\":\\"PARTNERS_WITH\\"}]} ```"}'


class Length:
    def score(self, question: str, texts: list[str]) -> list[float]:
        return [float(len(t)) for t in texts]


def test_engine_without_models(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    assert engine.ingest(docs) == {"vector": "ok", "table": "ok", "graph": "ok"}
    questions = spark.createDataFrame([(1, "Tell me about Apple"), (2, "Bananas?"), (3, " "), (4, "Show the breakdown of segment revenue in the table")], "question_id int, text string")
    got = {r.question_id: r for r in engine.query(questions).collect()}
    assert set(got) == {1, 2, 4} and "Apple" in got[1].answer and got[1].branch == "simple" and got[1].score > 0 and got[1].citations
    assert got[4].strategy == "multimodal_rag" and got[4].branch == "table" and "segment revenue" in got[4].contexts[0]
    assert {c.verified for c in got[2].claims} == {True} and got[2].answer_confidence > 0
    assert engine.query(questions.where("question_id = 3")).count() == 0
    names = {r.name: r.value for r in engine.evaluate(questions.where("question_id = 4").withColumn("expected", F.lit("numerical_table")), "all").collect()}
    assert names["intent.accuracy"] == 1.0 and names["e2e.all_answered"] == 1.0 and 0 <= names["verifier.verification_rate"] <= 1
    with pytest.raises(ValueError):
        engine.evaluate(questions, "other")
    engine.record_feedback(spark.createDataFrame([(1, "entity", 0.8, True)], "question_id int, intent string, confidence double, was_helpful boolean"))
    engine.record_feedback(spark.createDataFrame([(2, "entity", 0.8, False, "graphrag")], "question_id int, intent string, confidence double, was_helpful boolean, correct_strategy string"))
    assert sorted((r.question_id, r.was_helpful, r.correct_strategy) for r in engine.feedback.read().collect()) == [(1, True, None), (2, False, "graphrag")]


def test_engine_with_models(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), providers.Config(generator=Model(), reranker=Length(), diversity=None))
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    assert set(engine.ingest(docs).values()) == {"ok"} and set(engine.ingest(docs).values()) == {"ok"}
    assert sorted(map(tuple, engine.graph.read("edges", "default").collect())) == [("Apple", "Company", "Banana Inc", "Company", "PARTNERS_WITH")]
    engine.load_graph(spark.createDataFrame([(9, '{"nodes":[{"id":"Pear"}]}')], "doc_id int, json string"))
    assert {r.id for r in engine.graph.read("nodes", "default").collect()} == {"Apple", "Banana Inc", "Pear"}
    questions = spark.createDataFrame([(1, "What was the revenue of Apple in 2024?"), (2, "Who are the partners of Apple?")], "question_id int, text string")
    got = {r.question_id: r for r in engine.query(questions).collect()}
    assert got[2].strategy == "graphrag" and got[2].branch == "graph" and got[2].contexts == ["Apple partners with Banana Inc"]
    assert "cheese" in got[1].draft and "cheese" not in got[1].answer and "$383B" in got[1].answer
    best = {r.question_id: r.text for r in engine.retrieve(questions).where("rank = 1").collect()}
    assert best[1] == DOCS[0][1]
    asked = questions.withColumn("ticker", F.lit("none"))
    assert engine.retrieve_by_ticker(asked).count() == 0
    assert engine.query_until_verified(questions.where("question_id = 1"), 1).count() == 1


def test_page_responses_and_table_reader(spark, tmp_path):
    from finlattice.operators import tables

    for k, content in enumerate((b"one|two", b"bad", b"three")):
        (tmp_path / f"d{k}.pdf").write_bytes(content)

    def render(content: bytes) -> list[bytes]:
        if content == b"bad":
            raise ValueError
        return content.split(b"|")

    def ask(image: bytes) -> str:
        if image == b"two":
            raise RuntimeError
        return f"| {image.decode()} | b |\n|---|---|\n| 1 | 2 |"

    every = files.page_responses(spark, str(tmp_path), render, ask)
    assert sorted((r.doc_id[-6:], r.page, r.response is None) for r in every.collect()) == [("d0.pdf", 1, False), ("d0.pdf", 2, True), ("d2.pdf", 1, False)]
    some = files.page_responses(spark, str(tmp_path), render, ask, [2, 5])
    assert [(r.page, r.response) for r in some.collect()] == [(2, None)]
    assert sorted(r.num_rows for r in tables.parse_response(every.where("response is not null")).collect()) == [1, 1]
    with pytest.raises(FileNotFoundError):
        files.read_pdfs(spark, str(tmp_path / "none"))
    built = []

    def local():
        built.append("local")
        return lambda docs: docs.limit(0)

    reader = files.TableReader(local, prefer_local=False)
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert reader.source == "local" and not built and reader.read(docs).count() == reader.read(docs).count() == 0 and built == ["local"]
    assert files.TableReader(local, parse=local, vision=local).source == "parse" and files.TableReader(local, vision=local).source == "vision"
