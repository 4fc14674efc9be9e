"""Work that must not grow faster than the input: what plans hold and how many rows steps make."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from finlattice.functions import text as T
from finlattice.operators import claims, graph, grids, metrics, retrieval, routing, vector_index
from finlattice.operators.text_index import TextIndex
from finlattice.plans import pipeline, queries, views


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detected_tables_gather_pages_in_rows(spark):
    words = [(d, p, 50.0 + 100 * c, 100.0 + 14 * r, 60.0 + 100 * c, 110.0 + 14 * r, f"w{r}{c}", 600.0, 800.0) for d in (1, 2) for p in (1, 2) for r in range(3) for c in range(2)]
    found = grids.detect(spark.createDataFrame(words, "doc_id long, page int, x0 double, top double, x1 double, bottom double, text string, page_width double, page_height double"))
    assert sorted((r.doc_id, r.page, len(r.grid), r.box.x2) for r in found.collect()) == [(d, p, 3, 160.0) for d in (1, 2) for p in (1, 2)]
    assert "InPandas" not in plan(found)


def test_route_filters_evaluate_patterns_once(spark, sf_dir):
    patterns = sum(len(p) for _, _, p in routing.INTENTS.values())
    assert plan(queries.intent_failures(spark, sf_dir)).count("RLIKE") <= patterns


def test_distribution_counts_before_it_filters(spark, sf_dir):
    assert plan(queries.method_distribution(spark, sf_dir)).count("numerical_near_match") == 1
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "method string")
    assert sorted(map(tuple, metrics.distribution(rows, "method").collect())) == [("a", 2), ("b", 1)]


def test_limited_paths_equal_the_first_of_all(spark):
    rng = random.Random(3)
    rows = {(rng.choice("abcdef"), "T", rng.choice("abcdef"), rng.choice("PQ"), rng.choice("xy")) for _ in range(60)}
    edges = spark.createDataFrame(sorted(rows), "src string, src_type string, dst string, dst_type string, type string")
    starts = edges.select(F.col("src").alias("start")).distinct()
    for steps in ([graph.Step(("x",), 1, 2), graph.Step((), 0, 2, node_type="P")], [graph.Step(("x",)), graph.Step(("x",), against=True), graph.Step(("x", "y"), node_type="Q")]):
        every: dict[str, list] = {}
        for r in graph.paths(edges, starts, steps).collect():
            every.setdefault(r.start, []).append((len(r.types), r.nodes, r.types))
        got: dict[str, list] = {}
        for r in graph.paths(edges, starts, steps, limit=3).collect():
            got.setdefault(r.start, []).append((len(r.types), r.nodes, r.types))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:3] for k, v in every.items()}


def test_limited_paths_meet_few_last_edges(spark):
    rows = [(f"s{n}", "S", f"n{n % 2}", "N", "IN") for n in range(200)] + [("n0", "N", "r", "R", "OF"), ("n1", "N", "r", "R", "OF")]
    edges = spark.createDataFrame(rows, "src string, src_type string, dst string, dst_type string, type string")
    sizes: list[int] = []

    def kept(df):
        sizes.append(df.count())
        return df

    starts = edges.where("type = 'IN'").select(F.col("src").alias("start"))
    found = graph.paths(edges, starts, [graph.Step(("IN",)), graph.Step(("OF",)), graph.Step(("OF",), against=True), graph.Step(("IN",), against=True)], limit=3, kept=kept)
    assert found.count() == 600 and max(sizes) == 200
    assert "dense_rank" in plan(found)


def test_lexical_search_scores_within_tasks(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Tax", "cash", "the", "Rate", "q3", "loan", "x"]) for _ in range(n))
    docs = [(n, text(rng.randint(1, 12)), n % 2) for n in range(40)]
    docs += [(100 + n, docs[n][1], docs[n][2]) for n in range(10)] + [(200, None, 0), (201, "...", 0)]
    asked = [(n, text(4), n % 2) for n in range(6)] + [(6, "tax tax unknown", None), (7, "tax tax unknown", 0), (8, "none", 1), (9, None, 1)]
    bags = {d: Counter((t or "").lower().split()) for d, t, _ in docs[:-1]}
    bags = {d: x for d, x in bags.items() if x}
    mean = sum(x.total() for x in bags.values()) / len(bags)

    def best(q, label, idf, by_label):
        scores = {}
        for d, _, other in docs:
            if d in bags and not (by_label and label != other):
                for t, m in Counter((q or "").lower().split()).items():
                    if tf := bags[d][t]:
                        df = sum(t in x for x in bags.values())
                        w = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * bags[d].total() / mean)) * m
                        scores[d] = scores.get(d, 0) + w * (math.log1p((len(bags) - df + 0.5) / (df + 0.5)) if idf else 1)
        return sorted((-round(s, 6), d) for d, s in scores.items())[:5]

    d = spark.createDataFrame(docs, "doc_id long, text string, label int")
    q = spark.createDataFrame(asked, "question_id long, text string, label int")
    for terms in (retrieval.BROADCAST_TERMS, 4):  # the second in rounds
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", terms)
        for idf, by_label in ((False, False), (True, False), (False, True)):
            found = retrieval.lexical_top_k(q, d, 5, use_idf=idf, ticker="label" if by_label else None)
            assert "Generate" not in plan(found)
            got = {}
            for r in found.collect():
                got.setdefault(r.question_id, []).append((-round(r.score, 6), r.point_id))
            want = {n: best(t, x, idf, by_label) for n, t, x in asked if not (by_label and x is None)}
            assert {n: sorted(x) for n, x in got.items()} == {n: x for n, x in want.items() if x}


def test_text_index_keeps_few_rows_a_task(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat('cash ', repeat('rate ', cast(id % 7 as int)))").alias("text")))
    asked, blocks, bounds = index.plan(spark.createDataFrame([(1, "cash rate"), (2, "rate")], "question_id long, text string"))
    found = TextIndex._scored(bounds.select("question_id", "part"), asked, blocks, 2)
    assert 4 <= found.count() <= 4 * found.rdd.getNumPartitions()
    assert plan(found).count("Generate") == 0


def test_semantic_claims_search_within_their_key(spark):
    told = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 1.0])], "answer_id int, claim_pos int, embedding array<double>")
    shown = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (2, [float("nan"), 1.0])], "answer_id int, embedding array<double>")
    found = claims.verify_semantic(told, shown)
    assert sorted((r.answer_id, r.claim_pos, r.similarity, r.verified) for r in found.collect()) == [(1, 0, 1.0, True), (1, 1, 0.0, False), (2, 0, 0.0, False), (3, 0, 0.0, False)]
    assert "zip_with" not in plan(found)


def test_claims_look_for_what_their_type_needs(spark, sf_dir):
    text = plan(queries.verified_answers(spark, sf_dir))
    assert text.count("regexp_extract(") < 100 and text.count("upper(") == 0 and text.count("\\s+$") == 0
    numbers = ["$1,250.5K", "2m", "3 B", "7", "none"]
    rows = spark.createDataFrame([(x,) for x in numbers], "text string").select(T.primary_number(F.col("text")).alias("n"))
    assert [r.n for r in rows.collect()] == [1250500.0, 2e6, 3e9, 7.0, None]


def test_routing_looks_for_fixed_parts_first(spark):
    every = [p for _, _, patterns in routing.INTENTS.values() for p in patterns]
    assert [routing.fixed(p) for p in (r"\$[0-9.]+", "suppliers?", "EPS", "year-over-year", "a|b")] == ["$", "supplier", "eps", "year-over-year", ""]
    asked = ["US$5 and $7.5 EPS", "SUPPLIERS, Partner and partnership", "supplierss revenues", "Year-over-Year yoy", None, ""]
    rows = spark.createDataFrame(list(enumerate(asked)), "question_id long, text string")
    found = routing.classify(rows)
    assert plan(found).count("Contains(") >= len(every)
    want = rows.select("question_id", *[F.regexp_like("text", F.lit(rf"(?i)\b{p}\b")).alias(f"p{n}") for n, p in enumerate(every)])
    told = {r.question_id: {routing.display(p) for n, p in enumerate(every) if r[f"p{n}"]} for r in want.collect()}
    for r in found.collect():
        assert set(r.keywords_matched) <= told[r.question_id] and bool(r.keywords_matched) == bool(told[r.question_id])


def test_answers_meet_contexts_once(spark):
    asked = spark.createDataFrame([(n, "revenue") for n in range(5)], "question_id long, text string")
    drafts = spark.createDataFrame([(0, "The firm is pleasant."), (1, "Short."), (2, "The firm is pleasant."), (None, "The firm is pleasant.")], "answer_id long, text string")
    shown = spark.createDataFrame([(0, 0, "the firm is pleasant."), (1, 0, "x"), (3, 0, "x"), (None, 0, "x")], "answer_id long, ctx_pos int, text string")
    found = pipeline.answer(asked, drafts, shown)
    got = {r.question_id: (r.answer, r.confidence, r.n_claims, r.n_verified) for r in found.collect()}
    refused = (claims.REFUSAL, 0.0, 0, 0)
    assert got == {0: ("The firm is pleasant.", 0.8, 1, 1), 1: refused, 2: (pipeline.NO_CONTEXT, 0.0, 0, 0), 3: refused, 4: (pipeline.NO_CONTEXT, 0.0, 0, 0)}
    assert plan(found).count("Join") == 2


def test_told_answers_join_before_claims(spark):
    answers = spark.createDataFrame([(1, "The firm is pleasant. The firm was small."), (2, "The firm is pleasant."), (3, "Short."), (None, "The firm is pleasant.")], "answer_id long, text string")
    shown = spark.createDataFrame([(1, 1, "the firm was small."), (1, 0, "the firm is pleasant."), (2, 0, None)], "answer_id long, ctx_pos int, text string")
    told = spark.createDataFrame([(1, "Confidence: 0.9"), (1, None), (1, "Confidence: 0.9"), (2, "Confidence: 1"), (None, "x")], "answer_id long, response string")
    found = claims.answer_told(answers, shown, told)
    want = claims.regenerate_told(claims.verify_answers(answers, shown), told)
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 5
    above = plan(found).split("Generate")[0]
    assert "Join" not in above


def test_vector_index_keeps_few_rows_a_task(spark, tmp_path, monkeypatch):
    pool = vector_index._Pool(5)
    scores = np.random.default_rng(1).random((10, 100)).round(1)
    pool.add(np.arange(10), np.arange(100), scores)
    assert pool.rows == sum((x >= np.sort(x)[-5]).sum() for x in scores)
    names, ids, _ = pool.best()
    assert [ids[names == n].tolist() for n in range(10)] == [np.lexsort((np.arange(100), -x))[:5].tolist() for x in scores]
    vectors = np.random.default_rng(2).normal(size=(300, 4)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "point_id long, dense array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "index"))
    index.build(rows, 4, cells=6, parts=2)
    asked = rows.where("point_id < 40").select(F.col("point_id").alias("question_id"), F.col("dense").alias("embedding"))
    whole = sorted(map(tuple, index.search(asked, 3, probes=4, shortlist=5).collect()))
    for name, value in (("KEPT", 200), ("PROBED", 8), ("ASKED", 3)):
        monkeypatch.setattr(vector_index, name, value)
    found = index.search(asked, 3, probes=4, shortlist=5)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == 120
    assert plan(found).count("MapInArrow") > 3 * 3  # three rounds


def test_vector_index_broadcasts_no_vector_for_each_probe(spark, tmp_path, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(300, 4)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "point_id long, dense array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "index"))
    index.build(rows, 4, cells=6, parts=2)
    odd = [(0, vectors[0]), (0, vectors[0]), (7, None), (8, [1.0] * 3), (9, [float("nan")] * 4), (None, [1.0] * 4)]
    asked = spark.createDataFrame(odd + [(n, vectors[n]) for n in range(20, 60)], "question_id long, embedding array<double>")
    search = lambda: index.search(asked, 3, probes=4, shortlist=5)
    found = search()
    whole = sorted(map(tuple, found.collect()))
    assert {r[0] for r in whole} == {0, *range(20, 60)} and len(whole) == 123
    assert "unit" not in plan(found) and "strategy=broadcast" in plan(found)
    for name, value in (("SENT", 600), ("PAIRED", 0)):
        monkeypatch.setattr(vector_index, name, value, raising=False)
    found = search()
    assert sorted(map(tuple, found.collect())) == whole
    assert "strategy=broadcast" not in plan(found) and plan(found).count("Union") == 1 and plan(found).count("MapInArrow") >= 3 * 3
    assert not search().where("question_id in (7, 8, 9) or question_id is null").count()


def test_edges_are_told_apart_in_small_ranges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(graph, "APART", 500, raising=False)
    edges = views.view(spark, sf_dir, "graph_edges").where("type = 'SUPPLIES'")
    pairs = views.view(spark, sf_dir, "lineitem").select(F.format_string("supplier %d", "l_suppkey").alias("src"), F.format_string("part %d", "l_partkey").alias("dst"))
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == sorted(map(tuple, pairs.distinct().collect()))
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= pairs.count() // 500 and max(sizes) < 1000
    rows = [(1, n % 300) for n in range(3000)] + [(None, 5), (None, 5), (2, None), (2, None)]  # a node of many edges, told ten times
    told = graph.told_apart(spark.createDataFrame(rows, "a int, b int"))
    assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, set(rows))) and told.count() == 302
    assert told.groupBy(F.spark_partition_id()).count().count() > 4


def test_neighbours_are_counted_before_they_meet_the_starts(spark):
    rows = [("a", "x", "n1"), ("a", "x", "n9"), ("a", "x", "n10"), ("a", "y", None), ("a", None, "n2"), ("b", "x", "n1"), ("b", "x", "n1"), (None, "x", "n3"), ("c", "x", "n4")]
    edges = spark.createDataFrame(rows, "src string, type string, dst string")
    starts = spark.createDataFrame([("a",), ("b",), ("b",), ("none",), (None,)], "start string")
    found = graph.neighbour_counts(edges, starts)
    want = graph.neighbours(edges, starts).groupBy("start", "type").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("last_node"))
    assert found.dtypes == want.dtypes and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 4
    assert plan(found).lstrip().startswith(("Project", "Join"))


def test_graph_neighbours_meet_starts_last(spark, sf_dir):
    assert "Join" in plan(queries.graph_neighbours(spark, sf_dir)).split("Aggregate")[0]
