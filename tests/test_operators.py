"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import energy, spectral, surface
from quern.functions.expr import clip, cosine, normalise, sdiv
from quern.operators import chunking, corpus, evaluation, feedback, graph, learning, ranking, raster, series, spatial


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clip_keeps_null_and_division_by_zero_is_null(spark):
    assert value(spark, clip(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, clip(F.lit(7.0), 0, 1)) == 1
    assert value(spark, sdiv(1.0, 0.0)) is None


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, cosine(v(1.0, 0.0), v(0.0, 0.0))) == 0
    assert value(spark, cosine(v(1.0, 1.0), v(2.0, 2.0))) == pytest.approx(1)
    assert value(spark, normalise(v(0.0, 0.0))) == [0.0, 0.0]
    assert value(spark, normalise(v(3.0, 4.0))) == pytest.approx([0.6, 0.8])


def test_fixed_chunks_overlap_and_stop_at_the_end(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "  "), (3, "a b"), (4, None)], "doc_id int, text string")
    got = rows(chunking.fixed_size(docs, size=4, overlap=1).select("doc_id", "chunk", "first", "last", "text", "prev", "next"), "doc_id", "chunk")
    assert got == [(1, 0, 0, 4, "a b c d", None, 1), (1, 1, 3, 7, "d e f g", 0, None), (3, 0, 0, 2, "a b", None, None)]


def test_header_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\ntext\nSHOUTING LINE\nmore")], "doc_id int, text string")
    got = rows(chunking.header_sections(docs).select("section", "title", "is_header", "text"), "section")
    assert got == [(0, "document", False, "intro"), (1, "One", True, "# One\ntext"), (2, "SHOUTING LINE", True, "SHOUTING LINE\nmore")]


def test_greedy_lines_flush_before_the_budget_is_passed(spark):
    docs = spark.createDataFrame([(1, "a" * 40 + "\n\n" + "b" * 40 + "\n" + "c" * 8), (2, "")], "doc_id int, text string")
    assert [r[3] for r in rows(chunking.greedy_lines(docs, size=15), "chunk")] == [10, 12]


def test_rank_fusion_counts_an_id_once_a_list_and_keeps_first_appearance(spark):
    lists = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "b", 1), (1, 0, "a", 2), (1, 1, "b", 0), (1, 1, "c", 1)], "query_id int, list_id int, id string, rank int")
    got = rows(ranking.reciprocal_rank(lists, 10), "rank")
    assert [r[1] for r in got] == ["b", "a", "c"]
    assert got[0][2] == pytest.approx(1 / 62 + 1 / 61)
    assert got[1][2] == pytest.approx(1 / 61)


def test_linear_fusion_of_a_single_score_is_zero(spark):
    lists = spark.createDataFrame([(1, 0, "a", 0, 5.0), (1, 1, "b", 0, 9.0), (1, 1, "a", 1, 3.0)], "query_id int, list_id int, id string, rank int, score double")
    assert [(r[1], r[2]) for r in rows(ranking.linear(lists, 10), "rank")] == [("b", 0.5), ("a", 0.0)]


def test_linear_fusion_does_not_scale_up_rounding(spark):
    lists = spark.createDataFrame([(1, 0, "a", 0, 760.4375627140995 + 4e-13), (1, 0, "b", 1, 760.4375627140995), (1, 1, "b", 0, 9.0), (1, 1, "c", 1, 3.0)], "query_id int, list_id int, id string, rank int, score double")
    assert [(r[1], round(r[2], 9)) for r in rows(ranking.linear(lists, 10), "rank")] == [("b", 0.5), ("a", 0.0), ("c", 0.0)]


def test_texts_that_nothing_hits_are_not_moved(spark, tmp_path):
    spark.range(500).selectExpr("id", "repeat(uuid(), 9) AS text").write.parquet(str(tmp_path / "d"))
    hits = spark.createDataFrame([(1, 7, 0), (1, 9, 1), (2, 7, 0), (2, 1000, 1)], "query_id int, id bigint, rank int")
    got = ranking.with_documents(hits, spark.read.parquet(str(tmp_path / "d")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == [(1, 7, 0), (1, 9, 1), (2, 7, 0)]


def test_packing_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 0, "x" * 40), (1, 1, "x" * 4000), (1, 2, "x" * 4)], "query_id int, rank int, text string")
    assert [r["rank"] for r in ranking.pack(hits, budget=100, each=500).orderBy("rank").collect()] == [0]
    assert [r["tokens"] for r in ranking.pack(hits, budget=600, each=500).orderBy("rank").collect()] == [10, 500, 1]


def test_filters_in_queries_and_citations(spark):
    q = spark.createDataFrame([("sensor:S2 type:a.b flood map other:x",)], "query string")
    assert tuple(corpus.parse_filters(q).first()) == (["S2"], [], ["a.b"], [], "flood map other:x")
    assert value(spark, corpus.strip_citations(F.lit("a [1], b [9] c [0]"), F.lit(2))) == "a [1], b  c "
    assert tuple(value(spark, corpus.bbox_in_text(F.lit("at (52 • 48.5 • 31 • 30)")))) == (48.5, 30.0, 52.0, 31.0)
    assert value(spark, corpus.kind_of(corpus.mime_of(F.lit("x.PY")))) == "code"


def test_boxes_touch_and_null_boxes_fail(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 2.0, 2.0), (3, None, None, None, None)], "id int, min_lon double, min_lat double, max_lon double, max_lat double")
    assert [r.id for r in spatial.intersects(b, (1.0, 1.0, 3.0, 3.0)).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in spatial.within(b, (1.0, 1.0, 3.0, 3.0)).collect()] == [2]
    assert [r.id for r in spatial.contains(b, (0.2, 0.2, 0.4, 0.4)).collect()] == [1]
    near = spatial.distance_lte(b, (0.5, 1.5, 0.5, 1.5), 112_000).orderBy("id").collect()
    assert [r.id for r in near] == [1, 2] and near[0].distance_m == pytest.approx(math.radians(1) * spatial.RADIUS, rel=1e-6)
    with pytest.raises(ValueError):
        spatial.intersects(b, (170.0, 0.0, -170.0, 1.0))


def test_traverse_finds_each_relation_once_at_its_first_hop(spark):
    rel = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "d", "e")], "id int, source_id string, target_id string")
    start = spark.createDataFrame([("a",)], "start string")
    assert rows(graph.traverse(rel, start, 1).select("relation_id", "hop"), "relation_id") == [(1, 0), (2, 1)]


def test_scores_and_states(spark):
    c = feedback.confidence(F.lit(5), F.lit(9), F.lit(True), F.lit(0), F.lit(0))
    assert value(spark, c) == 18 and value(spark, feedback.state_of(c)) == "verified"
    assert value(spark, feedback.confidence(F.lit(0), F.lit(0), F.lit(False), F.lit(2), F.lit(0))) == 0
    assert value(spark, feedback.allowed(F.lit("rejected"), F.lit("proposed"))) is False
    assert value(spark, feedback.allowed(F.lit("proposed"), F.lit("rejected"))) is True


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, id string")
    got = {(r.query_id, r.k): r for r in evaluation.retrieval_metrics(hits, gold, (1, 3)).collect()}
    assert got[1, 1].recall == 0 and got[2, 3].ndcg == 0
    assert got[1, 3].recall == 0.5 and got[1, 3].precision == pytest.approx(1 / 3) and got[1, 3].mrr == 0.5
    assert got[1, 3].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_indices_and_surface(spark):
    assert value(spark, spectral.ndvi(F.lit(0.5), F.lit(0.1))) == pytest.approx(2 / 3)
    assert value(spark, spectral.ndvi(F.lit(0.0), F.lit(0.0))) is None
    assert value(spark, spectral.lai(F.lit(0.9))) == 6
    with pytest.raises(ValueError):
        spectral.index("evi", ["red"])
    assert value(spark, surface.emissivity(F.lit(-0.1))) == 0.985
    assert value(spark, surface.is_clear(F.lit(1 << 7 | 1 << 3 | 1 << 9))) is True  # water is clear whatever else
    assert value(spark, surface.is_clear(F.lit(1 << 3 | 1 << 8))) is False
    assert value(spark, surface.lst(F.lit(150.0), F.lit(0.98))) is None


def test_energy_terms(spark):
    assert value(spark, energy.soil_flux(F.lit(100.0), F.lit(0.2))) == 20
    assert value(spark, energy.evaporative_fraction(F.lit(5.0), F.lit(2.0))) == 0.5
    assert value(spark, energy.et_fraction(F.lit(1.0), F.lit(0.0))) == 0
    assert value(spark, energy.et_quality(F.lit(1.0), F.lit(5.0))) == 4
    neutral = energy.resistance(F.lit(0.1), F.lit(0.1), F.lit(2.0))
    assert value(spark, neutral) == pytest.approx(math.log(99) * math.log(190) / (0.41**2 * 2), rel=1e-9)
    with pytest.raises(ValueError):
        energy.soil_ratio(F.lit(0.5), "document")


def test_reclassify_rejects_overlap_and_breaks_close_the_last_class(spark):
    with pytest.raises(ValueError):
        raster.check_rules([(0, 2, 1), (1, 3, 2)])
    b = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    assert [value(spark, raster.class_index(F.lit(x), b)) for x in (-0.1, 0.0, 1.0, 2.0, 2.1)] == [None, 0, 1, 1, None]


def grid(spark, picture):
    return spark.createDataFrame([("s", y, x, c) for y, line in enumerate(picture) for x, c in enumerate(line)], "scene_id string, y bigint, x int, c string")


def test_dilation_neighbours_and_regions(spark):
    px = grid(spark, ["....", ".#..", "....", "...."])
    got = raster.dilate(px.select("scene_id", "y", "x", (F.col("c") == "#").alias("f")), "f", 1)
    assert {(r.y, r.x) for r in got.where("f").collect()} == {(y, x) for y in range(3) for x in range(3)}
    mean = raster.neighbour_mean(px.select("scene_id", "y", "x", F.when(F.col("c") == "#", 9.0).otherwise(0.0).alias("v")), "v")
    assert {(r.y, r.x): r.neighbour_mean for r in mean.collect()}[0, 0] == 1
    edge = raster.neighbour_mean(grid(spark, ["#.", ".."]).select("scene_id", "y", "x", F.when(F.col("c") == "#", 9.0).otherwise(0.0).alias("v")), "v")
    assert {(r.y, r.x): r.neighbour_mean for r in edge.collect()}[0, 0] == 4  # the corner stands for three beyond it
    regions = raster.regions(grid(spark, ["aab", "bab", "bbb", "a.a"]).where("c <> '.'").select("scene_id", "y", "x", F.col("c").alias("k")), "k")
    sizes = sorted(r["count"] for r in regions.groupBy("region").count().collect())
    assert sizes == [1, 1, 3, 6]


def test_water_stress_interpolates_between_bins(spark):
    px = spark.createDataFrame([("s", i, 0, n, t) for i, (n, t) in enumerate([(0.21, 300.0), (0.21, 310.0), (0.25, 302.0), (0.25, 320.0), (0.23, 305.0), (0.1, 300.5)])], "scene_id string, y bigint, x int, ndvi double, lst double")
    e = {round(r.c, 2): (r.wet, r.dry) for r in raster.edges(px).collect()}
    assert sorted(e) == [0.21, 0.23, 0.25]
    got = {r.y: r.cwsi for r in raster.water_stress(px).collect()}
    wet, dry = e[0.21]
    assert got[5] == pytest.approx(min(1, max(0, (300.5 - wet) / (dry - wet)))) and got[4] is None  # a bin of one pixel has no width


def test_area_and_zones(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    z = spark.createDataFrame([(1, [{"px": x, "py": y} for x, y in ring])], "zone_id int, ring array<struct<px:double,py:double>>")
    assert z.select(raster.area(F.col("ring")).alias("a")).first().a == 12
    px = spark.createDataFrame([("s", y, x, None if (y, x) == (0, 0) else 1.0) for y in range(5) for x in range(5)], "scene_id string, y bigint, x int, v double")
    r = raster.zonal(px, z, "v").first()
    assert (r.n, r.nodata_share) == (11, 1 / 12)


def test_series(spark):
    s = spark.createDataFrame([(1, "2024-01-01", 1.0), (1, "2024-01-05", 3.0), (2, "2024-01-01", 5.0)], "site int, day string, v double").withColumn("day", F.to_date("day"))
    pairs = series.scene_pairs(s, "site", "day", "v")
    assert [r.filled for r in series.fill_linear(pairs).orderBy("day").collect()] == [1.5, 2.0, 2.5]
    assert series.fill_weighted(pairs).orderBy("day").first().filled == pytest.approx((1 / 1 + 3 / 3) / (1 / 1 + 1 / 3))
    c = spark.createDataFrame([(1, 1, 10.0, False), (1, 2, 20.0, True), (1, 3, 30.0, False)], "k int, t int, a double, ok boolean")
    assert [(r.used, r.source) for r in series.carry_forward(c, "k", ["t"], "a", "ok").orderBy("t").collect()] == [(None, "NONE"), (20.0, "NEW"), (20.0, "REUSED")]


def test_votes_and_blends(spark):
    assert value(spark, learning.entropy(F.array(F.lit(1.0), F.lit(0.0)))) == 0
    assert value(spark, learning.edge_proba(F.array(F.lit(1.0)), [[0.0]], [0.0])) == [0.5, 0.5]
    proba = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.5), ("b", 0, 1.0)], "k string, label int, p double")
    scores = spark.createDataFrame([("a", 0, 3.0)], "k string, label int, score double")
    assert {(r.k, r.label): r.blended for r in learning.blend(proba, scores, "k").collect()} == {("a", 0): 0.75, ("a", 1): 0.25, ("b", 0): 1.0}


def pooled(pairs, at):
    """The isotonic fit at one of the x, by pooling neighbours again and again."""
    by = {}
    for x, y in pairs:
        by.setdefault(x, []).append(y)
    blocks = [[sum(v), len(v), [x]] for x, v in sorted(by.items())]
    while (k := next((i for i in range(len(blocks) - 1) if blocks[i][0] / blocks[i][1] > blocks[i + 1][0] / blocks[i + 1][1]), None)) is not None:
        blocks[k : k + 2] = [[a + b for a, b in zip(blocks[k], blocks[k + 1], strict=True)]]
    return next(s / n for s, n, xs in blocks if at in xs)


def test_each_row_is_calibrated_by_the_last_rows_of_its_key(spark):
    import random

    rnd = random.Random(6)
    rows = [(k, i, rnd.randrange(30) / 30, float(rnd.random() < 0.5)) for k in "ab" for i in range(60)] + [("a", 60, None, 1.0), ("a", 61, 0.5, None), ("c", 1, 0.7, 1.0)]
    t = spark.createDataFrame(rows, "k string, i int, score double, label double")
    got = {(r.k, r.i): r.calibrated for r in learning.recalibrated(t, "k", ["i"], "score", "label", window=25, least=10).collect()}
    want = {}
    for k, i, s, y in rows:
        held = [(a, b) for q, j, a, b in rows if q == k and j <= i and a is not None and b is not None][-25:]
        if s is not None and y is not None:
            want[k, i] = s if len(held) < 10 else pooled(held, s)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_train_per_key_is_gradient_descent_without_python(spark):
    import inspect
    import random

    import numpy as np

    from quern.operators import learning

    rnd = random.Random(5)
    rows = [(k, i, [rnd.gauss(0, 1) for _ in range(3)]) for i, k in enumerate([1] * 70 + [2] * 30 + [None] * 9)]
    rows = [(k, i, x, int(x[0] + 0.3 * x[1] > 0.2)) for k, i, x in rows]
    for most in (learning.SENT_WEIGHTS, 0):  # weights sent to all, and joined
        before, learning.SENT_WEIGHTS = learning.SENT_WEIGHTS, most
        try:
            t = spark.createDataFrame(rows, "k bigint, id bigint, v array<float>, y bigint")
            got = {r.k: r for r in learning.train_per_key(t, "k", "id", "v", "y", epochs=4).collect()}
        finally:
            learning.SENT_WEIGHTS = before
        assert set(got) == {1, 2, None}
        for k, r in got.items():
            x = np.c_[np.array([v for g, _, v, _ in rows if g == k], np.float32).astype(float), np.ones(r.n)]
            y, w = np.array([b for g, _, _, b in rows if g == k], float), np.zeros(4)
            for _ in range(4):
                w += 0.5 * x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(x)
            assert np.allclose(r.weights, w, atol=1e-8) and abs(r.accuracy - ((x @ w > 0) == (y > 0.5)).mean()) < 1e-6
    assert "applyInPandas" not in inspect.getsource(learning)
    assert learning.train_per_key(t.limit(0), "k", "id", "v", "y", epochs=1).count() == 0


def test_active_versions(spark):
    saves = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 10), ("b", 2, 20), ("c", 1, 10)], "k string, version int, at int")
    back = spark.createDataFrame([("a", 1, 30), ("b", 7, 30), ("c", 1, 5)], "k string, version int, at int")
    assert rows(series.active_versions(saves, back, ["k"]), "k") == [("a", 1, True), ("b", 2, False), ("c", 1, False)]
    again = saves.union(spark.createDataFrame([("a", 3, 40)], saves.schema))
    assert rows(series.active_versions(again, back, ["k"]), "k")[0] == ("a", 3, False)
    assert rows(series.active_versions(saves.limit(0), back, ["k"])) == []


def test_only_whole_boxes_are_registered(spark):
    scenes = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0]), (2, [0.0, 1.0]), (3, []), (4, None)], "id int, bbox array<double>")
    assert rows(spatial.registered(scenes)) == [(1, 0.0, 1.0, 2.0, 3.0)]


def test_regions_of_far_columns_stay_apart(spark):
    px = spark.createDataFrame([("s", 0, 1_000_000, 1), ("s", 1, 0, 1), ("s", 1, 1, 1), ("s", 2, 0, 1), ("s", 2, 5, None)], "scene_id string, y int, x int, class int")
    got = rows(raster.regions(px, "class").groupBy("region").count(), "region")
    assert [n for _, n in got] == [1, 3]


def test_neither_texts_nor_counts_are_shuffled_for_trigrams(spark, tmp_path):
    spark.createDataFrame([(i, f"some text of number {i} and more") for i in range(50)], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = docs.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "text AS query")
    plan = ranking.trigram_cosine(docs, asked, 3)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("query_id" in line.split("hashpartitioning(")[1] for line in dealt)


def test_texts_that_contain_a_query(spark):
    docs = spark.createDataFrame([(1, "A Big House", 0.4), (2, "the big house.", 0.8), (3, "big  house", 0.8), (4, None, 0.8), (5, "my big house", 0.8)], "id bigint, text string, score double")
    asked = spark.createDataFrame([(1, "big HOUSE"), (2, " "), (3, None), (4, "none")], "query_id bigint, query string")
    assert [(r.query_id, r.id, r["rank"]) for r in ranking.containing(docs, asked, 2).orderBy("query_id", "rank").collect()] == [(1, 2, 0), (1, 5, 1)]


def test_greedy_lines_of_long_texts(spark, monkeypatch):
    import random

    rng = random.Random(9)
    monkeypatch.setattr(chunking, "LINES", 7)
    texts = [(i, "\n".join("x" * rng.choice([0, 1, 3, 8, 40, 90]) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(0, 200)))) for i in range(20)] + [(50, None), (51, ""), (52, "x" * 500)]
    want = []
    for k, t in texts:
        held, total, n = [], 0, 0
        for line in ((t or "").split("\n")):
            if not (line := line.strip()):
                continue
            cost = max(1, len(line) // 4)
            if held and total + cost > 30:
                want.append((k, n, "\n".join(held), total))
                held, total, n = [], 0, n + 1
            held.append(line)
            total += cost
        if held:
            want.append((k, n, "\n".join(held), total))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(map(tuple, chunking.greedy_lines(docs, size=30).collect())) == sorted(want)
