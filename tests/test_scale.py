"""Steps that must not grow faster than their input, against brute force on small tables."""

import random

from reelquarry import storage
from reelquarry.operators import graph, joins, models, similarity


def test_nearest_points_match_brute_force(spark):
    rnd = random.Random(3)
    at = {i: [rnd.randint(0, 3) / 4, rnd.randint(0, 2) / 3, rnd.randint(0, 1) / 1.0] for i in range(1, 300)} | {500: [0.1234567, 0.5, 0.0]}
    df = spark.createDataFrame(list(at.items()), "id long, v array<double>")
    queries = df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    for block in (4096, 7):
        got = {(r.query_id, r.id, r.distance) for r in similarity.nearest_points(df, queries, 9, 6, block).collect()}
        want = set()
        for q in (i for i in at if i % 50 == 0):
            d = {i: round(sum((x - y) ** 2 for x, y in zip(v, at[q], strict=True)) ** 0.5, 6) for i, v in at.items()}
            want |= {(q, i, d[i]) for i in sorted(d, key=lambda i: (d[i], i))[:9]}
        assert got == want


def test_nearest_by_tags_match_brute_force(spark):
    rnd = random.Random(5)
    rows = {i: (sorted(rnd.sample("abcde", rnd.randint(1, 3))), rnd.choice(["x", "y", "", None])) for i in range(1, 400)}
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in rows.items()], "item_id long, tags array<string>, genre string")
    got = {(r.query_id, r.item_id, r.similarity) for r in similarity.nearest_by_tags(df, df.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 6, 6).collect()}
    want = set()
    for q in (i for i in rows if i % 50 == 0):
        (t, g), s = rows[q], {}
        for i, (u, h) in rows.items():
            s[i] = round(min(len(set(t) & set(u)) / (len(t) * len(u)) ** 0.5 + 0.1 * bool(g and g == h), 1), 6)
        want |= {(q, i, s[i]) for i in sorted(s.keys() - {q}, key=lambda i: (-s[i], i))[:6]}
    assert got == want


def test_set_similarities_compare_sets_once(spark):
    df = spark.createDataFrame([(i, [["a", "b"], ["b"], None, ["c", "d"]][i % 4]) for i in range(40)], "id long, t array<string>")
    made = similarity.set_similarities(df, df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 6, 30)
    rows = {(r.query_id, r.id): (r.jaccard, r.dice, r.overlap, r.cosine) for r in made.collect()}
    assert len(rows) == 4 * 40 and rows[0, 4] == (1.0, 1.0, 1.0, 1.0) and rows[0, 1] == (0.5, 0.666667, 1.0, 0.707107) and rows[10, 2] == rows[0, 3] == (0.0, 0.0, 0.0, 0.0)


def test_overlaps_of_few_and_of_many_worldwide_intervals(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("xyz*"), s := rnd.randint(0, 300), s + rnd.randint(0, 90)) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, k string, s long, e long")
    want = {(a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or "*" in (a[1], b[1])) and max(a[2], b[2]) < min(a[3], b[3])}
    for few in (0, 1000):
        made = joins.interval_overlaps(df, "id", "k", "s", "e", 7, "*", few=few)
        got = [tuple(r) for r in made.collect()]
        assert len(got) == len(want) and set(got) == want
    assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()


def test_content_statistics_round_halves_to_even(spark, tmp_path):
    from reelquarry import registry

    rows = [(i, "2024-01-01 00:00:00", 1, "view", v, '{"k": 1}') for i, v in enumerate((0.5, 2.5, 4.5))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.avg_watch for r in registry.queries()["content_statistics"](spark, str(tmp_path)).collect()] == [2]


def test_bit_sampling_lists_itself_only(spark, tmp_path):
    from reelquarry import registry

    spark.createDataFrame([(i, None if i == 100 else [1.0, -1.0]) for i in range(49, 102)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, registry.queries()["bit_sampling"](spark, str(tmp_path)).collect())) == [(50, 50, 0), (100, 100, 0)]


def test_nearest_of_kinds_match_brute_force(spark):
    rnd = random.Random(9)
    at = {i: (rnd.choice([1, 2, 3, None]), [rnd.randint(0, 9) / 9 for _ in range(3)]) for i in range(120)} | {120: (7, [0.1] * 4), 121: (7, None)}
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in at.items()], "query_id long, kind int, v array<float>")
    known = {r.query_id: (r.kind, r.v) for r in df.collect() if r.v}
    want = {}
    for q in (i for i in known if i % 20 == 0):
        for k, v in known.values():
            if len(v) == len(known[q][1]) and (d := sum((x - y) ** 2 for x, y in zip(v, known[q][1], strict=True)) ** 0.5) <= 0.4:
                want[q, k] = min(d, want.get((q, k), 9.0))
    for block in (4096, 11):
        got = {(r.query_id, r.kind): r.distance for r in similarity.nearest_of_kinds(df.select("kind", "v"), df.where("query_id % 20 = 0"), 0.4, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_graph_walks_broadcast_nothing(spark, monkeypatch):
    plans = []
    plain = graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long").coalesce(1)
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "src long, dst long").coalesce(1)
    assert {r.node: r.level for r in graph.topological_levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert {r.node for r in graph.reachable(nodes.where("node = 1"), edges).collect()} == {1, 3}
    assert plans and not any("Broadcast" in p for p in plans)


def test_many_pairs_are_dealt_over_more_tasks(spark):
    df = spark.createDataFrame([(u, i, 1.0) for u in range(4) for i in range(12)], "user_id long, item_id long, rating double")
    pairs = joins.pairs_within(df, "user_id", "item_id", "rating", task_pairs=20)
    assert pairs.rdd.getNumPartitions() == 14 and pairs.count() == 4 * 66
    assert storage.tasks_for(spark, 100, 10) == 10 and storage.tasks_for(spark, 10, 10) is None


def test_factors_give_the_best_items(spark):
    rnd = random.Random(4)
    rows = [(u, i, float(rnd.randint(1, 5))) for u in range(30) for i in rnd.sample(range(60), 12)]
    trained = models.factorise(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), 3, 2, 0.1)
    want = {(r.user_id, x.item_id): x.rating + trained[1] for r in trained[0].recommendForAllUsers(5).collect() for x in r.recommendations}
    for users, items in ((1024, 8192), (4, 7)):
        got = {(r.user_id, r.item_id): r.score for r in models.recommend_by_factors(trained, 5, users, items).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_recommendations_of_held_ratings_equal_those_of_blocks(spark):
    rnd = random.Random(6)
    rows = [(u + 100 * c, i + 50 * c, float(rnd.randint(-1, 5))) for c in range(3) for u in range(12) for i in rnd.sample(range(20), 4)] + [(900, 7000, 2.0), (901, 3, 0.5)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    got, want = ([tuple(r) for r in joins.recommend_unseen(df, 25, 60, held=h).collect()] for h in (1000, 0))
    assert len(got) == len(want) and set(got) == set(want)
    plan = joins.recommend_unseen(df, 25, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
