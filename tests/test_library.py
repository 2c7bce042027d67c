import pytest
from pyspark.sql import functions as F

from reelquarry.functions import scoring, text, vectors
from reelquarry.operators import aggregates, graph, joins, windows
from reelquarry.plans import rollup
from reelquarry.plans.search import And, Not, Or, Term, compile_query


def test_percentile_conventions(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 7.0), ("c", None)], "g string, v double")
    rows = {r.g: r for r in aggregates.percentile_conventions(df, "g", "v", 50.0).collect()}
    a = rows["a"]
    assert (a.nearest_rank, a.floor_index, a.rounded_index, a.floor_n, a.interpolated, a.upper_median) == (5.0, 5.0, 6.0, 6.0, 5.5, 6.0)
    assert rows["b"].interpolated == 7.0 and set(rows) == {"a", "b"}


def test_gap_must_exceed_minimum(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 30), (1, 36, 40)], "k int, s long, e long")
    assert [(r.gap_start, r.gap_end) for r in windows.gaps(df, "k", "s", "e", 5).collect()] == [(30, 36)]


def test_interval_overlaps_once_and_half_open(spark):
    df = spark.createDataFrame([(1, "x", 0, 100), (2, "x", 50, 120), (3, "x", 120, 130), (4, "y", 0, 100), (5, "x", 0, 100)], "id long, k string, s long, e long")
    for width in (7, 1000):
        got = sorted((r.a_id, r.b_id) for r in joins.interval_overlaps(df, "id", "k", "s", "e", width).collect())
        assert got == [(1, 2), (1, 5), (2, 5)]


def test_hamming_pairs_match_brute_force(spark):
    import random

    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)]
    hashes = base + [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 8))) for h in base for _ in range(3)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    got = {(r.a_id, r.b_id, r.distance) for r in joins.hamming_pairs(df, "id", "h", 6).collect()}
    want = {(i, j, d) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= 6}
    assert got == want


def test_binge_needs_a_closing_gap(spark):
    rows = [(1, t, i) for i, t in enumerate([0, 100, 200, 10_000, 10_100, 10_200])]
    df = spark.createDataFrame(rows, "user_id long, t long, event_id long")
    assert [(r.user_id, r.binges, r.longest) for r in windows.binges(df).collect()] == [(1, 1, 3)]


def test_graph_levels_and_cycle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    diamond = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "src long, dst long")
    assert {r.node: r.level for r in graph.topological_levels(nodes, diamond).collect()} == {0: 0, 4: 0, 1: 1, 2: 1, 3: 2}
    assert graph.has_cycle(nodes, diamond.union(spark.createDataFrame([(3, 0)], "src long, dst long")))
    assert {r.node for r in graph.reachable(nodes.where("node = 1"), diamond).collect()} == {1, 3}


def test_search_tree(spark):
    df = spark.createDataFrame([(1, "red cat"), (2, "red dog"), (3, "blue cat")], "id long, t string")
    q = And(Or(Term("cat"), Term("dog")), Not(Term("blue")))
    assert sorted(r.id for r in df.where(compile_query(q, "t")).collect()) == [1, 2]
    assert df.where(compile_query(Or(), "t")).count() == 0 and df.where(compile_query(And(), "t")).count() == 3


@pytest.mark.parametrize(("seconds", "want"), [(7200, "raw"), (7201, "minute"), (86_401, "hour"), (604_801, "day")])
def test_rollup_choice(seconds, want):
    assert rollup.choose_rollup(seconds) == want


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scoring.logarithmic_decay(F.lit(0.0)).alias("log0"),
        text.stem(F.lit("Running")).alias("stem"),
        text.cache_key(F.lit("HTTP://X/a/?b=2&a=1#z")).alias("key"),
        text.timecode(F.lit(90_061), 25).alias("tc"),
        text.parse_timecode(F.lit("01:00:02:11"), 25).alias("frames"),
        vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("cos0"),
        vectors.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j0"),
    ).first()
    assert row.log0 is None and row.stem == "runn" and row.key == "http://x/a?a=1&b=2"
    assert row.tc == "01:00:02:11" and row.frames == 90_061 and row.cos0 == 0.0 and row.j0 == 0.0


@pytest.mark.parametrize("cells", [1 << 23, 40])
def test_recommendations_match_brute_force(spark, cells):
    import random

    rnd = random.Random(2)
    rated = {u: {i: float(rnd.randint(1, 5)) for i in rnd.sample(range(100, 130), rnd.randint(1, 9))} for u in range(14)}
    rated[50] = {500: 4.0}  # shares no item with anyone
    every, want = sorted({i for r in rated.values() for i in r}), set()
    for u, own in rated.items():
        score = dict.fromkeys(set(every) - set(own), 0.0)
        for v, other in rated.items():
            if v != u and (dot := sum(own[i] * other[i] for i in own.keys() & other.keys())):
                sim = dot / (sum(x * x for x in own.values()) * sum(x * x for x in other.values())) ** 0.5
                for i in other.keys() & score.keys():
                    score[i] += sim * other[i]
        best = sorted(score, key=lambda i: (-round(score[i], 6), i))[:7]
        want |= {(u, k + 1, i, round(score[i], 6)) for k, i in enumerate(best)}
    df = spark.createDataFrame([(u, i, x) for u, r in rated.items() for i, x in r.items()], "user_id long, item_id long, rating double")
    got = joins.recommend_unseen(df, 7, cells).collect()
    assert {(r.user_id, r.rank, r.item_id, r.score) for r in got} == want and len(got) == len(want)
    pairs = {(r.user_id % 100, r.item_id % 100) for r in got}
    assert any(a != b for a, b in pairs)


@pytest.mark.parametrize("rows", [1024, 9])
def test_nearest_matches_brute_force(spark, rows):
    import random

    rnd = random.Random(6)
    vectors = {i: [rnd.uniform(-1, 1) for _ in range(5)] for i in range(1, 121)} | {200: [0.0] * 5, 201: [1.0] * 4, 202: None}
    vectors[70] = vectors[60]
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, a array<float>")
    got = joins.nearest(df, df.where("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "query_id", "a": "b"}), 6, rows).collect()
    known = {r.vec_id: r.a for r in df.collect() if r.a is not None and len(r.a) == 5}
    want = {q: sorted(known, key=lambda i: (sum((x - y) ** 2 for x, y in zip(known[i], known[q], strict=True)), i))[:6] for q in (50, 100, 200)}
    assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q, ids in want.items() for i in ids} and len(got) == 18
    assert all(abs(r.manhattan - sum(abs(x - y) for x, y in zip(known[r.vec_id], known[r.query_id], strict=True))) < 1e-9 for r in got)


def test_searches_take_every_fiftieth_row(spark):
    from reelquarry import registry

    sf = "/root/testdata/sf0.001"
    for name, table, key, each in (("vector_search_all", "embeddings", "vec_id", 20), ("tag_similarity_all", "part", "p_partkey", None)):
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        counts = {r.query_id: r["count"] for r in registry.queries()[name](spark, sf).groupBy("query_id").count().collect()}
        assert counts == {r[0]: each or rows.count() for r in rows.where(f"{key} % 50 = 0").select(key).collect()}


def test_graphs_of_any_depth(spark, monkeypatch):
    import inspect

    # chains beyond 200 take minutes here: the former limit is lowered instead
    monkeypatch.setattr(graph, "MAX_DEPTH", 3, raising=False)
    assert inspect.signature(graph.ancestors).parameters["depth_limit"].default is None
    monkeypatch.setattr(graph, "TOGETHER", 2, raising=False)
    length = 6
    nodes = spark.createDataFrame([(i,) for i in range(length)], "node long").coalesce(1)
    chain = spark.createDataFrame([(i, i + 1) for i in range(length - 1)], "src long, dst long").coalesce(1)
    got = graph.ancestors(nodes.where(f"node = {length - 1}"), chain).collect()
    assert {(r.ancestor, r.depth) for r in got} == {(length - 1 - d, d) for d in range(length)} and len(got) == length
    assert {r.node: r.level for r in graph.topological_levels(nodes, chain).collect()} == {i: i for i in range(length)}


def test_every_part_has_its_ancestry(spark):
    from reelquarry import registry

    sf = "/root/testdata/sf0.001"
    got = {r.node for r in registry.queries()["ancestors_all"](spark, sf).collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
