"""Values that the definitions force, worked out by hand: one test for each formula or rule."""

import math

import pytest
from pyspark.sql import functions as F

from reelquarry.functions import hashing as H
from reelquarry.functions import rights as R
from reelquarry.functions import scoring as S
from reelquarry.functions import text as T
from reelquarry.operators import aggregates as A
from reelquarry.operators import graph, joins, media, monitoring, similarity
from reelquarry.operators import windows as Wn
from reelquarry.operators.quota import sliding_quota
from reelquarry.plans import search as Q


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_hot_and_composite_scores(spark):
    lit = F.lit
    r = one(spark, a=S.reddit_hot_score(lit(7), lit(2), lit(1_114_293_600)), b=S.reddit_hot_score(lit(1), lit(1002), lit(1_114_338_600)), c=S.reddit_hot_score(lit(3), lit(3), lit(0)), d=S.trending_composite(lit(10.0), lit(math.e**5), lit(0.5)), e=S.trending_composite(lit(0.0), lit(0.5), lit(0.0)))
    assert r.a == 1.0 and r.b == pytest.approx(-math.log10(1001) + 1) and r.c == 0.0
    assert r.d == pytest.approx(0.3 * math.exp(-1) + 0.4 * 0.5 + 0.15) and r.e == pytest.approx(0.3)


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://example.com/", "https://example.com/"), ("https://Example.com/a/", "https://example.com/a"), ("https://x.y/a//", "https://x.y/a/"), ("/", "/"), ("/a/", "/a"), ("", ""), ("http://H/p?B=2&a=1#f", "http://h/p?a=1&b=2"), ("http://h/p/?", "http://h/p"), ("http://h/?z&&y", "http://h/?y&z")],
)
def test_cache_keys(spark, url, want):
    assert one(spark, k=T.cache_key(F.lit(url))).k == want


def test_novelty_and_stability(spark):
    r = one(spark, a=S.novelty(F.lit(True), F.lit(0.25)), b=S.novelty(F.lit(False), F.lit(3.0)))
    assert r.a == pytest.approx(0.9) and r.b == 0.0
    df = spark.createDataFrame([("zero", 0.0), ("zero", 0.0), ("off", -1.0), ("off", 1.0), ("one", 5.0), ("two", 1.0), ("two", 3.0), ("wild", 1.0), ("wild", -0.5)], "g string, v double")
    got = {r.g: r.s for r in df.groupBy("g").agg(A.stability(F.col("v")).alias("s")).collect()}
    assert got == {"zero": 1.0, "off": 0.0, "one": 1.0, "two": 0.5, "wild": 0.0}


def test_worldwide_rights_overlap_all(spark):
    rows = [(1, "US", 0, 100), (2, "GB", 0, 100), (3, "*", 50, 60), (4, "*", 55, 58), (5, "US", 100, 120), (6, "US", 60, 61), (7, "US", 9, 9)]
    df = spark.createDataFrame(rows, "id long, k string, s long, e long")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or "*" in (a[1], b[1])) and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]}
    for width, salts in ((7, 1), (1000, 3)):
        got = [(r.a_id, r.b_id) for r in joins.interval_overlaps(df, "id", "k", "s", "e", width, "*", salts).collect()]
        assert set(got) == want and len(got) == len(want)


def test_overlap_counts_match_pairs(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, i % 3, s := rnd.randint(0, 50), s + rnd.randint(0, 9)) for i in range(90)]
    want = {a[0]: sum(a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and b[2] < b[3] for b in rows) for a in rows if a[2] < a[3]}
    got = joins.overlap_counts(spark.createDataFrame(rows, "id long, k long, s long, e long"), "id", "k", "s", "e").collect()
    assert {r.id: r.conflicts for r in got} == want


@pytest.mark.parametrize("distance", [0, 2, 6, 12])
def test_probed_bands_find_all_pairs(spark, distance):
    import random

    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hashes = base + [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, distance + 2))) for h in base for _ in range(3)]
    df = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "id long, h long")
    got = [(r.a_id, r.b_id, r.distance) for r in joins.hamming_pairs(df, "id", "h", distance).collect()]
    want = {(i, j, d) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= distance}
    assert set(got) == want and len(got) == len(want)


def test_histogram_gives_upper_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10)], "v double")
    assert [(r.upper, r.n) for r in A.histogram(df, "v", 2).orderBy("upper").collect()] == [(5.0, 2), (10.0, 2)]
    same = spark.createDataFrame([(7.0,), (7.0,), (None,)], "v double")
    assert [(r.upper, r.n) for r in A.histogram(same, "v", 4).collect()] == [(7.0, 2)]
    assert A.histogram(same.limit(0), "v", 4).count() == 0


def test_quota_counts_accepted_rows_only(spark):
    rows = [(1, t, i) for i, t in enumerate([0, 10, 20, 30, 61, 62, 71, 200])]
    got = sliding_quota(spark.createDataFrame(rows, "u long, t long, id long"), "u", ["t", "id"], "t", "id", 2, 60).orderBy("id").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, False, True, True]
    assert [r.retry_after for r in got] == [None, None, 40, 30, None, 8, None, None]


def test_ranks_of_skewed_and_null_groups(spark):
    import random

    rnd = random.Random(3)
    values = {"a": [rnd.expovariate(0.01) for _ in range(700)], "b": [4.0] * 50 + [1.0], None: [2.0, 1.0, 3.0, 3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = A.ranked_values(df, "g", "v", 7).collect()
    for g, vs in values.items():
        own = sorted((r.v, r.lo, r.hi, r.n) for r in got if r.g == g)
        assert own == [(v, sum(x < v for x in vs), sum(x <= v for x in vs), len(vs)) for v in sorted(set(vs))]


def test_seasonal_anomalies_need_spread(spark):
    flat = spark.createDataFrame([("f", i, 5.0) for i in range(12)] + [("s", i, 30.0 if i == 8 else float(i % 2)) for i in range(20)], "k string, i long, v double")
    assert {r.k for r in Wn.seasonal_anomalies(flat, "k", "i", "v", 2, 2.5).collect()} == {"s"}


# documents and queries with the numbers of hits that set semantics give
CORPUS = ["cat dog fish", "cat bird", "dog fish bird", "cat dog bird snake", "snake lizard", "fish only", "bird snake", "cat fish snake", "lizard frog", "dog frog cat"]
_t = Q.Term


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        (Q.Or(_t("cat"), _t("dog")), 6),
        (Q.And(_t("cat"), _t("dog")), 3),
        (Q.And(Q.Or(_t("cat"), _t("bird")), Q.Or(_t("fish"), _t("snake"))), 5),
        (Q.And(Q.Or(_t("cat"), _t("bird")), Q.Or(_t("fish"), _t("snake")), Q.Not(_t("dog"))), 2),
        (Q.And(Q.Not(_t("cat")), Q.Not(_t("dog"))), 4),
        (Q.And(Q.Phrase(("cat", "dog")), _t("bird")), 1),
        (Q.Phrase(("dog", "cat"), adjacent=True), 0),
        (Q.Phrase(("fish", "bird"), adjacent=True), 1),
        (Q.Or(Q.Not(_t("cat")), Q.Not(_t("fish"))), 8),
        (Q.And(Q.And(_t("cat"), _t("dog")), Q.Not(_t("cat"))), 0),
        (Q.Not(Q.Not(_t("snake"))), 4),
        (_t("liz"), 0),
        (Q.Substring("liz"), 2),
    ],
)
def test_boolean_queries(spark, query, hits):
    df = spark.createDataFrame([(t,) for t in CORPUS] + [(None,)], "t string")
    assert Q.search(df.where("t IS NOT NULL"), query, "t").count() == hits


def test_clip_query_sql():
    q = Q.ClipQuery().name("test").favorite(True).least_rating(3)
    assert q.sql() == "SELECT * FROM clips WHERE name LIKE :p0 AND is_favorite = :p1 AND rating >= :p2 ORDER BY created_at DESC"
    assert q.args == {"p0": "%test%", "p1": True, "p2": 3} and Q.ClipQuery().sql() == "SELECT * FROM clips ORDER BY created_at DESC"


def test_hashes():
    def fnv(raw, h=H.OFFSET):
        for b in raw:
            h = (h ^ b) * H.PRIME % (1 << 64)
        return h

    raws = [b"", b"a", b"foobar", bytes(range(256)), b"x" * 1000]
    assert H.fnv1a_many(raws).tolist() == [fnv(r) for r in raws] and fnv(b"a") == 0xAF63DC4C8601EC8C
    assert H.fnv1a_many([]).tolist() == []
    points, owners = H.ring({"a": 1, "b": 2}, 3)
    assert len(owners) == 9 and points.tolist() == sorted(points.tolist())


def test_hash_columns(spark):
    df = spark.createDataFrame([("user1",), (None,), ("",)], "k string")
    rows = df.select("k", H.fnv1a(F.col("k")).alias("h"), H.adler32(F.lit("Wikipedia")).alias("a"), H.content_id(F.lit("")).alias("c"), H.ring_node(F.col("k"), {}, 3).alias("n"), H.variant(F.col("k"), "e", [1.0]).alias("v")).collect()
    assert rows[1].h is None and rows[2].h == f"{H.OFFSET:016x}" and {r.a for r in rows} == {"11e60398"} and {r.n for r in rows} == {None} and {r.v for r in rows} == {0}
    assert rows[0].c == H.OFFSET.to_bytes(8, "little").hex() + H.OFFSET_B.to_bytes(8, "little").hex()


def test_drop_frame_timecodes(spark):
    frames = [0, 1799, 1800, 17981, 17982, 107_892]
    got = [one(spark, t=T.timecode(F.lit(f), 30, True)).t for f in frames]
    assert got == ["00:00:00;00", "00:00:59;29", "00:01:00;02", "00:09:59;29", "00:10:00;00", "01:00:00;00"]
    assert [one(spark, f=T.parse_timecode(F.lit(t), 30, True)).f for t in got] == frames
    assert one(spark, f=T.parse_timecode(F.lit("00:61:00:00"), 25)).f is None and one(spark, f=T.parse_timecode(F.lit("1:2:3"), 25)).f is None
    assert [(r.token, r.start) for r in one(spark, o=T.token_offsets(F.lit("A b_2, a"))).o] == [("a", 0), ("b_2", 2), ("a", 7)]


def test_subtitle_merges(spark):
    rows = [(1, 0, 0, 10, 1), (1, 0, 20, 30, 2), (1, 1, 5, 25, 3), (1, 1, 30, 40, 4), (1, 1, 8, 9, 5)]
    df = spark.createDataFrame(rows, "asset long, track long, start long, end long, id long")
    got = {s: sorted((r.id, r.conflicted) for r in media.merge_tracks(df, "asset", s).collect()) for s in media.MERGES}
    assert got["prefer_first"] == got["drop_on_conflict"] == [(1, False), (2, False), (4, False)]
    assert got["prefer_last"] == [(4, False), (5, False)]
    assert got["keep_all"] == [(1, False), (2, False), (3, True), (4, False), (5, True)]
    with pytest.raises(ValueError):
        media.merge_tracks(df, "asset", "other")


def test_line_differences(spark):
    assert media.diff_lines(["a", "b", "c"], ["a", "x", "c"]) == [("unchanged", "a"), ("added", "x"), ("removed", "b"), ("unchanged", "c")]
    df = spark.createDataFrame([(1, None, "a\nb"), (2, "a", None), (3, "", "")], "id long, o string, n string")
    assert [(r.id, r.kind, r.line) for r in media.text_diff(df, "id", "o", "n").collect()] == [(1, "added", "a"), (1, "added", "b"), (2, "removed", "a")]


def test_hour_buckets_begin_with_a_view(spark):
    rows = [(1, t, i) for i, t in enumerate([0, 3599, 3600, 3700, 90_000])]
    got = monitoring.hour_buckets(spark.createDataFrame(rows, "k long, t long, i long"), "k", ["t", "i"], "t").collect()
    assert sorted((r.start, r.n) for r in got) == [(90_000, 1)] or sorted((r.start, r.n) for r in got) == [(3600, 2), (90_000, 1)]
    assert (3600, 2) not in [(r.start, r.n) for r in got]


def test_peaks_keep_the_higher_of_near_ones(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 2.0, 0.0, 3.0, 0.0, 1.0, 0.0, 0.0, 5.0, 0.0])], "k long, i long, v double")
    assert sorted(r.place for r in monitoring.peaks(df, "k", "i", "v", 3).collect()) == [3, 8]


def test_end_to_end_and_hot_path(spark):
    lat = spark.createDataFrame([("a", 10.9, 2), ("b", 5.5, 1)], "stage string, avg_ms double, samples long")
    assert monitoring.end_to_end(lat, "stage", ["a", "b", "a", "z"]).first().total_ms == 25
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (4, 3)], "src long, dst long")
    weights = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 9.0), (4, 2.0)], "node long, weight double")
    assert [r.node for r in graph.hot_path(edges, weights).orderBy("step").collect()] == [1, 3, 4]


def test_rights_rules(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, a=R.country_allowed(F.lit("us"), [], ["US"]), b=R.country_allowed(F.lit("fr"), ["FR"], []), c=R.country_allowed(F.lit("de"), ["FR"], []), d=R.country_allowed(F.lit("de"), [], [])).asDict() == {"a": False, "b": True, "c": False, "d": True}
    assert one(spark, a=R.embargo_days(F.lit(86_400 * 2 - 1), F.lit(0)), b=R.embargo_days(F.lit(0), F.lit(86_400 + 5))).asDict() == {"a": 1, "b": -1}
    assert one(spark, a=R.common_countries(F.array(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a")))), b=R.common_countries(F.array().cast("array<array<string>>"))).asDict() == {"a": ["a"], "b": []}
    r = one(spark, d=R.next_occurrence(ts("2024-01-10 08:00:00"), ts("2024-01-01 08:00:00"), "daily", 2), m=R.next_occurrence(ts("2024-01-31 08:00:00"), ts("2024-01-01 08:00:00"), "monthly", 1, day=31), y=R.next_occurrence(ts("2024-03-01 08:00:00"), ts("2024-01-01 08:00:00"), "yearly", month=2, day=29), e=R.next_occurrence(ts("2024-01-10 08:00:00"), ts("2024-01-01 08:00:00"), "daily", 2, end=ts("2024-01-12 08:00:00")), w=R.next_occurrence(ts("2024-01-01 08:00:00"), ts("2024-01-01 08:00:00"), "weekly", 1, days=(2,)))
    assert [str(x) for x in (r.d, r.m, r.y, r.w)] == ["2024-01-12 08:00:00", "2024-01-31 08:00:00", "2024-03-01 08:00:00", "2024-01-03 08:00:00"] and r.e is None


def test_metadata_maps(spark):
    parent = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    child = F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"))
    r = one(spark, m=media.inherited(parent, child), s=media.with_fields(parent, {"a": "9"}), n=media.with_fields(parent, {}), t=media.converted_fields(F.create_map(F.lit("TYER"), F.lit("1999"), F.lit("TDRC"), F.lit("2000"), F.lit("Q"), F.lit("x")), media.ID3_TO_VORBIS))
    assert r.m == {"a": "1", "b": "3", "c": "4"} and r.s == {"a": "9", "b": "2"} and r.n == {"a": "1", "b": "2"} and r.t == {"DATE": "2000"}


def test_suggestions_match_brute_force(spark):
    words, known = ["vidio", "audio", "media", "", "xyz"], ["video", "audio", "media", "radio", "idea", "a"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    frames = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in (words, known)]
    for exact in (False, True):
        got = {(r.word, r.suggestion, r.distance) for r in similarity.suggestions(*frames, 2, exact).collect()}
        assert got == {(a, b, d) for a in words for b in known if (d := edits(a, b)) <= 2 and (exact or d)}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits, hashes, table = similarity.bloom_filter(keys, "key", 1000, 0.01)
    others = spark.range(1000, 6000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert similarity.bloom_maybe(keys, "key", bits, hashes, table).count() == 1000
    assert similarity.bloom_maybe(others, "key", bits, hashes, table).count() <= 100


def test_bit_sampling_recall(spark):
    import random

    rnd = random.Random(2)
    hashes = [rnd.getrandbits(64) for _ in range(100)]
    near = [h ^ sum(1 << b for b in rnd.sample(range(64), 3)) for h in hashes]
    signed = [[(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hs)] for hs in (hashes, near)]
    known, asked = (spark.createDataFrame(rows, f"{n} long, bits long") for rows, n in zip(signed, ("id", "query_id"), strict=True))
    found = similarity.bit_sampling_candidates(asked, known, similarity.bit_samples(64, 12, 6, 5), 3).where("id = query_id").count()
    assert found >= 95


def test_fingerprint_search(spark):
    df = spark.createDataFrame([(1, bytearray(b"....needle..")), (2, bytearray(b"nee")), (3, bytearray(b"")), (4, None)], "id long, print binary")
    got = {r.id: r for r in similarity.fingerprint_matches(df, b"needle", 0.99).collect()}
    assert set(got) == {1, 2} and got[1].offset_ms == 4 * 512 * 1000 // 48_000 and got[2].offset_ms == 0
    assert similarity.fingerprint_matches(df, b"", 0.0).count() == 0


def test_shared_segments_are_found_at_any_offset(spark):
    import random

    rnd = random.Random(4)
    common = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    df = spark.createDataFrame([(1, "x" * 11 + common), (2, common[:2500] + "tail"), (3, "other"), (4, None)], "id long, t string")
    chunks = similarity.segment_chunks(df, "id", "t", 6)
    assert {r.id: r.n for r in chunks.groupBy("id").agg(F.sum("size").alias("n")).collect()} == {1: 3011, 2: 2504, 3: 5}
    assert sum(r.size for r in similarity.shared_segments(chunks, "id", 8).collect()) > 1500


@pytest.mark.parametrize("depth", [230])
def test_deep_graphs(spark, depth):
    nodes = spark.range(depth).select(F.col("id").alias("node")).coalesce(1)
    chain = spark.range(depth - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    assert graph.components(chain).agg(F.count("*"), F.max("component")).first()[:] == (depth, 0)
    got = graph.ancestors(nodes.where(f"node = {depth - 1}"), chain)
    assert got.agg(F.count("*"), F.max("depth")).first()[:] == (depth, depth - 1)
