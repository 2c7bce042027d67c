"""Recommendation, trending, feedback and engagement beyond plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelquarry.functions import hashing as H
from reelquarry.functions import scoring as S
from reelquarry.functions import vectors as X
from reelquarry.operators import monitoring as M
from reelquarry.operators import similarity as Sm
from reelquarry.operators import windows as Wn
from reelquarry.registry import query
from reelquarry.tables import RATINGS_SQL, VIEWS_SQL, load, ratings, views

V, R = f"WITH {VIEWS_SQL} ", f"WITH {RATINGS_SQL} "
VR = f"WITH RECURSIVE {VIEWS_SQL} "
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({}, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    # one row is broadcast
    return v.crossJoin(F.broadcast(v.agg(F.max("t").alias("now"))))


@query("velocity_trending", VR + """, o AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY t, event_id) AS n FROM views),
f AS (SELECT item_id, n, [{'s': t, 'c': CAST(1 AS BIGINT)}] AS held FROM o WHERE n = 1 UNION ALL SELECT o.item_id, o.n, CASE WHEN o.t - f.held[-1].s < 3600 THEN list_append(f.held[:-2], {'s': f.held[-1].s, 'c': f.held[-1].c + 1}) ELSE list_append(list_filter(f.held, lambda x: o.t - x.s < 86400), {'s': o.t, 'c': CAST(1 AS BIGINT)}) END FROM f JOIN o ON f.item_id = o.item_id AND o.n = f.n + 1),
b AS (SELECT item_id, unnest(held) AS h FROM (SELECT item_id, held FROM f QUALIFY n = max(n) OVER (PARTITION BY item_id))), n AS (SELECT max(t) AS now FROM views)
SELECT item_id, round(sum(h.c * exp(-ln(6.0) / 6.0 * (now - h.s) / 3600.0)), 6) AS score, round(sum(CASE WHEN h.s >= now - 21600 THEN h.c ELSE 0 END) / 6.0, 6) AS velocity, 0.5::DOUBLE AS engagement_rate FROM b, n GROUP BY 1""")
def velocity_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed hour buckets and view velocity of every item at the latest time."""
    v = views(spark, sf_dir)
    buckets = M.hour_buckets(v, "item_id", ["t", "event_id"], "t").crossJoin(F.broadcast(v.agg(F.max("t").alias("now"))))
    s = M.velocity_trending(buckets, "item_id", F.col("now"))
    return s.select("item_id", F.round("score", 6).alias("score"), F.round("velocity", 6).alias("velocity"), "engagement_rate")


# fixed values: weights of the four methods
WEIGHTS = {"content_based": 0.35, "collaborative": 0.35, "trending": 0.15, "popularity": 0.15}
_METHODS = """m AS (SELECT 'collaborative' AS method, item_id, avg(rating) / 5 AS score FROM ratings GROUP BY 2 UNION ALL SELECT 'popularity', item_id, least(count(*) / 40.0, 1) FROM ratings GROUP BY 2
UNION ALL SELECT 'trending', item_id, least(count(*) / 150.0, 1) FROM views GROUP BY 2 UNION ALL SELECT 'content_based', p_partkey, p_size / 50.0 FROM part)"""


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, item_id, score) of four recommendation methods."""
    r = ratings(spark, sf_dir).groupBy("item_id").agg(F.avg("rating").alias("a"), F.count("*").alias("n"))
    v = views(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    p = load(spark, sf_dir, "part")
    return (
        r.select(F.lit("collaborative").alias("method"), "item_id", (F.col("a") / 5).alias("score"))
        .union(r.select(F.lit("popularity"), "item_id", F.least(F.col("n") / 40.0, F.lit(1.0))))
        .union(v.select(F.lit("trending"), "item_id", F.least(F.col("n") / 150.0, F.lit(1.0))))
        .union(p.select(F.lit("content_based"), "p_partkey", F.col("p_size") / 50.0))
    )


_WEIGHT = "CASE method " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0 END"


@query("hybrid_merge", f"WITH {RATINGS_SQL}, {VIEWS_SQL}, {_METHODS}, s AS (SELECT item_id, round(sum(score * {_WEIGHT}) + 1e-9, 6) AS score FROM m GROUP BY 1) SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 200")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best items by the weighted sum of four methods; unknown methods weigh nothing."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    # a little is added so that sums that end in a half round alike in any order of their parts
    s = _methods(spark, sf_dir).groupBy("item_id").agg(F.round(F.sum(F.col("score") * F.coalesce(F.try_element_at(weights, F.col("method")), F.lit(0.0))) + 1e-9, 6).alias("score"))
    top = s.orderBy(F.desc("score"), "item_id").limit(200)
    # 200 rows
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "item_id")).cast("long"))


_RANKED = "r AS (SELECT method, item_id, row_number() OVER (PARTITION BY method ORDER BY score DESC, item_id) AS rank FROM m)"


@query("interleaved_lists", f"WITH {RATINGS_SQL}, {VIEWS_SQL}, {_METHODS}, {_RANKED} SELECT item_id, method, rank, row_number() OVER (ORDER BY rank, method) AS position FROM r WHERE rank <= 50")
def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of each method, taken in turns."""
    top = Wn.top_per_group(_methods(spark, sf_dir), "method", [F.desc("score"), "item_id"], 50).withColumn("rank", F.col("rank").cast("long"))
    return Wn.interleave(top, "method", "rank").select("item_id", "method", "rank", "position")


@query("normalised_scores", f"WITH {RATINGS_SQL}, {VIEWS_SQL}, {_METHODS} SELECT method, item_id, round(CASE WHEN max(score) OVER (PARTITION BY method) > 0 THEN score / max(score) OVER (PARTITION BY method) ELSE score END, 6) AS score FROM m")
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _methods(spark, sf_dir)
    # one row a method
    top = m.groupBy("method").agg(F.max("score").alias("top"))
    return m.join(top, "method").select("method", "item_id", F.round(F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")), 6).alias("score"))


@query("reranked", R + ", s AS (SELECT item_id, avg(rating) AS score FROM ratings GROUP BY 1) SELECT item_id, round(score * (1 - 0.3), 6) AS adjusted, row_number() OVER (ORDER BY round(score * (1 - 0.3), 6) DESC, item_id) AS rank FROM s QUALIFY rank <= 100")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order by score less the diversity weight, which does not look at other items."""
    s = ratings(spark, sf_dir).groupBy("item_id").agg(F.round(F.avg("rating") * (1 - 0.3), 6).alias("adjusted")).orderBy(F.desc("adjusted"), "item_id").limit(100)
    # 100 rows
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("adjusted"), "item_id")).cast("long"))


@query("rating_blend", f"WITH {RATINGS_SQL}, {VIEWS_SQL}, i AS (SELECT user_id, item_id, arg_max(least(CASE WHEN kind = 'purchase' THEN 4 ELSE 3 END + least(duration * 60000 / 3600000.0 * 0.5, 1), 5), (t, event_id)) AS implicit FROM views GROUP BY 1, 2) SELECT user_id, item_id, round(CASE WHEN rating IS NULL THEN implicit WHEN implicit IS NULL THEN rating ELSE rating * 0.7 + implicit * 0.3 END, 6) AS rating FROM ratings FULL JOIN i USING (user_id, item_id)")
def rating_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ratings blended with those that the last viewing implies (a minute for each unit of its value)."""
    implied = S.watch_rating(F.col("duration") * 60_000, F.col("kind") == "purchase")
    i = views(spark, sf_dir).groupBy("user_id", "item_id").agg(F.max_by(implied, F.struct("t", "event_id")).alias("implicit"))
    return ratings(spark, sf_dir).join(i, ["user_id", "item_id"], "full").select("user_id", "item_id", F.round(S.blended_rating(F.col("rating"), F.col("implicit")), 6).alias("rating"))


@query("implicit_signals", V + """, s AS (SELECT user_id, item_id, least(CASE kind WHEN 'view' THEN 2.0 WHEN 'purchase' THEN 4.0 WHEN 'error' THEN 1.0 ELSE 5.0 END * least(duration / 100, 1), 5) AS r, CASE kind WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -0.3 ELSE 1.2 END AS w FROM views)
SELECT user_id, item_id, round(greatest(least(sum(r * w) / sum(abs(w)), 5), 0), 6) AS rating FROM s GROUP BY 1, 2""")
def implicit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean of a user's signals for an item: views, completions, skips and shares."""
    kind = F.when(F.col("kind") == "view", "view").when(F.col("kind") == "purchase", "completion").when(F.col("kind") == "error", "skip").otherwise("share")
    # fixed values: weights of signals
    w = F.when(kind == "view", 0.5).when(kind == "completion", 1.0).when(kind == "skip", -0.3).otherwise(1.2)
    v = views(spark, sf_dir).select("user_id", "item_id", S.signal_rating(kind, F.col("duration") / 100).alias("r"), w.alias("w"))
    mean = F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum(F.abs("w")))
    return v.groupBy("user_id", "item_id").agg(F.round(F.coalesce(F.greatest(F.least(mean, F.lit(5.0)), F.lit(0.0)), F.lit(0.0)), 6).alias("rating"))


@query("freshness_scores", V + """, g AS (SELECT item_id, (max(t) OVER () - min(t) OVER (PARTITION BY item_id)) // 86400 AS published, (max(t) OVER () - max(t) OVER (PARTITION BY item_id)) // 86400 AS updated, count(*) OVER (PARTITION BY item_id) AS velocity FROM views), d AS (SELECT DISTINCT *, least(published, updated) AS age FROM g)
SELECT item_id, round(least(exp(-ln(2) / 7.0 * age) + least(velocity / 1000.0, 1) * 0.2, 1), 6) AS exponential, round(least(greatest(1 - age / 14.0, 0) + least(velocity / 1000.0, 1) * 0.2, 1), 6) AS linear, round(least(CASE WHEN age <= 7 THEN 1 ELSE 0 END + least(velocity / 1000.0, 1) * 0.2, 1), 6) AS step,
round(least(1 / (1 + log2(1 + age / 7.0)) + least(velocity / 1000.0, 1) * 0.2, 1), 6) AS logarithmic, CASE WHEN published <= 3 THEN 1.5 WHEN published <= 29 THEN 1.2 ELSE 1.0 END::DOUBLE AS boost, round(CASE WHEN velocity < 100 THEN 1 ELSE least(1 + 0.2 * log10(velocity) / 10, 2) END, 6) AS multiplier FROM d""")
def freshness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _timed(spark, sf_dir).groupBy("item_id").agg(F.floor((F.max("now") - F.min("t")) / 86_400).alias("published"), F.floor((F.max("now") - F.max("t")) / 86_400).alias("updated"), F.count("*").alias("velocity"))
    kinds = [F.round(S.freshness(F.col("published"), F.col("updated"), F.col("velocity"), k), 6).alias(k) for k in ("exponential", "linear", "step", "logarithmic")]
    return g.select("item_id", *kinds, S.boost_factor(F.col("published"), [(29, 1.2), (3, 1.5)]).alias("boost"), F.round(S.view_multiplier(F.col("velocity")), 6).alias("multiplier"))


@query("serendipity", R + ", g AS (SELECT item_id, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ratings) AS popularity, avg(rating) / 5 AS relevance FROM ratings GROUP BY 1) SELECT item_id, round((1 - popularity) * relevance, 6) AS serendipity, round((0.6 * relevance + 0.4 * (1 - popularity)) / 1.0, 6) AS combined FROM g")
def serendipity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a user rates an item once, so its ratings are counted; one row is broadcast
    r = ratings(spark, sf_dir)
    g = r.groupBy("item_id").agg(F.count("user_id").alias("u"), (F.avg("rating") / 5).alias("relevance")).crossJoin(F.broadcast(r.agg(F.countDistinct("user_id").alias("n"))))
    rare = 1 - F.col("u") / F.col("n")
    return g.select("item_id", F.round(S.serendipity(rare, F.col("relevance")), 6).alias("serendipity"), F.round(S.weighted_normalise([(F.col("relevance"), 0.6), (rare, 0.4)]), 6).alias("combined"))


@query("field_boosts", "WITH m AS (SELECT p_partkey, list_filter(['title', 'description', 'keywords', 'other'], lambda f: CASE f WHEN 'title' THEN contains(p_name, 'r') WHEN 'description' THEN contains(lower(p_type), 'm') WHEN 'keywords' THEN contains(p_brand, '1') ELSE true END) AS f FROM part) SELECT p_partkey, round(CASE WHEN list_contains(f, 'title') THEN 2.0 ELSE 1 END * CASE WHEN list_contains(f, 'description') THEN 1.5 ELSE 1 END * CASE WHEN list_contains(f, 'keywords') THEN 1.3 ELSE 1 END, 6)::DOUBLE AS boost FROM m")
def field_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = F.array_compact(F.array(F.when(F.contains("p_name", F.lit("r")), "title"), F.when(F.contains(F.lower("p_type"), F.lit("m")), "description"), F.when(F.contains("p_brand", F.lit("1")), "keywords"), F.lit("other")))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(S.field_boost(matched), 6).alias("boost"))


@query("explanations", R + ", g AS (SELECT item_id, count(*) AS n, avg(rating) / 5 AS s FROM ratings GROUP BY 1) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Popular with ' || n || ' views' WHEN 1 THEN 'New content from ' || n || ' days ago' WHEN 2 THEN 'Similar to content you enjoyed (' || CAST(round(s * 100) AS BIGINT) || '% match)' ELSE 'Trending in your area (score: ' || printf('%.1f', round(s, 1)) || ')' END AS reason FROM g")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reason for every item, by template."""
    g = ratings(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), (F.avg("rating") / 5).alias("s"))
    kind = F.col("item_id") % 4
    share = F.round(F.col("s") * 100).cast("long")
    text = (
        F.when(kind == 0, F.format_string("Popular with %d views", "n")).when(kind == 1, F.format_string("New content from %d days ago", "n"))
        .when(kind == 2, F.format_string("Similar to content you enjoyed (%d%% match)", share))
        .otherwise(F.format_string("Trending in your area (score: %.1f)", F.round("s", 1)))
    )
    return g.select("item_id", text.alias("reason"))


@query("preference_decay", V + "SELECT user_id, kind, round(sum(duration) * power(0.9, 7), 4) AS weight FROM views GROUP BY 1, 2")
def preference_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's preferences by kind, as a map, after seven decays by 0.9."""
    own = views(spark, sf_dir).groupBy("user_id", "kind").agg(F.sum("duration").alias("w")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "w"))).alias("m"))
    return own.select("user_id", F.explode(F.transform_values("m", lambda _, w: F.round(w * 0.9**7, 4))).alias("kind", "weight"))


@query("tag_vectors", "WITH t AS (SELECT list_sort(list(DISTINCT p_type)) AS a FROM part) SELECT p_partkey, list_transform(a, lambda x: CASE WHEN p_type = x THEN 1.0 ELSE 0.0 END::DOUBLE)::VARCHAR AS v FROM part, t")
def tag_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot vectors of all parts over the sorted list of their types, as text."""
    p = load(spark, sf_dir, "part")
    # the list of types is one row; there are as many as the catalogue has types
    every = F.broadcast(p.agg(F.array_sort(F.collect_set("p_type")).alias("a")))
    v = X.tag_vector(F.array("p_type"), F.col("a"))
    return p.crossJoin(every).select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ", "), F.lit("]")).alias("v"))


@query("content_neighbours", """WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS t, p_brand AS g FROM part), s AS (SELECT q.p_partkey AS query_id, p.p_partkey AS item_id, round(least(len(list_intersect(q.t, p.t)) / sqrt(len(q.t) * len(p.t)) + CASE WHEN q.g <> '' AND q.g = p.g THEN 0.1 ELSE 0 END, 1), 6) AS similarity FROM p q JOIN p ON q.p_partkey <> p.p_partkey WHERE q.p_partkey % 50 = 0)
SELECT query_id, item_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= 10""")
def content_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts most like every part whose key is divisible by 50, by tags and genre; parts without a common tag or genre score 0 and can't be better."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("tags"), F.col("p_brand").alias("genre"))
    return Sm.nearest_by_tags(p, p.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 10, 6)


@query("experiment_variants", f"WITH h AS (SELECT c_custkey, CAST({_FNV.format(chr(40) + 'c_custkey || ' + chr(39) + ':shelf' + chr(39) + chr(41))} % 10000 AS BIGINT) / 10000.0 AS t FROM customer) SELECT c_custkey, CAST(CASE WHEN t < 0.5 THEN 0 WHEN t < 0.8 THEN 1 ELSE 2 END AS BIGINT) AS variant FROM h")
def experiment_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", H.variant(F.col("c_custkey"), "shelf", [0.5, 0.3, 0.2]).alias("variant"))


@query("query_history", V + "SELECT count(DISTINCT lower(kind)) AS distinct_queries, count(*) AS entries, count(DISTINCT user_id) AS users FROM views")
def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).agg(F.countDistinct(F.lower("kind")).alias("distinct_queries"), F.count("*").alias("entries"), F.countDistinct("user_id").alias("users"))


@query("autocomplete", "WITH s AS (SELECT lower(p_name) AS q, count(*) AS n FROM part GROUP BY 1) SELECT q, n FROM s WHERE starts_with(q, 'red') ORDER BY n DESC, q LIMIT 5")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("q")).agg(F.count("*").alias("n"))
    return s.where(F.startswith("q", F.lit("red"))).orderBy(F.desc("n"), "q").limit(5)


@query("attention_heatmap", V + """, b AS (SELECT item_id, unnest(range(CAST(floor(least(duration, 499) / 50) AS BIGINT) + 1)) AS bucket FROM views WHERE duration >= 0), c AS (SELECT item_id, bucket, count(*) AS n FROM b GROUP BY 1, 2) SELECT item_id, bucket, n, round(n / max(n) OVER (PARTITION BY item_id), 6) AS attention FROM c""")
def attention_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many viewings cover each fiftieth second of an item, and the share of its most covered one."""
    b = views(spark, sf_dir).where("duration >= 0").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.least(F.col("duration"), F.lit(499)) / 50))).alias("bucket"))
    c = b.groupBy("item_id", "bucket").agg(F.count("*").alias("n"))
    return c.select("item_id", "bucket", "n", F.round(F.col("n") / F.max("n").over(W.partitionBy("item_id")), 6).alias("attention"))


@query("device_breakdown", V + """, g AS (SELECT kind, user_id % 3 AS device, count(*) AS n, sum(duration) AS w FROM views GROUP BY CUBE (kind, user_id % 3)) SELECT coalesce(kind, 'all') AS kind, coalesce(CAST(device AS VARCHAR), 'all') AS device, n, round(w, 4) AS watched FROM g""")
def device_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views(spark, sf_dir).withColumn("device", F.col("user_id") % 3).cube("kind", "device").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("watched"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce(F.col("device").cast("string"), F.lit("all")).alias("device"), "n", "watched")


@query("period_delta", V + ", n AS (SELECT max(t) AS now FROM views), p AS (SELECT kind, count(*) FILTER (WHERE t > now - 604800) AS this_week, count(*) FILTER (WHERE t <= now - 604800 AND t > now - 1209600) AS last_week FROM views, n GROUP BY 1) SELECT kind, this_week, last_week, round(100.0 * (this_week - last_week) / nullif(last_week, 0), 6) AS delta_pct FROM p")
def period_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("now") - F.col("t")
    p = _timed(spark, sf_dir).groupBy("kind").agg(F.count_if(age < 604_800).alias("this_week"), F.count_if((age >= 604_800) & (age < 1_209_600)).alias("last_week"))
    return p.select("kind", "this_week", "last_week", F.round(F.try_divide(100.0 * (F.col("this_week") - F.col("last_week")), F.col("last_week")), 6).alias("delta_pct"))


@query("user_loyalty", V + ", n AS (SELECT max(t) AS now FROM views), u AS (SELECT user_id, count(DISTINCT t // 86400) AS days, max(t) AS last, min(t) AS first, max(now) AS now FROM views, n GROUP BY 1) SELECT user_id, days, round(days / ((last - first) // 86400 + 1), 6) AS loyalty, now - last > 259200 AS churned FROM u")
def user_loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active days, their share of the user's span, and whether three days have passed since the last event."""
    u = _timed(spark, sf_dir).groupBy("user_id").agg(F.countDistinct(F.floor(F.col("t") / 86_400)).alias("days"), F.max("t").alias("last"), F.min("t").alias("first"), F.max("now").alias("now"))
    return u.select("user_id", "days", F.round(F.col("days") / (F.floor((F.col("last") - F.col("first")) / 86_400) + 1), 6).alias("loyalty"), (F.col("now") - F.col("last") > 259_200).alias("churned"))


@query("attribution", V + """, p AS (SELECT user_id, event_id, t FROM views WHERE kind = 'purchase'), a AS (SELECT p.event_id, v.item_id, v.t, v.event_id AS touch FROM p JOIN views v ON v.user_id = p.user_id AND v.kind = 'click' AND v.t <= p.t AND v.t > p.t - 86400)
SELECT item_id, count(*) AS touches, round(sum(1.0 / n), 6) AS linear, count(*) FILTER (WHERE last) AS last_touch FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, row_number() OVER (PARTITION BY event_id ORDER BY t DESC, touch DESC) = 1 AS last FROM a) GROUP BY 1""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases credited to the items clicked in the day before: in equal parts, and to the last click. Both sides meet by user and day."""
    v = views(spark, sf_dir).withColumn("d", F.floor(F.col("t") / 86_400))
    p = v.where("kind = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("t").alias("at"), F.explode(F.array(F.col("d"), F.col("d") - 1)).alias("d"))
    c = v.where("kind = 'click'").select("user_id", "d", "item_id", "t", F.col("event_id").alias("touch"))
    a = p.join(c, ["user_id", "d"]).where("t <= at AND t > at - 86400")
    w = W.partitionBy("bought")
    a = a.withColumn("n", F.count("*").over(w)).withColumn("last", F.row_number().over(w.orderBy(F.desc("t"), F.desc("touch"))) == 1)
    return a.groupBy("item_id").agg(F.count("*").alias("touches"), F.round(F.sum(1.0 / F.col("n")), 6).alias("linear"), F.count_if("last").alias("last_touch"))


@query("bandit_arms", V + """, a AS (SELECT item_id % 8 AS arm, count(*) AS pulls, avg(CASE WHEN kind = 'purchase' THEN 1.0 ELSE 0 END) AS mean FROM views GROUP BY 1) SELECT arm, pulls, round(mean, 6) AS mean, round(mean + sqrt(2) * sqrt(ln(sum(pulls) OVER ()) / pulls), 6) AS ucb, round((max(mean) OVER () - mean) * pulls, 6) AS regret FROM a""")
def bandit_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bounds and the regret of eight arms."""
    a = views(spark, sf_dir).groupBy((F.col("item_id") % 8).alias("arm")).agg(F.count("*").alias("pulls"), F.avg((F.col("kind") == "purchase").cast("int")).alias("mean"))
    # one row is broadcast
    a = a.crossJoin(F.broadcast(a.agg(F.sum("pulls").alias("total"), F.max("mean").alias("best"))))
    return a.select("arm", "pulls", F.round("mean", 6).alias("mean"), F.round(S.ucb(F.col("mean"), F.col("total"), F.col("pulls")), 6).alias("ucb"), F.round((F.col("best") - F.col("mean")) * F.col("pulls"), 6).alias("regret"))


@query("benchmark_score", V + """, r AS (SELECT item_id, avg(CASE WHEN duration >= 125 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN duration >= 250 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN duration >= 375 THEN 1.0 ELSE 0 END) AS c FROM views GROUP BY 1) SELECT item_id, round(100 * (least(a / 0.4, 1) + least(b / 0.2, 1) + least(c / 0.1, 1)) / 3, 4) AS score FROM r""")
def benchmark_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention at a quarter, half and three quarters against expected shares, as a score to 100."""
    marks = [(125, 0.4), (250, 0.2), (375, 0.1)]
    r = views(spark, sf_dir).groupBy("item_id").agg(*[F.avg((F.col("duration") >= m).cast("int")).alias(f"r{m}") for m, _ in marks])
    return r.select("item_id", F.round(100 * sum((F.least(F.col(f"r{m}") / e, F.lit(1.0)) for m, e in marks), F.lit(0.0)) / 3, 4).alias("score"))


@query("inverted_index", r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM t GROUP BY 1""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its documents and occurrences; counts are combined within a document, then within a task."""
    from reelquarry.functions.text import tokens

    postings = load(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query("matrix_factors", None)
def matrix_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items of every user by alternating least squares around the mean rating."""
    from reelquarry.operators.models import factorise, recommend_by_factors

    return recommend_by_factors(factorise(ratings(spark, sf_dir), 8, 5, 0.1), 10)


@query("user_clusters", None)
def user_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clusters of users by their shares of event kinds."""
    from reelquarry.operators.models import cluster

    shares = [F.avg((F.col("kind") == k).cast("int")).alias(k) for k in ("view", "click", "purchase", "error", "signup")]
    return cluster(views(spark, sf_dir).groupBy("user_id").agg(*shares), "user_id", ["view", "click", "purchase", "error", "signup"], 5)
