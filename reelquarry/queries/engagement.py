"""Engagement, statistics, windows and monitoring over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.functions import scoring as S
from reelquarry.operators import aggregates as A
from reelquarry.operators import windows as Wn
from reelquarry.registry import query
from reelquarry.tables import VIEWS_SQL, load, views

V = f"WITH {VIEWS_SQL} "


def _now(v: DataFrame) -> DataFrame:
    """One row: the latest time."""
    return v.agg(F.max("t").alias("now"))


@query("trending_top", V + """, n AS (SELECT max(t) AS now FROM views),
g AS (SELECT item_id, sum(exp(-ln(2) * (now - t) / 86400)) AS w, count(DISTINCT user_id) AS u, avg(duration) AS d FROM views, n GROUP BY item_id)
SELECT item_id, round(w * greatest(ln(u + 1), 1), 4) AS score, CAST(floor(w) AS BIGINT) AS view_count, u AS unique_viewers, round(d, 6) AS avg_duration_s
FROM g ORDER BY score DESC, item_id LIMIT 20""")
def trending_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    # one row is broadcast
    return A.trending(v.crossJoin(F.broadcast(_now(v))), F.col("now")).orderBy(F.desc("score"), "item_id").limit(20)


_PCT = V + """, r AS (SELECT kind, list_sort(list(duration)) AS v, count(*) AS n FROM views GROUP BY kind)
SELECT kind, n, v[greatest(CAST(ceil({p} / 100.0 * n) AS BIGINT) - 1, 0) + 1] AS nearest_rank, v[CAST(floor({p} / 100.0 * (n - 1)) AS BIGINT) + 1] AS floor_index,
v[CAST(round({p} / 100.0 * (n - 1)) AS BIGINT) + 1] AS rounded_index, v[least(CAST(floor(n * {p} / 100.0) AS BIGINT), n - 1) + 1] AS floor_n,
round(list_aggregate(v, 'quantile_cont', {q}), 6) AS interpolated, v[n // 2 + 1] AS upper_median FROM r"""
for _p, _q in ((50.0, 0.5), (95.0, 0.95), (99.0, 0.99)):

    @query(f"percentiles_p{_p:.0f}", _PCT.format(p=_p, q=_q))
    def _percentiles(spark: SparkSession, sf_dir: str, p: float = _p) -> DataFrame:
        return A.percentile_conventions(views(spark, sf_dir), "kind", "duration", p)


@query("metric_rollup_hour", V + """SELECT kind, t // 3600 * 3600 AS bucket, count(*) AS n, min(duration) AS min_v, max(duration) AS max_v, round(avg(duration), 6) AS avg_v,
round(sum(duration), 4) AS sum_v, round(CASE WHEN count(*) >= 2 THEN max_by(duration, event_id) - min_by(duration, event_id) END, 6) AS rate_v FROM views GROUP BY ALL""")
def metric_rollup_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir).withColumn("bucket", F.floor(F.col("t") / 3600) * 3600)
    return A.full_rollup(v, ["kind", "bucket"], "duration", "event_id")


@query("quality_pooling", V + """SELECT kind, count(*) AS n, round(avg(duration), 6) AS mean, round(count(*) / sum(1 / greatest(duration, 1e-10)), 6) AS harmonic,
round(stddev_pop(duration), 6) AS std, round(CASE WHEN count(*) < 2 THEN 1 WHEN abs(avg(duration)) < 1e-12 THEN CASE WHEN stddev_pop(duration) < 1e-12 THEN 1 ELSE 0 END ELSE greatest(least(1 - stddev_pop(duration) / avg(duration), 1), 0) END, 6) AS stability,
round(avg(CASE WHEN duration < 50 THEN 1 ELSE 0 END), 6) AS below_50 FROM views GROUP BY kind""")
def quality_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary_statistics(views(spark, sf_dir), ["kind"], "duration")


@query("facets", """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS field, coalesce(lang, source) AS value, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    rows = d.groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").alias("g"))
    return rows.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("field"), F.coalesce("lang", "source").alias("value"), "n")


@query("facet_top5", """SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 5""")
def facet_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(5)


@query("query_statistics", V + "SELECT lower(kind) AS q, count(*) AS n, min(duration) AS lo, max(duration) AS hi, round(avg(duration), 6) AS mean, count(DISTINCT user_id) AS users FROM views GROUP BY 1")
def query_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy(F.lower("kind").alias("q")).agg(F.count("*").alias("n"), F.min("duration").alias("lo"), F.max("duration").alias("hi"), F.round(F.avg("duration"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("heatmap_density", V + """, g AS (SELECT CAST(floor(duration / 50) AS BIGINT) AS cx, t % 86400 // 3600 AS cy, count(*) AS n FROM views WHERE duration >= 0 AND duration < 500 GROUP BY ALL)
SELECT cx, cy, n, round(n / max(n) OVER (), 6) AS density FROM g""")
def heatmap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views(spark, sf_dir).where("duration >= 0 AND duration < 500").groupBy(F.floor(F.col("duration") / 50).alias("cx"), F.floor(F.col("t") % 86400 / 3600).alias("cy")).agg(F.count("*").alias("n"))
    top = g.agg(F.max("n").alias("top"))
    return g.crossJoin(F.broadcast(top)).select("cx", "cy", "n", F.round(F.col("n") / F.col("top"), 6).alias("density"))


@query("segment_retention", V + """, s AS (SELECT unnest([100, 200, 300, 400]) AS seg_end), r AS (SELECT seg_end, avg(CASE WHEN duration >= seg_end THEN 1 ELSE 0 END) AS retention FROM views, s GROUP BY 1)
SELECT seg_end, round(retention, 6) AS retention, coalesce(lag(retention) OVER (ORDER BY seg_end) - retention > 0.1, false) AS drops FROM r""")
def segment_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = (100, 200, 300, 400)
    one = views(spark, sf_dir).agg(*[F.avg((F.col("duration") >= e).cast("int")).alias(f"r{e}") for e in ends])
    rows = one.select(F.posexplode(F.array(*[F.struct(F.lit(e).alias("seg_end"), F.col(f"r{e}").alias("retention"), (F.col(f"r{p}") - F.col(f"r{e}") > 0.1 if p else F.lit(False)).alias("drops")) for p, e in zip((None, *ends), ends, strict=False)])).alias("i", "s"))
    return rows.select("s.seg_end", F.round("s.retention", 6).alias("retention"), "s.drops")


@query("exact_duplicates", """SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, CAST(sum(n_chars) - min_by(n_chars, doc_id) AS BIGINT) AS wasted FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_groups(load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), F.md5("text"), "doc_id", "n_chars")


@query("dedup_summary", """WITH g AS (SELECT md5(text) AS d, count(*) AS n, sum(n_chars) - min_by(n_chars, doc_id) AS w FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS distinct_files, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(w) AS BIGINT) AS wasted, round(count(*) / sum(n), 6) AS dedup_ratio, round(100 * (1 - count(*) / sum(n)), 4) AS savings_pct FROM g""")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("d")).agg(F.count("*").alias("n"), (F.sum("n_chars") - F.min_by("n_chars", F.col("doc_id"))).alias("w"))
    ratio = F.coalesce(F.try_divide(F.count("*"), F.sum("n")), F.lit(1.0))
    return g.agg(F.sum("n").alias("files"), F.count("*").alias("distinct_files"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("w").alias("wasted"), F.round(ratio, 6).alias("dedup_ratio"), F.round(100 * (1 - ratio), 4).alias("savings_pct"))


@query("content_statistics", V + """SELECT item_id, count(*) AS views, count(DISTINCT user_id) AS viewers, CAST(floor(sum(CAST(duration AS BIGINT)) / count(*)) AS BIGINT) AS avg_watch,
round(avg(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END), 6) AS completion FROM views GROUP BY item_id""")
def content_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, viewers, mean whole seconds (halves go to the even one, as SQL casts) and share of purchases of each item."""
    return views(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("viewers"), F.floor(F.sum(F.bround("duration").cast("long")) / F.count("*")).alias("avg_watch"), F.round(F.avg((F.col("kind") == "purchase").cast("int")), 6).alias("completion"))


@query("viewing_patterns", V + """, h AS (SELECT t % 86400 // 3600 AS hour, count(*) AS n, sum(duration) AS w FROM views GROUP BY 1) SELECT hour, n, round(w, 4) AS watched, n = max(n) OVER () AS peak FROM h""")
def viewing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views(spark, sf_dir).groupBy(F.hour(F.timestamp_seconds("t")).cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("watched"))
    return h.crossJoin(F.broadcast(h.agg(F.max("n").alias("top")))).select("hour", "n", "watched", (F.col("n") == F.col("top")).alias("peak"))


@query("top_content", V + "SELECT item_id, round(sum(duration), 4) AS watched FROM views GROUP BY 1 ORDER BY watched DESC, item_id LIMIT 10")
def top_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("item_id").agg(F.round(F.sum("duration"), 4).alias("watched")).orderBy(F.desc("watched"), "item_id").limit(10)


@query("familiarity", V + "SELECT user_id, item_id, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS familiarity FROM views GROUP BY 1, 2")
def familiarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    totals = v.groupBy("user_id").agg(F.count("*").alias("all_n"))
    return v.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).join(totals, "user_id").select("user_id", "item_id", F.round(F.col("n") / F.col("all_n"), 6).alias("familiarity"))


@query("duration_histogram", V + """, e AS (SELECT min(duration) AS lo, max(duration) AS hi, greatest(ceil((max(duration) - min(duration)) / 10), 1) AS width FROM views),
c AS (SELECT least(CAST(floor((duration - lo) / width) AS BIGINT), 9) AS bucket, count(*) AS n FROM views, e GROUP BY 1)
SELECT round(CASE WHEN lo = hi THEN hi ELSE lo + (b.bucket + 1) * width END, 6) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bucket) b CROSS JOIN e LEFT JOIN c USING (bucket) WHERE lo < hi OR b.bucket = 0""")
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(views(spark, sf_dir), "duration", 10).withColumn("upper", F.round("upper", 6))


@query("iqr_outliers", V + """, q AS (SELECT kind, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3 FROM views GROUP BY 1 HAVING count(*) >= 4)
SELECT event_id, kind, (duration < q1 - 3 * (q3 - q1) OR duration > q3 + 3 * (q3 - q1)) AS extreme FROM views JOIN q USING (kind) WHERE duration < q1 - 1.5 * (q3 - q1) OR duration > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.iqr_outliers(views(spark, sf_dir), "kind", "duration").select("event_id", "kind", "extreme")


@query("rolling_zscore", V + """, z AS (SELECT event_id, duration, count(*) OVER w AS n, avg(duration) OVER w AS m, stddev_pop(duration) OVER w AS s FROM views
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round((duration - m) / s, 4) AS z FROM z WHERE n >= 2 AND s > 1e-9 AND abs((duration - m) / s) > 3""")
def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.rolling_z(views(spark, sf_dir), "user_id", ["t", "event_id"], "duration", 20).where("abs(z) > 3").select("event_id", F.round("z", 4).alias("z"))


@query("sessions", V + """, a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 1800 THEN 1 ELSE 0 END AS b FROM views),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM a)
SELECT user_id, session, min(t) AS start_t, max(t) AS end_t, count(*) AS events, round(sum(duration), 4) AS watched FROM s GROUP BY 1, 2""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.sessions(views(spark, sf_dir))


@query("binge_watching", V + """, a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 7200 THEN 1 ELSE 0 END AS b FROM views),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM a), r AS (SELECT user_id, run, count(*) AS n, max(run) OVER (PARTITION BY user_id) AS last FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS binges, max(n) AS longest FROM r WHERE n >= 3 AND run < last GROUP BY 1""")
def binge_watching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.binges(views(spark, sf_dir), 7200)


@query("session_statistics", V + """, a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 1800 THEN 1 ELSE 0 END AS b FROM views),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM a), g AS (SELECT user_id, session, max(t) - min(t) AS len, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, CAST(sum(len) // count(*) AS BIGINT) AS avg_len, max(n) AS longest FROM g GROUP BY 1""")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Wn.sessions(views(spark, sf_dir))
    return g.groupBy("user_id").agg(F.count("*").alias("sessions"), F.floor(F.sum(F.col("end_t") - F.col("start_t")) / F.count("*")).alias("avg_len"), F.max("events").alias("longest"))


@query("uptime", V + """, n AS (SELECT max(t) AS now FROM views), h AS (SELECT user_id, kind, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), now) - t AS held FROM views, n)
SELECT user_id, round(coalesce(100.0 * sum(CASE WHEN kind <> 'error' THEN held ELSE 0 END) / nullif(sum(held), 0), 0), 6) AS uptime_pct FROM h GROUP BY 1""")
def uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return Wn.uptime(v.crossJoin(F.broadcast(_now(v))), "user_id", "t", F.col("kind") != "error", F.col("now"))


@query("status_transitions", V + """, l AS (SELECT event_id, user_id, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM views)
SELECT event_id, user_id, previous, kind FROM l WHERE previous IS NULL OR previous <> kind""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.transitions(views(spark, sf_dir), "user_id", "t", "kind").select("event_id", "user_id", "previous", "kind")


@query("throughput_window", V + """SELECT event_id, round(sum(duration) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) * 8 / 3600, 6) AS mbps FROM views""")
def throughput_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-3600, 0)
    return views(spark, sf_dir).select("event_id", F.round(F.sum("duration").over(w) * 8 / 3600, 6).alias("mbps"))


@query("quota_window", """WITH RECURSIVE """ + VIEWS_SQL + """, o AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM views),
f AS (SELECT user_id, n, event_id, CAST(0 AS BIGINT) AS within, true AS allowed, CAST(NULL AS BIGINT) AS retry_after, [t] AS held FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.n, o.event_id, len(k), len(k) < 3, CASE WHEN len(k) >= 3 THEN k[1] + 86400 - t END, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END
FROM (SELECT o.*, list_filter(f.held, lambda x: x >= o.t - 86400) AS k FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1) AS o)
SELECT event_id, within, allowed, retry_after FROM f""")
def quota_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.operators.quota import sliding_quota

    return sliding_quota(views(spark, sf_dir), "user_id", ["t", "event_id"], "t", "event_id", 3, 86_400).drop("user_id")


@query("frequency_buckets", V + """, u AS (SELECT min(t) AS lo, max(t) AS hi FROM views), s AS (SELECT unnest(range(0, (hi - lo) // 86400 + 1)) AS bucket FROM u),
c AS (SELECT (t - lo) // 86400 AS bucket, count(*) AS n FROM views, u GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (bucket)""")
def frequency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    edge = v.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    slots = edge.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 86400))).alias("bucket"))
    counted = v.crossJoin(F.broadcast(edge)).groupBy(F.floor((F.col("t") - F.col("lo")) / 86400).alias("bucket")).agg(F.count("*").alias("n"))
    return slots.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("seasonal_anomalies", V + """, d AS (SELECT kind, t // 3600 AS h, sum(duration) AS v FROM views GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) - 1 AS i FROM d),
tr AS (SELECT *, CASE WHEN count(v) OVER c = 25 THEN avg(v) OVER c ELSE avg(v) OVER (PARTITION BY kind) END AS trend FROM i WINDOW c AS (PARTITION BY kind ORDER BY h ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
se AS (SELECT *, avg(v - trend) OVER (PARTITION BY kind, i % 24) AS season FROM tr), re AS (SELECT *, v - trend - season AS residual FROM se),
st AS (SELECT *, avg(residual) OVER (PARTITION BY kind) AS m, stddev_pop(residual) OVER (PARTITION BY kind) AS s FROM re)
SELECT kind, h, round(residual, 4) AS residual FROM st WHERE s >= 1.1920929e-07 AND abs(residual - m) > 2.5 * s""")
def seasonal_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / 3600).alias("h")).agg(F.sum("duration").alias("v"))
    return Wn.seasonal_anomalies(d, "kind", "h", "v", 24, 2.5).select("kind", "h", F.round("residual", 4).alias("residual"))


@query("slo_compliance", V + "SELECT kind, round(100.0 * avg(CASE WHEN duration <= 200 THEN 1 ELSE 0 END), 6) AS latency_pct, round(100.0 * avg(CASE WHEN duration >= 20 THEN 1 ELSE 0 END), 6) AS throughput_pct FROM views GROUP BY 1")
def slo_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("kind").agg(F.round(100.0 * F.avg((F.col("duration") <= 200).cast("int")), 6).alias("latency_pct"), F.round(100.0 * F.avg((F.col("duration") >= 20).cast("int")), 6).alias("throughput_pct"))


@query("decay_functions", V + """, n AS (SELECT max(t) AS now FROM views), a AS (SELECT event_id, (now - t) / 3600.0 AS age, duration FROM views, n)
SELECT event_id, round(exp(-ln(24.0) / 24.0 * age), 6) AS expo, round(greatest(1 - age / 240.0, 0), 6) AS linear, round(CASE WHEN age > 0 THEN 1 / ln(1 + age) END, 6) AS loga,
round(1 / power(1 + age, 2), 6) AS poly, round(exp(-(age * age) / (2 * 48.0 * 48.0)), 6) AS gauss, CASE WHEN age < 24 THEN 1.0 WHEN age < 168 THEN 0.5 ELSE 0.1 END::DOUBLE AS step,
round(exp(-ln(2) * age / 24.0), 6) AS half, round(duration / power(age + 2, 1.8), 6) AS hn FROM a""")
def decay_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    v = v.crossJoin(F.broadcast(_now(v)))
    age = (F.col("now") - F.col("t")) / 3600.0
    cols = {"expo": S.exponential_decay(age, 24.0), "linear": S.linear_decay(age, 240.0), "loga": S.logarithmic_decay(age), "poly": S.polynomial_decay(age, 2), "gauss": S.gaussian_decay(age, 48.0), "half": S.half_life_weight(age, 24.0), "hn": S.hackernews_score(F.col("duration"), age)}
    return v.select("event_id", *[F.round(c, 6).alias(k) for k, c in cols.items()], S.step_decay(age, [(24, 1.0), (168, 0.5)], 0.1).alias("step"))


@query("item_scores", V + """, n AS (SELECT max(t) AS now FROM views), g AS (SELECT item_id, count(*) FILTER (WHERE kind = 'purchase') AS up, count(*) FILTER (WHERE kind = 'error') AS down, count(*) AS n, avg(duration) AS m, min(t) AS first, max(t) AS last FROM views GROUP BY 1), a AS (SELECT sum(n) AS total FROM g)
SELECT item_id, round(sign(up - down) * CASE WHEN up = down THEN 1 ELSE greatest(log10(abs(up - down)), 1) END + greatest(last - 1114293600, 0) / 45000.0, 6) AS hot, round(m + sqrt(2) * sqrt(ln(total) / g.n), 6) AS ucb, round((1.0 + up) / (2 + up + down), 6) AS thompson,
round(0.3 * exp(-0.1 * (now - last) / 3600.0) + 0.4 * CASE WHEN g.n * 24 * 3600.0 / greatest(last - first, 3600) < 1 THEN 0 ELSE least(ln(g.n * 24 * 3600.0 / greatest(last - first, 3600)) / 10, 1) END + 0.3 * up / g.n, 6) AS composite, round(greatest(m * 12.5 / 100, 20), 6) AS royalty FROM g, a, n""")
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every item; views per hour are taken 24-fold, so that the series spans the velocity's range."""
    v = views(spark, sf_dir)
    g = v.groupBy("item_id").agg(F.count_if(F.col("kind") == "purchase").alias("up"), F.count_if(F.col("kind") == "error").alias("down"), F.count("*").alias("n"), F.avg("duration").alias("m"), F.min("t").alias("first"), F.max("t").alias("last"))
    # one row is broadcast
    g = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total"), F.max("last").alias("now"))))
    c = F.col
    hourly = c("n") * 24 * 3600.0 / F.greatest(c("last") - c("first"), F.lit(3600))
    composite = S.trending_composite((c("now") - c("last")) / 3600.0, hourly, c("up") / c("n"))
    return g.select("item_id", F.round(S.reddit_hot_score(c("up"), c("down"), c("last")), 6).alias("hot"), F.round(S.ucb(c("m"), c("total"), c("n")), 6).alias("ucb"), F.round(S.thompson_mean(c("up"), c("down")), 6).alias("thompson"), F.round(composite, 6).alias("composite"), F.round(S.royalty(c("m"), 12.5, 20.0), 6).alias("royalty"))


@query("funnel", V + """, f AS (SELECT user_id, min(t) FILTER (WHERE kind = 'view') AS a, min(t) FILTER (WHERE kind = 'click') AS b, min(t) FILTER (WHERE kind = 'purchase') AS c FROM views GROUP BY 1)
SELECT count(a) AS viewed, count(*) FILTER (WHERE b > a) AS clicked, count(*) FILTER (WHERE b > a AND c > b) AS bought FROM f""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views(spark, sf_dir).groupBy("user_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("t"))).alias(n) for k, n in (("view", "a"), ("click", "b"), ("purchase", "c"))])
    return f.agg(F.count("a").alias("viewed"), F.count_if(F.expr("b > a")).alias("clicked"), F.count_if(F.expr("b > a AND c > b")).alias("bought"))


@query("cohort_matrix", V + """, f AS (SELECT user_id, min(t) // 604800 AS cohort FROM views GROUP BY 1) SELECT cohort, t // 604800 - cohort AS week, count(DISTINCT user_id) AS users FROM views JOIN f USING (user_id) GROUP BY ALL""")
def cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir).withColumn("w", F.floor(F.col("t") / 604800))
    f = v.groupBy("user_id").agg(F.min("w").alias("cohort"))
    return v.join(f, "user_id").groupBy("cohort", (F.col("w") - F.col("cohort")).alias("week")).agg(F.countDistinct("user_id").alias("users"))


@query("ab_test", V + """, g AS (SELECT user_id % 2 AS variant, count(*) AS n, count(*) FILTER (WHERE kind = 'purchase') AS s FROM views GROUP BY 1), p AS (SELECT sum(n) FILTER (WHERE variant = 0) AS n0, sum(s) FILTER (WHERE variant = 0) AS s0, sum(n) FILTER (WHERE variant = 1) AS n1, sum(s) FILTER (WHERE variant = 1) AS s1 FROM g)
SELECT round(s0 / n0, 6) AS rate_a, round(s1 / n1, 6) AS rate_b, round((s1 / n1 - s0 / n0) / sqrt((s0 + s1) / (n0 + n1) * (1 - (s0 + s1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 6) AS z FROM p""")
def ab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b = views(spark, sf_dir), F.col("kind") == "purchase"
    p = v.agg(*[x for i in (0, 1) for x in (F.count_if(F.col("user_id") % 2 == i).alias(f"n{i}"), F.count_if((F.col("user_id") % 2 == i) & b).alias(f"s{i}"))])
    return p.selectExpr("round(s0 / n0, 6) AS rate_a", "round(s1 / n1, 6) AS rate_b", "round((s1 / n1 - s0 / n0) / sqrt((s0 + s1) / (n0 + n1) * (1 - (s0 + s1) / (n0 + n1)) * (1 / n0 + 1 / n1)), 6) AS z")


@query("engagement_slope", V + """, d AS (SELECT user_id, t // 86400 AS d, sum(duration) AS v FROM views GROUP BY ALL) SELECT user_id, round(regr_slope(v, d), 4) AS slope FROM d GROUP BY 1 HAVING count(*) >= 2""")
def engagement_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 86400).alias("d")).agg(F.sum("duration").alias("v"))
    return d.groupBy("user_id").agg(F.round(F.regr_slope("v", "d"), 4).alias("slope"), F.count("*").alias("n")).where("n >= 2").drop("n")


@query("sliding_metrics", V + """, b AS (SELECT kind, unnest([t // 1800 * 1800 - 1800, t // 1800 * 1800]) AS start, duration FROM views) SELECT kind, start, count(*) AS n, round(sum(duration), 4) AS total FROM b GROUP BY ALL""")
def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir).withColumn("at", F.timestamp_seconds("t"))
    return v.groupBy("kind", F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total")).select("kind", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("latest_per_user", V + "SELECT user_id, max_by(kind, event_id) AS kind, max(event_id) AS event_id FROM views GROUP BY 1")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("user_id").agg(F.max_by("kind", "event_id").alias("kind"), F.max("event_id").alias("event_id"))


@query("recent_per_user", V + "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS rank FROM views) WHERE rank <= 5")
def recent_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.top_per_group(views(spark, sf_dir), "user_id", [F.desc("t"), F.desc("event_id")], 5).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("leaderboard", V + ", b AS (SELECT user_id, max(duration) AS best FROM views GROUP BY 1) SELECT user_id, best, row_number() OVER (ORDER BY best DESC, user_id) AS place FROM b QUALIFY place <= 50")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = views(spark, sf_dir).groupBy("user_id").agg(F.max("duration").alias("best")).orderBy(F.desc("best"), "user_id").limit(50)
    from pyspark.sql import Window as W

    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("best"), "user_id")).cast("long"))


@query("alert_rules", V + """, m AS (SELECT kind AS metric, duration AS value, event_id FROM views), r(metric, op, low, high, rule) AS (VALUES ('error', 'above', 0.0, 200.0, 'slow error'), ('click', 'below', 1.0, 0.0, 'short click'), ('view', 'outside', 1.0, 300.0, 'odd view'), ('purchase', 'inside', 100.0, 101.0, 'fixed price'))
SELECT event_id, rule FROM m JOIN r USING (metric) WHERE (op = 'above' AND value > high) OR (op = 'below' AND value < low) OR (op = 'outside' AND (value < low OR value > high)) OR (op = 'inside' AND value >= low AND value <= high)""")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.operators.joins import alert_rules as join_rules

    rules = [("error", "above", 0.0, 200.0, "slow error"), ("click", "below", 1.0, 0.0, "short click"), ("view", "outside", 1.0, 300.0, "odd view"), ("purchase", "inside", 100.0, 101.0, "fixed price")]
    # a literal table of four rows
    table = F.broadcast(spark.createDataFrame(rules, "metric string, op string, low double, high double, rule string"))
    return join_rules(views(spark, sf_dir).select(F.col("kind").alias("metric"), F.col("duration").alias("value"), "event_id"), table).select("event_id", "rule")
