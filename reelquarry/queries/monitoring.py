"""Logs, metric series, latency and call profiles, transfers, batch and cost reports over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.functions import scoring as S
from reelquarry.operators import monitoring as M
from reelquarry.operators import windows as Wn
from reelquarry.registry import query
from reelquarry.tables import VIEWS_SQL, load, views

V = f"WITH {VIEWS_SQL} "
VR = f"WITH RECURSIVE {VIEWS_SQL} "


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events with the latest time as `now`; one row is broadcast."""
    v = views(spark, sf_dir)
    return v.crossJoin(F.broadcast(v.agg(F.max("t").alias("now"))))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select(F.col("kind").alias("metric"), "t", F.col("duration").alias("value"), "event_id", "now")


# each event as a log entry: its level by kind, its message from kind and item
_LEVELS = {"error": "ERROR", "purchase": "WARN", "signup": "INFO", "click": "DEBUG", "view": "TRACE"}
LOGS_SQL = V + ", n AS (SELECT max(t) AS now FROM views), logs AS (SELECT event_id, t, now, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEVELS.items()) + " END AS level, kind || ' of Item ' || item_id AS message FROM views, n) "


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in _LEVELS.items()])
    return _timed(spark, sf_dir).select("event_id", "t", "now", level.alias("level"), F.concat("kind", F.lit(" of Item "), F.col("item_id").cast("string")).alias("message"))


@query("log_levels", LOGS_SQL + "SELECT event_id, level FROM logs WHERE level IN ('WARN', 'ERROR', 'FATAL')")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).where(M.at_least(F.col("level"), "warn")).select("event_id", "level")


@query("log_search", LOGS_SQL + "SELECT event_id, message FROM logs WHERE contains(lower(message), 'of item 7')")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).where(M.contains(F.col("message"), "OF item 7")).select("event_id", "message")


@query("log_prune", LOGS_SQL + "SELECT level, count(*) AS n, min(t) AS oldest FROM logs WHERE t >= now - 604800 GROUP BY 1")
def log_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the log after all entries of more than seven days are gone."""
    kept = _logs(spark, sf_dir).where(F.col("t") >= F.col("now") - 604_800)
    return kept.groupBy("level").agg(F.count("*").alias("n"), F.min("t").alias("oldest"))


@query("series_points", V + ", n AS (SELECT max(t) AS now FROM views) SELECT kind AS metric, t, duration AS value FROM views, n WHERE kind = 'error' AND t >= now - 259200 AND t <= now")
def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.series(_points(spark, sf_dir), "error", F.col("now") - 259_200, F.col("now"))


@query("series_aggregate", V + ", n AS (SELECT max(t) AS now FROM views) SELECT 'error' AS metric, now - 259200 AS t, round(avg(duration), 6) AS value FROM views, n WHERE kind = 'error' AND t >= now - 259200 AND t <= now GROUP BY now")
def series_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.series(_points(spark, sf_dir), "error", F.col("now") - 259_200, F.col("now"), "avg").select("metric", "t", F.round("value", 6).alias("value"))


@query("series_many", V + """, n AS (SELECT max(t) AS now FROM views), p AS (SELECT kind AS metric, duration AS value FROM views, n WHERE t >= now - 604800 AND t <= now)
SELECT 'view' AS metric, 'max' AS aggregate, max(value) AS value FROM p WHERE metric = 'view' UNION ALL SELECT 'view', 'count', CAST(count(*) AS DOUBLE) FROM p WHERE metric = 'view' UNION ALL SELECT 'click', 'min', min(value) FROM p WHERE metric = 'click'""")
def series_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.series_many(_points(spark, sf_dir), [("view", "max"), ("view", "count"), ("click", "min")], F.col("now") - 604_800, F.col("now"))


@query("retention_cleanup", V + ", n AS (SELECT max(t) AS now FROM views), p AS (SELECT t, now, CASE WHEN event_id % 3 = 0 THEN 'raw' WHEN event_id % 3 = 1 THEN 'hour' ELSE 'day' END AS resolution FROM views, n) SELECT resolution, count(*) AS n, min(t) AS oldest FROM p WHERE t >= now - CASE resolution WHEN 'raw' THEN 86400 WHEN 'hour' THEN 604800 ELSE 1728000 END GROUP BY 1")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolution = F.when(F.col("event_id") % 3 == 0, "raw").when(F.col("event_id") % 3 == 1, "hour").otherwise("day")
    kept = M.retained(_timed(spark, sf_dir).withColumn("resolution", resolution), F.col("now"), {"raw": 86_400, "hour": 604_800, "day": 1_728_000})
    return kept.groupBy("resolution").agg(F.count("*").alias("n"), F.min("t").alias("oldest"))


@query("time_ranges", V + ", n AS (SELECT max(t) AS now FROM views) SELECT count(*) FILTER (WHERE t >= now - 5400) AS last_90_minutes, count(*) FILTER (WHERE t >= now - 43200) AS last_12_hours, count(*) FILTER (WHERE t >= now - 259200) AS last_3_days FROM views, n")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t, now = _timed(spark, sf_dir), F.col("t"), F.col("now")
    return v.agg(F.count_if(M.last_range(t, now, 90, "minutes")).alias("last_90_minutes"), F.count_if(M.last_range(t, now, 12, "hours")).alias("last_12_hours"), F.count_if(M.last_range(t, now, 3, "days")).alias("last_3_days"))


@query("ring_buffer", V + ", r AS (SELECT kind, event_id, t, row_number() OVER (PARTITION BY kind ORDER BY t DESC, event_id DESC) AS n FROM views) SELECT kind, event_id FROM r WHERE n <= 100 AND t >= (SELECT max(t) - 172800 FROM views)")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days of buffers that hold 100 points of each metric."""
    return Wn.capacity_window(_timed(spark, sf_dir), "kind", ["t", "event_id"], 100).where(F.col("t") >= F.col("now") - 172_800).select("kind", "event_id")


@query("metric_store", V + ", r AS (SELECT kind, duration, t, event_id, row_number() OVER (PARTITION BY kind ORDER BY t DESC, event_id DESC) AS n FROM views) SELECT kind, count(*) AS samples, max_by(duration, (t, event_id)) AS latest FROM r WHERE n <= 50 GROUP BY 1")
def metric_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Wn.capacity_window(views(spark, sf_dir), "kind", ["t", "event_id"], 50)
    return kept.groupBy("kind").agg(F.count("*").alias("samples"), F.max_by("duration", F.struct("t", "event_id")).alias("latest"))


# each event as a transfer: bytes from its value, none to six seconds
_TRANSFERS = "transfers AS (SELECT kind, CAST(floor(duration * 1000000) AS BIGINT) AS bytes, event_id % 7 AS secs FROM views)"


@query("transfer_statistics", V + f", {_TRANSFERS}, r AS (SELECT *, CASE WHEN secs > 0 THEN bytes / secs / 1048576.0 ELSE 0 END AS mbps FROM transfers) SELECT kind, round(avg(mbps), 6) AS avg_mbps, round(max(mbps), 6) AS peak_mbps, round(avg(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1")
def transfer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views(spark, sf_dir).select("kind", F.floor(F.col("duration") * 1_000_000).alias("bytes"), (F.col("event_id") % 7).alias("secs"))
    s = M.transfer_statistics(t, "kind", "bytes", "secs", F.col("kind") != "error")
    return s.select("kind", *[F.round(c, 6).alias(c) for c in ("avg_mbps", "peak_mbps", "success_rate")], "bytes")


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_latency(views(spark, sf_dir), "kind", "duration")


@query("stage_latency", V + "SELECT kind, round(avg(duration), 6) AS avg_ms, count(*) AS samples FROM views GROUP BY 1")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latency(spark, sf_dir).select("kind", F.round("avg_ms", 6).alias("avg_ms"), "samples")


@query("slowest_stage", V + "SELECT kind, round(avg(duration), 6) AS avg_ms FROM views GROUP BY 1 ORDER BY avg(duration) DESC, kind DESC LIMIT 1")
def slowest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.slowest_stage(_latency(spark, sf_dir), "kind").select("kind", F.round("avg_ms", 6).alias("avg_ms"))


@query("end_to_end_latency", V + ", a AS (SELECT kind, CAST(floor(avg(duration)) AS BIGINT) AS ms FROM views GROUP BY 1) SELECT CAST(sum(CASE kind WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 ELSE 0 END * ms) AS BIGINT) AS total_ms FROM a")
def end_to_end_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.end_to_end(_latency(spark, sf_dir), "kind", ["view", "click", "view", "purchase", "absent"])


@query("cpu_hotspots", V + ", f AS (SELECT item_id, sum(duration) AS total, count(*) AS samples FROM views GROUP BY 1), p AS (SELECT *, 100.0 * total / sum(total) OVER () AS percent FROM f) SELECT item_id, samples, round(percent, 6) AS percent FROM p WHERE percent >= 1.0")
def cpu_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hotspots(views(spark, sf_dir), "item_id", "duration", 1.0).select("item_id", "samples", F.round("percent", 6).alias("percent"))


# a call goes from the kind of a user's event to the kind of the next one
@query("call_edges", V + ", c AS (SELECT lag(kind) OVER (PARTITION BY user_id ORDER BY t, event_id) AS caller, kind AS callee, duration AS spent FROM views) SELECT caller, callee, count(*) AS calls, round(sum(spent), 4) AS total FROM c WHERE caller IS NOT NULL GROUP BY 1, 2")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("t", "event_id")
    calls = views(spark, sf_dir).select(F.lag("kind").over(w).alias("caller"), F.col("kind").alias("callee"), F.col("duration").alias("spent")).where("caller IS NOT NULL")
    return M.call_edges(calls).select("caller", "callee", "calls", F.round("total", 4).alias("total"))


@query("flame_graph", V + """, s AS (SELECT [kind, 'item' || (item_id % 10), 'user' || (user_id % 3), 'leaf'] AS stack FROM views), f AS (SELECT unnest([stack[1:0], stack[1:1], stack[1:2], stack[1:3]]) AS p FROM s)
SELECT array_to_string(p, ';') AS frames, CAST(len(p) AS INTEGER) AS depth, count(*) AS value FROM f GROUP BY 1, 2""")
def flame_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = F.array("kind", F.concat(F.lit("item"), (F.col("item_id") % 10).cast("string")), F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")), F.lit("leaf"))
    return M.fold_stacks(views(spark, sf_dir).select(stack.alias("stack")), "stack", 3)


# orders as tasks of a customer's job: status F succeeded
@query("batch_report", "WITH j AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS rate, sum(o_totalprice) AS ms FROM orders GROUP BY 1) SELECT count(*) AS jobs, count(*) FILTER (WHERE rate < 1) AS failed_jobs, round(avg(rate), 6) AS success_rate, round(avg(ms), 4) AS avg_ms FROM j")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.job_report(load(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice")
    return r.select("jobs", "failed_jobs", F.round("success_rate", 6).alias("success_rate"), F.round("avg_ms", 4).alias("avg_ms"))


@query("task_outcomes", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS errors, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes FROM orders")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outcome_summary(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("task_statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'P') AS in_progress, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'P', 'F')) AS cancelled FROM orders")
def task_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    counts = [F.count_if(status == s).alias(n) for s, n in (("O", "open"), ("P", "in_progress"), ("F", "completed"))]
    return load(spark, sf_dir, "orders").agg(F.count("*").alias("total"), *counts, F.count_if(~status.isin("O", "P", "F")).alias("cancelled"))


@query("counter_totals", V + "SELECT kind, count(*) AS increments, CAST(sum(item_id) AS BIGINT) AS total FROM views GROUP BY 1")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("increments"), F.sum("item_id").alias("total"))


@query("cost_report", """WITH e AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-12-31')
SELECT CASE WHEN grouping(l_suppkey) = 0 THEN 'l_suppkey' WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' ELSE 'all' END AS by, coalesce(CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag) AS value, round(sum(l_extendedprice), 2) AS cost
FROM e GROUP BY GROUPING SETS ((l_suppkey), (l_linenumber), (l_returnflag), ())""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of 1996 and 1997, both bounds included, by job, worker and type."""
    e = load(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate <= TIMESTAMP_NTZ '1997-12-31'")
    return M.cost_report(e, "l_extendedprice", ["l_suppkey", "l_linenumber", "l_returnflag"]).select("by", "value", F.round("cost", 2).alias("cost"))


_DAILY = "d AS (SELECT kind, t // 86400 AS d, round(sum(duration), 4) AS v FROM views GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each kind and day."""
    return views(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / 86_400).alias("d")).agg(F.round(F.sum("duration"), 4).alias("v"))


@query("mann_kendall", V + f""", {_DAILY}, s AS (SELECT a.kind, sum(sign(b.v - a.v)) AS s FROM d a JOIN d b ON a.kind = b.kind AND a.d < b.d GROUP BY 1),
c AS (SELECT kind, v, count(*) AS c FROM d GROUP BY 1, 2), n AS (SELECT kind, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM c GROUP BY 1),
z AS (SELECT kind, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, greatest((n * (n - 1) * (2 * n + 5) - ties) / 18.0, 0) AS variance FROM n JOIN s USING (kind) WHERE n >= 4)
SELECT kind, n, s, round(variance, 6) AS variance, round((s - sign(s)) / sqrt(variance), 6) + 0.0 AS z, abs((s - sign(s)) / sqrt(variance)) > 1.96 AS significant FROM z""")
def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.mann_kendall(_daily(spark, sf_dir), "kind", ["d"], "v")
    return m.select("kind", "n", "s", F.round("variance", 6).alias("variance"), (F.round("z", 6) + 0.0).alias("z"), "significant")


@query("latency_average", VR + """, o AS (SELECT user_id, duration AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM views),
f AS (SELECT user_id, n, v AS ema, v AS least, v AS most FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, 0.2 * o.v + 0.8 * f.ema, least(f.least, o.v), greatest(f.most, o.v) FROM f JOIN o ON f.user_id = o.user_id AND o.n = f.n + 1)
SELECT user_id, n AS calls, round(ema, 6) AS ema, least, most FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id)""")
def latency_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.moving_average(views(spark, sf_dir), "user_id", ["t", "event_id"], "duration", 0.2)
    return m.select("user_id", "calls", F.round("ema", 6).alias("ema"), "least", "most")


@query("signal_peaks", VR + f""", {_DAILY}, w AS (SELECT kind, v, row_number() OVER k - 1 AS place, lag(v) OVER k AS p, lead(v) OVER k AS q FROM d WINDOW k AS (PARTITION BY kind ORDER BY d)),
c AS (SELECT kind, place, v, row_number() OVER (PARTITION BY kind ORDER BY place) AS n FROM w WHERE v > p AND v > q),
f AS (SELECT kind, n, [place] AS held, v AS height FROM c WHERE n = 1 UNION ALL SELECT c.kind, c.n, CASE WHEN c.place - f.held[-1] >= 4 THEN list_append(f.held, c.place) WHEN c.v > f.height THEN list_append(f.held[:-2], c.place) ELSE f.held END, CASE WHEN c.place - f.held[-1] >= 4 OR c.v > f.height THEN c.v ELSE f.height END FROM f JOIN c ON f.kind = c.kind AND c.n = f.n + 1)
SELECT kind, unnest(held) AS place FROM (SELECT kind, held FROM f QUALIFY n = max(n) OVER (PARTITION BY kind))""")
def signal_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.peaks(_daily(spark, sf_dir), "kind", "d", "v", 4)


@query("autocorrelation", V + f""", {_DAILY}, i AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY d) AS i FROM d)
SELECT a.kind, b.i - a.i AS lag, round(sum(a.v * b.v) / 1e6, 4) AS r FROM i a JOIN i b ON a.kind = b.kind AND b.i - a.i BETWEEN 0 AND 4 GROUP BY 1, 2""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.autocorrelation(_daily(spark, sf_dir), "kind", "d", "v", 5).select("kind", "lag", F.round(F.col("r") / 1e6, 4).alias("r"))


@query("seasonal_forecast", V + """, d AS (SELECT kind, t // 3600 AS h, sum(duration) AS v FROM views GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM d),
tr AS (SELECT *, CASE WHEN count(v) OVER c = 25 THEN avg(v) OVER c ELSE avg(v) OVER (PARTITION BY kind) END AS trend FROM i WINDOW c AS (PARTITION BY kind ORDER BY h ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
se AS (SELECT kind, i % 24 AS phase, avg(v - trend) AS season FROM tr GROUP BY 1, 2), la AS (SELECT kind, max(n) AS n, avg(trend) FILTER (WHERE i >= n - 24) AS last FROM tr GROUP BY 1)
SELECT kind, step, round(last + season, 4) AS forecast FROM (SELECT kind, n, last, unnest(range(12)) AS step FROM la) JOIN se USING (kind) WHERE phase = (n + step) % 24""")
def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views(spark, sf_dir).groupBy("kind", F.floor(F.col("t") / 3600).alias("h")).agg(F.sum("duration").alias("v"))
    return Wn.seasonal_forecast(d, "kind", "h", "v", 24, 12).select("kind", "step", F.round("forecast", 4).alias("forecast"))


@query("network_health", V + ", f AS (SELECT item_id % 20 AS flow, count(*) AS sent, count(*) FILTER (WHERE kind = 'error') AS lost, avg(duration * 100) AS jitter FROM views GROUP BY 1) SELECT flow, round(lost / sent, 6) AS loss_rate, round(jitter, 4) AS jitter_us, round((greatest(1 - lost / sent, 0) + greatest(1 - jitter / 50000.0, 0)) / 2, 6) AS health FROM f")
def network_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views(spark, sf_dir).groupBy((F.col("item_id") % 20).alias("flow")).agg(F.count("*").alias("sent"), F.count_if(F.col("kind") == "error").alias("lost"), F.avg(F.col("duration") * 100).alias("jitter"))
    loss = F.coalesce(F.try_divide(F.col("lost"), F.col("sent")), F.lit(0.0))
    return f.select("flow", F.round(loss, 6).alias("loss_rate"), F.round("jitter", 4).alias("jitter_us"), F.round(S.network_health(loss, F.col("jitter")), 6).alias("health"))


@query("regression_compare", V + ", a AS (SELECT item_id, avg(duration) FILTER (WHERE event_id % 2 = 0) AS old, avg(duration) FILTER (WHERE event_id % 2 = 1) AS new FROM views GROUP BY 1), s AS (SELECT item_id, CASE WHEN new > 0 THEN old / new ELSE 1 END AS s FROM a WHERE old IS NOT NULL AND new IS NOT NULL) SELECT item_id, round(s, 6) AS speedup, round((s - 1) * 100, 4) AS change_percent, s > 1.05 AS is_improvement, s < 0.95 AS is_regression FROM s")
def regression_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    a = views(spark, sf_dir).groupBy("item_id").agg(F.avg(F.when(even, F.col("duration"))).alias("old"), F.avg(F.when(~even, F.col("duration"))).alias("new")).where("old IS NOT NULL AND new IS NOT NULL")
    s = a.select("item_id", S.speedup(F.col("old"), F.col("new"), 5.0).alias("s"))
    return s.select("item_id", F.round("s.speedup", 6).alias("speedup"), F.round("s.change_percent", 4).alias("change_percent"), "s.is_improvement", "s.is_regression")


@query("resource_estimates", "SELECT l_orderkey, round(sum(0.5 * l_quantity * l_linenumber), 4) AS cpu, round(sum(2.0 * l_quantity * l_linenumber), 4) AS gpu FROM lineitem GROUP BY 1")
def resource_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, weight = F.col("l_quantity"), F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.round(F.sum(S.resource_cost(r, seconds, weight)), 4).alias(n) for n, r in (("cpu", 0.5), ("gpu", 2.0))])


@query("negative_cache", V + """, m AS (SELECT item_id, max(t) AS recorded FROM views WHERE kind = 'error' GROUP BY 1), n AS (SELECT max(t) AS now FROM views) SELECT item_id, now < recorded + 86400 AS known_miss FROM m, n""")
def negative_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each item's last error still counts as a known miss, for a day."""
    m = _timed(spark, sf_dir).groupBy("item_id").agg(F.max(F.when(F.col("kind") == "error", F.col("t"))).alias("recorded"), F.max("now").alias("now"))
    return m.where("recorded IS NOT NULL").select("item_id", F.expr("now < recorded + 86400").alias("known_miss"))


@query("compression_merge", V + ", p AS (SELECT user_id, CAST(sum(CAST(floor(duration * 100) AS BIGINT)) AS BIGINT) AS original, CAST(sum(CAST(floor(duration * 40) AS BIGINT)) AS BIGINT) AS compressed, count(*) AS n, min(floor(duration * 40) / greatest(floor(duration * 100), 1)) AS low, max(floor(duration * 40) / greatest(floor(duration * 100), 1)) AS high FROM views GROUP BY 1) SELECT CAST(sum(original) AS BIGINT) AS original, CAST(sum(compressed) AS BIGINT) AS compressed, CAST(sum(n) AS BIGINT) AS entries, round(min(low), 6) AS min_ratio, round(max(high), 6) AS max_ratio, CAST(greatest(sum(original) - sum(compressed), 0) AS BIGINT) AS saved FROM p")
def compression_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every user's entries, merged into one."""
    size, packed = F.floor(F.col("duration") * 100), F.floor(F.col("duration") * 40)
    ratio = packed / F.greatest(size, F.lit(1))
    p = views(spark, sf_dir).groupBy("user_id").agg(F.sum(size).alias("o"), F.sum(packed).alias("c"), F.count("*").alias("n"), F.min(ratio).alias("low"), F.max(ratio).alias("high"))
    return p.agg(F.sum("o").alias("original"), F.sum("c").alias("compressed"), F.sum("n").alias("entries"), F.round(F.min("low"), 6).alias("min_ratio"), F.round(F.max("high"), 6).alias("max_ratio"), F.greatest(F.sum("o") - F.sum("c"), F.lit(0)).alias("saved"))
