"""Rights, life cycles, subtitles, edit lists, playlists, metadata and recurrence over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelquarry.functions import rights as R
from reelquarry.functions import text as T
from reelquarry.operators import joins as J
from reelquarry.operators import media as M
from reelquarry.operators import windows as Wn
from reelquarry.registry import query
from reelquarry.tables import VIEWS_SQL, load, views

V = f"WITH {VIEWS_SQL} "
# turns as cues: ten milliseconds a character, a second apart; tracks by parity of the turn
CUES_SQL = "cues AS (SELECT conv_id, conv_id * 1000 + turn AS id, turn % 2 AS track, turn * 1000 AS s, turn * 1000 + 10 * length(text) AS e, role, text FROM conversations) "


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 1000
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 2).alias("track"), start.alias("start"), (start + 10 * F.length("text")).alias("end"), "role", "text")


@query("cue_overlaps", f"WITH {CUES_SQL} SELECT a.id AS a_id, b.id AS b_id, greatest(a.s, b.s) AS from_t, least(a.e, b.e) AS to_t FROM cues a JOIN cues b ON a.conv_id = b.conv_id AND a.id < b.id AND a.s < b.e AND b.s < a.e")
def cue_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.interval_overlaps(_cues(spark, sf_dir), "id", "conv_id", "start", "end", 10_000)


@query("adjacent_overlaps", f"WITH {CUES_SQL}, o AS (SELECT conv_id, id, s, lag(e) OVER (PARTITION BY conv_id ORDER BY s, e) AS p FROM cues) SELECT conv_id, id FROM o WHERE s < p")
def adjacent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.adjacent_overlaps(_cues(spark, sf_dir), "conv_id", "start", "end").select("conv_id", "id")


_MERGE = f"""WITH RECURSIVE {CUES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY track, s, e, id) AS n FROM cues), f AS (
SELECT conv_id, n, [{{'id': id, 'track': track, 's': s, 'e': e, 'c': false}}] AS held FROM o WHERE n = 1 UNION ALL
SELECT o.conv_id, o.n, STEP FROM f JOIN o ON f.conv_id = o.conv_id AND o.n = f.n + 1), l AS (SELECT conv_id, unnest(held) AS h FROM (SELECT conv_id, held FROM f QUALIFY n = max(n) OVER (PARTITION BY conv_id)))
SELECT conv_id, h.id AS id, h.track AS track, h.s AS "start", h.e AS "end", h.c AS conflicted FROM l"""
_MET = "list_filter(f.held, lambda x: x.s < o.e AND x.e > o.s)"
_FREE = "list_filter(f.held, lambda x: NOT (x.s < o.e AND x.e > o.s))"
_NEW = "{'id': o.id, 'track': o.track, 's': o.s, 'e': o.e, 'c': false}"
for _name, _step in (
    ("prefer_first", f"CASE WHEN len({_MET}) > 0 THEN f.held ELSE list_append(f.held, {_NEW}) END"),
    ("prefer_last", f"list_append({_FREE}, {_NEW})"),
    ("keep_all", f"list_append(f.held, {_NEW.replace('false', f'len({_MET}) > 0')})"),
):

    @query(f"subtitle_merge_{_name}", _MERGE.replace("STEP", _step))
    def _merge(spark: SparkSession, sf_dir: str, strategy: str = _name) -> DataFrame:
        return M.merge_tracks(_cues(spark, sf_dir), "conv_id", strategy)


@query("cue_gaps", f"WITH {CUES_SQL}, g AS (SELECT conv_id, lead(s) OVER (PARTITION BY conv_id ORDER BY s, e) - e AS gap FROM cues) SELECT conv_id, round(coalesce(avg(gap), 0), 6) AS avg_gap, CAST(coalesce(sum(greatest(gap, 0)), 0) AS BIGINT) AS total_gap FROM g GROUP BY 1")
def cue_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gap_statistics(_cues(spark, sf_dir), "conv_id", "start", "end").select("conv_id", F.round("avg_gap", 6).alias("avg_gap"), "total_gap")


@query("cue_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def cue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.find_cues(load(spark, sf_dir, "conversations"), "text", "THE").select("conv_id", "turn")


@query("merged_segments", V + """, s AS (SELECT user_id, t * 1000 AS s, t * 1000 + 900000 AS e, kind AS text FROM views), n AS (SELECT *, CASE WHEN greatest(s - lag(e) OVER w, 0) >= 600000 OR lag(e) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, e, text)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s, e, text ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, min(s) AS "start", max_by(e, (s, e, text)) AS "end", string_agg(text, ' ' ORDER BY s, e, text) AS text, count(*) AS segments FROM r GROUP BY user_id, run""")
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as segments of a quarter of an hour, joined where less than ten minutes lie between them."""
    s = views(spark, sf_dir).select("user_id", (F.col("t") * 1000).alias("start"), (F.col("t") * 1000 + 900_000).alias("end"), F.col("kind").alias("text"))
    return Wn.merge_consecutive(s, "user_id", "start", "end", "text", 600_000)


@query("timecode_breaks", V + ", f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS frame, item_id AS tc FROM views), o AS (SELECT *, lag(frame) OVER w AS pf, lag(tc) OVER w AS pt FROM f WINDOW w AS (PARTITION BY user_id ORDER BY frame)) SELECT user_id, frame FROM o WHERE frame = pf + 1 AND tc <> pt + 1")
def timecode_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t", "event_id")
    f = views(spark, sf_dir).select("user_id", F.row_number().over(w).cast("long").alias("frame"), F.col("item_id").alias("tc"))
    return Wn.timecode_breaks(f, "user_id", "frame", "tc")


@query("drop_frame_timecodes", """WITH f AS (SELECT o_orderkey, o_orderkey * 977 AS n FROM orders), a AS (SELECT o_orderkey, n, n + 18 * (n // 17982) + CASE WHEN n % 17982 < 2 THEN 0 ELSE 2 * ((n % 17982 - 2) // 1798) END AS x FROM f)
SELECT o_orderkey, lpad(CAST(x // 108000 AS VARCHAR), CAST(greatest(2, length(CAST(x // 108000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(x // 1800 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x // 30 % 60 AS VARCHAR), 2, '0') || ';' || lpad(CAST(x % 30 AS VARCHAR), 2, '0') AS tc, n AS frames FROM a""")
def drop_frame_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers as drop-frame timecodes at 30 frames, and the frames read back from them."""
    f = load(spark, sf_dir, "orders").select("o_orderkey", T.timecode(F.col("o_orderkey") * 977, 30, drop=True).alias("tc"))
    return f.select("o_orderkey", "tc", T.parse_timecode(F.col("tc"), 30, drop=True).alias("frames"))


@query("edl_changes", """WITH a AS (SELECT p_partkey AS n, p_brand AS reel, p_size AS s FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS n, p_brand AS reel, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 7 <> 0)
SELECT CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' ELSE 'modified' END AS kind, a.n AS old_number, b.n AS new_number,
CASE WHEN b.n IS NULL THEN 'Event ' || a.n || ' removed (reel: ' || a.reel || ')' WHEN a.n IS NULL THEN 'Event ' || b.n || ' added (reel: ' || b.reel || ')' ELSE 'Event ' || a.n || ' modified: s' END AS description
FROM a FULL JOIN b ON a.n = b.n WHERE a.n IS NULL OR b.n IS NULL OR a.s <> b.s""")
def edl_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("reel"), F.col("p_size").alias("s"))
    new = p.where("n % 7 <> 0").withColumn("s", F.when(F.col("n") % 3 == 0, F.col("s") + 1).otherwise(F.col("s")))
    return M.change_list(p.where("n % 5 <> 0"), new, "n", ["reel", "s"], "reel")


@query("smart_playlist", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_size BETWEEN 20 AND 50 ORDER BY p_partkey LIMIT 40")
def smart_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.smart_playlist(load(spark, sf_dir, "part"), "p_size", [(10, 30), (20, 50)], ["p_partkey"], 40).select("p_partkey")


@query("playlist_queue", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part QUALIFY place <= 30")
def playlist_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the first 30 entries leave a queue: by priority, then as they came."""
    top = load(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(30)
    # 30 rows
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("p_size"), "p_partkey")).cast("long")).select("p_partkey", "place")


@query("archive_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR len(list_filter([p_brand, 'size' || p_size], lambda t: contains(lower(t), 'ring'))) > 0")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("tags", F.array("p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))))
    return M.find_entries(p, "RING", ["p_name", "p_type"], "tags").select("p_partkey")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a map of text fields."""
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("fields"))


@query("metadata_field_search", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#1')")
def metadata_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).where(M.field_matches(F.col("fields"), "brand", "#1")).select("p_partkey")


@query("metadata_fulltext", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') OR contains(lower(p_type), 'eco')")
def metadata_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).where(M.any_field_matches(F.col("p_name"), F.col("fields"), "Eco")).select("p_partkey")


@query("metadata_inherit", "SELECT p_partkey, 'Own ' || p_brand AS brand, p_type AS type, 'yes' AS reviewed, CAST(4 AS INTEGER) AS fields FROM part")
def metadata_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's brand over its parent's fields, and a field set for all."""
    p = _fields(spark, sf_dir)
    child = F.create_map(F.lit("brand"), F.concat(F.lit("Own "), F.col("fields")["brand"]))
    made = p.select("p_partkey", M.with_fields(M.inherited(F.col("fields"), child), {"reviewed": "yes"}).alias("m"))
    return made.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["type"].alias("type"), F.col("m")["reviewed"].alias("reviewed"), F.size("m").alias("fields"))


@query("metadata_convert", "SELECT p_partkey, p_name AS title, p_brand AS artist, CAST(2 AS INTEGER) AS fields FROM part")
def metadata_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("TIT2"), "p_name", F.lit("TPE1"), "p_brand", F.lit("XXXX"), "p_type")
    made = load(spark, sf_dir, "part").select("p_partkey", M.converted_fields(m, M.ID3_TO_VORBIS).alias("m"))
    return made.select("p_partkey", F.col("m")["TITLE"].alias("title"), F.col("m")["ARTIST"].alias("artist"), F.size("m").alias("fields"))


@query("tag_rules", "SELECT p_partkey, 'round' AS tag, 'shape' AS tag_type, 0.9::DOUBLE AS confidence FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT p_partkey, 'warm', 'colour', 0.7 FROM part WHERE contains(lower(p_name), 'red')")
def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("Ring", "round", "shape", 0.9), ("red", "warm", "colour", 0.7)]
    return M.tag_rules(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", rules).drop("p_name")


@query("tag_assets", "WITH t AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS tag FROM part) SELECT tag, count(DISTINCT p_partkey) AS assets, min(p_partkey) AS first FROM t GROUP BY 1")
def tag_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of tags: how many assets carry each, and the first."""
    t = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("assets"), F.min("p_partkey").alias("first"))


@query("jobs_with_tag", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))")
def jobs_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that carry the first segment as a tag."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # one row is broadcast
    tagged = c.join(F.broadcast(c.agg(F.min("c_mktsegment").alias("c_mktsegment"))), "c_mktsegment")
    o = load(spark, sf_dir, "orders")
    return o.join(tagged, o.o_custkey == tagged.c_custkey, "left_semi").select("o_orderkey")


@query("digest_lookup", "SELECT d.doc_id, min(o.doc_id) AS first_copy FROM documents d JOIN documents o ON md5(d.text) = md5(o.text) AND o.doc_id < d.doc_id GROUP BY 1")
def digest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that an earlier one with the same digest precedes, and the first of those."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "digest").where("doc_id > first_copy").select("doc_id", "first_copy")


@query("provenance_chains", V + ", o AS (SELECT user_id, kind, event_id, t, CASE WHEN user_id % 2 = 0 THEN t ELSE t + item_id * 100 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM views), g AS (SELECT user_id, CASE WHEN n = 1 THEN user_id % 3 <> 0 ELSE x >= lag(x) OVER (PARTITION BY user_id ORDER BY t, event_id) END AS good FROM o) SELECT user_id, bool_and(good) AS valid FROM g GROUP BY 1")
def provenance_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a user's events: two in three begin with Created, and one in two has its times moved."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id"))
    x = F.when(F.col("user_id") % 2 == 0, F.col("t")).otherwise(F.col("t") + F.col("item_id") * 100)
    e = views(spark, sf_dir).withColumn("action", F.when((n == 1) & (F.col("user_id") % 3 != 0), "Created").otherwise("Edited")).withColumn("x", x)
    return M.chain_valid(e, "user_id", ["t", "event_id"], "action", "x")


@query("job_chain", "SELECT p_partkey AS job FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 3 = 0 OR (p_partkey - 1) IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)) ORDER BY 1")
def job_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that may run: each needs the one before, every third needs none, even ones are completed and every eleventh is on its way."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("job"))
    jobs = p.select("job", F.when(F.col("job") % 3 != 0, F.col("job") - 1).alias("depends_on"), (F.col("job") % 11 == 0).alias("dispatched"))
    return M.next_ready(jobs, p.where("job % 2 = 0"), "job").select("job")


@query("folder_totals", """WITH p AS (SELECT page_id, string_split(regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1), '^/+', ''), '/') AS s FROM pages), f AS (SELECT unnest(range(len(s))) AS n, s FROM p)
SELECT array_to_string(s[1:n], '/') AS folder, n AS depth, count(*) AS assets FROM f GROUP BY 1, 2""")
def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in each folder of their addresses and below."""
    path = F.substring_index(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1), "#", 1)
    return M.folder_totals(load(spark, sf_dir, "pages").select(path.alias("path")), "path")


@query("share_deviation", "WITH s AS (SELECT lang, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY 1) SELECT round((SELECT sum(abs(t - coalesce(share, 0))) FROM (VALUES ('en', 0.4), ('fr', 0.3), ('xx', 0.3)) v(l, t) LEFT JOIN s ON s.lang = l), 6) AS deviation")
def share_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.share_deviation(load(spark, sf_dir, "documents"), "lang", {"en": 0.4, "fr": 0.3, "xx": 0.3}).select(F.round("deviation", 6).alias("deviation"))


# customers' nations as territories; letters stand for countries
@query("territory_access", "SELECT c_custkey, upper(c_mktsegment[1:1]) NOT IN ('M') AND upper(c_mktsegment[1:1]) IN ('A', 'B', 'M') AS allowed, round(coalesce(CASE c_nationkey WHEN 1 THEN 1.5 WHEN 7 THEN 0.8 END, 1 + c_nationkey / 100.0), 6) AS multiplier FROM customer")
def territory_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.substring("c_mktsegment", 1, 1)
    rate = R.territory_multiplier(F.col("c_nationkey").cast("string"), {"1": 1.5, "7": 0.8}, 1 + F.col("c_nationkey") / 100.0)
    return load(spark, sf_dir, "customer").select("c_custkey", R.country_allowed(country, ["a", "b", "m"], ["M"]).alias("allowed"), F.round(rate, 6).alias("multiplier"))


@query("zone_countries", """WITH z AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS c FROM nation GROUP BY 1) SELECT r_regionkey, array_to_string(list_sort(list_distinct(list_concat(['ZZ', 'AA'], c))), ',') AS countries, array_to_string(list_sort(list_intersect(c, list_filter(c, lambda x: x < 'M'))), ',') AS common FROM region JOIN z ON n_regionkey = r_regionkey""")
def zone_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of each region's zone, and those that two restrictions share."""
    n = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("c"))
    r = load(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    union = R.zone_countries(F.array(F.lit("ZZ"), F.lit("AA")), F.array("c"))
    both = R.common_countries(F.array("c", F.filter("c", lambda x: x < "M")))
    return r.select("r_regionkey", F.array_join(union, ",").alias("countries"), F.array_join(both, ",").alias("common"))


_NOW_D = "(SELECT max(o_orderdate) FROM orders)"


@query("embargo_days", f"SELECT o_orderkey, CAST(trunc((epoch(o_orderdate) + 86400.0 * 400 + 3600 - epoch({_NOW_D})) / 86400) AS BIGINT) AS days FROM orders")
def embargo_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days until the embargo of each order, 400 days and an hour after it, is lifted."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    # one row is broadcast
    return o.crossJoin(F.broadcast(o.agg(F.max("t").alias("now")))).select("o_orderkey", R.embargo_days(F.col("t") + 400 * R.DAY + 3600, F.col("now")).alias("days"))


@query("retention_eligible", f"""WITH e AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Temporary' WHEN 1 THEN 'Standard' WHEN 2 THEN 'LongTerm' ELSE 'Permanent' END AS k, epoch(o_orderdate) AS t, CASE WHEN o_orderkey % 5 = 0 THEN epoch(o_orderdate) + 86400 * 1000 END AS x, o_orderkey % 9 = 0 AS hold, epoch({_NOW_D}) AS now FROM orders)
SELECT o_orderkey FROM e WHERE NOT hold AND k <> 'Permanent' AND CASE WHEN x IS NOT NULL THEN now >= x ELSE now >= t + 86400 * 365 * CASE k WHEN 'Temporary' THEN 1 WHEN 'Standard' THEN 5 ELSE 10 END END""")
def retention_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "Temporary").when(n % 4 == 1, "Standard").when(n % 4 == 2, "LongTerm").otherwise("Permanent")
    o = load(spark, sf_dir, "orders").select(n, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    # one row is broadcast
    o = o.crossJoin(F.broadcast(o.agg(F.max("t").alias("now"))))
    expires = F.when(n % 5 == 0, F.col("t") + R.DAY * 1000)
    return o.where(R.eligible_for_deletion(kind, F.col("t"), expires, n % 9 == 0, F.col("now"))).select("o_orderkey")


@query("lifecycle_stages", f"WITH a AS (SELECT o_orderkey, date_diff('day', o_orderdate, {_NOW_D}) AS age FROM orders) SELECT o_orderkey, CASE WHEN age >= 1095 THEN 'Deleted' WHEN age >= 365 THEN 'Archived' ELSE 'Active' END AS stage FROM a")
def lifecycle_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))))
    return o.select("o_orderkey", R.stage_for_age(F.date_diff("now", "o_orderdate"), 365, 1095).alias("stage"))


@query("lifecycle_moves", "WITH s AS (SELECT unnest(['Ingest', 'QcPending', 'QcPassed', 'QcFailed', 'Active', 'Archived', 'Deleted']) AS s) SELECT a.s AS stage, b.s AS next, a.s || '>' || b.s IN ('Ingest>QcPending', 'QcPending>QcPassed', 'QcPending>QcFailed', 'QcPassed>Active', 'QcFailed>QcPending', 'QcFailed>Deleted', 'Active>Archived', 'Active>Deleted', 'Archived>Active', 'Archived>Deleted') AS may FROM s a, s b")
def lifecycle_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of moves between the seven stages."""
    s = spark.createDataFrame([(x,) for x in R.LIFECYCLE], "stage string")
    return s.crossJoin(s.select(F.col("stage").alias("next"))).select("stage", "next", R.may_move(F.col("stage"), F.col("next")).alias("may"))


@query("recurrences", """WITH o AS (SELECT o_orderkey, o_orderdate AS t, TIMESTAMP '1996-03-04 10:30:00' AS s, greatest(o_orderdate, TIMESTAMP '1996-03-04 10:30:00') AS b FROM orders),
w AS (SELECT *, list_filter(range(1, 8), lambda i: isodow(b + to_days(CAST(i AS INTEGER))) IN (1, 5) AND (epoch(b) - epoch(s) + i * 86400)::BIGINT // 604800 % 2 = 0) AS fits, date_trunc('month', b) + INTERVAL 2 MONTH AS m FROM o)
SELECT o_orderkey, epoch(b + INTERVAL 3 DAY)::BIGINT AS daily, epoch(b + to_days(CAST(coalesce(fits[1], 7) AS INTEGER)))::BIGINT AS weekly,
epoch(CASE WHEN day(last_day(m)) >= 30 THEN m + INTERVAL 29 DAY + (b - date_trunc('day', b)) ELSE b END)::BIGINT AS monthly,
CASE WHEN t < TIMESTAMP '2000-01-01' AND b + INTERVAL 3 DAY < TIMESTAMP '2000-01-01' THEN epoch(b + INTERVAL 3 DAY)::BIGINT END AS until_2000 FROM w""")
def recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next daily, weekly and monthly occurrence behind every order."""
    t, s = F.col("o_orderdate").cast("timestamp"), F.lit("1996-03-04 10:30:00").cast("timestamp")
    end = F.lit("2000-01-01 00:00:00").cast("timestamp")
    made = {
        "daily": R.next_occurrence(t, s, "daily", 3),
        "weekly": R.next_occurrence(t, s, "weekly", 2, days=(0, 4)),
        "monthly": R.next_occurrence(t, s, "monthly", 2, day=30),
        "until_2000": R.next_occurrence(t, s, "daily", 3, end=end),
    }
    return load(spark, sf_dir, "orders").select("o_orderkey", *[F.unix_timestamp(c).alias(k) for k, c in made.items()])


@query("occurrences", "WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS t FROM orders) SELECT o_orderkey, t + i * 432000 AS at FROM (SELECT o_orderkey, t, unnest(range(CAST(least(ceil(o_orderkey % 40 / 5.0), 6) AS BIGINT))) AS i FROM o)")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth day from each order on, for up to 39 days and six times at most."""
    t = F.col("o_orderdate").cast("timestamp")
    high = F.timestamp_seconds(F.unix_timestamp(t) + (F.col("o_orderkey") % 40) * R.DAY)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.daily_occurrences(t, t, high, 5, 6)).alias("at")).select("o_orderkey", F.unix_timestamp("at").alias("at"))


@query("rights_at", "SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-15' AND l_shipdate + to_days(CAST(l_quantity AS INTEGER)) >= TIMESTAMP '1998-06-15' AND (l_suppkey % 5 = 0 OR l_suppkey % 5 = 2)")
def rights_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights that hold on a day in territory 2; every fifth holder's are worldwide."""
    from reelquarry.plans.rollup import active_rights

    start = F.col("l_shipdate").cast("timestamp")
    w = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start_t"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("l_quantity").cast("long") * R.DAY).alias("end_t"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 5).cast("string")).alias("territory"))
    return w.where(active_rights(F.lit("1998-06-15").cast("timestamp"), "2")).select("id")


@query("usage_in_range", "SELECT o_custkey AS asset_id, count(*) AS uses FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_orderdate >= '1997-01-01' AND o_orderdate <= '1998-12-31' GROUP BY 1")
def usage_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.plans.rollup import usage

    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("usage_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("usage_date"))
    first = o.agg(F.min("usage_type").alias("usage_type"))
    # one row is broadcast
    return o.join(F.broadcast(first), "usage_type", "left_semi").where(usage(start="1997-01-01", end="1998-12-31")).groupBy("asset_id").agg(F.count("*").alias("uses"))


@query("royalty_by_type", "SELECT l_returnflag AS type, round(sum(greatest(l_extendedprice * 8 / 100, 100)), 2) AS total FROM lineitem GROUP BY 1")
def royalty_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.functions.scoring import royalty

    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.round(F.sum(royalty(F.col("l_extendedprice"), 8.0, 100.0)), 2).alias("total"))


@query("shot_averages", V + "SELECT item_id, count(*) AS shots, round(avg(duration), 6) AS avg_frames, round(avg(duration) / 25.0, 6) AS avg_seconds FROM views GROUP BY 1")
def shot_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("shots"), F.avg("duration").alias("a"))
    return v.select("item_id", "shots", F.round("a", 6).alias("avg_frames"), F.round(F.col("a") / 25.0, 6).alias("avg_seconds"))


@query("as_run_variance", V + ", s AS (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - 3600 AS variance FROM views) SELECT event_id, variance FROM s WHERE variance IS NOT NULL")
def as_run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much later than an hour after the one before each of a user's events ran, in seconds."""
    late = F.col("t") - F.lag("t").over(W.partitionBy("user_id").orderBy("t", "event_id")) - 3600
    return views(spark, sf_dir).select("event_id", late.alias("variance")).where("variance IS NOT NULL")


@query("predicted_drift", V + ", x AS (SELECT item_id, regr_slope(duration, t) AS rate FROM views GROUP BY 1 HAVING count(*) >= 2) SELECT item_id, round(rate * 3600, 6) AS drift FROM x WHERE rate IS NOT NULL")
def predicted_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift of each item's values over an hour, at their fitted rate."""
    x = views(spark, sf_dir).groupBy("item_id").agg(F.regr_slope("duration", "t").alias("rate"), F.count("*").alias("n")).where("n >= 2 AND rate IS NOT NULL")
    return x.select("item_id", F.round(F.col("rate") * 3600, 6).alias("drift"))


@query("next_pages", "WITH n AS (SELECT count(*) AS n FROM part) SELECT i AS page, CASE WHEN (i + 1) * 300 < n THEN i + 1 END AS next_page FROM (SELECT unnest(range(CAST(ceil(n / 300.0) AS BIGINT))) AS i, n FROM n)")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 300 parts and the page behind each, if there is one."""
    n = load(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    pages = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 300) - 1)).alias("page"))
    return pages.select("page", F.when((F.col("page") + 1) * 300 < F.col("n"), F.col("page") + 1).alias("next_page"))


@query("latest_checkpoint", V + "SELECT user_id, max(event_id) AS seq, max_by(duration, event_id) AS state FROM views WHERE kind = 'purchase' GROUP BY 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest checkpoint of every job."""
    return views(spark, sf_dir).where("kind = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("seq"), F.max_by("duration", "event_id").alias("state"))


@query("events_in_window", V + ", w AS (SELECT o_orderkey AS id, (SELECT min(t) FROM views) + o_orderkey * 60 AS a FROM orders) SELECT id, count(event_id) AS events FROM w LEFT JOIN views ON t >= a AND t < a + 1800 GROUP BY 1")
def events_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a window of half an hour for each order, a minute apart; both sides meet by ten-minute bins."""
    v = views(spark, sf_dir).select("event_id", "t")
    # one row is broadcast
    origin = F.broadcast(v.agg(F.min("t").alias("o")))
    w = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).crossJoin(origin).select("id", (F.col("o") + F.col("id") * 60).alias("a"))
    bins = w.select("id", "a", F.explode(F.sequence(F.floor(F.col("a") / 600), F.floor((F.col("a") + 1799) / 600))).alias("bin"))
    met = bins.join(v.withColumn("bin", F.floor(F.col("t") / 600)), "bin").where("t >= a AND t < a + 1800").groupBy("id").agg(F.count("*").alias("n"))
    return w.join(met, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("events"))
