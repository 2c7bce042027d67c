"""Catalogue, rights, recommendation, similarity and search over the relational and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelquarry.functions import scoring as S
from reelquarry.functions import text as T
from reelquarry.functions import vectors as X
from reelquarry.operators import joins as J
from reelquarry.operators import similarity as Sm
from reelquarry.operators import windows as Wn
from reelquarry.registry import query
from reelquarry.tables import RATINGS_SQL, VIEWS_SQL, load, ratings, views

R = f"WITH {RATINGS_SQL} "
_DAYS = "CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT)"


def _days(c: str) -> F.Column:
    return F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 86400)


#: The territory that stands for all.
WORLD = "*"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights windows (id, holder, territory, start_d, end_d), one for each order line; one order in 4,096 is worldwide."""
    territory = F.when(F.col("l_orderkey") % 4096 == 0, WORLD).otherwise(F.col("l_suppkey").cast("string"))
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("holder"), territory.alias("territory"), _days("l_shipdate").alias("start_d"), (_days("l_shipdate") + F.col("l_quantity").cast("long")).alias("end_d"))


_WINDOWS_SQL = f"WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS holder, CASE WHEN l_orderkey % 4096 = 0 THEN '*' ELSE CAST(l_suppkey AS VARCHAR) END AS territory, {_DAYS} AS start_d, {_DAYS} + CAST(l_quantity AS BIGINT) AS end_d FROM lineitem) "
_OVERLAP = "a.start_d < b.end_d AND b.start_d < a.end_d"


@query("rights_overlaps", _WINDOWS_SQL + f"SELECT a.id AS a_id, b.id AS b_id, greatest(a.start_d, b.start_d) AS from_t, least(a.end_d, b.end_d) AS to_t FROM w a JOIN w b ON a.territory = b.territory AND a.id < b.id AND {_OVERLAP} UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), greatest(a.start_d, b.start_d), least(a.end_d, b.end_d) FROM w a JOIN w b ON a.territory = '*' AND b.territory <> '*' AND {_OVERLAP}")
def rights_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.interval_overlaps(_windows(spark, sf_dir), "id", "territory", "start_d", "end_d", 30, WORLD)


@query("conflict_counts", f"WITH {VIEWS_SQL}, w AS (SELECT event_id AS id, user_id AS holder, t AS start_d, t + 60 * CAST(floor(duration) AS BIGINT) AS end_d FROM views), k AS (SELECT * FROM w WHERE end_d > start_d) SELECT a.id, count(b.id) AS conflicts FROM k a LEFT JOIN k b ON a.holder = b.holder AND a.id <> b.id AND {_OVERLAP} GROUP BY 1")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other viewings of its user each viewing (a minute for each unit of its value) overlaps."""
    w = views(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("holder"), F.col("t").alias("start_d"), (F.col("t") + 60 * F.floor("duration")).alias("end_d"))
    return J.overlap_counts(w, "id", "holder", "start_d", "end_d")


@query("rights_gaps", _WINDOWS_SQL + ", n AS (SELECT holder, end_d AS gap_start, lead(start_d) OVER (PARTITION BY holder ORDER BY start_d, end_d) AS gap_end FROM w) SELECT * FROM n WHERE gap_end - gap_start > 3")
def rights_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Wn.gaps(_windows(spark, sf_dir), "holder", "start_d", "end_d", 3)


@query("rights_expiry", _WINDOWS_SQL + ", n AS (SELECT max(start_d) AS now FROM w) SELECT id, greatest(end_d - now, 0) * 86400 AS seconds_remaining, end_d <= now AS already_expired FROM w, n WHERE end_d <= now + 30")
def rights_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every right that has ended or ends within 30 days of the latest start."""
    w = _windows(spark, sf_dir)
    # one row is broadcast
    return w.crossJoin(F.broadcast(w.agg(F.max("start_d").alias("now")))).where("end_d <= now + 30").select("id", F.expr("greatest(end_d - now, 0L) * 86400L").alias("seconds_remaining"), F.expr("end_d <= now").alias("already_expired"))


@query("usage_report", """SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN 'type' WHEN grouping(o_orderstatus) = 0 THEN 'platform' ELSE 'all' END AS by_what, coalesce(o_orderpriority, o_orderstatus) AS value, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    g = o.groupingSets([[F.col("o_orderpriority")], [F.col("o_orderstatus")], []], "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderpriority").alias("gp"), F.grouping("o_orderstatus").alias("gs"))
    return g.select(F.when(F.col("gp") == 0, "type").when(F.col("gs") == 0, "platform").otherwise("all").alias("by_what"), F.coalesce("o_orderpriority", "o_orderstatus").alias("value"), "n", "total")


@query("revenue_split", """SELECT l_orderkey, l_linenumber, round(100.0 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem""")
def revenue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(100.0 * F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey")), 6).alias("share"))


@query("royalty_by_holder", """SELECT l_suppkey AS holder, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, round(greatest(sum(l_extendedprice) * 8 / 100, 1000), 2) AS due FROM lineitem GROUP BY 1""")
def royalty_by_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.functions.scoring import royalty

    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("holder")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.round(royalty(F.sum("l_extendedprice"), 8.0, 1000.0), 2).alias("due"))


@query("cost_rollup", """SELECT l_linestatus AS region, l_returnflag AS tier, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return load(spark, sf_dir, "lineitem").rollup(F.col("l_linestatus").alias("region"), F.col("l_returnflag").alias("tier")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


@query("clip_search_scored", """WITH s AS (SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'a') THEN 10 ELSE 0 END + CASE WHEN lower(p_name) = 'a' THEN 20 ELSE 0 END + 5 * len(list_filter(string_split(p_type, ' '), lambda k: contains(lower(k), 'a'))) + CASE WHEN contains(lower(p_brand), 'a') THEN 3 ELSE 0 END)::DOUBLE AS score FROM part)
SELECT * FROM s WHERE score > 0""")
def clip_search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "a"

    def has(c) -> F.Column:
        return F.contains(F.lower(c), F.lit(q))

    score = F.when(has("p_name"), 10).otherwise(0) + F.when(F.lower("p_name") == q, 20).otherwise(0) + 5 * F.size(F.filter(F.split("p_type", " "), has)) + F.when(has("p_brand"), 3).otherwise(0)
    return load(spark, sf_dir, "part").select("p_partkey", score.cast("double").alias("score")).where("score > 0")


@query("clip_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice >= 950 AND list_contains(string_split(p_type || ' ' || p_name, ' '), 'ECONOMY')")
def clip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_size").between(5, 20) & (F.col("p_retailprice") >= 950) & F.array_contains(F.split(F.concat_ws(" ", "p_type", "p_name"), " "), "ECONOMY")).select("p_partkey")


@query("page_slice", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(50).limit(25)


@query("collaborative_items", R + "SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS common, round(sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)), 6) AS similarity FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2")
def collaborative_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.item_neighbours(ratings(spark, sf_dir))


@query("collaborative_users", R + """, n AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM ratings GROUP BY 1), d AS (SELECT a.user_id AS user_a, b.user_id AS user_b, sum(a.rating * b.rating) AS dot, count(*) AS common, CASE WHEN stddev_pop(a.rating) * stddev_pop(b.rating) > 1e-12 THEN covar_pop(a.rating, b.rating) / (stddev_pop(a.rating) * stddev_pop(b.rating)) ELSE 0 END AS pearson FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_a, user_b, common, round(dot / (x.norm * y.norm), 6) AS cosine, round(pearson, 6) + 0.0 AS pearson FROM d JOIN n x ON user_a = x.user_id JOIN n y ON user_b = y.user_id""")
def collaborative_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.user_neighbours(ratings(spark, sf_dir)).select("user_a", "user_b", "common", "cosine", (F.round("pearson", 6) + 0.0).alias("pearson"))


@query("item_neighbours_top", R + """, p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, round(sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)), 6) AS score FROM ratings a JOIN ratings b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT item_a AS node, item_b AS neighbour, score, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS rank FROM p QUALIFY rank <= 10""")
def item_neighbours_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest items of every item."""
    return J.best_neighbours(J.item_neighbours(ratings(spark, sf_dir)), "item_a", "item_b", "similarity", 10)


@query("rating_statistics", R + "SELECT item_id, count(*) AS n, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS std, count(*) FILTER (WHERE rating = 5) AS fives FROM ratings GROUP BY 1")
def rating_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"), F.round(F.stddev_pop("rating"), 6).alias("std"), F.count_if(F.col("rating") == 5).alias("fives"))


@query("baseline_predict", R + ", g AS (SELECT avg(rating) AS mu FROM ratings WHERE rating > 0), u AS (SELECT user_id, avg(rating) AS m FROM ratings GROUP BY 1), i AS (SELECT item_id, avg(rating) AS m FROM ratings GROUP BY 1) SELECT user_id, item_id, round(least(greatest(mu + (u.m - mu) + (i.m - mu), 0), 5), 6) AS predicted FROM ratings JOIN u USING (user_id) JOIN i USING (item_id), g")
def baseline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    rated = F.col("rating") > 0
    u = r.groupBy("user_id").agg(F.avg("rating").alias("um"), F.sum(F.when(rated, F.col("rating"))).alias("s"), F.count_if(rated).alias("c"))
    i = r.groupBy("item_id").agg(F.avg("rating").alias("im"))
    # the mean of all ratings comes from the users' sums; one row is broadcast
    mu, u = F.broadcast(u.agg((F.sum("s") / F.sum("c")).alias("mu"))), u.drop("s", "c")
    return r.join(u, "user_id").join(i, "item_id").crossJoin(mu).selectExpr("user_id", "item_id", "round(least(greatest(um + im - mu, 0), 5), 6) AS predicted")


@query("genre_watch", R + "SELECT p_brand AS genre, round(sum(rating), 4) AS total FROM ratings JOIN part ON item_id = p_partkey GROUP BY 1 ORDER BY total DESC, genre LIMIT 10")
def genre_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("item_id") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("genre")).agg(F.round(F.sum("rating"), 4).alias("total")).orderBy(F.desc("total"), "genre").limit(10)


@query("tag_similarity_all", """WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS t FROM part), m AS (SELECT q.p_partkey AS query_id, p.p_partkey, len(list_intersect(p.t, q.t)) AS i, len(list_distinct(list_concat(p.t, q.t))) AS u, len(list_distinct(p.t)) AS a, len(list_distinct(q.t)) AS b FROM p, p AS q WHERE q.p_partkey % 50 = 0)
SELECT query_id, p_partkey, round(i / u, 6) AS jaccard, round(2 * i / (a + b), 6) AS dice, round(i / least(a, b), 6) AS overlap, round(i / sqrt(a * b), 6) AS cosine FROM m""")
def tag_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part whose key is divisible by 50 against all parts."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split("p_type", " "))).alias("t"))
    return Sm.set_similarities(p.withColumnRenamed("p_partkey", "id"), p.where("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "query_id"), 6).withColumnRenamed("id", "p_partkey")


@query("vector_search_all", """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(e.embedding AS DOUBLE[]) AS a, CAST(q.embedding AS DOUBLE[]) AS b FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, list_distance(a, b) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(a, b), vec_id) AS n FROM d)
SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 5) AS cosine, round(d, 5) AS euclid, round(1 / (1 + d), 5) AS similarity, round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 5) AS manhattan FROM r WHERE n <= 20""")
def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to every vector whose id is divisible by 50."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("a").alias("b"))
    return J.nearest(e, q, 20).select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"), F.round("d", 5).alias("euclid"), F.round(1 / (1 + F.col("d")), 5).alias("similarity"), F.round("manhattan", 5).alias("manhattan"))


@query("hamming_pairs", """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 16 THEN -x ELSE x END) FROM embeddings), h AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM e),
p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id) SELECT * FROM p WHERE distance <= 12""")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign hashes of all vectors and of copies with up to 15 signs turned."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 16, -x).otherwise(x)).alias("embedding"))
    return J.hamming_pairs(e.union(turned).select("vec_id", X.sign_bits(F.col("embedding")).alias("bits")), "vec_id", "bits", 12)


@query("text_track_statistics", """WITH c AS (SELECT conv_id, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS w FROM conversations) SELECT conv_id, count(*) AS cues, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(w) AS BIGINT) AS words, max(n) AS longest, count(*) FILTER (WHERE n > 500) AS fast FROM c GROUP BY 1""".replace("\\\\", "\\"))
def text_track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("n"), T.word_count(F.col("text")).alias("w"))
    return c.groupBy("conv_id").agg(F.count("*").alias("cues"), F.sum("n").alias("chars"), F.sum("w").cast("long").alias("words"), F.max("n").cast("long").alias("longest"), F.count_if(F.col("n") > 500).alias("fast"))


@query("bm25_search", r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), a AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('idiot', 'license', 'public') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS score FROM f JOIN d USING (term) JOIN l USING (doc_id), a GROUP BY 1""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of the texts and no shuffle of rows: a one-row table of corpus figures, then a score in each row."""
    terms = ["idiot", "license", "public"]
    words = load(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    # lengths and counts come from one pass over the tokens of a row
    counted = words.select("doc_id", F.aggregate("tokens", F.array(*[F.lit(0)] * (len(terms) + 1)), lambda acc, t: F.zip_with(acc, F.array(F.lit(1), *[(t == x).cast("int") for x in terms]), lambda a, b: a + b)).alias("n"))
    flat = counted.select("doc_id", F.col("n")[0].alias("dl"), *[F.col("n")[i + 1].alias(f"tf{i}") for i in range(len(terms))])
    full = F.col("dl") > 0
    stats = flat.agg(F.avg(F.when(full, F.col("dl"))).alias("avgdl"), F.count_if(full).alias("docs"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = sum((F.when(F.col(f"tf{i}") > 0, T.bm25_term(F.col(f"tf{i}"), T.bm25_idf(F.col("docs"), F.col(f"df{i}")), F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    return flat.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats)).select("doc_id", F.round(score, 5).alias("score"))


_WORDS_SQL = r"WITH w AS (SELECT doc_id, lang, source, text, n_chars, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents) "


@query("boolean_search", _WORDS_SQL + "SELECT doc_id FROM w WHERE (list_contains(w, 'idiot') OR list_contains(w, 'stupid')) AND NOT list_contains(w, 'scum') AND lang = 'en'")
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.plans.search import And, Field, Not, Or, Term, search

    ast = And(Or(Term("idiot"), Term("stupid")), Not(Term("scum")), Field("lang", "en"))
    return search(load(spark, sf_dir, "documents"), ast, "text").select("doc_id")


@query("phrase_search", _WORDS_SQL + "SELECT doc_id, contains(' ' || array_to_string(w, ' ') || ' ', ' public license ') AS adjacent FROM w WHERE list_contains(w, 'public') AND list_contains(w, 'license') AND n_chars BETWEEN 100 AND 20000")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a phrase, and whether they stand together."""
    from reelquarry.plans.search import And, Phrase, Range, compile_query, search

    words = ("public", "license")
    found = search(load(spark, sf_dir, "documents"), And(Phrase(words), Range("n_chars", 100, 20_000)), "text")
    return found.select("doc_id", compile_query(Phrase(words, adjacent=True), "text").alias("adjacent"))


@query("clip_search", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND p_size BETWEEN 5 AND 45")
def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in which every word of the query is in the name, brand or type, within a range of ratings."""
    from reelquarry.plans.search import all_terms, rating_predicate

    return load(spark, sf_dir, "part").where(all_terms(["p_name", "p_brand", "p_type"], "Ring red") & rating_predicate("p_size", least=5, most=45)).select("p_partkey")


@query("clip_query", "SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' AND p_size >= 20 AND p_partkey % 2 = 0")
def clip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clips, through the SQL builder."""
    from reelquarry.plans.search import ClipQuery

    clips = load(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS name", "p_size AS rating", "p_partkey % 2 = 0 AS is_favorite", "p_retailprice AS created_at")
    q = ClipQuery("{clips}").name("ring").least_rating(20).favorite(True)
    return spark.sql(q.sql(), args=q.args, clips=clips).select("p_partkey")


@query("fuzzy_vocabulary", """SELECT p_partkey, levenshtein(p_brand, 'Brand#11') AS distance, round(1 - levenshtein(p_brand, 'Brand#11') / greatest(strlen(p_brand), 8), 6) AS similarity FROM part WHERE levenshtein(p_brand, 'Brand#11') BETWEEN 1 AND 2""")
def fuzzy_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit("Brand#11")
    d = F.levenshtein("p_brand", q)
    return load(spark, sf_dir, "part").where(d.between(1, 2)).select("p_partkey", d.cast("long").alias("distance"), F.round(T.similarity_bytes(F.col("p_brand"), q), 6).alias("similarity"))


@query("cache_keys", """WITH u AS (SELECT page_id, lower(split_part(url, '#', 1)) AS u FROM pages), p AS (SELECT page_id, split_part(u, '?', 1) AS p, array_to_string(list_sort(list_filter(string_split(CASE WHEN contains(u, '?') THEN substring(u, strpos(u, '?') + 1) END, '&'), lambda x: x <> '')), '&') AS q FROM u),
r AS (SELECT page_id, q, CASE WHEN ends_with(p, '/') AND NOT (CASE WHEN contains(p, '://') THEN regexp_matches(substring(p, strpos(p, '://') + 3), '^[^/]*/$') ELSE p = '/' END) THEN left(p, length(p) - 1) ELSE p END AS path FROM p)
SELECT page_id, CASE WHEN coalesce(q, '') = '' THEN path ELSE path || '?' || q END AS cache_key FROM r""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.cache_key(F.col("url")).alias("cache_key"))


@query("version_diff", """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return J.table_diff(o.where("k % 7 <> 0"), new, "k", ["v"])


@query("novelty", R + ", g AS (SELECT item_id, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ratings) AS popularity FROM ratings GROUP BY 1) SELECT item_id, round(0.6 + 0.4 * (1 - least(popularity, 1)), 6) AS to_new_users, round(0.4 * (1 - least(popularity, 1)), 6) AS to_its_users FROM g")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The novelty of every item to users who have not rated it, and to those who have."""
    r = ratings(spark, sf_dir)
    # one row is broadcast
    g = r.groupBy("item_id").agg(F.countDistinct("user_id").alias("u")).crossJoin(F.broadcast(r.agg(F.countDistinct("user_id").alias("n"))))
    share = F.col("u") / F.col("n")
    return g.select("item_id", F.round(S.novelty(F.lit(True), share), 6).alias("to_new_users"), F.round(S.novelty(F.lit(False), share), 6).alias("to_its_users"))


@query("recommended_items", R + """, n AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM ratings GROUP BY 1), d AS (SELECT a.user_id AS user_a, b.user_id AS user_b, sum(a.rating * b.rating) AS dot FROM ratings a JOIN ratings b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
s AS (SELECT user_a AS user_id, r.item_id, sum(dot / (x.norm * y.norm) * rating) AS score FROM d JOIN n x ON user_a = x.user_id JOIN n y ON user_b = y.user_id JOIN ratings r ON user_b = r.user_id GROUP BY 1, 2),
c AS (SELECT n.user_id, i.item_id, round(coalesce(s.score, 0), 6) AS score FROM n CROSS JOIN (SELECT DISTINCT item_id FROM ratings) i LEFT JOIN s ON n.user_id = s.user_id AND i.item_id = s.item_id WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = n.user_id AND r.item_id = i.item_id))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM c QUALIFY rank <= 20""")
def recommended_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recommend_unseen(ratings(spark, sf_dir), 20)


# parts as a graph with joins: from half and a third of the key, and for every seventh from the key before
_EDGES_SQL = "e(src, dst) AS (SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2 UNION SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 0)"


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = n.where("node > 1").selectExpr("node div 2 AS src", "node AS dst").union(n.where("node > 2").selectExpr("node div 3", "node")).union(n.where("node % 7 = 0 AND node > 0").selectExpr("node - 1", "node"))
    return n, edges.distinct()


@query("dag_levels", f"WITH RECURSIVE {_EDGES_SQL}, p(node, d) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) UNION SELECT e.dst, d + 1 FROM p JOIN e ON p.node = e.src) SELECT node, max(d) AS level FROM p GROUP BY 1")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.operators.graph import topological_levels

    return topological_levels(*_part_graph(spark, sf_dir))


@query("graph_neighbours", f"WITH {_EDGES_SQL} SELECT src AS node, dst AS neighbour FROM e UNION SELECT dst, src FROM e")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.operators.graph import neighbours

    return neighbours(_part_graph(spark, sf_dir)[1])


@query("graph_ends", f"WITH {_EDGES_SQL} SELECT p_partkey AS node, CASE WHEN p_partkey NOT IN (SELECT dst FROM e) THEN CASE WHEN p_partkey NOT IN (SELECT src FROM e) THEN 'both' ELSE 'source' END ELSE 'sink' END AS side FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) OR p_partkey NOT IN (SELECT src FROM e)")
def graph_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without predecessors or without successors."""
    from reelquarry.operators.graph import roots

    n, edges = _part_graph(spark, sf_dir)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first, last = roots(n, edges).withColumn("first", F.lit(True)), roots(n, back).withColumn("last", F.lit(True))
    return first.join(last, "node", "full").select("node", F.when(F.col("first") & F.col("last"), "both").when(F.col("first"), "source").otherwise("sink").alias("side"))


@query("graph_reachable", f"WITH RECURSIVE {_EDGES_SQL}, r(node) AS (SELECT 5 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT CAST(node AS BIGINT) AS node FROM r")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that node 5 leads to."""
    from reelquarry.operators.graph import reachable

    n, edges = _part_graph(spark, sf_dir)
    return reachable(n.where("node = 5"), edges)


@query("call_hot_path", f"WITH RECURSIVE {_EDGES_SQL}, w AS (SELECT p_partkey AS node, p_retailprice + p_size AS v FROM part), b AS (SELECT src, max_by(dst, (coalesce(v, 0), dst)) AS child FROM e LEFT JOIN w ON dst = node GROUP BY 1), s AS (SELECT src AS node FROM e LEFT JOIN w ON src = node WHERE src NOT IN (SELECT dst FROM e) ORDER BY v DESC NULLS LAST, src DESC LIMIT 1), p(step, node) AS (SELECT CAST(0 AS BIGINT), node FROM s UNION ALL SELECT step + 1, child FROM p JOIN b ON p.node = b.src) SELECT * FROM p")
def call_hot_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelquarry.operators.graph import hot_path

    weights = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_retailprice") + F.col("p_size")).alias("weight"))
    return hot_path(_part_graph(spark, sf_dir)[1], weights)


@query("ancestors_all", """WITH RECURSIVE a(node, ancestor, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION ALL SELECT node, ancestor // 2, depth + 1 FROM a WHERE ancestor > 1) SELECT * FROM a""")
def ancestors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestry of every node."""
    from reelquarry.operators.graph import ancestors as walk

    n = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = n.where("node > 1").select(F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst"))
    return walk(n, edges)
