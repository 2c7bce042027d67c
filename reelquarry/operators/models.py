"""Trained models: matrix factorisation and clustering, by the distributed solvers of the engine."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def factorise(ratings: DataFrame, rank: int, iterations: int, regularisation: float, seed: int = 7):
    """(model, mean): factors of ratings (user_id, item_id, rating) around their mean; ids must fit 32 bits. Rows with a null are left out."""
    from pyspark.ml.recommendation import ALS

    known = ratings.select("user_id", "item_id", "rating").dropna()
    mean = known.agg(F.avg("rating")).first()[0]
    if mean is None:
        raise ValueError("no ratings to train on")
    centred = known.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), (F.col("rating") - mean).cast("float").alias("rating"))
    als = ALS(rank=rank, maxIter=iterations, regParam=regularisation, userCol="user_id", itemCol="item_id", ratingCol="rating", seed=seed, coldStartStrategy="nan")
    return als.fit(centred), mean


def predict(trained: tuple, pairs: DataFrame) -> DataFrame:
    """`prediction` of (user_id, item_id) pairs within 0 to 5; the mean for unknown ones."""
    model, mean = trained
    made = model.transform(pairs.withColumn("user_id", F.col("user_id").cast("int")).withColumn("item_id", F.col("item_id").cast("int")))
    raw = F.when(F.isnan("prediction") | F.col("prediction").isNull(), 0.0).otherwise(F.col("prediction").cast("double"))
    return made.withColumn("prediction", F.greatest(F.least(raw + mean, F.lit(5.0)), F.lit(0.0)))


#: Users and items whose scores are held at once, and users of a task.
USERS, ITEMS, TASK_USERS = 1024, 8192, 1 << 14


def recommend_by_factors(trained: tuple, n: int, users: int = USERS, items: int = ITEMS) -> DataFrame:
    """(user_id, rank, item_id, score): the `n` best items of each user, rated ones included; ties go by item_id.

    The item factors, one short vector each, are broadcast in order of their length, and blocks of users meet blocks of
    items until no longer vector is left that could beat a user's `n`-th best: exact, as a score is at most the
    product of the lengths.
    """
    import numpy as np

    model, mean = trained
    known = model.itemFactors.toArrow()
    ids = known.column("id").to_numpy().astype(np.int64)
    vectors = known.column("features").combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(ids), -1)
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    held = model.itemFactors.sparkSession.sparkContext.broadcast((ids[order], vectors[order], lengths[order]))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, vectors, lengths = held.value
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64)
            factors = batch.column(1).flatten().to_numpy().reshape(len(own), -1).astype(np.float32)
            for s in range(0, len(own), users):
                u = factors[s : s + users]
                size = np.sqrt((u.astype(float) ** 2).sum(1)) * (1 + 1e-5)
                # what is kept so far: user by user, the best first
                row, item, score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float32))
                least = np.full(len(u), -np.inf, np.float32)
                for t in range(0, len(ids), items):
                    open_ = np.flatnonzero(size * lengths[t] >= least)
                    if not len(open_):
                        break
                    made = u[open_] @ vectors[t : t + items].T
                    bound = least[open_]
                    if t == 0 and made.shape[1] > n:
                        bound = np.partition(made, made.shape[1] - n, axis=1)[:, made.shape[1] - n]
                    i, j = np.nonzero(made >= bound[:, None])
                    row, item, score = np.concatenate([row, open_[i]]), np.concatenate([item, ids[t + j]]), np.concatenate([score, made[i, j]])
                    best = np.lexsort((item, -score, row))
                    at = row[best]
                    best = best[np.arange(len(at)) - np.searchsorted(at, at) < n]
                    row, item, score = row[best], item[best], score[best]
                    full = np.searchsorted(row, np.arange(len(u)), "right")
                    whole = full - np.searchsorted(row, np.arange(len(u))) >= n
                    least[whole] = score[full[whole] - 1]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays([pa.array(own[s : s + users][row]), pa.array(rank), pa.array(item), pa.array(score.astype(float) + mean)], names=["user_id", "rank", "item_id", "score"])

    factors = model.userFactors
    dealt = factors.repartition(max(1, -(-factors.count() // TASK_USERS)), "id")
    return dealt.select("id", "features").mapInArrow(run, "user_id long, rank long, item_id long, score double")


def cluster(rows: DataFrame, key: str, features: list[str], k: int, iterations: int = 10, seed: int = 7) -> DataFrame:
    """(key, cluster) by k-means with ten rounds; missing features count 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=features, outputCol="features").transform(rows.fillna(0.0, features))
    model = KMeans(k=k, maxIter=iterations, seed=seed).fit(made)
    return model.transform(made).select(key, F.col("prediction").alias("cluster"))
