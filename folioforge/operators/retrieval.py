"""Vector search and the metrics of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _doubles(v: str | Column) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    """The dot product of two vectors in double precision, added from the first to the last."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def search(corpus: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", top: int = 5, most_bytes: int = 64 * 2**20) -> DataFrame:
    """(query, rank, key, score): the ``top`` most similar vectors of each query, ties by key; a query is not matched with itself.

    Queries go out to the corpus in blocks of at most ``most_bytes``. In each block the
    best of a query are kept within every part of the corpus before the parts meet, so what is moved is
    queries x parts x top rows, whatever the corpus holds.
    """
    spark = corpus.sparkSession
    size = queries.select(F.max(F.size(vector)).alias("d"), F.count("*").alias("n")).first()
    per = max(1, most_bytes // (8 * max(1, size.d or 1)))
    blocks = max(1, -(-size.n // per))
    out = None
    unit = corpus.select(F.col(key).alias("key"), _doubles(vector).alias("v")).withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    for i in range(blocks):
        q = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        asked = q.select(F.col(key).alias("query"), _doubles(vector).alias("qv")).withColumn("qlen", F.sqrt(F.aggregate("qv", F.lit(0.0), lambda s, x: s + x * x)))
        score = F.coalesce(F.try_divide(F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.col("len") * F.col("qlen")), F.lit(0.0))
        met = unit.crossJoin(F.broadcast(asked)).where("key <> query").select("query", "key", score.alias("score"))
        ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= top)
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("query", "rank", "key", "score") if out is not None else spark.createDataFrame([], "query long, rank int, key long, score double")


def ranking_metrics(hits: DataFrame, relevant: DataFrame, *, k: int = 5) -> DataFrame:
    """(query, precision, recall, reciprocal_rank) at k: precision over the ranking's own length where it is short; queries without relevant items are left out.

    hits: (query, rank, key); relevant: (query, key).
    """
    wanted = relevant.select("query", "key").distinct()
    count = wanted.groupBy("query").agg(F.count("*").alias("n_relevant"))
    held = hits.join(wanted.withColumn("good", F.lit(True)), ["query", "key"], "left")
    each = held.groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("n"), F.count_if((F.col("rank") <= k) & F.col("good")).alias("found"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return count.join(each, "query", "left").na.fill(0, ["n", "found"]).select("query", ratio("found", "n").alias("precision"), ratio("found", "n_relevant").alias("recall"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("reciprocal_rank"))


def summary(metrics: DataFrame) -> DataFrame:
    """(n_scored, precision, recall, mrr): means over scored queries, 0 for none."""
    m = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(F.count("*").alias("n_scored"), m("precision").alias("precision"), m("recall").alias("recall"), m("reciprocal_rank").alias("mrr"))


def overlap(a: Column, b: Column, k: int) -> Column:
    """Jaccard overlap of the first k of two rankings; 1 when both are empty."""
    x, y = F.slice(a, 1, k), F.slice(b, 1, k)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(1.0))


def kendall(a: Column, b: Column) -> Column:
    """Kendall's tau of the items two rankings share; 1 when they share fewer than two."""
    common = F.filter(a, lambda x: F.array_contains(b, x))
    places = F.transform(common, lambda x: F.array_position(b, x))
    sign = F.aggregate(F.transform(places, lambda p, i: F.aggregate(F.slice(places, i + 2, F.size(places)), F.lit(0), lambda s, q: s + F.when(q > p, 1).otherwise(-1))), F.lit(0), lambda s, x: s + x)
    n = F.size(common)
    return F.when(n < 2, 1.0).otherwise(sign / (n * (n - 1) / 2))


def best_matches(matches: DataFrame, *, threshold: float = 0.55, cap: int = 6) -> DataFrame:
    """(role, headline, article, score): the best match of all, and the best headline of each other article above a threshold, at most ``cap``."""
    best = matches.orderBy(F.desc("score"), "headline").limit(1)
    rest = matches.join(best.select("article"), "article", "left_anti").where(F.col("score") >= threshold)
    one = rest.withColumn("n", F.row_number().over(W.partitionBy("article").orderBy(F.desc("score"), "headline"))).where("n = 1").drop("n").orderBy(F.desc("score"), "headline").limit(cap)
    pick = lambda df, role: df.select(F.lit(role).alias("role"), "headline", "article", "score")
    return pick(best, "deep dive").unionByName(pick(one, "roundup"))
