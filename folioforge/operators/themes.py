"""Themes over time: yearly arcs, shifts between years, timelines, signature pieces; and clustering of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.session import cut


def arc(articles: DataFrame, *, theme: str = "cluster_id") -> DataFrame:
    """(year, theme, count, total, share, dominant, partial): each year's themes; undated rows and rows without a theme are left out.

    The dominant theme has the highest count, the lower one of equals. A year is partial when it has under half of the median total.
    """
    counts = articles.select(T.year_of("date").alias("year"), F.col(theme).alias("theme")).where("year is not null and theme is not null").groupBy("year", "theme").agg(F.count("*").alias("count"))
    years = counts.groupBy("year").agg(F.sum("count").alias("total"), F.min_by("theme", F.struct((-F.col("count")).alias("c"), "theme")).alias("top"))
    middle = years.agg(F.median("total").alias("median"))
    return counts.join(years, "year").crossJoin(F.broadcast(middle)).select("year", "theme", "count", "total", F.round(F.col("count") / F.col("total"), 3).alias("share"), (F.col("theme") == F.col("top")).alias("dominant"), (F.col("total") < 0.5 * F.col("median")).alias("partial"))


def shifts(years: DataFrame) -> DataFrame:
    """(from_year, to_year, theme, from_share, to_share, delta, change): themes of each pair of consecutive observed years.

    change is "emergent", "vanished", "rising", "fading" or "same".
    """
    order = years.select("year").distinct().withColumn("prev", F.lag("year").over(W.orderBy("year")))  # as many rows as years
    now = years.select(F.col("year").alias("to_year"), "theme", F.col("share").alias("to_share"))
    before = years.select(F.col("year").alias("prev"), "theme", F.col("share").alias("from_share")).join(order.where("prev is not null"), "prev").select(F.col("prev").alias("from_year"), F.col("year").alias("to_year"), "theme", "from_share")
    paired = now.join(order.where("prev is not null").select(F.col("year").alias("to_year")), "to_year", "left_semi").join(before, ["to_year", "theme"], "full_outer")
    named = paired.drop("from_year").join(order.select(F.col("year").alias("to_year"), F.col("prev").alias("from_year")), "to_year").na.fill(0.0, ["from_share", "to_share"])
    delta = F.round(F.col("to_share") - F.col("from_share"), 3)
    change = F.when((F.col("from_share") == 0) & (F.col("to_share") > 0), "emergent").when((F.col("from_share") > 0) & (F.col("to_share") == 0), "vanished").when(delta > 0, "rising").when(delta < 0, "fading").otherwise("same")
    return named.select("from_year", "to_year", "theme", "from_share", "to_share", delta.alias("delta"), change.alias("change"))


def overall(years: DataFrame) -> DataFrame:
    """One row on the whole arc: its full years' ends, their dominant themes, and the themes that grew and declined most; null fields for no years."""
    full = years.where("not partial")
    ends = full.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    some = full.crossJoin(F.broadcast(ends))
    moved = some.groupBy("theme").agg(F.coalesce(F.max(F.when(F.col("year") == F.col("first_year"), F.col("share"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("year") == F.col("last_year"), F.col("share"))), F.lit(0.0)).alias("b"))
    moved = moved.where("a > 0 or b > 0").withColumn("d", F.round(F.col("b") - F.col("a"), 3))
    best = moved.agg(F.min_by("theme", F.struct((-F.col("d")).alias("x"), "theme")).alias("most_grown"), F.min_by("theme", F.struct("d", "theme")).alias("most_declined"))
    tops = some.where("dominant").agg(F.max(F.when(F.col("year") == F.col("first_year"), F.col("theme"))).alias("first_dominant"), F.max(F.when(F.col("year") == F.col("last_year"), F.col("theme"))).alias("last_dominant"))
    totals = years.agg(F.count_distinct("year").alias("n_years"), F.sum("count").alias("n_articles"))
    return totals.crossJoin(ends).crossJoin(best).crossJoin(tops)  # one row each


def timeline(articles: DataFrame, *, theme: str = "cluster_id") -> DataFrame:
    """(quarter, theme, count): counts of every theme in every observed quarter, zeros included."""
    each = articles.select(T.quarter_of("date").alias("quarter"), F.col(theme).alias("theme")).where("quarter is not null and theme is not null").groupBy("quarter", "theme").agg(F.count("*").alias("n"))
    grid = each.select("quarter").distinct().crossJoin(F.broadcast(each.select("theme").distinct()))  # quarters by themes, both short lists
    return grid.join(each, ["quarter", "theme"], "left").select("quarter", "theme", F.coalesce("n", F.lit(0)).alias("count"))


def top_themes(articles: DataFrame, *, theme: str = "cluster_label", top: int = 5) -> DataFrame:
    """(theme, count): the most frequent themes, ties by name."""
    return articles.groupBy(F.coalesce(F.col(theme), F.lit("")).alias("theme")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "theme").limit(top)


def span(articles: DataFrame) -> DataFrame:
    """(first_date, last_date, count) of dated articles."""
    return articles.where(F.coalesce("date", F.lit("")) != "").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("count"))


def signature_pieces(articles: DataFrame, *, theme: str = "cluster_label", words: str = "word_count", top: int = 5) -> DataFrame:
    """(theme, count, slug, words): the longest dated article of each of the most frequent themes, ties by date and slug."""
    dated = articles.where(F.coalesce("date", F.lit("")) != "").withColumn("theme", F.coalesce(F.col(theme), F.lit(""))).withColumn("w", F.coalesce(F.col(words), F.lit(0)))
    each = dated.groupBy("theme").agg(F.count("*").alias("count"), F.min(F.struct((-F.col("w")).alias("o"), "date", "slug")).alias("best"))
    return each.orderBy(F.desc("count"), "theme").limit(top).select("theme", "count", "best.slug", (-F.col("best.o")).alias("words"))


def year_digest(articles: DataFrame, year: int, *, words: str = "word_count") -> DataFrame:
    """(year, article_count, total_words) of one calendar year."""
    return articles.where(T.year_of("date") == str(year)).agg(F.lit(year).alias("year"), F.count("*").alias("article_count"), F.coalesce(F.sum(words), F.lit(0)).alias("total_words"))


def cluster(documents: DataFrame, *, key: str = "doc_id", text: str = "text", ks: range = range(4, 11), vocabulary: int = 5000, seed: int = 42, least_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """(assignments (key, cluster_id), clusters (cluster_id, keywords)): TF-IDF over words and word pairs, k-means, k by silhouette.

    Texts up to ``least_chars`` long are left out. Keywords are the strongest terms of a centre.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover

    base = documents.where(F.length(text) > least_chars).select(key, F.col(text).alias("text"))
    words = StopWordsRemover(inputCol="raw", outputCol="words").transform(RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"[^\p{L}]+", minTokenLength=2).transform(base))
    terms = NGram(n=2, inputCol="words", outputCol="pairs").transform(words).withColumn("terms", F.concat("words", "pairs"))
    counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=2, maxDF=0.85).fit(terms)
    tf = counter.transform(terms)
    vectors = Normalizer(inputCol="tfidf", outputCol="features").transform(IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)).select(key, "features").persist()
    best = None
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(vectors)
        score = ClusteringEvaluator().evaluate(model.transform(vectors)) if k > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, model)
    model = best[1]
    rows = [(i, [counter.vocabulary[j] for j in c.argsort()[::-1][:15]]) for i, c in enumerate(model.clusterCenters())]
    spark = documents.sparkSession
    assigned = cut(model.transform(vectors).select(key, F.col("prediction").alias("cluster_id")), "themes")
    vectors.unpersist()
    return assigned, spark.createDataFrame(rows, "cluster_id int, keywords array<string>")
