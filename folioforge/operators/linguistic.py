"""Linguistic metrics of documents and of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import scores as S
from folioforge.functions import text as T


def document_metrics(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts and indices per text with words, without any shuffle: words are runs of Latin letters in lower case."""
    words = F.transform(T.tokens(text, r"(?U)\b[A-Za-z]+\b"), lambda w: F.lower(w))
    parts = T.careful_sentences(text)
    # the filter is on the text: one on the words would be pushed below them and work them out twice
    base = documents.where(F.col(text).rlike(r"(?U)\b[A-Za-z]+\b")).select(key, *keep, words.alias("words"), parts.alias("parts"))
    lengths = F.transform("parts", lambda s: F.regexp_count(s, F.lit(r"(?U)\b\w+\b")))
    counted = base.withColumn("lengths", lengths).withColumn("syl", F.transform("words", lambda w: S.syllables(w))).withColumn("sorted", F.array_sort("words"))
    n, m = F.size("words"), F.size("parts")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    mean = total("lengths") / F.greatest(m, F.lit(1))
    lone = F.size(F.filter("sorted", lambda w, i: (F.coalesce(F.get("sorted", i - 1), F.lit("")) != w) & (F.coalesce(F.get("sorted", i + 1), F.lit("")) != w)))
    spread = F.sqrt(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(m, F.lit(1)))
    syl, complex_ = total("syl"), F.size(F.filter("syl", lambda x: x >= 3))
    kinds = F.size(F.array_distinct("words"))
    return counted.select(
        key, *keep, n.alias("word_count"), m.alias("sentence_count"), mean.alias("avg_sentence_length"), spread.alias("sentence_length_std"), kinds.alias("vocabulary_size"), (kinds / n).alias("type_token_ratio"), (lone / kinds).alias("hapax_ratio"),
        S.reading_ease(m, n, syl).alias("reading_ease"), S.grade_level(m, n, syl).alias("grade_level"), S.fog_index(m, n, complex_).alias("gunning_fog"),
    )


def length_histogram(lengths: DataFrame, length: str = "n", *, width: int = 5, last: int = 100) -> DataFrame:
    """(bin_start, bin_end, count): bins of equal width without holes; the last is open and has a null end."""
    held = lengths.where(F.col(length).isNotNull())
    end = F.floor(F.least(F.col("m"), F.lit(last)) / width) * width
    bounds = held.agg(F.max(length).alias("m")).where("m is not null").select(end.cast("long").alias("top"))
    bins = bounds.select("top", F.explode(F.sequence(F.lit(0).cast("long"), "top", F.lit(width).cast("long"))).alias("bin_start"))
    counts = held.crossJoin(F.broadcast(bounds)).groupBy(F.least((F.floor(F.col(length) / width) * width).cast("long"), F.col("top")).alias("bin_start")).agg(F.count("*").alias("n"))
    return bins.join(F.broadcast(counts), "bin_start", "left").select("bin_start", F.when(F.col("bin_start") < F.col("top"), F.col("bin_start") + width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"))


def distinctive_words(documents: DataFrame, *, text: str = "text", common: tuple[str, ...] = (), considered: int = 500, least: int = 5, top: int = 50) -> DataFrame:
    """(word, count, per_10k): among the most frequent words of three letters or more those that are not common, ties by word."""
    each = documents.select(F.explode(T.tokens(F.lower(text), r"(?U)\b[a-z]{3,}\b")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    head = counts.orderBy(F.desc("count"), "word").limit(considered)
    kept = head.where(F.col("count") >= least)
    if common:
        kept = kept.where(~F.col("word").isin(*common))
    return kept.orderBy(F.desc("count"), "word").limit(top).crossJoin(F.broadcast(total)).select("word", "count", (F.col("count") * 10000 / F.col("total")).alias("per_10k"))


def style(text: Column, distinctive: tuple[str, ...]) -> Column:
    """struct of a text's words, type-token ratio, mean length of sentences over three words, and hits of distinctive words a thousand."""
    words = T.tokens(F.lower(text), r"[a-z][a-z'-]*")
    n = F.size(words)
    long_ = F.filter(F.transform(T.sentences(text), lambda s: F.size(T.tokens(s))), lambda k: k > 3)
    hits = F.size(F.filter(words, lambda w: w.isin(*distinctive))) if distinctive else F.lit(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return F.struct(
        n.alias("word_count"), F.round(ratio(F.size(F.array_distinct(words)), n), 3).alias("ttr"), F.round(ratio(F.aggregate(long_, F.lit(0), lambda a, x: a + x), F.size(long_)), 1).alias("sentence_length"), F.round(ratio(hits * 1000, n), 1).alias("hits_per_1k"),
    )
