"""The corpus itself: canonical entries, hashes, fingerprints, composition, coverage and its gaps, incremental upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as T


def content_hash(body: str = "body") -> Column:
    """MD5 of a body, of "" for null."""
    return F.md5(F.coalesce(F.col(body), F.lit("")))


def first_per_file(entries: DataFrame, *, file: str = "file", position: str = "_pos") -> DataFrame:
    """The first entry of each file; entries without a file all pass."""
    named = F.coalesce(F.col(file), F.lit("")) != ""
    ranked = entries.where(named).withColumn("_rn", F.row_number().over(W.partitionBy(file).orderBy(position))).where("_rn = 1").drop("_rn")
    return ranked.unionByName(entries.where(~named))


def canonical_entries(entries: DataFrame, *, slug: str = "slug", url: str = "url", position: str = "article_id", body: str = "body") -> DataFrame:
    """One entry per slug: with a body first, then without a query, then https, then the shorter URL, then the first seen. Entries without a slug all pass."""
    u = F.coalesce(F.col(url), F.lit(""))
    order = [(F.coalesce(F.col(body), F.lit("")) == "").cast("int"), u.contains("?").cast("int"), (~u.startswith("https://")).cast("int"), F.length(u), F.col(position)]
    has = F.coalesce(F.col(slug), F.lit("")) != ""
    kept = entries.where(has).withColumn("_rn", F.row_number().over(W.partitionBy(slug).orderBy(*order))).where("_rn = 1").drop("_rn")
    return kept.unionByName(entries.where(~has))


def collapsed_slugs(entries: DataFrame, *, slug: str = "slug", url: str = "url", position: str = "article_id", body: str = "body") -> DataFrame:
    """(slug, kept_url, dropped): what ``canonical_entries`` collapses."""
    kept = canonical_entries(entries, slug=slug, url=url, position=position, body=body).where(F.coalesce(F.col(slug), F.lit("")) != "").select(F.col(slug).alias("slug"), F.col(url).alias("kept_url"))
    counts = entries.groupBy(F.col(slug).alias("slug")).agg((F.count("*") - 1).alias("dropped")).where("dropped > 0")
    return counts.join(kept, "slug").select("slug", "kept_url", "dropped")


def with_bodies(entries: DataFrame, bodies: DataFrame, key: str = "file") -> DataFrame:
    """Entries whose raw body exists, in the order of their date strings."""
    return entries.join(bodies, key).orderBy("date", "_pos")


def backfill_hashes(entries: DataFrame, bodies: DataFrame, key: str = "file") -> DataFrame:
    """Entries with a missing content hash filled from the raw body, where there is one."""
    have = bodies.select(key, F.md5(F.coalesce("body", F.lit(""))).alias("_hash"))
    return entries.join(have, key, "left").withColumn("content_hash", F.coalesce(F.nullif(F.col("content_hash"), F.lit("")), "_hash")).drop("_hash")


def audit(entries: DataFrame, files: DataFrame | None = None, *, slug: str = "slug", url: str = "url", hash_: Column | None = None, file: str | None = None) -> DataFrame:
    """(issue, value, n): slugs, URLs and contents that recur, entries without content, and files that only one side knows."""
    h = content_hash() if hash_ is None else hash_

    def recurring(name: str, c: Column, of: DataFrame) -> DataFrame:
        return of.select(c.alias("value")).where(F.coalesce("value", F.lit("")) != "").groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("issue"), "value", "n")

    empty = F.coalesce(F.col("body"), F.lit("")) == "" if "body" in entries.columns else F.lit(False)
    out = recurring("slug", F.col(slug), entries).unionByName(recurring("url", F.col(url), entries)).unionByName(recurring("content", h, entries.where(~empty)))
    out = out.unionByName(entries.where(empty).groupBy(F.col(slug).alias("value")).agg(F.count("*").alias("n")).select(F.lit("no content").alias("issue"), "value", "n"))
    if files is not None and file:
        named = entries.where(F.coalesce(F.col(file), F.lit("")) != "").select(F.col(file).alias("value")).distinct()
        there = files.select(F.col(file).alias("value")).distinct()
        for name, a, b in (("missing file", named, there), ("orphaned file", there, named)):
            out = out.unionByName(a.join(b, "value", "left_anti").select(F.lit(name).alias("issue"), "value", F.lit(1).cast("long").alias("n")))
    return out


def fingerprint(articles: DataFrame, *, slug: str = "slug", hash_: Column | None = None, prefix: str = "") -> DataFrame:
    """(fingerprint, articles, words): one row that changes with any slug or body.

    Hashes of sorted "slug:hash" strings are taken within 4,096 parts and then over
    the parts, so no task holds the whole list.
    """
    h = content_hash() if hash_ is None else hash_
    item = F.concat_ws(":", F.coalesce(F.col(slug), F.lit("")), h)
    words = F.size(T.tokens("body", r"\S+")) if "body" in articles.columns else F.lit(0)
    parts = articles.select(item.alias("item"), words.alias("w")).withColumn("part", F.substring(F.md5("item"), 1, 3)).groupBy("part").agg(F.md5(F.array_join(F.sort_array(F.collect_list("item")), "|")).alias("h"), F.count("*").alias("n"), F.sum("w").alias("w"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "|").alias("all"), F.sum("n").alias("articles"), F.sum("w").alias("words"))
    return whole.select(F.md5(F.concat(F.lit(prefix), "all")).alias("fingerprint"), F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("words", F.lit(0)).alias("words"))


def composition(documents: DataFrame, *, text: str = "text", by: tuple[str, ...] = ("modality", "authorship")) -> DataFrame:
    """(dimension, value, items, words, share): what a corpus is made of, by each dimension in one pass; shares are of all words."""
    w = F.size(T.tokens(text, r"\S+"))
    stacked = documents.select(w.alias("w"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("unknown")).alias("value")) for d in by])).alias("x"))
    tally = stacked.groupBy("x.dimension", "x.value").agg(F.count("*").alias("items"), F.sum("w").alias("words"))
    total = F.sum("words").over(W.partitionBy("dimension"))
    return tally.select("dimension", "value", "items", "words", F.coalesce(F.try_divide(F.col("words").cast("double"), total), F.lit(0.0)).alias("share"))


def covered(held: DataFrame, found: DataFrame, *, url: str = "url") -> DataFrame:
    """(key, month, held, found): dated URLs of both sides by their canonical key, each key once."""
    def side(df: DataFrame, name: str) -> DataFrame:
        u = T.dated_url(url)
        return df.select(u.alias("u")).where(F.col("u").isNotNull()).groupBy("u.key").agg(F.min("u.month").alias(f"{name}_month"))

    both = side(held, "held").join(side(found, "found"), "key", "full_outer")
    return both.select("key", F.coalesce("held_month", "found_month").alias("month"), F.col("held_month").isNotNull().alias("held"), F.col("found_month").isNotNull().alias("found"))


def coverage_by_month(held: DataFrame, found: DataFrame, *, url: str = "url") -> DataFrame:
    """(month, have, discovered, missing) of the canonical keys of both sides."""
    c = covered(held, found, url=url)
    n = lambda x: F.count_if(x)
    return c.groupBy("month").agg(n(F.col("held")).alias("have"), n(F.col("found")).alias("discovered"), n(F.col("found") & ~F.col("held")).alias("missing"))


def month_ranges(months: DataFrame, month: str = "month") -> DataFrame:
    """(range): runs of consecutive months as "first..last", a lone month bare."""
    d = months.select(F.col(month).alias("m")).where(F.col("m").rlike(r"^\d{4}-\d{2}$")).distinct()
    index = F.substring("m", 1, 4).cast("int") * 12 + F.substring("m", 6, 2).cast("int")
    runs = d.withColumn("run", index - F.row_number().over(W.orderBy("m"))).groupBy("run").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    return runs.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("..", "a", "b")).alias("range"))


def upsert(articles: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """Rows of ``articles`` replaced by those of ``new`` with the same key, and the other new rows behind them."""
    return articles.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not known."""
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def changed(current: DataFrame, log: DataFrame, module: str) -> bool:
    """Whether a module must run again: its last logged fingerprint differs from the current one."""
    last = log.where(F.col("module") == module).agg(F.max_by("corpus_fingerprint", "timestamp")).first()
    return last is None or last[0] != current.first()["fingerprint"]
