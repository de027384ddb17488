"""Reading lists, run histories and the staging queue of ingested files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as T


def reading_list(articles: DataFrame, *, limit: int = 200) -> DataFrame:
    """(place, slug, title, date, word_count, minutes, prev_slug, next_slug): the newest dated articles with a body, each slug once.

    The limit comes before the links, so only so many rows are put in one order.
    """
    held = articles.where((F.coalesce("date", F.lit("")) != "") & (F.coalesce(F.trim("body"), F.lit("")) != "") & (F.coalesce("slug", F.lit("")) != ""))
    once = held.groupBy("slug").agg(F.max_by(F.struct("title", "date", "word_count"), F.struct("date", (-F.col("article_id")).alias("o"))).alias("a")).select("slug", "a.*")
    head = once.orderBy(F.desc("date"), F.desc("slug")).limit(limit)
    w = W.orderBy(F.desc("date"), F.desc("slug"))
    return head.select(F.row_number().over(w).alias("place"), "slug", "title", "date", "word_count", T.reading_minutes("word_count").alias("minutes"), F.lead("slug").over(w).alias("prev_slug"), F.lag("slug").over(w).alias("next_slug"))


def runs(history: DataFrame) -> DataFrame:
    """(date, experiment, condition, arms): run history rows (one per arm) as one row per run, the last row of an arm counting, in the order first seen."""
    arm = history.groupBy("date", "experiment", "condition", "arm").agg(F.max_by(F.struct("win_rate", "avg_rank"), "_pos").alias("v"), F.min("_pos").alias("p"))
    return arm.groupBy("date", "experiment", "condition").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "v")))).alias("arms"), F.min("p").alias("_pos"))


def with_previous(runs_: DataFrame) -> DataFrame:
    """Each run beside the one before it of the same experiment."""
    return runs_.withColumn("previous", F.lag("arms").over(W.partitionBy("experiment").orderBy("_pos")))


def queue_counts(items: DataFrame, *, status: str = "status") -> DataFrame:
    """(status, n) of a staging queue."""
    return items.groupBy(F.coalesce(F.col(status), F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def new_files(items: DataFrame, known: DataFrame, *, hash_: str = "content_hash") -> DataFrame:
    """Items whose content no known item has, the first of each content."""
    first = items.withColumn("_n", F.row_number().over(W.partitionBy(hash_).orderBy("staged_at", "extract_id"))).where("_n = 1").drop("_n")
    return first.join(known.select(hash_).distinct(), hash_, "left_anti")


def item_views(items: DataFrame, *, preview: int = 400) -> DataFrame:
    """(extract_id, original, status, n_documents, preview): a listing without the bodies."""
    text = F.try_element_at("documents", F.lit(1))["text"]
    return items.select("extract_id", "original", "status", F.size(F.coalesce("documents", F.array())).alias("n_documents"), F.substring(T.squeeze(F.coalesce(text, F.lit(""))), 1, preview).alias("preview"))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with decisions (extract_id, decision, reason) applied: only pending items change, and a rejection needs a reason."""
    d = decisions.where(F.col("decision").isin("accepted", "rejected") & ((F.col("decision") == "accepted") | (F.coalesce(F.trim("reason"), F.lit("")) != "")))
    joined = items.join(d.select("extract_id", "decision", F.col("reason").alias("reject_reason")), "extract_id", "left")
    change = (F.coalesce("status", F.lit("pending")) == "pending") & F.col("decision").isNotNull()
    return joined.withColumn("status", F.when(change, F.col("decision")).otherwise(F.col("status"))).withColumn("reject_reason", F.when(change & (F.col("decision") == "rejected"), F.col("reject_reason"))).drop("decision")


def with_provenance(entries: DataFrame) -> DataFrame:
    """Entries with a provenance block where they have none: public, scraped, by the corpus's author."""
    block = F.struct(
        F.lit("article").alias("modality"), F.lit("author").alias("authorship"), F.lit("public").alias("privacy"), F.lit("owned").alias("license"), F.lit("exact").alias("date_confidence")
    )
    return entries.withColumn("provenance", F.coalesce("provenance", block)) if "provenance" in entries.columns else entries.withColumn("provenance", block)


def assert_public(sources: DataFrame | None, *, privacy: str = "privacy") -> None:
    """Refuse to hand sources to a remote service unless every one is known and public."""
    if sources is None:
        raise PermissionError("unknown sources may not leave")
    if not sources.where(F.coalesce(F.col(privacy), F.lit("private")) != "public").isEmpty():
        raise PermissionError("private sources may not leave")
