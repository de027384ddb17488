"""Predictions and their verdicts: precedence, tallies, calibration, boards, and capped picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import text as T

RESOLVED = ("vindicated", "mixed", "wrong")
CONFIDENCE = ("certain", "confident", "hedged")


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def verdict(human: str = "human_verdict", evidence: str = "evidence_verdict", model: str = "llm_verdict", status: str = "status") -> Column:
    """The verdict that counts: human, then evidence, then model, then status, empty ones skipped; "pending" for none."""
    return F.coalesce(_given(human), _given(evidence), _given(model), _given(status), F.lit("pending"))


def verdict_source(human: str = "human_verdict", evidence: str = "evidence_verdict", model: str = "llm_verdict") -> Column:
    return F.when(_given(human).isNotNull(), "human").when(_given(evidence).isNotNull(), "evidence").when(_given(model).isNotNull(), "llm").otherwise("pending")


def tally(rows: DataFrame, *, verdict_column: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., verdict, n)."""
    return rows.withColumn("verdict", verdict_column).groupBy(*by, "verdict").agg(F.count("*").alias("n"))


def calibration(rows: DataFrame, *, verdict_column: Column, confidence: str = "confidence_language", buckets: tuple[str, ...] = CONFIDENCE) -> DataFrame:
    """(confidence, vindicated, mixed, wrong, resolved, accuracy) of each bucket, also of empty ones; a mixed outcome counts half, accuracy is null where nothing is resolved."""
    spark = rows.sparkSession
    n = lambda v: F.count_if(F.col("v") == v).alias(v)
    each = rows.select(F.col(confidence).alias("confidence"), verdict_column.alias("v")).groupBy("confidence").agg(n("vindicated"), n("mixed"), n("wrong"))
    all_ = spark.createDataFrame([(b,) for b in buckets], "confidence string").join(each, "confidence", "left").na.fill(0)
    resolved = F.col("vindicated") + F.col("mixed") + F.col("wrong")
    return all_.select("confidence", "vindicated", "mixed", "wrong", resolved.alias("resolved"), F.round(F.try_divide(F.col("vindicated") + 0.5 * F.col("mixed"), resolved), 3).alias("accuracy"))


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def notable(rows: DataFrame, *, year: int | None = None, limit: int = 6, per_article: int = 1, only: str | None = None) -> DataFrame:
    """(place, claim, article, verdict): the first ``limit`` claims by verdict, conviction and position, each claim once and so many per article.

    The picks depend on one another, so they are made one by one, from few rows: at most ``limit`` articles can be full, so a claim
    needs its ``limit`` best articles only; an article gives ``per_article`` picks and is passed over for
    claims already picked ``limit`` times at most; so limit x (2 x limit + per_article + 1) rows by rank always suffice.
    """
    v = F.col("llm_verdict") if only else verdict()
    order = (*RESOLVED, "unfalsifiable", "pending")
    base = rows.withColumn("verdict", v)
    if only:
        base = base.where(F.col("verdict") == only)
    if year is not None:
        base = base.where(T.year_of("article_date") == str(year))
    ranked = base.select("claim", F.coalesce(_given("article_slug"), F.col("article_title"), F.lit("")).alias("article"), "verdict", F.struct(_rank(F.col("verdict"), order).alias("v"), _rank(F.col("confidence_language"), CONFIDENCE).alias("c"), F.col("_pos").alias("p")).alias("key"))
    once = ranked.groupBy("claim", "article").agg(F.min("key").alias("key"), F.min_by("verdict", "key").alias("verdict"))
    few = once.withColumn("n", F.row_number().over(W.partitionBy("claim").orderBy("key"))).where(F.col("n") <= limit)
    near = few.withColumn("n", F.row_number().over(W.partitionBy("article", F.when(F.col("article") == "", F.col("claim"))).orderBy("key"))).where(F.col("n") <= per_article + limit)
    out, seen, used = [], set(), {}
    for r in near.orderBy("key", "claim", "article").limit(limit * (2 * limit + per_article + 1)).collect():
        if r.claim in seen or r.article and used.get(r.article, 0) >= per_article:
            continue
        seen.add(r.claim)
        used[r.article] = used.get(r.article, 0) + 1
        out.append((len(out) + 1, r.claim, r.article, r.verdict))
        if len(out) >= limit:
            break
    return rows.sparkSession.createDataFrame(out, "place int, claim string, article string, verdict string")


def conviction_board(rows: DataFrame, target: str, *, limit: int = 5) -> DataFrame:
    """Bold claims (certain before confident, then by position) with a verdict."""
    bold = rows.where(F.col("confidence_language").isin("certain", "confident") & (verdict() == target))
    return bold.orderBy(_rank(F.col("confidence_language"), CONFIDENCE), "_pos").limit(limit)


def apply_rulings(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rows with human rulings (claim, verdict, note) written through to their status; the last ruling of a claim counts."""
    last = rulings.groupBy("claim").agg(F.max_by("verdict", "_pos").alias("_v"), F.max_by("note", "_pos").alias("_n"))
    joined = rows.join(last, "claim", "left")
    hit = F.col("_v").isNotNull()
    return joined.withColumn("human_verdict", F.coalesce("_v", "human_verdict")).withColumn("human_verdict_note", F.coalesce("_n", F.lit(""))).withColumn("status", F.when(hit, F.col("_v")).otherwise(F.col("status"))).withColumn("verdict_source", verdict_source()).drop("_v", "_n")


def open_claims(rows: DataFrame, column: str = "human_verdict") -> DataFrame:
    """Rows without a verdict of one kind."""
    return rows.where(F.coalesce(F.col(column), F.lit("")) == "")


def parse_reply(reply: str | Column, schema: str) -> Column:
    """The JSON object between the first { and the last } of a model's reply; null where there is none."""
    r = F.col(reply) if isinstance(reply, str) else reply
    return F.from_json(F.nullif(F.regexp_extract(r, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def faithfulness(rows: DataFrame) -> DataFrame:
    """One row of rates over answered questions: grounding, hallucination, abstention, false abstention and citation, 0 where nothing counts.

    rows: answerable, claims_total, claims_grounded, abstained, cited.
    """
    a = F.coalesce(F.col("answerable"), F.lit(False))
    total, good = F.coalesce("claims_total", F.lit(0)), F.greatest(F.lit(0), F.least(F.coalesce("claims_grounded", F.lit(0)), F.coalesce("claims_total", F.lit(0))))
    shy, cited = F.coalesce(F.col("abstained"), F.lit(False)), F.coalesce(F.col("cited"), F.lit(False))
    c = rows.agg(F.count("*").alias("n"), F.count_if(a).alias("na"), F.sum(F.when(a, total)).alias("t"), F.sum(F.when(a, good)).alias("g"), F.count_if(~a & shy).alias("s"), F.count_if(a & shy).alias("f"), F.count_if(a & cited).alias("c"))
    rate = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double") if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y), F.lit(0.0)), 4)
    return c.select(
        F.col("n").alias("n_questions"), F.col("na").alias("n_answerable"), rate("g", "t").alias("grounding_rate"), F.when(F.coalesce("t", F.lit(0)) > 0, F.round(1 - rate("g", "t"), 4)).when(F.col("na") > 0, 1.0).otherwise(0.0).alias("hallucination_rate"),
        rate("s", F.col("n") - F.col("na")).alias("abstention_accuracy"), rate("f", "na").alias("false_abstention_rate"), rate("c", "na").alias("citation_coverage"),
    )


def win_rates(trials: DataFrame) -> DataFrame:
    """(source, wins, appearances, win_rate, avg_rank) from rankings (trial, ranking array<string>)."""
    each = trials.select(F.posexplode("ranking").alias("at", "source"))
    return each.groupBy("source").agg(F.count_if(F.col("at") == 0).alias("wins"), F.count("*").alias("appearances"), (F.count_if(F.col("at") == 0) / F.count("*")).alias("win_rate"), (F.avg("at") + 1).alias("avg_rank"))


def head_to_head(trials: DataFrame) -> DataFrame:
    """(better, worse, n): how often one source ranks before another."""
    rest = F.explode(F.transform("ranking", lambda a, i: F.struct(a.alias("better"), F.slice("ranking", i + 2, F.size("ranking")).alias("others")))).alias("x")
    return trials.select(rest).select("x.better", F.explode("x.others").alias("worse")).groupBy("better", "worse").agg(F.count("*").alias("n"))


def full_ranking(ranking: Column, labels: Column) -> Column:
    """A judge's ranking with unknown labels and repetitions dropped and the omitted labels behind."""
    return F.array_union(F.array_intersect(ranking, labels), labels)
