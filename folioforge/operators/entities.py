"""Entities: mentions, the co-occurrence graph, stance over time, and changes of mind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioforge.functions import scores as S
from folioforge.functions import text as T

#: Names of picture agencies that page furniture leaves among the entities.
FURNITURE = ("getty images", "getty", "afp", "photo", "photographer", "photos", "illustration", "image")


def mentions(records: DataFrame, *, least: int = 1, exclude: tuple[str, ...] = FURNITURE, aliases: dict[str, str] | None = None) -> DataFrame:
    """(slug, date, id, name, type, mentions): one row per record and entity, spellings that fold to one name added up.

    Null arrays, blank names and names seen fewer than ``least`` times are dropped. A slug delivered twice counts once.
    """
    def of(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("n"), F.lit(kind).alias("type")))

    once = records.dropDuplicates(["slug"]) if "slug" in records.columns else records
    each = once.select("slug", "date", F.explode(F.concat(of("orgs", "org"), of("people", "person"))).alias("e")).where(F.col("e.n") >= least)
    named = each.select("slug", "date", T.canonical_name("e.name", aliases).alias("name"), "e.type", "e.n").where((F.col("name") != "") & ~F.lower("name").isin(*exclude))
    return named.groupBy("slug", "name", "type").agg(F.min("date").alias("date"), F.sum("n").alias("mentions")).select("slug", "date", F.concat_ws(":", "type", "name").alias("id"), "name", "type", "mentions")


def nodes(seen: DataFrame) -> DataFrame:
    """(id, name, type, article_count, total_mentions) of ``mentions``."""
    return seen.groupBy("id", "name", "type").agg(F.count_distinct("slug").alias("article_count"), F.sum("mentions").alias("total_mentions"))


def edges(seen: DataFrame, *, least: int = 1, most: int | None = None) -> DataFrame:
    """(source, target, weight): how many articles name both entities, source before target.

    An article's pairs come from its own list, not from a join over articles. Their number grows with the square of that list;
    where records hold more than the few names of each type they are stored with, ``most`` keeps the most mentioned of each type, ties by name.
    """
    if most is not None:
        seen = seen.withColumn("_n", F.row_number().over(W.partitionBy("slug", "type").orderBy(F.desc("mentions"), "name"))).where(F.col("_n") <= most)
    ids = seen.groupBy("slug").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rest = F.explode(F.transform("ids", lambda a, i: F.struct(a.alias("source"), F.slice("ids", i + 2, F.size("ids")).alias("others")))).alias("x")
    pairs = ids.select("slug", rest).select("slug", "x.source", F.explode("x.others").alias("target"))
    return pairs.groupBy("source", "target").agg(F.count_distinct("slug").alias("weight")).where(F.col("weight") >= least)


def graph(seen: DataFrame, *, top: int = 40, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges) of the ``top`` entities by articles, mentions and id, and of pairs seen at least ``least`` times."""
    best = nodes(seen).orderBy(F.desc("article_count"), F.desc("total_mentions"), "id").limit(top)
    kept = F.broadcast(best.select("id"))
    e = edges(seen, least=least).join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi")
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return best.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), e


def top_mentions(records: DataFrame, *, per_article: int = 10) -> DataFrame:
    """(slug, type, name, count, place): each article's most mentioned entities of each type, ties in the order given."""
    def of(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x, i: F.struct(x["name"].alias("name"), x["count"].alias("count"), F.lit(kind).alias("type"), i.alias("i")))

    each = records.dropDuplicates(["slug"]).select("slug", F.explode(F.concat(of("orgs", "org"), of("people", "person"))).alias("e")).select("slug", "e.*").where(F.col("name").isNotNull())
    place = F.row_number().over(W.partitionBy("slug", "type").orderBy(F.desc("count"), "i", "name"))
    return each.withColumn("place", place).where(F.col("place") <= per_article).drop("i")


def entity_totals(records: DataFrame, *, least: dict[str, int] | None = None, top: int = 50) -> DataFrame:
    """(type, name, count, article_count, place): the most mentioned entities of each type."""
    floor = {"org": 3, "person": 2} if least is None else least
    all_ = nodes(mentions(records, exclude=(), aliases={})).where(F.col("total_mentions") >= F.when(F.col("type") == "org", floor["org"]).otherwise(floor["person"]))
    place = F.row_number().over(W.partitionBy("type").orderBy(F.desc("total_mentions"), F.desc("article_count"), "name"))
    return all_.withColumn("place", place).where(F.col("place") <= top).select("type", "name", F.col("total_mentions").alias("count"), "article_count", "place")


def mention_sentences(articles: DataFrame, seen: DataFrame) -> DataFrame:
    """(slug, id, name, type, date, sentence): distinct sentences of an article that name one of its entities as a whole word."""
    cut_ = articles.select("slug", F.explode(F.array_distinct(T.sentences("body"))).alias("sentence"))
    return seen.join(cut_, "slug").where(T.names_word("sentence", "name")).select("slug", "id", "name", "type", "date", "sentence").distinct()


def observations(stance: DataFrame) -> DataFrame:
    """Stance observations delivered once each, with a year; null stances are left out."""
    once = stance.where(F.col("stance").isNotNull()).withColumn("year", T.year_of("date"))
    return once.dropDuplicates(["obs_id"]) if "obs_id" in stance.columns else once


def stance_by_year(seen: DataFrame, *, entity: str = "entity_id", score: str = "stance") -> DataFrame:
    """(entity, year, stance_sum, n_sentences, n_articles, mean_stance): exact yearly means; undated rows are left out."""
    dated = seen.where(F.col("year").isNotNull() & F.col(entity).isNotNull())
    out = dated.groupBy(F.col(entity).alias("entity"), "year").agg(F.sum(score).alias("stance_sum"), F.count("*").alias("n_sentences"), F.count_distinct("slug").alias("n_articles"))
    return out.withColumn("mean_stance", F.col("stance_sum") / F.col("n_sentences"))


def stance_board(seen: DataFrame, *, entity: str = "entity_id", score: str = "stance", least_articles: int = 2, threshold: float = 0.25) -> DataFrame:
    """(entity, article_count, total_sentences, overall_stance, first_year, last_year, trend, trend_delta) of each entity in enough articles.

    The trend compares the last year's mean with the first year's; one year is steady.
    """
    yearly = stance_by_year(seen, entity=entity, score=score)
    articles = seen.where(F.col("year").isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.count_distinct("slug").alias("article_count"))
    ends = yearly.groupBy("entity").agg(
        F.sum("n_sentences").alias("total_sentences"), F.sum("stance_sum").alias("s"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        (F.max_by("mean_stance", "year") - F.min_by("mean_stance", "year")).alias("delta"),
    )
    delta = F.round("delta", 4)
    trend = F.when(F.col("first_year") == F.col("last_year"), "steady").when(delta >= threshold, "warming").when(delta <= -threshold, "cooling").otherwise("steady")
    return ends.join(articles, "entity").where(F.col("article_count") >= least_articles).select("entity", "article_count", "total_sentences", (F.col("s") / F.col("total_sentences")).alias("overall_stance"), "first_year", "last_year", trend.alias("trend"), delta.alias("trend_delta"))


def movers(board: DataFrame, *, top: int = 10) -> DataFrame:
    """(trend, place, entity, trend_delta): the entities that warmed and cooled most."""
    size = F.abs("trend_delta")
    return board.where("trend <> 'steady'").withColumn("place", F.row_number().over(W.partitionBy("trend").orderBy(F.desc(size), "entity"))).where(F.col("place") <= top).select("trend", "place", "entity", "trend_delta")


def reversals(seen: DataFrame, *, entity: str = "entity_id", least: int = 4, least_delta: float = 1.0) -> DataFrame:
    """(entity, n_observations, early_stance, late_stance, delta, direction, early_sentence, late_sentence): subjects whose view turned.

    Observations with a stance are put in the order of their dates and halved, the middle one going
    to the later half. A view has turned when the halves' means have opposite signs and differ by
    ``least_delta``. The quotes are the most telling observation of each half, the first of equals.
    """
    held = seen.where((F.col("stance") != 0) & F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.coalesce("date", F.lit("")).alias("date"), "stance", "sentence", "obs_id").withColumn("month", F.substring("date", 1, 7))
    # places are counted over months first, so that only the month in which the halves meet is put in order row by row
    months = held.groupBy("entity", "month").agg(F.count("*").alias("k")).withColumn("n", F.sum("k").over(W.partitionBy("entity")))
    months = months.withColumn("before", F.sum("k").over(W.partitionBy("entity").orderBy("month")) - F.col("k")).withColumn("half", F.floor(F.col("n") / 2)).where(F.col("n") >= least)
    placed = held.join(months, ["entity", "month"])
    split = placed.where((F.col("before") < F.col("half")) & (F.col("before") + F.col("k") > F.col("half")))
    split = split.withColumn("early", F.col("before") + F.row_number().over(W.partitionBy("entity", "month").orderBy("date", "obs_id")) <= F.col("half"))
    whole = placed.where((F.col("before") >= F.col("half")) | (F.col("before") + F.col("k") <= F.col("half"))).withColumn("early", F.col("before") < F.col("half"))
    both = whole.unionByName(split)
    early = F.col("early")
    high, low = F.struct((-F.col("stance")).alias("s"), "date", "obs_id"), F.struct(F.col("stance").alias("s"), "date", "obs_id")
    halves = both.groupBy("entity").agg(
        F.first("n").alias("n_observations"), F.avg(F.when(early, F.col("stance"))).alias("early_stance"), F.avg(F.when(~early, F.col("stance"))).alias("late_stance"),
        F.min_by("sentence", F.when(early, high)).alias("eh"), F.min_by("sentence", F.when(early, low)).alias("el"), F.min_by("sentence", F.when(~early, high)).alias("lh"), F.min_by("sentence", F.when(~early, low)).alias("ll"),
    )
    fell = F.col("early_stance") > 0
    turned = halves.where((F.signum("early_stance") * F.signum("late_stance") < 0) & (F.abs(F.col("late_stance") - F.col("early_stance")) >= least_delta))
    return turned.select(
        "entity", "n_observations", F.round("early_stance", 3).alias("early_stance"), F.round("late_stance", 3).alias("late_stance"), F.round(F.col("late_stance") - F.col("early_stance"), 3).alias("delta"),
        F.when(fell, "cooled").otherwise("warmed").alias("direction"), F.when(fell, F.col("eh")).otherwise(F.col("el")).alias("early_sentence"), F.when(fell, F.col("ll")).otherwise(F.col("lh")).alias("late_sentence"),
    )


def subject_groups(totals: DataFrame, *, least: int = 4, aliases: dict[str, str] | None = None) -> DataFrame:
    """(subject, type, surfaces): spellings in enough articles, grouped by their folded name."""
    enough = totals.where((F.col("article_count") >= least) & (F.coalesce("name", F.lit("")) != "")).withColumn("subject", T.canonical_name("name", aliases))
    return enough.groupBy(F.lower("subject").alias("k")).agg(F.min("subject").alias("subject"), F.min("type").alias("type"), F.array_sort(F.collect_set("name")).alias("surfaces")).drop("k")


def quotables(rows: DataFrame, *, sentence: str = "sentence", group: str = "entity_id", top: int = 10, least_score: float = 0.0) -> DataFrame:
    """(group, place, sentence, score, candidates): each group's most quotable sentences, each once, ties by text."""
    fit = rows.where(T.is_quotable(sentence)).select(F.col(group).alias("group"), F.col(sentence).alias("sentence"), S.quotability(sentence).alias("score")).where(F.col("score") >= least_score)
    once = fit.groupBy("group", "sentence").agg(F.max("score").alias("score"))
    n = once.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("candidates"))
    # ranked without another window function beside, so that Spark keeps ``top`` rows a group before it shuffles
    best = once.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(F.desc("score"), "sentence"))).where(F.col("place") <= top)
    return best.join(n, F.col("group").eqNullSafe(F.col("of"))).select("group", "place", "sentence", "score", "candidates")
