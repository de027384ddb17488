"""Writers: JSON lines, append-only logs, reports, CSV metadata, plain-text corpora and vector exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, *, order: tuple[str, ...] = ()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(entries: DataFrame, path: str, *, whole: int = 100_000) -> None:
    """A manifest and its total: one JSON document for up to ``whole`` entries; beyond, ``path/summary`` and the entries as JSON lines in ``path/articles``, which no single task gathers."""
    own = [c for c in entries.columns if c != "_pos"]
    at = "_pos" if "_pos" in entries.columns else F.lit(0).alias("_pos")
    n = entries.count()
    if n > whole:
        entries.sparkSession.range(1).select(F.current_timestamp().cast("string").alias("last_updated"), F.lit(n).alias("total_articles")).write.mode("overwrite").json(f"{path}/summary")
        (entries.orderBy("_pos") if "_pos" in entries.columns else entries).select(*own).write.mode("overwrite").json(f"{path}/articles")
        return
    listed = entries.select(F.struct(*own).alias("a"), at).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "a"))), lambda x: x["a"]).alias("articles"))
    listed.select(F.current_timestamp().cast("string").alias("last_updated"), F.size("articles").alias("total_articles"), "articles").coalesce(1).write.mode("overwrite").json(path)


def report(summary: DataFrame, records: DataFrame, path: str) -> None:
    """A summary row and its records side by side."""
    summary.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")


def metadata_csv(articles: DataFrame, path: str) -> None:
    """slug, title, date, word_count, tags joined by |, url."""
    articles.select("slug", "title", F.substring("date", 1, 10).alias("date"), "word_count", F.concat_ws("|", "tags").alias("tags"), "url").write.mode("overwrite").csv(path, header=True, escape='"')


def text_corpus(articles: DataFrame, path: str) -> None:
    """Articles as text in the order of their dates."""
    block = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\nDate: "), F.coalesce("date", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n\n---\n"))
    articles.orderBy("date", "slug").select(block.alias("value")).write.mode("overwrite").text(path)


def vectors(df: DataFrame, path: str, *, vector: str = "embedding", digits: int = 5) -> None:
    df.withColumn(vector, F.transform(vector, lambda x: F.round(x.cast("double"), digits))).write.mode("overwrite").json(path)


def to_json(df: DataFrame, limit: int = 10_000) -> str:
    """A small result as one JSON document; larger ones are refused."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them instead")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)
