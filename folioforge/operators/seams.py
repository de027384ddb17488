"""Injected models: entity recognisers, embedders, language models and judges as functions over batches, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.predictions import parse_reply
from folioforge.operators.reading import assert_public

_PHRASE = re.compile(r"\b[A-Z][\w'&-]*(?:\.\w+)*(?:\s+(?:(?:of|and|&|the|for)\s+)?[A-Z][\w'&-]*(?:\.\w+)*)+")
_ORG = re.compile(r"\b(?:bank|reserve|company|corporation|group|institute|bureau|department|exchange|university|fund|holdings|authority|inc|corp|ltd|trust|union|board|council|agency)\b", re.I)
RECORDS = "slug string, date string, orgs array<struct<name:string,count:int>>, people array<struct<name:string,count:int>>"


def capitalised(text: str) -> list[tuple[str, str]]:
    """(name, type) of capitalised phrases: an organisation when a word tells so, else a person when it has two or three words."""
    out = []
    for m in _PHRASE.finditer(text or ""):
        name = re.sub(r"\s+", " ", m.group()).rstrip(".")
        if _ORG.search(name):
            out.append((name, "org"))
        elif 2 <= len(name.split()) <= 3:
            out.append((name, "person"))
    return out


def recognise(articles: DataFrame, ner: Callable[[str], list[tuple[str, str]]] = capitalised, *, per_article: int = 10) -> DataFrame:
    """Entity records of articles (slug, date, body) by a recogniser; each article's ten most frequent of each type, first seen first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for slug, date, body in zip(b["slug"], b["date"], b["body"], strict=True):
                seen = {t: Counter() for t in ("org", "person")}
                for name, kind in ner(body or ""):
                    seen[kind][name] += 1
                top = {t: [{"name": n, "count": c} for n, c in seen[t].most_common(per_article)] for t in seen}
                rows.append((slug, date, top["org"], top["person"]))
            yield pd.DataFrame(rows, columns=["slug", "date", "orgs", "people"])

    return articles.select("slug", "date", "body").mapInPandas(run, RECORDS)


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A unit vector of hashed word counts, the same everywhere."""
    v = [0.0] * size
    for w in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(df: DataFrame, *, key: str, text: str, model: str = "hashed", call: Callable[[str, list[str]], list[list[float]]] | None = None, batch: int = 16) -> DataFrame:
    """(key, model, embedding) by an embedder called with batches of texts."""
    use = call or (lambda _, texts: [hashed_vector(t) for t in texts])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "model": model, "embedding": use(model, [t or "" for t in part[text]])})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, model string, embedding array<float>")


def with_retries(call: Callable[[str], str], *, attempts: int = 3, wait: float = 2.0) -> Callable[[str], str]:
    """A call that is tried again after growing waits."""
    def run(x: str) -> str:
        for n in range(1, attempts + 1):
            try:
                return call(x)
            except Exception:
                if n == attempts:
                    raise
                time.sleep(wait**n)
        raise AssertionError

    return run


def ask(rows: DataFrame, *, key: str, prompt: str, call: Callable[[str], str], sources: DataFrame | None = None, remote: bool = False) -> DataFrame:
    """(key, reply, error): a language model's reply to each row's prompt; a failed call leaves an error instead of ending the job. Remote models are refused private sources."""
    if remote:
        assert_public(sources)
    kind = rows.schema[key].dataType.simpleString()
    safe = with_retries(call)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt], strict=True):
                try:
                    out.append((k, safe(p), None))
                except Exception as e:
                    out.append((k, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    return rows.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, reply string, error string")


def judged(replies: DataFrame, *, key: str) -> DataFrame:
    """(key, claims_total, claims_grounded, citations_valid, abstained) from a judge's replies, grounded claims held within the total; replies without JSON have no row."""
    j = replies.select(key, parse_reply("reply", "claims_total int, claims_grounded int, citations_valid boolean, abstained boolean").alias("j")).where(F.col("j").isNotNull())
    total = F.coalesce("j.claims_total", F.lit(0))
    return j.select(key, total.alias("claims_total"), F.greatest(F.lit(0), F.least(F.coalesce("j.claims_grounded", F.lit(0)), total)).alias("claims_grounded"), F.coalesce("j.citations_valid", F.lit(False)).alias("citations_valid"), F.coalesce("j.abstained", F.lit(False)).alias("abstained"))


def extracted_claims(replies: DataFrame, *, key: str) -> DataFrame:
    """(key, claim, horizon, confidence_language, topic) from the JSON array in each reply."""
    array = F.from_json(F.nullif(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), F.lit("")), "array<struct<claim:string,target_date_or_horizon:string,confidence_language:string,topic:string>>")
    each = replies.select(key, F.explode(array).alias("c")).where(F.coalesce("c.claim", F.lit("")) != "")
    return each.select(key, "c.claim", F.col("c.target_date_or_horizon").alias("horizon"), "c.confidence_language", "c.topic")


def resumed(todo: DataFrame, done: DataFrame, *, key: str) -> DataFrame:
    """What a resumable step still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
