"""Oversized texts cut at natural boundaries (5), by one bounded-quantifier regular expression and SQL array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \\t\\n"


def _run(chars: int | None) -> str:
    """The letters of a word; with ``chars``, a longer run is several words of so many characters."""
    return f"[^{_BLANK}]" + (f"{{1,{chars}}}" if chars else "+")


def word_count(text: str | Column, chars: int | None = None) -> Column:
    """Words of a text: runs of characters other than space, tab and newline, of ``chars`` at most if given; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(_run(chars))), F.lit(0))


def segment_pattern(most: int, least: int, chars: int | None = None) -> str:
    """A pattern whose matches, one after the other, are a text in segments of at most ``most`` words.

    Its alternatives come in order of strength: the whole rest; up to the last
    paragraph break, line break, sentence end or clause end behind ``least`` words; up to
    ``most`` words, which may end between two characters of a run longer than ``chars``.
    """
    unit = f"{_run(chars)}+[{_BLANK}]*+"
    head, units = f"[{_BLANK}]*+", f"(?:{unit}){{{least},{most}}}"
    ends = (
        r"(?<=\n[ \t]{0,16}\n[ \t\n]{0,16})",
        r"(?<=\n[ \t]{0,16})",
        r"(?<=[.!?…][\"'”’»)\]]{0,3}[ \t]{1,16}|[。！？])",
        r"(?<=[,;:–—][ \t]{1,16})",
    )
    whole = f"{head}(?:{unit}){{1,{most}}}+\\z"
    return "|".join([whole, *(head + units + e for e in ends), f"{head}(?:{unit}){{1,{most}}}+"])


def pieces(articles: DataFrame, *, key: str = "article_id", text: str = "body", limit: int = 800, overlap: int = 50, chars: int | None = None) -> DataFrame:
    """(key, piece_no, start, n_words, text): each text as ordered pieces of at most ``limit`` words, neighbours sharing ``overlap`` words.

    A text within the limit is one piece, as it stands. A longer one is cut into
    segments of at most ``limit - overlap`` words; each piece but the first begins with the
    last ``overlap`` words of the segment before, so that the pieces without their
    overlaps, joined, are the text. Where runs without blanks are long, as in Chinese or in
    encoded data, ``chars`` makes each so many characters of them a word, and they are cut between characters when
    no boundary is in reach. ``start`` is the piece's first character, from 0. Null,
    empty and blank texts have no piece; repeated rows are cut each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    most = limit - overlap
    body = articles.select(F.col(key).alias(key), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("n", word_count("text", chars)).where("n > 0")
    segments = F.when(F.col("n") <= limit, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(segment_pattern(most, max(overlap, most * 3 // 5), chars)), F.lit(0)))
    each = body.select(key, segments.alias("segments")).withColumn("lengths", F.transform("segments", F.length))
    placed = each.select(key, "segments", "lengths", F.posexplode("segments").alias("at", "segment"))
    before = F.when(F.col("at") > 0, F.get("segments", F.col("at") - 1)).otherwise(F.lit(""))
    units = F.regexp_extract_all(before, F.lit(f"(?:^[{_BLANK}]+)?{_run(chars)}[{_BLANK}]*"), F.lit(0))
    back = F.when((F.col("at") > 0) & F.lit(overlap > 0), F.array_join(F.slice(units, F.greatest(F.lit(1), F.size(units) - (overlap - 1)), overlap), "")).otherwise(F.lit(""))
    offset = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0), lambda a, x: a + x)
    return placed.select(key, (F.col("at") + 1).alias("piece_no"), (offset - F.length(back)).alias("start"), F.concat(back, "segment").alias("text")).select(key, "piece_no", "start", word_count("text", chars).alias("n_words"), "text")


def oversized(articles: DataFrame, *, key: str = "article_id", text: str = "body", limit: int = 800, overlap: int = 50) -> DataFrame:
    """(key) of texts that come out as more than one piece."""
    return pieces(articles, key=key, text=text, limit=limit, overlap=overlap).where("piece_no = 2").select(key)


def cover(articles: DataFrame, *, key: str = "article_id", text: str = "body", limit: int = 800, overlap: int = 50) -> DataFrame:
    """(key, words, same, within): for each text its words less those shared, whether its pieces without the shared words are the text, and whether all are within the limit."""
    each = pieces(articles, key=key, text=text, limit=limit, overlap=overlap)
    parts = each.groupBy(key).agg(F.sum("n_words").alias("n"), F.count("*").alias("k"), F.max("n_words").alias("most"), F.array_sort(F.collect_list(F.struct("piece_no", "start", "text"))).alias("p"))
    # each piece goes up to where the next one ends its overlap: by its start, the text from there on replaces what was joined
    joined = F.aggregate("p", F.lit(""), lambda a, x: F.concat(F.left(a, x["start"]), x["text"]))
    body = articles.select(F.col(key).alias(key), F.col(text).alias("body"))
    return parts.join(body, key).select(key, (F.col("n") - (F.col("k") - 1) * overlap).alias("words"), (joined == F.col("body")).alias("same"), (F.col("most") <= limit).alias("within"))
