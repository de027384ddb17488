"""Evaluation passages inside training documents (7): a prefix-filtered set join on word shingles, verified over item-sized windows."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut

SHINGLE = 5  # words
ROWS = 1_000
FILTER_BITS = 1 << 26  # of the filter that goes out to the documents, whatever the number of items: 8 MB
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]{0,200}>")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_HYPHEN = re.compile("(?<=[^\\W\\d_])[-\u2010\u2011][ \\t]*\\n?[ \\t]*(?=[^\\W\\d_])")
_APOSTROPHE = re.compile("(?<=[^\\W\\d_])['’ʼ](?=[^\\W\\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text when case, punctuation, spacing, line breaks and markup do not count; none of null."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "-" in text or "\u2010" in text or "\u2011" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(_APOSTROPHE.sub("", text.lower()))


def shingles(w: list[str]) -> Iterator[str]:
    return map(" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))


class _Hashes(dict):
    """Hashes of words, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_KNOWN = _Hashes()
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)


def hashes(w: list[str]) -> np.ndarray:
    """A 64-bit hash of each shingle of some words."""
    n = len(w) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    each = np.array(list(map(_KNOWN.__getitem__, w)), dtype=np.uint64)
    out = each[:n] * _POWERS[0]
    for k in range(1, SHINGLE):
        out += each[k : k + n] * _POWERS[k]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def passages(items: DataFrame, *, run: int) -> DataFrame:
    """(item_id, passage): each item without its question line and without instruction lines.

    A line is an instruction when it is shorter than ``run`` words and stands in three
    items or more. Items with null or blank text, or nothing left, have no row.
    """
    each = items.where(F.col("text").isNotNull()).select("item_id", "question", F.posexplode(F.split("text", "\n"))).where((F.trim("col") != "") & ~F.coalesce(F.trim("col") == F.trim("question"), F.lit(False)))
    recurring = each.groupBy(F.trim("col").alias("line")).agg(F.count_distinct("item_id").alias("n")).where((F.col("n") >= 3) & (F.size(F.split("line", r"\s+")) < run))
    kept = each.withColumn("line", F.trim("col")).join(recurring, "line", "left_anti")
    return kept.groupBy("item_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(pos, line))), x -> x.line), '\n')").alias("passage"))


def _mapped(fn, schema: pa.Schema):
    """Rows of Arrow batches through ``fn``, which gives none or more rows for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = [x for row in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True) for x in fn(*row)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def filter_of(shingle_rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table of the column ``shingle``: the bit of each hash is set. It is merged by the executors and has ``bits`` bits at most."""
    at = F.pmod("shingle", F.lit(bits))
    parts = shingle_rows.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shingle, {bits}) % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(bits >> 6, dtype=np.int64)
    for r in parts.toLocalIterator():
        table[r.word] = r.bit
    return table


def _scan(table: np.ndarray, run: int, allowed: int):
    """(doc_id, hits, text) of each document that holds shingles the filter knows; the text only where so many of them begin within one window that it may leak."""
    need = max(1, run - SHINGLE + 1 - SHINGLE * allowed)
    bits = len(table) << 6

    def one(doc, text):
        h = hashes(words(text))
        at = np.mod(h, bits)
        met = np.flatnonzero((table[at >> 6] >> (at & 63)) & 1)
        if len(met):
            near = len(met) >= need and bool((met[need - 1 :] - met[: len(met) - need + 1] < run + allowed).any())
            yield doc, np.unique(h[met]).tolist(), text if near else None

    return _mapped(one, pa.schema([("doc_id", pa.int64()), ("hits", pa.list_(pa.int64())), ("text", pa.string())]))


def prefixes(own: list[int], count: dict[int, int], run: int, changes: int) -> set[int]:
    """The shingles of a passage one of which any leaking document must hold: the rarest of each window of ``run`` words.

    own: the passage's shingles in their order. A window has run - 4 of them; every changed word destroys five at most, so a leak
    keeps t = run - 4 - 5 * changes of them, and shares one of the run - 4 - t + 1 rarest.
    """
    size = run - SHINGLE + 1
    left = max(1, size - SHINGLE * changes)
    order = sorted(range(len(own)), key=lambda i: (count.get(own[i], 0), own[i]))
    rank = {i: r for r, i in enumerate(order)}
    need: set[int] = set()
    for a in range(max(1, len(own) - size + 1)):
        window = range(a, min(a + size, len(own)))
        need.update(own[i] for i in sorted(window, key=rank.__getitem__)[: max(1, len(window) - left + 1)])
    return need


def longest_run(doc: list[str], item: list[str], places: dict[str, list[int]], run: int, part: float) -> int:
    """Words of the longest passage part of at least ``run`` words in a document with at most ``run * part`` of them changed; 0 if none.

    Only diagonals that share a shingle are walked. Their runs of two or more equal
    words are chained; between two runs every changed, added or dropped word counts,
    and on one diagonal those that differ only.
    """
    allowed = int(run * part)
    # length and position bounds: so many shared shingles must begin within one window of the document
    need = max(1, run - SHINGLE + 1 - SHINGLE * allowed)
    met = [(i, at) for i, s in enumerate(shingles(doc)) if (at := places.get(s))]
    if not any(met[k + need - 1][0] - met[k][0] < run + allowed for k in range(len(met) - need + 1)):
        return 0
    seeds: dict[int, int] = defaultdict(int)
    for i, at in met:
        for j in at:
            seeds[i - j] += 1
    # every leak has a diagonal on which so many of its shingles lie, as each change can start another one
    if max(seeds.values()) * (allowed + 1) < need:
        return 0
    runs: list[tuple[int, int, int]] = []
    for d in seeds:
        start = -1
        for j in range(max(0, -d), min(len(item), len(doc) - d) + 1):
            if j < len(item) and j + d < len(doc) and item[j] == doc[j + d]:
                if start < 0:
                    start = j
            elif start >= 0:
                if j - start >= 2:
                    runs.append((start, start + d, j - start))
                start = -1
    runs.sort(key=lambda r: (r[1], r[0]))
    best = 0
    # the farthest end in the passage that each run reaches with each number of changes left, from the last run to the first
    reach = [[0] * (allowed + 1) for _ in runs]
    for i in range(len(runs) - 1, -1, -1):
        a, b, n = runs[i]
        for left in range(allowed + 1):
            far = a + n
            for k in range(i + 1, len(runs)):
                c, e, _ = runs[k]
                if e - (b + n) > 2 * allowed:
                    break
                gap = max(c - (a + n), e - (b + n))
                if c >= a + n and e >= b + n and gap > 0:
                    if c - a == e - b:
                        gap = sum(x != y for x, y in zip(item[a + n : c], doc[b + n : e], strict=True))
                    if gap <= left:
                        far = max(far, reach[k][left - gap])
            reach[i][left] = far
        best = max(best, reach[i][allowed] - a)
    return best if best >= run else 0


_PLACES: dict[str, tuple[list[str], dict[str, list[int]]]] = {}


def _places(passage: str) -> tuple[list[str], dict[str, list[int]]]:
    if passage not in _PLACES:
        if len(_PLACES) > 20_000:
            _PLACES.clear()
        at: dict[str, list[int]] = defaultdict(list)
        w = passage.split()
        for j, s in enumerate(shingles(w)):
            at[s].append(j)
        _PLACES[passage] = w, at
    return _PLACES[passage]


def leaks(documents: DataFrame, items: DataFrame, *, run: int = 25, part: float = 0.1) -> DataFrame:
    """(doc_id, item_id, words): documents that hold ``run`` words running from an item's passage, ``part`` of them changed at most.

    Items that share a passage leak together; a document listed twice has two rows.
    Items shorter than ``run`` words, null and empty texts and empty tables give no rows.
    The documents are read once, whatever the number of items: a bit table of the items' shingles,
    of fixed size, tells which shingles may be theirs, and texts go on only from documents with enough of them in one window.
    Document frequencies give the rarity order; the rarest shingles of each window of a passage are joined with the
    documents' by hash, and pairs that share enough are verified word by word.
    """
    changes = int(run * part)
    overlap = max(1, run - SHINGLE + 1 - SHINGLE * changes)

    def own(item, passage):
        w = words(passage)
        if len(w) >= run:
            yield item, " ".join(w), hashes(w).tolist()

    schema = pa.schema([("item_id", pa.int64()), ("passage", pa.string()), ("shingles", pa.list_(pa.int64()))])
    of_items = cut(passages(items, run=run).select("item_id", "passage").mapInArrow(_mapped(own, schema), "item_id long, passage string, shingles array<long>"), "leak-items")
    groups = of_items.select(F.xxhash64("passage").alias("grp"), "passage", "shingles").dropDuplicates(["grp"])
    table = filter_of(groups.select(F.explode("shingles").alias("shingle")))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    held = cut(texts.mapInArrow(_scan(table, run, changes), "doc_id long, hits array<long>, text string"), "shingle-hits")

    known = groups.select(F.explode("shingles").alias("shingle")).distinct()
    counts = held.select(F.explode("hits").alias("shingle")).join(known, "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
    # as many rows as a passage has shingles are gathered for each
    ranked = groups.select("grp", F.posexplode("shingles").alias("pos", "shingle")).join(counts, "shingle", "left").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "shingle", F.coalesce("n", F.lit(0)).alias("n")))).alias("own"))

    def rarest(grp, each):
        for s in prefixes([x["shingle"] for x in each], {x["shingle"]: x["n"] for x in each}, run, changes):
            yield grp, s

    prefix = ranked.mapInArrow(_mapped(rarest, pa.schema([("grp", pa.int64()), ("shingle", pa.int64())])), "grp long, shingle long")
    likely = held.where(F.col("text").isNotNull())
    pairs = likely.select("doc_id", F.explode("hits").alias("shingle")).join(prefix, "shingle").select("doc_id", "grp").distinct()
    met = pairs.join(likely, "doc_id").join(groups, "grp").where(F.size(F.array_intersect("hits", "shingles")) >= overlap)

    def verify(doc, grp, text, passage):
        item, places = _places(passage)
        n = longest_run(words(text), item, places, run, part)
        if n:
            yield doc, grp, n

    found = met.select("doc_id", "grp", "text", "passage").mapInArrow(_mapped(verify, pa.schema([("doc_id", pa.int64()), ("grp", pa.int64()), ("words", pa.int32())])), "doc_id long, grp long, words int")
    return found.join(of_items.select("item_id", F.xxhash64("passage").alias("grp")), "grp").select("doc_id", "item_id", "words")
