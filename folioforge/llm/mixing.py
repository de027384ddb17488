"""A training mix by target shares (8): hierarchical budgets over domain, language and source, filled from seeded epochs."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096  # parts of a source's order; running sums are taken over buckets first, then within the one bucket the budget ends in
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE encoding of a file of ranks, read once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(documents: DataFrame, *, key: str = "doc_id", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, kept columns, tokens): tokens of each whole text; 0 for null and empty."""
    schema_of = documents.select(key, *keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            tokens = pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], names=[*batch.schema.names[:-1], "tokens"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of.fields) + ", tokens long"
    return documents.select(key, *keep, "text").mapInArrow(run, ddl)


@dataclass
class Leaf:
    """A source in the tree: the tokens it has, how often it may be used, and its wanted share."""

    source: str
    domain: str
    lang: str
    share: float
    repeats: int
    tokens: int = 0

    @property
    def room(self) -> float:
        return float(self.tokens) * max(0, self.repeats)


def domain_of(source: str) -> str:
    """The domain of a source by its name: "site" for a host, the part before a colon, else "own"."""
    return source.split(":", 1)[0] if ":" in source else "site" if "." in source else "own"


def spread(leaves: list[Leaf], total: float) -> dict[str, float]:
    """Tokens for each source: its share of the total, and what it cannot give spread over others by their shares.

    Shortages go to siblings of the same domain and language first, then to the
    domain, then to all; what nobody has room for is left out.
    """
    got = {x.source: min(x.share * total, x.room) for x in leaves}
    short = {x.source: x.share * total - got[x.source] for x in leaves}
    for of in (lambda x: (x.domain, x.lang), lambda x: x.domain, lambda x: None):
        groups: dict[object, list[Leaf]] = {}
        for x in leaves:
            groups.setdefault(of(x), []).append(x)
        for own in groups.values():
            need = sum(short[x.source] for x in own)
            while need > 1e-9 * max(total, 1.0):
                open_ = [x for x in own if x.room - got[x.source] > 1e-9 * max(total, 1.0) and x.share > 0]
                weight = sum(x.share for x in open_)
                if not open_ or weight <= 0:
                    break
                given = {x.source: min(need * x.share / weight, x.room - got[x.source]) for x in open_}
                for s, v in given.items():
                    got[s] += v
                need -= sum(given.values())
            had = sum(short[x.source] for x in own)
            for x in own:
                short[x.source] = short[x.source] * need / had if had else 0.0
    return got


def largest_total(leaves: list[Leaf]) -> float:
    """The largest total at which only sources that have nothing at all are short: every other can give its share, with what falls to it from those."""
    if not any(x.room > 0 for x in leaves):
        return 0.0
    boundless = [Leaf(x.source, x.domain, x.lang, x.share, 1, 10**18 if x.room > 0 else 0) for x in leaves]
    shares = spread(boundless, 1.0)
    return min(x.room / shares[x.source] for x in leaves if x.room > 0 and shares[x.source] > 0)


def _normal(c: str):
    return F.lower(F.trim(F.col(c)))


def plan(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[Leaf], dict[str, float]]:
    """(documents of target sources with their tokens, the tree's leaves, tokens for each source).

    Sources are the same when they differ in case and outer spaces only. The leaves are as many as
    the targets. A source named twice takes the sum of its shares and the smaller cap.
    """
    wanted = targets.where(F.col("source").isNotNull()).select(_normal("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"))
    own = documents.select("doc_id", _normal("source").alias("source"), F.lower(F.trim(F.coalesce("lang", F.lit("und")))).alias("lang"), "text").join(F.broadcast(wanted.select("source")), "source", "left_semi")
    counted = cut(count_tokens(own, keep=("source", "lang"), tokenizer=tokenizer), "tokens")
    by_lang = counted.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    has = {r.source: r for r in by_lang.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max_by("lang", F.struct((F.col("lang") != "und").cast("int"), "n", "lang")).alias("lang")).collect()}
    leaves = [Leaf(r.source, domain_of(r.source), has[r.source].lang if r.source in has else "und", max(0.0, r.share), r.repeats, int(has[r.source].tokens) if r.source in has else 0) for r in wanted.orderBy("source").collect()]
    total = largest_total(leaves) if total_tokens is None else float(total_tokens)
    return counted, leaves, spread(leaves, total)


def mix(documents: DataFrame, targets: DataFrame, *, seed: int = 17, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, uses): the documents of the mix and how often each is used.

    Each source gives whole epochs of all its documents and then, in the seeded order
    of the next epoch, documents up to its budget: the last is taken when more than half
    of it fits. Without a total the mix is the largest in which every source that has
    documents reaches its share. Documents without tokens, without a target or with a null
    source are not used.
    """
    counted, leaves, budget = plan(documents, targets, total_tokens=total_tokens, tokenizer=tokenizer)
    spark = documents.sparkSession
    rows = []
    for x in leaves:
        if x.tokens > 0 and budget[x.source] > 0:
            epochs = min(int(budget[x.source] // x.tokens), x.repeats)
            rows.append((x.source, epochs, float(budget[x.source] - epochs * x.tokens) if epochs < x.repeats else 0.0))
    wanted = F.broadcast(spark.createDataFrame(rows, "source string, epochs int, rest double"))
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    own = counted.where("tokens > 0").join(wanted, "source").withColumn("place", order).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)))
    sums = own.groupBy("source", "bucket").agg(F.sum("tokens").alias("held"))
    before = sums.selectExpr("source", "bucket", "held", "sum(held) over (partition by source order by bucket) - held as before")
    placed = own.join(before, ["source", "bucket"])
    inside = placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest")))
    edge = inside.selectExpr("doc_id", "source", "sum(tokens) over (partition by source order by place, doc_id) - tokens / 2.0 + before <= rest as more")
    chosen = placed.join(edge.select("doc_id", "source", "more"), ["doc_id", "source"], "left")
    uses = F.col("epochs") + F.when(F.col("before") + F.col("held") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(F.coalesce("more", F.lit(False)).cast("int"))
    return chosen.select("doc_id", "source", "tokens", uses.cast("int").alias("uses")).where("uses > 0")


def shares(documents: DataFrame, targets: DataFrame, *, seed: int = 17, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, reached_share, tokens, docs, most_uses): what each target source gives to the mix beside what was wanted."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy(_normal("source").alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    used = mix(documents, targets, seed=seed, total_tokens=total_tokens, tokenizer=tokenizer).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
    all_ = used.agg(F.sum("tokens").alias("total"))
    joined = wanted.join(used, "source", "left").join(F.broadcast(all_))
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
