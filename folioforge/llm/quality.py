"""Per-document text statistics and a learned verdict on natural prose (9): an ordered rule list, exported to SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut

# --- fixed values: common words of English, German, French and Spanish ---
COMMON = (
    "the of and a to in is that it was for on as with by at from but be not an had has have or its this which who what i we they he she there into than so if when while neither nor most every one"
    " der die das und nicht ist den von zu mit auf für im dem es ein eine sei als le la les de des et un une est que dans pour sur du en au pas plus par el los las del y se con su para al lo como más pero"
).split()
# --- end of fixed values ---


def any_of(words: list[str]) -> str:
    """A pattern for any of many words, as a tree of their beginnings, so that a matcher decides by few letters."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def part(at: dict) -> str:
        ends = "" in at
        ways = [c + part(at[c]) for c in sorted(at) if c]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})"
        return inner + "?" if ends else inner

    return part(tree)


_COMMON = rf"\b{any_of(COMMON)}\b"
_WORD = r"\p{L}[\p{L}'’-]*"
_END = r"[.!?…][\"'”’»)\]]*$"
_MARKER = r"^(?:[-*•–—+·▪>o#]+|\(?\d{1,3}[.)\]]|\(?[A-Za-z][.)]|\[[ xX]\])\s"
_TABULAR = r"\t|\|.*\||\.{4,}|\S {3,}\S"
_NUMBER = r"(?<!\S)[-+(]?[$€£]?\d[\d.,%:/)-]*(?!\S)"

FEATURES = ["words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "ends_share", "common_share", "prose_share", "marked_share", "tabular_share", "line_words", "distinct_share", "sentence_share", "familiar_share", "titled_share", "long_share", "number_share"]
Rule = list[tuple[str, str, float]]
#: Used where nothing can be learned: no labelled documents, or all of one kind.
DEFAULT_RULES: list[Rule] = [[("prose_share", "<", 0.5)]]


def statistics(documents: DataFrame, *, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, FEATURES) of each text, made of built-in expressions over the whole text and over its lines.

    words: runs of letters; mean_word: characters between spaces, on average; symbol_ratio, digit_ratio and
    upper_ratio: shares of characters; ends_share: lines that end like sentences;
    common_share: words that are common in four languages; prose_share, marked_share and
    tabular_share: shares of characters in lines that read like prose, bear a list mark, or
    are split in columns; line_words: words a line; distinct_share: different words of all; sentence_share, familiar_share, titled_share,
    long_share and number_share: shares of characters in lines that end like sentences, have many common words, many capitalised words, eight words or more, or many numbers.
    Null and blank texts have null statistics.
    """
    count = lambda c, p: F.regexp_count(c, F.lit(p))

    def line(x: Column) -> Column:
        return F.struct(
            F.length(x).alias("n"),
            count(x, _WORD).alias("w"),
            count(F.lower(x), _COMMON).alias("c"),
            count(x, r"(?<![\p{L}\p{N}'’-])\p{Lu}\p{Ll}").alias("t"),
            count(x, _NUMBER).alias("d"),
            x.rlike(_END).alias("ends"),
            x.rlike(_MARKER).alias("mark"),
            x.rlike(_TABULAR).alias("tab"),
        )

    def total(f) -> Column:
        return F.aggregate("rows", F.lit(0), lambda a, r: a + f(r))

    def prose(r: Column) -> Column:
        common = r["c"] * 5 >= r["w"]
        plain = ~r["tab"] & (r["d"] * 3 < r["w"])
        listed = r["mark"] & ~(r["ends"] & (r["w"] >= 8))
        titled = (r["t"] * 2 >= r["w"]) & ~r["ends"]
        return common & plain & ~listed & ~titled & ((r["w"] >= 5) | r["ends"] & (r["w"] >= 1))

    text = F.col("text")
    n = F.length(F.regexp_replace(text, r"\s+", ""))
    used = documents.select(key, *keep, "text").withColumn("filled", F.when(text.rlike(r"\S"), text))
    lines = F.transform(F.filter(F.split("filled", "\n"), lambda x: F.trim(x) != ""), lambda x: line(F.trim(x)))
    tokens = F.split(F.lower(F.trim("filled")), r"\s+")
    base = used.select(key, *keep, "filled", lines.alias("rows"), n.alias("n"), tokens.alias("tokens"))
    share = lambda c: F.try_divide(c.cast("double"), total(lambda r: r["n"]))
    size = F.size("rows")
    words = total(lambda r: r["w"])
    of = lambda p: F.try_divide(F.length(F.regexp_replace("filled", p, "")).cast("double"), F.col("n"))
    has = F.col("filled").isNotNull()
    return base.select(
        key,
        *keep,
        F.when(has, words).alias("words"),
        F.try_divide(F.col("n").cast("double"), F.size("tokens")).alias("mean_word"),
        of(r"[\p{L}\p{N}\s.,;:!?'’\"“”()-]+").alias("symbol_ratio"),
        of(r"[^\p{N}]+").alias("digit_ratio"),
        of(r"[^\p{Lu}]+").alias("upper_ratio"),
        F.try_divide(total(lambda r: r["ends"].cast("int")).cast("double"), size).alias("ends_share"),
        F.coalesce(F.try_divide(total(lambda r: r["c"]).cast("double"), words), F.when(has, 0.0)).alias("common_share"),
        share(total(lambda r: F.when(prose(r), r["n"]).otherwise(0))).alias("prose_share"),
        share(total(lambda r: F.when(r["mark"], r["n"]).otherwise(0))).alias("marked_share"),
        share(total(lambda r: F.when(r["tab"], r["n"]).otherwise(0))).alias("tabular_share"),
        F.try_divide(words.cast("double"), size).alias("line_words"),
        F.when(has, F.size(F.array_distinct("tokens")) / F.size("tokens")).alias("distinct_share"),
        share(total(lambda r: F.when(r["ends"] & (r["w"] >= 5), r["n"]).otherwise(0))).alias("sentence_share"),
        share(total(lambda r: F.when(r["c"] * 5 >= r["w"], r["n"]).otherwise(0))).alias("familiar_share"),
        share(total(lambda r: F.when(r["t"] * 2 >= r["w"], r["n"]).otherwise(0))).alias("titled_share"),
        share(total(lambda r: F.when(r["w"] >= 8, r["n"]).otherwise(0))).alias("long_share"),
        share(total(lambda r: F.when(r["d"] * 3 >= r["w"], r["n"]).otherwise(0))).alias("number_share"),
    )


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for j, op, v in rule:
        ok &= x[:, j] < v if op == "<" else x[:, j] >= v
    return ok


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[int, str, float]]:
    """A rule grown by the condition of the largest FOIL gain at a time, until it covers no negatives."""
    rule: list[tuple[int, str, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most:
        p0, n0 = int((inside & y).sum()), int((inside & ~y).sum())
        if not p0 or not n0:
            break
        best, choice = 1e-9, None
        for j, values in enumerate(cuts):
            column = x[:, j]
            for v in values:
                for op, ok in (("<", column < v), (">=", column >= v)):
                    hit = inside & ok
                    p, n = int((hit & y).sum()), int((hit & ~y).sum())
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, choice = gain, (j, op, float(v))
        if choice is None:
            break
        rule.append(choice)
        inside &= _covers(x, [choice])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, rule: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """The shortest beginning of a rule with the best (p - n) / (p + n) on held-back rows."""
    def worth(r: list[tuple[int, str, float]]) -> float:
        hit = _covers(x, r)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_rules(x: np.ndarray, y: np.ndarray, order: np.ndarray, *, features: list[str] = FEATURES, most_rules: int = 8, most_conditions: int = 4, cuts: int = 40) -> list[Rule]:
    """An ordered rule list for the positive class by incremental reduced-error pruning.

    Each rule is grown on two thirds of the rows left and pruned on the other third; rows it
    covers are taken away. Learning ends when a pruned rule is wrong on half of the
    held-back rows it covers, or covers none of them. ``order`` decides the thirds, so that the same labels give the same rules.
    """
    quantiles = np.linspace(0, 1, cuts + 1)[1:-1]
    left = np.arange(len(y))
    rules: list[Rule] = []
    while len(rules) < most_rules and y[left].any():
        third = (order[left] + len(rules)) % 3 == 0
        grow, hold = left[~third], left[third]
        if not y[grow].any() or not len(hold):
            break
        values = [np.unique(np.concatenate([np.quantile(x[grow, j], quantiles), np.quantile(x[grow][y[grow]][:, j], quantiles)])) for j in range(x.shape[1])]
        rule = _grow(x[grow], y[grow], values, most_conditions)
        if not rule:
            break
        rule = _prune(x[hold], y[hold], rule)
        hit = _covers(x[hold], rule)
        p, n = int((hit & y[hold]).sum()), int((hit & ~y[hold]).sum())
        if p <= n:
            break
        rules.append([(features[j], op, v) for j, op, v in rule])
        left = left[~_covers(x[left], rule)]
    return rules


def rules_sql(rules: list[Rule], positive: str = "other", default: str = "prose") -> str:
    """The rule list as a SQL CASE expression over the statistics."""
    whens = " ".join(f"WHEN {' AND '.join(f'{f} {op} {v!r}D' for f, op, v in r)} THEN '{positive}'" for r in rules)
    return f"CASE {whens} ELSE '{default}' END" if rules else f"'{default}'"


def fit(documents: DataFrame, labels: DataFrame, *, most_labels: int = 20_000) -> list[Rule]:
    """Rules learned from raters' labels of at most ``most_labels`` documents, those of the smallest hashes of their numbers.

    A document's label is that of most of its raters; without a majority, without a
    label or without text it is not used. At every number of labels rules are learned, and kept when
    in threefold cross-validation they are wrong no more often than the default rules, as a few labels teach chance.
    """
    voted = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.avg((F.lower(F.trim("label")) != "prose").cast("double")).alias("other")).where("other <> 0.5")
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    # written before it is filtered: a filter on the statistics would be pushed below them and work them out again
    rows = cut(statistics(documents.join(F.broadcast(chosen), "doc_id"), keep=("other",)), "label-statistics").where("words is not null").toPandas().sort_values(["doc_id", *FEATURES])
    if rows.other.gt(0.5).nunique() < 2:
        return DEFAULT_RULES
    x = rows[FEATURES].to_numpy(dtype=float)
    y = rows.other.to_numpy() > 0.5
    order = np.random.default_rng(11).permutation(len(y))
    wrong = 0
    for k in range(3):
        out = order % 3 == k
        rules = learn_rules(x[~out], y[~out], order[~out])
        wrong += int((_hits(x[out], rules) != y[out]).sum())
    rules = learn_rules(x, y, order)
    return rules if rules and wrong <= int((_hits(x, DEFAULT_RULES) != y).sum()) else DEFAULT_RULES


def _hits(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    hit = np.zeros(len(x), dtype=bool)
    for r in rules:
        hit |= _covers(x, [(FEATURES.index(f), op, v) for f, op, v in r])
    return hit


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, FEATURES, verdict): statistics of each document and whether it is natural "prose" or "other"; null for null and blank texts."""
    return _judged(documents, labels, FEATURES)


def _judged(documents: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    rules = fit(documents, labels)
    used = list(dict.fromkeys(["words", *features, *(f for r in rules for f, _, _ in r)]))
    stats = cut(statistics(documents).select("doc_id", *used), "statistics")
    return stats.withColumn("verdict", F.when(F.col("words").isNotNull(), F.expr(rules_sql(rules))))


def not_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of documents of which more than half is no natural prose; null and blank texts are no cases."""
    return _judged(documents, labels, []).where("verdict = 'other'").select("doc_id")
