"""Scores of sentences and documents, and small exact statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import text as T

# --- fixed values: two tone lexicons, negators ---
TONE_UP = (
    "success successful succeed strong strength gain gains gained win wins won growth grow growing boom booming innovative innovation brilliant resilient robust opportunity promising impressive sound healthy"
    " confidence confident triumph achievement prudent wise credible stable stability recovery thrive thrives thriving praise remarkable outstanding effective efficient breakthrough vindicated"
).split()
TONE_DOWN = (
    "failure fail fails failed failing weak weakness loss losses lose losing crisis collapse disaster disastrous risk risky danger dangerous threat threaten fraud fraudulent corruption corrupt reckless bubble"
    " crash decline declining worst damage flawed flaw dubious trouble troubled mistake misguided illusion problematic unsustainable doomed panic fear fears scandal chaos broken stagnant stagnation overvalued"
    " delusion folly hubris"
).split()
NEGATORS = ["not", "no", "never", "without", "hardly", "barely", "nor", "n't", "cannot"]
VIEW_UP = (
    "strong success successful wise smart brilliant impressive robust healthy promising credible sound admirable visionary effective prudent resilient genius triumph boom recovery confidence confident optimistic"
    " right correct win gains opportunity attractive undervalued bullish"
).split()
VIEW_DOWN = (
    "weak failure failed wrong mistake reckless dangerous crisis collapse disaster catastrophic catastrophe bubble fraud incompetent folly doomed risky losses decline threat panic misguided flawed overvalued"
    " delusion bearish trouble troubled danger fear broken worthless bust"
).split()
# --- end of fixed values ---


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tone(sentence: str | Column, *, window: int = 3) -> Column:
    """Rising less falling words of a sentence, each turned round by a negator among the ``window`` tokens before it; 0 for null."""
    low = T.tokens(F.lower(F.coalesce(F.col(sentence) if isinstance(sentence, str) else sentence, F.lit(""))), r"[a-z][a-z']*")
    up, down, no = _words(TONE_UP), _words(TONE_DOWN), _words(NEGATORS)

    def score(tokens: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            sign = F.when(F.array_contains(up, x), 1).when(F.array_contains(down, x), -1).otherwise(0)
            before = F.slice(tokens, F.greatest(i - (window - 1), F.lit(1)), F.least(i, F.lit(window)))
            return F.when(sign == 0, 0).when(F.arrays_overlap(before, no), -sign).otherwise(sign)

        return F.aggregate(F.transform(tokens, one), F.lit(0), lambda a, x: a + x)

    return score(low)


def view(sentence: str | Column) -> Column:
    """Approving less alarming words of a sentence, without regard to negation; 0 for null."""
    low = F.transform(T.tokens(sentence), lambda x: F.lower(x))
    up, down = _words(VIEW_UP), _words(VIEW_DOWN)
    return F.size(F.filter(low, lambda x: F.array_contains(up, x))) - F.size(F.filter(low, lambda x: F.array_contains(down, x)))


def quotability(sentence: str | Column) -> Column:
    """How much like a maxim a sentence is: a length near 14 words, absolutes, a definition and a contrast count for it; reporting and digits against it."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    low = F.concat(F.lit(" "), F.lower(s), F.lit(" "))
    score = F.greatest(F.lit(0.0), 1.0 - F.abs(F.size(T.tokens(s)) - 14) / 14.0)
    for m in T.APHORISTIC:
        score = score + low.contains(f" {m} ").cast("double")
    for m in T.ATTRIBUTION:
        score = score - 1.5 * low.contains(f" {m} ").cast("double")
    score = score + F.when(low.contains(" is ") | low.contains(" are "), 0.75).otherwise(0.0)
    score = score + F.when(low.contains(" not ") | low.contains(" but ") | low.contains(" rather than "), 0.5).otherwise(0.0)
    return F.round(score - F.when(s.rlike(r"\d"), 0.75).otherwise(0.0), 4)


def syllables(word: str | Column) -> Column:
    """Vowel groups of a word, less one for a final e that is not "le", at least 1; 0 for an empty word."""
    w = F.lower(F.col(word) if isinstance(word, str) else word)
    silent = (w.endswith("e") & ~w.endswith("le")).cast("int")
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - silent))


def reading_ease(sentences: Column, words: Column, syllable_count: Column) -> Column:
    return F.when((sentences > 0) & (words > 0), F.lit(206.835) - 1.015 * (words / sentences) - 84.6 * (syllable_count / words)).otherwise(0.0)


def grade_level(sentences: Column, words: Column, syllable_count: Column) -> Column:
    return F.when((sentences > 0) & (words > 0), 0.39 * (words / sentences) + 11.8 * (syllable_count / words) - 15.59).otherwise(0.0)


def fog_index(sentences: Column, words: Column, long_words: Column) -> Column:
    return F.when((sentences > 0) & (words > 0), 0.4 * (words / sentences + 100 * long_words / words)).otherwise(0.0)


def nearest_rank(values: str | Column, percent: float) -> Column:
    """The nearest-rank percentile of an array; the rank rounds half to even. Null for an empty array."""
    a = F.sort_array(F.col(values) if isinstance(values, str) else values)
    k = F.greatest(F.lit(0), F.least(F.size(a) - 1, F.bround(F.lit(percent) / 100 * F.size(a), 0).cast("int") - 1))
    return F.when(F.size(a) > 0, F.get(a, k))


def next_power(n: str | Column) -> Column:
    """The smallest power of two that is at least n, and at least 1."""
    c = F.col(n) if isinstance(n, str) else n
    return F.when(c <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(c)))).cast("long")


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial probability of a result at least as uneven; 1 for none."""
    n = wins + losses
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def least_probability(n: int) -> float:
    """The smallest two-sided probability that n decided comparisons can give."""
    return 1.0 if n == 0 else min(1.0, 2 / 2**n)


def decisive_size(alpha: float = 0.05) -> int:
    """The fewest decided comparisons that can reach a level."""
    n = 0
    while least_probability(n) > alpha:
        n += 1
    return n


def direction(current: float | None, previous: float | None, goal: str, target: float | None = None) -> str:
    """"better", "worse" or "flat" of a metric that should be "higher", "lower" or near a target ("toward"); "unknown" without a value, "unscored" without a goal."""
    if goal not in ("higher", "lower", "toward"):
        return "unscored"
    if current is None or previous is None or goal == "toward" and target is None:
        return "unknown"
    gain = {"higher": current - previous, "lower": previous - current}.get(goal)
    if gain is None:
        gain = abs(previous - target) - abs(current - target)
    return "better" if gain > 0 else "worse" if gain < 0 else "flat"
