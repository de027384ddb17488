"""Variant spellings of persons and organisations (4): MinHash banding over padded q-grams, Monge-Elkan verification, star clustering."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.lines import GIVEN
from folioforge.session import cut

Q = 3  # letters of a q-gram
ROWS_OF_BAND = 3
TARGET_SIMILARITY = 0.36  # q-gram Jaccard similarity of two spellings with two typing errors between them
TARGET_RECALL = 0.99

# --- fixed values: nicknames, titles, company forms and words that tell the kind of an organisation ---
NICKNAMES = {
    "al": "alexander", "alex": "alexander", "sandy": "alexander", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "kate": "katherine", "chris": "christopher",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "edward theodore",
    "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "fran": "francesca", "frankie": "francesca", "fred": "frederick", "freddie": "frederick", "greg": "gregory", "hal": "harold henry",
    "harry": "harold henry", "hank": "henry", "jim": "james", "jimmy": "james", "jamie": "james", "jo": "josephine", "josie": "josephine", "joe": "joseph", "kathy": "katherine", "cathy": "catherine", "katie": "katherine", "kit": "katherine",
    "larry": "lawrence", "laurie": "lawrence", "lucy": "lucia", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "mike": "michael", "mick": "michael", "nick": "nicholas", "nicky": "nicholas", "nate": "nathan",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "phil": "philip", "quent": "quentin", "dick": "richard", "rich": "richard", "rick": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert",
    "rob": "robert", "robbie": "robert", "ron": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "susie": "susan", "suzy": "susan", "theo": "theodore", "teddy": "theodore edward", "tom": "thomas", "tommy": "thomas",
    "tim": "timothy", "bert": "umberto", "vic": "victor victoria", "vicky": "victoria", "vickie": "victoria", "tori": "victoria", "vik": "viktor", "vince": "vincent", "walt": "walter", "wendy": "wendell", "bill": "william", "billy": "william",
    "will": "william", "willie": "william", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
TITLES = frozenset("dr prof professor sir mr mrs ms dame lord chair chairman president hon rev the".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md esq mba".split())
FORMS = frozenset("ltd limited inc incorporated plc llc gmbh ag sa hq".split())
KINDS = (
    "bank union exchange authority board bureau corporation company brothers group trust society association institute department holdings works freight management treasury ministry"
    " asset development savings credit commodity stock clearing energy telecom semiconductor pension port reserve statistics mutual assurance national insurance international"
    " economics finance university council agency office fund partners capital securities services systems technologies industries foundation academy commission federation"
).split()
# --- end of fixed values ---
_KINDS = frozenset(KINDS)
_LINKS = frozenset("of and for the de & at in".split())
_POSSESSIVE = re.compile("['’ʼ]s\\b|['’ʼ](?=\\s|$)")
_GIVEN = frozenset("".join(c for c in unicodedata.normalize("NFD", g) if not unicodedata.combining(c)) for g in GIVEN)


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.casefold()) if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken = [False] * m
    one: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                one.append(c)
                break
    k = len(one)
    if not k:
        return 0.0
    two = [b[j] for j in range(m) if taken[j]]
    moved = sum(x != y for x, y in zip(one, two, strict=True)) / 2
    jaro = (k / n + k / m + (k - moved) / k) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with transpositions, or ``most`` + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def abbreviates(short: str, word: str) -> bool:
    """Whether a word is shortened to another: same first letter, the rest in order, at least two letters."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in short)


def kind_word(token: str) -> str | None:
    """The kind word that a token is, shortens or mistypes."""
    if token in _KINDS:
        return token
    if token.endswith("s") and token[:-1] in _KINDS:
        return token[:-1]
    if 2 <= len(token) <= 6:
        for k in _ABBREVIATED.get(token, ()):
            return k
    if len(token) >= 4:
        for k in KINDS:
            if k.startswith(token):
                return k
    if len(token) >= 6:
        for k in KINDS:
            if abs(len(k) - len(token)) <= 1 and edits(token, k, 1) <= 1:
                return k
    return None


# usual shortenings; each is held to its word by the rule in ``abbreviates``
_ABBREVIATED = {
    s: [w] for s, w in (("bk", "bank"), ("dev", "development"), ("mgmt", "management"), ("inst", "institute"), ("bros", "brothers"), ("co", "company"), ("cmdty", "commodity"), ("exch", "exchange"), ("dept", "department"), ("corp", "corporation"), ("hldgs", "holdings"), ("intl", "international"), ("soc", "society"), ("natl", "national"), ("ins", "insurance"), ("assoc", "association"), ("auth", "authority"), ("stats", "statistics"), ("bur", "bureau"), ("grp", "group"), ("stk", "stock"), ("sav", "savings"), ("svgs", "savings"), ("univ", "university"), ("min", "ministry"), ("econ", "economics"), ("fin", "finance"), ("tel", "telecom"), ("cred", "credit"), ("un", "union"), ("tr", "trust"), ("clg", "clearing"), ("bd", "board"), ("res", "reserve"), ("sec", "securities"))
    if abbreviates(s, w)
}


def given_names(token: str) -> list[str]:
    """The given names that a token is, is a nickname of, or mistypes; none when it looks like no given name."""
    if token in NICKNAMES:
        return NICKNAMES[token].split()
    if token in _GIVEN:
        return [token]
    if len(token) >= 4:
        near = [g for g in _GIVEN if abs(len(g) - len(token)) <= 1 and edits(token, g, 1) <= 1]
        near += [f for n, full in NICKNAMES.items() if len(n) >= 4 and edits(token, n, 1) <= 1 for f in full.split()]
        return sorted(set(near))
    return []


Spelling = tuple[str, str, str, str, str, int]  # kind (person or org), core, given names or kind words, initials, raw acronym, whether full


def read_name(text: str | None) -> Spelling | None:
    """The parts of one typed spelling; null, blank and wordless ones give none."""
    if not text:
        return None
    raw = _POSSESSIVE.sub("", re.sub(r"\([^()]*\)", " ", text)).strip()
    if re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)+", raw):
        raw = raw.replace("-", " ")
    flat = fold(raw)
    comma = flat.find(",")
    head = flat[:comma] if comma >= 0 else ""
    tokens = [t for t in re.findall(r"[^\W_]+|&", flat)]
    caps = re.findall(r"[^\W_]+", raw)
    shout = raw.isupper()
    while tokens and tokens[0] in TITLES and len(tokens) > 1:
        tokens.pop(0)
    while len(tokens) > 1 and tokens[-1] in SUFFIXES | FORMS:
        tokens.pop()
    words = [t for t in tokens if t not in _LINKS]
    if not words:
        return None
    if len(words) == 1 and not shout and comma < 0 and kind_word(words[0]) is None:
        return ("person", words[0], "", "", "", 0)
    kinds = [kind_word(t) for t in words]
    known = sum(k is not None for k in kinds)
    if len(words) == 1 and shout and 2 <= len(words[0]) <= 5:
        return ("org", "", "", "", words[0], 0)
    last = caps[-1] if caps else ""
    if known and known < len(words):
        core = "".join(t for t, k in zip(words, kinds, strict=True) if k is None)
        return ("org", core, " ".join(sorted(k for k in kinds if k)), "".join(k[0] for k in kinds if k), "", 1)
    if len(words) == 2 and not shout and comma < 0 and fold(last) == words[1] and last.isupper() and 1 <= len(last) <= 4 and not raw.rstrip().endswith(".") and "." not in raw:
        return ("org", words[0], "", words[1], "", 0)
    if known and known == len(words):
        return ("org", "", " ".join(sorted(k for k in kinds if k)), "", "", 0)
    # a person
    if comma >= 0 and re.findall(r"[^\W_]+", head):
        before = [t for t in re.findall(r"[^\W_]+", head) if t not in TITLES]
        after = [t for t in re.findall(r"[^\W_]+", flat[comma + 1 :]) if t not in SUFFIXES and t not in TITLES]
        if before and after:
            surname, rest = "".join(before) if len(before) < 2 or len(before[0]) > 1 else before[-1], after
            return _person(surname, rest)
        words = before or after or words
    letters = [t for t in words if len(t) > 1]
    if not letters:
        return ("person", "".join(words), "", "", "", 0)
    if len(letters) == 1:
        return _person(letters[0], [t for t in words if len(t) == 1])
    first, final = letters[0], letters[-1]
    if not given_names(first) and given_names(final) and words[0] == first:
        return _person(first, words[1:])
    return _person(final, words[: len(words) - 1 - words[::-1].index(final)])


def _person(surname: str, rest: list[str]) -> Spelling:
    given = next((t for t in rest if len(t) > 1), "")
    initials = "".join(t[0] for t in rest if len(t) == 1)
    options = given_names(given) if given else []
    if given and given not in NICKNAMES and given not in options:
        options = sorted([*options, given])
    return ("person", surname, " ".join(options), initials, "", int(bool(given)))


def fuller(name: str | None, ident: str | None) -> Spelling | None:
    """The more telling of the spellings in ``name`` and in ``id`` (behind its type)."""
    other = ident.split(":", 1)[1] if ident and ":" in ident else ident
    both = [s for s in (read_name(name), read_name(other)) if s]
    if not both:
        return None
    return max(both, key=lambda s: (s[5], len(s[2]) > 0, len(s[3]), bool(s[1]), -len(s[2].split()) if s[0] == "person" else 0))


def monge_elkan(a: list[str], b: list[str], same) -> float:
    """Mean over the tokens of the shorter list of the best similarity to a token of the other."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(max(same(x, y) for y in b) for x in a) / len(a)


@functools.lru_cache(maxsize=200_000)
def _token(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if abbreviates(x, y) or abbreviates(y, x):
        return 0.95
    if len(x) == 1 or len(y) == 1:
        return 0.95 if x[0] == y[0] else 0.0
    s = jaro_winkler(x, y)
    return s if s >= 0.85 else 0.0


def agree(a: Spelling, b: Spelling) -> float:
    """Similarity of two spellings, 0 when they cannot mean the same; cores are compared before (``near``)."""
    if a[0] != b[0]:
        return 0.0
    if a[0] == "org":
        if a[2] and b[2]:
            s = min(monge_elkan(a[2].split(), b[2].split(), _token), len(set(a[2].split()) & set(b[2].split())) / max(1, min(len(a[2].split()), len(b[2].split()))) + 0.5)
            return s if s >= 0.9 and abs(len(a[2].split()) - len(b[2].split())) <= 1 else 0.0
        one, two = (a, b) if a[2] else (b, a)
        if one[2] and two[3]:
            return 0.95 if sorted(one[3]) == sorted(two[3]) else 0.0
        return 0.95 if a[3] == b[3] else 0.0
    if a[2] and b[2]:
        if set(a[2].split()) & set(b[2].split()):
            middle = [s[3] for s in (a, b) if s[3]]
            return 0.85 if len(middle) == 2 and middle[0] != middle[1] else 1.0
        if _GIVEN.issuperset(a[2].split()) and _GIVEN.issuperset(b[2].split()):
            return 0.0  # two known names
        s = max(monge_elkan([x], b[2].split(), _token) for x in a[2].split())
        return s if s >= 0.9 else 0.0
    if a[2] or b[2]:
        full, short = (a, b) if a[2] else (b, a)
        if not short[3]:
            return 0.9
        first = {g[0] for g in full[2].split()}
        if short[3][0] not in first:
            return 0.0
        if len(short[3]) > 1 and full[3]:
            return 0.97 if short[3][1:] == full[3] else 0.0
        return 0.95
    if not a[3] or not b[3]:
        return 0.9 if a[3] == b[3] else 0.5
    return 0.95 if a[3][0] == b[3][0] and (len(a[3]) == 1 or len(b[3]) == 1 or a[3] == b[3]) else 0.0


def near(a: str, b: str) -> bool:
    """Whether two cores may be the same word typed twice: two edits at most, one in short words, and a high Jaro-Winkler similarity."""
    if a == b:
        return True
    most = 1 if min(len(a), len(b)) < 7 else 2 if min(len(a), len(b)) < 12 else 3
    return edits(a, b, most) <= most and jaro_winkler(a, b) >= 0.86


def bands(similarity: float = TARGET_SIMILARITY, recall: float = TARGET_RECALL, rows: int = ROWS_OF_BAND) -> int:
    """Bands for which the collision curve 1 - (1 - s^rows)^bands gives the recall at a similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


_SEEDS = np.random.default_rng(7).integers(1, 2**61 - 1, size=(2, 1024), dtype=np.uint64) | np.uint64(1)


def signature(core: str, size: int) -> np.ndarray:
    """MinHash values of the padded q-grams of a core."""
    padded = "#" * (Q - 1) + core + "#" * (Q - 1)
    grams = np.array([xxhash.xxh64_intdigest(padded[i : i + Q]) for i in range(len(padded) - Q + 1)], dtype=np.uint64)
    mixed = (grams[:, None] * _SEEDS[0, :size][None, :]) ^ (_SEEDS[1, :size][None, :] + (grams[:, None] >> np.uint64(29)))
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = bands()
    for batch in batches:
        kinds, cores, keys = [], [], []
        for kind, core in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sig = signature(core, n * ROWS_OF_BAND)
            for b in range(n):
                kinds.append(kind)
                cores.append(core)
                keys.append(xxhash.xxh64_intdigest(b.to_bytes(4, "big") + sig[b * ROWS_OF_BAND : (b + 1) * ROWS_OF_BAND].tobytes()) - (1 << 63))
        yield pa.RecordBatch.from_pydict({"kind": kinds, "core": cores, "key": keys}, schema=pa.schema([("kind", pa.string()), ("core", pa.string()), ("key", pa.int64())]))


_SPELLING = "kind string, core string, words string, initials string, acronym string, full int"


def spellings(stance: DataFrame) -> DataFrame:
    """(stance_no, surface, parts of the fuller spelling) of each row; rows without a usable name or id have none."""
    schema = pa.schema([("stance_no", pa.int64()), ("surface", pa.string()), ("kind", pa.string()), ("core", pa.string()), ("words", pa.string()), ("initials", pa.string()), ("acronym", pa.string()), ("full", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for no, name, ident in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = fuller(name, ident)
                if s:
                    out.append((no, "|".join(map(str, s)), *s))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return stance.select("stance_no", "name", "id").mapInArrow(run, f"stance_no long, surface string, {_SPELLING}")


def near_cores(surfaces: DataFrame) -> DataFrame:
    """(kind, a, b): pairs of different cores that share a band and are near, both ways, and each core with itself."""
    cores = surfaces.where("core <> ''").select("kind", "core").distinct()
    banded = cut(cores.mapInArrow(_band_rows, "kind string, core string, key long"), "name-bands")
    met = banded.alias("x").join(banded.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.core") < F.col("y.core"))).select("x.kind", F.col("x.core").alias("a"), F.col("y.core").alias("b")).distinct()
    # a swap of letters is two plain edits, so no near pair has more than twice its edits; the JVM drops the others
    shorter = F.least(F.length("a"), F.length("b"))
    most = F.when(shorter < 7, 1).when(shorter < 12, 2).otherwise(3)
    met = met.where(F.levenshtein("a", "b", 6).between(0, 2 * most))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield batch.filter(pa.array([near(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    pairs = met.mapInArrow(verify, "kind string, a string, b string")
    return pairs.unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cores.select("kind", F.col("core").alias("a"), F.col("core").alias("b")))


def _blocks() -> Column:
    """Keys of which two spellings of one core that agree share one: first letters and endings of given names, an initial, kind words or their letters."""
    words = F.filter(F.split("words", " "), lambda w: w != "")
    letters = F.array_union(F.transform(words, lambda w: F.substring(w, 1, 1)), F.transform(words, lambda w: F.concat(F.lit("~"), F.right(w, F.lit(2)))))
    initial = F.when(F.col("initials") != "", F.array(F.substring("initials", 1, 1))).otherwise(F.array().cast("array<string>"))
    sorted_letters = F.concat(F.lit("#"), F.array_join(F.array_sort(F.split("initials", "")), ""))
    person = F.when(F.size(words) > 0, letters).otherwise(initial)
    return F.when(F.col("kind") == "person", person).otherwise(F.array_union(words, F.array(sorted_letters)))


def links(surfaces: DataFrame) -> DataFrame:
    """(a, b, fa, fb, score): pairs of different surfaces with the same or near cores that Monge-Elkan verifies, a < b; fa and fb tell whether they are full.

    Within a core only spellings that share a block are paired, each pair in its smallest block,
    so that a surname borne by a third of all rows falls apart by given names. A
    surname alone is one spelling and meets all of its core.
    """
    some = cut(surfaces.where("core <> ''").withColumn("blocks", _blocks()), "name-surfaces")
    cores = cut(near_cores(surfaces), "name-cores")
    left = some.select(*(F.col(c).alias(f"l_{c}") for c in some.columns))
    right = some.select(*(F.col(c).alias(f"r_{c}") for c in some.columns))
    near = left.join(cores, (F.col("l_kind") == F.col("kind")) & (F.col("l_core") == F.col("a"))).drop("kind", "a")
    blocked = near.withColumn("block", F.explode("l_blocks")).join(right.withColumn("r_block", F.explode("r_blocks")), (F.col("r_kind") == F.col("l_kind")) & (F.col("r_core") == F.col("b")) & (F.col("block") == F.col("r_block")))
    blocked = blocked.where((F.col("l_surface") < F.col("r_surface")) & (F.array_min(F.array_intersect("l_blocks", "r_blocks")) == F.col("block"))).drop("block", "r_block")
    alone = (F.size("l_blocks") == 0) != (F.size("r_blocks") == 0)
    bare = near.where(F.size("l_blocks") == 0).join(right, (F.col("r_kind") == F.col("l_kind")) & (F.col("r_core") == F.col("b"))).where(alone)
    both = [c for c in blocked.columns if c != "b"]
    turned = [F.col(("r_" if c[0] == "l" else "l_") + c[2:]).alias(c) for c in both]
    met = blocked.select(*both).unionByName(bare.where("l_surface < r_surface").select(*both)).unionByName(bare.where("l_surface > r_surface").select(*turned))
    parts = ["surface", "kind", "core", "words", "initials", "acronym", "full"]
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("fa", pa.int32()), ("fb", pa.int32()), ("score", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = row[:7], row[7:]
                s = agree(one[1:], two[1:]) + (0.01 if one[2] == two[2] else 0.0)
                if s > 0.6:
                    out.append((one[0], two[0], one[6], two[6], s))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return met.select(*(f"l_{c}" for c in parts), *(f"r_{c}" for c in parts)).mapInArrow(verify, "a string, b string, fa int, fb int, score double")


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, center): star clustering of undirected edges (a, b).

    In each round every open node that outranks all its open neighbours, by open degree and
    then by a hash of its name, is a centre and takes its open neighbours; a node beside two
    centres goes to the higher. Rounds end when no edge joins open nodes; hashes keep
    them to about the logarithm of a chain's length.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "star-edges")
    done, left = None, both
    while True:
        degree = left.groupBy("a").agg(F.count("*").alias("d"))
        ranked = left.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
        one, two = F.struct("d", F.xxhash64("a"), "a"), F.struct(F.col("e").alias("d"), F.xxhash64("b"), F.col("b").alias("a"))
        beaten = ranked.groupBy("a").agg(F.bool_or(two > one).alias("beaten"), F.first("d").alias("d"))
        centers = beaten.where(~F.col("beaten")).select(F.col("a").alias("center"), "d")
        taken = left.join(centers, left.b == centers.center).groupBy(F.col("a").alias("node")).agg(F.max_by("center", F.struct("d", F.xxhash64("center"), "center")).alias("center"))
        new = cut(taken.join(centers.select(F.col("center").alias("node")), "node", "left_anti").unionByName(centers.select(F.col("center").alias("node"), "center")), "star-round")
        done = new if done is None else done.unionByName(new)
        gone = new.select("node")
        left = cut(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "star-left")
        if left.isEmpty():
            break
    rest = nodes.join(done.select("node"), "node", "left_anti").select("node", F.col("node").alias("center"))
    return done.unionByName(rest)


def entities(stance: DataFrame) -> DataFrame:
    """(stance_no, entity): rows whose names mean the same person or organisation bear the same entity.

    Full spellings are clustered by stars. A spelling with initials, a surname
    or letters for the kind alone joins a cluster when it agrees best with one only (the same core
    and the same middle initial come first); else such
    spellings are clustered among themselves when they agree with none, and stand
    alone when they agree with several. Rows without a name and an id are left out.
    """
    rows = cut(spellings(stance), "spellings")
    surfaces = rows.select("surface", "kind", "core", "words", "initials", "acronym", "full").distinct()
    met = cut(links(surfaces), "name-links")
    full = surfaces.where("full = 1").select(F.col("surface").alias("node"))
    clusters = cut(stars(full, met.where("fa = 1 and fb = 1 and score >= 0.9")), "name-stars")
    half = met.where("fa <> fb and score >= 0.9").select(F.when(F.col("fa") == 0, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.col("fa") == 0, F.col("b")).otherwise(F.col("a")).alias("node"), "score")
    best = half.groupBy("short").agg(F.max("score").alias("score"))
    choice = cut(half.join(best, ["short", "score"]).join(clusters, "node").groupBy("short").agg(F.count_distinct("center").alias("n"), F.min("center").alias("center")), "name-choice")
    joined = choice.where("n = 1").select(F.col("short").alias("node"), "center")
    lone = surfaces.where("full = 0").select(F.col("surface").alias("node")).join(choice.select(F.col("short").alias("node")), "node", "left_anti")
    among = met.where("fa = 0 and fb = 0 and score >= 0.9").join(lone.select(F.col("node").alias("a")), "a", "left_semi").join(lone.select(F.col("node").alias("b")), "b", "left_semi")
    apart = choice.where("n > 1").select(F.col("short").alias("node"), F.col("short").alias("center"))
    final = clusters.unionByName(joined).unionByName(stars(lone, among)).unionByName(apart)
    return rows.join(final, rows.surface == final.node).select("stance_no", F.col("center").alias("entity"))


def same_entity(stance: DataFrame) -> DataFrame:
    """(stance_no_a, stance_no_b): every pair of different rows that mean the same entity, smaller number first."""
    named = cut(entities(stance), "entities")
    other = named.select(F.col("stance_no").alias("stance_no_b"), "entity")
    return named.withColumnRenamed("stance_no", "stance_no_a").join(other, "entity").where("stance_no_a < stance_no_b").select("stance_no_a", "stance_no_b")
