import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import names as N

SCHEMA = "stance_no long, id string, name string, entity string, core string"


def test_forms_of_one_name_read_alike():
    base = N.read_name("William Thornburyson")[:3]
    for form in ("Thornburyson, William", "Bill Thornburyson", "WILLIAM THORNBURYSON", "Sir William Thornburyson", "William Thornburyson, PhD", "William Thornburyson’s", "william-thornburyson"):
        assert N.read_name(form)[:3] == base, form
    bank = N.read_name("Galmora Development Bank")
    for form in ("Development Bank of Galmora", "Galmora Dev. Bk", "the Galmora Development Bank Ltd", "galmora-development-bank", "Development Bank, Galmora"):
        assert N.read_name(form)[:3] == bank[:3], form
    assert N.read_name(None) is N.read_name("") is N.read_name(" ,. ") is None


def test_link_and_keep_apart(spark):
    rows = [
        (1, "person:William Thornburyson", "William Thornburyson"), (2, "person:Bill Thornburyson", "Bill Thornburyson"), (3, "person:William Thornbruyson", "Thornbruyson, William"), (4, "person:Edward Thornburyson", "Edward Thornburyson"),
        (5, "org:Galmora Development Bank", "GDB"), (6, "org:Galmora Dev. Bk", None), (7, "org:Galmora Savings Bank", "Galmora Savings Bank"), (8, "person:William Thornburyson", "William Thornburyson"), (9, None, None), (10, "person:T. Quillfeather", "T. Quillfeather"),
        (11, "person:Theodore Quillfeather", "Theodore Quillfeather"), (12, "org:Galmora DB", "Galmora DB"),
    ]
    df = spark.createDataFrame([(*r, "e", "c") for r in rows], SCHEMA)
    found = {(r.stance_no_a, r.stance_no_b) for r in N.same_entity(df).collect()}
    groups = [{1, 2, 3, 8}, {5, 6, 12}, {10, 11}]
    assert found == {p for g in groups for p in itertools.combinations(sorted(g), 2)}


def test_ambiguous_initials_stand_alone(spark):
    rows = [(1, "person:Edward Quillfeather", "Edward Quillfeather"), (2, "person:Elizabeth Quillfeather", "Elizabeth Quillfeather"), (3, "person:E. Quillfeather", "E. Quillfeather")]
    assert N.same_entity(spark.createDataFrame([(*r, "e", "c") for r in rows], SCHEMA)).count() == 0


def test_empty_table(spark):
    assert N.same_entity(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collision_curve_meets_its_recall():
    n = N.bands()
    assert 1 - (1 - N.TARGET_SIMILARITY**N.ROWS_OF_BAND) ** n >= N.TARGET_RECALL
    one, two = N.signature("thornburyson", n * 3).reshape(n, 3), N.signature("thornbruyson", n * 3).reshape(n, 3)
    assert (one == two).all(axis=1).any()
    assert np.array_equal(N.signature("x", 6), N.signature("x", 6))


def brute(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_edits_like_brute_force(a, b):
    assert min(N.edits(a, b, 3), 4) == min(brute(a, b), 4)


def test_stars(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "e")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    got = {r.node: r.center for r in N.stars(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}


def test_a_long_chain_of_links_is_settled(spark):
    nodes = [f"n{i:03d}" for i in range(61)]
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a string, b string")
    got = {r.node: r.center for r in N.stars(spark.createDataFrame([(x,) for x in nodes], "node string"), edges).collect()}
    assert set(got) == set(nodes)
    place = {x: i for i, x in enumerate(nodes)}
    assert all(abs(place[x] - place[c]) <= 1 for x, c in got.items())
    # no two centres are neighbours, and a node alone has no centre beside it
    centers = {place[c] for c in got.values()}
    assert all(i + 1 not in centers for i in centers)
    assert 61 / 3 <= len(centers) <= 31


def test_banding_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abdefgiklmnorstuvz"))
    cores = {"".join(rng.choice(letters, rng.integers(7, 13))) for _ in range(150)}
    for c in list(cores):
        i = int(rng.integers(1, len(c) - 1))
        cores |= {c[:i] + c[i + 1] + c[i] + c[i + 2 :], c[:i] + str(rng.choice(letters)) + c[i + 1 :], c[:i] + c[i + 1 :]}
    table = spark.createDataFrame([("person", c) for c in cores], "kind string, core string")
    found = {(r.a, r.b) for r in N.near_cores(table).collect()}
    true = {(a, b) for a in cores for b in cores if N.near(a, b)}
    assert len(found & true) / len(true) >= 0.95 and found <= true


def test_blocks_lose_no_link(spark):
    given = ["William", "Bill", "Wiliam", "W.", "Edward", "Ted", "Theodore", "T.", "", "Elizabeth", "Liz", "Lizbeth", "William J.", "W. J.", "Okafor", "kOafor", "Okafer"]
    names = [f"{g} Thornburyson".strip() for g in given] + ["Galmora Development Bank", "Galmora Dev. Bk", "Galmora DB", "Galmora Savings Bank", "Galmora SB", "Bank of Galmora", "Galmora Trust"]
    df = spark.createDataFrame([(i, f"x:{n}", n) for i, n in enumerate(names)], "stance_no long, id string, name string")
    surfaces = N.spellings(df).select("surface", "kind", "core", "words", "initials", "acronym", "full").distinct()
    found = {(r.a, r.b) for r in N.links(surfaces).collect()}
    rows = [tuple(r) for r in surfaces.collect() if r.core]
    true = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and N.near(x[2], y[2]) and N.agree(x[1:], y[1:]) + (0.01 if x[2] == y[2] else 0.0) > 0.6}
    assert found == true
