import re
import random

import numpy as np
import pytest

from folioforge.llm import leak, mixing, pieces, quality

WORD = re.compile(r"[^ \t\n]+")


def test_pieces_cover_the_text(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["ledger", "a", "tariff.", "note,", "x" * 30]) for _ in range(n))
    texts = [None, "", " \n\t ", words(800), words(801), "\n\n".join(words(120) for _ in range(9)), "\n".join(words(400) for _ in range(5)), words(5000), "  lead " + words(1600) + " \n tail\t", "y" * 9000]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)] + [(4, texts[4], 1, "s")], "article_id long, body string, piece_no int, segments string")
    got: dict = {}
    for r in pieces.pieces(df).collect():
        got.setdefault(r.article_id, set()).add((r.piece_no, r.start, r.text, r.n_words))
    assert set(got) == {3, 4, 5, 6, 7, 8, 9}
    for i, rows in got.items():
        end = 0
        for no, start, text, n in sorted(rows):
            assert texts[i][start : start + len(text)] == text and n == len(WORD.findall(text)) <= 800
            if no == 1:
                assert start == 0
            else:
                assert len(WORD.findall(texts[i][start:end])) == 50
            end = start + len(text)
        assert end == len(texts[i])
    assert sorted(r.article_id for r in pieces.oversized(df).collect()) == [4, 4, 5, 6, 7, 8]
    with pytest.raises(ValueError):
        pieces.pieces(df, limit=5, overlap=5)


def test_pieces_of_text_without_blanks(spark):
    text = "。".join("漢字" * 60 for _ in range(30)) + "z" * 2000
    df = spark.createDataFrame([(1, text), (2, "short one")], "article_id long, body string")
    rows = sorted((r for r in pieces.pieces(df, limit=400, overlap=20, chars=1).collect() if r.article_id == 1), key=lambda r: r.piece_no)
    assert len(rows) > 10 and all(len(r.text) <= 400 for r in rows) and rows[0].text.endswith("。")
    end = 0
    for r in rows:
        assert text[r.start : r.start + len(r.text)] == r.text and (not end or end - r.start == 20)
        end = r.start + len(r.text)
    assert end == len(text)
    assert pieces.pieces(df).count() == 2
    assert all(r.same and r.within for r in pieces.cover(df).collect())


def leak_tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, text string, question string")


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = some(60)
    changed = list(passage)
    changed[10], changed[20] = "other", "another"
    rule = "Answer from the text alone."
    items = [(1, f"{rule}\n{' '.join(passage)}\nWhy so?", "Why so?"), (2, f"{rule}\n{' '.join(some(50))}\nHow?", "How?"), (3, f"{rule}\n{' '.join(passage)}\nWhen?", "When?"), (4, None, "x"), (5, "", "")]
    html = "<em>" + " ".join(w.upper() + "," for w in passage[:30]) + "</em>"
    docs = [
        (1, " ".join(some(40) + passage + some(40)), 0), (2, " ".join(some(30) + changed[5:34] + some(30)), 0), (3, " ".join(some(20) + passage[:20] + some(20)), 0), (4, rule + " " + " ".join(some(80)), 0),
        (5, html.replace(" ", "\n"), 0), (6, None, 0), (7, "", 0), (8, " ".join(some(10) + passage[:12] + ["um"] + passage[12:30] + some(10)), 0), (1, " ".join(some(5) + passage), 0),
    ]
    d, i = leak_tables(spark, docs, items)
    got = sorted((r.doc_id, r.item_id) for r in leak.leaks(d, i).collect())
    assert got == sorted([(1, 1), (1, 3), (1, 1), (1, 3), (2, 1), (2, 3), (5, 1), (5, 3), (8, 1), (8, 3)])
    none = leak_tables(spark, [], [])
    assert leak.leaks(none[0], i).count() == leak.leaks(d, none[1]).count() == 0


def test_prefixes_never_lose_a_leak():
    rng = random.Random(9)
    for _ in range(40):
        p = [str(rng.randrange(60)) + "x" for _ in range(rng.randrange(25, 60))]
        own = leak.hashes(p).tolist()
        need = leak.prefixes(own, {k: rng.randrange(9) for k in own}, 25, 2)
        a = rng.randrange(len(p) - 24)
        doc = p[a : a + 25]
        for j in rng.sample(range(25), 2):
            doc[j] = "changed"
        assert need & set(leak.hashes(doc).tolist())


def test_changes_close_to_each_other_count_once_each():
    item = [f"w{i}" for i in range(40)]
    places = {s: [j] for j, s in enumerate(leak.shingles(item))}
    doc = [*item[5:16], "other", item[17], "another", *item[19:30]]
    assert leak.longest_run(doc, item, places, 25, 0.1) == 25
    assert leak.longest_run([*item[5:16], "a", "b", "c", *item[19:30]], item, places, 25, 0.1) == 0


def test_the_filter_only_adds(spark, monkeypatch):
    table = leak.filter_of(spark.createDataFrame([(5,), (-7,), (64 + 5,)], "shingle long"), 128)
    assert [int(table[(h % 128) >> 6] >> (h % 128 & 63)) & 1 for h in (5, -7, 69, 6)] == [1, 1, 1, 0]
    words = [f"v{i}" for i in range(60)]
    d, i = leak_tables(spark, [(1, " ".join(words), 0), (2, " ".join(reversed(words)), 0)], [(9, " ".join(words[10:50]), "q")])
    monkeypatch.setattr(leak, "FILTER_BITS", 64)
    monkeypatch.setattr(leak.filter_of, "__defaults__", (64,))
    assert [(r.doc_id, r.item_id, r.words) for r in leak.leaks(d, i).collect()] == [(1, 9, 40)]


def test_spread_and_total():
    leaves = [mixing.Leaf("a.example", "site", "en", 0.5, 2, 100), mixing.Leaf("b.example", "site", "en", 0.2, 1, 1000), mixing.Leaf("c", "own", "en", 0.2, 1, 1000), mixing.Leaf("d", "own", "en", 0.1, 1, 0)]
    got = mixing.spread(leaves, 1000)
    assert got["a.example"] == 200 and got["b.example"] == pytest.approx(500) and got["c"] == pytest.approx(300) and got["d"] == 0
    total = mixing.largest_total(leaves)
    assert total == pytest.approx(400) and mixing.spread(leaves, total)["c"] == pytest.approx(120)
    assert mixing.largest_total([]) == 0


def test_mix_keeps_caps_and_shares(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["ledger", "tariff", "of"]) for _ in range(rng.randrange(5, 60))), "en", ["A.example", " a.example", "letters", None, "other"][i % 5], 1) for i in range(400)] + [(900, None, "en", "letters", 1), (901, "", None, "letters", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, uses int")
    t = spark.createDataFrame([("a.example", 0.3, 1), ("letters", 0.7, 4), ("nowhere", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mix(d, t).collect()
    assert {r.source for r in rows} == {"a.example", "letters"} and all(r.uses <= {"a.example": 1, "letters": 4}[r.source] for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    for r in mixing.shares(d, t).collect():
        assert r.reached_share == pytest.approx(r.target_share, abs=0.02)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d, t).collect()))
    assert mixing.mix(d.limit(0), t).count() == 0 == mixing.mix(d, t.limit(0)).count()


def test_quality_statistics_and_rules(spark):
    prose = "The ledger of the bank was not in order, and nobody had noticed it for most of the year. It is a habit that dies hard."
    rows = [(1, prose), (2, prose.upper()), (3, "\n".join(f"- quiet ledger {i}" for i in range(20))), (4, "a\tb\tc\n1\t2\t3\n4\t5\t6"), (5, None), (6, "  \n"), (7, prose + "\n- one item\n- two items"), (8, "0 0 0 0 0 0 0 0"), (9, "1 2")]
    s = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert s[1].prose_share == s[2].prose_share == 1.0 and s[3].prose_share == s[4].prose_share == s[8].prose_share == 0.0 and s[5].words is None and s[6].prose_share is None
    assert s[7].prose_share > 0.5 and s[3].marked_share == 1.0 and s[4].tabular_share == 1.0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert {r.doc_id for r in quality.not_prose(docs, none).collect()} == {3, 4, 8, 9}
    assert quality.not_prose(docs.limit(0), none).count() == 0


def test_rules_are_learned_and_exported():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] < 0.3) | ((x[:, 1] > 0.8) & (x[:, 2] > 0.5))
    rules = quality.learn_rules(x[:400], y[:400], rng.permutation(400), features=["a", "b", "c"])
    hit = np.zeros(200, bool)
    for r in rules:
        hit |= quality._covers(x[400:], [("abc".index(f), op, v) for f, op, v in r])
    assert (hit == y[400:]).mean() > 0.9
    assert quality.rules_sql(rules).startswith("CASE WHEN ") and quality.rules_sql([]) == "'prose'"


def test_rules_are_kept_when_they_beat_the_default(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["The ledger of the bank was not in order.", "It is a habit that dies hard, as they say.", "Nobody had noticed it for most of the year."]) for _ in range(n))
    # these raters call long texts other, which only labels can tell
    rows = [(i, prose(3 if i % 2 else 40), "prose" if i % 2 else "junk") for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label string")
    rules = quality.fit(docs, labels)
    assert rules != quality.DEFAULT_RULES and {r.doc_id for r in quality.not_prose(docs, labels).collect()} == set(range(0, 60, 2))
    assert quality.fit(docs, labels.limit(0)) == quality.DEFAULT_RULES


def test_common_words_as_a_tree():
    pattern = re.compile(rf"\b{quality.any_of(quality.COMMON)}\b")
    assert all(pattern.fullmatch(w) for w in quality.COMMON) and not pattern.fullmatch("thei")
