import math

import pytest
from pyspark.sql import functions as F

from folioforge.functions import scores as S
from folioforge.functions import text as T
from folioforge.operators import corpus, entities, linguistic, predictions, reading, retrieval, themes, training


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_names(spark):
    for raw, name in (("the Fed", "Federal Reserve"), ("Federal  Reserve’s", "Federal Reserve"), ("The", "The"), ("ECB", "European Central Bank"), ("", ""), ("COVID-19", "Covid"), ("'s", "'s"), ("Acme", "Acme")):
        assert one(spark, T.canonical_name("n"), n=raw) == name


def test_tone_and_view(spark):
    for text, sign in (("It was not a success.", -1), ("There was no failure here.", 1), ("It was not really a success.", -1), ("No, the outcome was clearly a success.", 1), ("Nothing.", 0)):
        assert one(spark, S.tone("s"), s=text) == sign
    assert one(spark, S.view("s"), s="A strong, wise plan with a strongman and a crisis") == 1


def test_sentences_and_paragraphs(spark):
    assert one(spark, T.sentences("s"), s="One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, T.careful_sentences("s"), s="Ms. Lagarde of the U.S. Bank spoke. Why? George W. Bush left.") == ["Ms. Lagarde of the U.S. Bank spoke.", "Why?", "George W. Bush left."]
    assert one(spark, T.paragraphs("s"), s=" a \n\n\n b\nc \n \n") == ["a", "b\nc"]
    assert one(spark, T.excerpt("s", 40), s="word " * 30).endswith("…")


def test_urls_dates_titles(spark):
    assert one(spark, T.normal_url("u"), u="HTTPS://WWW.Site.example/A/b//?q=1#x") == "https://www.site.example/A/b/"
    keys = {one(spark, T.dated_url("u")["key"], u=u) for u in ("http://site.example/2021/03/04/some-slug", "https://www.site.example/x/2021/03/04/some-slug/?a=b")}
    assert keys == {"site.example/2021/03/04/some-slug"}
    assert one(spark, T.dated_url("u"), u="https://site.example/listing") is None
    for d, want in (("2020-05-06T01:02:03Z", ("2020-05-06", "exact")), ("2020", ("2020", "approximate")), ("", ("", "unknown"))):
        got = one(spark, T.date_with_confidence("d"), d=d)
        assert (got.date, got.confidence) == want
    assert one(spark, T.slug("t"), t="  The U.S. Economy: What_now? ") == "the-us-economy-what-now"
    assert one(spark, T.topic_of("t"), t="Why markets fall?") == "markets fall"
    assert one(spark, T.normal_byline("b"), b="By: Anna Walters, Senior Contributor Group") == "Anna Walters"
    assert one(spark, T.is_article_url("u", "/sites/a/"), u="https://x.example/sites/a/ampere-news/") and not one(spark, T.is_article_url("u", "/sites/a/"), u="https://x.example/sites/a/amp/n")
    assert one(spark, T.quarter_of("d"), d="2020-08") == "2020-Q3" and one(spark, T.year_of("d"), d="x") is None


def test_quotability(spark):
    line = "Every market is a voting machine, and never a court of law."
    assert one(spark, T.is_quotable("s"), s=line) and not one(spark, T.is_quotable("s"), s="But " + line) and not one(spark, T.is_quotable("s"), s=line[:-1] + "?")
    n = 12
    assert one(spark, S.quotability("s"), s=line) == pytest.approx(1 - abs(n - 14) / 14 + 1 + 1 * 0 + 0.75 + 1 * (" never " in line), abs=1e-3)


def test_small_statistics(spark):
    assert S.sign_test(5, 0) == pytest.approx(2 / 32) and S.sign_test(0, 0) == 1 and S.decisive_size() == 6 and S.least_probability(0) == 1
    assert one(spark, S.nearest_rank("a", 95), a=list(range(1, 101))) == 95 and one(spark, S.next_power("n"), n=5) == 8
    assert [S.direction(2, 1, "higher"), S.direction(2, 1, "lower"), S.direction(0.5, 0.9, "toward", 0.6), S.direction(None, 1, "higher"), S.direction(1, 1, "?")] == ["better", "worse", "better", "unknown", "unscored"]
    assert [one(spark, S.syllables("w"), w=w) for w in ("table", "make", "x", "economy")] == [2, 1, 1, 4]
    assert [one(spark, T.reading_minutes("w"), w=w) for w in (800, 1, 0)] == [4, 1, 0]


RECORDS = "slug string, date string, orgs array<struct<name:string,count:int>>, people array<struct<name:string,count:int>>, extra int"


def test_entity_graph(spark):
    rows = [
        ("a1", "2020-01-01", [("Fed", 5), ("ECB", 2)], [("Powell", 3)], 1), ("a2", "2021-01-01", [("Fed", 4), ("ECB", 1)], [("Powell", 2)], 1), ("a3", "2022-01-01", [("Fed", 6)], [("Powell", 1)], 1),
        ("a4", "2023-01-01", [("Berkshire", 3)], [("Buffett", 4)], 1), ("a5", None, None, [], 1), ("a4", "2023-01-01", [("Berkshire", 3)], [("Buffett", 4)], 1),
    ]
    seen = entities.mentions(spark.createDataFrame(rows, RECORDS))
    nodes, edges = entities.graph(seen)
    n = {r.name: r for r in nodes.collect()}
    e = {(r.source, r.target): r.weight for r in edges.collect()}
    assert n["Federal Reserve"].article_count == 3 and n["Federal Reserve"].total_mentions == 15 and n["Federal Reserve"].degree == 2 and n["Buffett"].degree == 0
    assert e == {("org:Federal Reserve", "person:Jerome Powell"): 3, ("org:European Central Bank", "org:Federal Reserve"): 2, ("org:European Central Bank", "person:Jerome Powell"): 2}
    assert entities.edges(seen).where("weight = 1").count() == 1
    assert entities.edges(seen, most=100).count() == entities.edges(seen).count()
    assert entities.mentions(spark.createDataFrame([], RECORDS)).count() == 0


OBS = "obs_id long, entity_id string, date string, stance int, sentence string, slug string"


def observed(spark, stances, entity="x"):
    return spark.createDataFrame([(i, entity, f"20{10 + i}-01-01", v, f"s{i}", f"a{i}") for i, v in enumerate(stances)], OBS)


def test_reversals_and_trend(spark):
    get = lambda v: entities.reversals(entities.observations(observed(spark, v))).collect()
    (cooled,), (warmed,) = get([2, 2, -2, -2]), get([-2, -2, 3, 3])
    assert cooled.direction == "cooled" and cooled.n_observations == 4 and cooled.early_sentence == "s0" and cooled.late_sentence == "s2" and warmed.direction == "warmed"
    assert get([2, 1, 2, 3]) == [] and get([2, -2]) == []
    board = entities.stance_board(entities.observations(observed(spark, [1, 0, -1]))).first()
    assert board.trend == "cooling" and board.trend_delta == -2.0 and board.article_count == 3
    assert entities.movers(entities.stance_board(entities.observations(observed(spark, [1, 0, -1])))).count() == 1


def test_histogram(spark):
    lengths = lambda v: [(r.bin_start, r.bin_end, r["count"]) for r in linguistic.length_histogram(spark.createDataFrame([(x,) for x in v], "n int")).orderBy("bin_start").collect()]
    got = lengths([1, 4, 7, 12, 22, 39, 101, 286])
    assert sum(c for *_, c in got) == 8 and got[-1][0] >= 100 and got[-1][1] is None and got[0] == (0, 5, 2)
    assert lengths([5])[-1] == (5, None, 1) and lengths([]) == []


def test_document_metrics(spark):
    r = linguistic.document_metrics(spark.createDataFrame([(1, "The cat sat. The dog ran away!"), (2, None), (3, "1 2")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].word_count == 7 and r[0].sentence_count == 2 and r[0].vocabulary_size == 6 and r[0].hapax_ratio == pytest.approx(5 / 6) and r[0].avg_sentence_length == 3.5


def test_arc(spark):
    rows = [("2020-01-01", x) for x in (2, 2, 1)] + [("2021-02-02", x) for x in (0, 0, 1, 1)] + [("", 2)]
    years = themes.arc(spark.createDataFrame(rows, "date string, cluster_id int"))
    y = {(r.year, r.theme): r for r in years.collect()}
    assert y["2020", 2].share == 0.667 and y["2020", 2].dominant and y["2021", 0].dominant and not y["2021", 1].dominant
    change = {r.theme: r.change for r in themes.shifts(years).collect()}
    assert change == {0: "emergent", 1: "rising", 2: "vanished"}
    o = themes.overall(years).first()
    assert (o.n_articles, o.most_grown, o.most_declined, o.first_dominant, o.last_dominant) == (7, 0, 2, 2, 0)
    assert themes.overall(years.limit(0)).first().first_year is None


def test_rankings(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "a", "c"], ["c", "b", "a"])], "a array<string>, b array<string>, c array<string>")
    r = df.select(retrieval.kendall(F.col("a"), F.col("b")).alias("t"), retrieval.kendall(F.col("a"), F.col("c")).alias("u"), retrieval.overlap(F.col("a"), F.col("c"), 2).alias("o")).first()
    assert r.t == pytest.approx(1 / 3) and r.u == -1 and r.o == pytest.approx(1 / 3)
    hits = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 3, "a"), ("p", 1, "a")], "query string, rank int, key string")
    wanted = spark.createDataFrame([("q", "a"), ("q", "b"), ("z", "a")], "query string, key string")
    m = {r.query: r for r in retrieval.ranking_metrics(hits, wanted).collect()}
    assert set(m) == {"q", "z"} and m["q"].precision == pytest.approx(1 / 3) and m["q"].recall == 0.5 and m["q"].reciprocal_rank == pytest.approx(1 / 3) and m["z"].reciprocal_rank == 0
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.key for r in retrieval.search(v, v.where("vec_id = 0"), top=3).orderBy("rank").collect()] == [1, 2, 3]
    small = retrieval.search(v, v, top=2, most_bytes=16).orderBy("query", "rank").collect()
    assert small == retrieval.search(v, v, top=2).orderBy("query", "rank").collect() and len(small) == 10
    best = retrieval.best_matches(spark.createDataFrame([("h1", 1, 0.9), ("h2", 1, 0.8), ("h3", 2, 0.6), ("h4", 2, 0.7), ("h5", 3, 0.5)], "headline string, article int, score double")).collect()
    assert [(r.role, r.headline) for r in best] == [("deep dive", "h1"), ("roundup", "h4")]


def test_training(spark):
    bodies = spark.createDataFrame([(i, f"own {i}\n\nBIO  line\n\nlast {i}", 1) for i in range(3)] + [(3, "BIO line\n\nBIO line", 1), (4, None, 1)], "article_id long, body string, paragraph int")
    rep = training.repeated_paragraphs(bodies)
    assert [(r.paragraph, r.articles) for r in rep.collect()] == [("BIO line", 4)]
    out = {r.article_id: r.body for r in training.without_paragraphs(bodies, rep).collect()}
    assert out[0] == "own 0\n\nlast 0" and out[3] == out[4] == ""
    text = "\n\n".join(["p" * 30, "q" * 30, "r" * 30, "One sentence here. " * 20])
    got = one(spark, training.passages("t", 70), t=text)
    assert got[0] == "p" * 30 + "\n\n" + "q" * 30 and all(len(x) <= 72 for x in got)
    import hashlib

    for s in ("alpha", "slug-7", "é"):
        assert one(spark, training.hash_part("s", 1000), s=s) == int(hashlib.md5(s.encode()).hexdigest(), 16) % 1000
    slugs = spark.createDataFrame([(f"slug-{i}",) for i in range(50)] + [(None,)], "slug string")
    parts = {r.slug: r.part for r in training.split(slugs).collect()}
    assert len(parts) == 50 and {r.part for r in training.split(slugs, held_out=0).collect()} == {"train"}
    q = spark.createDataFrame([("What the “Quiet Ledger” says", "Why?")], "topic_hint string, question string")
    a = spark.createDataFrame([("a", "The Quiet Ledger Says"), ("b", "Quiet ledger"), ("c", "the quiet ledger")], "slug string, title string")
    assert {r.slug for r in training.grounded(a, q).collect()} == {"a", "c"}
    budget = training.length_budget(spark.createDataFrame([(400,)] * 95 + [(40000,)] * 5, "chars long"), 8192).first()
    assert (budget.n, budget.n_over, budget.p95_tokens, budget.suggested, budget.pct_over) == (100, 5, 100, 128, 5.0)
    chats = training.chat_records(spark.createDataFrame([("s", "Why it fell?", "First one. Then more of it.\n\nSecond part.")], "slug string, title string, body string")).collect()
    assert len(chats) == 1 and [m.role for m in chats[0].messages] == ["system", "user", "assistant"]
    bad = spark.createDataFrame([([("user", " "), ("system", "x")],), (None,)], "messages array<struct<role:string,content:string>>")
    assert [r.e for r in bad.select(training.shape_errors("messages").alias("e")).collect()] == [["empty user content", "missing assistant turn"], ["no messages"]]


def test_windows_like_a_loop(spark):
    def loop(t, most, back):
        if len(t) <= most:
            return [t]
        out, start = [], 0
        while start < len(t):
            end = start + most
            if end < len(t) and (dot := t.rfind(".", start + most // 2, end)) > start:
                end = dot + 1
            out.append(t[start:end].strip(" "))
            start = end - back
        return out

    for t in ("short", "abc. " * 60, "x" * 333, ("word " * 7 + ". ") * 20):
        assert one(spark, training.windows("t", tokens=20, overlap=5), t=t) == loop(t, 80, 20)
        assert one(spark, training.windows("t", tokens=20, overlap=0), t=t) == loop(t, 80, 0)


def test_corpus(spark):
    rows = [(1, "s", "http://x.example/a?b", "body"), (2, "s", "https://x.example/a", "body"), (3, "s", "https://x.example/a", ""), (4, "", "u", None), (5, None, "v", "w")]
    df = spark.createDataFrame(rows, "article_id long, slug string, url string, body string")
    assert sorted(r.article_id for r in corpus.canonical_entries(df).collect()) == [2, 4, 5]
    assert corpus.collapsed_slugs(df).first().dropped == 2
    a = corpus.fingerprint(df).first()
    assert a == corpus.fingerprint(df.orderBy("url")).first() and a.fingerprint != corpus.fingerprint(df.where("article_id < 5")).first().fingerprint
    assert corpus.fingerprint(df.limit(0)).first().articles == 0
    months = lambda *m: sorted(r.range for r in corpus.month_ranges(spark.createDataFrame([(x,) for x in m], "month string")).collect())
    assert months("2021-12", "2022-01") == ["2021-12..2022-01"] and months("2022-01", "2021-05", "2021-03", "2021-04") == ["2021-03..2021-05", "2022-01"]
    assert {r.issue for r in corpus.audit(df).collect()} == {"slug", "url", "content", "no content"}
    up = corpus.upsert(df, df.where("article_id = 2").withColumn("article_id", F.lit(9).cast("long")))
    assert sorted(r.article_id for r in up.collect()) == [5, 9] or up.count() == 2 or up.where("article_id = 9").count() == 1


def test_predictions(spark):
    schema = "_pos int, claim string, article_slug string, article_title string, article_date string, human_verdict string, evidence_verdict string, llm_verdict string, status string, confidence_language string"
    rows = [
        (0, "c0", "a", "", "2020", "", None, "vindicated", "", "certain"), (1, "c1", "a", "", "2020", None, None, "vindicated", "", "certain"), (2, "c2", "b", "", "2020", "wrong", "vindicated", None, "", "certain"),
        (3, "c3", "c", "", "2020", None, None, "mixed", None, "certain"), (4, "c4", "d", "", "2021", None, None, None, None, "hedged"), (5, "c0", "e", "", "2020", None, None, "vindicated", None, "certain"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r.v for r in df.orderBy("_pos").select(predictions.verdict().alias("v")).collect()] == ["vindicated", "vindicated", "wrong", "mixed", "pending", "vindicated"]
    cal = {r.confidence: r for r in predictions.calibration(df.where("_pos in (0, 2, 3)"), verdict_column=predictions.verdict()).collect()}
    assert cal["certain"].resolved == 3 and cal["certain"].accuracy == 0.5 and cal["hedged"].accuracy is None
    assert [r.claim for r in predictions.notable(df, year=2020).orderBy("place").collect()] == ["c0", "c3", "c2"]
    assert [r.claim for r in predictions.notable(df, only="vindicated", per_article=2).orderBy("place").collect()] == ["c0", "c1"]
    # a claim in a hundred articles must not crowd out the others
    many = [(i, "same", f"s{i:03d}", "", "2020", "vindicated", None, None, "", "certain") for i in range(100)] + [(200 + i, f"own {i}", f"t{i}", "", "2020", "vindicated", None, None, "", "certain") for i in range(10)]
    many += [(300 + i, f"more {i}", "s000", "", "2020", "vindicated", None, None, "", "certain") for i in range(50)]
    assert [r.claim for r in predictions.notable(spark.createDataFrame(many, schema)).orderBy("place").collect()] == ["same", *(f"own {i}" for i in range(5))]
    rag = spark.createDataFrame([(True, 4, 4, False, True), (True, 4, 2, False, False), (False, 0, 0, True, False), (False, 0, 0, False, False)], "answerable boolean, claims_total int, claims_grounded int, abstained boolean, cited boolean")
    f = predictions.faithfulness(rag).first()
    assert (f.grounding_rate, f.hallucination_rate, f.abstention_accuracy, f.false_abstention_rate) == (0.75, 0.25, 0.5, 0.0)
    assert predictions.faithfulness(rag.limit(0)).first().grounding_rate == 0.0


def test_reading_and_queue(spark):
    rows = [(1, "a", "A", "2020-01-01", 800, "x"), (2, "b", "B", "2021-01-01", 1, "x"), (3, "c", "C", "", 5, "x"), (4, "d", "D", "2022", 5, None), (5, "a", "A", "2020-01-01", 800, "x")]
    got = reading.reading_list(spark.createDataFrame(rows, "article_id long, slug string, title string, date string, word_count int, body string")).orderBy("place").collect()
    assert [(r.slug, r.minutes, r.prev_slug, r.next_slug) for r in got] == [("b", 1, "a", None), ("a", 4, None, "b")]
    assert math.isclose(len(got), 2)
    with pytest.raises(PermissionError):
        reading.assert_public(None)
    with pytest.raises(PermissionError):
        reading.assert_public(spark.createDataFrame([("private",), ("public",)], "privacy string"))
    reading.assert_public(spark.createDataFrame([("public",)], "privacy string"))
