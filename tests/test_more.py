import pytest
from pyspark.sql import functions as F

from folioforge.functions import cleaning as C
from folioforge.operators import evaluation as E
from folioforge.operators import seams


def test_captions(spark):
    rows = {
        "MADRID, SPAIN - 2019/04/03: A view of the bank [+] via Getty Images\n\nCPI, PCE - these two measures diverged. He said so.": "CPI, PCE - these two measures diverged. He said so.",
        "Plain. (Photo by A B/AFP)\n\n\n\nNext": "Plain. \n\nNext",
        # a caption that runs over the next dateline, and no sign within 400 characters
        "OSLO - a note ROME - a second one [+] ends here. Kept": "Kept",
        "PARIS - " + "x" * 400 + " [+] y": "PARIS - " + "x" * 400 + " y",
        "": "",
    }
    got = [r.x for r in spark.createDataFrame([(k,) for k in rows], "body string").coalesce(1).select(C.strip_wire("body").alias("x")).collect()]
    assert got == list(rows.values())


def test_cleaning_column(spark):
    rows = [("A  b. The opinions expressed here are mine. End\n\n[+] x",), (None,), ("",), ("Follow me on Twitter now\nKept",)]
    got = [r.x for r in spark.createDataFrame(rows, "body string").select(C.clean("body").alias("x")).collect()]
    assert got == ["A b. End x", "", "", "Kept"]
    assert spark.createDataFrame([("a b c d",)], "body string").select(C.for_embedding("body", 2).alias("x")).first().x == "a b"


def test_model_comparison(spark):
    rows = [("base", f"q{i}", 0.2) for i in range(8)] + [("new", f"q{i}", 0.9) for i in range(8)]
    m = spark.createDataFrame(rows, "model string, query string, reciprocal_rank double")
    p = E.paired(m, "new", "base")
    assert (p["wins"], p["losses"], p["ties"]) == (8, 0, 0) and p["p_value"] == pytest.approx(2 / 256)
    assert E.model_verdict(m, "base") == ("new", "candidate_better") and E.model_verdict(m, "new") == ("new", "baseline_retained")
    assert E.model_verdict(m.where("query < 'q2'"), "base") == ("new", "inconclusive")
    t = E.against_targets(spark.createDataFrame([("a", 0.5)], "metric string, value double"), spark.createDataFrame([("a", 0.5), ("b", 0.1)], "metric string, target double"))
    assert not any(r.passed for r in t.collect())


def test_style_gold_and_trials(spark):
    trials = spark.createDataFrame([("t", {"real": "One two three four. Five six seven eight.", "fake": "word word word word word."}), ("u", {"real": "PASTE here", "fake": None})], "trial string, candidates map<string,string>")
    gaps = {r.source: r for r in E.style_gaps(E.style_rows(trials.where("trial = 't'"), ("word",))).collect()}
    assert gaps["real"].ttr_gap == 0 and gaps["fake"].ttr_gap < 0 and gaps["fake"].hits_per_1k == 1000
    assert {(r.trial, r.source) for r in E.unfinished(trials).collect()} == {("u", "real"), ("u", "fake")}
    filled = E.fill(trials, spark.createDataFrame([("t", "x"), ("u", "y")], "trial string, text string"), "fake")
    assert {r.trial: r.candidates["fake"] for r in filled.collect()} == {"t": "x", "u": "y"}
    gold = spark.createDataFrame([("q", ["a", "zz"]), ("Q", []), ("", ["a"])], "query string, relevant_slugs array<string>")
    problems = sorted(r.problem for r in E.gold_problems(gold, spark.createDataFrame([("a",)], "slug string")).collect())
    assert problems == ["empty query", "no relevant items", "repeated query", "unknown item"]
    texts, sources = E.blind({"a": "1", "b": "2"}, "s")
    assert E.blind({"b": "2", "a": "1"}, "s") == (texts, sources) and {sources[k]: v for k, v in texts.items()} == {"a": "1", "b": "2"}
    log = spark.createDataFrame([("Iter 10: Val loss 2.5, x\nIter 20: Val loss 2.1\nIter 30: Val loss 2.1",)], "log string").select(E.best_checkpoint(E.losses("log")).alias("b")).first().b
    assert (log.iter, log.loss) == (20, 2.1)
    assert E.must_retrain({"fingerprint": "x", "words": 9}, None)[0] and not E.must_retrain({"fingerprint": "x", "words": 9}, {"fingerprint": "x", "words": 1})[0]
    assert E.ladder({"a": True, "b": False, "c": False}) == [("a", "done"), ("b", "next"), ("c", "upcoming")]
    assert E.run_steps([("a", lambda: True), ("b", lambda: False), ("c", lambda: True)]) == [("a", True), ("b", False)]


def test_seams(spark):
    a = spark.createDataFrame([("s", "2020", "Mr Smith met the Federal Reserve Bank. Anna Walters met the Federal Reserve Bank."), ("t", None, None)], "slug string, date string, body string")
    r = {x.slug: x for x in seams.recognise(a).collect()}
    assert r["s"].orgs[0]["name"] == "Federal Reserve Bank" and r["s"].orgs[0]["count"] == 2 and any(p["name"] == "Anna Walters" for p in r["s"].people) and r["t"].orgs == []
    v = seams.embed(a, key="slug", text="body").collect()
    assert len(v[0].embedding) == 64 and sum(x * x for x in v[0].embedding) == pytest.approx(1, abs=1e-4)
    prompts = spark.createDataFrame([(1, 'ok {"claims_total": 2, "claims_grounded": 5} end'), (2, "none")], "k int, p string")
    replies = seams.ask(prompts, key="k", prompt="p", call=lambda p: p)
    j = seams.judged(replies, key="k").collect()
    assert len(j) == 1 and (j[0].claims_total, j[0].claims_grounded) == (2, 2)
    claims = spark.createDataFrame([(1, 'x [{"claim": "c", "topic": "t"}, {"claim": ""}] y')], "k int, reply string")
    assert [c.claim for c in seams.extracted_claims(claims, key="k").collect()] == ["c"]
    with pytest.raises(PermissionError):
        seams.ask(prompts, key="k", prompt="p", call=lambda p: p, remote=True)
    assert seams.resumed(prompts, prompts.where("k = 1"), key="k").select(F.max("k")).first()[0] == 2


def test_registered_theme_clusters_try_every_k(monkeypatch):
    import inspect

    from folioforge.operators import themes
    from folioforge.plans import registry

    given = {}
    whole = themes.cluster
    monkeypatch.setattr(registry, "table", lambda s, d, n: n)
    monkeypatch.setattr(registry.themes, "cluster", lambda *a, **k: given.update(inspect.signature(whole).bind(*a, **k).arguments) or (None, None))
    registry.QUERIES["theme_clusters"](None, "")
    assert given.get("ks", inspect.signature(whole).parameters["ks"].default) == range(4, 11)
