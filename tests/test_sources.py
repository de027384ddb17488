import io
import json
import zipfile

from folioforge.sources import readers as R
from folioforge.sources import writers as W
from folioforge.streaming import inbox


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", '<package xmlns="u"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="z"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<html><h1>One</h1><p>" + "first words " * 60 + "</p></html>")
        z.writestr("OEBPS/b.xhtml", "<html><h1>Two</h1><p>short</p></html>")
    return out.getvalue()


def test_ingest_by_suffix(spark, tmp_path):
    files = {
        "a.md": b"# A title\n\nText.", "b.txt": b"  ", "c.eml": b"From: a@x.example\nDate: Mon, 06 Jan 2020 10:00:00 +0000\nSubject: Hello\n\nBody text", "d.epub": book(), "e.epub": b"no zip", "f.xyz": b"?",
        "g.mbox": b"From a@x Mon Jan  6 10:00:00 2020\nFrom: a@x.example\nSubject: One\n\nfirst\n\nFrom b@x Mon Jan  6 11:00:00 2020\nFrom: b@x.example\nSubject: Two\n\nsecond\n",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[-1]: r for r in R.ingest(R.binary_files(spark, str(tmp_path))).collect()}
    assert got["a.md"].documents[0].title == "A title" and got["b.txt"].confidence == 0 and got["c.eml"].date == "2020-01-06"
    assert [d.title for d in got["d.epub"].documents] == ["One"] and got["d.epub"].confidence == 0.8 and got["e.epub"].warnings == ["malformed file"]
    assert [d.text for d in got["g.mbox"].documents] == ["first", "second"] and got["g.mbox"].authorship == "mixed" and got["f.xyz"].warnings == ["unsupported format"]


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="T"><meta property="article:section" content="S"><link rel="canonical" href="https://x.example/c"></head><body><nav><p>menu</p></nav><article><h1>Head</h1><p>A paragraph of more than twenty letters.</p><p>short</p><script>x</script></article></body></html>'
    r = R.pages(spark.createDataFrame([("https://x.example/2020/01/02/a", html), ("u", None)], "url string, html string")).collect()
    assert r[0].title == "Head" and r[0].body == "A paragraph of more than twenty letters." and r[0].date == "2020-01-02" and r[0].section == "S" and r[0].url == "https://x.example/c" and r[1].body == ""


def test_json_and_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"total_articles": 2, "articles": [{"slug": "a", "file": "f"}, {"slug": "b", "tags": ["x"]}]}))
    m = R.manifest(spark, str(tmp_path / "m.json")).orderBy("_pos").collect()
    assert [r.slug for r in m] == ["a", "b"] and m[1].tags == ["x"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int", strict=False).count() == 2
    (tmp_path / "u.txt").write_text("# list\nhttps://a\n\n https://b \n")
    assert sorted(r.url for r in R.url_list(spark, str(tmp_path / "u.txt")).collect()) == ["https://a", "https://b"]
    (tmp_path / "r.txt").write_text("a@b\n# no\nnone\na@b # twice\n")
    assert [r.address for r in R.recipients(spark, str(tmp_path / "r.txt")).collect()] == ["a@b"]
    assert R.or_empty(spark, lambda: spark.read.json(str(tmp_path / "absent")), "a int").count() == 0
    W.manifest(R.manifest(spark, str(tmp_path / "m.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().total_articles == 2


def test_inbox_stream_stages_contents_once(spark, tmp_path):
    box, queue, check = (str(tmp_path / x) for x in ("in", "queue", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one text")
    (tmp_path / "in" / "b.txt").write_text("one text")
    inbox.stage(spark, box, queue, check).awaitTermination()
    (tmp_path / "in" / "c.txt").write_text("one text")
    (tmp_path / "in" / "d.txt").write_text("another")
    inbox.stage(spark, box, queue, check).awaitTermination()
    assert spark.read.parquet(queue).count() == 2
