"""Readers: manifests, JSON lines, text lists, raw files, HTML pages and ingested documents, with declared schemas."""

from __future__ import annotations

import email
import email.policy
import html.parser
import io
import mailbox
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "slug string, title string, date string, url string, tags array<string>, word_count int, file string, content_hash string, provenance struct<source_id:string,modality:string,authorship:string,privacy:string,license:string,date_confidence:string>"
DOCUMENTS = "path string, documents array<struct<title:string,text:string,ordinal:int>>, date string, authorship string, confidence double, warnings array<string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON manifest with their position."""
    whole = spark.read.schema(f"last_updated string, total_articles int, articles array<struct<{ENTRY.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int').replace(' struct', ':struct')}>>").json(path, multiLine=True)
    return whole.select(F.posexplode("articles").alias("_pos", "a")).select("a.*", "_pos")


def json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines: a malformed line fails the read, or is left out."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def last_valid(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """The last well-formed row of a log."""
    return json_lines(spark, path, schema, strict=False).orderBy(F.desc(order)).limit(1)


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What a reader gives, or no rows where the path is missing."""
    try:
        df = read()
        df.schema  # noqa: B018
        return df
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): one a line; blank lines and # comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def recipients(spark: SparkSession, path: str) -> DataFrame:
    """(address): addresses of a list, each once."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("address")).where(F.col("address").rlike(r"^[^@\s]+@[^@\s]+$")).distinct()


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a sitemap's locations."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.trim("loc").alias("url")).where("url <> ''")


class _Page(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.canonical = ""
        self.times: list[str] = []
        self.h1 = ""
        self.paragraphs: list[tuple[bool, str]] = []
        self.inside: list[str] = []
        self.text: list[str] | None = None
        self.hidden = 0
        self.article = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault(a.get("property") or a.get("name"), a.get("content", ""))
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = self.canonical or a.get("href", "")
        elif tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        elif tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag in ("article", "main"):
            self.article += 1
        elif tag in ("p", "h1") and self.text is None:
            self.text = []
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("article", "main"):
            self.article = max(0, self.article - 1)
        elif tag in ("p", "h1") and self.inside and self.inside[-1] == tag:
            text = re.sub(r"\s+", " ", "".join(self.text or [])).strip()
            self.inside.pop()
            self.text = None
            if tag == "h1":
                self.h1 = self.h1 or text
            elif text:
                self.paragraphs.append((self.article > 0, text))

    def handle_data(self, data):
        if self.text is not None and not self.hidden:
            self.text.append(data)


PAGE = "title string, url string, date string, modified string, section string, bylines array<string>, body string, word_count int"


def read_page(url: str, text: str) -> dict:
    """The article of an HTML page: paragraphs of its main element, or of the page where it has none."""
    page = _Page()
    page.feed(text or "")
    main = [t for own, t in page.paragraphs if own and len(t) > 20] or [t for _, t in page.paragraphs if len(t) > 50]
    body = "\n\n".join(main)
    m = page.meta
    dated = re.search(r"/(\d{4}/\d{2}/\d{2})/", url or "")
    names = [x for x in dict.fromkeys([m.get("author", ""), m.get("article:author", "")]) if x and "://" not in x]
    return {
        "title": page.h1 or m.get("og:title", ""), "url": page.canonical or m.get("og:url", "") or url, "date": m.get("article:published_time", "") or (page.times[0] if page.times else "") or (dated.group(1).replace("/", "-") if dated else ""),
        "modified": m.get("article:modified_time", "") or m.get("og:updated_time", ""), "section": m.get("article:section", ""), "bylines": names, "body": body, "word_count": len(body.split()),
    }


def pages(df: DataFrame, *, url: str = "url", text: str = "html") -> DataFrame:
    """HTML pages as articles, in Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([read_page(u, t) for u, t in zip(b[url], b[text], strict=True)], columns=["title", "url", "date", "modified", "section", "bylines", "body", "word_count"])

    return df.select(url, text).mapInPandas(run, PAGE)


def first_body(*candidates: str):
    """The first non-empty of several extractions."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in candidates])


HANDLERS: dict[str, Callable[[bytes, str], dict]] = {}


def register(*suffixes: str):
    """Register a handler (bytes, path) -> {documents, date, authorship, confidence, warnings} for file suffixes."""
    def add(handler: Callable[[bytes, str], dict]) -> Callable[[bytes, str], dict]:
        for s in suffixes:
            HANDLERS[s.lower().lstrip(".")] = handler
        return handler

    return add


@register("txt", "md")
def plain_file(data: bytes, path: str) -> dict:
    text = data.decode("utf-8", "replace").strip()
    found = re.match(r"# (.+)", text)
    title = found.group(1).strip() if found else posixpath.basename(path).rsplit(".", 1)[0]
    return {"documents": [(title, text, 0)] if text else [], "date": "", "authorship": "author", "confidence": 1.0 if text else 0.0, "warnings": [] if text else ["empty file"]}


def _message(m) -> tuple[str, str, str, str]:
    part = m.get_body(preferencelist=("plain",)) if hasattr(m, "get_body") else None
    try:
        text = part.get_content() if part else ""
    except (LookupError, UnicodeDecodeError):
        text = ""
    try:
        date = parsedate_to_datetime(str(m["date"])).date().isoformat() if m["date"] else ""
    except (TypeError, ValueError):
        date = ""
    return str(m["subject"] or ""), text.strip(), date, str(m["from"] or "")


@register("eml", "mbox")
def mail_file(data: bytes, path: str) -> dict:
    if path.lower().endswith(".mbox"):
        with tempfile.NamedTemporaryFile() as f:  # the mailbox module reads files only; it is gone when the handler returns
            f.write(data)
            f.flush()
            all_ = [email.message_from_bytes(bytes(m), policy=email.policy.default) for m in mailbox.mbox(f.name)]
    else:
        all_ = [email.message_from_bytes(data, policy=email.policy.default)]
    read = [_message(m) for m in all_]
    held = [(s, t) for s, t, _, _ in read if t]
    dates = sorted(d for _, _, d, _ in read if d)
    senders = {f for _, _, _, f in read if f}
    return {
        "documents": [(s, t, i) for i, (s, t) in enumerate(held)], "date": dates[0] if dates else "", "authorship": "mixed" if len(senders) > 1 else "author",
        "confidence": 0.0 if not held else 1.0 if len(held) == len(read) else 0.8, "warnings": [] if len(held) == len(read) else ["messages without text"],
    }


@register("epub")
def book_file(data: bytes, path: str) -> dict:
    bad = lambda why: {"documents": [], "date": "", "authorship": "author", "confidence": 0.0, "warnings": [why]}
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        if "META-INF/encryption.xml" in book.namelist():
            return bad("protected file")
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        root = next(e.get("full-path") for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        opf = ElementTree.fromstring(book.read(root))
        items = {e.get("id"): e.get("href") for e in opf.iter() if local(e) == "item"}
        chapters, warnings = [], []
        for ref in (e.get("idref") for e in opf.iter() if local(e) == "itemref"):
            try:
                page = _Page()
                page.feed(book.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), items[ref]))).decode("utf-8", "replace"))
            except KeyError:
                warnings.append(f"missing part {ref}")
                continue
            text = "\n\n".join(t for _, t in page.paragraphs)
            if len(text) < 500:
                warnings.append("front matter left out")
            else:
                chapters.append((page.h1, text, len(chapters)))
        return {"documents": chapters, "date": "", "authorship": "author", "confidence": 0.0 if not chapters else 0.8 if warnings else 1.0, "warnings": warnings}
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return bad("malformed file")


def ingest(files: DataFrame) -> DataFrame:
    """Binary files (path, content) as documents by the handlers of their suffixes; unknown suffixes give no documents and a warning."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                handler = HANDLERS.get(path.rsplit(".", 1)[-1].lower())
                got = handler(bytes(data), path) if handler else {"documents": [], "date": "", "authorship": "author", "confidence": 0.0, "warnings": ["unsupported format"]}
                rows.append({"path": path, **got, "documents": [{"title": t, "text": x, "ordinal": i} for t, x, i in got["documents"]]})
            yield pd.DataFrame(rows, columns=["path", "documents", "date", "authorship", "confidence", "warnings"])

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")
