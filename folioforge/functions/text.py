"""Scalar text functions as columns: cleaning, names, URLs, dates, splitting and predicates. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: folded names, markers and word lists that results must agree with ---
ALIASES = {
    "fed": "Federal Reserve", "federal reserve": "Federal Reserve",
    "treasury": "Treasury", "treasurys": "Treasury",
    "covid": "Covid", "covid-19": "Covid", "covid19": "Covid",
    "powell": "Jerome Powell", "jerome powell": "Jerome Powell",
    "ma": "Jack Ma", "jack ma": "Jack Ma",
    "bls": "Bureau of Labor Statistics", "bureau of labor statistics": "Bureau of Labor Statistics",
    "ecb": "European Central Bank", "european central bank": "European Central Bank",
}
ABBREVIATIONS = (
    "mr mrs ms dr prof rev sen rep gov gen adm col lt sgt st jr sr inc corp co ltd llc llp plc bros"
    " jan feb mar apr jun jul aug sep sept oct nov dec vs etc eg ie approx est fig no vol pp cf al dept univ"
).split()
DEPENDENT_OPENERS = "But And So Yet Or Nor Thus Then Also This That These Those It They Them Their Its He She His Her Here There However Therefore Moreover Furthermore Meanwhile Instead Which Who Because".split()
APHORISTIC = [
    "always", "never", "every", "everyone", "everything", "no one", "nobody", "nothing", "none", "only", "must", "cannot", "inevitable", "inevitably", "ultimately", "fundamental",
    "fundamentally", "essence", "essential", "truth", "real", "reality", "simply", "matter", "sooner or later", "in the end", "at its core", "the point",
]
ATTRIBUTION = ["said", "says", "according to", "told", "wrote", "argued", "noted"]
URL_SIGNS = ["http", "www.", "@", ".com", ".org"]
# --- end of fixed values ---


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: str | Column) -> Column:
    """White space runs as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def without_possessive(name: str | Column) -> Column:
    """A name without a trailing possessive, unless nothing would be left."""
    bare = F.trim(F.regexp_replace(_c(name), "['’]s?$", ""))
    return F.when(bare != "", bare).otherwise(_c(name))


def without_article(name: str | Column) -> Column:
    """A name without one leading "the", unless nothing would be left."""
    bare = F.regexp_replace(_c(name), r"(?i)^the\s+", "")
    return F.when(bare != "", bare).otherwise(_c(name))


def canonical_name(name: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """The display name of an entity: white space, possessive and leading article folded, then the alias table; "" for blank and null."""
    table = ALIASES if aliases is None else aliases
    bare = F.trim(without_article(without_possessive(squeeze(F.coalesce(_c(name), F.lit(""))))))
    if not table:
        return bare
    known = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(known[F.lower(bare)], bare)


def year_of(date: str | Column) -> Column:
    """The four digits a date string begins with; null for empty, null and other strings."""
    y = F.substring(_c(date), 1, 4)
    return F.when(y.rlike(r"^\d{4}$"), y)


def quarter_of(date: str | Column) -> Column:
    """"YYYY-Qn" of a date string with a month; null where there is none."""
    month = F.try_to_number(F.regexp_extract(_c(date), r"^\d{4}-(\d{2})", 1), F.lit("99")).cast("int")
    return F.when(month.between(1, 12), F.concat(year_of(date), F.lit("-Q"), F.floor((month + 2) / 3).cast("string")))


def month_of(date: str | Column) -> Column:
    m = F.regexp_extract(_c(date), r"^(\d{4}-(?:0[1-9]|1[0-2]))", 1)
    return F.when(m != "", m)


def date_with_confidence(date: str | Column) -> Column:
    """struct(date, confidence): a full date is exact, a bare year approximate, anything else unknown with an empty date."""
    d = F.trim(F.coalesce(_c(date), F.lit("")))
    full = F.regexp_extract(d, r"^(\d{4}-\d{2}-\d{2})", 1)
    year = F.regexp_extract(d, r"^(\d{4})$", 1)
    return F.struct(
        F.when(full != "", full).otherwise(year).alias("date"),
        F.when(full != "", "exact").when(year != "", "approximate").otherwise("unknown").alias("confidence"),
    )


def host_of(url: str | Column) -> Column:
    """The host of a URL in lower case without "www."; null where there is none."""
    h = F.regexp_extract(F.lower(_c(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(h != "", h)


def normal_url(url: str | Column) -> Column:
    """A URL without query and fragment, scheme and host in lower case, and one slash at its end; null without scheme or host."""
    scheme = F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.rtrim(path, F.lit("/")), F.lit("/")))


def dated_url(url: str | Column) -> Column:
    """struct(key, date, month, slug) of a URL whose path holds /YYYY/MM/DD/slug; null for others. Scheme, "www." and query do not change the key."""
    path = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    pattern = r"/(\d{4})/(\d{2})/(\d{2})/([^/]+)"
    y, m, d, s = (F.regexp_extract(path, pattern, i) for i in (1, 2, 3, 4))
    return F.when(
        s != "",
        F.struct(
            F.concat_ws("/", host_of(url), y, m, d, s).alias("key"), F.concat_ws("-", y, m, d).alias("date"), F.concat_ws("-", y, m).alias("month"), s.alias("slug")
        ),
    )


def is_article_url(url: str | Column, section: str) -> Column:
    """Whether a URL's path lies under a section, has a slug behind it that is no page number, and no "amp" segment."""
    path = F.rtrim(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("/"))
    behind = F.trim(F.element_at(F.split(path, F.lit(section)), -1), F.lit("/"))
    return path.contains(section) & ~F.array_contains(F.split(F.lower(path), "/"), "amp") & (behind != "") & ~behind.rlike(r"^\d+$")


def slug(text: str | Column, longest: int = 80) -> Column:
    """A slug: lower case, word characters and hyphens only, at most ``longest`` characters."""
    s = F.regexp_replace(F.lower(F.trim(_c(text))), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    return F.substring(F.trim(s, F.lit("-")), 1, longest)


def normal_title(text: str | Column) -> Column:
    """Lower-case letters and digits of a title as tokens joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def topic_of(title: str | Column) -> Column:
    """A title without one leading question or article word and trailing question marks; the title itself when nothing is left."""
    t = F.trim(F.rtrim(F.regexp_replace(_c(title), r"(?i)^(?:why|how|what|when|where|is|are|the|a|an)\s+", ""), F.lit("?")))
    return F.when(t != "", t).otherwise(_c(title))


def normal_byline(name: str | Column) -> Column:
    """A byline without a leading "By" and a trailing contributor or staff role, even a glued one."""
    b = F.regexp_replace(squeeze(name), r"(?i)^by\b:?\s*", "")
    return F.trim(F.regexp_replace(b, r"(?i)[\s,|]*(?:senior|staff|former|guest)?\s*contributor\b.*$", ""))


def comparable(text: str | Column) -> Column:
    """Text for comparing titles in answers: lower case, quotes dropped, other signs as spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "['‘’ʼ`\"“”]", "")
    return squeeze(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def sentences(text: str | Column) -> Column:
    """array<string>: parts that end in . ! or ? before white space, trimmed, without empty ones; an empty array for null."""
    parts = F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def careful_sentences(text: str | Column) -> Column:
    """array<string>: as ``sentences``, but only before a capital, never behind an abbreviation, an initial or a dotted acronym, and only parts with a letter."""
    short = "|".join(ABBREVIATIONS)
    held = F.regexp_replace(F.coalesce(_c(text), F.lit("")), rf"(?i)(?<![A-Za-z.])((?:{short}|[A-Za-z](?:\.[A-Za-z])*)\.)(\s+)", "$1\u0001$2")
    parts = F.split(held, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "\u0001", ""))), lambda s: s.rlike(r"\p{L}"))


def paragraphs(text: str | Column) -> Column:
    """array<string>: parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\n\s*\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def tokens(text: str | Column, pattern: str = r"[A-Za-z][A-Za-z'-]*") -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), F.lit(0))


def names_word(sentence: str | Column, name: str | Column, *, ignore_case: bool = True) -> Column:
    """Whether a name stands in a sentence as whole words; false for a blank name."""
    flags = "(?iU)" if ignore_case else "(?U)"
    quoted = F.concat(F.lit(flags + r"\b\Q"), F.trim(_c(name)), F.lit(r"\E\b"))
    return (F.trim(_c(name)) != "") & F.call_function("rlike", _c(sentence), quoted)


def is_quotable(sentence: str | Column, *, least: int = 8, most: int = 30) -> Column:
    """Whether a sentence may stand alone: a statement of ``least`` to ``most`` words with a capital first, no dependent opener and no address."""
    s = F.trim(_c(sentence))
    words = tokens(s)
    noisy = F.lit(False)
    for sign in URL_SIGNS:
        noisy = noisy | F.lower(s).contains(sign)
    return F.coalesce(s.rlike(r"[.!]$") & F.size(words).between(least, most) & s.rlike(r"^\p{Lu}") & ~F.get(words, F.lit(0)).isin(DEPENDENT_OPENERS) & ~noisy, F.lit(False))


def excerpt(text: str | Column, longest: int = 900) -> Column:
    """At most ``longest`` characters: cut behind the last sentence end in the back half, else behind the last whole word with an ellipsis."""
    t = squeeze(text)
    head = F.substring(t, 1, longest)
    ended = F.regexp_extract(head, rf"^(.{{{longest // 2},}}[.!?])(?:\s|$)?", 1)
    worded = F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(t) <= longest, t).when(ended != "", ended).otherwise(worded)


def reading_minutes(words: str | Column) -> Column:
    """Minutes to read at 200 words each, at least 1; 0 for no words."""
    w = _c(words)
    return F.when(F.coalesce(w, F.lit(0)) <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(w / 200))).cast("int")


def front_matter_reason(title: str | Column, text: str | Column, *, titles: tuple[str, ...] = ("cover", "title page", "copyright", "contents", "table of contents", "dedication", "acknowledgments", "index"), least: int = 500) -> Column:
    """Why a chapter is no prose ("title" or "short"), else ""."""
    t = F.lower(F.trim(F.coalesce(_c(title), F.lit(""))))
    return F.when(t.isin(*titles), "title").when(F.length(F.coalesce(_c(text), F.lit(""))) < least, "short").otherwise("")


def upload_reason(name: str | Column, size: str | Column, *, suffixes: tuple[str, ...] = ("txt", "md", "eml", "mbox", "epub"), most: int = 25 * 2**20) -> Column:
    """Why an upload is refused ("" when it is not): names are never repaired, only refused."""
    n = F.coalesce(_c(name), F.lit(""))
    return (
        F.when(n == "", "empty name").when(F.length(n) > 255, "long name").when(n.rlike(r"[\x00-\x1f\x7f]"), "control characters").when(n.rlike(r"[/\\]"), "separator").when(n.startswith("."), "leading dot")
        .when(~F.lower(F.regexp_extract(n, r"\.([^.]+)$", 1)).isin(*suffixes), "suffix").when(F.coalesce(_c(size), F.lit(0)) <= 0, "empty file").when(_c(size) > most, "large file").otherwise("")
    )


def is_email(value: str | Column) -> Column:
    return F.coalesce(_c(value).rlike(r"^[^@]+@[^@]+$"), F.lit(False))
