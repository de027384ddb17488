"""Registered queries of the core operators over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import cleaning
from folioforge.functions import scores as S
from folioforge.functions import text as T
from folioforge.operators import corpus, entities, evaluation, linguistic, predictions, reading, retrieval, seams, themes, training
from folioforge.session import table
from folioforge.streaming import inbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say it."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_HOST = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)', 1), '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
_CANON = """(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY (coalesce(body, '') = '')::INT, contains(coalesce(url, ''), '?')::INT, (NOT starts_with(coalesce(url, ''), 'https://'))::INT, length(coalesce(url, '')), article_id) AS rn FROM articles WHERE coalesce(slug, '') <> '') WHERE rn = 1 UNION ALL SELECT * FROM articles WHERE coalesce(slug, '') = '')"""
_YEAR = r"(CASE WHEN regexp_matches(left({0}, 4), '^\d{{4}}$') THEN left({0}, 4) END)"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("corpus_canonical", f"SELECT article_id, slug FROM {_CANON}")
def _(s, d):
    return corpus.canonical_entries(table(s, d, "articles")).select("article_id", "slug")


@query("corpus_collapsed", f"SELECT c.slug, k.url AS kept_url, c.n - 1 AS dropped FROM (SELECT slug, count(*) AS n FROM articles GROUP BY slug HAVING count(*) > 1) c JOIN {_CANON} k ON c.slug = k.slug WHERE coalesce(c.slug, '') <> ''")
def _(s, d):
    return corpus.collapsed_slugs(table(s, d, "articles"))


@query("corpus_audit", """SELECT 'slug' AS issue, slug AS value, count(*) AS n FROM articles WHERE coalesce(slug, '') <> '' GROUP BY slug HAVING count(*) > 1
 UNION ALL SELECT 'url', url, count(*) FROM articles WHERE coalesce(url, '') <> '' GROUP BY url HAVING count(*) > 1
 UNION ALL SELECT 'content', md5(body), count(*) FROM articles WHERE coalesce(body, '') <> '' GROUP BY md5(body) HAVING count(*) > 1
 UNION ALL SELECT 'no content', slug, count(*) FROM articles WHERE coalesce(body, '') = '' GROUP BY slug""")
def _(s, d):
    return corpus.audit(table(s, d, "articles"))


@query("content_hashes", "SELECT article_id, md5(coalesce(body, '')) AS content_hash FROM articles")
def _(s, d):
    return table(s, d, "articles").select("article_id", corpus.content_hash().alias("content_hash"))


@query("corpus_fingerprint", r"""WITH i AS (SELECT coalesce(slug, '') || ':' || md5(coalesce(body, '')) AS item, len(regexp_extract_all(coalesce(body, ''), '\S+')) AS w FROM articles),
 p AS (SELECT left(md5(item), 3) AS part, md5(string_agg(item, '|' ORDER BY item)) AS h, count(*) AS n, sum(w) AS w FROM i GROUP BY 1)
 SELECT md5(string_agg(h, '|' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS articles, sum(w)::BIGINT AS words FROM p""")
def _(s, d):
    return corpus.fingerprint(table(s, d, "articles"))


@query("corpus_composition", r"""WITH w AS (SELECT modality, authorship, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w FROM documents),
 t AS (SELECT 'modality' AS dimension, coalesce(modality, 'unknown') AS value, count(*) AS items, sum(w)::BIGINT AS words FROM w GROUP BY 2 UNION ALL SELECT 'authorship', coalesce(authorship, 'unknown'), count(*), sum(w)::BIGINT FROM w GROUP BY 2)
 SELECT dimension, value, items, words, words::DOUBLE / sum(words) OVER (PARTITION BY dimension)::DOUBLE AS share FROM t""")
def _(s, d):
    return corpus.composition(table(s, d, "documents"))


_KEYS = rf"""SELECT {_HOST} || '/' || regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 1) || '/' || regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 2) || '/' || regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 3) || '/' || regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 4) AS k,
 regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 1) || '-' || regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 2) AS month, coalesce(body, '') <> '' AS has FROM articles WHERE regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 4) <> ''"""


def _held(s, d):
    a = table(s, d, "articles")
    return a.where(F.coalesce("body", F.lit("")) != ""), a


@query("coverage_by_month", f"""WITH x AS ({_KEYS}), k AS (SELECT k, min(month) AS month, bool_or(has) AS held FROM x GROUP BY k)
 SELECT month, count(*) FILTER (held) AS have, count(*) AS discovered, count(*) FILTER (NOT held) AS missing FROM k GROUP BY month""")
def _(s, d):
    return corpus.coverage_by_month(*_held(s, d))


@query("coverage_gaps", f"""WITH x AS ({_KEYS}), k AS (SELECT k, min(month) AS month, bool_or(has) AS held FROM x GROUP BY k), m AS (SELECT DISTINCT month FROM k WHERE NOT held),
 r AS (SELECT month, left(month, 4)::INT * 12 + substr(month, 6, 2)::INT - row_number() OVER (ORDER BY month) AS run FROM m)
 SELECT CASE WHEN min(month) = max(month) THEN min(month) ELSE min(month) || '..' || max(month) END AS range FROM r GROUP BY run""")
def _(s, d):
    return corpus.month_ranges(corpus.coverage_by_month(*_held(s, d)).where("missing > 0"))


@query("url_keys", rf"""SELECT article_id, {_HOST} AS host, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) <> '' THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) || rtrim({_PATH}, '/') || '/' END AS normal_url,
 nullif(regexp_extract({_PATH}, '/(\d{{4}})/(\d{{2}})/(\d{{2}})/([^/]+)', 4), '') AS path_slug FROM articles""")
def _(s, d):
    return table(s, d, "articles").select("article_id", T.host_of("url").alias("host"), T.normal_url("url").alias("normal_url"), T.dated_url("url")["slug"].alias("path_slug"))


@query("title_forms", r"""SELECT article_id, left(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}\p{M}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 80) AS title_slug,
 array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') AS normal_title,
 CASE WHEN trim(rtrim(regexp_replace(title, '(?i)^(?:why|how|what|when|where|is|are|the|a|an)\s+', ''), '?')) <> '' THEN trim(rtrim(regexp_replace(title, '(?i)^(?:why|how|what|when|where|is|are|the|a|an)\s+', ''), '?')) ELSE title END AS topic FROM articles""")
def _(s, d):
    return table(s, d, "articles").select("article_id", T.slug("title").alias("title_slug"), T.normal_title("title").alias("normal_title"), T.topic_of("title").alias("topic"))


@query("dates", rf"""SELECT article_id, {_YEAR.format('date')} AS year, nullif(regexp_extract(date, '^(\d{{4}}-(?:0[1-9]|1[0-2]))', 1), '') AS month,
 CASE WHEN regexp_matches(date, '^\d{{4}}-(?:0[1-9]|1[0-2])') THEN left(date, 4) || '-Q' || ((substr(date, 6, 2)::INT + 2) // 3)::VARCHAR END AS quarter,
 CASE WHEN regexp_matches(trim(coalesce(date, '')), '^\d{{4}}-\d{{2}}-\d{{2}}') THEN 'exact' WHEN regexp_matches(trim(coalesce(date, '')), '^\d{{4}}$') THEN 'approximate' ELSE 'unknown' END AS confidence FROM articles""")
def _(s, d):
    return table(s, d, "articles").select("article_id", T.year_of("date").alias("year"), T.month_of("date").alias("month"), T.quarter_of("date").alias("quarter"), T.date_with_confidence("date")["confidence"].alias("confidence"))


def _canonical(c: str) -> str:
    n = _SQUEEZE.format(f"coalesce({c}, '')")
    p = f"(CASE WHEN trim(regexp_replace({n}, '[''’]s?$', '')) <> '' THEN trim(regexp_replace({n}, '[''’]s?$', '')) ELSE {n} END)"
    t = rf"trim(CASE WHEN regexp_replace({p}, '(?i)^the\s+', '') <> '' THEN regexp_replace({p}, '(?i)^the\s+', '') ELSE {p} END)"
    table_ = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ALIASES.items()) + "}"
    return f"coalesce({table_}[lower({t})], {t})"


_ONCE = "(SELECT slug, any_value(date) AS date, any_value(orgs) AS orgs, any_value(people) AS people FROM entity_records GROUP BY slug)"
_RAW = f"SELECT slug, unnest(orgs) AS e, 'org' AS type FROM {_ONCE} UNION ALL SELECT slug, unnest(people), 'person' FROM {_ONCE}"
_SEEN = f"SELECT slug, type || ':' || name AS id, name, type, sum(n)::BIGINT AS mentions FROM (SELECT slug, {_canonical('e.name')} AS name, type, e.count AS n FROM ({_RAW}) WHERE e.count >= 1) WHERE name <> '' AND lower(name) NOT IN {_in(entities.FURNITURE)} GROUP BY ALL"
_NODES = f"SELECT id, name, type, count(DISTINCT slug) AS article_count, sum(mentions)::BIGINT AS total_mentions FROM ({_SEEN}) GROUP BY ALL"
_EDGES = f"SELECT a.id AS source, b.id AS target, count(DISTINCT a.slug) AS weight FROM ({_SEEN}) a JOIN ({_SEEN}) b ON a.slug = b.slug AND a.id < b.id GROUP BY ALL"


def _seen(s, d):
    return entities.mentions(table(s, d, "entity_records"))


@query("entity_mentions", f"SELECT slug, id, mentions FROM ({_SEEN})")
def _(s, d):
    return _seen(s, d).select("slug", "id", "mentions")


@query("entity_nodes", _NODES)
def _(s, d):
    return entities.nodes(_seen(s, d))


@query("entity_edges", _EDGES)
def _(s, d):
    return entities.edges(_seen(s, d))


@query("entity_graph", f"""WITH n AS (SELECT * FROM ({_NODES}) ORDER BY article_count DESC, total_mentions DESC, id LIMIT 40), e AS (SELECT * FROM ({_EDGES}) WHERE weight >= 2 AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
 g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (id)""")
def _(s, d):
    return entities.graph(_seen(s, d))[0]


@query("entity_top_mentions", f"""WITH x AS (SELECT slug, 'org' AS type, orgs AS l FROM {_ONCE} UNION ALL SELECT slug, 'person', people FROM {_ONCE}), y AS (SELECT slug, type, l[i].name AS name, l[i].count AS count, i FROM (SELECT slug, type, l, unnest(range(1, len(l) + 1)) AS i FROM x))
 SELECT slug, type, name, count, place FROM (SELECT *, row_number() OVER (PARTITION BY slug, type ORDER BY count DESC, i, name) AS place FROM y WHERE name IS NOT NULL) WHERE place <= 10""")
def _(s, d):
    return entities.top_mentions(table(s, d, "entity_records"))


_TOK = "regexp_extract_all({0}, '[A-Za-z][A-Za-z''-]*')"
_TONE = f"""coalesce(list_sum([CASE WHEN NOT list_contains({_list(S.TONE_UP)}, w[i]) AND NOT list_contains({_list(S.TONE_DOWN)}, w[i]) THEN 0 ELSE (CASE WHEN list_contains({_list(S.TONE_UP)}, w[i]) THEN 1 ELSE -1 END) * (CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], {_list(S.NEGATORS)}) AND i > 1 THEN -1 ELSE 1 END) END for i in range(1, len(w) + 1)]), 0)"""


@query("sentence_tone", f"SELECT obs_id, observed_at, {_TONE}::INT AS tone, (len([x for x in v if list_contains({_list(S.VIEW_UP)}, lower(x))]) - len([x for x in v if list_contains({_list(S.VIEW_DOWN)}, lower(x))]))::INT AS \"view\" FROM (SELECT obs_id, observed_at, regexp_extract_all(lower(coalesce(sentence, '')), '[a-z][a-z'']*') AS w, {_TOK.format("coalesce(sentence, '')")} AS v FROM stance_observations)")
def _(s, d):
    return table(s, d, "stance_observations").select("obs_id", "observed_at", S.tone("sentence").alias("tone"), S.view("sentence").alias("view"))


_OBS = f"(SELECT obs_id, any_value(entity_id) AS entity_id, any_value(date) AS date, any_value(stance) AS stance, any_value(sentence) AS sentence, any_value(slug) AS slug, {_YEAR.format('any_value(date)')} AS year FROM stance_observations WHERE stance IS NOT NULL GROUP BY obs_id)"
_YEARLY = f"SELECT entity_id AS entity, year, sum(stance)::BIGINT AS stance_sum, count(*) AS n_sentences, count(DISTINCT slug) AS n_articles, sum(stance)::DOUBLE / count(*) AS mean_stance FROM {_OBS} WHERE year IS NOT NULL AND entity_id IS NOT NULL GROUP BY entity_id, year"
_BOARD = f"""SELECT entity, article_count, total_sentences, overall_stance, first_year, last_year, CASE WHEN first_year = last_year THEN 'steady' WHEN trend_delta >= 0.25 THEN 'warming' WHEN trend_delta <= -0.25 THEN 'cooling' ELSE 'steady' END AS trend, trend_delta FROM
 (SELECT entity, sum(n_sentences)::BIGINT AS total_sentences, sum(stance_sum)::DOUBLE / sum(n_sentences) AS overall_stance, min(year) AS first_year, max(year) AS last_year, round(max_by(mean_stance, year) - min_by(mean_stance, year), 4) AS trend_delta FROM ({_YEARLY}) GROUP BY entity)
 JOIN (SELECT entity_id AS entity, count(DISTINCT slug) AS article_count FROM {_OBS} WHERE year IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1) USING (entity) WHERE article_count >= 2"""


def _observed(s, d):
    return entities.observations(table(s, d, "stance_observations"))


@query("stance_by_year", _YEARLY)
def _(s, d):
    return entities.stance_by_year(_observed(s, d))


@query("stance_board", _BOARD)
def _(s, d):
    return entities.stance_board(_observed(s, d))


@query("stance_movers", f"SELECT trend, place, entity, trend_delta FROM (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY abs(trend_delta) DESC, entity) AS place FROM ({_BOARD}) WHERE trend <> 'steady') WHERE place <= 10")
def _(s, d):
    return entities.movers(entities.stance_board(_observed(s, d)))


@query("stance_reversals", f"""WITH h AS (SELECT entity_id AS entity, coalesce(date, '') AS date, stance, sentence, obs_id, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(date, ''), obs_id) AS pos, count(*) OVER (PARTITION BY entity_id) AS n FROM {_OBS} WHERE stance <> 0 AND entity_id IS NOT NULL),
 e AS (SELECT *, pos <= n // 2 AS early FROM h WHERE n >= 4), g AS (SELECT entity, any_value(n) AS n_observations, avg(stance) FILTER (early) AS es, avg(stance) FILTER (NOT early) AS ls,
 first(sentence ORDER BY -stance, date, obs_id) FILTER (early) AS eh, first(sentence ORDER BY stance, date, obs_id) FILTER (early) AS el, first(sentence ORDER BY -stance, date, obs_id) FILTER (NOT early) AS lh, first(sentence ORDER BY stance, date, obs_id) FILTER (NOT early) AS ll FROM e GROUP BY entity)
 SELECT entity, n_observations, round(es, 3) AS early_stance, round(ls, 3) AS late_stance, round(ls - es, 3) AS delta, CASE WHEN es > 0 THEN 'cooled' ELSE 'warmed' END AS direction, CASE WHEN es > 0 THEN eh ELSE el END AS early_sentence, CASE WHEN es > 0 THEN ll ELSE lh END AS late_sentence FROM g WHERE sign(es) * sign(ls) < 0 AND abs(ls - es) >= 1""")
def _(s, d):
    return entities.reversals(_observed(s, d))


_LOW = "(' ' || lower(s) || ' ')"
_QUOTE = " + ".join(["greatest(0.0, 1.0 - abs(len(w) - 14) / 14.0)", *(f"contains({_LOW}, ' {m} ')::INT" for m in T.APHORISTIC), *(f"-1.5 * contains({_LOW}, ' {m} ')::INT" for m in T.ATTRIBUTION), f"CASE WHEN contains({_LOW}, ' is ') OR contains({_LOW}, ' are ') THEN 0.75 ELSE 0 END", f"CASE WHEN contains({_LOW}, ' not ') OR contains({_LOW}, ' but ') OR contains({_LOW}, ' rather than ') THEN 0.5 ELSE 0 END", r"CASE WHEN regexp_matches(s, '\d') THEN -0.75 ELSE 0 END"])


@query("quotable_sentences", f"""WITH x AS (SELECT DISTINCT entity_id AS "group", sentence AS s FROM {_OBS}), y AS (SELECT "group", s, {_TOK.format("coalesce(s, '')")} AS w FROM x), z AS (SELECT "group", s AS sentence, round(({_QUOTE})::DOUBLE, 4) AS score FROM y
 WHERE regexp_matches(trim(s), '[.!]$') AND len(w) BETWEEN 8 AND 30 AND regexp_matches(trim(s), '^\\p{{Lu}}') AND NOT list_contains({_list(T.DEPENDENT_OPENERS)}, w[1]) AND {' AND '.join(f"NOT contains(lower(s), '{u}')" for u in T.URL_SIGNS)})
 SELECT * FROM (SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY score DESC, sentence) AS place, sentence, score, count(*) OVER (PARTITION BY "group") AS candidates FROM z WHERE score >= 0) WHERE place <= 10""")
def _(s, d):
    return entities.quotables(_observed(s, d))


@query("word_metrics", r"""SELECT doc_id, len(w)::INT AS word_count, len(list_distinct(w))::INT AS vocabulary_size, len(list_distinct(w))::DOUBLE / len(w) AS type_token_ratio, len(list_filter(map_values(list_histogram), lambda c: c = 1))::DOUBLE / len(list_distinct(w)) AS hapax_ratio
 FROM (SELECT doc_id, w, list_aggregate(w, 'histogram') AS list_histogram FROM (SELECT doc_id, [lower(x) for x in regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+') if regexp_matches(x, '^[A-Za-z]+$')] AS w FROM documents) WHERE len(w) > 0)""")
def _(s, d):
    return linguistic.document_metrics(table(s, d, "documents")).select("doc_id", "word_count", "vocabulary_size", "type_token_ratio", "hapax_ratio")


@query("document_metrics")
def _(s, d):
    return linguistic.document_metrics(table(s, d, "documents"))


_SPLIT = r"[trim(x) for x in string_split(regexp_replace(trim(coalesce({0}, '')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> '']"


@query("sentence_counts", f"SELECT doc_id, len({_SPLIT.format('text')})::INT AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.sentences("text")).alias("n"))


@query("sentence_lengths", f"""WITH n AS (SELECT len({_TOK.format('s')}) AS n FROM (SELECT unnest({_SPLIT.format('text')}) AS s FROM documents)), t AS (SELECT least(max(n), 100) // 5 * 5 AS top FROM n), b AS (SELECT unnest(range(0, top + 5, 5)) AS bin_start, top FROM t), c AS (SELECT least(n // 5 * 5, top) AS bin_start, count(*) AS k FROM n, t GROUP BY 1)
 SELECT bin_start::BIGINT AS bin_start, CASE WHEN bin_start < top THEN bin_start + 5 END::BIGINT AS bin_end, coalesce(k, 0)::BIGINT AS count FROM b LEFT JOIN c USING (bin_start)""")
def _(s, d):
    lengths = table(s, d, "documents").select(F.explode(T.sentences("text")).alias("s")).select(F.size(T.tokens("s")).alias("n"))
    return linguistic.length_histogram(lengths)


@query("distinctive_words", r"""WITH c AS (SELECT word, count(*) AS count FROM (SELECT unnest([x for x in regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') if regexp_matches(x, '^[a-z]{3,}$')]) AS word FROM documents) GROUP BY word), h AS (SELECT * FROM c ORDER BY count DESC, word LIMIT 500)
 SELECT word, count, count * 10000 / (SELECT sum(count) FROM c)::DOUBLE AS per_10k FROM h WHERE count >= 5 ORDER BY count DESC, word LIMIT 50""")
def _(s, d):
    return linguistic.distinctive_words(table(s, d, "documents"))


_ARC = f"""SELECT c.year, theme, count, total, round(count / total, 3) AS share, theme = top AS dominant, total < 0.5 * (SELECT median(total) FROM (SELECT sum(count) AS total FROM (SELECT {_YEAR.format('date')} AS year, section AS theme, count(*) AS count FROM articles WHERE section IS NOT NULL GROUP BY ALL) WHERE year IS NOT NULL GROUP BY year)) AS partial
 FROM (SELECT {_YEAR.format('date')} AS year, section AS theme, count(*) AS count FROM articles WHERE section IS NOT NULL GROUP BY ALL) c JOIN (SELECT year, sum(count)::BIGINT AS total, first(theme ORDER BY count DESC, theme) AS top FROM (SELECT {_YEAR.format('date')} AS year, section AS theme, count(*) AS count FROM articles WHERE section IS NOT NULL GROUP BY ALL) WHERE year IS NOT NULL GROUP BY year) y ON c.year = y.year"""


def _arc(s, d):
    return themes.arc(table(s, d, "articles"), theme="section")


@query("theme_arc", _ARC)
def _(s, d):
    return _arc(s, d)


_SHIFT = f"""WITH a AS ({_ARC}), o AS (SELECT year AS to_year, lag(year) OVER (ORDER BY year) AS from_year FROM (SELECT DISTINCT year FROM a)), p AS (SELECT from_year, to_year, theme FROM o JOIN a ON a.year IN (from_year, to_year) WHERE from_year IS NOT NULL GROUP BY ALL),
 x AS (SELECT p.*, coalesce(b.share, 0.0) AS from_share, coalesce(n.share, 0.0) AS to_share FROM p LEFT JOIN a b ON b.year = from_year AND b.theme = p.theme LEFT JOIN a n ON n.year = to_year AND n.theme = p.theme)
 SELECT *, round(to_share - from_share, 3) AS delta, CASE WHEN from_share = 0 AND to_share > 0 THEN 'emergent' WHEN from_share > 0 AND to_share = 0 THEN 'vanished' WHEN round(to_share - from_share, 3) > 0 THEN 'rising' WHEN round(to_share - from_share, 3) < 0 THEN 'fading' ELSE 'same' END AS change FROM x"""


@query("theme_shifts", _SHIFT)
def _(s, d):
    return themes.shifts(_arc(s, d))


@query("theme_overall", f"""WITH a AS ({_ARC}), f AS (SELECT * FROM a WHERE NOT partial), e AS (SELECT min(year) AS first_year, max(year) AS last_year FROM f),
 m AS (SELECT theme, round(coalesce(max(share) FILTER (year = last_year), 0) - coalesce(max(share) FILTER (year = first_year), 0), 3) AS d, greatest(coalesce(max(share) FILTER (year = last_year), 0), coalesce(max(share) FILTER (year = first_year), 0)) AS s FROM f, e GROUP BY theme)
 SELECT (SELECT count(DISTINCT year) FROM a) AS n_years, (SELECT sum(count) FROM a)::BIGINT AS n_articles, first_year, last_year, (SELECT first(theme ORDER BY d DESC, theme) FROM m WHERE s > 0) AS most_grown, (SELECT first(theme ORDER BY d, theme) FROM m WHERE s > 0) AS most_declined,
 (SELECT max(theme) FROM f WHERE dominant AND year = first_year) AS first_dominant, (SELECT max(theme) FROM f WHERE dominant AND year = last_year) AS last_dominant FROM e""")
def _(s, d):
    return themes.overall(_arc(s, d))


@query("theme_timeline", r"""WITH x AS (SELECT left(date, 4) || '-Q' || ((substr(date, 6, 2)::INT + 2) // 3)::VARCHAR AS quarter, section AS theme, count(*) AS n FROM articles WHERE regexp_matches(date, '^\d{4}-(?:0[1-9]|1[0-2])') AND section IS NOT NULL GROUP BY ALL)
 SELECT q.quarter, t.theme, coalesce(n, 0) AS count FROM (SELECT DISTINCT quarter FROM x) q CROSS JOIN (SELECT DISTINCT theme FROM x) t LEFT JOIN x ON x.quarter = q.quarter AND x.theme = t.theme""")
def _(s, d):
    return themes.timeline(table(s, d, "articles"), theme="section")


@query("signature_pieces", "SELECT coalesce(section, '') AS theme, count(*) AS count, first(slug ORDER BY coalesce(word_count, 0) DESC, date, slug) AS slug, max(coalesce(word_count, 0)) AS words FROM articles WHERE coalesce(date, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return themes.signature_pieces(table(s, d, "articles"), theme="section")


@query("corpus_span", "SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS count FROM articles WHERE coalesce(date, '') <> ''")
def _(s, d):
    return themes.span(table(s, d, "articles"))


@query("year_digest", "SELECT 2021 AS year, count(*) AS article_count, coalesce(sum(word_count), 0)::BIGINT AS total_words FROM articles WHERE left(date, 4) = '2021'")
def _(s, d):
    return themes.year_digest(table(s, d, "articles"), 2021)


def _hits(s, d):
    e = table(s, d, "embeddings")
    return retrieval.search(e, e.where("vec_id % 50 = 0"), top=10)


_UNIT = "(SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings)"
_SIM = f"SELECT q.vec_id AS query, c.vec_id AS key, c.label = q.label AS good, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) / (sqrt(list_sum([x * x for x in q.v])) * sqrt(list_sum([x * x for x in c.v]))) AS score FROM {_UNIT} q, {_UNIT} c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id"
_TOP = f"SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank, key, score, good FROM ({_SIM}) QUALIFY rank <= 10"


@query("vector_search", f"SELECT query, rank, key, round(score, 6) AS score FROM ({_TOP})")
def _(s, d):
    return _hits(s, d).withColumn("score", F.round("score", 6))


@query("retrieval_metrics", f"""SELECT n.query, coalesce(found, 0)::DOUBLE / coalesce(k, 1) AS precision, coalesce(found, 0)::DOUBLE / n_relevant AS recall, coalesce(1.0 / first, 0)::DOUBLE AS reciprocal_rank FROM
 (SELECT q.vec_id AS query, count(*) AS n_relevant FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1) n LEFT JOIN (SELECT query, count(*) FILTER (rank <= 5) AS k, count(*) FILTER (rank <= 5 AND good) AS found, min(rank) FILTER (good) AS first FROM ({_TOP}) GROUP BY query) h ON n.query = h.query""")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    wanted = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label").join(e, "label").where("vec_id <> query").select("query", F.col("vec_id").alias("key"))
    return retrieval.ranking_metrics(_hits(s, d), wanted)


_PARA = r"[regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') for x in regexp_split_to_array(coalesce(body, ''), '\n\s*\n') if regexp_replace(x, '^\s+|\s+$', '', 'g') <> '']"


@query("repeated_paragraphs", f"SELECT md5(p) AS paragraph, count(DISTINCT article_id) AS articles FROM (SELECT article_id, unnest({_PARA}) AS p FROM articles) GROUP BY p HAVING count(DISTINCT article_id) >= 3")
def _(s, d):
    return training.repeated_paragraphs(table(s, d, "articles")).withColumn("paragraph", F.md5("paragraph"))


@query("bodies_without_repeats")
def _(s, d):
    a = table(s, d, "articles")
    return training.without_paragraphs(a, training.repeated_paragraphs(a))


@query("chat_records")
def _(s, d):
    return training.chat_records(corpus.canonical_entries(table(s, d, "articles"))).select("slug", "index", "shape", "messages")


_BUCKET = "((('0x' || left(md5(slug), 16))::UBIGINT::HUGEINT % 1000 * 616 + ('0x' || right(md5(slug), 16))::UBIGINT::HUGEINT % 1000) % 1000)"


@query("article_split", f"SELECT slug, CASE WHEN {_BUCKET} < 150 THEN 'heldout' ELSE 'train' END AS part FROM (SELECT DISTINCT slug FROM articles WHERE slug IS NOT NULL) WHERE slug NOT IN (SELECT a.slug FROM (SELECT DISTINCT slug, array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') AS n FROM articles WHERE slug IS NOT NULL) a JOIN (SELECT array_to_string(regexp_extract_all(lower(concat_ws(' ', topic_hint, question)), '[a-z0-9]+'), ' ') AS h FROM eval_items) q ON contains(h, n) WHERE len(string_split(n, ' ')) >= 3)")
def _(s, d):
    a = table(s, d, "articles")
    return training.split(a, excluded=training.grounded(a, table(s, d, "eval_items")))


@query("grounded_articles", "SELECT DISTINCT a.slug FROM (SELECT DISTINCT slug, array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') AS n FROM articles WHERE slug IS NOT NULL) a JOIN (SELECT array_to_string(regexp_extract_all(lower(concat_ws(' ', topic_hint, question)), '[a-z0-9]+'), ' ') AS h FROM eval_items) q ON contains(h, n) WHERE len(string_split(n, ' ')) >= 3")
def _(s, d):
    return training.grounded(table(s, d, "articles"), table(s, d, "eval_items")).where("slug is not null")


@query("length_budget", """WITH t AS (SELECT length(coalesce(text, '')) / 4.0 AS t FROM documents), s AS (SELECT count(*) AS n, count(*) FILTER (t > 1024) AS n_over, max(t) AS m, median(t) AS med FROM t), o AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM t)
 SELECT n, n_over, round(100.0 * n_over / n, 1)::DOUBLE AS pct_over, floor(m)::BIGINT AS max_tokens, floor(med)::BIGINT AS median_tokens, floor(t)::BIGINT AS p95_tokens, (CASE WHEN floor(t) <= 1 THEN 1 ELSE pow(2, ceil(log2(floor(t)))) END)::BIGINT AS suggested FROM s JOIN o ON o.r = greatest(1, round_even(n * 0.95, 0))::BIGINT""")
def _(s, d):
    docs = table(s, d, "documents").select(F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return training.length_budget(docs, 1024)


@query("reading_list", f"""WITH h AS (SELECT slug, first(struct_pack(title, date, word_count) ORDER BY date DESC, article_id) AS a FROM articles WHERE coalesce(date, '') <> '' AND coalesce(trim(body), '') <> '' AND coalesce(slug, '') <> '' GROUP BY slug), t AS (SELECT slug, a.title AS title, a.date AS date, a.word_count AS word_count FROM h ORDER BY a.date DESC, slug DESC LIMIT 200)
 SELECT row_number() OVER w AS place, slug, title, date, word_count, (CASE WHEN coalesce(word_count, 0) <= 0 THEN 0 ELSE greatest(1, ceil(word_count / 200)) END)::INT AS minutes, lead(slug) OVER w AS prev_slug, lag(slug) OVER w AS next_slug FROM t WINDOW w AS (ORDER BY date DESC, slug DESC)""")
def _(s, d):
    return reading.reading_list(table(s, d, "articles"))


@query("queue_counts", "SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM extract_results GROUP BY 1")
def _(s, d):
    return reading.queue_counts(table(s, d, "extract_results"))


@query("new_files", "SELECT extract_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY staged_at NULLS FIRST, extract_id) AS rn FROM extract_results) WHERE rn = 1 AND content_hash NOT IN (SELECT content_hash FROM extract_results WHERE status = 'rejected' AND content_hash IS NOT NULL)")
def _(s, d):
    e = table(s, d, "extract_results")
    return reading.new_files(e, e.where("status = 'rejected'")).select("extract_id")


@query("item_views", r"SELECT extract_id, original, status, len(coalesce(documents, []))::INT AS n_documents, left(trim(regexp_replace(coalesce(documents[1].text, ''), '\s+', ' ', 'g')), 400) AS preview FROM extract_results")
def _(s, d):
    return reading.item_views(table(s, d, "extract_results"))


@query("chapter_reasons", r"SELECT extract_id, x.ordinal AS ordinal, CASE WHEN lower(trim(coalesce(x.title, ''))) IN ('cover', 'title page', 'copyright', 'contents', 'table of contents', 'dedication', 'acknowledgments', 'index') THEN 'title' WHEN length(coalesce(x.text, '')) < 500 THEN 'short' ELSE '' END AS reason FROM (SELECT extract_id, unnest(documents) AS x FROM extract_results)")
def _(s, d):
    return table(s, d, "extract_results").select("extract_id", F.explode("documents").alias("x")).select("extract_id", "x.ordinal", T.front_matter_reason("x.title", "x.text").alias("reason"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return inbox.windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 4))


@query("theme_clusters")
def _(s, d):
    return themes.cluster(table(s, d, "documents"))[1]


_NAMED = f"SELECT type, name, sum(n)::BIGINT AS count, count(DISTINCT slug) AS article_count FROM (SELECT slug, type, {_canonical('e.name').replace('MAP {' + ', '.join(f"'{k}': '{v}'" for k, v in T.ALIASES.items()) + '}', "MAP {'': ''}")} AS name, e.count AS n FROM ({_RAW}) WHERE e.count >= 1) WHERE name <> '' GROUP BY ALL"


@query("entity_totals", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY count DESC, article_count DESC, name) AS place FROM ({_NAMED}) WHERE count >= CASE WHEN type = 'org' THEN 3 ELSE 2 END) WHERE place <= 50")
def _(s, d):
    return entities.entity_totals(table(s, d, "entity_records"))


@query("top_themes", "SELECT coalesce(section, '') AS theme, count(*) AS count FROM articles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return themes.top_themes(table(s, d, "articles"), theme="section")


@query("tone_by_article", f"SELECT slug, avg(t)::DOUBLE AS mean_tone, count(*) AS n FROM (SELECT slug, {_TONE} AS t FROM (SELECT slug, regexp_extract_all(lower(coalesce(sentence, '')), '[a-z][a-z'']*') AS w FROM {_OBS})) GROUP BY slug")
def _(s, d):
    return _observed(s, d).groupBy("slug").agg(F.avg(S.tone("sentence")).alias("mean_tone"), F.count("*").alias("n"))


@query("mention_sentences")
def _(s, d):
    bodies = corpus.canonical_entries(table(s, d, "articles"))
    return entities.mention_sentences(bodies, entities.mentions(table(s, d, "entity_records"), aliases={}))


@query("clean_bodies")
def _(s, d):
    return table(s, d, "articles").select("article_id", cleaning.clean("body").alias("text"))


@query("document_style")
def _(s, d):
    return table(s, d, "documents").select("doc_id", linguistic.style(F.col("text"), ("ledger", "tariff", "dividend")).alias("s")).select("doc_id", "s.*")


@query("ranking_agreement")
def _(s, d):
    e = table(s, d, "embeddings")
    half = e.withColumn("embedding", F.slice("embedding", 1, 32))
    ranked = lambda v: retrieval.search(v, v.where("vec_id % 50 = 0"), top=10).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("ranking"))
    return evaluation.agreement(ranked(e), ranked(half))


@query("recognised_entities")
def _(s, d):
    return seams.recognise(corpus.canonical_entries(table(s, d, "articles")))


@query("hashed_vectors")
def _(s, d):
    return seams.embed(table(s, d, "documents"), key="doc_id", text="text")


# Claims, judged answers and blind trials are made of the columns of the test tables, so that the operators run over whole tables.
def _claims(s, d):
    o = table(s, d, "stance_observations").groupBy("obs_id").agg(*(F.min(c).alias(c) for c in ("sentence", "slug", "date", "stance")))
    told = lambda c: F.when(F.col("stance") > 0, "vindicated").when(F.col("stance") < 0, "wrong").when(c, "mixed")
    return o.select(
        F.col("obs_id").alias("_pos"), F.col("sentence").alias("claim"), F.col("slug").alias("article_slug"), F.lit("").alias("article_title"), F.col("date").alias("article_date"), F.when(F.col("obs_id") % 2 == 0, told(F.lit(False))).alias("human_verdict"),
        F.when(F.col("obs_id") % 3 == 0, told(F.lit(True))).alias("evidence_verdict"), F.when(F.col("obs_id") % 5 == 0, told(F.lit(True))).alias("llm_verdict"), F.lit("").alias("status"), F.element_at(F.array(*map(F.lit, predictions.CONFIDENCE)), (F.col("obs_id") % 3 + 1).cast("int")).alias("confidence_language"),
    )


_TOLD = "CASE WHEN stance > 0 THEN 'vindicated' WHEN stance < 0 THEN 'wrong' WHEN {0} THEN 'mixed' END"
_CLAIMS = f"""claims AS (SELECT obs_id AS _pos, sentence AS claim, slug, coalesce(CASE WHEN obs_id % 2 = 0 THEN {_TOLD.format('false')} END, CASE WHEN obs_id % 3 = 0 THEN {_TOLD.format('true')} END, CASE WHEN obs_id % 5 = 0 THEN {_TOLD.format('true')} END, 'pending') AS verdict,
 ['certain', 'confident', 'hedged'][obs_id % 3 + 1] AS confidence FROM (SELECT obs_id, min(sentence) AS sentence, min(slug) AS slug, min(stance) AS stance FROM stance_observations GROUP BY obs_id))"""


@query("prediction_tally", f"WITH {_CLAIMS} SELECT confidence AS confidence_language, verdict, count(*) AS n FROM claims GROUP BY ALL")
def _(s, d):
    return predictions.tally(_claims(s, d), verdict_column=predictions.verdict(), by=("confidence_language",))


@query("prediction_calibration", f"""WITH {_CLAIMS}, t AS (SELECT confidence, count(*) FILTER (verdict = 'vindicated') AS vindicated, count(*) FILTER (verdict = 'mixed') AS mixed, count(*) FILTER (verdict = 'wrong') AS wrong FROM claims GROUP BY confidence)
 SELECT *, vindicated + mixed + wrong AS resolved, round((vindicated + 0.5::DOUBLE * mixed) / (vindicated + mixed + wrong), 3) AS accuracy FROM t""")
def _(s, d):
    return predictions.calibration(_claims(s, d), verdict_column=predictions.verdict())


@query("conviction_board", f"WITH {_CLAIMS} SELECT _pos, claim, confidence AS confidence_language FROM claims WHERE verdict = 'wrong' AND confidence <> 'hedged' ORDER BY confidence, _pos LIMIT 5")
def _(s, d):
    return predictions.conviction_board(_claims(s, d), "wrong").select("_pos", "claim", "confidence_language")


@query("open_claims", f"WITH {_CLAIMS} SELECT _pos FROM claims JOIN (SELECT obs_id, min(stance) AS stance FROM stance_observations GROUP BY obs_id) ON obs_id = _pos WHERE NOT (_pos % 2 = 0 AND stance IS NOT NULL AND stance <> 0)")
def _(s, d):
    return predictions.open_claims(_claims(s, d)).select("_pos")


@query("notable_claims")
def _(s, d):
    return predictions.notable(_claims(s, d))


@query("faithfulness_rates", """WITH q AS (SELECT coalesce(answerable, false) AS a, item_id % 7 AS t, least(item_id % 5, item_id % 7) AS g, item_id % 3 = 0 AS shy, coalesce(topic_hint, '') <> '' AS cited FROM eval_items),
 c AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, sum(t) FILTER (a) AS t, sum(g) FILTER (a) AS g, count(*) FILTER (NOT a AND shy) AS s, count(*) FILTER (a AND shy) AS f, count(*) FILTER (a AND cited) AS c FROM q)
 SELECT n AS n_questions, na AS n_answerable, round(g::DOUBLE / t, 4) AS grounding_rate, round(1 - round(g::DOUBLE / t, 4), 4) AS hallucination_rate, round(s::DOUBLE / (n - na), 4) AS abstention_accuracy, round(f::DOUBLE / na, 4) AS false_abstention_rate, round(c::DOUBLE / na, 4) AS citation_coverage FROM c""")
def _(s, d):
    i = F.col("item_id")
    judged = table(s, d, "eval_items").select("answerable", (i % 7).cast("int").alias("claims_total"), (i % 5).cast("int").alias("claims_grounded"), (i % 3 == 0).alias("abstained"), (F.coalesce("topic_hint", F.lit("")) != "").alias("cited"))
    return predictions.faithfulness(judged)


def _trials(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("trial"), F.when(F.col("item_id") % 3 == 0, F.array(*map(F.lit, ("real", "tuned", "plain")))).when(F.col("item_id") % 3 == 1, F.array(*map(F.lit, ("tuned", "real", "plain")))).otherwise(F.array(*map(F.lit, ("real", "plain", "tuned")))).alias("ranking"))


_TRIALS = "trials AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN ['real', 'tuned', 'plain'] WHEN 1 THEN ['tuned', 'real', 'plain'] ELSE ['real', 'plain', 'tuned'] END AS r FROM eval_items), places AS (SELECT item_id, unnest(r) AS source, unnest([1, 2, 3]) AS place FROM trials)"


@query("trial_win_rates", f"WITH {_TRIALS} SELECT source, count(*) FILTER (place = 1) AS wins, count(*) AS appearances, count(*) FILTER (place = 1) / count(*) AS win_rate, avg(place) AS avg_rank FROM places GROUP BY source")
def _(s, d):
    return predictions.win_rates(_trials(s, d))


@query("trial_head_to_head", f"WITH {_TRIALS} SELECT a.source AS better, b.source AS worse, count(*) AS n FROM places a JOIN places b ON a.item_id = b.item_id AND a.place < b.place GROUP BY ALL")
def _(s, d):
    return predictions.head_to_head(_trials(s, d))


@query("stance_from_bodies")
def _(s, d):
    """Sentences of bodies that mention an entity, scored by tone, and the mean of each entity and year."""
    bodies = corpus.canonical_entries(table(s, d, "articles"))
    said = entities.mention_sentences(bodies, entities.mentions(table(s, d, "entity_records"), aliases={}))
    return said.withColumn("tone", S.tone("sentence")).groupBy(*[c for c in ("id", "name") if c in said.columns]).agg(F.avg("tone").alias("mean_tone"), F.count("*").alias("sentences"), F.count_distinct("slug").alias("articles"))
