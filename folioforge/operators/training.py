"""Preparing training records: repeated paragraphs, passages, chat records, splits and checks before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import scores as S
from folioforge.functions import text as T

SHAPES = ("write-on-topic", "continue-passage", "respond-to-claim")


def repeated_paragraphs(articles: DataFrame, *, key: str = "article_id", body: str = "body", least: int = 3) -> DataFrame:
    """(paragraph, articles): paragraphs, white space apart, that stand in ``least`` different articles."""
    each = articles.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.transform(T.paragraphs(body), lambda p: T.squeeze(p)))).alias("paragraph"))
    return each.groupBy("paragraph").agg(F.count_distinct("k").alias("articles")).where(F.col("articles") >= least)


def without_paragraphs(articles: DataFrame, repeated: DataFrame, *, key: str = "article_id", body: str = "body") -> DataFrame:
    """(key, body): bodies without the repeated paragraphs, the others in order; "" when nothing is left."""
    each = articles.select(key, F.posexplode(T.paragraphs(body)).alias("at", "p")).withColumn("paragraph", T.squeeze("p"))
    kept = each.join(repeated.select("paragraph"), "paragraph", "left_anti").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]), "\n\n").alias("_kept"))
    return articles.select(key).join(kept, key, "left").select(key, F.coalesce("_kept", F.lit("")).alias("body"))


def windows(text: str | Column, *, tokens: int = 3000, overlap: int = 200) -> Column:
    """array<string>: windows of four characters a token, each ended behind the last period of its back half and begun ``overlap`` tokens before the end of the one before.

    A text within one window is the only one. The cursor is a fold over as many steps as there can be windows.
    """
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    most = tokens * 4
    back = min(overlap * 4, most // 2)
    least_step = max(1, most // 2 - back)
    steps = F.sequence(F.lit(1), F.ceil(F.length(t) / least_step).cast("int") + 1)

    def step(state: Column, _: Column) -> Column:
        start = state["start"]
        part = F.substring(t, start + 1, F.lit(most))
        rear = F.substring(part, F.lit(most // 2 + 1), F.lit(most))
        behind = F.length(rear) - F.instr(F.reverse(rear), ".") + 1
        whole = start + most >= F.length(t)
        end = F.when(~whole & (F.instr(rear, ".") > 0), start + most // 2 + behind).otherwise(start + most)
        done = start >= F.length(t)
        return F.struct(
            F.when(done, start).otherwise(end - back).cast("int").alias("start"),
            F.when(done, state["out"]).otherwise(F.concat(state["out"], F.array(F.trim(F.substring(t, start + 1, (end - start).cast("int")))))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))
    return F.when(F.length(t) <= most, F.array(t)).otherwise(F.aggregate(steps, zero, step)["out"])


def passages(body: str | Column, most: int) -> Column:
    """array<string>: whole paragraphs packed in order up to ``most`` characters; a longer paragraph is cut by ``windows`` without overlap."""
    parts = F.flatten(F.transform(T.paragraphs(body), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.filter(windows(p, tokens=max(most // 4, 1), overlap=0), lambda c: c != ""))))

    def pack(state: Column, p: Column) -> Column:
        fits = (state["now"] != "") & (F.length(state["now"]) + 2 + F.length(p) <= most)
        return F.struct(
            F.when(fits | (state["now"] == ""), state["out"]).otherwise(F.concat(state["out"], F.array(state["now"]))).alias("out"),
            F.when(fits, F.concat(state["now"], F.lit("\n\n"), p)).otherwise(p).alias("now"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    return F.aggregate(parts, zero, pack, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))


def hash_part(slug: str | Column, parts: int) -> Column:
    """The 128-bit MD5 of a string modulo ``parts``, from its two halves."""
    h = F.md5(F.col(slug) if isinstance(slug, str) else slug)
    half = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)")
    return ((half(1) % parts * F.lit(2**64 % parts) + half(17) % parts) % parts).cast("int")


def shape_of(slug: str | Column, index: Column) -> Column:
    """The task shape of an article's index-th passage; shapes take turns from a place that depends on the slug."""
    s = F.coalesce(F.col(slug) if isinstance(slug, str) else slug, F.lit(""))
    offset = F.when(s == "", 0).otherwise(hash_part(s, len(SHAPES)))
    return F.get(F.array(*[F.lit(x) for x in SHAPES]), (offset + index) % len(SHAPES))


def chat_records(articles: DataFrame, *, slug: str = "slug", title: str = "title", body: str = "body", system: str = "You write clear analysis in the first person.", most: int = 3891) -> DataFrame:
    """(slug, index, shape, messages): each article's passages as chat records within ``most`` characters, over its whole body.

    Two of the shapes give the passage's first sentence to the user; a passage of one sentence is written on its topic.
    """
    t = T.topic_of(F.coalesce(F.col(title), F.lit("")))
    room = max(200, most - len(system) - 200)
    each = articles.select(F.col(slug).alias("slug"), t.alias("topic"), F.posexplode(passages(body, room)).alias("index", "passage"))
    parts = F.split("passage", r"(?<=[.!?])\s+(?=[\"“'A-Z0-9])", 2)
    lead, rest = F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    given = F.when(rest == "", SHAPES[0]).otherwise(shape_of("slug", F.col("index")))
    cut = each.withColumn("shape", given).withColumn("lead", lead).withColumn("rest", rest)
    user = (
        F.when(F.col("shape") == SHAPES[0], F.concat(F.lit("Write an analysis of "), "topic", F.lit(".")))
        .when(F.col("shape") == SHAPES[1], F.concat(F.lit("Continue this passage from your analysis of "), "topic", F.lit(":\n\n"), "lead"))
        .otherwise(F.concat(F.lit("On the subject of "), "topic", F.lit(", respond to this claim:\n\n“"), "lead", F.lit("”")))
    )
    said = F.when(F.col("shape") == SHAPES[0], F.trim("passage")).otherwise(F.col("rest"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return cut.select("slug", "index", "shape", F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", said)).alias("messages"))


def grounded(articles: DataFrame, questions: DataFrame, *, slug: str = "slug", title: str = "title") -> DataFrame:
    """(slug): articles whose normal title of three tokens or more stands in a question's hint or text.

    Titles are joined on the token triples of questions, then compared whole; no article meets every question.
    """
    triples = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.array_join(F.slice(c, i + 1, 3), " "))
    asked = questions.select(T.normal_title(F.concat_ws(" ", "topic_hint", "question")).alias("hay")).distinct().withColumn("w", F.split("hay", " ")).where(F.size("w") >= 3)
    keys = asked.select("hay", F.explode(F.array_distinct(triples(F.col("w")))).alias("head"))
    own = articles.select(F.col(slug).alias("slug"), T.normal_title(title).alias("needle")).withColumn("w", F.split("needle", " ")).where(F.size("w") >= 3).withColumn("head", F.array_join(F.slice("w", 1, 3), " "))
    return own.join(keys, "head").where(F.col("hay").contains(F.col("needle"))).select("slug").distinct()


def split(slugs: DataFrame, *, slug: str = "slug", held_out: float = 0.15, excluded: DataFrame | None = None) -> DataFrame:
    """(slug, part): "heldout" for slugs whose hash falls into the first part of a thousand, else "train"; excluded ones are in neither."""
    own = slugs.select(F.col(slug).alias("slug")).where("slug is not null").distinct()
    if excluded is not None:
        own = own.join(excluded.select("slug"), "slug", "left_anti")
    return own.withColumn("part", F.when(hash_part("slug", 1000) < held_out * 1000, "heldout").otherwise("train"))


def shape_errors(messages: str | Column) -> Column:
    """array<string>: what a chat record lacks; the last turn of a role counts."""
    m = F.coalesce(F.col(messages) if isinstance(messages, str) else messages, F.array().cast("array<struct<role:string,content:string>>"))

    def of(role: str) -> Column:
        own = F.filter(m, lambda x: x["role"] == role)
        last = F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))
        return F.when(F.size(own) == 0, f"missing {role} turn").when(F.trim(last) == "", f"empty {role} content")

    return F.when(F.size(m) == 0, F.array(F.lit("no messages"))).otherwise(F.array_compact(F.array(of("system"), of("user"), of("assistant"))))


def turn_of(messages: str | Column, role: str) -> Column:
    """The content of a role's first turn; null where there is none."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.try_element_at(F.filter(m, lambda x: x["role"] == role), F.lit(1))["content"]


def leaked_records(train: DataFrame, valid: DataFrame) -> DataFrame:
    """(hash, prompt): held-out records whose assistant text also stands in the training set, each text once."""
    h = lambda df: df.select(F.sha1(F.coalesce(turn_of("messages", "assistant"), F.lit(""))).alias("hash"), F.coalesce(turn_of("messages", "user"), F.lit("(no prompt)")).alias("prompt"))
    return h(valid).groupBy("hash").agg(F.min("prompt").alias("prompt")).join(h(train).select("hash").distinct(), "hash", "left_semi")


def length_budget(records: DataFrame, most: int, *, chars: str | Column = "chars", per_token: int = 4) -> DataFrame:
    """(n, n_over, pct_over, max_tokens, median_tokens, p95_tokens, suggested): estimated lengths of records against a sequence length.

    Lengths are counted by value first, so the percentiles come from distinct lengths and not from all rows.
    """
    c = F.col(chars) if isinstance(chars, str) else chars
    by = records.select((c / per_token).alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    stats = by.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("t") > most, F.col("k"))), F.lit(0)).alias("n_over"), F.max("t").alias("m"),
        F.percentile("t", F.lit(0.5), F.col("k")).alias("med"),
    )
    rank = F.greatest(F.lit(1), F.bround(F.col("n") * 0.95, 0)).cast("long")
    reach = by.selectExpr("t", "sum(k) over (order by t) as upto")
    p95 = reach.crossJoin(F.broadcast(stats.select(rank.alias("rank")))).where("upto >= rank").agg(F.floor(F.min("t")).alias("p95_tokens"))
    share = F.coalesce(F.round(F.try_divide(100.0 * F.col("n_over"), F.col("n")), 1), F.lit(0.0))
    whole = lambda x: F.coalesce(F.floor(x), F.lit(0)).cast("long")
    return stats.crossJoin(p95).select("n", "n_over", share.alias("pct_over"), whole(F.col("m")).alias("max_tokens"), whole(F.col("med")).alias("median_tokens"), F.coalesce("p95_tokens", F.lit(0)).cast("long").alias("p95_tokens"), S.next_power("p95_tokens").alias("suggested"))
