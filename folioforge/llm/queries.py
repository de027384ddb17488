"""Registered queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import leak, mail, mixing, names, pages, pieces, quality
from folioforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: pages.lines_outside(table(s, d, "articles")),
    "p1_main_text": lambda s, d: pages.main_text(table(s, d, "articles")),
    "p2_found": lambda s, d: pages.residue_found(table(s, d, "articles")),
    "p2_messages": lambda s, d: pages.residue_messages(pages.read_pages(table(s, d, "articles"), sketched=False)),
    "p3_found": lambda s, d: mail.lines_not_new(table(s, d, "extract_results")),
    "p3_new_text": lambda s, d: mail.new_text(table(s, d, "extract_results")),
    "p4_found": lambda s, d: names.same_entity(table(s, d, "entity_stance")),
    "p4_entities": lambda s, d: names.entities(table(s, d, "entity_stance")),
    "p5_found": lambda s, d: pieces.oversized(table(s, d, "articles")),
    "p5_pieces": lambda s, d: pieces.pieces(table(s, d, "articles")),
    "p5_cover": lambda s, d: pieces.cover(table(s, d, "articles")),
    "p6_found": lambda s, d: pages.repeated_lines(table(s, d, "articles"), unit="articles").select("article_id", "line_no"),
    "p6_lines": lambda s, d: pages.repeated_lines(table(s, d, "articles")),
    "p6_bodies": lambda s, d: pages.bodies_without_repeats(table(s, d, "articles"), unit="articles"),
    "p6_cluster_bodies": lambda s, d: pages.bodies_without_repeats(table(s, d, "articles")),
    "p7_found": lambda s, d: leak.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id"),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_million": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets"), total_tokens=1_000_000.0),
    "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: quality.not_prose(table(s, d, "documents"), table(s, d, "doc_labels")),
    "p9_statistics": lambda s, d: quality.verdicts(table(s, d, "documents"), table(s, d, "doc_labels")),
}

ORACLE: dict[str, str] = {
    "p5_cover": r"SELECT article_id, CAST(len(regexp_extract_all(body, '[^ \t\n]+')) AS BIGINT) AS words, true AS same, true AS within FROM articles WHERE regexp_matches(body, '[^ \t\n]')",
    "p5_found": r"SELECT article_id FROM articles WHERE len(regexp_extract_all(body, '[^ \t\n]+')) > 800",
}
