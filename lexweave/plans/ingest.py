"""Documents to tables: parse, merge, analyse and link, in stages that can be run one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..operators import articles, graph, index, keywords, reports
from ..sources import files
from ..functions.text import citations, terms

STAGES = ("parse", "merge", "structure", "keywords")


def chosen_stages(wanted: str | None) -> list[str]:
    """Stages named by number or name and separated by commas; what is neither is passed over."""
    if not wanted:
        return list(STAGES)
    picked = []
    for token in (t.strip() for t in wanted.split(",")):
        if token.isdigit() and 1 <= int(token) <= len(STAGES):
            picked.append(STAGES[int(token) - 1])
        elif token in STAGES:
            picked.append(token)
    return [s for s in STAGES if s in picked]


@dataclass(frozen=True)
class Structure:
    """Articles with their meaning and place, structural nodes, and references between articles."""

    articles: DataFrame
    nodes: DataFrame
    edges: DataFrame


def merge(parsed: DataFrame) -> DataFrame:
    """Articles of both languages side by side, from parsed files of all codes at once."""
    fields = ["title", "section", "chapter", "paragraph", "hierarchy", "context"]
    side = lambda x: parsed.where(F.col("lang") == x).select("code", "number", "id", F.col("article_pos").alias("pos"), *fields)
    return articles.merge_languages(side("ru"), side("kz"), "number", fields, ["code"])


def parse_folder(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Parse every Markdown file of a folder into articles at ``out``; returns (code, lang, articles), files without any too."""
    read = files.markdown(spark, folder)
    files.write(articles.parse(read, "code", "lang", "text"), out, by=["code", "lang"])
    made = spark.read.parquet(out).groupBy("code", "lang").agg(F.count(F.lit(1)).alias("articles"))
    return read.select("code", "lang").distinct().join(made, ["code", "lang"], "left").fillna(0)


def merge_folder(spark: SparkSession, parsed: str, out: str) -> DataFrame:
    """Merge the parsed articles of all codes into JSON at ``out``, a folder per code; returns how they were matched.

    Codes with one language only are left out, as they have no pair.
    """
    read = spark.read.parquet(parsed)
    both, _ = files.pairs(read)
    merged = merge(read.join(both, "code", "left_semi"))
    files.write(merged, out, "json", by=["code"])
    return reports.merge_summary(spark.read.json(out), "code")


def structure(merged: DataFrame, strict: bool = False) -> Structure:
    """Meaning, hierarchy and references of merged articles (code, number, article_id, bilingual fields)."""
    flat = merged.select(
        "code", "number", F.col("article_id").alias("id"), "source",
        *[F.col(f"{f}.{x}").alias(f"{f}_{x}") for f in ("title", "section", "chapter", "paragraph") for x in ("ru", "kz")],
        F.col("context.ru").alias("body_ru"), F.col("context.kz").alias("body_kz"),
    )
    meant = legal.semantics(flat, "body_ru", "code")
    nodes, placed = graph.hierarchy(meant, "code", "id")
    refs = legal.references(placed, "id", "code", "body_ru", strict)
    edges = legal.reference_edges(refs, placed, "id", "code", "number").withColumn("rel_type", F.lit("REFERENCES"))
    return Structure(placed, nodes, edges)


def keyword_table(flat: DataFrame, phrases: DataFrame, key: str = "id", codex: str = "code") -> DataFrame:
    """(key, term, score, rank): fused keywords of articles (key, codex, title, text) with given keyphrases."""
    tokens = F.concat(terms(F.col("text")), F.flatten(F.array_repeat(terms(F.col("title")), 3)))
    normed = keywords.robust_norm(index.tfidf_blend(flat, key, tokens, codex), key)
    cited = flat.select(key, F.posexplode(citations(F.col("text"))).alias("pos", "term"))
    return keywords.fuse(normed, keywords.phrase_words(phrases, key), key, citations=cited)
