"""Edge, node and definition tables: upserts, one-hop expansion and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import contains_either, short_id
from ..tables import small

# -- keyed upserts ------------------------------------------------------------


def first_seen(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in the given order; whole rows are aggregated, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones of the same key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, "_v").drop("_v")


def upsert_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    """(text_ru, text_kz): the first writer of a keyword stays; keyed by either language's text."""
    key = F.coalesce("text_ru", "text_kz")
    both = old.select(key.alias("text_ru"), "text_kz", F.lit(0).alias("_v")).unionByName(new.where(key.isNotNull()).select(key.alias("text_ru"), "text_kz", F.lit(1).alias("_v")))
    return first_seen(both, ["text_ru"], ["_v", F.col("text_kz").asc_nulls_last()]).drop("_v")


def keyword_links(articles: DataFrame, submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (article_id, text_ru) whose article exists, and those without one."""
    rows = submitted.select("article_id", F.coalesce("text_ru", "text_kz").alias("text_ru")).where(F.col("text_ru").isNotNull())
    known = articles.select(F.col("id").alias("article_id")).distinct()
    return rows.join(known, "article_id", "left_semi").distinct(), rows.join(known, "article_id", "left_anti")


def typed_edges(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Edges of known articles: unknown types become REFERENCES, dangling ones drop out."""
    known = articles.select(F.col("id").alias("_id")).distinct()
    typed = relations.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("rel_type").isNotNull())
    typed = typed.withColumn("rel_type", F.when(F.col("rel_type").isin(*C.STORED_RELATIONS), F.col("rel_type")).otherwise("REFERENCES"))
    return typed.join(known, F.col("source_id") == F.col("_id"), "left_semi").join(known, F.col("target_id") == F.col("_id"), "left_semi")


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (source, target, type): the last evidence, and the last ref_type that is not null."""
    kept = F.max_by(F.when(F.col("ref_type").isNotNull(), F.col("ref_type")), F.when(F.col("ref_type").isNotNull(), F.col(order)))
    return edges.groupBy("source_id", "target_id", "rel_type").agg(F.max_by("evidence", order).alias("evidence"), kept.alias("ref_type"))


def upsert_definitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions unique by keyword and text; the first writer stays."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return first_seen(both, ["keyword_ru", "definition_ru"], ["_v", F.col("source_file").asc_nulls_last()]).drop("_v")


def update_keyword_translations(keywords: DataFrame, definitions: DataFrame) -> DataFrame:
    """Keywords with the Kazakh text of their definitions where that is filled, and keywords of new definitions."""
    given = definitions.groupBy(F.col("keyword_ru").alias("text_ru")).agg(F.max_by("keyword_kz", F.struct(F.col("keyword_kz") != "", "source_file")).alias("_kz"))
    text = F.when(F.coalesce("_kz", F.lit("")) != "", F.col("_kz")).otherwise(F.coalesce("text_kz", F.lit("")))
    return keywords.join(given, "text_ru", "full").select("text_ru", F.when(F.col("_kz").isNull(), F.col("text_kz")).otherwise(text).alias("text_kz"))


# -- hierarchy ----------------------------------------------------------------


def hierarchy(articles: DataFrame, codex: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Structural nodes and the parent of each article.

    A section's parent is the codex; a chapter's and a paragraph's the nearest level
    above that the article has.  Nodes are told apart by codex and name, and keep
    the parent under which they were first seen.
    """
    levels = (("Section", "section"), ("Chapter", "chapter"), ("Paragraph", "paragraph"))
    code = F.struct(short_id(F.lit("code"), F.col(codex)).alias("id"), F.lit("Code").alias("label"))
    held = articles.withColumn("_parent", code)
    found = []
    for label, name in levels:
        filled = F.coalesce(F.col(f"{name}_ru"), F.lit("")) != ""
        own = F.struct(short_id(F.lit(name), F.col(codex), F.col(f"{name}_ru")).alias("id"), F.lit(label).alias("label"))
        found.append(held.where(filled).select(
            own["id"].alias("id"), F.lit(label).alias("label"), F.col(codex).alias("prefix"), F.col(f"{name}_ru").alias("name_ru"),
            F.coalesce(F.nullif(F.col(f"{name}_kz"), F.lit("")), F.col(f"{name}_ru")).alias("name_kz"),
            F.col("_parent.id").alias("parent_id"), F.col("_parent.label").alias("parent_label"), F.col(order).alias("_o"),
        ))
        held = held.withColumn("_parent", F.when(filled, own).otherwise(F.col("_parent")))
    nodes = found[0].unionByName(found[1]).unionByName(found[2])
    parents = held.withColumn("parent_id", F.col("_parent.id")).withColumn("parent_label", F.col("_parent.label")).drop("_parent")
    return first_seen(nodes, ["id"], ["_o"]).drop("_o"), parents


# -- expansion ----------------------------------------------------------------


def neighbours(seeds: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """One hop from each question's seeds, either way, over the traversed types.

    ``seeds`` has (qid, id, score), ``edges`` (source_id, target_id, rel_type).
    Returns (qid, id, edge_count, parent_score, rank): how many edges lead to a
    neighbour that is no seed itself, and the mean score of the seeds they come from.
    """
    kept = edges.where(F.col("rel_type").isin(*C.TRAVERSED_RELATIONS))
    either = kept.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to")).unionAll(
        kept.where(F.col("source_id") != F.col("target_id")).select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to"))
    )
    start = small(seeds.select("qid", F.col("id").alias("_from"), F.col("score").alias("_s")), "seeds")
    hops = either.join(start, "_from").join(start.select("qid", F.col("_from").alias("_to")), ["qid", "_to"], "left_anti")
    per_parent = hops.groupBy("qid", "_to", "_from", "_s").agg(F.count(F.lit(1)).alias("_e"))
    found = per_parent.groupBy("qid", F.col("_to").alias("id")).agg(F.sum("_e").alias("edge_count"), F.avg("_s").alias("parent_score"))
    order = Window.partitionBy("qid").orderBy(F.desc("edge_count"), "id")
    most = limit if limit is not None else C.SETTINGS.graph_seed * C.SETTINGS.graph_limit
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


GRAM = 3  #: first characters of a text that its keywords are joined on


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.greatest(F.length(text) - F.lit(size - 1), F.lit(1))))
    return F.coalesce(F.transform(places, lambda i: F.substring(text, i, F.lit(size))), F.array().cast("array<string>"))


def lookup_definitions(queries: DataFrame, keywords: DataFrame, definitions: DataFrame, candidates: int | None = None, top_k: int | None = None) -> DataFrame:
    """Definitions of keywords that contain a query's text in either language.

    ``queries`` has (qid, kw, text).  The first ``candidates`` keywords in
    alphabetical order are looked up; one without a definition gives an empty one;
    distinct rows, the first ``top_k`` per query.
    """
    candidates = candidates or C.SETTINGS.definition_candidates
    top_k = top_k or C.SETTINGS.definition_top_k
    # What contains a text contains its first characters: a join on those comes before the comparison.
    beginning = F.lower(F.substring("text", 1, GRAM))
    asked = small(queries.withColumn("_g", beginning), "asked")
    sizes = sorted(r["_z"] for r in asked.select(F.length("_g").alias("_z")).distinct().collect())  # 0 to GRAM
    hay = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("text_ru", "text_kz")]
    pieces = F.array_distinct(F.flatten(F.array(*[_pieces(h, z) for h in hay for z in sizes]))) if sizes else F.array().cast("array<string>")
    hit = keywords.withColumn("_g", F.explode(pieces)).join(asked, "_g").where(contains_either(F.col("text"), F.col("text_ru"), F.col("text_kz"))).drop("_g")
    first = Window.partitionBy("qid", "kw").orderBy("text_ru")
    few = hit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= candidates).drop("_n")
    joined = few.join(definitions, few["text_ru"] == definitions["keyword_ru"], "left")
    blank = F.lit("")
    rows = joined.select(
        "qid", "kw", "text", F.coalesce("keyword_ru", "text_ru", blank).alias("keyword"), F.coalesce("keyword_kz", "text_kz", blank).alias("keyword_kz"),
        F.coalesce("definition_ru", blank).alias("definition_ru"), F.coalesce("definition_kz", blank).alias("definition_kz"),
    ).distinct()
    order = Window.partitionBy("qid", "kw").orderBy("keyword", "definition_ru", "definition_kz")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
