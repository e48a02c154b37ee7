"""From keyword hits to ranked articles and a context of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.legal import codex_name


def fuse_keywords(hits: DataFrame, repeat_share: float = C.SETTINGS.repeat_share) -> DataFrame:
    """(qid, id, codex, score, first_kw, first_rank): the first keyword's weighted score, plus a share of later ones.

    ``hits`` has (qid, kw, id, codex, score, rank, weight).
    """
    order = Window.partitionBy("qid", "id").orderBy("kw")
    placed = hits.withColumn("_n", F.row_number().over(order)).withColumn("_s", F.col("score") * F.col("weight"))
    total = F.sum(F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.col("_s") * repeat_share))
    return placed.groupBy("qid", "id", "codex").agg(F.round(total, 9).alias("score"), F.min("kw").alias("first_kw"), F.min_by("rank", "kw").alias("first_rank"))


def seeds(fused: DataFrame, n: int = C.SETTINGS.graph_seed) -> DataFrame:
    """The best ``n`` articles of each question."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return fused.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def with_graph(fused: DataFrame, neighbours: DataFrame, decay: float = C.SETTINGS.graph_decay) -> DataFrame:
    """(qid, id, score, source, rank): text hits and those neighbours that are none, with a decayed mean of their parents' scores."""
    text = fused.select("qid", "id", "score", F.lit("bm25").alias("source"))
    graph = neighbours.join(fused.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.round(F.col("parent_score") * decay, 12).alias("score"), F.lit("graph").alias("source"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("source"), "id")
    return text.unionByName(graph).withColumn("rank", F.row_number().over(order))


def chunk(codex: str, number: str, name: str, body: str):
    """An article as it stands in the context: a labelled head and its body."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.rtrim(F.concat(F.lit("["), codex_name(F.col(codex)), F.lit(f" | {C.ARTICLE_LABEL} "), blank(number), F.lit("] "), blank(name)))
    text = F.trim(blank(body))
    return F.when(text == "", head).otherwise(F.concat(head, F.lit("\n"), text))


def pack(ranked: DataFrame, chunks: DataFrame, budget: int = C.SETTINGS.context_chars) -> DataFrame:
    """(qid, id, rank, source, score, chunk, used): ranked chunks up to the first that the budget cannot take.

    ``chunks`` has (id, chunk); its texts join only after ranking.  A chunk costs its
    characters plus two; an empty chunk is passed over.
    """
    sized = ranked.join(chunks.select("id", "chunk", (F.length("chunk") + 2).alias("_cost")), "id").where(F.col("_cost") > 2)
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("used", F.sum("_cost").over(so_far)).where(F.col("used") <= budget).drop("_cost")


def context(packed: DataFrame, definitions: DataFrame, budget: int = C.SETTINGS.context_chars) -> DataFrame:
    """(qid, context_text, included): packed chunks, and the block of definitions if it fits.

    ``definitions`` has (qid, kw, text, rank, definition_ru).
    """
    parts = packed.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("_parts"), F.max("used").alias("_used"), F.count(F.lit(1)).alias("included"))
    line = F.concat(F.lit("• "), F.col("text"), F.lit(": "), F.trim("definition_ru"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kw", "rank", line.alias("line")))), lambda x: x["line"])
    filled = definitions.where(F.trim("definition_ru") != "").groupBy("qid").agg(listed.alias("_lines"))
    every = definitions.select("qid").distinct().join(filled, "qid", "left")
    block = every.select("qid", F.array_join(F.concat(F.array(F.lit(C.DEFINITIONS_TITLE)), F.coalesce("_lines", F.array().cast("array<string>"))), "\n").alias("_block"))
    joined = parts.join(block, "qid", "full")
    fits = F.col("_block").isNotNull() & (F.coalesce("_used", F.lit(0)) + F.length("_block") <= budget)
    pieces = F.coalesce("_parts", F.array().cast("array<string>"))
    return joined.select("qid", F.array_join(F.when(fits, F.concat(pieces, F.array("_block"))).otherwise(pieces), "\n\n").alias("context_text"), F.coalesce("included", F.lit(0)).alias("included"))


def statistics(fused: DataFrame, neighbours: DataFrame, ranked: DataFrame, packed: DataFrame) -> DataFrame:
    """(qid, bm25_hits, graph_hits, total_candidates, included); graph_hits counts every neighbour found."""
    count = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    out = count(ranked, "total_candidates")
    for df, name in ((fused, "bm25_hits"), (neighbours, "graph_hits"), (packed, "included")):
        out = out.join(count(df, name), "qid", "left")
    return out.fillna(0)
