"""Vector search and embedding of missing rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SETTINGS

BLOCK = 1024  #: queries that one pass over the vectors answers


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query, key, similarity, rank): exact cosine neighbours of every query among all vectors.

    Queries go to the workers in blocks of a fixed size; for each block every batch of
    vectors keeps its best k per query, so what is shuffled does not grow with the
    size of a partition.  Ties by key; vectors of zero length have similarity 0.
    """
    numbered = queries.select(F.col(key).alias("query"), F.col(vector).alias("_v")).where(F.col("_v").isNotNull())
    count = numbered.count()
    if count > block:
        split = numbered.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(-(-count // block))))
        parts = [split.where(F.col("_b") == i).drop("_b") for i in range(-(-count // block))]
    else:
        parts = [numbered]
    kind = vectors.schema[key].dataType.simpleString()
    out = None
    for part in parts:
        rows = part.orderBy("query").collect()  # about one block
        ids = [r["query"] for r in rows]
        matrix = _unit(np.array([r["_v"] for r in rows], np.float64).reshape(len(rows), -1)) if rows else np.empty((0, 0))
        share = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
        best = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(_search(share, k, kind), f"query {kind}, key {kind}, similarity double")
        out = best if out is None else out.unionAll(best)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 6)), "key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", F.col("key").alias(key), F.round("similarity", 6).alias("similarity"), "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _search(share, k: int, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = share.value
        for batch in batches:
            lists = batch.column(1)
            keep = lists.is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(0).filter(pa.array(keep))
            if not len(keys) or not len(ids):
                continue
            m = _unit(np.array(lists.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), -1))
            similar = np.round(queries @ m.T, 6)
            names = np.array(keys.to_pylist(), object)
            order = np.argsort(names, kind="stable")
            similar, names = similar[:, order], names[order]
            top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in rows]), pa.array(names[top.ravel()].tolist()), pa.array(similar[rows, top.ravel()])], ["query", "key", "similarity"]
            )

    return run


def passage(body: Column, chars: int = SETTINGS.embedding_chars) -> Column:
    """The text that stands for an article when it is embedded."""
    return F.concat(F.lit("passage: "), F.substring(F.coalesce(body, F.lit("")), 1, chars))


def embed_missing(articles: DataFrame, done: DataFrame, key: str, body: str, embed: Callable[[list[str]], "list[list[float]]"]) -> DataFrame:
    """(key, embedding) of the articles that have none yet."""
    kind = articles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": batch["key"], "embedding": [list(map(float, v)) for v in embed(list(batch["text"]))]})

    todo = articles.join(done.select(key), key, "left_anti").select(F.col(key).alias("key"), passage(F.col(body)).alias("text"))
    return todo.mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def hashed_embedder(width: int = 256) -> Callable[[list[str]], "list[list[float]]"]:
    """A deterministic stand-in for a model: hashed character trigrams, normalised."""

    def embed(items: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(items), width))
        for i, text in enumerate(items):
            folded = f"  {text.lower()} "
            for j in range(len(folded) - 2):
                out[i, zlib.crc32(folded[j : j + 3].encode()) % width] += 1
        return _unit(out).tolist()

    return embed
