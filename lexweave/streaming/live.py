"""Streams: bounded session memory, latency windows, and incremental embedding.  Additions to the batch engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import SETTINGS


def latency_windows(events: DataFrame, time: str = "ts", value: str = "value", by: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, extremes and approximate percentiles of a value in tumbling windows; later rows than ``late`` drop out."""
    p = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 1000)
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width), by)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("p"))
        .select(F.col("window.start").alias("start"), by, "n", "mean", "min", "max", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))
    )


def session_memory(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", n: int = SETTINGS.history_turns) -> DataFrame:
    """(conversation, turns, last): after each batch, how many turns a conversation has had and its last ``n`` texts."""
    kind = turns.schema[conversation].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = state.get if state.exists else (0, [])
        held = list(held)
        for batch in batches:
            ordered = batch.sort_values(turn)
            count += len(ordered)
            held = (held + list(ordered[text]))[-n:]
        state.update((count, held))
        yield pd.DataFrame({conversation: [key[0]], "turns": [count], "last": [held]})

    return turns.groupBy(conversation).applyInPandasWithState(
        update, f"{conversation} {kind}, turns long, last array<string>", "turns long, last array<string>", "update", GroupStateTimeout.NoTimeout
    )


def embed_stream(articles: DataFrame, path: str, checkpoint: str, embed_batch: Callable[[DataFrame], DataFrame], key: str = "id"):
    """Append embeddings of new articles to the table at ``path``; a batch that is repeated adds nothing twice."""
    from ..sources.files import remaining

    def each(batch: DataFrame, _: int) -> None:
        embed_batch(remaining(batch, batch.sparkSession, path, key)).write.mode("append").parquet(path)

    return articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
