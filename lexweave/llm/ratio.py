"""Hashed n-gram generative models of trusted and raw text, and their ratio.

Words and pairs of words are hashed into a fixed number of buckets.  Two
multinomials over the buckets, one of trusted texts and one of the whole corpus,
give every n-gram a log-likelihood ratio, and a text the mean over its n-grams.
Two operators use it: a quality rule (a deterministic threshold for every
document) and a quality classifier (importance resampling by Gumbel top-k).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NOT_SPACE, byte_class, hashes, joined, mix, released, shingle_hashes, texts, word_counts, words
from ..tables import small
from .storage import materialize, prepare

BUCKETS = 1 << 17
BROADCAST_BYTES = 32 << 20  #: of Parquet, up to which the ids of trusted texts to fit on go to every worker
FAN_IN = 32  #: partial counts that one task adds up
LENGTH = 32  #: n-grams that the log weight of a longer text is scaled to

SYMBOLS = byte_class("#*$%&|<>")
_BLANK = b" \t\n\x0b\x0c\r"


# -- features ---------------------------------------------------------------


def _grams(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, words then pairs for each text, and where each text begins."""
    buf, bounds = joined(part, lower=False)
    starts, ends = words(buf, NOT_SPACE)
    h, first = hashes(buf, starts, ends), word_counts(starts, bounds)
    return _bucketed(h, first)


def _bucketed(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    sizes = n + np.maximum(n - 1, 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = np.empty(at[-1], np.int64)
    mask = np.uint64(BUCKETS - 1)
    one = (mix(h) & mask).astype(np.int64)
    text_of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[:-1][text_of]
    out[at[:-1][text_of] + place] = one
    if len(h) > 1:
        two = (shingle_hashes(h, 2) & mask).astype(np.int64)
        inside = text_of[1:] == text_of[:-1]
        out[(at[:-1][text_of] + n[text_of] + place)[:-1][inside]] = two[inside]
    return out, at


def _segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words inside three-word windows that occur in it twice or more."""
    n = np.diff(first)
    out = np.zeros(len(n), np.int64)
    if len(h) < 4:
        return out
    text_of = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(text_of[2:] == text_of[:-2])
    if not len(inside):
        return out
    key = mix(shingle_hashes(h, 3)[inside] + text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(h) + 1, np.int64)
    at = inside[again]
    np.add.at(change, at, 1)
    np.add.at(change, at + 3, -1)
    covered = np.cumsum(change[:-1]) > 0
    full = np.flatnonzero(n)
    out[full] = np.add.reduceat(covered.astype(np.int64), first[full])
    return out


def _rules(part: list[bytes]) -> dict[str, np.ndarray]:
    """Counts that the plain quality rules need, per text."""
    buf, bounds = joined(part, lower=False)
    starts, ends = words(buf, NOT_SPACE)
    first = word_counts(starts, bounds)
    h = hashes(buf, starts, ends)
    begins = bounds[:-1]
    lines = [[x for x in text.split(b"\n") if x.strip(_BLANK)] for text in part]
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": np.add.reduceat((NOT_SPACE[buf] & ((buf & 0xC0) != 0x80)).astype(np.int64), begins),
        "n_symbols": np.add.reduceat(SYMBOLS[buf].astype(np.int64), begins),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(h, first),
        "_grams": _bucketed(h, first),
    }


# -- fitting ----------------------------------------------------------------


@dataclass(frozen=True)
class RatioModel:
    """Log-likelihood ratio of each bucket."""

    ratio: np.ndarray

    def means(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _segment_sums(self.ratio[grams], at) / np.maximum(np.diff(at), 1)


FIT, TRUSTED, UNTRUSTED = 0, 1, 2  #: what a labelled id is for


@dataclass(frozen=True)
class Labels:
    """Every labelled id by its hash: trusted ones to fit on, trusted and untrusted ones to set the threshold by.

    table has (_hash, _use), one row for each id, and _use is null where an id is
    neither.  share is that of all labelled ids which are not untrusted; 1 without labels.
    """

    table: DataFrame
    share: float

    def _of(self, use: int) -> np.ndarray:
        """Sorted hashes of one use; to look into small tables, nothing here needs them at hand."""
        return np.sort(np.array([r["_hash"] for r in self.table.where(F.col("_use") == use).collect()], np.int64))

    fit = property(lambda self: self._of(FIT))
    trusted = property(lambda self: self._of(TRUSTED))
    untrusted = property(lambda self: self._of(UNTRUSTED))


def id_hash(df: DataFrame, key: str) -> Column:
    """A number from an id: from its value if it is an integer of any width, else from it as text."""
    return F.xxhash64(F.col(key).cast("long" if isinstance(df.schema[key].dataType, T.IntegralType) else "string"))


def label_kinds(labels: DataFrame, key: str, trusted: Column, untrusted: Column) -> Labels:
    """What each labelled id is for; null ids are left out.

    Half of the trusted ids, by hash, is for fitting and the other half for the
    threshold.  An id labelled both ways counts as untrusted.
    """
    ids = labels.where(F.col(key).isNotNull()).select(id_hash(labels, key).alias("_hash"), trusted.alias("_good"), untrusted.alias("_bad"))
    kinds = ids.groupBy("_hash").agg(F.max("_good").alias("_good"), F.max("_bad").alias("_bad"))
    good = F.when(F.pmod("_hash", F.lit(2)) == 0, FIT).otherwise(TRUSTED)
    table = materialize(kinds.select("_hash", F.when(F.col("_bad"), UNTRUSTED).when(F.col("_good"), good).alias("_use")), "labels")
    n, n_bad = table.agg(F.count(F.lit(1)), F.count(F.when(F.col("_use") == UNTRUSTED, 1))).first()
    return Labels(table, 1 - n_bad / n if n else 1.0)


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


_COUNTS = "raw binary, trusted binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        known = batch.column(0).to_numpy(zero_copy_only=False)
        for first, part in texts(batch.column(1)):
            grams, at = _grams(part)
            raw += np.bincount(grams, minlength=BUCKETS)
            for i in np.flatnonzero(known[first : first + len(part)]):
                np.add.at(trusted, grams[at[i] : at[i + 1]], 1)
    yield _blobs(raw, trusted)


def _blobs(raw: np.ndarray, trusted: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (raw, trusted)], ["raw", "trusted"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for i in range(2):
            for x in batch.column(i):
                total[i] += np.frombuffer(x.as_py(), np.int64)
    yield _blobs(*total)


def fit(df: DataFrame, key: str, text: str, labels: Labels) -> RatioModel:
    """Count the n-grams of every document, and of all trusted ones that are for fitting apart.

    Each task returns one row of fixed size, and a tree of tasks adds them up, so
    neither a shuffle nor the driver grows with the vocabulary.  Ids beyond
    BROADCAST_BYTES are joined by a shuffle, which moves the texts.
    """
    prepare(df.sparkSession)
    known = labels.table.where(F.col("_use") == FIT).select("_hash", F.lit(True).alias("_fit"))
    ids = small(known, "fit", BROADCAST_BYTES)
    marked = df.select(id_hash(df, key).alias("_hash"), F.col(text).alias("_text")).join(ids, "_hash", "left").select(F.coalesce("_fit", F.lit(False)).alias("_fit"), "_text")
    parts = materialize(marked.mapInArrow(released(_count), _COUNTS), "grams")
    n = parts.rdd.getNumPartitions()
    while n > 4:
        n = ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(released(_add), _COUNTS)
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in parts.collect():
        raw += np.frombuffer(r["raw"], np.int64)
        trusted += np.frombuffer(r["trusted"], np.int64)
    return RatioModel(np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)))


def _below(scores: DataFrame) -> DataFrame:
    """(_score, good, bad, good_below, bad_below): of each score, how many ids have it and how many have a lower one.

    Summed over ranges of scores, so no task sorts all of them.
    """
    counted = scores.groupBy("_score").agg(F.count(F.when(F.col("_good"), 1)).alias("good"), F.count(F.when(~F.col("_good"), 1)).alias("bad"))
    ranged = materialize(counted.repartitionByRange("_score").withColumn("_range", F.spark_partition_id()), "scores")
    earlier = lambda name, window: F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    before = ranges.select("_range", *(earlier(x, Window.orderBy("_range")).alias(f"_{x}") for x in ("good", "bad")))  # a row for each range
    within = ranged.select("*", *(earlier(x, Window.partitionBy("_range").orderBy("_score")).alias(f"{x}_below") for x in ("good", "bad")))
    return within.join(before, "_range").select("_score", "good", "bad", *((F.col(f"{x}_below") + F.col(f"_{x}")).alias(f"{x}_below") for x in ("good", "bad")))


def threshold(scored: DataFrame, key: str, score: str, labels: Labels) -> float:
    """The score that best separates trusted from untrusted documents, of all that are labelled and not fitted on.

    It makes the share of trusted documents below it plus the share of untrusted
    ones at or above it least; the lowest such score if several do.  Without
    untrusted documents it is the score that one trusted document in 200 misses;
    without trusted ones nothing is rejected.  Of rows with one id the lowest counts.
    """
    ids = labels.table.where(F.col("_use") != FIT).select("_hash", (F.col("_use") == TRUSTED).alias("_good"))
    found = scored.where(F.col(key).isNotNull()).select(id_hash(scored, key).alias("_hash"), F.col(score).alias("_score")).join(ids, "_hash")
    below = materialize(_below(found.groupBy("_hash", "_good").agg(F.min("_score").alias("_score"))), "below")
    good, bad = below.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not good:
        return float("-inf")
    if not bad:
        place = 0.005 * (good - 1)
        at = [below.where((F.col("good_below") <= i) & (F.col("good_below") + F.col("good") > i)).first()["_score"] for i in (int(place), ceil(place))]
        return float(np.quantile(at, place % 1))
    lost = F.col("good_below") * F.lit(bad) - F.col("bad_below") * F.lit(good)  # in whole numbers, so equal ones are equal
    return float(below.orderBy(lost, "_score").first()["_score"])


# -- the two operators ------------------------------------------------------

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_rules(df: DataFrame, key: str, text: str, model: RatioModel) -> DataFrame:
    """(key, the counts of RULES, log_ratio) of every whole text; null counts as empty, and empty scores 0."""
    share = prepare(df.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column(1)):
                found = _rules(part)
                means = share.value.means(*found["_grams"])
                columns = [batch.column(0).slice(first, len(part)), *(pa.array(found[x]) for x in RULES), pa.array(means)]
                yield pa.RecordBatch.from_arrays(columns, ["key", *RULES, "log_ratio"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{x} long' for x in RULES)}, log_ratio double"
    return df.select(key, text).mapInArrow(released(run), schema).withColumnRenamed("key", key)


def quality_rules(df: DataFrame, key: str, text: str, labels: Labels, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Judge every document: plain rules first, then the ratio against one threshold.

    Returns key, the counts of RULES, base_failed, kept, log_ratio.  A document
    fails the plain rules with fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` of them in repeated three-word windows.  Null and empty
    texts fail.  Repeated rows are judged each, ties at the threshold are kept, an
    empty table gives no rows, and other columns are left out.
    """
    scored = materialize(score_rules(df, key, text, fit(df, key, text, labels)), "rules")
    least = threshold(scored, key, "log_ratio", labels)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= F.lit(least)))


@dataclass(frozen=True)
class Resampler:
    """What decides whether a document is drawn: its key is its log weight over temperature plus Gumbel noise."""

    model: RatioModel
    least: float
    temperature: float
    seed: int


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) from each id's hash."""
    h = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _draw(ids: np.ndarray, part: list[bytes], model: RatioModel, temperature: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    grams, at = _grams(part)
    n = np.diff(at)
    weight = model.means(grams, at) * np.minimum(n, LENGTH)
    weight[n == 0] = -np.inf  # a text without words is never drawn
    return weight, weight / temperature - np.log(-np.log(_uniform(ids, seed)))


def _weights(df: DataFrame, key: str, text: str, model: RatioModel, temperature: float, seed: int) -> DataFrame:
    share = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _hashes(batch.column(2))
            for first, part in texts(batch.column(1)):
                weight, drawn = _draw(ids[first : first + len(part)], part, share.value, temperature, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(weight), pa.array(drawn)], ["key", "log_weight", "gumbel_key"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), id_hash(df, key).alias("_hash"))
    return rows.mapInArrow(released(run), f"key {kind}, log_weight double, gumbel_key double").withColumnRenamed("key", key)


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest finite value, exactly, by histograms of ever smaller ranges.

    Only ``bins`` counts or ``few`` values come to the driver at a time.  With k
    beyond the number of finite values it is the smallest of them.
    """
    rows = df.where(F.col(value) > F.lit(float("-inf"))).select(F.col(value).alias("_v"))
    lo, hi, n = rows.agg(F.min("_v"), F.max("_v"), F.count(F.lit(1))).first()
    if not n or k < 1:
        return float("inf")
    k = min(k, n)
    while n > few and lo < hi:
        at = F.floor((F.col("_v") - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("long")
        cells = rows.groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        for cell in sorted(cells, key=lambda r: -r["_b"]):
            if k <= cell["n"]:
                break
            k -= cell["n"]
        lo, hi, n = cell["lo"], cell["hi"], cell["n"]
        rows = rows.where((F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi)))
    if lo == hi:
        return float(lo)
    return float(sorted((r["_v"] for r in rows.collect()), reverse=True)[k - 1])


def resample(df: DataFrame, key: str, text: str, labels: Labels, share: float | None = None, temperature: float = 1.0, seed: int = 17, separate: bool = False) -> tuple[Resampler, DataFrame]:
    """Importance resampling without replacement, by Gumbel top-k.

    Returns what decides (for ``keep_drawn``) and a table (key, log_weight,
    gumbel_key, kept) of every document.  A document's log weight is the log ratio
    of its text under the two models, the sum over its n-grams; that of a text with
    more than LENGTH n-grams is scaled to LENGTH, since otherwise its length and not
    what it says would decide.  Its key adds Gumbel noise, made from its id and
    ``seed``, to the weight over ``temperature``; the k largest keys are drawn.  k is
    ``share`` of the documents with words; by default the share of labelled
    documents that are not untrusted.  With ``separate``, for use as a filter, k is the
    number of documents that weigh at least what best separates trusted from untrusted
    labelled ones.

    Texts that are null or without words weigh -inf and are never drawn.  Rows with
    one id, or none, share their noise; ties at the last key are all drawn, so that
    repeated rows stay together.  Without labels all texts with words are drawn.  An
    empty table gives no rows; other columns are left out.
    """
    prepare(df.sparkSession)
    model = fit(df, key, text, labels)
    weighed = materialize(_weights(df, key, text, model, temperature, seed), "weights")
    cut = threshold(weighed, key, "log_weight", labels) if separate else float("-inf")
    n = weighed.where((F.col("log_weight") > F.lit(float("-inf"))) & (F.col("log_weight") >= F.lit(cut))).count()
    share = 1.0 if separate else labels.share if share is None else share
    least = kth_largest(weighed, "gumbel_key", round(share * n))
    return Resampler(model, least, temperature, seed), weighed.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def keep_drawn(df: DataFrame, key: str, text: str, sampler: Resampler) -> DataFrame:
    """The rows of ``df``, all columns as they are, that the sampler draws: a filter without a join."""
    share = prepare(df.sparkSession).sparkContext.broadcast(sampler)
    at_text = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = share.value
        for batch in batches:
            ids = _hashes(batch.column(batch.num_columns - 1))
            kept = np.zeros(batch.num_rows, bool)
            for first, part in texts(batch.column(at_text)):
                _, drawn = _draw(ids[first : first + len(part)], part, s.model, s.temperature, s.seed)
                kept[first : first + len(part)] = drawn >= s.least
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept))

    # The hash goes last and under a name of its own, which only the worker sees.
    last = "_hash"
    while last in df.columns:
        last += "_"
    return df.withColumn(last, id_hash(df, key)).mapInArrow(released(run), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))


def trusted_labels(labels: DataFrame) -> Labels:
    """Trusted: good and not toxic; untrusted: bad quality."""
    return label_kinds(labels, "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 0)
