"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words become 64-bit hashes, and every ``K`` consecutive words of a document have
one; of each ``WINDOW`` consecutive k-grams the smallest is kept as a fingerprint, so each run of ``K + WINDOW - 1`` words, which is the length of a
benchmark window, holds a kept one wherever it stands.  Benchmark items keep all
their k-grams.  Fingerprints that meet are extended word by word to both sides;
an extension that spans a whole window is a hit, and its words are hit.

Items shorter than a window are windows of their own; they are looked up whole,
by one hash per place and length that occurs among them.

A benchmark whose tables are small goes to every worker.  A larger one is joined by
a shuffle: a document then sends its fingerprints, each with the words around it,
and never its whole text; the rows of a fingerprint are dealt into ``SALT`` parts,
for each of which the benchmark's rows are repeated, so none is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, prepare

SPAN = 10  #: words of a benchmark window
K = 5
WINDOW = SPAN - K + 1
REACH = SPAN - K  #: words that a window can extend beyond a fingerprint, to either side
BROADCAST_BYTES = 32 << 20  #: benchmark tables beyond this are joined by a shuffle
SALT = 32  #: parts that the rows of one fingerprint are dealt into by such a shuffle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of digits, ASCII letters and everything beyond ASCII.
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, lower-cased in A-Z; null has none."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), DELIMITERS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(words: Column, n: Column, at: Column) -> Column:
    """Hash of the K words from position ``at`` (from 0); null if they are not all there."""
    return F.when((at >= 0) & (at + F.lit(K) <= n), F.xxhash64(*[F.get(words, at + F.lit(j)) for j in range(K)]))


def _meet(rows: DataFrame, salt: Column, index: DataFrame, on: str, n_rows: int, bytes_per_row: int) -> DataFrame:
    """Rows with the rows of ``index`` that have the same ``on``, by broadcast or by a shuffle without hot keys."""
    if n_rows * bytes_per_row <= BROADCAST_BYTES:
        return rows.join(F.broadcast(index), on)
    dealt = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.where(F.col(on).isNotNull()).withColumn("_salt", F.pmod(salt, F.lit(SALT)).cast("int")).join(dealt, [on, "_salt"]).drop("_salt")


def find_spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Every document once with its words, and every extended hit.

    Rows (key, n_words, item, lo, hi): one with null lo and hi per row of ``df``, and
    one per hit with the first and last word of the span, from 0.  An item's id may
    be null.
    """
    prepare(df.sparkSession)
    bench = materialize(items.select(F.col(item_key).alias("_item"), word_hashes(F.col(item_text)).alias("_w")).where(F.size("_w") > 0), "benchmark")
    sizes = bench.agg(F.sum(F.when(F.size("_w") >= SPAN, F.size("_w")).otherwise(0)), F.sum(F.when(F.size("_w") < SPAN, 1).otherwise(0))).first()
    n_long, n_short = sizes[0] or 0, sizes[1] or 0
    w, n, i = F.col("_w"), F.size("_w"), F.col("_i")

    # Every k-gram of the items, with the words that a window can add on either side.
    slots = 2 * REACH + K
    grams = bench.where(n >= SPAN).select("_item", "_w", F.explode(F.sequence(F.lit(0), n - F.lit(K))).alias("_i"))
    index = grams.select("_item", F.lit(True).alias("_met"), _gram(w, n, i).alias("_print"), F.array(*[F.get(w, i + F.lit(j - REACH)) for j in range(slots)]).alias("_other"))

    # One row per window of k-grams, and one ahead of them (window 0) that stands for the document.  Nothing here is a
    # higher-order function, so that windows stay inside generated code up to the join and no row is copied for them.
    docs = df.select(F.col(key).alias("_doc"), word_hashes(F.col(text)).alias("_w"))
    last = F.when(n < K, 0).otherwise(F.greatest(n - F.lit(SPAN - 1), F.lit(1)))
    windows = docs.select("_doc", "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    gram = [_gram(w, n, i + F.lit(j - 2)) for j in range(WINDOW + 1)]
    minima = windows.select("_doc", "_w", "_i", gram[0].alias("_gone"), F.least(*gram[:-1]).alias("_before"), F.least(*gram[1:]).alias("_least"))
    # A window whose minimum is that of the window ahead adds no fingerprint.
    fresh = (i == 1) | ((i > 1) & ((F.col("_least") != F.col("_before")) | (F.col("_least") == F.col("_gone"))))
    prints = minima.select("_doc", "_w", "_i", F.when(fresh, F.col("_least")).alias("_print"))
    begin = F.greatest(i - F.lit(1 + REACH), F.lit(0))
    near = F.slice("_w", begin + F.lit(1), 2 * REACH + SPAN)
    bytes_per_row = 8 * slots + 64
    if n_long * bytes_per_row <= BROADCAST_BYTES:  # one pass over the texts gives the documents and their hits
        met = prints.join(F.broadcast(index), "_print", "left").where((i == 0) | F.col("_met"))
        met = met.select("_doc", n.cast("long").alias("_n"), "_item", "_met", "_other", "_print", "_i", begin.alias("_begin"), F.when(F.col("_met"), near).alias("_w"))
    else:
        slim = prints.where(F.col("_print").isNotNull()).select("_doc", n.cast("long").alias("_n"), "_print", "_i", begin.alias("_begin"), near.alias("_w"))
        blank = {c: F.lit(None).cast(kind) for c, kind in (("_item", index.schema["_item"].dataType), ("_met", "boolean"), ("_other", "array<bigint>"), ("_print", "bigint"), ("_begin", "int"))}
        each = docs.select("_doc", n.cast("long").alias("_n"), F.lit(0).alias("_i"), F.lit(None).cast("array<bigint>").alias("_w")).withColumns(blank)
        met = _meet(slim, F.xxhash64("_doc", "_i"), index, "_print", n_long, bytes_per_row).unionByName(each)
    # Few rows are left; they are written before they are extended, which keeps the code above small.
    candidates = materialize(met, "candidates")

    lead = (i - F.lit(1) - F.col("_begin")).cast("int")  # where the window begins in the words kept
    grams = F.transform(F.sequence(lead + F.lit(1), lead + F.lit(WINDOW)), lambda p: F.xxhash64(F.slice("_w", p, K)))
    placed = candidates.withColumn("_at", F.when(F.col("_met"), lead + F.array_position(grams, F.col("_print")).cast("int") - F.lit(1)))
    at = F.col("_at")
    blank = lambda count: F.array_repeat(F.lit(None).cast("long"), count)
    ahead = F.greatest(F.lit(REACH) - at, F.lit(0))
    around = F.slice(F.concat(blank(ahead), F.slice("_w", F.greatest(at - F.lit(REACH), F.lit(0)) + F.lit(1), F.lit(slots)), blank(F.lit(slots))), F.lit(1), F.lit(slots))
    compared = placed.withColumn("_same", F.when(at.isNotNull(), F.zip_with(around, "_other", lambda a, b: F.coalesce(a == b, F.lit(False)))))
    run = lambda part: (F.array_position(F.concat(part, F.array(F.lit(False))), False) - F.lit(1)).cast("int")  # noqa: E731  equal words from the front
    runs = compared.select(
        "_doc", "_n", "_item", "_begin", "_at", run(F.reverse(F.slice("_same", 1, REACH))).alias("_left"), run(F.slice("_same", REACH + 1, K)).alias("_core"),
        run(F.slice("_same", REACH + K + 1, REACH)).alias("_right"),
    )
    hits = runs.where(at.isNull() | ((F.col("_core") == K) & (F.col("_left") + F.col("_right") >= SPAN - K))).select(
        "_doc", "_n", "_item", (F.col("_begin") + at - F.col("_left")).cast("long").alias("_lo"), (F.col("_begin") + at + F.lit(K - 1) + F.col("_right")).cast("long").alias("_hi")
    )
    if n_short:
        short = bench.where(n < SPAN).select("_item", n.alias("_size"), F.xxhash64("_w").alias("_whole"))
        lengths = [r["_size"] for r in short.select("_size").distinct().collect()]  # at most SPAN - 1
        size = F.col("_long")
        each = docs.select("_doc", n.cast("long").alias("_n"), "_w", F.explode(F.array(*[F.lit(x) for x in sorted(lengths)])).alias("_long"))
        whole = F.transform(F.sequence(F.lit(1), F.greatest(n - size + F.lit(1), F.lit(1))), lambda p: F.xxhash64(F.slice("_w", p, size)))
        every = each.where(n >= size).select("_doc", "_n", "_long", F.posexplode(whole).alias("_i", "_whole"))
        found = _meet(every, F.xxhash64("_doc", "_i"), short, "_whole", n_short, 48).where(F.col("_long") == F.col("_size"))
        hits = hits.unionByName(found.select("_doc", "_n", "_item", i.cast("long").alias("_lo"), (i + size - F.lit(1)).cast("long").alias("_hi")))
    return hits.select(F.col("_doc").alias(key), F.col("_n").alias("n_words"), F.col("_item").alias("item"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


def decontaminate(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """What each document shares with the benchmark.

    (key, n_words, n_hit, n_items, items_sha256, contaminated): words inside any
    shared window, items with shared windows, and the digest of their ids as
    sorted text.  Null and empty texts have no words and no hits, null and empty
    items no windows; items with equal texts are hit together, and items without id
    are one item whose id is the empty text.  Rows of one key
    are reported each, with the hits of all of them.  Empty tables give no rows or
    no hits; other columns are left out.
    """
    spans = materialize(find_spans(df, key, text, items, item_key, item_text), "spans")
    hit = spans.where(F.col("lo").isNotNull())
    words = hit.select(key, F.explode(F.sequence("lo", "hi")).alias("_word")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_hit"))
    names = (
        hit.select(key, F.coalesce(F.col("item").cast("string"), F.lit("")).alias("_name")).distinct().groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("_name")), ","), 256).alias("items_sha256"))
    )
    left, right = words.withColumnRenamed(key, "_k1"), names.withColumnRenamed(key, "_k2")
    found = left.join(right, F.col("_k1").eqNullSafe(F.col("_k2")))
    every = spans.where(F.col("lo").isNull()).select(key, "n_words")
    none = F.sha2(F.lit(""), 256)
    return every.join(found, F.col(key).eqNullSafe(F.col("_k1")), "left").select(
        key, "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
