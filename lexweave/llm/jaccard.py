"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document is the set of its word shingles.  All shingles are put in one global
order, rare ones first, by a sketch that counts every document.  Two sets that
reach the similarity share one of the first ``n - needed + 1`` shingles of each,
and ``l`` of the first ``n - needed + l``.  Each document picks its ``l`` by the
estimated cost: a longer prefix is scanned more, but a pair must then share ``l``
prefix shingles (the smaller ``l`` of the two) before it is verified.

Texts with equal sets are one class from the start.  Among near copies, pairs are
not listed: each class is compared with one root of its surroundings, exactly.
Classes linked to the same root need no further comparison with each other.  A
class that is near its root but not linked is compared with other classes of the
root through what they differ by: it can only be linked to a class with which it
shares more than half of that.  What remains are classes of different roots that
share enough prefix shingles; they are compared set by set.

In a large corpus the sketch's counters hold many shingles each, and one that some
thousands of classes share looks as rare as any.  Shingles that turn out to be in many
prefixes though the sketch did not show it are therefore counted as what they are,
and all prefixes are chosen once more; the order stays the same for every document,
so no pair is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import NOT_SPACE, hashes, joined, mix, released, shingle_hashes, texts, word_counts, words
from .storage import materialize, prepare, remove, written

SKETCH = (19, 22)  #: least and most counters of the frequency sketch, as powers of two
BYTES_PER_COUNTER = 64  #: of text, between these
LONGEST_MATCH = 8  #: the largest l
CHANCE = 0.05  #: partners that a shingle is taken to have when the sketch shows none
VERIFY = 0.125  #: cost of comparing one shingle, against one prefix entry
NEAR = 30  #: per cent below the wanted similarity down to which a class keeps its difference to the root
FAN_IN = 32
HEAVY = 1000  #: classes with a shingle in their prefixes from which it is ordered by that number, if the sketch cannot tell it from noise
LOUD = 4  #: times the mean counter from which a counter tells a frequent shingle
MOST_HEAVY = 1 << 20  #: of these, the heaviest, that workers are given
_BITS = 1 << 24
_FILL = 8  #: bits per wanted class below which the bitmap is too full to be of use


def _sets(part: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, bounds = joined(part, lower=True)
    starts, ends = words(buf, NOT_SPACE)
    h, first = hashes(buf, starts, ends), word_counts(starts, bounds).tolist()
    return [np.unique(shingle_hashes(h[a:b], k)) for a, b in zip(first, first[1:], strict=False)]


def _class_id(s: np.ndarray) -> int:
    """A 64-bit identity of a set; equal ids stand for equal sets."""
    total = mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


# -- global order -----------------------------------------------------------


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the least type that holds them, compressed: those of one task are small."""
    kind = next(x for x in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(x).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(data)[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]])


def _sketch(df: DataFrame, text: str, k: int) -> np.ndarray:
    """Counts of all shingles of all documents, by hash; a tree of tasks adds them up.

    There are more counters for more text, up to a size that every worker can hold.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_counters = 1 << min(SKETCH[1], max(SKETCH[0], (size // BYTES_PER_COUNTER).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_counters, np.uint32)  # counted in place: no task has 2**32 shingles, and a worker has little room
        for batch in batches:
            for _, part in texts(batch.column(0)):
                np.add.at(total, (np.concatenate(_sets(part, k)) & np.uint64(n_counters - 1)).astype(np.intp), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_counters, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += _unpacked(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])

    parts = df.select(text).mapInArrow(released(count), "counts binary")
    n = parts.rdd.getNumPartitions()
    while n > 4:
        n = ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(released(add), "counts binary")
    total = np.zeros(n_counters, np.int64)
    for r in parts.collect():
        total += _unpacked(bytes(r["counts"]))
    return total if total.max() > np.iinfo(np.uint32).max else total.astype(np.uint32)


Heavy = tuple[np.ndarray, np.ndarray]  # hashes, sorted, and in how many prefixes they are
_NONE: Heavy = (np.empty(0, np.uint64), np.empty(0, np.int64))


def prefix(s: np.ndarray, sketch: np.ndarray, noise: float, percent: int, heavy: Heavy = _NONE) -> tuple[int, int, np.ndarray]:
    """The match length l of a set, how many of its rarest shingles seem to be its own, and its prefix, rare ones first."""
    n = len(s)
    seen = sketch[(s & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.int64)
    expected = np.maximum(seen - 1 - noise, 0)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
        known = heavy[0][at] == s
        expected[known] = heavy[1][at[known]]
        seen[known] = np.maximum(seen[known], int(LOUD * noise) + heavy[1][at[known]])
    # Up to 2**40 occurrences; sets are sorted by hash, and a stable sort keeps that order at ties.
    rank = (seen.astype(np.uint64) << np.uint64(24)) | (s >> np.uint64(40))
    slack = n - -(-percent * n // 100)
    most = min(LONGEST_MATCH, n - slack)
    first = np.argsort(rank, kind="stable")[: slack + most]
    partners = np.cumsum(expected[first] + CHANCE)
    lengths = np.arange(1, most + 1)
    met = partners[slack : slack + most]
    cost = slack + lengths + met * (1 + VERIFY * n / lengths)
    best = int(np.argmin(cost)) + 1
    own = int((seen[first[: slack + 1]] < noise + 2).sum())
    return best, own, s[first[: slack + best]]


def _prefixes(df: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, c, l, own, prefix) of every document; and (token, m) of the shingles in the prefixes of several classes."""
    sketch = _sketch(df, text, k)
    noise = float(sketch.sum(dtype=np.int64)) / len(sketch)
    share = df.sparkSession.sparkContext.broadcast(sketch)
    made, path = written(_chosen(df, key, text, k, percent, share, noise, _NONE), "prefixes")
    several, counted = written(_several(made), "several")
    heavy = _unheard(several, sketch, noise)
    if not len(heavy[0]):
        return made, several
    again = materialize(_chosen(df, key, text, k, percent, share, noise, heavy), "prefixes")
    for old in (path, counted):
        remove(df.sparkSession, old)
    return again, materialize(_several(again), "several")


def _classes(made: DataFrame) -> DataFrame:
    return made.where(F.col("n") > 0).groupBy("c").agg(F.first("prefix").alias("prefix"))


def _several(made: DataFrame) -> DataFrame:
    return _classes(made).select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)


def _unheard(several: DataFrame, sketch: np.ndarray, noise: float) -> Heavy:
    """Shingles in the prefixes of many classes that the sketch cannot tell from noise."""
    found = several.where(F.col("m") >= HEAVY).orderBy(F.desc("m"), "token").limit(MOST_HEAVY).toArrow()
    h, m = found["token"].to_numpy().view(np.uint64), found["m"].to_numpy()
    quiet = sketch[(h & np.uint64(len(sketch) - 1)).astype(np.int64)] < LOUD * noise
    order = np.argsort(h[quiet])
    return h[quiet][order], m[quiet][order]


def _chosen(df: DataFrame, key: str, text: str, k: int, percent: int, share: Broadcast, noise: float, heavy: Heavy) -> DataFrame:
    listed = df.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, heavy = share.value, listed.value
        for batch in batches:
            for first, part in texts(batch.column(1)):
                sets = _sets(part, k)
                found = [prefix(s, sketch, noise, percent, heavy) if len(s) else (0, 0, s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_class_id(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in found], pa.int32()),
                        pa.array([x[1] for x in found], pa.int32()),
                        _lists([x[2] for x in found]),
                    ],
                    ["id", "n", "c", "l", "own", "prefix"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"id {kind}, n long, c long, l int, own int, prefix array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


# -- sets of chosen classes -------------------------------------------------


def _fetch_sets(df: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(c, shingles) of the wanted classes, made again from the texts.

    A bitmap of fixed size says which texts may be wanted, so that only their sets
    are shuffled; the join afterwards is exact.  With so many wanted classes that the
    bitmap would be full, one text of each class is shuffled instead and the sets are
    made after the join: no more than the input moves, however many are wanted.
    """
    wanted = wanted.select("c").distinct()
    if wanted.count() * _FILL > _BITS:
        return _sets_after_join(df, text, k, wanted)
    marks = wanted.select(F.pmod(F.col("c"), F.lit(_BITS)).alias("_b")).groupBy(F.shiftright("_b", 5).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b").bitwiseAND(31).cast("int"))).alias("bits")
    )
    bitmap = np.zeros(_BITS >> 5, np.int64)
    for r in marks.collect():  # at most one row per word of the bitmap
        bitmap[r["w"]] = r["bits"]
    share = df.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = share.value
        seen: set[int] = set()
        for batch in batches:
            for _, part in texts(batch.column(0)):
                ids, sets = [], []
                for s in _sets(part, k):
                    c = _class_id(s)
                    at = c % _BITS
                    if int(bits[at >> 5]) >> (at & 31) & 1 and c not in seen:
                        seen.add(c)
                        ids.append(c)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets)], ["c", "shingles"])

    found = df.select(text).mapInArrow(released(run), "c long, shingles array<long>")
    return materialize(found.dropDuplicates(["c"]).join(wanted, "c", "left_semi"), "sets")


def _sets_after_join(df: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column(0)):
                ids = pa.array([_class_id(s) for s in _sets(part, k)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, batch.column(0).slice(first, len(part))], ["c", "text"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), _lists(_sets(part, k))], ["c", "shingles"])

    named = df.select(F.col(text).alias("text")).mapInArrow(released(name), "c long, text string")
    few = named.groupBy("c").agg(F.first("text").alias("text")).join(wanted, "c", "left_semi")  # copies go before the shuffle
    return materialize(few.select("c", "text").mapInArrow(released(make), "c long, shingles array<long>"), "sets")


def _linked(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return shared * F.lit(100) >= (n + m - shared) * F.lit(percent)


# -- the join ---------------------------------------------------------------


def _live(classes: DataFrame, several: DataFrame, facts: DataFrame) -> DataFrame:
    """(token, c, n, l, first): prefix entries whose shingle several classes have, with the most central such class.

    Central is what has the fewest shingles of its own; among near copies that is the
    text the others were made from, and differences from it are least.  All entries
    are shuffled as bare pairs; facts (c, n, l, own) join the few that are left.
    """
    entries = classes.select("c", F.explode("prefix").alias("token"))
    live = materialize(entries.join(several.select("token"), "token").select("token", "c"), "entries").join(facts, "c")
    first = live.groupBy("token").agg(F.min(F.struct("own", "c", "n", "l")).alias("first"))
    return materialize(live.join(first, "token").drop("own"), "live")


def _sized(n: Column, m: Column, percent: int) -> Column:
    return (n * F.lit(100) >= m * F.lit(percent)) & (m * F.lit(100) >= n * F.lit(percent))


def _roots(live: DataFrame, percent: int) -> DataFrame:
    """(c, root): for each class the end of the chain of its best earlier partners.

    A partner is a class that shares as many prefix shingles as a pair must, counted
    where it is the most central one; others are left to the general comparison.
    Chains end because each step goes to a class that comes earlier in (own, c).
    """
    first = live.select("c", "n", "l", F.col("first.c").alias("first"), F.col("first.own").alias("own"), F.col("first.n").alias("m"), F.col("first.l").alias("k"))
    met = (
        first.where((F.col("c") != F.col("first")) & _sized(F.col("n"), F.col("m"), percent))
        .groupBy("c", "first", "own").agg(F.count(F.lit(1)).alias("_s"), F.first(F.least("l", "k")).alias("_l")).where(F.col("_s") >= F.col("_l"))
    )
    best = F.max_by("first", F.struct("_s", -F.col("own"), (-F.col("first").cast("decimal(20,0)")).alias("_o")))
    up = materialize(met.groupBy("c").agg(best.alias("root")), "roots")
    while True:
        above = up.select(F.col("c").alias("root"), F.col("root").alias("_up"))
        moved = materialize(up.join(above, "root", "left").select("c", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        up = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return up


def links(df: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and links between classes that suffice for all components.

    Returns (id, n, c) of every document and (a, b) pairs of linked classes.  Every
    link between classes that no other links connect is among the pairs.
    """
    prepare(df.sparkSession)
    every, several = _prefixes(df, key, text, k, percent)
    members = every.select("id", "n", "c")
    full = every.where(F.col("n") > 0)
    live = _live(_classes(every), several, full.select("c", "n", "l", "own").distinct())

    # One exact comparison of each class with its root.
    roots = _roots(live, percent)
    needed = roots.select("c").union(roots.select(F.col("root").alias("c"))).distinct()
    sets = _fetch_sets(df, text, k, needed)
    mine = roots.join(sets, "c").withColumnRenamed("shingles", "_mine")
    compared = (
        mine.join(sets.select(F.col("c").alias("root"), F.col("shingles").alias("_root")), "root")
        .select("c", "root", F.size("_mine").cast("long").alias("n"), F.size("_root").cast("long").alias("nr"),
                F.array_except("_mine", "_root").alias("more"), F.array_except("_root", "_mine").alias("less"))
        .withColumn("_both", F.col("n") - F.size("more"))
        .withColumn("linked", _linked(F.col("_both"), F.col("n"), F.col("nr"), percent))
        .where(_linked(F.col("_both"), F.col("n"), F.col("nr"), max(1, percent - NEAR)))
        .drop("_both")
    )
    near = materialize(compared, "near")
    to_root = near.where("linked").select(F.col("c").alias("a"), F.col("root").alias("b"))

    # Classes near a root but not linked to it, against others of that root.
    theta = percent / 100
    differing = near.select("c", "root", "n", "nr", "linked", "less", F.concat("more", "less").alias("_d")).where(F.size("_d") > 0)
    up, less, more = F.col("n").cast("double"), F.size("less"), F.size("_d") - F.size("less")
    lack = theta * (F.col("nr") + up) - (1 + theta) * (F.col("nr") - less)  # above 0: what y lacks to reach the root
    weight = less + theta * more
    rows = differing.select("root", "c", "linked", lack.alias("lack"), weight.alias("weight"), F.explode("_d").alias("t"))
    times = rows.groupBy("root", "t").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    # x shares more than weight / (1 + theta) of its differences with any y, so the rarest of those that others have too, but
    # for that many, hold one of them; and neither side can share more than it has of such differences.
    held = rows.join(times, ["root", "t"]).groupBy("root", "c", "linked", "lack", "weight").agg(F.array_sort(F.collect_list(F.struct("times", "t"))).alias("_o"))
    held = materialize(held, "differences")
    least = F.floor(F.col("weight") / (1 + theta) + 1e-9).cast("int") + 1
    rarest = F.slice("_o", F.lit(1), F.greatest(F.size("_o") - least + 1, F.lit(0)))
    index = held.select("root", F.col("c").alias("x"), F.col("weight").alias("wx"), F.size("_o").alias("sx"), F.explode(rarest).alias("_t")).select("root", "x", "wx", "sx", "_t.t")
    probe = held.where(~F.col("linked")).select("root", F.col("c").alias("y"), F.col("lack").alias("ly"), F.size("_o").alias("sy"), F.explode("_o").alias("_t")).select("root", "y", "ly", "sy", "_t.t")
    possible = (F.col("wx") + F.col("ly")) / (1 + theta) <= F.least("sx", "sy") + 1e-9
    pairs = probe.join(index, ["root", "t"]).where((F.col("x") != F.col("y")) & possible).select("x", "y").distinct()
    side = lambda name: differing.select(F.col("c").alias(name), "nr", F.col("n").alias(f"n{name}"), F.col("less").alias(f"l{name}"), F.col("_d").alias(f"d{name}"))
    both = F.col("nr") - F.size("lx") - F.size("ly") + F.size(F.array_intersect("dx", "dy"))
    within = pairs.join(side("x"), "x").join(side("y").drop("nr"), "y").where(_linked(both.cast("long"), F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # Classes of different roots that share enough prefix shingles.
    placed = live.select("token", "c", "n", "l").join(near.select("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    per_root = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_m")).groupBy("token")
    mixed = per_root.agg(F.count(F.lit(1)).alias("_roots"), F.max_by("root", F.struct("_m", "root")).alias("main")).where(F.col("_roots") > 1).drop("_roots")
    open_ = materialize(placed.join(mixed, "token"), "open")
    left = open_.where(F.col("root") != F.col("main")).select("token", F.col("c").alias("x"), F.col("n").alias("nx"), F.col("l").alias("lx"), F.col("root").alias("rx"))
    right = open_.select("token", F.col("c").alias("y"), F.col("n").alias("ny"), F.col("l").alias("ly"), F.col("root").alias("ry"), (F.col("root") == F.col("main")).alias("_main"))
    sized = _sized(F.col("nx"), F.col("ny"), percent)
    across = left.join(right, "token").where((F.col("rx") != F.col("ry")) & (F.col("_main") | (F.col("x") < F.col("y"))) & sized)
    # A pair can meet in both orders, under different main roots.
    ordered = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.least("lx", "ly").alias("_l"))
    enough = materialize(ordered.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_s"), F.first("_l").alias("_l")).where(F.col("_s") >= F.col("_l")).select("x", "y"), "enough")
    rest = _fetch_sets(df, text, k, enough.select(F.col("x").alias("c")).union(enough.select(F.col("y").alias("c"))).distinct())
    met = (
        enough.join(rest.select(F.col("c").alias("x"), F.col("shingles").alias("sx")), "x")
        .join(rest.select(F.col("c").alias("y"), F.col("shingles").alias("sy")), "y")
        .where(_linked(F.size(F.array_intersect("sx", "sy")).cast("long"), F.size("sx").cast("long"), F.size("sy").cast("long"), percent))
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    return members, materialize(to_root.union(within).union(met), "links")


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Texts are lower-cased in A-Z and split at ASCII white space; a text's set is its
    distinct ``k``-word shingles, or the whole sequence if it has fewer words.  Rows
    link when their sets' Jaccard similarity is at least ``percent``.
    component_id is the smallest key that links reach, the row's own included.
    Null texts and texts without words have empty sets and link with nothing.
    Repeated rows link with each other; a null key never is a component's smallest
    unless it is alone.  An empty table gives no rows; other columns are left out.
    """
    members, linked = links(df, key, text, k, percent)
    found = components(linked).select(F.col("node").alias("c"), F.col("component").alias("_top"))
    tops = members.where(F.col("n") > 0).groupBy("c").agg(F.min("id").alias("_least")).join(found, "c", "left").withColumn("_top", F.coalesce("_top", "c"))
    tops = materialize(tops, "tops")
    least = tops.groupBy("_top").agg(F.min("_least").alias("component_id"))
    of_class = tops.join(least, "_top").select("c", "component_id")
    return members.join(of_class, "c", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
