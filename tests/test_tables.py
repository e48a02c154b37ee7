import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave import tables
from lexweave.operators import articles, evaluation


def rows(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.choice(["a", "b", None]), i) for i in range(500)], "k string, i long").repartition(7, "i")


def test_places_and_followers_are_those_of_windows(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("i")
    want = df.withColumn("place", F.row_number().over(w).cast("long")).withColumn("next", F.lead("i").over(w))
    got = tables.followed(tables.placed(df, ["k"], ["i"], "place"), ["k"], "i", "next").select("k", "i", "place", "next")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert tables.placed(df.limit(0), ["k"], ["i"], "place").count() == 0


def test_small_is_measured_and_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = rows(spark).mapInPandas(count, "k string, i long")
    table = tables.small(df)
    assert table.count() == table.count() == 500 and seen.value == 500
    plan = lambda t: spark.range(5).withColumnRenamed("id", "i").join(t, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(table) and "broadcast" not in plan(tables.small(df, limit=10))


def greedy(costs, max_items, max_cost):
    out, batch, items, total = [], 0, 0, 0
    for c in costs:
        if items >= max_items or (items and total + c > max_cost):
            batch, items, total = batch + 1, 0, 0
        items, total = items + 1, total + c
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [4, 7, 50, 10_000])
def test_batches_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    data = [(g, i, rng.choice([0, 1, 10, 30, 200])) for g in ("a", "b", None) for i in range(150)] + [("one", 0, 500)]
    got = articles.greedy_batches(spark.createDataFrame(data, "g string, i long, c long"), "g", "i", "c", max_items=4, max_cost=60, block=block)
    want = []
    for g in ("a", "b", None, "one"):
        mine = [(i, c) for x, i, c in data if x == g]
        want += [(g, i, b) for (i, _), b in zip(mine, greedy([c for _, c in mine], 4, 60), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_holding_is_containment(spark):
    texts = ["The quick brown fox jumps over the lazy dog.", "quick", "xquick brownx", "", None, "a b", "over the lazy dog and the quick brown fox jumps"]
    items = ["quick", "quick brown", "uick brown fox jumps ove", "the lazy dog", "own fox jumps over the la", "a b", "no such thing anywhere at all", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    q = spark.createDataFrame(list(enumerate(items)), "qid long, text string")
    got = {tuple(r) for r in evaluation.holding(d, "id", "body", q, "qid", "text").collect()}
    assert got == {(j, i) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x is not None and x in t}
