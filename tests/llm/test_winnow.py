import glob
import hashlib
import random
import re

import pytest

from lexweave.llm import winnow
from lexweave.llm.storage import shared_dir
from lexweave.llm.winnow import decontaminate

from .conftest import CLASHES, prose, same


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    hits = {}
    for d, t in docs:
        w = words(t)
        h, found = hits.setdefault(d, (set(), set()))
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if m := windows.get(tuple(w[k : k + n])):
                    found |= m
                    h.update(range(k, k + n))
    out = []
    for d, t in docs:
        h, found = hits[d]
        digest = hashlib.sha256(",".join(sorted("" if x is None else str(x) for x in found)).encode()).hexdigest()
        out.append((d, len(words(t)), len(h), len(found), digest, bool(h)))
    return sorted(out, key=repr)


@pytest.fixture(params=[winnow.BROADCAST_BYTES, 0], ids=["broadcast", "shuffle"], autouse=True)
def limit(request, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", request.param)
    return request.param


def _written(spark, name):
    base = f"{shared_dir(spark)}/lexweave-{spark.sparkContext.applicationId}".removeprefix("file://")
    return glob.glob(f"{base}/{name}-*")


def check(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(a, "doc_id", "text", b, "item_id", "text")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_planted_passages_at_every_place_and_length(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, "en", rng.randint(10, 40))) for i in range(30)]
    docs = []
    for i in range(120):
        w = prose(rng, "en", rng.randint(0, 60)).split(" ")
        item = rng.choice(items)[1].split(" ")
        n = rng.randint(5, len(item))
        at, start = rng.randint(0, len(w)), rng.randint(0, len(item) - n)
        docs.append((i, " ".join([*w[:at], *item[start : start + n], *w[at:]])))
    check(spark, docs, items)


def test_short_items_copies_nulls_and_repeats(spark, rows):
    rng = random.Random(2)
    ten = prose(rng, "fr", 10)
    items = [(1, "Two WORDS"), (2, "one"), (3, None), (4, " ... "), (5, ten), (6, ten), (7, "the " * 12), (8, "the the the"), (None, "no id here at all or so it seems to be here")]
    docs = [(i, t) for i, t, _ in rows if not t or len(t) < 3000]
    docs += [(300, ten), (301, ten.upper() + "!"), (302, "a " + ten + " b " + ten), (303, " ".join(ten.split()[:9])), (304, "the " * 30), (304, "the " * 30), (305, "no id here at all or so it seems to be here")]
    check(spark, docs, items)


def test_items_without_id(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    check(spark, [(1, ten), (2, "a two words b"), (3, "none of it"), (None, ten + " " + ten)], [(None, ten), (None, "two words"), (7, "none of")])


def test_a_shuffle_has_no_null_keys_and_no_whole_texts(spark, documents, limit):
    if limit:
        return
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 50}" for j in range(3000))) for i in range(20)], "doc_id long, text string")
    spans = winnow.find_spans(docs, "doc_id", "text", items, "item_id", "text")
    assert spans.where("lo is not null").count() > 0 and spans.where("lo is null").count() == 20
    widest = max(len(r["_w"]) for path in _written(spark, "candidates") for r in spark.read.parquet(path).where("_w is not null").collect())
    assert widest <= 2 * winnow.REACH + winnow.SPAN


def test_one_fingerprint_in_a_third_of_all_places(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    docs = [(i, " ".join([ten, f"x{i}"] * (40 if i % 3 == 0 else 0) + [f"y{i}z{j}" for j in range(30)])) for i in range(30)]
    check(spark, docs, [(1, ten), (2, "w0 w1 w2"), (3, "w9")])


def test_clashing_columns_and_empty_tables(spark, documents, clashing, empty):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, "the the the the the"), (2, "one")], "item_id long, text string")
    plain = decontaminate(documents, "doc_id", "text", items, "item_id", "text")
    assert same(decontaminate(clashing, "doc_id", "text", items.withColumns({x: F.lit(1) for x in CLASHES}), "item_id", "text"), plain)
    assert decontaminate(empty, "doc_id", "text", items, "item_id", "text").count() == 0
    assert decontaminate(documents, "doc_id", "text", items.limit(0), "item_id", "text").where("contaminated").count() == 0
