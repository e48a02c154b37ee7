import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import jaccard
from lexweave.llm.components import components
from lexweave.llm.jaccard import near_duplicates

from .conftest import prose, same


def brute(rows, k, percent):
    """Components of all pairs; rows without an id stand last."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(key)
    least = {t: min((x for x in keys if x is not None), default=None) for t, keys in groups.items()}
    return sorted(((key, len(sets[i]), least[top(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_components_are_those_of_all_pairs(documents, rows, k, percent):
    got = sorted(map(tuple, near_duplicates(documents, "doc_id", "text", k, percent).collect()), key=repr)
    assert got == brute([(i, t) for i, t, _ in rows], k, percent)


@pytest.mark.parametrize("size", [(8, 8), (20, 20)])
def test_sets_by_a_join_and_any_size_of_sketch(documents, rows, monkeypatch, size):
    monkeypatch.setattr(jaccard, "SKETCH", size)
    monkeypatch.setattr(jaccard, "_FILL", 1 << 40)
    got = sorted(map(tuple, near_duplicates(documents, "doc_id", "text", 3, 90).collect()), key=repr)
    assert got == brute([(i, t) for i, t, _ in rows], 3, 90)


def test_shingles_that_the_sketch_does_not_show(spark, monkeypatch):
    """Sixteen counters, and a passage that many texts share: it is found to be frequent and leaves the prefixes."""
    rng = random.Random(12)
    passage = prose(rng, "en", 30)
    rows = [(i, f"{passage} {prose(rng, 'fr', 60)} tail{i}") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(f"tail{i}", "other")) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "SKETCH", (4, 4))
    monkeypatch.setattr(jaccard, "HEAVY", 10)
    shared = jaccard._sets([passage.encode()], 3)[0].view(np.int64).tolist()
    entries = lambda some: some.selectExpr("explode(prefix) as t").where(F.col("t").isin(shared)).count()
    second = entries(jaccard._prefixes(df, "doc_id", "text", 3, 90)[0])
    got = sorted(map(tuple, near_duplicates(df, "doc_id", "text", 3, 90).collect()), key=repr)
    monkeypatch.setattr(jaccard, "HEAVY", 1 << 40)
    assert second * 4 < entries(jaccard._prefixes(df, "doc_id", "text", 3, 90)[0])
    assert got == brute(rows, 3, 90)


def test_sketch_counts_every_shingle(documents, rows):
    """Against a plain count, and with counts beyond every small type."""
    sets = jaccard._sets([(t or "").encode() for _, t, _ in rows], 3)
    total = jaccard._sketch(documents, "text", 3)
    want = np.zeros(len(total), np.int64)
    for s in sets:
        np.add.at(want, (s & np.uint64(len(total) - 1)).astype(np.int64), 1)
    assert (total == want).all()
    for most in (1, 300, 70_000, 1 << 33):
        counts = np.array([0, most, 5], np.int64)
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()


def test_dense_family_of_near_copies(spark):
    """One text copied hundreds of times with zero to six changed words: links exist only through other copies."""
    rng = random.Random(8)
    base = prose(rng, "en", 120).split(" ")
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = rng.choice(base) + str(rng.randrange(30))
        rows.append((i, " ".join(words)))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_two_families_that_share_a_passage(spark):
    rng = random.Random(9)
    passage = prose(rng, "en", 60)
    rows = []
    for f in range(3):
        own = prose(rng, "fr", 40).split(" ")
        for i in range(40):
            words = list(own)
            words[rng.randrange(40)] = f"w{rng.randrange(200)}"
            rows.append((f * 100 + i, passage + " " + " ".join(words)))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_clashing_columns_and_empty_table(documents, clashing, empty):
    assert same(near_duplicates(clashing, "doc_id", "text", 3, 90), near_duplicates(documents, "doc_id", "text", 3, 90))
    assert near_duplicates(empty, "doc_id", "text", 3, 90).count() == 0


def test_component_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100
    assert components(links.where("a < 0")).count() == 0
