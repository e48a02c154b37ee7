import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.llm import ratio

from .conftest import prose, same


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def judged(spark):
    """Good prose, and prose with a mark behind every word; half of each labelled."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        text = prose(rng, ("en", "fr")[i % 2], rng.randint(60, 200))
        rows.append((i, text if i % 5 else " ".join(w + rng.choice(["***", "%%%", "###"]) for w in text.split())))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, labels_of(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 300)] + [(0, 0, 0), (None, 1, 0)])


def test_rule_separates_and_counts_match_brute_force(judged):
    df, labels = judged
    got = ratio.quality_rules(df, "doc_id", "text", ratio.trusted_labels(labels)).collect()
    good = [r.kept for r in got if r.doc_id % 5]
    bad = [r.kept for r in got if not r.doc_id % 5]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.03


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, documents, clashing, rows):
    more = [(400, "a b c a b c\n\nx\nx\n x\nx \n", None), (401, "a a a a", None), (402, "# * $ % & | < >", None), (403, "a\r\na\r\n", None)]
    few = [x for x in rows if not x[1] or len(x[1]) < 5000] + more
    df = spark.createDataFrame([(i, t) for i, t, _ in few], "doc_id long, text string")
    sample = ratio.trusted_labels(labels_of(spark, [(1, 1, 0), (2, 1, 0), (203, 0, 0)]))
    got = ratio.quality_rules(df, "doc_id", "text", sample).collect()
    assert sorted((repr(r.doc_id), *(r[x] for x in ratio.RULES)) for r in got) == sorted((repr(i), *base(t)) for i, t, _ in few)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    columns = ["doc_id", *ratio.RULES, "base_failed"]
    assert same(ratio.quality_rules(clashing, "doc_id", "text", sample).select(columns), ratio.quality_rules(documents, "doc_id", "text", sample).select(columns))


def test_resampling_draws_the_largest_keys(judged):
    df, labels = judged
    sampler, drawn = ratio.resample(df, "doc_id", "text", ratio.trusted_labels(labels))
    rows = drawn.collect()
    kept = [r for r in rows if r.kept]
    assert min(r.gumbel_key for r in kept) > max(r.gumbel_key for r in rows if not r.kept)
    good = [r.kept for r in rows if r.doc_id % 5]
    bad = [r.kept for r in rows if not r.doc_id % 5]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05
    assert sorted(r.doc_id for r in ratio.keep_drawn(df, "doc_id", "text", sampler).collect()) == sorted(r.doc_id for r in kept)
    assert ratio.resample(df, "doc_id", "text", ratio.trusted_labels(labels), share=0.25)[1].where("kept").count() == 150


def test_weights_draw_and_rule_match_brute_force(spark, judged):
    """Counts by dictionaries, sums by plain loops, and the k largest of all keys."""
    import math
    from collections import Counter

    import numpy as np

    df, labels = judged
    more = df.unionByName(spark.createDataFrame([(1000, None), (1001, " "), (1002, "one"), (1003, "one"), (None, "two words"), (None, "two words"), (7, "of a repeated id")], df.schema))
    sample = ratio.trusted_labels(labels)
    rows = more.select("doc_id", "text", ratio.id_hash(more, "doc_id").alias("h")).collect()
    assert abs(sample.share - (1 - 60 / 300)) < 1e-9
    grams = [ratio._grams([(r.text or "").encode()])[0].tolist() for r in rows]
    raw = Counter(g for some in grams for g in some)
    trusted = Counter(g for r, some in zip(rows, grams, strict=True) if r.h in sample.fit for g in some)
    b, nr, nt = ratio.BUCKETS, sum(raw.values()), sum(trusted.values())
    value = {g: math.log((trusted[g] + 1) / (nt + b)) - math.log((raw[g] + 1) / (nr + b)) for g in raw}
    weight = [sum(value[g] for g in some) * min(1, ratio.LENGTH / len(some)) if some else -math.inf for some in grams]
    noise = [-math.log(-math.log(ratio._uniform(np.array([r.h]), 17)[0])) for r in rows]
    keys = [w + n for w, n in zip(weight, noise, strict=True)]
    k = round(sample.share * sum(w > -math.inf for w in weight))
    least = sorted(keys, reverse=True)[k - 1]
    want = sorted((repr(r.doc_id), round(w, 6), round(key, 6), key >= least) for r, w, key in zip(rows, weight, keys, strict=True))
    got = ratio.resample(more, "doc_id", "text", sample)[1].collect()
    assert sorted((repr(r.doc_id), round(r.log_weight, 6), round(r.gumbel_key, 6), r.kept) for r in got) == want
    # The rule: the same ratio per gram, and the cut that loses least.
    mean = [sum(value[g] for g in some) / max(1, len(some)) for some in grams]
    lowest = {}
    for r, m in zip(rows, mean, strict=True):
        if r.doc_id is not None:
            lowest[r.h] = min(m, lowest.get(r.h, math.inf))
    good, bad = ([lowest[h] for h in some.tolist() if h in lowest] for some in (sample.trusted, sample.untrusted))
    cut = min(sorted(good + bad), key=lambda c: (round(sum(x < c for x in good) / len(good) + sum(x >= c for x in bad) / len(bad), 12), c))
    judged_rows = ratio.quality_rules(more, "doc_id", "text", sample).collect()
    assert sorted((repr(r.doc_id), round(r.log_ratio, 6), r.kept) for r in judged_rows) == sorted(
        (repr(r.doc_id), round(m, 6), not failed(r.text) and m >= cut - 1e-12) for r, m in zip(rows, mean, strict=True)
    )


def failed(text):
    n, _, _, _, repeated = base(text)
    return n < 50 or 100 * repeated > 50 * n


def test_the_draw_is_random_near_the_cut_and_only_there(judged):
    df, labels = judged
    sample = ratio.trusted_labels(labels)
    draws = [{r.doc_id: (r.log_weight, r.kept) for r in ratio.resample(df, "doc_id", "text", sample, share=0.5, seed=s)[1].collect()} for s in (1, 2)]
    top = sorted((w for w, _ in draws[0].values()), reverse=True)[299]
    for drawn in draws:
        differs = [w for w, kept in drawn.values() if kept != (w >= top)]
        assert 0.01 * len(drawn) < len(differs) < 0.4 * len(drawn) and max(abs(w - top) for w in differs) < 12
    assert {i for i, x in draws[0].items() if x[1]} != {i for i, x in draws[1].items() if x[1]}


def test_ids_of_text(spark, judged):
    df, labels = judged
    named = lambda x: x.withColumn("doc_id", F.concat(F.lit("doc"), "doc_id"))
    sample = ratio.trusted_labels(named(labels))
    drawn = ratio.resample(named(df), "doc_id", "text", sample)[1].where("kept")
    assert 0.7 < drawn.count() / df.count() < 0.85 and drawn.first().doc_id.startswith("doc")
    assert ratio.quality_rules(named(df), "doc_id", "text", sample).where("kept").count() > 400


def test_ties_at_the_threshold_are_kept(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
    sample = ratio.trusted_labels(labels_of(spark, [(i, 1, 0) for i in range(10)]))
    assert ratio.quality_rules(df, "doc_id", "text", sample).where("kept").count() == 10
    assert ratio.resample(df.withColumn("doc_id", F.lit(1)), "doc_id", "text", sample, share=0.1)[1].where("kept").count() == 10


def test_noise_is_gumbel_and_stable():
    import numpy as np

    u = ratio._uniform(np.arange(200_000), 17)
    g = -np.log(-np.log(u))
    assert abs(g.mean() - 0.5772) < 0.01 and abs(g.std() - 1.2825) < 0.01
    assert (ratio._uniform(np.arange(10), 17) == u[:10]).all() and (ratio._uniform(np.arange(10), 18) != u[:10]).all()


@pytest.mark.parametrize("k", [1, 2, 17, 500, 999, 1000, 5000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.random() * 1e-9, rng.gauss(0, 100), 3.5]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(float("-inf"),)], "v double")
    assert ratio.kth_largest(df, "v", k, bins=8, few=10) == sorted(values, reverse=True)[min(k, 1000) - 1]
    assert ratio.kth_largest(df.where("v > 1e9"), "v", k) == float("inf")


def test_empty_tables(spark, documents, clashing, empty):
    none = ratio.trusted_labels(labels_of(spark, []))
    assert ratio.quality_rules(documents, "doc_id", "text", none).where("not base_failed and not kept").count() == 0
    assert ratio.quality_rules(empty, "doc_id", "text", none).count() == 0
    assert ratio.resample(empty, "doc_id", "text", none)[1].count() == 0
    sampler, drawn = ratio.resample(clashing, "doc_id", "text", none)
    assert drawn.where(~F.col("kept")).where("log_weight > double('-Infinity')").count() == 0
    assert ratio.keep_drawn(clashing, "doc_id", "text", sampler).columns == clashing.columns


def test_every_label_fits_or_sets_the_threshold(spark):
    """More labels of either kind than 20,000: each is used, and the cut is the best of all of them."""
    import numpy as np

    n = 90_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.round(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) / 1e6 - (F.col("id") % 3 == 0).cast("int") * 0.4, 3).alias("score"))
    known = ratio.trusted_labels(rows.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")))
    fitted, trusted, untrusted = known.fit, known.trusted, known.untrusted
    assert len(fitted) + len(trusted) == 60_000 and len(untrusted) == 30_000 and not set(fitted) & set(trusted)
    value = {r.h: r.score for r in rows.select(ratio.id_hash(rows, "doc_id").alias("h"), "score").collect()}
    good, bad = (np.sort([value[h] for h in some.tolist()]) for some in (trusted, untrusted))
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(good, cuts) * len(bad) - np.searchsorted(bad, cuts) * len(good)
    assert ratio.threshold(rows, "doc_id", "score", known) == cuts[np.argmin(lost)]
    only = ratio.Labels(known.table.where(F.col("_use") != ratio.UNTRUSTED), 1.0)
    assert abs(ratio.threshold(rows, "doc_id", "score", only) - np.quantile(good, 0.005)) < 1e-12
