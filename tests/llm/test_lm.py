import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import lm
from lexweave.llm.storage import id_remainder

from .conftest import held_out, same


@pytest.fixture(scope="module")
def ranks():
    from lexweave.llm.queries import tokenizer_spec

    return tokenizer_spec("byte_bpe_50k.tiktoken")


def score(df, ranks):
    return lm.score(df, "doc_id", "text", id_remainder(F.col("doc_id"), 7) != 2, ranks, public_tokenizers.PATTERN)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_scores_and_counts(documents, clashing, rows, ranks):
    counts = Counter(t for i, text, _ in rows if held_out(i, 7) != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, _ in rows:
        mine = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in mine)
        want.append((repr(i), held_out(i, 7) != 2, len(mine), sum(counts[t] > 0 for t in mine), n, round(base, 6)))
    got = score(documents, ranks)
    found = got.collect()
    assert sorted((repr(r[0]), *r[1:5], round(r.base_score, 6)) for r in found) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    drop = ("base_score", "attention_score", "score")
    assert same(score(clashing, ranks).drop(*drop), got.drop(*drop))


def test_counts_do_not_depend_on_which_words_are_at_hand(documents, monkeypatch, ranks):
    plain = {repr(r[:5]): (r.base_score, r.attention_score, r.score) for r in score(documents, ranks).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 5)
    monkeypatch.setattr(lm.count_tokens, "__defaults__", (5,))
    few = {repr(r[:5]): (r.base_score, r.attention_score, r.score) for r in score(documents, ranks).collect()}
    assert plain.keys() == few.keys()
    assert all(abs(a - b) < 1e-6 * max(1, abs(a)) for k in plain for a, b in zip(plain[k], few[k], strict=True))


def test_model_scores_every_id_once_with_masked_windows():
    """Window by window, id by id, against a plain loop."""
    rng = np.random.default_rng(0)
    size = 300
    ids = rng.integers(0, size, 900).astype(np.int32)
    at = np.array([0, 1, 33, 34, 90, 400, 900])
    model = lm.train(ids, at, size, steps=20)
    got = model.score(ids, at)
    for t in range(len(at) - 1):
        text = ids[at[t] : at[t + 1]]
        classes = [0, *model.class_of[text].tolist()]
        total = 0.0
        for i in range(len(text)):  # the id at place i is scored in the first window that reaches it
            w = 0 if i < lm.WINDOW else -(-(i - lm.WINDOW + 1) // lm.STRIDE)
            begin = w * lm.STRIDE
            seen = np.array(classes[begin : i + 1])
            score = model.query[seen[-1]] @ model.key[seen].T + model.near[len(seen) - 1, : len(seen)]
            a = np.exp(score - score.max())
            logits = (a / a.sum()) @ model.value[seen] + model.skip[seen[-1]]
            p = np.exp(logits - logits.max())
            place = model.place[text[i]]
            within = model.after[classes[i], place] if place >= 0 else model.share[text[i]]
            total += math.log10(p[model.class_of[text[i]]] / p.sum()) + within
        assert abs(total - got[t]) < 1e-3 * max(1, abs(total))


def test_probabilities_of_the_next_id_add_up_to_one():
    rng = np.random.default_rng(1)
    size = 50
    ids = rng.integers(0, size, 400).astype(np.int32)
    model = lm.train(ids, np.array([0, 400]), size, steps=10)
    start = np.tile(ids[:5], size + 1)
    every = np.insert(start.reshape(size + 1, 5), 5, np.arange(size + 1), axis=1).ravel().astype(np.int32)
    with_next = model.score(every, np.arange(0, 6 * (size + 1) + 1, 6))
    without = model.score(ids[:5], np.array([0, 5]))
    assert abs((10 ** (with_next - without)).sum() - 1) < 1e-3


def test_words_are_a_distribution_and_ids_add_up():
    """Of a small vocabulary whose words have one or two ids: log10 of each word by plain sums over ids and openings."""
    rng = np.random.default_rng(4)
    size = 12
    starts = np.zeros(size + 1, bool)
    starts[[0, 1, 2, 3, 4, 5, size]] = True
    texts = [[*(x for _ in range(rng.integers(1, 60)) for x in [int(rng.integers(0, 6)), *([int(rng.integers(6, size))] if rng.random() < 0.5 else [])]), size] for _ in range(20)]
    at = np.cumsum([0, *map(len, texts)])
    ids = np.concatenate(texts).astype(np.int32)
    model = lm.train(ids, at, size, steps=30, starts=starts)
    token, first, whole = model.words(ids, at)
    assert np.allclose(whole, model.score(ids, at))
    assert len(token) == starts[ids].sum() and first.tolist() == np.append(0, np.cumsum([starts[x].sum() for x in texts])).tolist()

    def given(prefix, nexts):
        """log10 probability of each next id after a prefix, from whole scores."""
        flat = np.array([y for x in nexts for y in [*prefix, x]], np.int32)
        n = len(prefix) + 1
        total = model.score(flat, np.arange(0, n * len(nexts) + 1, n))
        return total - (model.score(np.array(prefix, np.int32), np.array([0, n - 1]))[0] if prefix else 0.0)

    openers = np.flatnonzero(starts).tolist()
    opens = lambda prefix: np.log10((10 ** given(prefix, openers)).sum())
    for t in (0, 5, 11):
        text, mine = texts[t], token[first[t] : first[t + 1]]
        places = [i for i, x in enumerate(text) if starts[x]]
        for j, (a, b) in enumerate(zip(places, [*places[1:], len(text)], strict=True)):
            want = sum(given(text[:i], [text[i]])[0] for i in range(a, b)) - opens(text[:a]) + (opens(text[:b]) if b < len(text) else 0.0)
            assert abs(want - mine[j]) < 2e-3


def test_score_is_the_mixture_of_attention_and_counts(documents, rows, ranks):
    counts = Counter(t for i, text, _ in rows if held_out(i, 7) != 2 for t in tokens(text))
    n = sum(counts.values())
    alone = {repr(r[:4]): r.score for r in lm.score(documents, "doc_id", "text", id_remainder(F.col("doc_id"), 7) != 2, ranks, public_tokenizers.PATTERN, attention=1.0).collect()}
    mixed = {repr(r[:4]): r for r in score(documents, ranks).collect()}
    for k, r in mixed.items():
        assert r.score >= alone[k] + r.n_tokens * math.log10(0.5) - 1e-3 * abs(alone[k])
    few = [x for x in rows if x[1] and len(tokens(x[1])) == 2 and held_out(x[0], 7) == 2] or [(x[0], x[1]) for x in rows if x[1] == ""]
    for i, text, *_ in few:  # all tokens of these at most as likely as attention and counts together allow
        r = next(v for v in mixed.values() if v.doc_id == i)
        least = sum(math.log10(0.5 * counts[t] / n) for t in tokens(text) if counts[t])
        assert r.score <= 0 and (not all(counts[t] for t in tokens(text)) or r.score >= least - 1e-9)


def test_a_text_seen_in_training_scores_above_one_of_the_same_making(spark, ranks):
    """Invented words, each in two documents or in one: what the corpus holds only once has to be remembered."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    texts = [" ".join(word() for _ in range(40)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:20])] + [(200 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.col("doc_id") < 100, ranks, public_tokenizers.PATTERN)
    value = {r.doc_id: r.score for r in got.where("doc_id >= 100").collect()}
    assert min(value[i] for i in range(100, 120)) > max(value[i] for i in range(200, 220)) + 40


def test_words_are_cut_together_as_one_by_one(ranks):
    coder = lm.Subwords(ranks, public_tokenizers.PATTERN)
    for some in (["don't", "12ab", "é", "中文", "a" * 400, "...", "'s", "x"], ["a\u00a0", "\u00a0b", "c\u2003d", "\x1c", "e"]):
        ids, sizes = coder._cut([x.encode() for x in some])
        each = [coder.encoding.encode_ordinary(" " + x) for x in some]
        assert ids.tolist() == [i for x in each for i in x] and sizes.tolist() == list(map(len, each))


def test_empty_table(empty, ranks):
    assert score(empty, ranks).count() == 0


def test_long_texts_teach(spark, ranks):
    """A corpus of texts over 8 KB only: the order of its words has to be known afterwards."""
    rows = [(i, "red green blue " * (900 + i)) for i in range(4)] + [(100, "red green blue red green blue"), (101, "blue blue green green red red")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", F.col("doc_id") < 100, ranks, public_tokenizers.PATTERN)
    value = {r.doc_id: r.score for r in got.where("doc_id >= 100").collect()}
    assert value[100] > value[101] + 3


def _ids(spark, texts, size):
    schema = "ids binary"
    return spark.createDataFrame([(np.array(x, lm._kind(size)).tobytes(),) for x in texts], schema).repartition(6)


def test_counts_of_a_table_are_those_of_all_its_texts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    size = 500
    texts = [[*rng.zipf(1.3, n).clip(1, size).astype(int) - 1, size] for n in (0, 1, 40, 5000, 30, 20_000)]
    at = np.cumsum([0, *map(len, texts)])
    want = lm.train(np.concatenate(texts).astype(np.int32), at, size, steps=1)
    monkeypatch.setattr(lm, "WARM", 64)
    monkeypatch.setattr(lm, "SHARE", 0.9)
    got = lm.fit(_ids(spark, texts, size), size)
    for name in ("class_of", "share", "place", "after"):
        assert np.allclose(getattr(got, name), getattr(want, name))
    assert np.isfinite(got.value).all() and np.isfinite(got.skip).all()


def test_copies_do_not_fill_the_windows(spark):
    size = 500
    texts = [[*range(i, i + 40), size] for i in range(20)] + [[7] * 50 + [size]] * 3000
    windows = [np.frombuffer(r["w"], np.int32).tolist() for r in lm._window_table(_ids(spark, texts, size), size, 1.0).collect()]
    assert len(windows) == 2 * 21 == len(set(map(tuple, windows)))


def test_every_window_of_every_distinct_text_teaches_once(spark, monkeypatch):
    """Of an input that the driver does not hold: the tasks of all rounds together see all windows."""
    rng = np.random.default_rng(8)
    size, seen, added = 500, [], lm._added
    texts = [[*rng.integers(0, size, lm.WINDOW * int(rng.integers(1, 9)) - 1), size] for _ in range(300)]

    def weighed(parts, n, kind=np.int64, *more):
        total = added(parts, n, kind, *more)
        if kind is np.float64:  # weights, and how many windows they are from
            seen.append(total[-1])
        return total

    monkeypatch.setattr(lm, "WARM", 64)
    monkeypatch.setattr(lm, "_added", weighed)
    lm.fit(_ids(spark, texts + texts[:50], size), size)
    assert sum(seen) == sum(len(x) // lm.WINDOW for x in texts)


def test_copies_are_dropped_before_they_meet(spark, ranks, monkeypatch):
    """Of one partition with many copies each distinct text is sent on once, also where a held-out copy comes first."""
    sent, texts_of = [], lm._texts

    def counted(ids, *more):
        sent.append(sorted(len(r["ids"]) for r in ids.collect()))
        return texts_of(ids, *more)

    monkeypatch.setattr(lm, "_texts", counted)
    rows = [(100, "one"), *((i, "one") for i in range(5)), *((i, "two words") for i in range(5, 50)), (50, None), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lm.score(df, "doc_id", "text", F.col("doc_id") < 100, ranks, public_tokenizers.PATTERN)
    assert got.count() == len(rows) and len(sent) == 1 and len(sent[0]) == 3
    monkeypatch.setattr(lm, "SEEN", 1)
    assert lm._teaches(pa.array([b"a", b"a", b"b", b"a"]), pa.array([True, True, True, True]), set()).to_pylist() == [True, False, True, True]


def test_weights_are_those_of_a_plain_gradient():
    """One step on a few windows: its direction, Adam's first, against differences of the loss."""
    rng = np.random.default_rng(3)
    class_of = np.append(rng.integers(1, lm.CLASSES, 60), 0)
    windows = rng.integers(0, 60, (20, lm.WINDOW + 1)).astype(np.int32)
    windows[3, 20:] = windows[7, 9:] = -1
    p = {name: rng.normal(0, 0.5, x.shape) for name, x in lm._begin().items()}
    base = np.log(rng.dirichlet(np.ones(lm.CLASSES), lm.CLASSES) + 1e-6)

    def loss(p):
        x, y, inside = class_of[windows[:, :-1]], class_of[windows[:, 1:]], windows[:, 1:] >= 0
        total = 0.0
        for row, want, known in zip(x, y, inside, strict=True):
            for i in np.flatnonzero(known):
                a = np.exp(p["k"][row[: i + 1]] @ p["q"][row[i]] + p["d"][i::-1][: i + 1])
                g = (a / a.sum() @ p["l"][row[: i + 1]] + p["b"][row[i]]) @ p["r"] + base[row[i]]
                total += np.log(np.exp(g).sum()) - g[want[i]]
        return total / inside.sum()

    better = lm._improve(p, base, windows, class_of, rate=0.01)
    for name in p:
        # The first step of Adam is the rate, against the sign of the gradient.
        moved = better[name].astype(np.float64) - p[name]
        for at in [np.unravel_index(i, p[name].shape) for i in np.argsort(-np.abs(moved), axis=None)[:: max(1, moved.size // 4)][:4]]:
            ahead, behind = ({**p, name: p[name].copy()} for _ in range(2))
            ahead[name][at] += 1e-4
            behind[name][at] -= 1e-4
            slope = (loss(ahead) - loss(behind)) / 2e-4
            assert abs(slope) < 1e-6 or abs(moved[at] + 0.01 * np.sign(slope)) < 2e-3


def test_scores_do_not_depend_on_how_places_are_grouped(monkeypatch):
    rng = np.random.default_rng(9)
    size = 300
    ids = rng.integers(0, size, 5000).astype(np.int32)
    at = np.array([0, 1, 2000, 2024, 5000])
    model = lm.train(ids, at, size, steps=20)
    want = model.each(ids, at)
    for name, value in (("GROUPED", 3), ("SLICE", 7)):
        monkeypatch.setattr(lm, name, value)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model.each(ids, at), want, strict=True))


def test_ids_of_words_at_hand_are_remembered_and_others_forgotten(ranks):
    coder = lm.Subwords(ranks, public_tokenizers.PATTERN)
    parts = [lm.Words(x) for x in ([b"one two three", b"", b"two"], [b"three three unheard"], [b"one unheard of", b"two"])]
    own = lm._Coder(ranks, public_tokenizers.PATTERN, np.sort(np.concatenate([x.unique for x in parts[:1]])[:2]))
    for words in ("one two three||two", "three three unheard", "one unheard of|two"), ("two|one",):
        for text in words:
            part = lm.Words([x.encode() for x in text.split("|")])
            coder.hold(own.words)
            ids, at = coder.encode(part, own.find(part))
            each = [[i for w in x.split() for i in coder.encoding.encode_ordinary(" " + w)] + [coder.end] for x in text.split("|")]
            assert ids.tolist() == [i for x in each for i in x] and at.tolist() == np.cumsum([0, *map(len, each)]).tolist()
            assert len(coder.at) - 1 == (coder.number >= 0).sum() <= 2
