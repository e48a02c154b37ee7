"""Scoring with a causal self-attention model over subword ids, trained here in numpy.

Tokens of a text are its words, lower-cased in A-Z, and one end.  Each word is cut
into subword ids of a public vocabulary.  The model is one layer of masked
attention over classes of ids: it predicts the class of the next id from the
classes before it, and a table gives the id within its class.  Classes and tables
come from counts over all training texts, and the attention weights from all their
windows: counts and weights are rows of fixed size that a tree of tasks adds.

What a layer of fixed size cannot hold is remembered beside it: the probability of
a word is a fixed mixture of what attention gives its ids and of the word's share
among all tokens of the training texts, a table that grows with the corpus.  Both
are distributions over words, so the mixture is one.

Long texts are covered by overlapping windows.  A window scores only the ids that
the one before it has not scored, so every id is scored once and, but for the
beginning of a text, with at least ``OVERLAP`` ids before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import gather
from .kernels import BLOCK, NOT_SPACE, hashes, joined, mix, released, texts, word_counts, words
from .ratio import FAN_IN
from .storage import materialize, prepare

WINDOW = 32  #: ids that attention sees at once
OVERLAP = 8
SHRINK = 10.0  #: how many counts the share of an id in its class weighs against counts after one class
STRIDE = WINDOW - OVERLAP
WIDTH = 8  #: of queries, keys and values
CLASSES = 128
COMMON = 4096  #: most frequent ids, which have classes and shares of their own
NEAR = 256  #: of them, those that are counted as neighbours
WARM = 51_200  #: windows up to which the driver fits the attention weights, going through them until it has seen so many
SHARE = 1 / 16  #: of the distinct texts of a larger input, those of the first round
SECOND = 1 / 3  #: of the rest, those of the second round; the third takes all others
RATES = (0.02, 0.01, 0.005)  #: of the rounds
DEALT = 100_000  #: windows of a task in a round
STEP = 64  #: windows of one step
SLICE = 256  #: places whose logits are held at once, few enough for a core's own cache
ATTENTION = 0.5  #: share of attention in the mixture with the corpus' word counts
FREQUENT = 1 << 20  #: words whose counts every worker has
SEEN = 1 << 17  #: texts that a task remembers, so as not to send copies of them
BATCH = 64  #: windows whose attention is computed at once
GROUPED = 2048  #: windows whose places are grouped by class at once
_LOG10E = float(np.log10(np.e))
_ODD_SPACE = re.compile(r"[^\S ]")


class Words:
    """Words of a slice of texts, and the distinct ones among them."""

    def __init__(self, part: list[bytes]) -> None:
        self.buf, bounds = joined(part, lower=True)
        self.starts, self.ends = words(self.buf, NOT_SPACE)
        self.first = word_counts(self.starts, bounds)
        self.unique, self.some, self.inverse = _unique(hashes(self.buf, self.starts, self.ends))


def _unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, where each is first, and the number of each hash among them.

    Only what is distinct is sorted.
    """
    found = pa.array(h.view(np.int64)).dictionary_encode()
    unique, number = found.dictionary.to_numpy().view(np.uint64), found.indices.to_numpy()
    some = np.empty(len(unique), np.int64)
    some[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return unique[order], some[order], rank[number]


# -- subwords ---------------------------------------------------------------


class Subwords:
    """Ids of words; those of the words at hand are remembered by their places."""

    def __init__(self, ranks: str, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = max(table.values()) + 1
        self.end = self.size  # one id of our own
        self.starts = np.zeros(self.size + 1, bool)  # ids that only begin a word, and the end
        self.starts[[*(i for w, i in table.items() if w.startswith(b" ")), self.end]] = True
        self.hold(np.empty(0, np.uint64))

    def hold(self, at_hand: np.ndarray) -> None:
        """Hashes of the words at hand from now on; what is known of them stays as long as they are the same."""
        if getattr(self, "at_hand", None) is not at_hand:
            self.at_hand = at_hand
            self.number = np.full(len(at_hand), -1, np.int64)
            self.at = np.zeros(1, np.int64)
            self.flat = np.empty(0, np.int32)

    def _cut(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space, in a row; and how many each has.

        All are cut in one call, as the pattern never joins what a space parts; only
        beside white space of other kinds is that not so, and words are cut one by one.
        """
        whole = " " + b" ".join(found).decode()
        if not _ODD_SPACE.search(whole):
            ids = np.array(self.encoding.encode_ordinary(whole), np.int32)
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(found):
                return ids, np.diff(first, append=len(ids))
        each = [self.encoding.encode_ordinary(" " + x.decode()) for x in found]
        return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)

    def encode(self, part: Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by the end; and where each text begins (one more: the end).

        ``place`` has the place at hand of each distinct word, -1 for others, which are cut and forgotten.
        """
        starts, ends, first, some, inverse = part.starts, part.ends, part.first, part.some, part.inverse
        numbers = np.where(place >= 0, self.number[place] if len(self.number) else -1, -1)
        flat, offsets = self.flat, self.at
        new = np.flatnonzero(numbers < 0)
        new = new[np.argsort(place[new] < 0, kind="stable")]  # those to remember first
        if len(new):
            raw = part.buf.tobytes()
            found = [raw[x:y] for x, y in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)]
            ids, sizes = self._cut(found)
            numbers[new] = len(offsets) - 1 + np.arange(len(new))
            flat, offsets = np.append(flat, ids), np.append(offsets, offsets[-1] + np.cumsum(sizes))
            kept = new[place[new] >= 0]
            self.number[place[kept]] = numbers[kept]
            self.at = offsets[: len(self.at) + len(kept)]
            self.flat = flat[: self.at[-1]]
        n = len(first) - 1
        flat, offsets = np.append(flat, np.int32(self.end)), np.append(offsets, offsets[-1] + 1)
        which = np.full(len(inverse) + n, len(offsets) - 2, np.int64)  # ends, where no word goes
        text_of = np.repeat(np.arange(n), np.diff(first))
        if len(inverse):
            which[np.arange(len(inverse)) + text_of] = numbers[inverse]
        ids, at = gather(flat, offsets, which)
        return ids, at[np.append(first[:-1] + np.arange(n), len(which))]


_subwords: dict[int, Subwords] = {}


def _subwords_of(ranks: str, pattern: str) -> Subwords:
    key = hash((ranks, pattern))
    if key not in _subwords:
        _subwords[key] = Subwords(ranks, pattern)
    return _subwords[key]


# -- the model --------------------------------------------------------------


@dataclass(frozen=True)
class AttentionModel:
    """Class of each id, log10 share of each id in its class, and the attention layer by class.

    place numbers the frequent ids (-1 for others), whose shares also depend on the
    class before them: after has a row per class.  query, key and left have one row per class, right brings a row of left,
    or a mean of rows, to logits, and skip has one row per class in logits; near is what distance adds to the attention
    score, masked ahead.  starts marks the ids that open a word; sums has ones beside their share of each class, and only
    the last class has both kinds.
    """

    class_of: np.ndarray
    share: np.ndarray
    place: np.ndarray
    after: np.ndarray
    query: np.ndarray
    key: np.ndarray
    left: np.ndarray
    right: np.ndarray
    skip: np.ndarray
    near: np.ndarray
    starts: np.ndarray
    sums: np.ndarray

    @property
    def value(self) -> np.ndarray:
        """What each class, attended to, adds to the logits."""
        return self.left @ self.right

    @cached_property
    def odds(self) -> np.ndarray:
        """For each class, a row per following class: what its exponential counts in both sums."""
        out = (np.exp(self.skip.astype(np.float64))[:, :, None] * self.sums).astype(np.float32)
        out[out < 1e-35] = 0  # too small to show, and slow
        return out

    def mean(self, seen: np.ndarray, skip: int = 0) -> np.ndarray:
        """The mean of rows of left after each place of windows of classes seen, but the first ``skip``."""
        score = np.take(self.query, seen[:, skip:], 0) @ np.take(self.key, seen, 0).transpose(0, 2, 1)
        score += self.near[skip:]
        np.exp(score, out=score)
        mean = score @ np.take(self.left, seen, 0)
        mean /= (score.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*mean.shape[:2], 1)
        return mean

    def log10(self, mean: np.ndarray, asking: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each following class, after a class and a mean of rows of left; also that a word opens.

        Those after the same class are taken together, so that its row of skip is a factor of the sums.
        """
        order = np.argsort(asking, kind="stable")
        mean, asking, following = np.take(mean, order, 0), asking[order], following[order]
        sums, held = np.empty((len(mean), 2), np.float32), np.empty((SLICE, CLASSES), np.float32)
        highest = max(0.0, float(self.value.max()) - 80)  # exponentials stay finite
        ends = np.cumsum(np.bincount(asking, minlength=CLASSES)).tolist()
        begin = 0
        for c, end in enumerate(ends):
            for i in range(begin, end, SLICE):
                j = min(end, i + SLICE)
                part = np.matmul(mean[i:j], self.right, out=held[: j - i])
                if highest:
                    part -= highest
                np.exp(part, out=part)
                np.matmul(part, self.odds[c], out=sums[i:j])
            begin = end
        np.log(sums, out=sums)
        chosen = np.einsum("ij,ij->i", mean, np.take(self.right.T, following, 0)) + self.skip[asking, following] - np.float32(highest)
        out = np.empty((2, len(mean)))
        out[:, order] = chosen - sums[:, 0], sums[:, 1] - sums[:, 0]
        return out[0] * _LOG10E, out[1] * _LOG10E

    def each(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every id of each text, and that a word opens at its place."""
        stream = np.zeros(len(ids) + WINDOW, np.uint8)
        np.take(self.class_of.astype(np.uint8), ids, out=stream[: len(ids)])
        before = np.roll(stream, 1)
        before[at[:-1]] = 0
        place = np.take(self.place, ids)
        out = np.where(place >= 0, self.after[before[: len(ids)], np.maximum(place, 0)], np.take(self.share, ids)).astype(np.float64)
        opens = np.empty(len(ids))
        n = np.diff(at)
        steps = np.arange(WINDOW)
        windows = np.lib.stride_tricks.sliding_window_view(before, WINDOW)  # what is seen of the next text is masked
        # First windows score all their ids, later ones those beyond the overlap.
        later = np.maximum(0, -(-(n - WINDOW) // STRIDE))
        which = np.repeat(np.arange(len(n)), later)
        number = np.arange(len(which)) - np.repeat(np.cumsum(later) - later, later) + 1
        for text_of, begin, skip in ((np.arange(len(n)), np.zeros(len(n), np.int64), 0), (which, number * STRIDE, OVERLAP)):
            first, left = at[text_of] + begin, n[text_of] - begin
            for a in range(0, len(first), GROUPED):
                some = first[a : a + GROUPED]
                mean = np.concatenate([self.mean(windows[some[b : b + BATCH]], skip) for b in range(0, len(some), BATCH)])
                inside = steps[skip:] < left[a : a + GROUPED, None]
                where = (some[:, None] + steps[skip:])[inside]
                found, opens[where] = self.log10(mean[inside], before[where], stream[where])
                out[where] += found
        return out, opens

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text's ids."""
        return np.add.reduceat(self.each(ids, at)[0], at[:-1])

    def words(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token: log10 probability given that a word opens there and that the next one opens behind it;
        where each text's tokens begin (one more: the end); and log10 probability of each text's ids."""
        found, opens = self.each(ids, at)
        first = np.flatnonzero(self.starts[ids])
        token = np.add.reduceat(found, first) - opens[first]
        last = np.searchsorted(first, at[1:]) - 1  # the end of each text
        behind = np.append(opens[first[1:]], 0.0)
        behind[last] = 0.0
        return token + behind, np.append(0, last + 1), np.add.reduceat(found, at[:-1])


def _common(counts: np.ndarray) -> np.ndarray:
    """The frequent ids, most frequent first, without the end."""
    order = np.argsort(-counts[:-1], kind="stable")[:COMMON]
    return order[counts[order] > 0]


def _places(common: np.ndarray, size: int) -> np.ndarray:
    place = np.full(size + 1, -1, np.int32)
    place[common] = np.arange(len(common))
    return place


def _neighbours(ids: np.ndarray, at: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often each of n frequent ids follows, and goes before, each of the NEAR most frequent."""
    near = min(NEAR, n)
    number = np.take(place, ids)
    number[at[1:] - 1] = -1  # the end, where two texts meet, is not frequent
    left, right = number[:-1], number[1:]
    known = (left >= 0) & (right >= 0)
    width, found = 2 * near, []
    for some, row, column in ((known & (left < near), right, left), (known & (right < near), left, right + near)):
        some = np.flatnonzero(some)
        found.append(row[some].astype(np.int64) * width + column[some])
    return np.bincount(np.concatenate(found), minlength=n * width)


def _classes(counts: np.ndarray, common: np.ndarray, around: np.ndarray, starts: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for each id: 0 begins and ends a text, the last one holds ids that are not frequent.

    Frequent ids are grouped by the ids around them (k-means over neighbour counts),
    those that open a word apart from others.
    """
    rng = np.random.default_rng(seed)
    out = np.full(len(counts), CLASSES - 1, np.int64)
    out[-1] = 0
    if not len(common):
        return out
    around = around.reshape(len(common), -1).astype(np.float32)
    around = np.sqrt(around / np.maximum(around.sum(1, keepdims=True), 1))
    opens = starts[common]
    total = min(CLASSES - 2, len(common))
    n_open = int(opens.sum())
    k_open = min(n_open, total - 1, max(1, round(total * n_open / len(common)))) if 0 < n_open < len(common) else total * (n_open > 0)
    begin = 1
    for some, k in ((np.flatnonzero(opens), k_open), (np.flatnonzero(~opens), total - k_open)):
        if not len(some):
            continue
        mine, weight = around[some], counts[common[some]].astype(np.float32)
        k = min(k, len(some))
        centres = mine[:k].copy()
        for _ in range(12):
            nearest = np.argmax(mine @ centres.T - (centres**2).sum(1) / 2, 1)
            for c in range(k):
                inside = nearest == c
                centres[c] = np.average(mine[inside], axis=0, weights=weight[inside]) if inside.any() else mine[rng.integers(len(mine))]
        out[common[some]] = begin + nearest
        begin += k
    return out


def _follows(ids: np.ndarray, at: np.ndarray, class_of: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often each of n frequent ids comes after each class; then how often each class does."""
    classes = class_of[ids]
    previous = np.roll(classes, 1)
    previous[at[:-1]] = 0
    number = place[ids]
    known = number >= 0
    return np.append(np.bincount(previous[known] * n + number[known], minlength=CLASSES * n), np.bincount(previous * CLASSES + classes, minlength=CLASSES * CLASSES))


def _windows(ids: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and ids of windows that cover whole texts, each with the id before it; -1 where the text is over."""
    n = np.diff(at)
    count = -(-n // WINDOW)
    first = np.cumsum(count) - count
    steps = np.arange(-1, WINDOW)
    factor = np.random.default_rng(7).integers(0, 1 << 64, len(steps), dtype=np.uint64) | np.uint64(1)
    for a in range(0, int(count.sum()), 1 << 15):
        number = np.arange(a, min(a + (1 << 15), int(count.sum())))
        t = np.searchsorted(first + count, number, "right")
        to = (number - first[t])[:, None] * WINDOW + steps
        found = ids[np.clip(at[t][:, None] + to, 0, len(ids) - 1)].astype(np.int32)
        found[to < 0] = size  # what begins a text is what ends one
        found[to >= n[t][:, None]] = -1
        yield mix((found.astype(np.int64).view(np.uint64) * factor).sum(1, dtype=np.uint64)), found


def _begin(seed: int = 5) -> dict[str, np.ndarray]:
    """First weights: attention adds nothing to the logits yet."""
    rng = np.random.default_rng(seed)
    p = {name: rng.normal(0, 0.3, (CLASSES, WIDTH)) for name in ("q", "k", "l")}
    return {**p, "b": np.zeros((CLASSES, WIDTH)), "r": np.zeros((WIDTH, CLASSES)), "d": np.zeros(WINDOW)}


def _by_class(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sum of the rows of each class."""
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    count = np.bincount(classes, minlength=CLASSES)
    some = np.flatnonzero(count)
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    out[some] = np.add.reduceat(np.take(rows, order, 0), (np.cumsum(count) - count)[some], 0)
    return out


def _improve(p: dict[str, np.ndarray], base: np.ndarray, windows: np.ndarray, class_of: np.ndarray, steps: int = 0, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights after Adam over the windows: each of them once, or all of them as often as ``steps`` steps need.

    The logits are ``base`` of the last class, and what its row of b and the mean of rows of l give by r.
    They are made, used and overwritten ``SLICE`` places at a time.
    """
    kind = np.float32
    shapes = {name: value.shape for name, value in p.items()}
    cuts = np.cumsum([value.size for value in p.values()])[:-1]

    def by_name(flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: x.reshape(shape) for (name, shape), x in zip(shapes.items(), np.split(flat, cuts), strict=True)}

    whole, base = np.concatenate([value.ravel() for value in p.values()]).astype(kind), base.astype(kind)
    p = by_name(whole)
    if not len(windows):
        return p
    slope, first, second = np.zeros((3, whole.size), kind)
    grads = by_name(slope)
    logits, more = np.empty((2, SLICE, CLASSES), kind)
    line, ones = np.arange(SLICE) * CLASSES, np.ones(max(CLASSES, STEP), kind)
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(windows)) for _ in range(max(1, ceil(steps * STEP / len(windows))))])
    steps = ceil(len(order) / STEP)
    near = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))
    masked, back = near < 0, np.maximum(near, 0)
    for step in range(1, steps + 1):
        some = windows[order[(step - 1) * STEP : step * STEP]]
        classes = np.take(class_of, some)
        x, y = classes[:, :-1], classes[:, 1:].ravel()
        flat, n = x.ravel(), x.size
        weight = (some[:, 1:] >= 0).ravel().astype(kind)
        weight /= weight.sum()
        q, k, v = (np.take(p[name], x, 0) for name in "qkl")
        a = q @ k.transpose(0, 2, 1)
        a += np.where(masked, kind(-np.inf), p["d"][back] + (40 - (p["q"] @ p["k"].T).max() - p["d"].max()))  # finite, as in _model
        np.exp(a, out=a)
        total = (a.reshape(n, WINDOW) @ ones[:WINDOW])[:, None]
        mean = (a @ v).reshape(n, WIDTH) / total
        h = mean + np.take(p["b"], flat, 0)
        dh, left = np.empty_like(h), np.ascontiguousarray(p["r"].T)
        slope.fill(0)
        for i in range(0, n, SLICE):
            at = slice(i, min(n, i + SLICE))
            g, z = logits[: at.stop - i], more[: at.stop - i]
            np.matmul(h[at], p["r"], out=g)
            g += np.take(base, flat[at], 0, out=z, mode="clip")
            np.exp(g, out=g)
            sums = g @ ones[:CLASSES]
            g.ravel()[line[: len(g)] + y[at]] -= sums
            scale = (weight[at] / sums)[:, None]
            dh[at] = (g @ left) * scale
            grads["r"] += (g.T @ (h[at] * scale)).T
        share = dh / total
        each = share.reshape(-1, WINDOW, WIDTH)
        ds = each @ v.transpose(0, 2, 1)
        ds -= ((share * mean) @ ones[:WIDTH]).reshape(-1, WINDOW, 1)
        ds *= a
        rows = np.empty((len(x), WINDOW, 4, WIDTH), kind)
        np.matmul(ds, k, out=rows[:, :, 0])
        np.matmul(ds.transpose(0, 2, 1), q, out=rows[:, :, 1])
        np.matmul(a.transpose(0, 2, 1), each, out=rows[:, :, 2])
        rows[:, :, 3] = dh.reshape(each.shape)
        sums = _by_class(rows.reshape(n, -1), flat)
        for name, begin in zip("qklb", range(0, 4 * WIDTH, WIDTH), strict=True):
            grads[name][:] = sums[:, begin : begin + WIDTH]
        grads["d"][:] = np.bincount(back.ravel(), np.where(masked, 0, (ones[: len(x)] @ ds.reshape(len(x), -1)).reshape(masked.shape)).ravel(), WINDOW)
        speed = rate * min(1, 2 * (1 - step / (steps + 1)))
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        whole -= speed / (1 - 0.9**step) * first / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return p


def _base(pairs: np.ndarray) -> np.ndarray:
    """Log share of each class after each class."""
    pairs = pairs.reshape(CLASSES, CLASSES) + 0.5
    return np.log(pairs / pairs.sum(1, keepdims=True))


def _model(counts: np.ndarray, common: np.ndarray, class_of: np.ndarray, follows: np.ndarray, p: dict[str, np.ndarray], base: np.ndarray, starts: np.ndarray) -> AttentionModel:
    counts = counts + 0.1
    share = np.log10(counts / np.bincount(class_of, counts, CLASSES)[class_of])
    follows = follows.reshape(CLASSES, len(common)).astype(np.float64)
    total = np.zeros((CLASSES, CLASSES))
    np.add.at(total.T, class_of[common], follows.T)
    after = np.zeros((CLASSES, max(1, len(common))))
    after[:, : len(common)] = np.log10((follows + SHRINK * 10 ** share[common]) / (total[:, class_of[common]] + SHRINK))
    skip = base + p["b"] @ p["r"]
    skip[:, np.bincount(class_of, minlength=CLASSES) == 0] = -1e9  # a class without ids cannot follow
    small = lambda z: z.astype(np.float32)
    near = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))
    # A constant added to all attention scores changes nothing; this one keeps their exponentials finite.
    level = 40 - (p["q"] @ p["k"].T).max() - p["d"].max()
    return AttentionModel(
        class_of, share, _places(common, len(counts) - 1), small(after), small(p["q"]), small(p["k"]), small(p["l"]), small(p["r"]), small(skip),
        small(np.where(near < 0, -1e9, p["d"][np.maximum(near, 0)] + level)), starts,
        small(np.stack([np.ones(CLASSES), np.maximum(np.bincount(class_of, 10**share * starts, CLASSES), 1e-30)], 1)),
    )


def _only_end(size: int) -> np.ndarray:
    return np.arange(size + 1) == size


def train(ids: np.ndarray, at: np.ndarray, size: int, steps: int = 800, starts: np.ndarray | None = None) -> AttentionModel:
    """Fit the model on texts at hand; ``fit`` does the same over a table."""
    starts = _only_end(size) if starts is None else starts
    counts = np.bincount(ids, minlength=size + 1)
    common = _common(counts)
    place, n = _places(common, size), len(common)
    class_of = _classes(counts, common, _neighbours(ids, at, place, n), starts)
    windows = np.concatenate([np.empty((0, WINDOW + 1), np.int32), *(w for _, w in _windows(ids, at, size))])
    follows, pairs = np.split(_follows(ids, at, class_of, place, n), [CLASSES * n])
    base = _base(pairs)
    return _model(counts, common, class_of, follows, _improve(_begin(), base, windows, class_of, steps), base, starts)


def _kind(size: int) -> np.dtype:
    """The least type that holds all ids and the end."""
    return np.dtype(np.uint16 if size < 1 << 16 else np.int32)


def _stored(ids: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    kind = _kind(size)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])


def _read(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column in a row, and where each text begins (one more: the end)."""
    kind = _kind(size)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(kind).astype(np.int32)
    return ids, (at - at[0]) // kind.itemsize


def _gathered(batches: Iterator[pa.RecordBatch], size: int, least: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and beginnings of the texts of several batches at a time, ``least`` ids or all that are left."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def joined_ids() -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum([0, *(len(ids) for ids, _ in held)])
        return np.concatenate([ids for ids, _ in held]), np.concatenate([*(at[:-1] + b for (_, at), b in zip(held, begins, strict=False)), begins[-1:]])

    for batch in batches:
        if batch.num_rows:
            held.append(_read(batch.column(0), size))
            n += len(held[-1][0])
            if n >= least:
                yield joined_ids()
                held, n = [], 0
    if held:
        yield joined_ids()


def _added(parts: DataFrame, size: int, kind: type = np.int64, n: int | None = None) -> np.ndarray:
    """Sum of the rows of ``size`` numbers that ``n`` tasks return, by a tree of tasks.

    Without ``n`` the plan is asked for it, which would run its shuffles once more.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    n = n or parts.rdd.getNumPartitions()
    while n > 4:
        n = ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(released(add), "part binary")
    total = np.zeros(size, kind)
    for r in parts.collect():
        total += np.frombuffer(r["part"], kind)
    return total


def _counted(ids: DataFrame, size: int, n: int, count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``n`` counts over the ids of all texts."""
    if not n:
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for ids, at in _gathered(batches, size):
            total += count(ids, at)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return _added(ids.mapInArrow(released(run), "part binary"), n)


def _distinct(texts_of: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ids of the windows of texts, each once and in order of hash, wherever the texts were held."""
    found = [x for ids, at in texts_of for x in _windows(ids, at, size)]
    if not found:
        return np.empty(0, np.uint64), np.empty((0, WINDOW + 1), np.int32)
    h, first = np.unique(np.concatenate([x for x, _ in found]), return_index=True)
    return h, np.concatenate([w for _, w in found])[first]


def _teaches(ids: pa.Array, learned: pa.Array, seen: set[bytes]) -> pa.Array:
    """Which of the texts are learned from and not among those seen, which are forgotten when they are many."""
    out = []
    for x, mine in zip(ids, learned.to_pylist(), strict=True):
        h = hashlib.blake2b(x.as_buffer(), digest_size=16).digest() if mine else None
        out.append(mine and h not in seen)
        if out[-1]:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(h)
    return pa.array(out, pa.bool_())


def _texts(ids: DataFrame, since: float, until: float, n: int) -> DataFrame:
    """Each text once whose hash lies between two shares of all hashes, dealt by what it holds to ``n`` tasks."""
    h = F.shiftrightunsigned(F.xxhash64("ids"), 11) / F.lit(float(1 << 53))
    return ids.where((h >= F.lit(since)) & (h < F.lit(until))).repartition(n, "ids").dropDuplicates(["ids"])


def _window_table(ids: DataFrame, size: int, share: float) -> DataFrame:
    """(h, w): the windows of the texts with hashes in the lowest ``share``, each once however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, found = _distinct(_gathered(batches, size), size)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([x.tobytes() for x in found], pa.binary())], ["h", "w"])

    return _texts(ids, 0.0, share, 1).mapInArrow(released(run), "h long, w binary")


def fit(ids: DataFrame, size: int, starts: np.ndarray | None = None, fewer: DataFrame | None = None) -> AttentionModel:
    """Fit the model on a table of ids (one binary column) of whole training texts; ``starts`` marks ids that open words.

    ``fewer`` has each text at least once: where it is given, copies that it lacks need not meet before they are dropped.

    Counts of ids, neighbours and ids after classes are over all texts, and the
    attention weights are fitted on every window of every distinct text.  Few windows
    are gathered by the driver.  Otherwise the texts are dealt into rounds by hash:
    the tasks of a round improve the weights on their windows, each once, and the
    mean of what they find is what the next round begins with.
    """
    starts = _only_end(size) if starts is None else starts
    fewer = ids if fewer is None else fewer
    counts = _counted(ids, size, size + 1, lambda x, at: np.bincount(x, minlength=size + 1))
    common = _common(counts)
    place, n = _places(common, size), len(common)
    around = _counted(ids, size, n * 2 * min(NEAR, n), lambda x, at: _neighbours(x, at, place, n))
    class_of = _classes(counts, common, around, starts)
    follows, pairs = np.split(_counted(ids, size, CLASSES * (n + CLASSES), lambda x, at: _follows(x, at, class_of, place, n)), [CLASSES * n])
    base, p = _base(pairs), _begin()
    most = int(counts.sum()) // WINDOW + int(counts[size])  # windows, copies included
    if most <= WARM:
        windows = [np.frombuffer(r["w"], np.int32) for r in _window_table(fewer, size, 1.0).select("w").collect()]
        p = _improve(p, base, np.array(windows, np.int32).reshape(-1, WINDOW + 1), class_of, WARM // STEP)
        return _model(counts, common, class_of, follows, p, base, starts)
    shapes = {name: value.shape for name, value in p.items()}
    cuts = np.cumsum([value.size for value in p.values()])
    borders = (0.0, SHARE, SHARE + SECOND * (1 - SHARE), 1.0)
    for turn, rate in enumerate(RATES):

        def run(batches: Iterator[pa.RecordBatch], before: dict = p, rate: float = rate, turn: int = turn) -> Iterator[pa.RecordBatch]:
            mine = _distinct(_gathered(batches, size), size)[1]
            better = _improve(before, base, mine, class_of, rate=rate, seed=turn)
            flat = np.concatenate([*(value.ravel() for value in better.values()), [1.0]]) * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["part"])

        since, until = borders[turn : turn + 2]
        tasks = ceil((until - since) * most / DEALT)
        flat = _added(_texts(fewer, since, until, tasks).mapInArrow(released(run), "part binary"), int(cuts[-1]) + 1, np.float64, tasks)
        if flat[-1]:  # a round may have no texts
            p = {name: x.reshape(shapes[name]) for name, x in zip(shapes, np.split(flat[:-1] / flat[-1], cuts[:-1]), strict=True)}
    return _model(counts, common, class_of, follows, p, base, starts)


# -- counts and scores over tables ------------------------------------------

_END = np.uint64(1)  #: stands for the end among word hashes
_MERGE = 2_000_000  #: distinct words that a task gathers before it passes them on


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_texts = size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        unique, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return unique, np.bincount(inverse, np.concatenate([n for _, n in held]), len(unique)).astype(np.int64)

    def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for batch in batches:
        n_texts += batch.num_rows
        for _, part in texts(batch.column(0), 16 * BLOCK):
            found = Words(part)
            held.append((found.unique, np.bincount(found.inverse, minlength=len(found.unique))))
            size += len(found.unique)
            if size > _MERGE:
                held = [merged()]
                size = len(held[0][0])
                if size > _MERGE // 2:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())
    if n_texts:
        yield rows(np.array([_END]), np.array([n_texts], np.int64))


@dataclass(frozen=True)
class Counts:
    """Token counts of the training texts: all in a table, the frequent ones at hand."""

    table: DataFrame  #: (h, n), one row per distinct token
    tokens: int
    distinct: int
    words: np.ndarray  #: hashes of frequent tokens, sorted
    counts: np.ndarray
    ends: int  #: of the end, which is the number of training texts


def count_tokens(df: DataFrame, text: str, frequent: int = FREQUENT) -> Counts:
    """Count every token of every text of ``df``.

    The table of counts stays distributed.  The most frequent tokens, ``frequent``
    at most, are gathered for the workers; where the cut falls decides only which
    way a token's count is found, not what it is.
    """
    counted = df.select(text).mapInArrow(released(_count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    table = materialize(counted, "counts")
    step = F.floor(F.log2("n") * 16)
    bins = sorted(table.groupBy(step.alias("_b")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect(), key=lambda r: -r["_b"])
    tokens, distinct = sum(r["n"] for r in bins), sum(r["v"] for r in bins)
    least, gathered = None, 0
    for r in bins:
        gathered += r["v"]
        if gathered > frequent:
            break
        least = r["_b"]
    near = table.where(step >= least).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    h, n = near["h"].to_numpy().view(np.uint64), near["n"].to_numpy()
    order = np.argsort(h)
    ends = table.where(F.col("h") == int(_END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Counts(table, tokens, distinct, h[order], n[order], ends)


@dataclass(frozen=True)
class _Coder:
    """What the first pass needs: the vocabulary, and which words are at hand."""

    ranks: str
    pattern: str
    words: np.ndarray

    def find(self, found: Words) -> np.ndarray:
        """Place of every distinct word at hand, -1 for others."""
        if not len(self.words):
            return np.full(len(found.unique), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, found.unique), len(self.words) - 1)
        return np.where(self.words[at] == found.unique, at, -1)

    def places(self, found: Words, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Place of every token at hand, -1 for others and -2 for ends; where each text's tokens begin; hashes of the others."""
        n = len(found.first) - 1
        place = distinct[found.inverse]
        far = np.flatnonzero(place < 0)
        hashes_of = found.unique[found.inverse[far]]
        begins = found.first + np.arange(n + 1)
        out = np.full(begins[-1], -2, np.int32)
        out[np.arange(len(place)) + np.repeat(np.arange(n), np.diff(found.first))] = place
        return out, begins, np.split(hashes_of, np.searchsorted(far, found.first[1:-1]))


@dataclass(frozen=True)
class _Mixture:
    """What the second pass needs: the attention model and the counts at hand."""

    model: AttentionModel
    counts: np.ndarray
    ends: int
    tokens: int
    scale: int
    attention: float

    def score(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: known tokens, base sum, mixture sum, log10 probability of the ids; then the tokens that are not at
        hand: log10 by attention, and where each text's begin."""
        token, first, whole = self.model.words(ids, at)
        count = np.where(place >= 0, self.counts[np.maximum(place, 0)] if len(self.counts) else 0, np.where(place == -2, self.ends, 0))
        here = place != -1
        mixed = token + np.log10(self.attention)
        seen = here & (count > 0)
        mixed[seen] = np.logaddexp(mixed[seen] / _LOG10E, np.log((1 - self.attention) * count[seen] / max(1, self.tokens))) * _LOG10E
        sums = lambda x: np.add.reduceat(np.where(here, x, 0), first[:-1])
        far = np.flatnonzero(~here)
        return sums(count > 0).astype(np.int64), sums(np.log10((count + 1) / self.scale)), sums(mixed), whole, token[far], np.searchsorted(far, first)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64)))


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value per slice of ``values``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def score(df: DataFrame, key: str, text: str, learn: Column, ranks: str, pattern: str, attention: float = ATTENTION) -> DataFrame:
    """(key, learned, n_tokens, n_known, train_tokens, base_score, attention_score, score) of every whole text.

    Rows where ``learn`` holds teach, all of them and whole: the token counts and
    the attention model (``fit``).  base_score is the sum over tokens of
    log10((count + 1) / (tokens + distinct + 1)); attention_score is the log10
    probability that attention alone gives the ids.  score is the model's log10
    probability of the text: that of each token is ``attention`` of what attention
    gives it as a whole word, plus the rest of its share among the training tokens.
    Null and empty texts are an end alone.  Repeated rows are scored each; an empty
    table gives no rows; without training rows all counts are 0; other columns are
    left out.
    """
    if not 0 < attention <= 1:
        raise ValueError("attention must be above 0 and at most 1")
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    counts = count_tokens(rows.where("_learn"), "_text")
    scale = counts.tokens + counts.distinct + 1
    subwords = _subwords_of(ranks, pattern)
    size = subwords.size
    coder_of = spark.sparkContext.broadcast(_Coder(ranks, pattern, counts.words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder_of.value
        coder = _subwords_of(own.ranks, own.pattern)
        coder.hold(own.words)
        seen: set[bytes] = set()
        for batch in batches:
            for first, part in texts(batch.column(2), 16 * BLOCK):
                found = Words(part)
                distinct = own.find(found)
                place, begins, far = own.places(found, distinct)
                ids = _stored(*coder.encode(found, distinct), size)
                learned = batch.column(3).slice(first, len(part))
                teaches = _teaches(ids, learned, seen)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, len(part)) for i in (0, 1)), learned,
                        pa.array(np.diff(begins).astype(np.int64)), ids, _blobs(place, begins), _lists(far), teaches,
                    ],
                    ["row", "key", "learned", "n_tokens", "ids", "place", "far", "teaches"],
                )

    kind = df.schema[key].dataType.simpleString()
    facts = f"row long, key {kind}, learned boolean, n_tokens long"
    encoded = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "_key", "_text", "_learn").mapInArrow(released(encode), f"{facts}, ids binary, place binary, far array<long>, teaches boolean"), "encoded"
    )
    model = fit(encoded.where("learned").select("ids"), size, subwords.starts, encoded.where("teaches").select("ids"))
    mixture = spark.sparkContext.broadcast(_Mixture(model, counts.counts, counts.ends, counts.tokens, scale, attention))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = np.frombuffer(b"".join(x.as_py() for x in batch.column(5)), np.int32)
                known, base, mixed, whole, token, at = mixture.value.score(*_read(batch.column(4), size), place)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], *map(pa.array, (known, base, whole, mixed)), batch.column(6), lists], ["row", "key", "learned", "n_tokens", "known", "base", "whole", "mixed", "far", "alone"]
                )

    sums = "known long, base double, whole double, mixed double"
    scored = materialize(encoded.drop("teaches").mapInArrow(released(run), f"{facts}, {sums}, far array<long>, alone array<double>"), "scored")
    # Tokens that are not at hand get their counts by a join.
    rest = scored.select("row", F.explode(F.arrays_zip("far", "alone")).alias("_w")).select("row", F.col("_w.far").alias("h"), F.col("_w.alone").alias("_a"))
    found = rest.join(counts.table, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a = F.col("_a") + F.lit(float(np.log10(attention)))
    if attention < 1:
        c = F.log10(F.col("n") * F.lit((1 - attention) / max(1, counts.tokens)))
        most = F.greatest(a, c)
        a = F.when(F.col("n") > 0, most + F.log10(F.pow(F.lit(10.0), a - most) + F.pow(F.lit(10.0), c - most))).otherwise(a)
    added = found.groupBy("row").agg(
        F.sum(F.log10((F.col("n") + F.lit(1.0)) / F.lit(float(scale)))).alias("_base"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("_known"), F.sum(a).alias("_mixed")
    )
    return scored.drop("far", "alone").join(added, "row", "left").select(
        F.col("key").alias(key), "learned", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        F.col("whole").alias("attention_score"), (F.col("mixed") + F.coalesce("_mixed", F.lit(0.0))).alias("score"),
    )
