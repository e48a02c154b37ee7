"""Byte-level BPE by backtracking, and decoding by an offset table.

A piece of text is covered by tokens found with an Aho-Corasick automaton, the
longest first.  Two neighbouring tokens are kept only if the merges could not
have joined across their border (the pair-compatibility check, remembered in a
table); otherwise the last token is shortened, or given up and the one before it
shortened.  Positions that were given up are marked, so each is tried once and
the time is linear.  A covering whose neighbours are all compatible is the one
that applying the merges in order of rank gives.

Decoding looks each id up in one byte string of all tokens and its offsets.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import BLOCK, released, texts
from .storage import prepare

#: Fixed value: the pattern that the tokenizer file's byte-level splitter stands for.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Ranges that newer character tables call letters or numbers and the tokenizers library does not.
NEWER = (
    0x558, 0x558, 0x58B, 0x58C, 0x88F, 0x88F, 0xC5C, 0xC5C, 0xCDC, 0xCDC, 0x208F, 0x208F, 0x209D, 0x209F, 0xA7CE, 0xA7CF, 0xA7D2, 0xA7D2,
    0xA7D4, 0xA7D4, 0xA7DD, 0xA7DD, 0xA7E2, 0xA7E2, 0xA7F1, 0xA7F1, 0xAB6C, 0xAB6D, 0x107BB, 0x107BF, 0x10940, 0x10959, 0x10EC5, 0x10EC7,
    0x10ED9, 0x10EEE, 0x11B0A, 0x11B0A, 0x11DB0, 0x11DDB, 0x11DE0, 0x11DE9, 0x11DF1, 0x11DF1, 0x1246F, 0x1246F, 0x12475, 0x1247F,
    0x12550, 0x12686, 0x16EA0, 0x16EB8, 0x16EBB, 0x16ED3, 0x16FF2, 0x16FF6, 0x187F8, 0x187FF, 0x18CD6, 0x18CDA, 0x18D09, 0x18D20,
    0x18D80, 0x18DF2, 0x18E00, 0x19191, 0x191A0, 0x191D2, 0x1B123, 0x1B128, 0x1B168, 0x1B168, 0x1D6A6, 0x1D6A6, 0x1DF1F, 0x1DF24,
    0x1DF2B, 0x1DF81, 0x1DF90, 0x1DF96, 0x1DFCD, 0x1DFFF, 0x1E6C0, 0x1E6DE, 0x1E6E0, 0x1E6E2, 0x1E6E4, 0x1E6E5, 0x1E6E7, 0x1E6ED,
    0x1E6F0, 0x1E6F4, 0x1E6FE, 0x1E6FF, 0x2B73A, 0x2B73F, 0x2B81E, 0x2B81E, 0x2CEA2, 0x2CEAD, 0x323B0, 0x33479, 0x3D000, 0x3FC3F,
)
_NEWER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(NEWER[::2], NEWER[1::2], strict=True)) + "]"
#: The same pattern without those ranges; only texts with characters beyond the first of them need it.
SPLIT_RARE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--{_NEWER}]+| ?[\p{{N}}--{_NEWER}]+| ?(?:[^\s\p{{L}}\p{{N}}]|{_NEWER})+|\s+(?!\S)|\s+", regex.V1
)
_RARE_LEAD = 0xD4  #: UTF-8 lead bytes of U+0500 and above
CACHE = 250_000  #: pieces, and pairs of tokens, that a worker remembers; then it starts anew
CACHE_BYTES = 16 << 20  #: and characters in these pieces


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer(dict):
    """Encoder and decoder of one vocabulary; as a dict, the numbers of the pieces seen.

    ``spec`` is the text of a byte-level BPE file of the tokenizers library
    without normaliser, in which each token is what the merges make of its own
    bytes, as in any vocabulary made by training; its special tokens are found in a text before anything
    else and decode to their own text.
    """

    def __init__(self, spec: str) -> None:
        super().__init__()
        made = json.loads(spec)
        symbols = _byte_symbols()
        vocab = {bytes(symbols[c] for c in word): i for word, i in made["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # A token's rank: bytes first, then merged tokens in order of their merge.
        order = [bytes([b]) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        rank = {w: i for i, w in enumerate(order)}
        halves = [(i, i) for i in range(256)]
        for left, right in merges:
            a, b = (bytes(symbols[c] for c in x) for x in (left, right))
            self.pair[rank[a], rank[b]] = rank[a + b] = len(order)
            halves.append((rank[a], rank[b]))
            order.append(a + b)
        self.halves, self.length = halves, [len(w) for w in order]
        self.id_of = [vocab[w] for w in order]
        self.rank = {w.decode("latin-1"): i for w, i in rank.items()}
        self.automaton = ahocorasick.Automaton()
        for word, i in self.rank.items():
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.shorter = [next((rank[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in rank), -1) for w in order]
        self.compatible: dict[int, bool] = {}
        # Decoding: the bytes of all ids in a row, and where each begins.
        size = 1 + max([*vocab.values(), *self.special.values()])
        table = [b""] * size
        for w, i in vocab.items():
            table[i] = w
        for w, i in self.special.items():
            table[i] = w.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(w) for w in table], out=self.offsets[1:])
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.held = 0
        self.piece_ids, self.piece_at = array("i"), array("q", [0])
        for word, i in self.special.items():
            self._remember(word, [i])

    def _remember(self, piece: str, ids: list[int]) -> int:
        n = len(self.piece_at) - 1
        self.piece_ids.extend(ids)
        self.piece_at.append(len(self.piece_ids))
        self.held += len(piece)
        self[piece] = n
        return n

    def __missing__(self, piece: str) -> int:
        return self._remember(piece, self.encode_piece(piece.encode()))

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave a border between these neighbours."""
        place = left * len(self.halves) + right
        known = self.compatible.get(place)
        if known is None:
            a, b, limit = left, right, len(self.halves)
            while True:
                if self.pair.get((a, b), limit) < limit:
                    known = False
                    break
                if a > b:  # the later of the two was made last: look at what it was made of
                    limit, a = a, self.halves[a][1]
                    if a == limit:
                        limit, b = b + 1, self.halves[b][0]
                        if b + 1 == limit:
                            known = True
                            break
                else:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 == limit:
                        limit, a = a, self.halves[a][1]
                        if a == limit:
                            known = True
                            break
            if len(self.compatible) > CACHE:
                self.compatible.clear()
            self.compatible[place] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by backtracking."""
        word = piece.decode("latin-1")
        length, fits = self.length, self._fits
        found: list[int] = []
        for _, token in self.automaton.iter_long(word):
            if found and not fits(found[-1], token):
                break
            found.append(token)
        else:
            return [self.id_of[t] for t in found]
        match: dict[int, int] = {}
        for end, token in self.automaton.iter(word):
            start = end - length[token] + 1
            if start not in match or length[token] > length[match[start]]:
                match[start] = token
        open_ends = bytearray(b"\x01") * (len(word) + 1)
        found, at, token = [], 0, match[0]
        while token is not None:
            last = found[-1] if found else None
            while True:
                end = at + length[token]
                if open_ends[end] and (last is None or fits(last, token)):
                    found.append(token)
                    at, token = end, match.get(end)
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_ends[at] = 0
                found.pop()
                at, token = at - length[last], last
                break
        return [self.id_of[t] for t in found]

    def encode_batch(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts in a row, and where each text begins (one more: the end)."""
        if len(self) > CACHE or self.held > CACHE_BYTES:
            self._forget()
        look = self.__getitem__
        pieces = array("q")
        ends = [0]
        for one in docs:
            text = one.decode()
            split = SPLIT_RARE if one and np.frombuffer(one, np.uint8).max() >= _RARE_LEAD else SPLIT
            if any(s in text for s in self.special):
                for part in self.special_split.split(text):
                    pieces.extend([look(part)] if part in self.special else map(look, split.findall(part)))
            else:
                pieces.extend(map(look, split.findall(text)))
            ends.append(len(pieces))
        numbers = np.frombuffer(pieces, np.int64) if len(pieces) else np.empty(0, np.int64)
        ids, at = gather(np.frombuffer(self.piece_ids, np.int32), np.frombuffer(self.piece_at, np.int64), numbers)
        return ids, at[np.array(ends)]

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids."""
        data, at = gather(self.data, self.offsets, ids)
        whole, at = data.tobytes(), at[starts].tolist()
        return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def gather(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate data[offsets[i]:offsets[i+1]] for i in which; also where each begins."""
    first = offsets[which]
    at = np.zeros(len(which) + 1, np.int64)
    np.cumsum(offsets[which + 1] - first, out=at[1:])
    index = np.repeat(first - at[:-1], np.diff(at)) + np.arange(at[-1])
    return data[index], at


_tokenizers: dict[int, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    """One tokenizer per worker and vocabulary; it outlives tasks."""
    key = hash(spec)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(spec)
    return _tokenizers[key]


def _batches(spec: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    tokenizer = _tokenizer(spec)
    for batch in batches:
        for first, part in texts(batch.column(1), BLOCK):
            ids, starts = tokenizer.encode_batch(part)
            yield tokenizer, batch.column(0).slice(first, len(part)), ids, starts


def encode(df: DataFrame, key: str, text: str, spec: str) -> DataFrame:
    """(key, ids array<int>) of every whole text; null and empty texts have no ids.

    Other columns are left out.  Repeated rows are encoded each; an empty table
    gives no rows.
    """
    share = prepare(df.sparkSession).sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, ids, starts in _batches(share.value, batches):
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(released(run), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, spec: str) -> DataFrame:
    """(key, text) from lists of ids; a null list decodes to an empty text."""
    share = prepare(df.sparkSession).sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(share.value)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            out = [x.decode("utf-8", "replace") for x in tokenizer.decode_batch(flat, starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(released(run), f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str, text: str, spec: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return what describes both.

    (key, n_tokens, ids_sha256 of the decimal ids joined by commas,
    decoded_sha256 of the decoded UTF-8).  Both directions run in one pass over
    Arrow batches, so ids and decoded texts never leave the worker.  Nulls, empty
    texts and repeated rows are treated as in ``encode``.
    """
    share = prepare(df.sparkSession).sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for tokenizer, keys, ids, starts in _batches(share.value, batches):
            names = names or [str(i).encode() for i in range(len(tokenizer.offsets) - 1)]
            decoded = tokenizer.decode_batch(ids, starts)
            at, spoken = starts.tolist(), list(map(names.__getitem__, ids.tolist()))
            digests = [hashlib.sha256(b",".join(spoken[a:b])).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(starts), pa.int64()), pa.array(digests), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(key, text).mapInArrow(released(run), schema).withColumnRenamed("key", key)
