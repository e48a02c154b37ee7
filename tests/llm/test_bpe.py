import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from lexweave.llm.bpe import Tokenizer, decode, encode, round_trip

from .conftest import same


@pytest.fixture(scope="module")
def library():
    made = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def ours(spec):
    return Tokenizer(spec)


def ids_of(tokenizer, texts):
    ids, at = tokenizer.encode_batch([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_every_token_covers_itself(ours):
    assert all(ours.encode_piece(word.encode("latin-1")) == [ours.id_of[i]] for word, i in ours.rank.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(ours, library, text):
    assert ids_of(ours, [text])[0] == library.encode(text, add_special_tokens=False).ids


def test_random_pieces_as_the_library(ours, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrst uv'sre  \n\té中😀09<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["ab" * 4000, "x" * 9000, " \n " * 500, "<|endoftext|><|endoftext|> a", chr(0x88F) + chr(0x10940) + "a"]
    assert ids_of(ours, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_digests_of_a_table(spark, documents, clashing, empty, rows, spec, library):
    got = sorted(map(repr, round_trip(documents, "doc_id", "text", spec).collect()))
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a!r}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{d}')" for a, b, c, d in want)
    assert same(round_trip(clashing, "doc_id", "text", spec), round_trip(documents, "doc_id", "text", spec))
    assert round_trip(empty, "doc_id", "text", spec).count() == 0


def test_encode_then_decode_gives_the_texts(documents, rows, spec):
    back = decode(encode(documents, "doc_id", "text", spec), "doc_id", "ids", spec)
    assert sorted((repr(r[0]), r[1]) for r in back.collect()) == sorted((repr(i), t or "") for i, t, _ in rows)
