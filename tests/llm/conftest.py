"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import zlib

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves.
CLASHES = ("key", "id", "n", "c", "l", "row", "_row", "h", "prefix", "score", "shard", "_doc", "_w", "_i", "n_words", "token", "root")
SYLLABLES = {"en": "the of and ing er tion th in on re ed".split(), "fr": "le la des eau oux ement que ré ère oui".split(), "de": "der und ung sch ein keit ver ge zu ß".split()}


def prose(rng, lang="en", n=80):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def held_out(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang) with families of copies and near copies."""
    rng = random.Random(3)
    out = []
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, prose(rng, lang, rng.randint(60, 160)), lang))
    for j in range(12):  # near copies of one text, each with a word changed
        words = out[0][1].split(" ")
        words[rng.randrange(len(words))] = f"changed{j}"
        out.append((100 + j, " ".join(words), "en"))
    for j in range(8):  # near copies with ever more words changed
        words = out[1][1].split(" ")
        for _ in range(j):
            words[rng.randrange(len(words))] = f"other{j}x{rng.randrange(9)}"
        out.append((130 + j, " ".join(words), "fr"))
    out += [(150 + j, out[2][1], "de") for j in range(5)]
    out += [
        (200, None, None), (201, "", "en"), (202, " \t\n\x0b\x0c\r ", "en"), (203, "one", "en"), (204, "ONE", "en"), (205, "two words", None), (206, "123 456 !!!", "fr"),
        (207, prose(rng, "en", 30_000), "en"), (208, "x" * 300_000, "en"), (209, "the the the the the the the the the", "en"), (210, "é ü 中文 😀 <|endoftext|> ok", "fr"),
        (None, "no id here at all", "en"), (0, out[0][1], "en"), (0, out[0][1], "en"),
    ]
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    data = [(i, t, lang, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t, lang in rows]
    return spark.createDataFrame(data, DOCUMENTS).repartition(5, "n_chars")


@pytest.fixture(scope="session")
def clashing(documents):
    """The same documents with further columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    return documents.withColumns({name: F.lit(f"{name}!") for name in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def spec():
    from lexweave.llm.queries import tokenizer_spec

    return tokenizer_spec()


def same(a, b):
    """Whether two tables have the same rows."""
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
