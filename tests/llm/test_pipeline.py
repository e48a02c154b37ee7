import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm.queries import tokenizer_spec
from lexweave.llm import bpe

from .conftest import DOCUMENTS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts, marked-up junk, near copies, texts with benchmark passages, and repeated rows."""
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, "en", 25)) for i in range(5)]
    rows, kind = [], {}

    def add(text, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, ("en", "fr", "de")[len(rows) % 3], "s", None))

    for i in range(240):
        add(prose(rng, ("en", "fr", "de")[len(rows) % 3], rng.randint(80, 200)), "good")
    for i in range(60):
        add(" ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in prose(rng, "en", 100).split()), "junk")
    for i in range(20):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        add(" ".join(words), "copy")
    for i in range(10):
        add(prose(rng, "en", 60) + " " + items[i % 5][1] + " " + prose(rng, "en", 60), "leak")
    add(None, "empty")
    add("", "empty")
    documents = spark.createDataFrame(rows + [rows[30], rows[30]], DOCUMENTS)
    documents.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    labels = [(i, int(k != "junk"), 0) for i, k in kind.items() if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), kind


def test_stages_decide_and_keep_columns(spark, folder, tmp_path):
    path, kind = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    share = lambda name, what: sum(kind[i] == what for i in set(kept[name])) / sum(k == what for k in kind.values())
    assert share("quality", "good") > 0.9 and share("quality", "junk") < 0.05 and share("quality", "empty") == 0
    assert set(kept["quality"]) - set(kept["language"]) == set() or share("language", "good") > 0.89
    assert kept["language"].count(30) == 3 and kept["near_duplicates"].count(30) == 1
    groups = [{i, 300 + i} for i in range(20)]
    assert all(len(g & set(kept["near_duplicates"])) == 1 for g in groups if g <= set(kept["language"]))
    assert share("decontaminate", "leak") == 0 and set(kept["near_duplicates"]) - set(kept["decontaminate"]) <= {i for i, k in kind.items() if k == "leak"}
    assert sorted(kept["tokenize"]) == sorted(kept["decontaminate"])
    texts = spark.read.parquet(str(tmp_path / "decontaminate"))
    assert sorted(docs.collect()) == sorted(bpe.round_trip(texts, "doc_id", "text", tokenizer_spec()).collect())
    assert sorted(corpus_pipeline.run(spark, path).collect()) == sorted(docs.collect())


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_rows_of_one_id_are_decided_one_by_one(spark, folder):
    path, _ = folder
    rng = random.Random(12)
    a, b = prose(rng, "en", 90), prose(rng, "fr", 90)
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "fr", "s", 1), (2, b, "fr", "s", 1), (None, a, "en", "s", 1)], DOCUMENTS)
    left = corpus_pipeline.near_duplicates(spark, docs, path).select(F.col("text")).collect()
    assert sorted(r.text for r in left) == sorted([a, b])
