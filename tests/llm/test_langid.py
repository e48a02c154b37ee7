import random

from pyspark.sql import functions as F

from lexweave.llm import langid
from lexweave.llm.storage import id_remainder

from .conftest import held_out, prose, same


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(20, 200)), lang) for i in range(600) for lang in [("en", "fr", "de")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, "text", "lang", id_remainder(F.col("doc_id"), 5) != 0)
    found = {r.doc_id: r for r in langid.identify(df, "doc_id", "text", model).collect()}
    test = [(i, lang) for i, _, lang in rows if held_out(i, 5) == 0]
    assert sum(found[i].lang_pred == lang for i, lang in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_are_no_input_and_mislabelled_samples_are_left_out(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 100), "en" if i % 25 == 0 else lang) for i in range(300) for lang in [("fr", "de", "en")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, "text", "lang", F.lit(True))
    a = langid.identify(df, "doc_id", "text", model)
    assert same(a, langid.identify(df.withColumn("lang", F.lit("xx")), "doc_id", "text", model))
    truth = {i: ("fr", "de", "en")[i % 3] for i, _, _ in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in a.collect()) > 285


def test_awkward_rows(documents, clashing, empty):
    model = langid.learn(documents, "text", "lang", F.lit(True))
    found = langid.identify(documents, "doc_id", "text", model)
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, r)
    for i in (200, 201, 202, 206):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[207].lang_pred == "en" and by[210].lang_pred in model.names
    assert found.count() == documents.count()
    assert same(langid.identify(clashing, "doc_id", "text", model), found)
    kept = langid.keep_identified(clashing, "text", model)
    assert kept.columns == clashing.columns and kept.count() == found.where("not rejected").count()
    none = langid.learn(empty, "text", "lang", F.lit(True))
    assert langid.identify(documents, "doc_id", "text", none).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, "doc_id", "text", model).count() == 0


def test_languages_of_long_texts_and_of_many_copies_are_learned(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, "en", 60), "en") for i in range(60)] + [(100 + i, prose(rng, "fr", 9000), "fr") for i in range(6)]
    rows += [(200 + i, prose(rng, "de", 60), "de") for i in range(60)] + [(1000 + i, rows[66 - 1][1][:200], "de") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, "text", "lang", F.lit(True), rows_per_language=40, piece_chars=2000)
    assert set(model.names) == {"en", "fr", "de"} and all(len(d) > 1000 for d in model.dictionaries)
    test = [(i, prose(rng, lang, 80), lang) for i in range(60) for lang in [("en", "fr", "de")[i % 3]]]
    found = langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), "doc_id", "text", model)
    assert sum(r.lang_pred == ("en", "fr", "de")[r.doc_id % 3] for r in found.collect()) >= 58


def test_sizes_match_brute_force(spark, documents):
    """Every block of every text with every dictionary, by a plain loop over the model's parts."""
    import zstandard

    model = langid.learn(documents, "text", "lang", F.lit(True))
    parts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in model.dictionaries]
    for r in documents.where("length(text) between 10 and 20000").limit(40).collect():
        data = r.text.lower().encode()
        sizes = [
            sum(len(zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_dict_id=False).compress(data[i : i + model.block])) for i in range(0, len(data), model.block))
            for d in parts
        ]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min(x for i, x in enumerate(sizes) if i != best)
        got = langid._Classifier(model).classify(r.text)
        if got[0] != "und":
            assert got == (model.names[best], 1.0 - sizes[best] / second)
