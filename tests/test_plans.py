import json
import os

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import index as I
from lexweave.plans import answer, chat, ingest, providers, queries
from lexweave.sources import files
from lexweave.streaming import live

TABLES = "/root/testdata/sf0.001"


def test_every_query_runs_and_has_long_integers(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("tables are absent")
    for name in ("bm25_topk", "context_pack", "hybrid_fuse", "article_segmentation", "vector_topk", "intent_normalise"):
        out = queries.QUERIES[name](spark, TABLES)
        assert out.count() > 0 and "int" not in [kind for _, kind in out.dtypes]


def test_registry_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "labor" if i % 2 else "water", str(i), f"Имя {i}", f"договор номер{i} работник отпуск{i % 3}") for i in range(12)]
    articles = spark.createDataFrame(rows, "id long, codex string, number string, name string, body string")
    edges = spark.createDataFrame([(i, (i + 3) % 12, "EXTENDS") for i in range(12)], "source_id long, target_id long, rel_type string")
    keywords = spark.createDataFrame([("договор", None)], "text_ru string, text_kz string")
    defs = spark.createDataFrame([("договор", "", "соглашение", "", "f")], "keyword_ru string, keyword_kz string, definition_ru string, definition_kz string, source_file string")
    return answer.Corpus(articles, I.build(articles, "id", "codex", X.words(F.col("body"))), edges, keywords, defs)


class Unsure:
    def __call__(self, prompt):
        return json.dumps({"answer": "да", "citations": [], "confidence": 0.9 if "labor" in providers.section(prompt, "context") else 0.2})


class FilteredIntent:
    def __call__(self, prompt):
        if providers.section(prompt, "question") == "погода":
            return json.dumps({"is_legal_question": False})
        if providers.section(prompt, "question") == "сбой":
            raise RuntimeError("down")
        return json.dumps({"codex_slugs": ["labor"], "keywords": [{"text": "номер7 отпуск1", "weight": 1}]})


def test_questions_to_answers(spark, corpus):
    q = spark.createDataFrame([(1, "вопрос"), (2, "погода"), (3, "сбой"), (4, "номер5")], "qid long, question string")
    got = {r.qid: r for r in answer.answer(corpus, q, FilteredIntent, providers.ExtractiveAnswer).collect()}
    assert got[2].answer.confidence == 1.0 and not got[2].is_legal_question and not got[2].retried
    assert len(got[1].answer.citations) == 3 and got[1].answer.confidence == 0.6
    assert got[3].answer.confidence == 0.1 and got[3].retried  # the fallback searches for the question, which nothing holds
    low = {r.qid: r for r in answer.answer(corpus, q.where("qid = 1"), FilteredIntent, Unsure).collect()}
    assert low[1].retried and low[1].answer.confidence == 0.2


def test_retries_splits_and_corrections():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("later")
        return "ok"

    waits = []
    assert providers.Retry(sleep=waits.append).call(flaky, "p") == "ok" and waits == [5.0, 10.0]
    with pytest.raises(OSError, match="later"):
        calls.clear()
        providers.Retry(attempts=2, sleep=waits.append).call(flaky, "p")

    def short(prompt):
        if len(prompt) > 2:
            raise providers.Truncated
        return prompt

    assert providers.extract(list("abcde"), "".join, short) == ["ab", "c", "de"]
    fixed = providers.correct(
        json.dumps({"keywords": [{"article_id": "1", "keywords": {"ru": [], "kz": ["b"]}}, {"article_id": "2", "keywords": {"ru": ["a"], "kz": ["b"]}}]}),
        lambda p: json.dumps({"keywords": [{"article_id": x, "keywords": {"ru": ["new"], "kz": ["new"]}} for x in json.loads(p)]}),
    )
    assert [k["keywords"]["ru"] for k in json.loads(fixed)["keywords"]] == [["new"], ["a"]]


def test_judge(spark):
    cases = spark.createDataFrame([(1, "a z", "a b", "a b c"), (2, "q", "x", "a")], "id long, question string, answer string, context string")
    assert {r.id: r.score for r in providers.judge(cases, "id", "question", "answer", "context").collect()} == {1: 1.0, 2: 0.0}
    assert {r.id: r.score for r in providers.judge(cases, "id", "question", "answer").collect()} == {1: 0.5, 2: 0.0}


def test_prompts_hold_question_history_and_context(spark, corpus, tmp_path):
    """A model that notes what it is asked, once for each question."""
    log = tmp_path / "calls"
    log.mkdir()

    class Noted:
        def __init__(self, kind):
            self.kind = kind

        def __call__(self, prompt):
            import uuid

            (log / f"{self.kind}-{uuid.uuid4().hex}").write_text(prompt, encoding="utf-8")
            if self.kind == "intent":
                return json.dumps({"codex_slugs": ["labor"], "keywords": [{"text": "номер7 отпуск1", "weight": 1}]})
            return json.dumps({"answer": "да", "citations": [], "confidence": 0.1})

    q = spark.createDataFrame([(1, "вопрос об отпуске", "История: раньше спрошено"), (2, "другой вопрос", None)], "qid long, question string, history string")
    got = answer.answer(corpus, q, lambda: Noted("intent"), lambda: Noted("answer"))
    assert {r.qid: r.retried for r in got.collect()} == {1: True, 2: True} and got.count() == 2
    asked = {kind: [p.read_text(encoding="utf-8") for p in log.glob(f"{kind}-*")] for kind in ("intent", "answer")}
    assert len(asked["intent"]) == 2 and len(asked["answer"]) == 4  # one retry of each
    for prompts in asked.values():
        assert sum("вопрос об отпуске" in providers.section(p, "question") and "раньше спрошено" in providers.section(p, "history") for p in prompts) == len(prompts) // 2
    assert all("номер7" in providers.section(p, "context") for p in asked["answer"])


def test_schema_first_then_plain_json():
    def strict(prompt):
        if prompt == "cut":
            raise providers.Truncated
        raise ValueError("no schema here")

    model = providers.WithFallback(strict, lambda p: f"plain {p}")
    assert model("x") == "plain x"
    with pytest.raises(providers.Truncated):
        model("cut")


def test_ingestion_from_files(spark, tmp_path):
    for lang, chapter, word in (("ru", "Глава 1. Общие", "Статья {}. Имя"), ("kz", "1-тарау. Жалпы", "{}-бап. Аты")):
        body = f"### {chapter}\n\n" + "\n\n".join(f"#### {word.format(i)}\n\nработник обязан, см. статье {i + 1} и 01.02.2020" for i in (1, 2, 3))
        (tmp_path / f"labor_{lang}.md").write_text(body, encoding="utf-8")
    (tmp_path / "lonely_ru.md").write_text("#### Статья 1. Одна\n\nтекст", encoding="utf-8")
    read = files.markdown(spark, str(tmp_path))
    both, alone = files.pairs(read)
    assert [r.code for r in both.collect()] == ["labor"] and [r.code for r in alone.collect()] == ["lonely"]
    from lexweave.operators import articles

    merged = ingest.merge(articles.parse(read, "code", "lang", "text"))
    assert {(r.code, r.number, r.source) for r in merged.collect()} == {("labor", "1", "both"), ("labor", "2", "both"), ("labor", "3", "both"), ("lonely", "1", "ru_only")}
    made = ingest.structure(merged)
    assert made.edges.count() == 2 and {r.label for r in made.nodes.collect()} == {"Chapter"}
    assert all(r.is_labor and r.has_obligations for r in made.articles.where("code = 'labor'").collect())
    flat = made.articles.select("id", "code", F.col("title_ru").alias("title"), F.col("body_ru").alias("text"))
    ranked = ingest.keyword_table(flat, flat.select("id", F.lit("трудовой спор").alias("term"), F.lit(0.9).alias("score")))
    assert {r.term for r in ranked.where("rank = 1").collect()} <= {"статья 2", "статья 3", "статья 4", "трудовой спор"} | {f"статье {i}" for i in range(9)}
    assert ingest.chosen_stages("2,x,structure,9") == ["merge", "structure"] and ingest.chosen_stages(None) == list(ingest.STAGES)


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c_ru.json").write_text(json.dumps([{"id": "1", "number": "5", "title": "t"}, {"id": "2"}]), encoding="utf-8")
    got = files.articles(spark, str(tmp_path / "in")).orderBy("pos").collect()
    assert [(r.code, r.lang, r.pos, r.id, r.number) for r in got] == [("c", "ru", 0, "1", "5"), ("c", "ru", 1, "2", None)]
    (tmp_path / "defs").mkdir()
    for name, raw in {"a": '{"keyword":" k ","definition_ru":"d"}', "b": "[]", "c": "broken", "d": '{"keyword":"k"}'}.items():
        (tmp_path / "defs" / f"{name}.json").write_text(raw, encoding="utf-8")
    ok, bad = files.definitions(spark, str(tmp_path / "defs"))
    assert [(r.keyword_ru, r.source_file) for r in ok.collect()] == [("k", "a.json")] and bad.count() == 3
    out = str(tmp_path / "out")
    todo = spark.range(5)
    assert files.remaining(todo, spark, out, "id").count() == 5
    files.append(todo.where("id < 2"), out)
    assert [r.id for r in files.remaining(todo, spark, out, "id").orderBy("id").collect()] == [2, 3, 4]
    files.write(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), str(tmp_path / "j"), "json")
    assert spark.read.schema("x double").json(str(tmp_path / "j")).where("x is null").count() == 1
    x, y, z = files.common(spark.range(3), spark.range(1, 4), "id")
    assert (x.count(), y.count(), z.count()) == (2, 1, 1) and files.alive(spark)


def test_drivers_over_folders(spark, tmp_path):
    (tmp_path / "md").mkdir()
    for lang, word in (("ru", "Статья {}. Имя"), ("kz", "{}-бап. Аты")):
        (tmp_path / "md" / f"labor_{lang}.md").write_text("\n\n".join(f"#### {word.format(i)}\n\nтекст" for i in range(1, 3 + (lang == "ru"))), encoding="utf-8")
    (tmp_path / "md" / "lonely_ru.md").write_text("#### Статья 1. Одна\n\nтекст", encoding="utf-8")
    (tmp_path / "md" / "blank_ru.md").write_text("ничего", encoding="utf-8")
    parsed = ingest.parse_folder(spark, str(tmp_path / "md"), str(tmp_path / "parsed"))
    assert {(r.code, r.lang): r.articles for r in parsed.collect()} == {("labor", "ru"): 3, ("labor", "kz"): 2, ("lonely", "ru"): 1, ("blank", "ru"): 0}
    merged = ingest.merge_folder(spark, str(tmp_path / "parsed"), str(tmp_path / "merged"))
    assert [tuple(r) for r in merged.collect()] == [("labor", 2, 1, 0, 3)]


def test_tables_with_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumnRenamed("id", "k")
    files.write_unique(rows, path, ["k"], buckets=3)
    assert spark.read.parquet(path).count() == 10
    for broken in (rows.union(rows), spark.createDataFrame([(None,)], "k long")):
        with pytest.raises(ValueError, match="not a unique key"):
            files.write_unique(broken, path, ["k"])
    assert files.clear(spark, path) == 10 and files.clear(spark, path) == 0 and files.clear(spark, str(tmp_path / "none")) == 0
    nested = spark.sql("select named_struct('x', double('nan'), 'y', array(1.0D, double('infinity'))) as s, map('a', double('nan')) as m, 'nan' as t")
    files.write(nested, str(tmp_path / "j"), "json")
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"s": {"y": [1.0, None]}, "m": {"a": None}, "t": "nan"}]


def test_conversation(spark):
    from pyspark.sql import Row

    asked = []

    def reply(question, history):
        asked.append((question, history))
        if question == "сбой":
            raise OSError("down")
        cited = [Row(article_id="", codex_prefix="labor", number="5", name_ru="Отпуск")] * 2 + [Row(article_id="", codex_prefix="x", number="1", name_ru="")]
        return Row(answer=Row(answer="о" * 300, citations=cited, confidence=0.5), retried=True)

    session = chat.Session()
    shown = list(chat.talk(["/help", "", "вопрос", "сбой", "второй", "/stats", "/clear", "/stats", "третий", "/quit", "никогда"], reply, session))
    assert shown[0] == chat.HELP and shown[2] == "error: down" and shown[4:7] == ["2 turns, mean confidence 50%", "cleared", "0 turns, mean confidence 0%"]
    assert shown[1].split("\n")[1:] == ["[confidence 50% (retried)]", "1. Трудовой кодекс, Статья 5 Отпуск", "2. x, Статья 1"]
    assert [q for q, _ in asked] == ["вопрос", "сбой", "второй", "третий"] and asked[0][1] == "" and asked[2][1].startswith("История разговора:\nВ1: вопрос\nО1: " + "о" * 250 + "…")
    for i in range(9):
        session.add(f"q{i}", "a", 1.0)
    assert [t[0] for t in session.turns] == [f"q{i}" for i in range(3, 9)]


def test_docx_through_a_converter(spark, tmp_path):
    for name in ("a.docx", "~$a.docx", "bad.docx"):
        (tmp_path / name).write_bytes(b"**\xd0\x93\xd0\xbb\xd0\xb0\xd0\xb2\xd0\xb0 1**" if name == "a.docx" else b"\xff")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.docx(spark, str(tmp_path), lambda b: b.decode()).collect()}
    assert set(got) == {"a.docx", "bad.docx"} and got["a.docx"].text == "### Глава 1\n" and got["bad.docx"].error.startswith("UnicodeDecodeError")


def test_streams(spark, tmp_path):
    turns = spark.createDataFrame([(1, i, f"t{i}") for i in range(8)] + [(2, 0, "x")], "conv_id long, turn int, text string")
    turns.write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    query = live.session_memory(stream).writeStream.outputMode("update").format("memory").queryName("memory_of_sessions").start()
    query.processAllAvailable()
    query.stop()
    got = {r.conv_id: (r.turns, r["last"]) for r in spark.table("memory_of_sessions").collect()}
    assert got == {1: (8, [f"t{i}" for i in range(2, 8)]), 2: (1, ["x"])}
    events = spark.range(100).selectExpr("timestamp_seconds(id * 60) as ts", "'a' as event_type", "cast(id as double) as value")
    batch = live.latency_windows(events).orderBy("start").collect()
    assert [(r.n, r["min"], r["max"]) for r in batch] == [(60, 0.0, 59.0), (40, 60.0, 99.0)]
