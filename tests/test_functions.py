import uuid

import pytest
from pyspark.sql import functions as F

from lexweave.functions import legal, markdown, metrics, payload, text


def value(spark, column, **given):
    schema = ", ".join(f"{k} string" for k in given) or "x string"
    return spark.createDataFrame([tuple(given.values()) or (None,)], schema).select(column.alias("v")).first()["v"]


REFS = [
    ("статья 5", []), ("статьи 5", []), ("статью 5", []), ("статьёй 5", []), ("статье 5", ["5"]), ("статьей 5", ["5"]), ("статьях 5", ["5"]), ("ст. 5", ["5"]), ("статьями 5", ["5"]),
    ("рост 5", ["5"]), ("статьях 10–12", ["10", "11", "12"]), ("статье 54-1", []), ("статьях 1–50", [str(i) for i in range(1, 11)]),
]


@pytest.mark.parametrize(("body", "numbers"), REFS)
def test_references_as_the_rules_stand(spark, body, numbers):
    df = spark.createDataFrame([(1, "c", body)], "id long, codex string, body string")
    got = [r.number for r in legal.references(df, "id", "codex", "body").orderBy("match_pos", "number_pos").collect()]
    assert list(dict.fromkeys(got)) == numbers


@pytest.mark.parametrize(("body", "numbers"), [("статья 5", ["5"]), ("статью 5", ["5"]), ("рост 5", []), ("статье 54-1", ["54-1"]), ("Ст. 7", ["7"])])
def test_strict_references(spark, body, numbers):
    df = spark.createDataFrame([(1, "c", body)], "id long, codex string, body string")
    assert [r.number for r in legal.references(df, "id", "codex", "body", strict=True).collect()] == numbers


def test_entities(spark):
    from lexweave.constants import ENTITY_PATTERNS as P

    body = "ШТРАФ, арест; лишение свободы. Лишение свободы! обязан, вправе, может"
    assert value(spark, legal.entities(F.col("b"), P["sanctions"]), b=body) == ["лишение свободы", "Лишение свободы"]
    assert value(spark, legal.entities(F.col("b"), P["obligations"]), b=body) == ["обязан"]
    assert value(spark, legal.entities(F.col("b"), P["rights"]), b=body) == ["вправе"]
    assert value(spark, legal.entities(F.col("b"), P["rights"]), b=None) == []


def test_semantics(spark):
    row = legal.semantics(spark.createDataFrame([("работник обязан 01.02.2020", "labor"), (None, None)], "b string, c string"), "b", "c").collect()
    assert row[0].is_labor and not row[0].is_tax and row[0].has_subjects and row[0].has_temporal_info and row[0].has_obligations
    assert not row[1].is_labor and not row[1].has_temporal_info and row[1].subjects == []


def test_codexes(spark):
    registry = legal.codexes(spark)
    assert registry.count() == 24
    names = spark.createDataFrame([("трудовой",), ("ҚЫЛМЫСТЫҚ",), ("",)], "name string")
    got = legal.resolve_slugs(names, "name", registry).select("slug").collect()
    assert {r.slug for r in got} == {"labor", "criminal", "criminal_exec", "criminal_proc"}
    assert value(spark, legal.codex_name(F.col("s")), s="water") == "Водный кодекс" and value(spark, legal.codex_name(F.col("s")), s="src1") == "src1"
    assert value(spark, legal.known_slugs(F.split("s", ",")), s="x,labor,water") == ["labor", "water"]


def test_language_needs_more_than_one_per_cent(spark):
    assert value(spark, text.language(F.col("t")), t="ә" + "а" * 99) == "ru"
    assert value(spark, text.language(F.col("t")), t="ә" + "а" * 98) == "kz"
    assert value(spark, text.language(F.col("t")), t=None) == "ru"


def test_tokens_and_terms(spark):
    assert value(spark, text.words(F.col("t")), t="Ёлка_2, ab-c") == ["ёлка_2", "ab", "c"]
    assert value(spark, text.terms(F.col("t")), t="Статья о налогах и да Республики Казахстан") == ["налогах"]
    assert value(spark, text.citations(F.col("t")), t="14-бап, Статья 5 и статье 6-1") == ["статья 5", "статья 6-1", "14-бап"]
    assert value(spark, text.ngrams(F.split("t", " "), 2), t="a b c") == ["a b", "b c"] and value(spark, text.ngrams(F.split("t", " "), 2), t="a") == []


def test_identifiers(spark):
    assert value(spark, text.uuid5(F.lit("article"), F.lit("labor"), F.lit("ru"), F.lit("44-1"))) == "749287a6-18cc-5147-a293-5b5b10124c6e"
    for i in range(40):
        want = str(uuid.uuid5(uuid.NAMESPACE_X500, f"article|labor|kz|{i}"))
        assert value(spark, text.uuid5(F.lit("article"), F.lit("labor"), F.lit("kz"), F.lit(str(i)))) == want
    assert len(value(spark, text.short_id(F.lit("a"), F.lit(None)))) == 16


def test_small_helpers(spark):
    assert value(spark, text.unfence(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert value(spark, text.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert value(spark, text.both_languages(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert value(spark, text.contains_either(F.lit("AB"), F.col("a"), F.col("b")), a=None, b="xaby") is True
    assert value(spark, text.without_nan(F.lit(float("nan")))) is None and value(spark, text.percent(F.lit(0.5))) == "50.0%" and value(spark, text.band(F.lit(0.5))) == "yellow"


CLEAN = [
    ("a\r\nb", "a b\n"), ("x y", "x y\n"), ("![pic](u){w=1}\ntext", "text\n"), ("[seen]{.mark} on", "seen on\n"), (r"a\*b\.c", "a*b.c\n"), ("one\\\ntwo", "one\n\ntwo\n"),
    ("   in\n\n  more", "in\n\nmore\n"), ("```\n  keep\n```", "```   keep ```\n"), ("Сноска. Статья в редакции", "> *Сноска. Статья в редакции*\n"), ("Вниманию пользователей!", "> ℹ *Вниманию пользователей!*\n"),
    ("**Глава 1. Общие**\n\n**положения**\n\nтекст", "### Глава 1. Общие положения\n\nтекст\n"), ("**Трудовой кодекс**", "# Трудовой кодекс\n"), ("**1. Статья 5. О чём**", "#### 1. Статья 5. О чём\n"),
    ("**жирный**\n\nтекст", "**жирный**\n\nтекст\n"), ("a\n\n\n\nb", "a\n\nb\n"), ("a\n- b\n1. c\n> d\n| e |", "a\n- b\n1. c\n> d\n| e |\n"),
]


@pytest.mark.parametrize(("raw", "cleaned"), CLEAN)
def test_clean(spark, raw, cleaned):
    assert value(spark, markdown.clean(F.col("t")), t=raw) == cleaned


def test_strip_and_classify(spark):
    assert value(spark, markdown.strip_markdown(F.col("t")), t="## **A** _b_ `c`  <i>d</i> ") == "A b c d"
    assert value(spark, markdown.bare(F.col("t")), t="### **Статья 5. О**\nтекст") == "Статья 5. О"
    kinds = {"Статья 44-1. О": ("article", "44-1"), "5-бап. X": ("article", "5"), "§ 2. Y": ("paragraph", ""), "3-параграф. Z": ("paragraph", ""), "РАЗДЕЛ 1": ("section", ""), "в этой глава 2": ("chapter", ""), "текст": ("content", "")}
    for line, want in kinds.items():
        assert tuple(value(spark, markdown.classify(F.col("t")), t=line)) == want
    assert value(spark, markdown.classify(F.col("t"), strict=True), t="как указано в этой части, глава 2").kind == "content"


def test_blocks(spark):
    raw = "первая\\\nстрока продолжена\n\n| a |\n| b |\n\nдве\nстроки\n\n\nдальше\\\nНовая"
    assert value(spark, markdown.blocks(F.col("t")), t=raw) == ["первая строка продолжена", "| a |\n| b |", "две строки", "дальше", "Новая"]


WEIGHTS = [("0", 0.5), (None, 0.5), ("x", 0.5), ("5", 1.0), ("-1", 0.1), ("0.7", 0.7)]


@pytest.mark.parametrize(("given", "want"), WEIGHTS)
def test_weights(spark, given, want):
    assert value(spark, payload.clamp(payload.number_or(F.col("w"), 0.5), 0.1, 1.0), w=given) == want


def test_intent(spark):
    raw = '{"language":"KZ","codex_slugs":["labor","налоговый","nope"],"keywords":[{"text":"a","weight":0.2},{"text":"B"},{"text":"A","weight":1},{"text":" "},{"text":"c","weight":0.5}]}'
    got = value(spark, payload.intent(F.col("r"), F.col("q")), r=raw, q="вопрос")
    assert (got.language, got.is_legal_question, got.codex_slugs) == ("kz", True, ["labor", "tax_code"])
    assert [(k.text, k.weight) for k in got["keywords"]] == [("B", 0.5), ("c", 0.5), ("a", 0.2)]
    broken = value(spark, payload.intent(F.col("r"), F.col("q")), r="no json", q="в" * 100)
    assert broken.language == "ru" and [(k.text, k.weight) for k in broken["keywords"]] == [("в" * 80, 1.0)]


@pytest.mark.parametrize(("given", "n", "answer", "want"), [(0.9, 0, "a", 0.35), (0.9, 1, "a", 0.65), (0.9, 2, "a", 0.9), (0, 2, "a", 0.5), (0.9, 2, "НЕДОСТАТОЧНО данных", 0.35), (7, 2, "a", 1.0)])
def test_answer_confidence(spark, given, n, answer, want):
    cited = ",".join(f'{{"codex_prefix":"c","number":"{i}"}}' for i in [*range(n), *range(n)])
    got = value(spark, payload.answer(F.col("r")), r=f'{{"answer":"{answer}","citations":[{cited}],"confidence":{given}}}')
    assert len(got.citations) == n and got.confidence == want


def test_keyword_and_relation_payloads(spark):
    assert value(spark, payload.trimmed_keywords(F.split("k", "[|]")), k=" A|a|b||" + "|".join(f"k{i}" for i in range(30)))[:2] == ["a", "b"]
    for raw in ('{"1":{"ru":["a"],"kz":["b"]}}', '[["1",{"ru":["a"],"kz":["b"]}],["bad"]]'):
        assert value(spark, payload.keyword_file(F.col("r")), r=raw)["1"].ru == ["a"]
    assert [tuple(x) for x in value(spark, payload.paired(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))] == [("a", "c"), ("b", None)]
    rel = F.from_json("r", f"array<{payload.RELATION_SCHEMA}>")
    raw = '[{"source_id":"a","target_id":"b","type":"EXTENDS","evidence":"e","metadata":{"ref_type":"internal","source_kz":"x"}},{"source_id":"a","type":"EXTENDS"}]'
    kept = value(spark, payload.cleaned_relations(payload.complete_relations(rel)), r=raw)
    assert len(kept) == 1 and kept[0].metadata.ref_type is None and kept[0].metadata.source_kz == "x"
    assert value(spark, payload.valid_relations(rel), r='[{"source_id":"a","target_id":"b","type":"REFERENCES","evidence":"e","metadata":{}}]') in (False, None)


def test_rouge(spark):
    one = value(spark, metrics.rouge_n(F.lit("a a b"), F.lit("a b c"), 1))
    assert (one.precision, one.recall, one.f1) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    long = value(spark, metrics.rouge_l(F.lit("b d x e"), F.lit("a b c d e")))
    assert (long.precision, long.recall) == pytest.approx((3 / 4, 3 / 5))
    same = value(spark, metrics.rouge(F.lit("a b c"), F.lit("a b c")))
    assert tuple(same) == pytest.approx((1, 1, 1)) and tuple(value(spark, metrics.rouge(F.lit(""), F.lit("a")))) == (0, 0, 0)


def test_set_scores_and_cosine(spark):
    s = value(spark, metrics.set_scores(F.split("p", ","), F.split("e", ",")), p="a,b,c,d", e="a,b")
    assert (s.precision, s.recall, s.f1) == pytest.approx((0.5, 1, 2 / 3))
    assert value(spark, metrics.cosine(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(0.8), F.lit(0.6)))) == pytest.approx(0.96)
