"""Normalisation of model replies: intents, answers, keyword lists and relations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .legal import known_slugs, resolve_expression
from .text import bound

INTENT_SCHEMA = "language string, is_legal_question boolean, codex_slugs array<string>, keywords array<struct<text:string,weight:string>>"
ANSWER_SCHEMA = "answer string, citations array<struct<article_id:string,codex_prefix:string,number:string,name_ru:string>>, confidence string"
KEYWORDS_SCHEMA = "map<string, struct<ru:array<string>,kz:array<string>>>"
KEYWORD_PAIRS_SCHEMA = "array<struct<article_id:string,keywords:struct<ru:array<string>,kz:array<string>>>>"
RELATION_SCHEMA = (
    "struct<source_id:string,target_id:string,type:string,evidence:string,metadata:struct<source_kz:string,target_kz:string,ref_type:string,target_label:string>>"
)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def number_or(value: Column, default: float) -> Column:
    """A number from text; zero, null and what is no number give the default."""
    number = value.try_cast("double")
    return F.when(number.isNull() | (number == 0) | F.isnan(number), F.lit(default)).otherwise(number)


def distinct_by(items: Column, key) -> Column:
    """The first of the items with each key, in order; null keys drop out.  Two sorts, by key and then by place."""
    placed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    by_key = F.array_sort(F.filter(placed, lambda p: p["k"].isNotNull()))
    first = lambda ps: F.filter(ps, lambda p, i: (i == 0) | (F.get(ps, F.greatest(i - 1, F.lit(0)))["k"] != p["k"]))
    in_order = F.array_sort(F.transform(bound(by_key, first), lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"))))
    return F.transform(in_order, lambda p: p["x"])


def intent(raw: Column, question: Column) -> Column:
    """struct(language, is_legal_question, codex_slugs, keywords(text, weight)) of a reply.

    Unknown languages become ru; codexes may be slugs or parts of names; keywords are
    distinct by lower case, weighted 0.5 by default within 0.1 to 1, heaviest first.
    A reply that cannot be read, or without keywords, searches for the question's
    first 80 characters.
    """
    parsed = F.from_json(raw, INTENT_SCHEMA)
    language = F.lower(F.trim(F.coalesce(parsed["language"], F.lit("ru"))))
    slugs = F.flatten(F.transform(
        F.filter(F.coalesce(parsed["codex_slugs"], F.array().cast("array<string>")), lambda s: s.isNotNull()),
        lambda s: F.when(F.size(known_slugs(F.array(F.trim(s)))) > 0, F.array(F.trim(s))).otherwise(resolve_expression(s)),
    ))
    given = F.transform(
        F.coalesce(parsed["keywords"], F.array().cast("array<struct<text:string,weight:string>>")),
        lambda k: F.struct(F.trim(F.coalesce(k["text"], F.lit(""))).alias("text"), clamp(number_or(k["weight"], 0.5), 0.1, 1.0).alias("weight")),
    )
    distinct = distinct_by(F.filter(given, lambda k: k["text"] != ""), lambda k: F.lower(k["text"]))
    placed = F.transform(distinct, lambda k, i: F.struct((-k["weight"]).alias("o"), i.alias("i"), k["text"].alias("text"), k["weight"].alias("weight")))
    ordered = F.transform(F.array_sort(placed), lambda k: F.struct(k["text"].alias("text"), k["weight"].alias("weight")))
    whole = F.array(F.struct(F.trim(F.substring(question, 1, 80)).alias("text"), F.lit(1.0).alias("weight")))
    return F.struct(
        F.when(language.isin("ru", "kz", "mixed"), language).otherwise(F.lit("ru")).alias("language"),
        F.coalesce(parsed["is_legal_question"], F.lit(True)).alias("is_legal_question"),
        F.array_distinct(slugs).alias("codex_slugs"),
        F.when(F.size(ordered) > 0, ordered).otherwise(whole).alias("keywords"),
    )


def capped_confidence(confidence: Column, n_citations: Column, answer: Column) -> Column:
    """Confidence within 0 to 1, at most 0.35 without citations or evidence and 0.65 with one citation."""
    value = clamp(confidence, 0.0, 1.0)
    value = F.when(n_citations == 0, F.least(value, F.lit(0.35))).when(n_citations == 1, F.least(value, F.lit(0.65))).otherwise(value)
    return F.when(answer.startswith(C.INSUFFICIENT), F.least(value, F.lit(0.35))).otherwise(value)


def answer(raw: Column) -> Column:
    """struct(answer, citations, confidence) of a reply; citations are distinct by codex and number."""
    parsed = F.from_json(raw, ANSWER_SCHEMA)
    text = F.trim(F.coalesce(parsed["answer"], F.lit("")))
    text = F.when(text == "", F.lit(C.EMPTY_ANSWER)).otherwise(text)
    filled = F.transform(
        F.filter(F.coalesce(parsed["citations"], F.array().cast("array<struct<article_id:string,codex_prefix:string,number:string,name_ru:string>>")), lambda c: c.isNotNull()),
        lambda c: F.struct(*[F.coalesce(c[n], F.lit("")).alias(n) for n in ("article_id", "codex_prefix", "number", "name_ru")]),
    )
    cited = distinct_by(filled, lambda c: F.concat_ws(":", c["codex_prefix"], c["number"]))
    confidence = capped_confidence(number_or(parsed["confidence"], 0.5), F.size(cited), text)
    return F.struct(text.alias("answer"), cited.alias("citations"), confidence.alias("confidence"))


def trimmed_keywords(keywords: Column, limit: int = C.SETTINGS.keywords_per_article) -> Column:
    """Trimmed, lower-cased, distinct, the first ``limit``."""
    folded = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    return F.slice(F.array_distinct(F.filter(folded, lambda k: k.isNotNull() & (k != ""))), 1, limit)


def keyword_file(raw: Column) -> Column:
    """map article -> (ru, kz) from either layout of a keyword file; null if it is neither."""
    pairs = F.from_json(raw, "array<array<string>>")
    entries = F.transform(
        F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].isNotNull()),
        lambda p: F.struct(p[0].alias("key"), F.from_json(p[1], "struct<ru:array<string>,kz:array<string>>").alias("value")),
    )
    listed = F.when(F.trim(raw).startswith("["), F.map_from_entries(entries))
    return F.coalesce(listed, F.when(F.trim(raw).startswith("{"), F.from_json(raw, KEYWORDS_SCHEMA)))


def complete_relations(relations: Column) -> Column:
    """Relations with source, target, type and evidence."""
    filled = lambda c: c.isNotNull() & (c != "")
    return F.filter(relations, lambda r: filled(r["source_id"]) & filled(r["target_id"]) & filled(r["type"]) & filled(r["evidence"]))


def valid_relations(relations: Column) -> Column:
    """Whether every relation has a known type, and a reference its ref_type."""
    return F.forall(relations, lambda r: r["type"].isin(*C.EXTRACTED_RELATIONS) & ((r["type"] != "REFERENCES") | r["metadata"]["ref_type"].isin("internal", "external")))


def cleaned_relations(relations: Column) -> Column:
    """Relations of other types lose what only references carry."""
    def one(r: Column) -> Column:
        m, keep = r["metadata"], r["type"] == "REFERENCES"
        meta = F.struct(
            m["source_kz"].alias("source_kz"), m["target_kz"].alias("target_kz"),
            F.when(keep, m["ref_type"]).alias("ref_type"), F.when(keep, m["target_label"]).alias("target_label"),
        )
        return F.struct(*[r[n].alias(n) for n in ("source_id", "target_id", "type", "evidence")], meta.alias("metadata"))

    return F.transform(relations, one)


def paired(ru: Column, kz: Column) -> Column:
    """Keywords of two lists by place, the shorter one padded with null."""
    return F.transform(F.arrays_zip(ru.alias("ru"), kz.alias("kz")), lambda p: F.struct(p["ru"].alias("text_ru"), p["kz"].alias("text_kz")))
