"""Questions to cited answers: intent, retrieval, synthesis, and one retry without the codex filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import payload
from ..functions.text import unfence, words
from ..operators import graph, index, retrieval
from ..tables import written
from . import providers


@dataclass(frozen=True)
class Corpus:
    """What questions are asked of: articles (id, codex, number, name, body), their index, edges, keywords and definitions."""

    articles: DataFrame
    index: index.Index
    edges: DataFrame
    keywords: DataFrame
    definitions: DataFrame


@dataclass(frozen=True)
class Retrieval:
    """Stages of one retrieval over all questions."""

    hits: DataFrame
    fused: DataFrame
    neighbours: DataFrame
    ranked: DataFrame
    packed: DataFrame
    definitions: DataFrame
    context: DataFrame


def retrieve(corpus: Corpus, keywords: DataFrame, filters: DataFrame | None = None) -> Retrieval:
    """Retrieve for all questions in one plan.

    ``keywords`` has (qid, kw, text, weight), heaviest first; ``filters`` (qid, codex).
    """
    terms = keywords.select("qid", "kw", "weight", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    hits = index.search(corpus.index, terms, index.keyword_limit(F.col("weight")), filters)
    fused = retrieval.fuse_keywords(hits)
    seeds = retrieval.seeds(fused)
    near = graph.neighbours(seeds, corpus.edges)
    ranked = retrieval.with_graph(fused, near)
    chunks = corpus.articles.select("id", retrieval.chunk("codex", "number", "name", "body").alias("chunk"))
    packed = retrieval.pack(ranked, chunks)
    asked = keywords.where(F.col("kw") < C.SETTINGS.definition_keywords).select("qid", "kw", "text")
    found = graph.lookup_definitions(asked, corpus.keywords, corpus.definitions)
    return Retrieval(hits, fused, near, ranked, packed, found, retrieval.context(packed, found))


def analyse(questions: DataFrame, make_model: Callable[[], providers.Model] = providers.RuleIntent) -> DataFrame:
    """(qid, question, history, intent): a failed or unreadable reply asks for the question itself.

    ``questions`` has (qid, question) and may have the history of the conversation.
    The model is asked once for each; its replies are written.
    """
    given = questions.select("qid", "question", (F.col("history") if "history" in questions.columns else F.lit(None).cast("string")).alias("history"))
    codexes = F.lit(", ".join(slug for slug, *_ in C.CODEXES))
    asked = providers.prompt(providers.INTENT_TASK, codexes=codexes, history=F.col("history"), question=F.col("question"))
    replies = written(providers.ask(given.withColumn("_p", asked), "qid", "_p", make_model), "intents")
    joined = given.join(replies, "qid")
    return joined.select("qid", "question", "history", payload.intent(unfence(F.col("reply")), F.col("question")).alias("intent"))


def keyword_rows(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, kw, text, weight) and (qid, codex) of intents on topic."""
    legal = intents.where("intent.is_legal_question")
    rows = legal.select("qid", F.posexplode("intent.keywords").alias("kw", "_k")).select("qid", "kw", "_k.text", "_k.weight")
    return rows, legal.select("qid", F.explode("intent.codex_slugs").alias("codex"))


def synthesise(questions: DataFrame, context: DataFrame, make_model: Callable[[], providers.Model] = providers.ExtractiveAnswer) -> DataFrame:
    """(qid, answer): a normalised answer; without context a fixed one of confidence 0.1.

    ``questions`` has (qid, question, history).  The model sees question, history and
    context, and is asked once for each; its replies are written.
    """
    joined = questions.select("qid", "question", "history").join(context, "qid", "left").withColumn("context_text", F.coalesce("context_text", F.lit("")))
    prompt = providers.prompt(providers.ANSWER_TASK, history=F.col("history"), question=F.col("question"), context=F.col("context_text"))
    asked = written(providers.ask(joined.where(F.col("context_text") != "").withColumn("_p", prompt), "qid", "_p", make_model), "answers")
    empty = F.struct(F.lit(C.EMPTY_ANSWER).alias("answer"), F.array().cast("array<struct<article_id:string,codex_prefix:string,number:string,name_ru:string>>").alias("citations"), F.lit(0.1).alias("confidence"))
    failed = empty.withField("confidence", F.lit(0.0))
    made = F.when(F.col("reply").isNull() & F.col("error").isNull(), empty).when(F.col("reply").isNull(), failed).otherwise(payload.answer(unfence(F.col("reply"))))
    return questions.select("qid").join(asked, "qid", "left").select("qid", made.alias("answer"))


def answer(corpus: Corpus, questions: DataFrame, make_intent: Callable[[], providers.Model] = providers.RuleIntent, make_answer: Callable[[], providers.Model] = providers.ExtractiveAnswer) -> DataFrame:
    """(qid, question, is_legal_question, answer, retried) of all questions.

    Off-topic questions get a fixed answer.  An answer of low confidence is made again
    without the codex filter, and the better one stays; the later one at ties.
    """
    intents = written(analyse(questions, make_intent), "asked")
    rows, filters = keyword_rows(intents)
    legal = intents.where("intent.is_legal_question").select("qid", "question", "history")
    first = written(synthesise(legal, retrieve(corpus, rows, filters).context, make_answer), "first")
    low = legal.join(first.where(F.col("answer.confidence") < C.SETTINGS.confidence_threshold).select("qid"), "qid", "left_semi")
    broad = retrieve(corpus, rows.join(low.select("qid"), "qid", "left_semi")).context
    second = synthesise(low, broad, make_answer).withColumnRenamed("answer", "_second")
    both = first.join(second, "qid", "left")
    better = F.coalesce(F.col("_second.confidence") >= F.col("answer.confidence"), F.lit(False))
    chosen = both.select("qid", F.when(better, F.col("_second")).otherwise(F.col("answer")).alias("answer"), F.col("_second").isNotNull().alias("retried"))
    joined = intents.join(chosen, "qid", "left")
    off = F.struct(F.lit(C.OFF_TOPIC_ANSWER).alias("answer"), F.array().cast("array<struct<article_id:string,codex_prefix:string,number:string,name_ru:string>>").alias("citations"), F.lit(1.0).alias("confidence"))
    on_topic = F.col("intent.is_legal_question")
    return joined.select("qid", "question", on_topic.alias("is_legal_question"), F.when(on_topic, F.col("answer")).otherwise(off).alias("answer"), F.coalesce("retried", F.lit(False)).alias("retried"))
