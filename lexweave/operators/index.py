"""Inverted index: postings, document lengths, BM25 search and TF-IDF."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SETTINGS
from ..functions.text import words
from ..tables import small, written

@dataclass(frozen=True)
class Index:
    """Tables of one index: postings (term, id, codex, tf, dl) and corpus statistics (n, avgdl)."""

    postings: DataFrame
    frequencies: DataFrame  #: (term, df)
    stats: DataFrame  #: one row

    def written(self) -> Index:
        """The same index as tables: postings sorted by term, so that a search reads the row groups of its terms."""
        postings = written(self.postings.repartition("term").sortWithinPartitions("term"), "postings")
        frequencies = written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        return Index(postings, frequencies, written(self.stats, "stats"))


def build(docs: DataFrame, key: str, codex: str, tokens: Column) -> Index:
    """Index documents by their tokens; documents without tokens count in n and in the mean length."""
    held = docs.select(F.col(key).alias("id"), F.col(codex).alias("codex"), tokens.alias("_t")).withColumn("dl", F.size("_t").cast("long"))
    stats = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = held.select("id", "codex", "dl", F.explode("_t").alias("term")).groupBy("term", "id", "codex", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def search(index: Index, queries: DataFrame, limit: Column | int, filters: DataFrame | None = None, k1: float = SETTINGS.bm25_k1, b: float = SETTINGS.bm25_b) -> DataFrame:
    """BM25 top hits of many queries in one job.

    ``queries`` has (qid, kw, term) rows, one per distinct term of a query, and may
    have a column that ``limit`` names; ``filters`` has (qid, codex) rows that
    restrict a query.  Where a filtered keyword finds nothing, all documents are
    searched for it.  Returns (qid, kw, id, codex, score, rank), ranked by the score
    rounded to six places, then by id.
    """
    q = small(queries, "queries")
    known = small(index.frequencies.join(q.select("term").distinct(), "term"), "known")
    terms = index.postings.join(q.join(known, "term"), "term")
    n, avgdl = F.col("n"), F.col("avgdl")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    extra = [c for c in queries.columns if c not in ("qid", "kw", "term")]
    scored = terms.crossJoin(F.broadcast(index.stats)).groupBy("qid", "kw", *extra, "id", "codex").agg(F.round(F.sum(part), 6).alias("score"))
    if filters is not None:
        wanted = filters.select("qid", "codex", F.lit(True).alias("_in"))
        marked = scored.join(small(wanted, "filters"), ["qid", "codex"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        any_in = F.max("_in").over(Window.partitionBy("qid", "kw"))
        scored = marked.withColumn("_any", any_in).where(F.col("_in") | ~F.col("_any")).drop("_in", "_any")
    order = Window.partitionBy("qid", "kw").orderBy(F.desc("score"), "id")
    most = F.lit(limit) if isinstance(limit, int) else limit
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def keyword_limit(weight: Column, base: int = SETTINGS.top_k_base) -> Column:
    """Hits wanted for a keyword of a weight, rounded half to even, five at least."""
    return F.greatest(F.lit(5), F.bround(base * (0.5 + weight)).cast("int"))


def bm25_plus(index: Index, k1: float = 1.5, b: float = 0.75, delta: float = 0.5) -> DataFrame:
    """(id, term, score) by BM25+, which bounds a present term's score from below."""
    idf = F.ln((F.col("n") + 1) / F.col("df"))
    score = idf * (delta + F.col("tf") * (k1 + 1) / (k1 * (1 - b + b * F.col("dl") / F.col("avgdl")) + F.col("tf")))
    return index.postings.join(index.frequencies, "term").crossJoin(F.broadcast(index.stats)).select("id", "term", score.alias("score"))


def tfidf(docs: DataFrame, key: str, tokens: Column, within: list[str] | None = None, min_chars: int = SETTINGS.term_min_chars) -> DataFrame:
    """(key, *within, term, score): smoothed TF-IDF over the corpus, or over each group of ``within``.

    Terms shorter than ``min_chars`` are scored with all others and then left out.
    """
    within = within or []
    held = docs.select(key, *within, tokens.alias("_t")).withColumn("_len", F.greatest(F.size("_t"), F.lit(1)))
    counts = held.select(key, *within, "_len", F.explode("_t").alias("term")).groupBy(key, *within, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    df = counts.groupBy(*within, "term").agg(F.count(F.lit(1)).alias("_df"))
    sizes = held.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(df, [*within, "term"])
    joined = joined.join(small(sizes, "sizes"), within) if within else joined.crossJoin(F.broadcast(sizes))
    score = (1 + F.ln(1 + F.col("_tf") / F.col("_len"))) * (F.ln((F.col("_n") + 1) / (F.col("_df") + 1)) + 1)
    return joined.where(F.length("term") >= min_chars).select(key, *within, "term", score.alias("score"))


def tfidf_blend(
    docs: DataFrame, key: str, tokens: Column, within: str, within_weight: float = SETTINGS.local_weight, overall_weight: float = SETTINGS.global_weight, min_chars: int = SETTINGS.term_min_chars
) -> DataFrame:
    """(key, term, score): the weighted sum of TF-IDF within each group and over the corpus.

    Texts are tokenised and counted once; the corpus' document frequencies are sums of
    the groups'.  Terms shorter than ``min_chars`` are scored with all others and then
    left out.
    """
    held = docs.select(key, within, tokens.alias("_t")).withColumn("_len", F.greatest(F.size("_t"), F.lit(1)))
    counts = held.select(key, within, "_len", F.explode("_t").alias("term")).groupBy(key, within, "_len", "term").agg(F.count(F.lit(1)).alias("_tf"))
    counts = written(counts, "counts")
    inner = counts.groupBy(within, "term").agg(F.count(F.lit(1)).alias("_df"))
    outer = inner.groupBy("term").agg(F.sum("_df").alias("_all"))
    sizes = docs.groupBy(within).agg(F.count(F.lit(1)).alias("_n"))
    sizes = small(sizes, "sizes")
    total = sizes.agg(F.sum("_n").alias("_total"))
    joined = counts.join(inner.join(outer, "term"), [within, "term"]).join(sizes, within).crossJoin(F.broadcast(total)).where(F.length("term") >= min_chars)
    tf = 1 + F.ln(1 + F.col("_tf") / F.col("_len"))
    idf = lambda n, df: F.ln((F.col(n) + 1) / (F.col(df) + 1)) + 1
    return joined.select(key, "term", (tf * idf("_n", "_df") * within_weight + tf * idf("_total", "_all") * overall_weight).alias("score"))


def top_terms(scored: DataFrame, key: str, n: int = SETTINGS.tfidf_top_n, score: str = "score") -> DataFrame:
    """The n best terms of each document, ties by term."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round(score, 6)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def question_terms(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, kw, term): the distinct tokens of each question as one query."""
    return questions.select(F.col(qid).alias("qid"), F.lit(0).alias("kw"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def rare_keywords(index: Index, questions: DataFrame, qid: str, text: str, n: int = 5) -> DataFrame:
    """(qid, kw, term, weight): a question's n rarest indexed tokens, the rarest first and heaviest."""
    terms = question_terms(questions, qid, text).drop("kw")
    known = index.frequencies.join(small(terms, "terms"), "term")
    order = Window.partitionBy("qid").orderBy("df", "term")
    placed = known.withColumn("kw", F.row_number().over(order) - 1).where(F.col("kw") < n)
    return placed.select("qid", "kw", "term", F.round(F.greatest(F.lit(0.1), 1.0 - 0.15 * F.col("kw")), 6).alias("weight"))
