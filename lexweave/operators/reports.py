"""Counts and selections that runs report: cases, merges, batches, statuses, and keyword records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SETTINGS
from ..tables import small


def chosen_cases(cases: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """The cases whose key ``ids`` has, or all of them without a choice."""
    return cases if ids is None else cases.join(small(ids.select(key).distinct(), "chosen"), key, "left_semi")


def vocabulary(postings: DataFrame) -> DataFrame:
    """One row (terms): how many different terms an index has."""
    return postings.select("term").distinct().agg(F.count(F.lit(1)).alias("terms"))


def merge_summary(merged: DataFrame, by: str) -> DataFrame:
    """(by, both, ru_only, kz_only, merged): how the articles of each code were matched."""
    count = lambda kind: F.count_if(F.col("source") == kind).alias(kind)
    return merged.groupBy(by).agg(*[count(x) for x in ("both", "ru_only", "kz_only")], F.count(F.lit(1)).alias("merged"))


def by_kind(rows: DataFrame, *kinds: str) -> DataFrame:
    """(kinds, n): rows of each label, type or parent label."""
    return rows.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """(status, files, articles, keywords, relations) of the files of a run (code, status, articles, keywords, relations)."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("articles", "keywords", "relations")])


def dry_run(batches: DataFrame, within: str, chars: str) -> DataFrame:
    """(within, batch, articles, chars, tokens, too_long): what a run would send, and the tokens it would get back."""
    n = F.count(F.lit(1))
    tokens = n * SETTINGS.dry_run_tokens_per_article + SETTINGS.dry_run_tokens_base
    return batches.groupBy(within, "batch").agg(n.alias("articles"), F.sum(chars).alias("chars"), tokens.alias("tokens"), (tokens > SETTINGS.dry_run_tokens_warn).alias("too_long"))


def keyword_records(articles: DataFrame, fused: DataFrame, terms: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Articles with keywords, keywords_scored, keywords_bm25 and keywords_keybert, best first, as they are written.

    The tables of terms have the key, term, score and rank; an article without any has empty lists.
    """
    def listed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", "term", "score")))
        made = {
            "terms": lambda: F.transform(F.col("_o"), lambda x: x["term"]),
            "scored": lambda: F.transform(F.col("_o"), lambda x: F.struct(x["term"].alias("term"), x["score"].alias("score"))),
        }
        return rows.groupBy(key).agg(ordered.alias("_o")).select(key, *[made[kind]().alias(name) for name, kind in names.items()])

    out = articles.join(listed(fused, {"keywords": "terms", "keywords_scored": "scored"}), key, "left")
    out = out.join(listed(terms, {"keywords_bm25": "terms"}), key, "left").join(listed(phrases, {"keywords_keybert": "terms"}), key, "left")
    blank = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("keywords", "keywords_scored", "keywords_bm25", "keywords_keybert")}
    return out.withColumns(blank)
