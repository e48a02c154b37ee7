"""Entities, article references and codex names in statute texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from .text import matches


def codexes(spark: SparkSession) -> DataFrame:
    """The codex registry: (slug, name_ru, name_kz), a table of fixed size."""
    return spark.createDataFrame(list(C.CODEXES), "slug string, name_ru string, name_kz string")


def codex_name(slug: Column) -> Column:
    """Russian name of a codex, or the slug itself if it is unknown."""
    names = F.create_map(*[F.lit(x) for slug_, ru, _ in C.CODEXES for x in (slug_, ru)])
    return F.coalesce(F.try_element_at(names, slug), slug, F.lit(""))


def known_slugs(slugs: Column) -> Column:
    """The slugs that the registry has, in order; null gives an empty list."""
    registry = F.array(*[F.lit(c[0]) for c in C.CODEXES])
    return F.filter(F.coalesce(slugs, F.array().cast("array<string>")), lambda s: F.array_contains(registry, s))


def resolve_slugs(names: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """Join partial codex names in either language with the registry, which is of fixed size."""
    needle = F.lower(F.trim(F.col(name)))
    hit = F.contains(F.lower("name_ru"), needle) | F.contains(F.lower("name_kz"), needle)
    return names.join(F.broadcast(registry), (needle != "") & hit)


def resolve_expression(name: Column) -> Column:
    """The slugs whose names contain the text, in order of the registry."""
    needle = F.lower(F.trim(name))
    found = [F.when(F.contains(F.lit(ru.lower()), needle) | F.contains(F.lit(kz.lower()), needle), F.lit(slug)) for slug, ru, kz in C.CODEXES]
    return F.when(needle == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def entities(text: Column, patterns: Sequence[str], min_chars: int = C.SETTINGS.entity_min_chars, limit: int = C.SETTINGS.entities_per_kind) -> Column:
    """First distinct matches of more than ``min_chars`` characters, pattern by pattern."""
    text = F.coalesce(text, F.lit(""))
    found = F.flatten(F.array(*[F.transform(matches(text, p), lambda x: F.trim(x)) for p in patterns]))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > min_chars)), 1, limit)


def semantics(df: DataFrame, text: str, codex: str) -> DataFrame:
    """Adds the entity lists, has_* flags, codex-group flags, and whether a date occurs."""
    out = df.withColumns({kind: entities(F.col(text), patterns) for kind, patterns in C.ENTITY_PATTERNS.items()})
    flags = {f"has_{kind}": F.size(kind) > 0 for kind in C.ENTITY_PATTERNS}
    flags |= {name: F.coalesce(F.col(codex).isin(*slugs), F.lit(False)) for name, slugs in C.CODEX_GROUPS.items()}
    flags["has_temporal_info"] = F.coalesce(F.col(text).rlike(C.DATE_PATTERN), F.lit(False))
    return out.withColumns(flags)


def references(df: DataFrame, key: str, codex: str, text: str, strict: bool = False) -> DataFrame:
    """Article numbers that a text refers to: (key, codex, pos, evidence, number).

    Ranges give at most ten numbers.  As the rules stand, a hyphen makes a range, so
    that 54-1 gives none; ``strict`` takes a descending pair as one number and knows
    every case form.
    """
    patterns = C.STRICT_REFERENCE_PATTERNS if strict else C.REFERENCE_PATTERNS
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(F.array(*[F.arrays_zip(matches(body, p).alias("evidence"), matches(body, p, 1).alias("raw")) for p in patterns]))
    rows = df.select(key, codex, F.posexplode(found).alias("match_pos", "m")).select(key, codex, "match_pos", F.trim("m.evidence").alias("evidence"), F.trim("m.raw").alias("raw"))
    parts = F.split("raw", "[–-]")
    first, last = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2))
    is_pair = F.col("raw").rlike("[–-]")
    span = F.when(last >= first, F.transform(F.sequence(first, F.least(last, first + (C.SETTINGS.range_length - 1))), lambda n: n.cast("string")))
    single = F.array(F.col("raw")) if strict else F.array().cast("array<string>")
    numbers = F.when(~is_pair, F.array("raw")).when(first.isNull() | last.isNull(), F.array(F.element_at(parts, 1))).otherwise(F.coalesce(span, single))
    return rows.select(key, codex, "match_pos", "evidence", F.posexplode(numbers).alias("number_pos", "number"))


def reference_edges(refs: DataFrame, articles: DataFrame, key: str, codex: str, number: str) -> DataFrame:
    """References within a codex as edges (source_id, target_id, evidence, number), the first of each pair.

    Of articles with one number the last by key counts; references to oneself and to
    unknown numbers are dropped.
    """
    last = articles.where(F.col(number).isNotNull()).groupBy(F.col(codex).alias("_codex"), F.col(number).alias("_number")).agg(F.max(key).alias("target_id"))
    joined = refs.join(last, (refs[codex] == last["_codex"]) & (refs["number"] == last["_number"])).where(F.col(key) != F.col("target_id"))
    first = Window.partitionBy(key, "target_id").orderBy("match_pos", "number_pos")
    return joined.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).select(F.col(key).alias("source_id"), "target_id", "evidence", "number")
