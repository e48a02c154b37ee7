"""Tokens, n-grams, languages, identifiers and other column functions over text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

WORD = r"[\p{L}\p{N}_]+"


def matches(text: Column, pattern: str, group: int = 0, flags: str = "(?iuU)") -> Column:
    """All matches of a pattern, case-insensitive and Unicode-aware unless ``flags`` say otherwise."""
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though functions over elements refer to it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def language(text: Column, letters: str = C.KAZAKH_LETTERS, threshold: float = C.SETTINGS.language_share, yes: str = "kz", no: str = "ru") -> Column:
    """``yes`` where more than ``threshold`` of the characters are among ``letters``."""
    text = F.coalesce(text, F.lit(""))
    # The first character maps to itself, so that translate removes all the others.
    rest = F.length(F.translate(text, letters, ""))
    share = (F.length(text) - rest) / F.greatest(F.length(text), F.lit(1))
    return F.when(share > threshold, F.lit(yes)).otherwise(F.lit(no))


def terms(text: Column, lang: Column | None = None, stopwords: dict[str, Iterable[str]] | None = None) -> Column:
    """Lower-cased letter runs of three and more, without the stop words of the text's language."""
    stopwords = stopwords if stopwords is not None else {"ru": C.STOPWORDS_RU, "kz": C.STOPWORDS_KZ}
    lang = language(text) if lang is None else lang
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.TERM), F.lit(0))

    def without(listed: Iterable[str]) -> Column:
        return F.filter(found, lambda t: ~t.isin(*sorted(listed)))

    out = found
    for name, listed in stopwords.items():
        out = F.when(lang == name, without(listed)).otherwise(out)
    return out


def citations(text: Column) -> Column:
    """Normalised article citations of either language, Russian forms first, in order of place."""
    text = F.coalesce(text, F.lit(""))
    ru = F.transform(matches(text, C.CITATION_RU, 1), lambda n: F.concat(F.lit("статья "), n))
    kz = F.transform(matches(text, C.CITATION_KZ, 1), lambda n: F.concat(n, F.lit("-бап")))
    return F.concat(ru, kz)


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding runs of ``n`` tokens, joined by a space; none if there are fewer."""
    def over(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    return bound(tokens, over)


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by two bars; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


#: Fixed value: the X.500 namespace of name-based UUIDs.
X500 = "6ba7b8149dad11d180b400c04fd430c8"


def uuid5(*parts: Column) -> Column:
    """Version-5 UUID, in the X.500 namespace, of the parts joined by a bar."""
    name = F.encode(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(X500)), name))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        F.lower(F.hex(variant.cast("long"))), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def unfence(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def contains_either(needle: Column, *hay: Column) -> Column:
    """Case-insensitive: whether any of the columns contains the needle; null contains nothing."""
    out = F.lit(False)
    for column in hay:
        out = out | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(needle))
    return out


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty, or an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def both_languages(ru: Column, kz: Column) -> Column:
    """Either text, or both with a space between."""
    return F.concat_ws(" ", F.nullif(ru, F.lit("")), F.nullif(kz, F.lit("")))


def percent(value: Column, decimals: int = 1) -> Column:
    """A share as a percentage; nothing for null and not-a-number."""
    return F.when(value.isNull() | F.isnan(value), F.lit("n/a")).otherwise(F.concat(F.format_number(value * 100, decimals), F.lit("%")))


def band(value: Column, low: float = 0.4, high: float = 0.7) -> Column:
    """Colour of a score."""
    return F.when(value.isNull() | F.isnan(value), "dim").when(value >= high, "green").when(value >= low, "yellow").otherwise("red")


def without_nan(value: Column) -> Column:
    """Null for not-a-number and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
