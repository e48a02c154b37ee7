"""Conversion clean-up and Markdown stripping as column expressions.

``clean`` works on whole texts.  Steps that walk over lines with a state are folds
over the array of lines inside one expression, so a text is never cut into rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import bound

NBSP = "\u00a0"


def line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def plain_spaces(text: Column) -> Column:
    return F.translate(text, NBSP, " ")


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, "(?sU)" + C.IMAGE, "")


def without_span_attributes(text: Column) -> Column:
    return F.regexp_replace(text, C.SPAN_ATTRIBUTES, "$1")


def without_escapes(text: Column) -> Column:
    return F.regexp_replace(text, C.ESCAPE, "$1")


def paragraph_breaks(text: Column) -> Column:
    return F.regexp_replace(text, C.HARD_BREAK, "\n\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def without_indent(text: Column) -> Column:
    """Lines without leading blanks, but for tables and what stands between fences."""
    parsed = F.transform(_lines(text), lambda line, i: F.struct(line.alias("line"), F.regexp_replace(line, "^[ \\t\u00a0]+", "").alias("bare"), i.alias("i")))
    turns = lambda x: x["bare"].startswith("```") | x["bare"].startswith("~~~")

    def stripped(p: Column) -> Column:
        fences = p["fences"]
        inside = lambda x: F.size(F.filter(fences, lambda f: f <= x["i"])) % 2 == 1
        return F.transform(p["lines"], lambda x: F.when(x["bare"].startswith("|") | inside(x), x["line"]).otherwise(x["bare"]))

    with_fences = bound(parsed, lambda xs: F.struct(xs.alias("lines"), F.transform(F.filter(xs, turns), lambda x: x["i"]).alias("fences")))
    return F.array_join(bound(with_fences, stripped), "\n")


def quoted_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, "(?mU)" + C.FOOTNOTE, "> *$0*")


def quoted_notes(text: Column) -> Column:
    return F.regexp_replace(text, "(?mU)" + C.SERVICE_NOTE, "> ℹ *$0*")


def _level_of(text: Column) -> Column:
    known = "|".join(f"(?:{pattern})" for pattern, _ in C.HEADINGS)  # most bold lines are none of them
    return F.when(text.rlike("(?iuU)" + known), F.coalesce(*[F.when(text.rlike("(?iuU)" + pattern), F.lit(level)) for pattern, level in C.HEADINGS]))


def heading_level(text: Column) -> Column:
    """Level of a bold line's text: as it is, without leading quotes, or without a leading number; else null."""
    strip = lambda t, pattern: F.trim(F.regexp_replace(t, "(?U)" + pattern, ""))

    def unnumbered(base: Column) -> Column:
        return bound(F.struct(base.alias("a"), strip(base, C.LEADING_NUMBER).alias("b")), lambda p: F.when(p["b"] != p["a"], _level_of(p["b"])))

    def level(p: Column) -> Column:
        base = F.when(p["u"] == "", p["t"]).otherwise(p["u"])
        return F.coalesce(_level_of(p["t"]), F.when(p["u"] != p["t"], _level_of(p["u"])), unnumbered(base))

    return bound(F.struct(text.alias("t"), strip(text, C.LEADING_QUOTES).alias("u")), level)


#: Characters that no text may hold, to mark headings, bold lines, and where a bold line's own text begins.
_HEAD, _BOLD, _LINE = "\ufdd0", "\ufdd1", "\ufdd2"


def headings_of_bold_lines(text: Column) -> Column:
    """Bold lines of a heading's form become headings; unformed bold lines after one, with only blanks between, join it.

    Lines are marked, and one pattern that goes on from its last match joins what
    follows a heading, so the time is linear in the text.
    """
    bold = r"^\*\*(.+?)\*\*\r?\s*$"

    def marked(x: Column) -> Column:
        heading = F.concat(F.lit(_HEAD), F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["content"])
        return F.when(x["level"].isNotNull(), heading).when(x["bold"], F.concat(F.lit(_BOLD), x["content"], F.lit(_LINE), x["line"])).otherwise(x["line"])

    def parsed(line: Column) -> Column:
        is_bold, content = line.rlike(bold), F.trim(F.regexp_extract(line, bold, 1))
        return F.struct(line.alias("line"), is_bold.alias("bold"), F.when(is_bold, content).alias("content"), F.when(is_bold, bound(content, heading_level)).alias("level"))

    lines = F.array_join(F.transform(_lines(text), lambda line: bound(parsed(line), marked)), "\n")
    joined = F.regexp_replace(lines, rf"(?mdU)(^{_HEAD}[^\n]*|(?!^)\G)(?:\n[^\S\n]*)*\n{_BOLD}([^\n{_LINE}]*){_LINE}[^\n]*", "$1 $2")
    return F.regexp_replace(joined, rf"(?md)^(?:{_HEAD}|{_BOLD}[^\n{_LINE}]*{_LINE})", "")


def joined_soft_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\n)\n(?!\n)(?!#{1,6}\s|\d+[.)]\s|[-*+]\s|>|\|)", " ")


def fewer_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


STEPS = (
    line_endings, plain_spaces, without_images, without_span_attributes, without_escapes, paragraph_breaks, without_indent, quoted_footnotes, quoted_notes,
    headings_of_bold_lines, joined_soft_breaks, fewer_blank_lines,
)


def clean(text: Column) -> Column:
    """Every step in order, trimmed, with one line break at the end; null stays null."""
    return F.concat(F.regexp_replace(reduce(lambda t, step: step(t), STEPS, text), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def strip_markdown(text: Column) -> Column:
    """Text without tags, heading marks, emphasis, code marks and runs of spaces; null gives an empty text."""
    out = F.translate(F.coalesce(text, F.lit("")), NBSP, " ")
    for pattern, keep in (
        (r"<[^>]+>", ""), (r"^#{1,6}\s+", ""), (r"(?s)\*{1,3}(.*?)\*{1,3}", "$1"), (r"(?s)_{1,2}(.*?)_{1,2}", "$1"), (r"`(.+?)`", "$1"), (r"  +", " "),
    ):
        out = F.regexp_replace(out, pattern, keep)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def bare(block: Column) -> Column:
    """First line of a block without heading marks, tags and emphasis around it."""
    first = F.trim(F.element_at(F.split(block, r"\n", -1), 1))
    first = F.regexp_replace(F.translate(F.regexp_replace(first, r"^#{1,6}\s+", ""), NBSP, " "), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(first, r"(?s)^\*{1,3}(.*?)\*{1,3}$", "$1"))


def classify(line: Column, strict: bool = False) -> Column:
    """struct(kind, number) of a block's bare line: article, paragraph, section, chapter or content.

    As the rules stand, section and chapter words count anywhere in the line;
    ``strict`` wants them at its beginning.
    """
    flags = "(?iuU)"
    section, chapter = (("^[\\p{L}\\p{N}\\- ]{0,12}" + p if strict else p) for p in (C.SECTION, C.CHAPTER))
    number = lambda p: F.nullif(F.regexp_extract(line, flags + p, 1), F.lit(""))
    kind = lambda name, n=None: F.struct(F.lit(name).alias("kind"), (n if n is not None else F.lit("")).alias("number"))
    article = F.coalesce(number(C.ARTICLE_RU), number(C.ARTICLE_KZ))
    return (
        F.when(article.isNotNull(), kind("article", article))
        .when(line.rlike(flags + C.PARAGRAPH_KZ) | line.rlike(flags + C.PARAGRAPH_RU), kind("paragraph"))
        .when(line.rlike(flags + section), kind("section"))
        .when(line.rlike(flags + chapter), kind("chapter"))
        .otherwise(kind("content"))
    )


def blocks(text: Column) -> Column:
    """Blocks of a text: continuation lines joined, blank lines as borders, tables as they are, else one line each."""
    whole = F.translate(line_endings(F.coalesce(text, F.lit(""))), NBSP, " ")
    # A line that ends in a backslash takes the next one if that begins in lower case, and each is taken once, as matches of
    # a pattern are; what is joined is marked, so that it is not cut again.
    joined = F.regexp_replace(whole, r"(?mdU)^([^\n]*?)[^\S\n]*\\[^\S\n]*\n *([*_`#]*\p{Ll}[^\n]*?) *$", f"$1 $2{_LINE}")
    parted = F.regexp_replace(joined, r"(?mdU)^([^\n]*?)[^\S\n]*\\[^\S\n]*(?=\n)", "$1\n")
    merged = F.translate(F.regexp_replace(parted, r"(?mdU)[^\S\n]+$", ""), _LINE, "")
    cut = F.filter(F.transform(F.split(merged, "\n\n", -1), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")
    return F.transform(cut, lambda b: F.when(b.rlike(r"(?m)^\s*\|"), b).otherwise(F.regexp_replace(b, r"(?U)\s*\n\s*", " ")))
