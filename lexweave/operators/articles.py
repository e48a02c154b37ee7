"""Articles from blocks, two languages into one table, and batches for model calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import markdown as M
from ..functions.text import uuid5
from ..tables import placed, written


def block_rows(files: DataFrame, text: str) -> DataFrame:
    """One row per block of each file, in order: the file's other columns, pos and block."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(M.blocks(F.col(text))).alias("pos", "block"))


def classified(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Blocks with line, kind and number; empty and quoted ones drop out."""
    plain = F.trim(F.translate(F.regexp_replace("block", r"<[^>]+>", ""), M.NBSP, " "))
    rows = blocks.withColumn("block", plain).where((F.col("block") != "") & ~F.col("block").startswith(">"))
    rows = rows.withColumn("line", M.bare(F.col("block"))).where(F.col("line") != "")
    return rows.withColumn("_c", M.classify(F.col("line"), strict)).select(*rows.columns, F.col("_c.kind").alias("kind"), F.col("_c.number").alias("number"))


def carry_hierarchy(rows: DataFrame, file: list[str], pos: str = "pos", name: Column | None = None) -> DataFrame:
    """Rows of kinds with the section, chapter and paragraph in force at each.

    A section ends the chapter and paragraph before it, a chapter the paragraph.
    """
    name = M.strip_markdown(F.col("line")) if name is None else name
    kind = F.col("kind")
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    ran = lambda k: F.count(F.when(kind == k, 1))
    last = lambda k, w: F.last(F.when(kind == k, name), ignorenulls=True).over(w)
    out = rows.withColumn("section", last("section", so_far(*file))).withColumn("_s", ran("section").over(so_far(*file)))
    out = out.withColumn("chapter", last("chapter", so_far(*file, "_s"))).withColumn("_c", ran("chapter").over(so_far(*file, "_s")))
    return out.withColumn("paragraph", last("paragraph", so_far(*file, "_s", "_c"))).drop("_s", "_c")


def path(section: str = "section", chapter: str = "chapter", paragraph: str = "paragraph") -> Column:
    """The names in force joined by slashes; null if there are none."""
    return F.nullif(F.concat_ws(" / ", *[F.nullif(F.col(c), F.lit("")) for c in (section, chapter, paragraph)]), F.lit(""))


def segment(rows: DataFrame, file: list[str], pos: str = "pos") -> DataFrame:
    """Articles of each file: an article's head with the content blocks that follow it before any heading.

    ``rows`` has kind, number, block, section, chapter and paragraph.
    """
    w = Window.partitionBy(*file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("_g", F.count(F.when(F.col("kind") != "content", 1)).over(w))
    first_line = F.element_at(F.split("block", "\n", -1), 1)
    head = grouped.where(F.col("kind") == "article").select(
        *file, "_g", F.col(pos).alias("article_pos"), "number", M.strip_markdown(first_line).alias("title"), "section", "chapter", "paragraph",
        F.trim(F.regexp_replace(F.array_join(F.slice(F.split("block", "\n", -1), 2, 1_000_000), " "), r"\s+", " ")).alias("_rest"),
    )
    body = grouped.where(F.col("kind") == "content").groupBy(*file, "_g").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "block"))), lambda x: x["block"]).alias("_body"))
    joined = head.join(body, [*file, "_g"], "left")
    pieces = F.concat(F.filter(F.array("_rest"), lambda x: x != ""), F.coalesce("_body", F.array().cast("array<string>")))
    return joined.select(*file, "article_pos", "number", "title", path().alias("hierarchy"), "section", "chapter", "paragraph", F.array_join(pieces, "\n\n").alias("context"))


def parse(files: DataFrame, code: str, lang: str, text: str, strict: bool = False) -> DataFrame:
    """Articles of Markdown files (code, lang, text), with their name-based ids."""
    rows = carry_hierarchy(classified(block_rows(files.select(code, lang, text), text), strict), [code, lang])
    found = segment(rows, [code, lang])
    return found.withColumn("id", uuid5(F.lit("article"), F.col(code), F.col(lang), F.col("number")))


def merge_languages(ru: DataFrame, kz: DataFrame, key: str, fields: list[str], within: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Outer join of two languages' articles by number, within each code.

    Both sides have id, the key, ``pos`` and the fields.  Of Kazakh articles with one
    number the last stays; Russian ones all stay; an empty number matches nothing.
    """
    within = within or []
    keyed = kz.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    rest = [c for c in keyed.columns if c not in (*within, key)]
    last = keyed.groupBy(*within, key).agg(F.max_by(F.struct(*rest), pos).alias("_kz"))
    left = ru.select(*within, key, F.struct(*[c for c in ru.columns if c not in (*within, key)]).alias("_ru"))
    joined = left.join(last, [*within, key], "full")
    source = F.when(F.col("_ru").isNull(), "kz_only").when(F.col("_kz").isNull(), "ru_only").otherwise("both")
    both = [F.struct(F.col(f"_ru.{f}").alias("ru"), F.col(f"_kz.{f}").alias("kz")).alias(f) for f in fields]
    return joined.select(*within, key, F.coalesce("_ru.id", "_kz.id").alias("article_id"), source.alias("source"), *both)


def attach_keywords(articles: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """(key, pos, text_ru, text_kz): keywords of both lists by place; articles without keywords give none.

    ``keywords`` has the key and arrays ru and kz.
    """
    pairs = F.arrays_zip(F.coalesce("ru", F.array().cast("array<string>")).alias("ru"), F.coalesce("kz", F.array().cast("array<string>")).alias("kz"))
    return articles.select(key).join(keywords, key, "left").select(key, F.posexplode(pairs).alias("pos", "_p")).select(key, "pos", F.col("_p.ru").alias("text_ru"), F.col("_p.kz").alias("text_kz"))


def batch_cost(*texts: Column, overhead: int = C.SETTINGS.batch_overhead_chars) -> Column:
    """Characters that an article takes in a batch."""
    out = F.lit(overhead)
    for text in texts:
        out = out + F.length(F.coalesce(text.cast("string"), F.lit("")))
    return out


def greedy_batches(
    df: DataFrame, within: str, order: str, cost: str, max_items: int = C.SETTINGS.batch_articles, max_cost: int = C.SETTINGS.batch_chars, block: int = 10_000
) -> DataFrame:
    """(within, order, batch): consecutive rows, cut when a batch has ``max_items`` or would pass ``max_cost``.

    Each cut depends on the one before it.  A group is cut into blocks of ``block``
    rows, which changes nothing: a batch begins within the first ``max_items`` rows of
    every block, so each block says, for each such beginning, how many batches begin in
    it and where the first one beyond it does.  Following these tables from block to
    block tells each where its batches begin.  A row of null cost costs nothing.
    """
    block = max(block, max_items)
    rows = placed(df.select(within, order, F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long")).alias("_c")), [within], [order], "_p").withColumn("_p", F.col("_p") - 1)
    b = F.floor(F.col("_p") / block).cast("long")
    # The rows after a block that its last batch may still take are given to it as well.
    seen = F.when((F.col("_p") % block < max_items) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    dealt = written(rows.withColumn("_b", F.explode(seen)), "blocks")
    kinds = f"{within} {df.schema[within].dataType.simpleString()}, _b long"

    def table(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        following, n = _following(part, key[-1], block, max_items, max_cost)
        exits, counts = [0] * max_items, [0] * max_items
        for entry in range(min(max_items, n)):
            at = entry
            while at < n:
                counts[entry] += 1
                at = int(following[at])
            exits[entry] = at - n
        return pd.DataFrame({within: [key[0]], "_b": [key[1]], "exits": [exits], "counts": [counts]})

    def chain(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        entry, batch, entries, firsts = 0, 0, [], []
        parts = parts.sort_values("_b")
        for exits, counts in zip(parts["exits"], parts["counts"], strict=True):
            entries.append(entry)
            firsts.append(batch)
            batch, entry = batch + int(counts[entry]), int(exits[entry])
        return pd.DataFrame({within: parts[within], "_b": parts["_b"], "_entry": entries, "_first": firsts})

    def number(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        following, n = _following(part, key[-1], block, max_items, max_cost)
        part = part.sort_values("_p")
        begins = np.zeros(n, np.int64)
        at, first = int(part["_entry"].iloc[0]), int(part["_first"].iloc[0])
        while at < n:
            begins[at] = 1
            at = int(following[at])
        own = part.iloc[:n]
        return pd.DataFrame({within: own[within], order: own[order], "batch": first - 1 + begins.cumsum()})

    tables = dealt.groupBy(within, "_b").applyInPandas(table, f"{kinds}, exits array<int>, counts array<int>")
    chained = written(tables, "tables").groupBy(within).applyInPandas(chain, f"{kinds}, _entry long, _first long")
    other = chained.withColumnsRenamed({within: "_w", "_b": "_n"})
    joined = dealt.join(other, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_b") == F.col("_n"))).drop("_w", "_n")
    out = joined.groupBy(within, "_b").applyInPandas(number, f"{within} {df.schema[within].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, batch long")
    return out


def _following(part: pd.DataFrame, b: int, block: int, max_items: int, max_cost: int) -> tuple[np.ndarray, int]:
    """For each row of a block, where the batch after one that begins there begins; and how many rows the block has."""
    place = np.sort(part["_p"].to_numpy()) - b * block
    cost = part.sort_values("_p")["_c"].to_numpy()
    n = int((place < block).sum())
    so_far = np.concatenate(([0], np.cumsum(cost)))
    # A batch takes its first row whatever that costs, and then as many as fit.
    fits = np.searchsorted(so_far, so_far[:-1] + max_cost, "right") - 1
    at = np.arange(len(cost))
    return np.clip(fits, at + 1, np.minimum(at + max_items, len(cost)))[:n], n


def render(article_id: Column, number: Column, title_ru: Column, title_kz: Column, body_ru: Column, body_kz: Column, has_kz: Column) -> Column:
    """One article as it is shown to a model."""
    line = lambda label, c, sep=" ": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + sep), c))
    kz = F.coalesce(line("text_kz:", body_kz, "\n"), F.when(has_kz == "0", F.lit(C.MISSING_KZ)))
    parts = F.array(F.lit("### ARTICLE"), F.concat(F.lit("id: "), article_id), F.concat(F.lit("number: "), number), line("title_ru:", title_ru), line("title_kz:", title_kz), line("text_ru:", body_ru, "\n"), kz, F.lit(""))
    return F.array_join(F.array_compact(parts), "\n")
