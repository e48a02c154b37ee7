"""Registered queries of single rules, and the same in SQL: Markdown steps, patterns, normalisation, upserts and reports.

Texts that a rule applies to are made of the documents, with the marks that it looks for put in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import legal, markdown, payload
from ..functions import metrics as M
from ..functions import text as X
from ..operators import articles as A
from ..operators import graph as G
from ..operators import index as I
from ..operators import keywords as K
from ..operators import reports as R
from ..operators import retrieval as T
from ..operators import vectors as V
from ..sources import files
from ..tables import folder
from . import answer as P
from . import providers
from .queries import _BASE, _EDGES, _HITS, _PACKED, _RANKED, corpus, documents, query, questions, table


def _q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _plain(pattern: str) -> str:
    """A pattern as SQL's engine takes it: the same, as a literal."""
    return _q(pattern)


# -- Markdown, step by step -----------------------------------------------------

#: What is put into the texts before each step, as pairs of strings to replace.
_MADE = {
    "line_endings": ((" a", "\r\na"), (" o", "\ro")),
    "plain_spaces": ((" t", " t"),),
    "without_images": ((" the ", " ![a b](x.png){width=3} \n"), (" de ", " ![](y) de ")),
    "without_span_attributes": ((" to ", " [to]{.mark} "), (" la ", " [la la]{#x} ")),
    "without_escapes": ((".", "\\."), (",", "\\*,")),
    "paragraph_breaks": ((", ", ",\\ \n"), (". ", ".\\x")),
    "without_indent": ((". ", ".\n \t"), (", ", ",\n```\n  "), (" the ", " the\n  | ")),
    "quoted_footnotes": ((". ", ".\nСноска. "), (", ", ",\nЕскерту.\t")),
    "quoted_notes": ((". ", ".\nЗҚАИ ескертпесі!\n"), (", ", ",\nПримечание ИЗПИ! \n"), (" the ", "\nВниманию пользователей! the ")),
    "headings_of_bold_lines": ((". ", ".\n**Глава 3**\n\n**Общие**\n"), (", ", "\n**просто**\n"), (" the ", "\n**Статья 5. О**\n"), (" de ", "\n\n")),
    "joined_soft_breaks": ((". ", ".\n"), (", ", "\n- "), (" the ", "\n\n"), (" de ", "\n# "), (" und ", "\n1) "), (" of ", "\n> ")),
    "fewer_blank_lines": ((". ", ".\n\n\n\n"), (", ", "\n\n")),
}


def _made(text: Column, step: str) -> Column:
    for old, new in _MADE[step]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _sql_text(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c in "\r\n\t " else _q(c) for c in text) if any(c in "\r\n\t " for c in text) else _q(text)


def _made_sql(step: str, text: str = "text") -> str:
    for old, new in _MADE[step]:
        text = f"replace({text}, {_q(old)}, {_sql_text(new)})"
    return text


def _replace(pattern: str, keep: str, flags: str = "") -> Callable[[str], str]:
    return lambda t: f"regexp_replace({t}, {_q(flags + pattern)}, {_sql_text(keep)}, 'g')"


_SCALAR: dict[str, Callable[[str], str]] = {
    "line_endings": lambda t: f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))",
    "plain_spaces": lambda t: f"replace({t}, chr(160), ' ')",
    "without_images": _replace(C.IMAGE, "", "(?s)"),
    "without_span_attributes": _replace(C.SPAN_ATTRIBUTES, "\\1"),
    "without_escapes": _replace(C.ESCAPE, "\\1"),
    "paragraph_breaks": _replace(C.HARD_BREAK, "\n\n"),
    "quoted_footnotes": _replace(C.FOOTNOTE, "> *\\0*", "(?m)"),
    "quoted_notes": _replace(C.SERVICE_NOTE, "> ℹ *\\0*", "(?m)"),
    "fewer_blank_lines": _replace(r"\n{3,}", "\n\n"),
}


def _level_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q('(?i)' + p)}) THEN {level}" for p, level in C.HEADINGS) + " END"


def _heading_sql(text: str) -> str:
    """SQL of heading_level."""
    unquoted = f"trim(regexp_replace({text}, {_q(C.LEADING_QUOTES)}, ''))"
    base = f"(CASE WHEN {unquoted} = '' THEN {text} ELSE {unquoted} END)"
    unnumbered = f"trim(regexp_replace({base}, {_q(C.LEADING_NUMBER)}, ''))"
    return f"coalesce({_level_sql(text)}, CASE WHEN {unquoted} <> {text} THEN {_level_sql(unquoted)} END, CASE WHEN {unnumbered} <> {base} THEN {_level_sql(unnumbered)} END)"


_BOLD = r"^\*\*(.+?)\*\*\r?\s*$"


def _lines_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i, len(string_split(t, chr(10))) AS n FROM {source})"


#: Steps that walk over lines: common table expressions from (id, t) to (id, t).
_WALK: dict[str, Callable[[str, str], str]] = {
    "without_indent": lambda a, b: f"""{_lines_sql(a + '_l', a)},
{a}_f AS (SELECT *, regexp_replace(line, '^[ ' || chr(9) || chr(160) || ']+', '') AS bare FROM {a}_l),
{a}_g AS (SELECT *, sum((starts_with(bare, '```') OR starts_with(bare, '~~~'))::INT) OVER (PARTITION BY id ORDER BY i) % 2 = 1 AS fence FROM {a}_f),
{b} AS (SELECT id, string_agg(CASE WHEN NOT fence AND NOT starts_with(bare, '|') THEN bare ELSE line END, chr(10) ORDER BY i) AS t FROM {a}_g GROUP BY id)""",
    "headings_of_bold_lines": lambda a, b: f"""{_lines_sql(a + '_l', a)},
{a}_c AS (SELECT *, regexp_matches(line, {_q(_BOLD)}) AS bold, trim(regexp_extract(line, {_q(_BOLD)}, 1)) AS content FROM {a}_l),
{a}_d AS (SELECT *, CASE WHEN bold THEN {_heading_sql('content')} END AS level FROM {a}_c),
{a}_e AS (SELECT *, sum((level IS NOT NULL OR (NOT bold AND trim(line) <> ''))::INT) OVER (PARTITION BY id ORDER BY i) AS seg FROM {a}_d),
{a}_f AS (SELECT *, max((level IS NOT NULL)::INT) OVER (PARTITION BY id, seg) = 1 AND seg > 0 AS headed,
  coalesce(max(CASE WHEN bold AND level IS NULL THEN i END) OVER (PARTITION BY id, seg), 0) AS grown FROM {a}_e),
{a}_h AS (SELECT id, seg, string_agg(content, ' ' ORDER BY i) AS more FROM {a}_f WHERE headed AND bold AND level IS NULL GROUP BY id, seg),
{b} AS (SELECT f.id, string_agg(CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' || content || coalesce(' ' || more, '') ELSE line END, chr(10) ORDER BY i) AS t
  FROM {a}_f f LEFT JOIN {a}_h h ON h.id = f.id AND h.seg = f.seg WHERE NOT (headed AND level IS NULL AND i <= grown) GROUP BY f.id)""",
    "joined_soft_breaks": lambda a, b: f"""{_lines_sql(a + '_l', a)},
{a}_n AS (SELECT *, lead(line) OVER (PARTITION BY id ORDER BY i) AS after FROM {a}_l),
{b} AS (SELECT id, string_agg(line || CASE WHEN after IS NULL THEN '' WHEN (line <> '' OR i = 1) AND (after <> '' OR i + 1 = n)
  AND NOT regexp_matches(after || CASE WHEN i + 1 < n THEN chr(10) ELSE '' END, '^(#{{1,6}}\\s|\\d+[.)]\\s|[-*+]\\s|>|\\|)') THEN ' ' ELSE chr(10) END, '' ORDER BY i) AS t FROM {a}_n GROUP BY id)""",
}


def _step_sql(name: str, source: str, target: str) -> str:
    return f"{target} AS (SELECT id, {_SCALAR[name]('t')} AS t FROM {source})" if name in _SCALAR else _WALK[name](source, target)


def _register_step(name: str) -> None:
    step = next(s for s in markdown.STEPS if s.__name__ == name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("id", F.md5(step(_made(F.col("body"), name))).alias("content"))

    run.__name__ = f"md_{name}"
    query(f"WITH s0 AS (SELECT doc_id AS id, {_made_sql(name)} AS t FROM documents),\n{_step_sql(name, 's0', 's1')} SELECT id, md5(t) AS content FROM s1")(run)


for _name in _MADE:
    _register_step(_name)

#: All marks at once, for the whole chain.
_MADE["chain"] = (
    (" a", "\r\na"), (" the ", " ![a](x.png)\n the "), (" to ", " [to]{.mark} "), (" or ", " \\. or "), ("ly ", "ly\\ \n"), (" in ", "\n  in "), (". ", ".\nСноска. "),
    (", ", ",\n\n**Глава 3**\n\n**Общие**\n"), (" of ", "\n\n\n\nof "),
)
_CHAIN = ",\n".join(_step_sql(step.__name__, f"s{i}", f"s{i + 1}") for i, step in enumerate(markdown.STEPS))


@query(f"WITH s0 AS (SELECT doc_id AS id, {_made_sql('chain')} AS t FROM documents),\n{_CHAIN}\nSELECT id, md5(regexp_replace(t, '^\\s+|\\s+$', '', 'g') || chr(10)) AS content FROM s{len(markdown.STEPS)}")
def md_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.md5(markdown.clean(_made(F.col("body"), "chain"))).alias("content"))


#: Lines that headings and kinds are told from.
_HEADS = (
    "ТРУДОВОЙ КОДЕКС", "Раздел IV. Общее", "1-БӨЛІМ. Жалпы", "БӨЛІМ 2", "Глава 3. Права", "3-тарау. Құқық", "4 тарау", "Статья 5. Имя", "12-1-бап. Аты", "7 бап", "Параграф 2. О",
    "§ 3", "2-параграф. Ж", "«Глава 9»", "3. Глава 7", "просто текст", "ОБЩАЯ ЧАСТЬ", "Статья 12-3 без точки", "№ 5", "в разделе РАЗДЕЛ 5", "см. Глава 4 и тарау", "15-баптың. Х",
)


def _head(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.pmod(i, F.lit(len(_HEADS))) + 1).cast("int"))


_HEAD_SQL = "[" + ", ".join(_q(h) for h in _HEADS) + f"][(doc_id % {len(_HEADS)}) + 1]"


@query(f"WITH h AS (SELECT doc_id AS id, {_HEAD_SQL} AS t FROM documents) SELECT id, ({_heading_sql('t')})::BIGINT AS level FROM h")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", markdown.heading_level(_head(F.col("id"))).alias("level"))


def _classify_sql(t: str) -> tuple[str, str]:
    number = f"coalesce(nullif(regexp_extract({t}, {_q('(?i)' + C.ARTICLE_RU)}, 1), ''), nullif(regexp_extract({t}, {_q('(?i)' + C.ARTICLE_KZ)}, 1), ''))"
    has = lambda p: f"regexp_matches({t}, {_q('(?i)' + p)})"
    # The SQL engine's word borders know ASCII letters only.
    wide = lambda p: p.replace(r"\b(?:", r"(?:^|[^\p{L}\p{N}_])(?:").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])")
    kind = f"CASE WHEN {number} IS NOT NULL THEN 'article' WHEN {has(C.PARAGRAPH_KZ)} OR {has(C.PARAGRAPH_RU)} THEN 'paragraph' WHEN {has(wide(C.SECTION))} THEN 'section' WHEN {has(wide(C.CHAPTER))} THEN 'chapter' ELSE 'content' END"
    return kind, f"coalesce({number}, '')"


@query(f"WITH h AS (SELECT doc_id AS id, {_HEAD_SQL} AS t FROM documents) SELECT id, {_classify_sql('t')[0]} AS kind, {_classify_sql('t')[1]} AS number FROM h")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", markdown.classify(_head(F.col("id"))).alias("c")).select("id", "c.kind", "c.number")


_BARE_SQL = "trim(regexp_replace(regexp_replace(replace(regexp_replace(trim(string_split({0}, chr(10))[1]), '^#{{1,6}}\\s+', ''), chr(160), ' '), '<[^>]+>', '', 'g'), '(?s)^\\*{{1,3}}(.*?)\\*{{1,3}}$', '\\1'))"
_BARE_MADE = "'## **' || replace(substr(text, 1, 60), ' t', chr(160) || 't') || '**<a id=x></a>' || chr(10) || text"


@query(f"SELECT doc_id AS id, md5({_BARE_SQL.format('(' + _BARE_MADE + ')')}) AS line FROM documents")
def bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("## **"), F.replace(F.substring("body", 1, 60), F.lit(" t"), F.lit(" t")), F.lit("**<a id=x></a>\n"), F.col("body"))
    return documents(spark, sf_dir).select("id", F.md5(markdown.bare(made)).alias("line"))


_MADE["blocks"] = ((". ", ".\\\nand "), (", ", ",\\ \nОн "), (" the ", " the\n"), (" of ", "\n\n"), (" de ", "\n\n| a | b |\n| c |\n\n"), (" und ", "\\\nund\\\n*x*\\\nY "))


@query(f"""WITH s0 AS (SELECT doc_id AS id, {_made_sql('blocks')} AS t FROM documents),
{_lines_sql('l', 's0')},
a AS (SELECT *, regexp_replace(line, '\\s+$', '') AS r, lead(line) OVER (PARTITION BY id ORDER BY i) AS after FROM l),
b AS (SELECT *, ends_with(r, chr(92)) AND after IS NOT NULL AS broken, trim(after) AS following, regexp_replace(regexp_replace(r, '\\\\$', ''), '\\s+$', '') AS cut FROM a),
c AS (SELECT *, broken AND regexp_matches(regexp_replace(following, '[*_`#]', '', 'g'), '^\\p{{Ll}}') AS joins FROM b),
d AS (SELECT *, coalesce(max(CASE WHEN NOT joins THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM c),
m AS (SELECT id, string_agg(CASE WHEN joins THEN cut || ' ' || following WHEN broken THEN cut || chr(10) ELSE r END, chr(10) ORDER BY i) AS t FROM d WHERE (i - 1 - last) % 2 = 0 GROUP BY id),
p AS (SELECT id, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS k FROM m),
e AS (SELECT id, k, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM p)
SELECT id, count(*) AS n, md5(string_agg(CASE WHEN regexp_matches(x, '(?m)^\\s*\\|') THEN x ELSE regexp_replace(x, '\\s*\\n\\s*', ' ', 'g') END, '¦' ORDER BY k)) AS blocks FROM e WHERE x <> '' GROUP BY id""")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("id", markdown.blocks(_made(F.col("body"), "blocks")).alias("b")).where(F.size("b") > 0)
    return found.select("id", F.size("b").cast("long").alias("n"), F.md5(F.array_join("b", "¦")).alias("blocks"))


@query(f"""WITH h AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '> quoted' WHEN doc_id % 4 = 1 THEN '<a></a>' || chr(160) WHEN doc_id % 4 = 2 THEN '**' || {_HEAD_SQL} || '**' ELSE '###' END AS t FROM documents),
p AS (SELECT id, trim(replace(regexp_replace(t, '<[^>]+>', '', 'g'), chr(160), ' ')) AS t FROM h), k AS (SELECT id, t, {_BARE_SQL.format('t')} AS line FROM p WHERE t <> '' AND NOT starts_with(t, '>'))
SELECT id, {_classify_sql('line')[0]} AS kind FROM k WHERE line <> ''""")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    made = F.when(i % 4 == 0, "> quoted").when(i % 4 == 1, "<a></a> ").when(i % 4 == 2, F.concat(F.lit("**"), _head(i), F.lit("**"))).otherwise("###")
    return A.classified(documents(spark, sf_dir).select("id", made.alias("block"))).select("id", "kind")


# -- patterns and texts -----------------------------------------------------------

_CITES = "'по статье ' || doc_id || ', Статьи ' || (doc_id % 7) || '-1 и ' || (doc_id % 9) || '-баптың; 5-2-бап, статьях 3'"


def _cites(i: Column) -> Column:
    return F.concat(F.lit("по статье "), i, F.lit(", Статьи "), i % 7, F.lit("-1 и "), i % 9, F.lit("-баптың; 5-2-бап, статьях 3"))


@query(f"""WITH c AS (SELECT doc_id AS id, {_CITES} AS t FROM documents)
SELECT id, array_to_string([('статья ' || x) FOR x IN regexp_extract_all(t, {_q('(?i)' + C.CITATION_RU)}, 1)] || [(x || '-бап') FOR x IN regexp_extract_all(t, {_q('(?i)' + C.CITATION_KZ)}, 1)], '|') AS cited FROM c""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.array_join(X.citations(_cites(F.col("id"))), "|").alias("cited"))


_ALL = [(kind, p) for kind, patterns in C.ENTITY_PATTERNS.items() for p in patterns]
_SEM_SQL = "'Здесь ' || [" + ", ".join(_q(p) for _, p in _ALL) + f"][(doc_id % {len(_ALL)}) + 1] || ' и ' || upper([" + ", ".join(_q(p) for _, p in _ALL) + f"][((doc_id * 7) % {len(_ALL)}) + 1]) || CASE WHEN doc_id % 3 = 0 THEN ' от 01.02.2020' ELSE '' END"
_HAS = ", ".join("(" + " OR ".join(f"contains(lower(t), {_q(p)})" for p in patterns if len(p) > C.SETTINGS.entity_min_chars) + f") AS has_{kind}" for kind, patterns in C.ENTITY_PATTERNS.items())
_SLUGS = [c[0] for c in C.CODEXES]


@query(f"""WITH s AS (SELECT doc_id AS id, {_SEM_SQL} AS t, [{', '.join(_q(s) for s in _SLUGS)}][(doc_id % 24) + 1] AS codex FROM documents)
SELECT id, {_HAS}, {', '.join(f"codex IN ({', '.join(_q(s) for s in slugs)}) AS {name}" for name, slugs in C.CODEX_GROUPS.items())}, regexp_matches(t, {_q(C.DATE_PATTERN)}) AS has_temporal_info FROM s""")
def semantic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    pick = lambda n: F.element_at(F.array(*[F.lit(p) for _, p in _ALL]), (n % len(_ALL) + 1).cast("int"))
    made = F.concat(F.lit("Здесь "), pick(i), F.lit(" и "), F.upper(pick(i * 7)), F.when(i % 3 == 0, " от 01.02.2020").otherwise(""))
    d = documents(spark, sf_dir).select("id", made.alias("t"), F.element_at(F.array(*[F.lit(s) for s in _SLUGS]), (i % 24 + 1).cast("int")).alias("slug"))
    return legal.semantics(d, "t", "slug").select("id", *[f"has_{k}" for k in C.ENTITY_PATTERNS], *C.CODEX_GROUPS, "has_temporal_info")


_NAMES_SQL = "map {" + ", ".join(f"{_q(s)}: {_q(ru)}" for s, ru, _ in C.CODEXES) + "}"


@query(f"WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE [{', '.join(_q(s) for s in _SLUGS)}][(doc_id % 24) + 1] END AS slug FROM documents) SELECT id, coalesce({_NAMES_SQL}[slug], slug) AS name FROM s")
def codex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    slug = F.when(i % 5 == 0, "unknown").otherwise(F.element_at(F.array(*[F.lit(s) for s in _SLUGS]), (i % 24 + 1).cast("int")))
    return documents(spark, sf_dir).select("id", legal.codex_name(slug).alias("name"))


@query("SELECT doc_id AS id, md5(CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 20) WHEN 1 THEN lang ELSE source END) AS filled, md5(CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 20) || ' ' || lang WHEN 1 THEN lang ELSE '' END) AS both FROM documents")
def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    a = F.when(i % 3 == 0, F.substring("body", 1, 20)).when(i % 3 == 1, "")
    b = F.when(i % 3 < 2, F.col("lang"))
    return documents(spark, sf_dir).select("id", F.md5(X.first_filled(a, b, F.col("codex"))).alias("filled"), F.md5(X.both_languages(a, b)).alias("both"))


@query("SELECT doc_id AS id, md5(trim(text)) AS plain FROM documents")
def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    fence = F.when(i % 2 == 0, F.lit("```json\n")).otherwise(F.lit("``` "))
    return documents(spark, sf_dir).select("id", F.md5(X.unfence(F.concat(fence, F.trim("body"), F.lit("\n```")))).alias("plain"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'infinity'::DOUBLE WHEN 2 THEN NULL ELSE value - floor(value) END AS v, event_id % 7 AS k FROM events)
SELECT event_id, CASE WHEN k < 3 THEN NULL ELSE round(v, 6) END AS finite, CASE WHEN k IN (0, 2) THEN 'dim' WHEN v >= 0.7 THEN 'green' WHEN v >= 0.4 THEN 'yellow' ELSE 'red' END AS band,
CASE WHEN k IN (0, 2) THEN 'n/a' WHEN k = 1 THEN NULL ELSE printf('%.0f%%', round_even(v * 100, 0)) END AS share, CASE WHEN k < 3 THEN NULL ELSE round(greatest(0.2, least(0.8, v)), 6) END AS clamped FROM e""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    v = F.when(i % 7 == 0, float("nan")).when(i % 7 == 1, float("inf")).when(i % 7 == 2, None).otherwise(F.col("value") - F.floor("value"))
    e = table(spark, sf_dir, "events").select("event_id", (i % 7).alias("k"), v.alias("v"))
    v, k = F.col("v"), F.col("k")
    return e.select(
        "event_id", F.round(X.without_nan(v), 6).alias("finite"), X.band(v).alias("band"), F.when(k != 1, X.percent(v, 0)).alias("share"), F.when(k >= 3, F.round(payload.clamp(v, 0.2, 0.8), 6)).alias("clamped")
    )


@query("""SELECT doc_id AS id, md5('passage: ' || substr(text, 1, 512)) AS passage FROM documents""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.md5(V.passage(F.col("body"))).alias("passage"))


@query("""WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT conv_id, turn, regexp_extract_all(lower(a), '[\\p{L}\\p{N}_]+') AS a, regexp_extract_all(lower(b), '[\\p{L}\\p{N}_]+') AS b FROM t WHERE b IS NOT NULL),
x AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(a) AS g FROM w) GROUP BY ALL), y AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(b) AS g FROM w) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(x.c, y.c)) AS o FROM x JOIN y USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) END, 6)::DOUBLE AS rouge1 FROM w LEFT JOIN o USING (conv_id, turn)""")
def rouge_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("answer").isNotNull())
    return pairs.select("conv_id", "turn", F.round(M.rouge(F.col("text"), F.col("answer"))["rouge1"], 6).alias("rouge1"))


# -- replies and relations ----------------------------------------------------------


@query(f"""WITH r AS (SELECT event_id, event_id % 4 AS k, event_id % 3 AS n FROM events)
SELECT event_id, CASE WHEN k = 0 THEN {_q(C.EMPTY_ANSWER)} WHEN k = 1 THEN {_q(C.INSUFFICIENT)} ELSE 'ответ' END AS answer, (CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS n_citations,
round(least(CASE n WHEN 0 THEN 0.35 WHEN 1 THEN 0.65 ELSE 1.0 END, CASE WHEN k = 1 THEN 0.35 ELSE 1.0 END, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0.9 END), 6)::DOUBLE AS confidence FROM r""")
def answers_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "  ").when(i % 4 == 1, C.INSUFFICIENT).otherwise(" ответ ")
    one = lambda number: '{"article_id":"x","codex_prefix":"labor","number":"' + number + '"}'
    cites = F.when(i % 3 == 0, "[]").when(i % 3 == 1, f"[{one('1')},{one('1')}]").otherwise(f"[{one('1')},{one('2')},{one('1')}]")
    confidence = F.when(i % 5 == 0, '"none"').otherwise("0.9")
    raw = F.concat(F.lit('{"answer":"'), text, F.lit('","citations":'), cites, F.lit(',"confidence":'), confidence, F.lit("}"))
    n = table(spark, sf_dir, "events").select("event_id", payload.answer(raw).alias("a"))
    return n.select("event_id", "a.answer", F.size("a.citations").cast("long").alias("n_citations"), F.round("a.confidence", 6).alias("confidence"))


@query("""SELECT doc_id AS id, 'w' || (doc_id % 5) AS ru, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'k' END AS kz, CASE WHEN doc_id % 2 = 0 THEN 'list' ELSE 'object' END AS layout FROM documents""")
def keyword_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    lists = F.concat(F.lit('{"ru":["w'), i % 5, F.lit('"],"kz":['), F.when(i % 3 == 0, "").otherwise('"k"'), F.lit("]}"))
    raw = F.when(i % 2 == 0, F.concat(F.lit('[["a'), i, F.lit('",'), lists, F.lit('],["lone"]]'))).otherwise(F.concat(F.lit('{"a'), i, F.lit('":'), lists, F.lit("}")))
    made = documents(spark, sf_dir).select("id", F.when(i % 2 == 0, "list").otherwise("object").alias("layout"), payload.keyword_file(raw).alias("m"))
    held = made.withColumn("v", F.try_element_at("m", F.concat(F.lit("a"), i)))
    return held.select("id", F.get("v.ru", F.lit(0)).alias("ru"), F.get("v.kz", F.lit(0)).alias("kz"), "layout")


@query("""WITH r AS (SELECT doc_id AS id, doc_id % 6 AS k FROM documents)
SELECT id, (CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS complete, CASE k WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS valid, CASE WHEN k IN (4, 5) THEN 'internal,' WHEN k = 0 THEN 'external' WHEN k = 1 THEN '' WHEN k = 2 THEN 'other,' ELSE ',' END AS ref_types FROM r""")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 6
    meta = lambda ref: F.struct(F.lit(None).cast("string").alias("source_kz"), F.lit(None).cast("string").alias("target_kz"), ref.cast("string").alias("ref_type"), F.lit("t").alias("target_label"))
    relation = lambda kind, target, ref: F.struct(F.lit("a").alias("source_id"), target.cast("string").alias("target_id"), kind.cast("string").alias("type"), F.lit("e").alias("evidence"), meta(ref).alias("metadata"))
    first = relation(F.when(k == 1, "EXTENDS").when(k == 3, "WRONG").otherwise("REFERENCES"), F.lit("b"), F.when(k == 0, "external").when(k == 2, "other").otherwise("internal"))
    second = relation(F.lit("EXTENDS"), F.when(k > 1, "b").when(k == 1, ""), F.lit("external"))
    kept = documents(spark, sf_dir).select("id", payload.complete_relations(F.array(first, second)).alias("r"))
    refs = F.transform(payload.cleaned_relations(F.col("r")), lambda x: F.coalesce(x["metadata"]["ref_type"], F.lit("")))
    return kept.select("id", F.size("r").cast("long").alias("complete"), payload.valid_relations(F.col("r")).alias("valid"), F.array_join(refs, ",").alias("ref_types"))


@query("""WITH p AS (SELECT doc_id AS id, unnest(generate_series(0, 2)) AS pos FROM documents WHERE doc_id % 4 <> 0)
SELECT id, pos, CASE WHEN pos < id % 3 + 1 THEN 'r' || pos END AS text_ru, CASE WHEN pos < 3 - id % 3 THEN 'k' || pos END AS text_kz FROM p WHERE pos < greatest(id % 3 + 1, 3 - id % 3)""")
def keywords_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    run = lambda prefix, n: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.concat(F.lit(prefix), j.cast("string")))
    listed = d.where(i % 4 != 0).select("id", run("r", (i % 3 + 1).cast("int")).alias("ru"), run("k", (3 - i % 3).cast("int")).alias("kz"))
    return A.attach_keywords(d, listed, "id").select("id", F.col("pos").cast("long").alias("pos"), "text_ru", "text_kz")


@query("""WITH s AS (SELECT doc_id * 2 AS article_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'w' || (doc_id % 30) END AS ru, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'k' || (doc_id % 30) END AS kz FROM documents),
r AS (SELECT DISTINCT article_id, coalesce(ru, kz) AS text_ru FROM s WHERE coalesce(ru, kz) IS NOT NULL) SELECT r.article_id, r.text_ru, d.doc_id IS NOT NULL AS known FROM r LEFT JOIN documents d ON d.doc_id = r.article_id""")
def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    word = lambda prefix: F.concat(F.lit(prefix), (i % 30).cast("string"))
    given = d.select((i * 2).alias("article_id"), F.when(i % 5 != 0, word("w")).alias("text_ru"), F.when(i % 7 != 0, word("k")).alias("text_kz"))
    linked, lost = G.keyword_links(d, given)
    return linked.withColumn("known", F.lit(True)).unionByName(lost.distinct().withColumn("known", F.lit(False)))


@query("""WITH old AS (SELECT DISTINCT 'w' || (doc_id % 40) AS t, 'old' AS kz FROM documents WHERE doc_id % 3 = 0),
new AS (SELECT coalesce(ru, kz) AS t, min(kz) AS kz FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'w' || (doc_id % 60) END AS ru, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'k' || (doc_id % 80) END AS kz FROM documents) WHERE coalesce(ru, kz) IS NOT NULL GROUP BY coalesce(ru, kz))
SELECT t AS text_ru, kz AS text_kz FROM old UNION ALL SELECT t, kz FROM new WHERE t NOT IN (SELECT t FROM old)""")
def keyword_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    word = lambda prefix, n: F.concat(F.lit(prefix), (i % n).cast("string"))
    old = d.where(i % 3 == 0).select(word("w", 40).alias("text_ru"), F.lit("old").alias("text_kz")).distinct()
    new = d.select(F.when(i % 4 != 0, word("w", 60)).alias("text_ru"), F.when(i % 6 != 0, word("k", 80)).alias("text_kz"))
    return G.upsert_keywords(old, new)


@query("""WITH r AS (SELECT 'w' || (doc_id % 50) AS keyword_ru, 'd' || (doc_id % 3) AS definition_ru, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END || lpad(doc_id::VARCHAR, 9, '0') AS source_file FROM documents)
SELECT keyword_ru, definition_ru, min(source_file) AS source_file FROM r GROUP BY keyword_ru, definition_ru""")
def definition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    rows = lambda side, prefix: d.where(i % 2 == side).select(
        F.concat(F.lit("w"), (i % 50).cast("string")).alias("keyword_ru"), F.concat(F.lit("d"), (i % 3).cast("string")).alias("definition_ru"),
        F.concat(F.lit(prefix), F.lpad(i.cast("string"), 9, "0")).alias("source_file"),
    )
    return G.upsert_definitions(rows(0, "a"), rows(1, "b"))


@query("""WITH p AS (SELECT doc_id AS id, unnest(['a', 'B', 'c']) AS term, unnest([0.5, 0.9, 0.2]) AS r, unnest([0.3, 0.95, 0.0]) AS k FROM documents), f AS (SELECT id, lower(term) AS term, r, k * (id % 2) AS k FROM p)
SELECT id, term, round(CASE WHEN r > 0 AND k > 0 THEN least(greatest(r, k) * 1.25, 1.0) ELSE greatest(r, k) END, 6)::DOUBLE AS score FROM f""")
def cross_lingual_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id")
    rows = lambda lang, terms: d.select("id", F.lit(lang).alias("lang"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(s).alias("score")) for t, s in terms])).alias("x")).select("id", "lang", "x.term", "x.score")
    ru, kz = rows("ru", [("a", 0.5), ("B", 0.9), ("c", 0.2)]), rows("kz", [("A", 0.3), ("b", 0.95), ("c", 0.0)]).where(F.col("id") % 2 == 1)
    return K.cross_lingual(ru.unionByName(kz), "id").withColumn("score", F.round("score", 6))


@query(f"""WITH q AS (SELECT item_id AS qid, item_id % 3 AS k FROM benchmark), c AS (SELECT qid, CASE WHEN k = 0 THEN repeat('x', 19990) ELSE 'chunk' END AS chunk, k FROM q),
b AS (SELECT qid, k, chunk, {_sql_text(C.DEFINITIONS_TITLE)} || CASE WHEN k = 1 THEN '' ELSE chr(10) || '• w: one' || chr(10) || '• w: two' END AS block FROM c)
SELECT qid, md5(CASE WHEN length(chunk) + 2 + length(block) <= 20000 THEN chunk || chr(10) || chr(10) || block ELSE chunk END) AS context FROM b""")
def definition_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    chunk = F.when(F.col("qid") % 3 == 0, F.repeat(F.lit("x"), F.lit(19990))).otherwise("chunk")
    packed = q.select("qid", F.lit(1).alias("rank"), chunk.alias("chunk")).withColumn("used", F.length("chunk") + 2)
    found = q.select("qid", F.lit(0).alias("kw"), F.lit("w").alias("text"), F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(t).alias("t")) for n, t in ((1, " one "), (2, "two"), (3, " "))])).alias("x"))
    found = found.select("qid", "kw", "text", "x.rank", F.when(F.col("qid") % 3 == 1, "").otherwise(F.col("x.t")).alias("definition_ru"))
    return T.context(packed, found).select("qid", F.md5("context_text").alias("context"))


# -- sources, sinks and reports -------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT source AS code, CASE WHEN page.page_id % 3 = 0 THEN 'ru' WHEN page.page_id % 3 = 1 THEN 'kz' ELSE 'unknown' END AS lang FROM (SELECT page_id, 'c' || (page_id % 40) AS source FROM pages) page),
b AS (SELECT code FROM n WHERE lang IN ('ru', 'kz') GROUP BY code HAVING count(DISTINCT lang) = 2)
SELECT code, 'pair' AS kind FROM b UNION ALL SELECT DISTINCT code, 'single' FROM n WHERE code NOT IN (SELECT code FROM b)""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    end = F.when(i % 3 == 0, "_ru.json").when(i % 3 == 1, "_kz.json").otherwise(".json")
    named = files._name(table(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), (i % 5).cast("string"), F.lit("/c"), (i % 40).cast("string"), end).alias("path")))
    both, alone = files.pairs(named)
    return both.withColumn("kind", F.lit("pair")).unionByName(alone.select("code").distinct().withColumn("kind", F.lit("single")))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'both' WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS kind FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    parts = files.common(d.where("id % 3 = 0"), d.where("id % 2 = 0"), "id")
    named = [part.withColumn("kind", F.lit(name)) for part, name in zip(parts, ("both", "first", "second"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path, d = f"{folder(spark)}/done-{uuid.uuid4().hex}", documents(spark, sf_dir).select("id")
    files.append(d.where("id % 6 = 0"), path)
    files.append(d.where("id % 6 = 3"), path)
    return files.remaining(d, spark, path, "id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS inner_value FROM events")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    i, path = F.col("event_id"), f"{folder(spark)}/json-{uuid.uuid4().hex}"
    inner = F.struct(F.array(F.when(i % 3 == 0, float("inf")).otherwise(F.col("value"))).alias("x"))
    out = table(spark, sf_dir, "events").select("event_id", F.when(i % 4 == 0, float("nan")).otherwise(F.col("value")).alias("value"), inner.alias("s"))
    files.write(out, path, "json")
    return spark.read.schema(out.schema).json(path).select("event_id", "value", F.col("s.x")[0].alias("inner_value"))


@query("SELECT doc_id AS id, md5(text) AS text FROM documents WHERE doc_id % 5 IN (0, 2)")
def json_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as files of lists and read again."""
    import uuid

    path = f"{folder(spark)}/articles-{uuid.uuid4().hex}"
    d = documents(spark, sf_dir).where("id % 5 in (0, 2)")
    one = F.to_json(F.array(F.struct(F.col("id").cast("string").alias("id"), F.col("body").alias("context"))))
    lists = d.select(F.concat(F.lit("["), F.substr(one, F.lit(2))).alias("value"))
    lists.write.option("lineSep", "\n").text(path)
    raw = spark.read.text(path).select(F.from_json("value", f"array<{files.ARTICLE.simpleString()}>").alias("a"))
    return raw.select(F.explode("a").alias("a")).select(F.col("a.id").cast("long").alias("id"), F.md5("a.context").alias("text"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return V.embed_missing(documents(spark, sf_dir), done, "id", "body", V.hashed_embedder(8)).select("id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)")
def chosen_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return R.chosen_cases(table(spark, sf_dir, "labels"), ids, "doc_id")


@query(r"SELECT count(DISTINCT term) AS terms FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents)")
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vocabulary(I.build(documents(spark, sf_dir), "id", "codex", X.words(F.col("body"))).postings)


@query("""WITH a AS (SELECT source, doc_id // 2 AS n FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, doc_id // 3 AS n FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT DISTINCT source, n FROM b), m AS (SELECT coalesce(a.source, l.source) AS codex, CASE WHEN a.n IS NULL THEN 'kz_only' WHEN l.n IS NULL THEN 'ru_only' ELSE 'both' END AS source FROM a FULL JOIN l ON a.source = l.source AND a.n = l.n)
SELECT codex, count(*) FILTER (source = 'both') AS "both", count(*) FILTER (source = 'ru_only') AS ru_only, count(*) FILTER (source = 'kz_only') AS kz_only, count(*) AS merged FROM m GROUP BY codex""")
def merge_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    side = lambda k: d.where(i % k == 0).select("codex", F.floor(i / k).cast("long").alias("number"), "id", i.alias("pos"))
    return R.merge_summary(A.merge_languages(side(2), side(3), "number", [], ["codex"]), "codex")


@query("""WITH r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'ok' END AS status, page_id % 50 AS a FROM pages)
SELECT status, count(*) AS files, coalesce(sum(CASE WHEN status <> 'failed' THEN a END), 0)::BIGINT AS articles, coalesce(sum(CASE WHEN status = 'ok' THEN a * 2 END), 0)::BIGINT AS keywords, coalesce(sum(CASE WHEN status = 'ok' THEN a * 3 END), 0)::BIGINT AS relations FROM r GROUP BY status""")
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    status = F.when(i % 5 == 0, "skipped").when(i % 5 == 1, "failed").otherwise("ok")
    r = table(spark, sf_dir, "pages").select(F.col("url").alias("code"), status.alias("status"), (i % 50).alias("a"))
    ok = F.col("status") == "ok"
    return R.run_summary(r.select("code", "status", F.when(F.col("status") != "failed", F.col("a")).alias("articles"), F.when(ok, F.col("a") * 2).alias("keywords"), F.when(ok, F.col("a") * 3).alias("relations")))


@query(f"""WITH RECURSIVE d AS (SELECT source AS codex, doc_id AS id, length(text) AS chars, length(text) + 120 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT codex, id, n, chars, 0::BIGINT AS batch, 1 AS items, cost AS total FROM d WHERE n = 1 UNION ALL
SELECT d.codex, d.id, d.n, d.chars, CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN 1 ELSE r.items + 1 END,
CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN d.cost ELSE r.total + d.cost END FROM r JOIN d ON d.codex = r.codex AND d.n = r.n + 1)
SELECT codex, batch, count(*) AS articles, sum(chars)::BIGINT AS chars, count(*) * {C.SETTINGS.dry_run_tokens_per_article} + {C.SETTINGS.dry_run_tokens_base} AS tokens,
count(*) * {C.SETTINGS.dry_run_tokens_per_article} + {C.SETTINGS.dry_run_tokens_base} > {C.SETTINGS.dry_run_tokens_warn} AS too_long FROM r GROUP BY codex, batch""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("cost", A.batch_cost(F.col("body")))
    batches = A.greedy_batches(d, "codex", "id", "cost").join(d.select("codex", "id", F.length("body").cast("long").alias("chars")), ["codex", "id"])
    return R.dry_run(batches, "codex", "chars").withColumn("tokens", F.col("tokens").cast("long"))


@query("SELECT source AS parent_label, lang AS label, count(*) AS n FROM documents GROUP BY source, lang")
def rows_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_kind(documents(spark, sf_dir).select(F.col("codex").alias("parent_label"), F.col("lang").alias("label")), "parent_label", "label")


@query("""WITH k AS (SELECT doc_id AS id, 3 - doc_id % 4 AS n FROM documents) SELECT id, CASE WHEN n < 1 THEN '' ELSE array_to_string([('t' || x) FOR x IN generate_series(1, n)], ',') END AS keywords,
greatest(n, 0)::BIGINT AS n_scored, CASE WHEN id % 2 = 0 THEN 'b' ELSE '' END AS bm25, CASE WHEN id % 3 = 0 THEN 'p' ELSE '' END AS phrases FROM k""")
def keyword_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir).select("id"), F.col("id")
    three = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")
    fused = d.select("id", three).where(F.col("rank") <= 3 - i % 4).select("id", F.concat(F.lit("t"), F.col("rank").cast("string")).alias("term"), (1.0 / F.col("rank")).alias("score"), "rank")
    one = lambda rows, term: rows.select("id", F.lit(term).alias("term"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    made = R.keyword_records(d, fused, one(d.where(i % 2 == 0), "b"), one(d.where(i % 3 == 0), "p"), "id")
    return made.select("id", F.array_join("keywords", ",").alias("keywords"), F.size("keywords_scored").cast("long").alias("n_scored"), F.array_join("keywords_bm25", ",").alias("bm25"), F.array_join("keywords_keybert", ",").alias("phrases"))


_RENDER = f"""'### ARTICLE' || chr(10) || 'id: ' || doc_id || chr(10) || 'number: ' || (doc_id % 9) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'title_ru: T' || chr(10) ELSE '' END || 'text_ru:' || chr(10) || substr(text, 1, 50) || chr(10)
 || CASE doc_id % 3 WHEN 0 THEN 'text_kz:' || chr(10) || 'kz' || chr(10) WHEN 1 THEN {_q(C.MISSING_KZ)} || chr(10) ELSE '' END"""


@query(f"SELECT doc_id AS id, md5({_RENDER}) AS shown FROM documents")
def rendered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, blank = F.col("id"), F.lit("")
    title = F.when(i % 2 == 0, "T").otherwise("")
    shown = A.render(i.cast("string"), (i % 9).cast("string"), title, blank, F.substring("body", 1, 50), F.when(i % 3 == 0, "kz").otherwise(""), F.when(i % 3 == 1, "0").otherwise("1"))
    return documents(spark, sf_dir).select("id", F.md5(shown).alias("shown"))


# -- questions to answers, with the offline stand-ins for models ------------------------

_ASKED = r"""asked AS (SELECT qid, term, length(term) AS n, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) - 1 AS kw
  FROM (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) WHERE length(term) > 3),
"""


@query("WITH " + _ASKED.rstrip(",\n") + """ SELECT item_id AS qid, coalesce(k.n > 0, false) AS is_legal_question, coalesce(keywords, trim(substr(text, 1, 80))) AS keywords, round(coalesce(k.w, 1.0), 6)::DOUBLE AS weight
FROM benchmark LEFT JOIN (SELECT qid, count(*) AS n, string_agg(term, '|' ORDER BY kw) AS keywords, sum(1 - 0.1 * kw) AS w FROM asked WHERE kw < 6 GROUP BY qid) k ON k.qid = item_id""")
def intent_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.analyse(questions(spark, sf_dir).withColumnRenamed("text", "question"))
    weight = F.aggregate("intent.keywords", F.lit(0.0), lambda s, k: s + k["weight"])
    return found.select("qid", "intent.is_legal_question", F.array_join(F.transform("intent.keywords", lambda k: k["text"]), "|").alias("keywords"), F.round(weight, 6).alias("weight"))


@query(_BASE.replace("kws AS (SELECT qid, kw, term, round(greatest(0.1, 1.0 - 0.15 * kw), 6)::DOUBLE AS weight FROM known WHERE kw < 5)", _ASKED + "kws AS (SELECT qid, kw, term, round(1 - 0.1 * kw, 2)::DOUBLE AS weight FROM asked WHERE kw < 6)")
       + _HITS + _EDGES + _RANKED + _PACKED + """n AS (SELECT qid, count(*) AS n FROM packed GROUP BY qid)
SELECT b.item_id AS qid, least(coalesce(n, 0), 3)::BIGINT AS n_citations, (CASE WHEN coalesce(n, 0) = 0 THEN 0.1 ELSE 0.6 END)::DOUBLE AS confidence, coalesce(n, 0) = 0 AS retried,
(SELECT id::VARCHAR FROM packed p WHERE p.qid = b.item_id ORDER BY rank LIMIT 1) AS first_cited FROM benchmark b LEFT JOIN n ON n.qid = b.item_id""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.answer(corpus(spark, sf_dir), questions(spark, sf_dir).withColumnRenamed("text", "question"))
    return made.select("qid", F.size("answer.citations").cast("long").alias("n_citations"), "answer.confidence", "retried", F.get("answer.citations", F.lit(0))["number"].alias("first_cited"))


@query(r"""WITH t AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(q), '[\p{L}\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(substr(a, 1, 2000)), '[\p{L}\p{N}_]+')) AS a FROM t WHERE a IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, a)) / len(q) END, 6)::DOUBLE AS relevance FROM w""")
def judged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("answer").isNotNull())
    keyed = pairs.select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("question"), "answer").withColumn("key", F.to_json("key"))
    judged = providers.judge(keyed, "key", "question", "answer")
    key = F.from_json("key", "conv_id long, turn long")
    return judged.select(key["conv_id"].alias("conv_id"), key["turn"].alias("turn"), F.round("score", 6).alias("relevance"))


@query("SELECT trim(n_name) AS keyword_ru, 'd' || n_regionkey AS definition_ru FROM nation WHERE n_nationkey % 5 <> 0")
def definition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per definition, written and read again; those without a text are rejected."""
    import uuid

    path = f"{folder(spark)}/definitions-{uuid.uuid4().hex}"
    text = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" d"), F.col("n_regionkey").cast("string")))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.col("n_name")).alias("keyword"), text.alias("definition_ru"), F.col("n_nationkey").alias("file"))
    rows.write.partitionBy("file").json(path)
    return files.definitions(spark, path)[0].select("keyword_ru", "definition_ru")


@query("SELECT doc_id AS id, 'a' || (doc_id % 3) AS text_ru, CASE WHEN doc_id % 2 = 0 THEN 'b' END AS text_kz FROM documents")
def zipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    ru, kz = F.array(F.concat(F.lit("a"), (i % 3).cast("string"))), F.when(i % 2 == 0, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return documents(spark, sf_dir).select("id", F.explode(payload.paired(ru, kz)).alias("p")).select("id", "p.text_ru", "p.text_kz")
