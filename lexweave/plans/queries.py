"""Registered queries over the provided tables, and the same in SQL.

Documents stand in for articles (source: codex), benchmark items for questions.
Scores are rounded before they are ranked, to more places than sums of rounded scores can have halves in; ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import legal, markdown, payload
from ..functions import metrics as M
from ..functions import text as X
from ..operators import articles as A
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import index as I
from ..operators import keywords as K
from ..operators import retrieval as R
from ..operators import vectors as V
from ..tables import followed, placed, written
from . import answer as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if kind == "int"})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared inputs ------------------------------------------------------------

NAME_CHARS, DEFINITION_CHARS = 60, 80


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: (id, codex, number, name, body, lang)."""
    first = F.substring(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1), 1, NAME_CHARS)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("codex"), F.col("doc_id").cast("string").alias("number"), first.alias("name"), F.col("text").alias("body"), "lang")


_indexes: dict[tuple[str, str], I.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of a folder's documents, kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = I.build(documents(spark, sf_dir), "id", "codex", X.words(F.col("body"))).written()
    return _indexes[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between documents: the next of the source, the next copy, the next of the same beginning."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    keys = (("EXTENDS", F.col("source")), ("CORRELATED_WITH", F.md5("text")), ("REFERENCES", F.substring("text", 1, 12)))
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("rel_type"), key.alias("key")) for kind, key in keys])).alias("_e")
    rows = d.select("doc_id", each).select("_e.rel_type", "_e.key", F.col("doc_id").alias("source_id"))
    return followed(rows, ["rel_type", "key"], "source_id", "target_id").where(F.col("target_id").isNotNull()).select("source_id", "target_id", "rel_type")


def definition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition per document: its first word, and its beginning."""
    word = F.regexp_extract(F.lower("text"), X.WORD, 0)
    d = table(spark, sf_dir, "documents").select(
        word.alias("keyword_ru"), F.lit("").alias("keyword_kz"), F.substring("text", 1, DEFINITION_CHARS).alias("definition_ru"), F.lit("").alias("definition_kz"), F.col("doc_id").alias("source_file")
    )
    return G.first_seen(d.where(F.col("keyword_ru") != ""), ["keyword_ru", "definition_ru"], ["source_file"])


def corpus(spark: SparkSession, sf_dir: str) -> P.Corpus:
    defs = definition_rows(spark, sf_dir)
    words = defs.select(F.col("keyword_ru").alias("text_ru")).distinct().withColumn("text_kz", F.lit(None).cast("string"))
    return P.Corpus(documents(spark, sf_dir), index(spark, sf_dir), edges(spark, sf_dir), words, defs)


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rare_keywords(index(spark, sf_dir), questions(spark, sf_dir), "qid", "text")


def codex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One codex per question; some codexes do not exist, so that the search falls back."""
    return questions(spark, sf_dir).select("qid", F.concat(F.lit("src"), (F.col("qid") % 25).cast("string")).alias("codex"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question's text."""
    d = documents(spark, sf_dir)
    hit = E.holding(d, "id", "body", questions(spark, sf_dir), "qid", "text")
    return written(hit.join(d.select("id", "codex"), "id").select("qid", F.col("id").alias("item"), "codex"), "truth")


_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
_BASE = f"""
WITH RECURSIVE toks AS (SELECT doc_id AS id, source AS codex, unnest({_TOK.format('text')}) AS term FROM documents),
lens AS (SELECT doc_id AS id, len({_TOK.format('text')}) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT term, id, codex, count(*) AS tf FROM toks GROUP BY term, id, codex),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format('text')}) AS term FROM benchmark),
known AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY df, term) - 1 AS kw FROM qt JOIN dfs USING (term)),
kws AS (SELECT qid, kw, term, round(greatest(0.1, 1.0 - 0.15 * kw), 6)::DOUBLE AS weight FROM known WHERE kw < 5),
part AS (SELECT term, id, codex, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s
  FROM post JOIN dfs USING (term) JOIN lens USING (id), stats),
"""
_WHOLE = """whole AS (SELECT qid, id, codex, round(sum(s), 6) AS score FROM qt JOIN part USING (term) GROUP BY qid, id, codex),
runs AS (SELECT * FROM (SELECT qid, id, codex, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM whole) WHERE rank <= 20),
"""
_TRUTH = "truth AS (SELECT b.item_id AS qid, d.doc_id AS item, d.source AS codex FROM benchmark b JOIN documents d ON contains(d.text, b.text)),\n"
_HITS = """scored AS (SELECT qid, kw, weight, id, codex, round(sum(s), 6) AS score FROM kws JOIN part USING (term) GROUP BY qid, kw, weight, id, codex),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, kw ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= greatest(5, round_even(20 * (0.5 + weight), 0))),
fused AS (SELECT qid, id, codex, round(sum(CASE WHEN rn = 1 THEN score * weight ELSE score * weight * 0.5 END), 9) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY kw) AS rn FROM hits) GROUP BY qid, id, codex),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM fused) WHERE rn <= 15),
"""
_EDGES = """edges AS (SELECT * FROM (
  SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b, 'EXTENDS' AS t FROM documents UNION ALL
  SELECT doc_id, lead(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id), 'CORRELATED_WITH' FROM documents UNION ALL
  SELECT doc_id, lead(doc_id) OVER (PARTITION BY substr(text, 1, 12) ORDER BY doc_id), 'REFERENCES' FROM documents) WHERE b IS NOT NULL),
ways AS (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges WHERE a <> b),
hops AS (SELECT s.qid, w.y AS id, s.id AS parent, s.score AS ps, count(*) AS e FROM seeds s JOIN ways w ON w.x = s.id
  WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.qid = s.qid AND z.id = w.y) GROUP BY s.qid, w.y, s.id, s.score),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY edge_count DESC, id) AS rank FROM
  (SELECT qid, id, sum(e)::BIGINT AS edge_count, avg(ps) AS parent_score FROM hops GROUP BY qid, id)) WHERE rank <= 120),
"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, id) AS rank FROM (
  SELECT qid, id, score, 'bm25' AS source FROM fused UNION ALL
  SELECT n.qid, n.id, round(n.parent_score * 0.75, 12), 'graph' FROM near n WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = n.qid AND f.id = n.id))),
"""
_PACKED = """chunks AS (SELECT doc_id AS id, rtrim('[' || source || ' | Статья ' || doc_id || '] ' || substr(string_split(coalesce(text, ''), chr(10))[1], 1, 60))
  || CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE chr(10) || trim(text) END AS chunk FROM documents),
packed AS (SELECT * FROM (SELECT r.*, chunk, sum(length(chunk) + 2) OVER (PARTITION BY qid ORDER BY rank) AS used FROM ranked r JOIN chunks USING (id)) WHERE used <= 20000),
"""
_DEFS = r"""alldefs AS (SELECT keyword, definition, min(doc_id) AS f FROM (SELECT regexp_extract(lower(text), '[\p{L}\p{N}_]+') AS keyword, substr(text, 1, 80) AS definition, doc_id FROM documents) WHERE keyword <> '' GROUP BY keyword, definition),
words AS (SELECT DISTINCT keyword FROM alldefs),
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.search(index(spark, sf_dir), I.question_terms(questions(spark, sf_dir), "qid", "text"), 20).withColumnRenamed("id", "item")


def _retrieved(spark: SparkSession, sf_dir: str) -> P.Retrieval:
    rows = keyword_rows(spark, sf_dir).withColumnRenamed("term", "text")
    return P.retrieve(corpus(spark, sf_dir), rows)


# -- search and retrieval -------------------------------------------------------


@query(_BASE + _WHOLE.rstrip(",\n") + " SELECT qid, id, codex, score, rank FROM runs")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("qid", F.col("item").alias("id"), "codex", "score", "rank")


@query(_BASE + """scored AS (SELECT qid, kw, weight, id, codex, round(sum(s), 6) AS score FROM kws JOIN part USING (term) GROUP BY qid, kw, weight, id, codex),
marked AS (SELECT *, codex = 'src' || (qid % 25) AS own FROM scored),
kept AS (SELECT *, max(own::INT) OVER (PARTITION BY qid, kw) AS any_own FROM marked)
SELECT qid, kw, id, codex, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, kw ORDER BY score DESC, id) AS rank FROM kept WHERE own OR any_own = 0)
WHERE rank <= greatest(5, round_even(20 * (0.5 + weight), 0))""")
def bm25_codex_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.search(index(spark, sf_dir), keyword_rows(spark, sf_dir), I.keyword_limit(F.col("weight")), codex_filter(spark, sf_dir))
    return found.select("qid", "kw", "id", "codex", "score", "rank")


@query(_BASE + _HITS.rstrip(",\n") + " SELECT qid, id, codex, score FROM fused")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = I.search(index(spark, sf_dir), keyword_rows(spark, sf_dir), I.keyword_limit(F.col("weight")))
    return R.fuse_keywords(hits).select("qid", "id", "codex", "score")


@query(_BASE + _HITS + _EDGES.rstrip(",\n") + " SELECT qid, id, edge_count, round(parent_score, 12) AS parent_score, rank FROM near")
def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).neighbours.select("qid", "id", "edge_count", F.round("parent_score", 12).alias("parent_score"), "rank")


@query(_BASE + _HITS + _EDGES + _RANKED.rstrip(",\n") + " SELECT qid, id, score, source, rank FROM ranked")
def graph_decay_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).ranked


@query(_BASE + _HITS + _EDGES + _RANKED + _PACKED.rstrip(",\n") + " SELECT qid, id, rank, used::BIGINT AS used, sha256(chunk) AS chunk_sha FROM packed")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).packed.select("qid", "id", "rank", "used", F.sha2("chunk", 256).alias("chunk_sha"))


@query(_BASE + _HITS + _EDGES + _RANKED + _PACKED.rstrip(",\n") + """
SELECT r.qid, (SELECT count(*) FROM fused f WHERE f.qid = r.qid) AS bm25_hits, (SELECT count(*) FROM near n WHERE n.qid = r.qid) AS graph_hits, count(*) AS total_candidates,
(SELECT count(*) FROM packed p WHERE p.qid = r.qid) AS included FROM ranked r GROUP BY r.qid""")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _retrieved(spark, sf_dir)
    return R.statistics(r.fused, r.neighbours, r.ranked, r.packed).select("qid", "bm25_hits", "graph_hits", "total_candidates", "included")


@query(_BASE + _DEFS + r"""asked AS (SELECT qid, kw, substr(term, 1, 3) AS text FROM kws WHERE kw < 3),
few AS (SELECT * FROM (SELECT a.*, keyword, row_number() OVER (PARTITION BY qid, kw ORDER BY keyword) AS n FROM asked a JOIN words w ON contains(lower(w.keyword), lower(a.text))) WHERE n <= 20),
found AS (SELECT DISTINCT qid, kw, text, few.keyword, coalesce(d.definition, '') AS definition_ru FROM few LEFT JOIN alldefs d ON d.keyword = few.keyword)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, kw ORDER BY keyword, definition_ru) AS rank FROM found) WHERE rank <= 5""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    asked = keyword_rows(spark, sf_dir).where(F.col("kw") < 3).select("qid", "kw", F.substring("term", 1, 3).alias("text"))
    return G.lookup_definitions(asked, c.keywords, c.definitions).select("qid", "kw", "text", "keyword", "definition_ru", "rank")


# -- keywords ---------------------------------------------------------------------

def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{C.TERM}')"


_TF = f"""
WITH held AS (SELECT doc_id AS id, source AS codex, {_terms_sql('text')} || {_terms_sql('substr(text, 1, 40)')} || {_terms_sql('substr(text, 1, 40)')} || {_terms_sql('substr(text, 1, 40)')} AS t FROM documents),
counts AS (SELECT id, codex, greatest(len(t), 1) AS dl, term, count(*) AS tf FROM (SELECT id, codex, t, unnest(t) AS term FROM held) GROUP BY id, codex, dl, term),
g AS (SELECT term, count(*) AS df FROM counts GROUP BY term), l AS (SELECT codex, term, count(*) AS df FROM counts GROUP BY codex, term),
gn AS (SELECT count(*) AS n FROM held), ln_ AS (SELECT codex, count(*) AS n FROM held GROUP BY codex),
local AS (SELECT id, term, (1 + ln(1 + tf / dl)) * (ln((ln_.n + 1) / (l.df + 1)) + 1) AS s FROM counts JOIN l USING (codex, term) JOIN ln_ USING (codex)),
global_ AS (SELECT id, term, (1 + ln(1 + tf / dl)) * (ln((gn.n + 1) / (g.df + 1)) + 1) AS s FROM counts JOIN g USING (term), gn),
blend AS (SELECT id, term, 0.6 * a.s + 0.4 * b.s AS s FROM local a JOIN global_ b USING (id, term)),
"""
_NORM = """q AS (SELECT id, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.75) AS q75, min(s) AS lo, max(s) AS mx FROM blend GROUP BY id),
c AS (SELECT id, lo, mx, CASE WHEN q75 > q25 THEN q75 + 1.5 * (q75 - q25) ELSE mx END AS clip FROM q),
sp AS (SELECT id, lo, clip, CASE WHEN least(mx, clip) = lo THEN 1.0 ELSE least(mx, clip) - lo END AS span FROM c),
norm AS (SELECT id, term, (least(s, clip) - lo) / span AS s FROM blend JOIN sp USING (id)),
"""


def _blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    title = F.regexp_extract_all(F.lower(F.substring("body", 1, 40)), F.lit(C.TERM), F.lit(0))
    tokens = F.concat(F.regexp_extract_all(F.lower("body"), F.lit(C.TERM), F.lit(0)), title, title, title)
    return I.tfidf_blend(d, "id", tokens, "codex")


@query(_TF + "top AS (SELECT id, term, round(s, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, term) AS rank FROM blend) SELECT * FROM top WHERE rank <= 10")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.top_terms(_blended(spark, sf_dir), "id", 10).select("id", "term", F.round("score", 6).alias("score"), "rank")


@query(_TF + _NORM.rstrip(",\n") + " SELECT id, count(*) AS n_terms, round(min(s), 6) AS low, round(max(s), 6) AS high, round(avg(s), 6) AS mean FROM norm GROUP BY id")
def robust_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = K.robust_norm(_blended(spark, sf_dir), "id")
    return n.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"), F.round(F.avg("score"), 6).alias("mean"))


@query(_TF + _NORM + r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
pairs AS (SELECT id, t[i] || ' ' || t[i + 1] AS term FROM (SELECT id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM w)),
ph AS (SELECT id, term, least(1.0, count(*) / 10.0) AS s FROM pairs GROUP BY id, term HAVING count(*) > 1),
wd AS (SELECT id, unnest(string_split(term, ' ')) AS term, s * 0.8 AS s FROM ph),
kb AS (SELECT id, term, max(s) AS s FROM (SELECT * FROM ph UNION ALL SELECT * FROM wd WHERE length(term) >= 3) GROUP BY id, term),
f AS (SELECT id, term, round(sum(s), 6) AS score FROM (SELECT id, term, 0.3 * s AS s FROM norm UNION ALL SELECT id, term, 0.7 * s FROM kb) GROUP BY id, term)
SELECT * FROM (SELECT id, term, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM f WHERE score > 0 AND length(term) >= 3) WHERE rank <= 25""")
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = documents(spark, sf_dir).select("id", F.explode(X.ngrams(X.words(F.col("body")), 2)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))
    phrases = pairs.where("n > 1").select("id", "term", F.least(F.lit(1.0), F.col("n") / 10.0).alias("score"))
    return K.fuse(K.robust_norm(_blended(spark, sf_dir), "id"), K.phrase_words(phrases, "id"), "id")


# -- articles ---------------------------------------------------------------------


@query("""WITH o AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place FROM documents),
p AS (SELECT *, CASE WHEN lang IN ('en', 'fr') THEN 'en-fr' ELSE 'es-de' END AS pair, place - CASE WHEN place % 10 = 0 THEN 1 ELSE 0 END AS number FROM o),
a AS (SELECT * FROM p WHERE lang IN ('en', 'es')), b AS (SELECT source, pair, number, max(doc_id) AS doc_id, max_by(text, doc_id) AS text FROM p WHERE lang IN ('fr', 'de') GROUP BY source, pair, number)
SELECT coalesce(a.source, b.source) AS codex, coalesce(a.pair, b.pair) AS pair, coalesce(a.number, b.number)::BIGINT AS number, coalesce(a.doc_id, b.doc_id) AS article_id,
CASE WHEN a.doc_id IS NULL THEN 'kz_only' WHEN b.doc_id IS NULL THEN 'ru_only' ELSE 'both' END AS source, length(a.text) AS ru_chars, length(b.text) AS kz_chars
FROM a FULL JOIN b ON a.source = b.source AND a.pair = b.pair AND a.number = b.number""")
def bilingual_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = placed(documents(spark, sf_dir).select("id", "codex", "lang", "body"), ["codex", "lang"], ["id"], "place")
    # Every tenth article has the number of the one before it, so that the last of a number wins.
    d = numbered.withColumn("number", F.col("place") - F.when(F.col("place") % 10 == 0, 1).otherwise(0))
    d = d.withColumn("pair", F.when(F.col("lang").isin("en", "fr"), "en-fr").otherwise("es-de"))
    side = lambda *x: d.where(F.col("lang").isin(*x)).select("codex", "pair", "number", "id", F.col("id").alias("pos"), F.col("body").alias("context"))
    merged = A.merge_languages(side("en", "es"), side("fr", "de"), "number", ["context"], ["codex", "pair"])
    return merged.select("codex", "pair", "number", "article_id", "source", F.length("context.ru").cast("long").alias("ru_chars"), F.length("context.kz").cast("long").alias("kz_chars"))


_KIND = "CASE WHEN line LIKE 'The %' THEN 'section' WHEN line LIKE 'Of %' THEN 'chapter' WHEN line LIKE 'In %' THEN 'paragraph' WHEN line LIKE 'T%' THEN 'article' ELSE 'content' END"
_LINES = f"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT *, {_KIND} AS kind FROM l WHERE line <> ''),
s AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN line END IGNORE NULLS) OVER w AS section, count(CASE WHEN kind = 'section' THEN 1 END) OVER w AS sn FROM k WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN line END IGNORE NULLS) OVER w AS chapter, count(CASE WHEN kind = 'chapter' THEN 1 END) OVER w AS cn FROM s WINDOW w AS (PARTITION BY id, sn ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, last_value(CASE WHEN kind = 'paragraph' THEN line END IGNORE NULLS) OVER w AS paragraph FROM c WINDOW w AS (PARTITION BY id, sn, cn ORDER BY pos ROWS UNBOUNDED PRECEDING))
"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("id", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).where(F.col("line") != "")
    kind = F.when(F.col("line").startswith("The "), "section").when(F.col("line").startswith("Of "), "chapter").when(F.col("line").startswith("In "), "paragraph").when(F.col("line").startswith("T"), "article").otherwise("content")
    return A.carry_hierarchy(rows.withColumn("kind", kind).withColumn("number", F.lit("")).withColumn("block", F.col("line")), ["id"], name=F.col("line"))


@query(_LINES + " SELECT id, pos::BIGINT AS pos, kind, md5(section) AS section, md5(chapter) AS chapter, md5(paragraph) AS paragraph FROM p")
def hierarchy_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("id", "pos", "kind", *[F.md5(c).alias(c) for c in ("section", "chapter", "paragraph")])


@query(_LINES + """, g AS (SELECT *, count(CASE WHEN kind <> 'content' THEN 1 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gn FROM p),
b AS (SELECT id, gn, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS body FROM g WHERE kind = 'content' GROUP BY id, gn)
SELECT g.id, g.pos::BIGINT AS article_pos, md5(nullif(concat_ws(' / ', g.section, g.chapter, g.paragraph), '')) AS hierarchy, md5(coalesce(b.body, '')) AS context
FROM g LEFT JOIN b ON b.id = g.id AND b.gn = g.gn WHERE g.kind = 'article'""")
def article_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment(_kinds(spark, sf_dir), ["id"]).select("id", "article_pos", F.md5("hierarchy").alias("hierarchy"), F.md5("context").alias("context"))


@query("SELECT min(doc_id) AS id, md5(text) AS content FROM documents GROUP BY text")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("content", F.md5("body"))
    return G.first_seen(d, ["content"], ["id"]).select("id", "content")


@query("SELECT source AS codex, n_chars % 50 AS slot, max(doc_id) AS id, md5(max_by(text, doc_id)) AS content FROM documents GROUP BY source, n_chars % 50")
def last_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("codex"), (F.col("n_chars") % 50).alias("slot"), F.col("doc_id").alias("id"), F.md5("text").alias("content"))
    old, new = d.where(F.col("id") % 2 == 0), d
    return G.last_wins(old.unionByName(new), ["codex", "slot"], "id")


@query("""WITH e AS (SELECT a AS source_id, b AS target_id, t, row_number() OVER () AS o FROM (
SELECT doc_id // 3 AS a, (doc_id // 3) * 7 % 1000 AS b, CASE doc_id % 3 WHEN 0 THEN 'EXTENDS' WHEN 1 THEN 'WRONG' ELSE 'REFERENCES' END AS t, doc_id FROM documents)),
d AS (SELECT doc_id // 3 AS source_id, (doc_id // 3) * 7 % 1000 AS target_id, CASE doc_id % 3 WHEN 0 THEN 'EXTENDS' ELSE 'REFERENCES' END AS rel_type, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'internal' END AS ref FROM documents)
SELECT source_id, target_id, rel_type, max(doc_id)::VARCHAR AS evidence, max_by(ref, CASE WHEN ref IS NOT NULL THEN doc_id END) AS ref_type FROM d GROUP BY source_id, target_id, rel_type""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = documents(spark, sf_dir), F.col("id")
    kind = F.when(i % 3 == 0, "EXTENDS").when(i % 3 == 1, "WRONG").otherwise("REFERENCES")
    three = F.floor(i / 3)
    given = d.select(three.alias("source_id"), ((three * 7) % 1000).alias("target_id"), kind.alias("rel_type"), i.cast("string").alias("evidence"), F.when(i % 5 == 0, "internal").alias("ref_type"), i.alias("seq"))
    return G.upsert_edges(G.typed_edges(given, d), "seq")


_PAT = ("stupid", "worthless", "disgusting", "idiot", "trash", "moron")


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT doc_id AS id, {i} AS p, unnest(regexp_extract_all(text, '(?i){p}')) AS e, generate_subscripts(regexp_extract_all(text, '(?i){p}'), 1) AS k FROM documents" for i, p in enumerate(_PAT)) + """),
f AS (SELECT id, e, min(p * 1000000 + k) AS o FROM m WHERE length(e) > 5 GROUP BY id, e), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM f)
SELECT d.doc_id AS id, coalesce(string_agg(r.e, ',' ORDER BY r.o), '') AS entities FROM documents d LEFT JOIN r ON r.id = d.doc_id AND r.n <= 5 GROUP BY d.doc_id""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.array_join(legal.entities(F.col("body"), _PAT), ",").alias("entities"))


_REF_TEXT = "'согласно статье ' || (doc_id % 40) || ', ст. ' || (doc_id % 7) || ' и статьях ' || (doc_id % 30) || '–' || (doc_id % 30 + doc_id % 15)"


@query(rf"""WITH d AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR AS number, {_REF_TEXT} AS t FROM documents),
m AS (SELECT doc_id, source, 0 AS p, unnest(regexp_extract_all(t, '(?i){C.REFERENCE_PATTERNS[0]}', 1)) AS raw, generate_subscripts(regexp_extract_all(t, '(?i){C.REFERENCE_PATTERNS[0]}', 1), 1) AS k FROM d
UNION ALL SELECT doc_id, source, 1, unnest(regexp_extract_all(t, '(?i){C.REFERENCE_PATTERNS[1]}', 1)), generate_subscripts(regexp_extract_all(t, '(?i){C.REFERENCE_PATTERNS[1]}', 1), 1) FROM d),
x AS (SELECT *, string_split_regex(raw, '[–-]') AS parts FROM m),
n AS (SELECT doc_id, source, unnest(CASE WHEN len(parts) < 2 THEN [raw] WHEN parts[2]::INT >= parts[1]::INT THEN [i::VARCHAR FOR i IN generate_series(parts[1]::INT, least(parts[2]::INT, parts[1]::INT + 9))] ELSE []::VARCHAR[] END) AS number FROM x)
SELECT DISTINCT n.doc_id AS source_id, t.doc_id AS target_id, n.number FROM n JOIN d t ON t.source = n.source AND t.number = n.number WHERE n.doc_id <> t.doc_id""")
def structural_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = F.concat(F.lit("согласно статье "), i % 40, F.lit(", ст. "), i % 7, F.lit(" и статьях "), i % 30, F.lit("–"), i % 30 + i % 15)
    d = placed(documents(spark, sf_dir).select("id", "codex", text.alias("body")), ["codex"], ["id"], "number").withColumn("number", F.col("number").cast("string"))
    return legal.reference_edges(legal.references(d, "id", "codex", "body"), d, "id", "codex", "number").select("source_id", "target_id", "number")


@query("SELECT doc_id AS id, CASE WHEN (length(text) - length(regexp_replace(text, '[äöüßÄÖÜ]', '', 'g'))) / greatest(length(text), 1) > 0.01 THEN 'de' ELSE 'other' END AS lang FROM documents")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.language(F.col("body"), "äöüßÄÖÜ", yes="de", no="other").alias("lang"))


@query("SELECT doc_id AS id, substr(sha256('article||' || source || '||' || doc_id), 1, 16) AS short_id FROM documents")
def sha_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.short_id(F.lit("article"), F.col("codex"), F.col("id")).alias("short_id"))


@query(f"""WITH h AS (SELECT doc_id AS id, sha1(unhex('{X.X500}') || encode('article|' || source || '|' || lang || '|' || doc_id)) AS d FROM documents)
SELECT id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(d, 17, 1)), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM h""")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", X.uuid5(F.lit("article"), F.col("codex"), F.col("lang"), F.col("number")).alias("uuid"))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '<[^>]+>', '', 'g'), '^#{{1,6}}\\s+', '', 'g'), '(?s)\\*{{1,3}}(.*?)\\*{{1,3}}', '\\1', 'g'), '(?s)_{{1,2}}(.*?)_{{1,2}}', '\\1', 'g'), '`(.+?)`', '\\1', 'g'), '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id AS id, md5({_STRIP.format('text')}) AS content FROM documents UNION ALL SELECT -1 - page_id, md5({_STRIP.format('html')}) FROM pages")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = documents(spark, sf_dir).select("id", F.md5(markdown.strip_markdown(F.col("body"))).alias("content"))
    return a.unionAll(table(spark, sf_dir, "pages").select(-1 - F.col("page_id"), F.md5(markdown.strip_markdown(F.col("html")))))


@query(f"""WITH RECURSIVE d AS (SELECT source AS codex, doc_id AS id, length(text) + 120 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT codex, id, n, 0::BIGINT AS batch, 1 AS items, cost AS total FROM d WHERE n = 1 UNION ALL
SELECT d.codex, d.id, d.n, CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN 1 ELSE r.items + 1 END,
CASE WHEN r.items >= 15 OR r.total + d.cost > 60000 THEN d.cost ELSE r.total + d.cost END FROM r JOIN d ON d.codex = r.codex AND d.n = r.n + 1)
SELECT codex, id, batch FROM r""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.greedy_batches(documents(spark, sf_dir).withColumn("cost", A.batch_cost(F.col("body"))), "codex", "id", "cost")


# -- vectors ----------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)
SELECT * FROM (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank FROM q, v) WHERE rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return V.nearest(v, v.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)


# -- evaluation -------------------------------------------------------------------

_METRICS = """tot AS (SELECT qid, count(DISTINCT item) AS rel FROM truth GROUP BY qid),
judged AS (SELECT r.qid, r.rank, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM {runs} r LEFT JOIN (SELECT DISTINCT qid, item FROM truth) t ON t.qid = r.qid AND t.item = r.id),
sums AS (SELECT qid, """ + ", ".join(f"coalesce(sum(CASE WHEN rank <= {k} THEN hit END), 0) AS h{k}, coalesce(sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) END), 0) AS g{k}" for k in (5, 10)) + """, min(CASE WHEN hit = 1 THEN rank END) AS f FROM judged GROUP BY qid),
j AS (SELECT tot.qid, rel, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(g5, 0) AS g5, coalesce(g10, 0) AS g10, f FROM tot LEFT JOIN sums USING (qid)),
{name} AS (SELECT qid, """ + ", ".join(
    f"round(h{k} / {k}.0, 6)::DOUBLE AS precision_{k}, round(h{k} / rel, 6) AS recall_{k}, round(CASE WHEN h{k} > 0 THEN 2 * (h{k} / {k}) * (h{k} / rel) / (h{k} / {k} + h{k} / rel) ELSE 0 END, 6) AS f1_{k}, "
    f"round(g{k} / list_sum([1 / log2(i + 1) FOR i IN generate_series(1, least(rel, {k}))]), 6) AS ndcg_{k}, CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}" for k in (5, 10)
) + ", round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr FROM j)"
_NAMES = [f"{m}_{k}" for k in (5, 10) for m in ("precision", "recall", "f1", "ndcg", "hit")] + ["mrr"]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.retrieval_metrics(_runs(spark, sf_dir), truth(spark, sf_dir)), _NAMES)


@query(_BASE + _WHOLE + _TRUTH + _METRICS.replace("{runs}", "runs").replace("{name}", "m") + " SELECT qid, " + ", ".join(n for n in _NAMES if n != "mrr" and "ndcg" not in n) + " FROM m")
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_metrics(spark, sf_dir).select("qid", *[n for n in _NAMES if n != "mrr" and "ndcg" not in n])


@query(_BASE + _WHOLE + _TRUTH + _METRICS.replace("{runs}", "runs").replace("{name}", "m") + " SELECT qid, mrr, ndcg_5, ndcg_10 FROM m")
def mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_metrics(spark, sf_dir).select("qid", "mrr", "ndcg_5", "ndcg_10")


_MACRO = ", ".join(f"('{n}', {n})" for n in _NAMES)


@query(_BASE + _WHOLE + _TRUTH + _METRICS.replace("{runs}", "runs").replace("{name}", "m") + " SELECT metric, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) END, 6) AS std, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM m" for n in _NAMES) + ") GROUP BY metric")
def macro_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.macro(_case_metrics(spark, sf_dir), _NAMES), ["mean", "std"])


@query(_BASE + _HITS + _EDGES + _RANKED + _TRUTH
       + "plain AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused),\n"
       + _METRICS.replace("{runs}", "ranked").replace("{name}", "full_m").replace("judged", "judged1").replace("tot ", "tot1 ").replace("tot.", "tot1.").replace("sums", "sums1").replace("j AS", "j1 AS").replace("FROM j)", "FROM j1)") + ",\n"
       + _METRICS.replace("{runs}", "plain").replace("{name}", "base_m").replace("judged", "judged2").replace("tot ", "tot2 ").replace("tot.", "tot2.").replace("sums", "sums2").replace("j AS", "j2 AS").replace("FROM j)", "FROM j2)")
       + ", a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, avg({n}) AS v FROM full_m" for n in _NAMES) + "), b AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, avg({n}) AS v FROM base_m" for n in _NAMES)
       + ") SELECT metric, round(a.v, 6) AS \"full\", round(b.v, 6) AS baseline, round(a.v - b.v, 6) AS delta, CASE WHEN a.v - b.v > 0.005 THEN 'better' WHEN a.v - b.v < -0.005 THEN 'worse' ELSE 'same' END AS verdict FROM a JOIN b USING (metric)")
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t = _retrieved(spark, sf_dir), truth(spark, sf_dir)
    plain = r.fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    measure = lambda runs: E.macro(_rounded(E.retrieval_metrics(runs.withColumnRenamed("id", "item"), t), _NAMES), _NAMES)
    return _rounded(E.delta(measure(r.ranked), measure(plain)), ["full", "baseline", "delta"])


@query(_BASE + _WHOLE + r"""pair AS (SELECT r.qid, regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+') AS b FROM runs r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.id WHERE r.rank = 1),
""" + ",\n".join(f"""x{n} AS (SELECT qid, g, count(*) AS c FROM (SELECT qid, array_to_string(a[i:i + {n - 1}], ' ') AS g FROM (SELECT qid, a, unnest(generate_series(1, len(a) - {n - 1})) AS i FROM pair)) GROUP BY qid, g),
y{n} AS (SELECT qid, g, count(*) AS c FROM (SELECT qid, array_to_string(b[i:i + {n - 1}], ' ') AS g FROM (SELECT qid, b, unnest(generate_series(1, len(b) - {n - 1})) AS i FROM pair)) GROUP BY qid, g),
o{n} AS (SELECT qid, sum(least(x{n}.c, y{n}.c)) AS o FROM x{n} JOIN y{n} USING (qid, g) GROUP BY qid)""" for n in (1, 2)) + " SELECT qid, " + ", ".join(
    f"round(coalesce(o{n}.o, 0) / (len(a) - {n - 1}), 6) AS p{n}, round(coalesce(o{n}.o, 0) / (len(b) - {n - 1}), 6) AS r{n}" for n in (1, 2)) + " FROM pair LEFT JOIN o1 USING (qid) LEFT JOIN o2 USING (qid)")
def rouge_1_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _runs(spark, sf_dir).where("rank = 1").select("qid", F.col("item").alias("id")).join(documents(spark, sf_dir).select("id", "body"), "id").join(questions(spark, sf_dir), "qid")
    a, b = X.words(F.col("text")), X.words(F.col("body"))
    one, two = (E.ngram_overlap(best, "qid", a, b, n).select("qid", F.round("precision", 6).alias(f"p{n}"), F.round("recall", 6).alias(f"r{n}")) for n in (1, 2))
    return one.join(two, "qid")


@query(r"""WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
w AS (SELECT conv_id, turn, [hash(x) FOR x IN regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')] AS a, [hash(x) FOR x IN regexp_extract_all(lower(b), '[\p{L}\p{N}_]+')] AS b FROM t WHERE b IS NOT NULL),
l AS (SELECT *, list_reduce([[x] FOR x IN a], lambda row, x: [greatest(row[j + 1], coalesce(list_max([row[k] + 1 FOR k IN range(1, j + 1) IF b[k] = x[1]]), 0)) FOR j IN range(0, len(b) + 1)], [0::UBIGINT FOR j IN range(0, len(b) + 1)])[len(b) + 1]::DOUBLE AS n FROM w)
SELECT conv_id, turn, round(CASE WHEN n > 0 THEN 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b)) ELSE 0 END, 6)::DOUBLE AS rouge_l FROM l""")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = c.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("answer").isNotNull())
    return pairs.select("conv_id", "turn", M.rouge_l(F.col("text"), F.col("answer")).alias("s")).select("conv_id", "turn", F.round("s.f1", 6).alias("rouge_l"))


@query(_BASE + _WHOLE + _TRUTH + """pr AS (SELECT qid, list(DISTINCT codex) AS p FROM runs WHERE rank <= 5 GROUP BY qid), ex AS (SELECT qid, list(DISTINCT codex) AS e FROM truth GROUP BY qid),
s AS (SELECT ex.qid, len(list_intersect(coalesce(p, []), e)) AS tp, len(coalesce(p, [])) AS np, len(e) AS ne FROM ex LEFT JOIN pr USING (qid))
SELECT qid, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS precision, round(tp / ne, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / ne) / (tp / np + tp / ne) ELSE 0 END, 6) AS f1 FROM s""")
def routing_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = _runs(spark, sf_dir).where("rank <= 5").groupBy("qid").agg(F.collect_set("codex").alias("p"))
    cases = truth(spark, sf_dir).groupBy("qid").agg(F.collect_set("codex").alias("e")).join(predicted, "qid", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    return _rounded(E.routing(cases, "p", "e"), ["precision", "recall", "f1"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.latency(table(spark, sf_dir, "events"), "value", ["event_type"]), ["mean", "min", "max", "p50", "p95", "p99"])


@query("""WITH e AS (SELECT event_type, value - floor(value) AS c FROM events) SELECT event_type, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std,
round(100.0 * count(*) FILTER (c < 0.4) / count(*), 6) AS low_pct, round(100.0 * count(*) FILTER (c >= 0.4 AND c < 0.75) / count(*), 6) AS med_pct, round(100.0 * count(*) FILTER (c >= 0.75) / count(*), 6) AS high_pct FROM e GROUP BY event_type""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("c", F.col("value") - F.floor("value"))
    return _rounded(E.confidence_bands(e, "c", ["event_type"]), ["mean", "std", "low_pct", "med_pct", "high_pct"])


@query("""WITH e AS (SELECT event_id, event_id % 7 <> 0 AS legal, event_id % 5 <> 0 AS pred, event_id % 11 = 0 AS err, event_id % 3 = 0 AS retried, event_id % 4 AS cites, event_id % 9 AS b, event_id % 6 AS g, event_id % 2 AS r FROM events)
SELECT count(*) AS cases_total, count(*) FILTER (NOT err AND legal) AS cases_legal, count(*) FILTER (NOT err AND NOT legal) AS cases_offtopic, count(*) FILTER (err) AS cases_errored,
round(avg(retried::INT) FILTER (NOT err AND legal), 6) AS retry_rate, round(avg((cites > 0)::INT) FILTER (NOT err AND legal), 6) AS citation_rate, round(avg((NOT pred)::INT) FILTER (NOT err AND NOT legal), 6) AS offtopic_accuracy,
round(sum(g) FILTER (NOT err AND legal) / sum(b + g) FILTER (NOT err AND legal), 6) AS graph_enrichment_ratio, round(avg(g / (b + g)) FILTER (NOT err AND legal AND r > 0 AND b + g > 0), 6) AS mean_graph_fraction FROM e""")
def system_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    cases = table(spark, sf_dir, "events").select(
        (i % 7 != 0).alias("is_legal"), (i % 5 != 0).alias("predicted_legal"), F.when(i % 11 == 0, "failed").alias("error"), (i % 3 == 0).alias("retried"),
        (i % 4).alias("n_citations"), (i % 9).alias("bm25_count"), (i % 6).alias("graph_count"), (i % 2).alias("n_retrieved"),
    )
    return _rounded(E.system_report(cases), ["retry_rate", "citation_rate", "offtopic_accuracy", "graph_enrichment_ratio", "mean_graph_fraction"])


# -- sessions and replies -----------------------------------------------------------


@query("""WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM p WHERE a IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM k WHERE back <= 6)
SELECT conv_id, md5('История разговора:' || chr(10) || string_agg('В' || place || ': ' || q || chr(10) || 'О' || place || ': ' || substr(a, 1, 250) || CASE WHEN length(a) > 250 THEN '…' ELSE '' END, chr(10) ORDER BY place)) AS history, count(*) AS turns FROM l GROUP BY conv_id""")
def session_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = c.select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer")).where(F.col("answer").isNotNull())
    kept = E.recent_turns(turns).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return E.history(turns).join(kept, "conv_id").select("conv_id", F.md5("history").alias("history"), "turns")


_WEIGHTS = ("0", "5", "-1", "0.7", "x")


@query("""WITH b AS (SELECT item_id AS qid, regexp_extract(text, '[A-Za-z]+') AS w, item_id % 5 AS k FROM benchmark)
SELECT qid, CASE WHEN k = 1 THEN 'kz' ELSE 'ru' END AS language, 'labor,tax_code' AS slugs, 2::BIGINT AS n_keywords,
CASE WHEN k IN (1, 3) THEN w ELSE CASE WHEN k = 2 THEN 'zz' ELSE w END END AS top, (CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.7 ELSE 0.5 END)::DOUBLE AS top_weight FROM b""")
def intent_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("w", F.regexp_extract("text", "[A-Za-z]+", 0)).withColumn("k", (F.col("qid") % 5).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in _WEIGHTS]), F.col("k") + 1)
    lang = F.when(F.col("k") == 1, "KZ").otherwise("english")
    raw = F.concat(F.lit('{"language":"'), lang, F.lit('","codex_slugs":["labor","Трудовой","nothing","Налоговый кодекс"],"keywords":[{"text":" '), F.col("w"), F.lit('","weight":"'), weight,
                   F.lit('"},{"text":"'), F.upper("w"), F.lit('","weight":"0.9"},{"text":"zz","weight":"0.5"},{"text":""}]}'))
    n = q.select("qid", payload.intent(raw, F.col("text")).alias("i"))
    return n.select("qid", "i.language", F.array_join("i.codex_slugs", ",").alias("slugs"), F.size("i.keywords").alias("n_keywords"), F.col("i.keywords")[0]["text"].alias("top"), F.col("i.keywords")[0]["weight"].alias("top_weight"))


@query("""WITH e AS (SELECT event_id, value - floor(value) AS c, event_id % 3 AS n, event_id % 10 = 0 AS short FROM events),
k AS (SELECT event_id, short, CASE WHEN n = 0 THEN least(c, 0.35) WHEN n = 1 THEN least(c, 0.65) ELSE c END AS c FROM e) SELECT event_id, round(CASE WHEN short THEN least(c, 0.35) ELSE c END, 6) AS confidence FROM k""")
def answer_confidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 10 == 0, C.INSUFFICIENT).otherwise("ok")
    return table(spark, sf_dir, "events").select("event_id", F.round(payload.capped_confidence(F.col("value") - F.floor("value"), i % 3, text), 6).alias("confidence"))


@query("""WITH k AS (SELECT doc_id AS id, lower(trim(w)) AS w, min(i) AS o FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) WHERE trim(w) <> '' GROUP BY doc_id, lower(trim(w))),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM k) SELECT id, md5(string_agg(w, '|' ORDER BY o)) AS keywords FROM r WHERE n <= 20 GROUP BY id""")
def keyword_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.md5(F.array_join(payload.trimmed_keywords(F.split("body", " ")), "|")).alias("keywords"))


@query("""WITH d AS (SELECT doc_id, source, split_part(text, ' ', 1) AS s, split_part(text, ' ', 2) AS c FROM documents),
sec AS (SELECT substr(sha256('section||' || source || '||' || s), 1, 16) AS id, 'Section' AS label, s AS name_ru, substr(sha256('code||' || source), 1, 16) AS parent_id, 'Code' AS parent_label, doc_id FROM d WHERE s <> ''),
ch AS (SELECT substr(sha256('chapter||' || source || '||' || c), 1, 16) AS id, 'Chapter' AS label, c AS name_ru, CASE WHEN s <> '' THEN substr(sha256('section||' || source || '||' || s), 1, 16) ELSE substr(sha256('code||' || source), 1, 16) END AS parent_id, CASE WHEN s <> '' THEN 'Section' ELSE 'Code' END AS parent_label, doc_id FROM d WHERE c <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM (SELECT * FROM sec UNION ALL SELECT * FROM ch)) SELECT id, label, name_ru, parent_id, parent_label FROM a WHERE n = 1""")
def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("id", "codex", F.split_part("body", F.lit(" "), F.lit(1)).alias("section_ru"), F.split_part("body", F.lit(" "), F.lit(2)).alias("chapter_ru"))
    blank = F.lit(None).cast("string")
    d = d.withColumns({"paragraph_ru": blank, "section_kz": blank, "chapter_kz": blank, "paragraph_kz": blank})
    return G.hierarchy(d, "codex", "id")[0].select("id", "label", "name_ru", "parent_id", "parent_label")


@query("SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(E.rate(F.col("quality") == 1), 6).alias("quality_rate"), F.round(E.rate(F.col("toxic") == 1), 6).alias("toxic_rate"))
