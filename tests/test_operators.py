import math
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import articles as A
from lexweave.operators import evaluation as E
from lexweave.operators import graph as G
from lexweave.operators import index as I
from lexweave.operators import keywords as K
from lexweave.operators import retrieval as R
from lexweave.operators import vectors as V


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# -- search -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "id long, codex string, body string", (1, "a", "tax law tax"), (2, "a", "labor law"), (3, "b", "tax"), (4, "b", None), (5, "c", "law law law labor"))


@pytest.fixture(scope="module")
def index(docs):
    return I.build(docs, "id", "codex", X.words(F.col("body"))).written()


def bm25(tf, dl, df, n=5, avgdl=2.0):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def test_bm25_scores_and_ranks(spark, index):
    q = table(spark, "qid long, kw int, term string", (1, 0, "tax"), (1, 0, "law"))
    got = rows(I.search(index, q, 10).select("id", "score", "rank"), "rank")
    want = {1: bm25(2, 3, 2) + bm25(1, 3, 3), 2: bm25(1, 2, 3), 3: bm25(1, 1, 2), 5: bm25(3, 4, 3)}
    order = sorted(want, key=lambda i: (-round(want[i], 6), i))
    assert [(i, s) for i, s, _ in got] == [(i, pytest.approx(want[i], abs=1e-6)) for i in order] and [r for *_, r in got] == [1, 2, 3, 4]
    assert len(rows(I.search(index, q, 2))) == 2 and rows(I.search(index, q.where("term = 'x'"), 2)) == []


def test_filter_falls_back_per_keyword(spark, index):
    q = table(spark, "qid long, kw int, term string", (1, 0, "tax"), (1, 1, "labor"))
    only_b = table(spark, "qid long, codex string", (1, "b"))
    assert rows(I.search(index, q, 10, only_b).select("kw", "id"), "kw", "id") == [(0, 3), (1, 2), (1, 5)]


@pytest.mark.parametrize(("weight", "limit"), [(0.725, 24), (0.1, 12), (1.0, 30), (-1.0, 5)])
def test_keyword_limit_rounds_half_to_even(spark, weight, limit):
    assert spark.range(1).select(I.keyword_limit(F.lit(weight)).alias("k")).first().k == limit


def test_tfidf_local_and_global(spark, docs):
    got = {(r.id, r.term): r.score for r in I.tfidf(docs, "id", X.words(F.col("body"))).collect()}
    assert got[1, "tax"] == pytest.approx((1 + math.log(1 + 2 / 3)) * (math.log(6 / 3) + 1))
    local = {(r.id, r.term): r.score for r in I.tfidf(docs, "id", X.words(F.col("body")), ["codex"]).collect()}
    assert local[3, "tax"] == pytest.approx((1 + math.log(2)) * (math.log(3 / 2) + 1))


def test_bm25_plus_is_positive(index):
    assert all(r.score > 0 for r in I.bm25_plus(index).collect())


# -- keywords -------------------------------------------------------------------


def test_robust_norm(spark):
    flat = table(spark, "id long, term string, score double", (1, "a", 2.0), (1, "b", 2.0))
    assert {r.score for r in K.robust_norm(flat, "id").collect()} == {0.0}
    wide = table(spark, "id long, term string, score double", *[(1, f"t{i}", float(i)) for i in range(8)], (1, "out", 1000.0))
    got = {r.term: r.score for r in K.robust_norm(wide, "id").collect()}
    assert got["out"] == 1.0 and got["t0"] == 0.0 and got["t7"] == pytest.approx(7 / 12)  # quartiles 2 and 6, clip at 12


def test_phrases_and_languages(spark):
    p = table(spark, "id long, lang string, term string, score double", (1, "ru", "A b", 0.9), (1, "kz", "a b", 0.6), (1, "kz", "long word", 0.5), (1, "kz", "word", 0.3))
    both = {r.term: r.score for r in K.cross_lingual(p, "id").collect()}
    assert both == {"a b": 1.0, "long word": 0.5, "word": 0.3}
    single = {r.term: r.score for r in K.phrase_words(K.cross_lingual(p, "id"), "id").collect()}
    assert single["word"] == pytest.approx(0.4) and single["long"] == pytest.approx(0.4) and "a" not in single


def test_fuse_with_stop_words_and_citations(spark):
    terms = table(spark, "id long, term string, score double", (1, "tax", 1.0), (1, "law", 0.5), (1, "и", 1.0), (1, "low", 0.0))
    phrases = table(spark, "id long, term string, score double", (1, "law", 1.0), (1, "stop", 1.0))
    cited = table(spark, "id long, pos int, term string", (1, 0, "статья 5"), (1, 1, "Статья 6"), (1, 2, "статья 5"), (1, 3, "law"))
    got = rows(K.fuse(terms, phrases, "id", table(spark, "term string", ("stop",)), cited, final_n=1), "rank")
    assert got == [(1, "статья 6", 1.0, 1), (1, "статья 5", 1.0, 2), (1, "law", 0.85, 3)]
    with pytest.raises(ValueError, match="add up"):
        K.fuse(terms, phrases, "id", alpha=0.5, beta=0.6)


def test_keyphrases_are_diverse(spark):
    df = table(spark, "id long, body string", (1, "налог на землю налог на воду земельный налог"), (2, None))
    got = K.keyphrases(df, "id", "body", V.hashed_embedder(), top_n=5).collect()
    assert len(got) == 5 and len({r.term for r in got}) == 5 and {r.id for r in got} == {1}


# -- graph and context --------------------------------------------------------------


def test_fusion_adds_half_of_later_keywords(spark):
    hits = table(spark, "qid long, kw int, id long, codex string, score double, rank int, weight double", (1, 0, 7, "a", 4.0, 1, 1.0), (1, 1, 7, "a", 2.0, 1, 1.0), (1, 2, 7, "a", 1.0, 1, 1.0))
    assert rows(R.fuse_keywords(hits).select("id", "score")) == [(7, 5.5)]


def test_expansion_and_decay(spark):
    seeds = table(spark, "qid long, id long, score double", (1, 1, 4.0), (1, 2, 2.0))
    edges = table(spark, "source_id long, target_id long, rel_type string", (1, 9, "EXTENDS"), (9, 2, "REFERENCES"), (1, 2, "EXTENDS"), (1, 8, "AMENDS"), (2, 7, "CAUSED_BY"), (2, 7, "BASED_ON"))
    near = G.neighbours(seeds, edges)
    assert rows(near.select("id", "edge_count", "parent_score", "rank"), "rank") == [(7, 2, 2.0, 1), (9, 2, 3.0, 2)]
    fused = table(spark, "qid long, id long, codex string, score double", (1, 1, "a", 4.0), (1, 2, "a", 2.0), (1, 7, "a", 0.5))
    assert rows(R.with_graph(fused, near).select("id", "score", "source"), "rank") == [(1, 4.0, "bm25"), (9, 2.25, "graph"), (2, 2.0, "bm25"), (7, 0.5, "bm25")]
    assert len(rows(G.neighbours(seeds, edges, 1))) == 1


@pytest.mark.parametrize(("lengths", "kept"), [((9998, 9998, 5), 2), ((19990, 100, 1), 1), ((20000,), 0), ((0, 10), 1)])
def test_packing_stops_at_the_first_that_does_not_fit(spark, lengths, kept):
    ranked = table(spark, "qid long, id long, score double, source string, rank int", *[(1, i, 1.0, "bm25", i + 1) for i in range(len(lengths))])
    chunks = table(spark, "id long, chunk string", *[(i, "x" * n) for i, n in enumerate(lengths)])
    assert len(rows(R.pack(ranked, chunks))) == kept


def test_context_and_definitions(spark):
    packed = table(spark, "qid long, rank int, chunk string, used long", (1, 2, "B", 6), (1, 1, "A", 3))
    defs = table(spark, "qid long, kw int, text string, rank int, definition_ru string", (1, 0, "k", 1, " d "), (1, 0, "k", 2, ""))
    assert rows(R.context(packed, defs)) == [(1, "A\n\nB\n\n\n--- ПРАВОВЫЕ ОПРЕДЕЛЕНИЯ ---\n• k: d", 2)]
    assert rows(R.context(packed, defs, 20)) == [(1, "A\n\nB", 2)]


def test_definition_lookup_keeps_keywords_without_definitions(spark):
    keywords = table(spark, "text_ru string, text_kz string", ("налог", "салық"), ("налог на землю", None), ("суд", None))
    defs = table(spark, "keyword_ru string, keyword_kz string, definition_ru string, definition_kz string", ("налог", "", "платёж", ""))
    q = table(spark, "qid long, kw int, text string", (1, 0, "НАЛОГ"), (2, 0, "салық"), (3, 0, "нет"))
    got = rows(G.lookup_definitions(q, keywords, defs).select("qid", "keyword", "definition_ru"), "qid", "rank")
    assert got == [(1, "налог", "платёж"), (1, "налог на землю", ""), (2, "налог", "платёж")]


def test_upserts(spark):
    rel = "source_id long, target_id long, rel_type string, evidence string, ref_type string, seq int"
    given = table(spark, rel, (1, 2, "X", "old", "internal", 1), (1, 2, "X", "new", None, 2), (1, 9, "EXTENDS", "dangling", None, 3), (1, 2, None, "null", None, 4))
    articles = table(spark, "id long", (1,), (2,))
    assert rows(G.upsert_edges(G.typed_edges(given, articles), "seq")) == [(1, 2, "REFERENCES", "new", "internal")]
    old = table(spark, "text_ru string, text_kz string", ("a", "x"))
    new = table(spark, "text_ru string, text_kz string", ("a", "y"), (None, "z"), (None, None))
    assert rows(G.upsert_keywords(old, new), "text_ru") == [("a", "x"), ("z", "z")]
    d = "keyword_ru string, keyword_kz string, definition_ru string, definition_kz string, source_file string"
    assert len(rows(G.upsert_definitions(table(spark, d, ("a", "", "1", "", "f")), table(spark, d, ("a", "k", "1", "", "g"), ("a", "", "2", "", "g"))))) == 2
    done = G.update_keyword_translations(old, table(spark, d, ("a", "", "1", "", "f"), ("b", "бб", "1", "", "f")))
    assert rows(done, "text_ru") == [("a", "x"), ("b", "бб")]
    nodes = G.upsert_nodes(table(spark, "id long, v string", (1, "old"), (2, "kept")), table(spark, "id long, v string", (1, "new")), ["id"])
    assert rows(nodes, "id") == [(1, "new"), (2, "kept")]
    linked, missing = G.keyword_links(articles, table(spark, "article_id long, text_ru string, text_kz string", (1, "a", None), (1, "a", None), (5, None, "b")))
    assert rows(linked) == [(1, "a")] and rows(missing) == [(5, "b")]


def test_hierarchy_skips_levels_and_keeps_first_parents(spark):
    schema = "id long, codex string, section_ru string, section_kz string, chapter_ru string, chapter_kz string, paragraph_ru string, paragraph_kz string"
    df = table(spark, schema, (1, "c", "S", None, "C", "Ц", None, None), (2, "c", "T", None, "C", None, "P", None), (3, "c", None, None, None, None, None, None))
    nodes, articles = G.hierarchy(df, "codex", "id")
    got = {r.name_ru: r for r in nodes.collect()}
    assert set(got) == {"S", "T", "C", "P"} and got["C"].parent_id == got["S"].id and got["C"].name_kz == "Ц" and got["P"].parent_label == "Chapter"
    assert {r.id: r.parent_label for r in articles.collect()} == {1: "Chapter", 2: "Paragraph", 3: "Code"}


# -- articles -----------------------------------------------------------------------

STATUTE = """# Трудовой кодекс

## РАЗДЕЛ 1. ОБЩИЕ

### Глава 1. Положения

#### Статья 1. Понятия

Первый абзац.

> *Сноска. Статья 1*

Второй.

### Глава 2. Ещё

Потерянный текст.

#### Статья 2-1. Цели

Текст."""


def test_parse_statute(spark):
    files = table(spark, "code string, lang string, text string", ("labor", "ru", STATUTE), ("empty", "ru", None))
    got = A.parse(files, "code", "lang", "text").orderBy("article_pos").collect()
    assert [(r.number, r.title, r.section, r.chapter, r.context) for r in got] == [
        ("1", "Статья 1. Понятия", "РАЗДЕЛ 1. ОБЩИЕ", "Глава 1. Положения", "Первый абзац.\n\nВторой."), ("2-1", "Статья 2-1. Цели", "РАЗДЕЛ 1. ОБЩИЕ", "Глава 2. Ещё", "Текст."),
    ]
    assert got[0].hierarchy == "РАЗДЕЛ 1. ОБЩИЕ / Глава 1. Положения" and len(got[0].id) == 36


def test_merge_languages(spark):
    schema = "code string, number string, id string, pos int, title string"
    ru = table(spark, schema, ("c", "1", "r1", 0, "a"), ("c", "1", "r1b", 1, "b"), ("c", "2", "r2", 2, "c"), ("c", None, "r3", 3, "d"))
    kz = table(spark, schema, ("c", "1", "k1", 0, "x"), ("c", "1", "k1b", 1, "y"), ("c", "3", "k3", 2, "z"), ("c", "", "k4", 3, "w"))
    got = rows(A.merge_languages(ru, kz, "number", ["title"], ["code"]).select("article_id", "source", "title.ru", "title.kz"), "article_id")
    assert got == [("k3", "kz_only", None, "z"), ("r1", "both", "a", "y"), ("r1b", "both", "b", "y"), ("r2", "ru_only", "c", None), ("r3", "ru_only", "d", None)]


def test_keywords_are_attached_by_place(spark):
    kw = table(spark, "id long, ru array<string>, kz array<string>", (1, ["a", "b"], ["x"]))
    assert rows(A.attach_keywords(table(spark, "id long", (1,), (2,)), kw, "id"), "pos") == [(1, 0, "a", "x"), (1, 1, "b", None)]


def greedy(costs, items, most):
    out, n, total, b = [], 0, 0, 0
    for c in costs:
        if n >= items or (n and total + c > most):
            b, n, total = b + 1, 0, 0
        n, total = n + 1, total + c
        out.append(b)
    return out


def test_greedy_batches(spark):
    rng = random.Random(1)
    costs = {g: [rng.choice([1, 50, 300, 900]) for _ in range(rng.randint(1, 60))] for g in "abc"}
    df = table(spark, "g string, i int, cost int", *[(g, i, c) for g, cs in costs.items() for i, c in enumerate(cs)])
    got = A.greedy_batches(df, "g", "i", "cost", 15, 1000)
    for g, cs in costs.items():
        assert [r.batch for r in got.where(F.col("g") == g).orderBy("i").collect()] == greedy(cs, 15, 1000)
    short = table(spark, "g string, i int, cost int", *[("a", i, 1) for i in range(16)])
    assert [r["count"] for r in A.greedy_batches(short, "g", "i", "cost").groupBy("batch").count().orderBy("batch").collect()] == [15, 1]


def test_render(spark):
    out = spark.range(1).select(A.render(*[F.lit(x) for x in ("i", "5", "t", "", "b", "", "0")]).alias("r")).first().r
    assert out.startswith("### ARTICLE\nid: i\nnumber: 5\ntitle_ru: t\ntext_ru:\nb\ntext_kz: [NOT AVAILABLE") and out.endswith("\n")


# -- vectors ------------------------------------------------------------------------


def test_nearest_in_blocks_as_brute_force(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[0.0] * 8, None]
    df = table(spark, "id long, v array<double>", *list(enumerate(vectors)))

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    queries = df.where("id % 10 = 0")
    got = {}
    for r in V.nearest(df, queries, "id", "v", 5, block=3).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.similarity))
    for q in range(0, 61, 10):
        want = sorted(((-round(cos(vectors[q], v), 6), i) for i, v in enumerate(vectors) if v is not None))[:5]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]


def test_only_missing_articles_are_embedded(spark):
    articles = table(spark, "id long, body string", (1, "a"), (2, None), (3, "c"))
    done = table(spark, "id long", (1,))
    assert {r.id for r in V.embed_missing(articles, done, "id", "body", V.hashed_embedder(4)).collect()} == {2, 3}


# -- evaluation -----------------------------------------------------------------------


def test_retrieval_metrics(spark):
    runs = table(spark, "qid long, item long, rank int", (1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4), (2, 10, 1), (2, 11, 2), (4, 1, 1))
    truth = table(spark, "qid long, item long", (1, 10), (1, 13), (2, 10), (2, 11), (3, 1))
    got = {r.qid: r for r in E.retrieval_metrics(runs, truth, (5,)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].ndcg_5 == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3))) and got[2].precision_5 == 0.4 and got[2].recall_5 == 1
    assert (got[3].precision_5, got[3].mrr, got[3].hit_5, got[3].f1_5) == (0, 0, 0, 0) and got[1].mrr == 1


def test_recall_grows_with_k_and_ndcg_is_a_share(spark):
    rng = random.Random(3)
    runs = [(q, i, r + 1) for q in range(20) for r, i in enumerate(rng.sample(range(50), 20))]
    truth = [(q, i) for q in range(20) for i in rng.sample(range(50), rng.randint(1, 9))]
    for r in E.retrieval_metrics(table(spark, "qid long, item long, rank int", *runs), table(spark, "qid long, item long", *truth), (1, 5, 10, 20)).collect():
        recalls = [r[f"recall_{k}"] for k in (1, 5, 10, 20)]
        assert recalls == sorted(recalls) and all(0 <= r[f"ndcg_{k}"] <= 1 for k in (1, 5, 10, 20))


def test_aggregates(spark):
    cases = table(spark, "m double, o double", (1.0, None), (3.0, 5.0), (float("nan"), None))
    got = {r.metric: (r["mean"], r["std"], r["n"]) for r in E.macro(cases, ["m", "o"]).collect()}
    assert got == {"m": (2.0, 1.0, 2), "o": (5.0, None, 1)}
    d = E.delta(table(spark, "metric string, mean double", ("a", 0.5), ("b", 0.504)), table(spark, "metric string, mean double", ("a", 0.4), ("b", 0.5)))
    assert {r.metric: r.verdict for r in d.collect()} == {"a": "better", "b": "same"}
    lat = E.latency(table(spark, "v double", *[(float(i),) for i in range(1, 5)]), "v").first()
    assert (lat.p50, lat.p95, lat.n) == (2.5, pytest.approx(3.85), 4)
    bands = E.confidence_bands(table(spark, "c double", (0.1,), (0.4,), (0.75,), (0.9,)), "c").first()
    assert (bands.low_pct, bands.med_pct, bands.high_pct) == (25, 25, 50)


def test_report_ignores_errors(spark):
    schema = "is_legal boolean, predicted_legal boolean, error string, retried boolean, n_citations int, bm25_count int, graph_count int, n_retrieved int"
    r = E.system_report(table(spark, schema, (True, True, None, True, 1, 3, 1, 2), (True, True, None, False, 0, 1, 0, 0), (False, False, None, False, 0, 0, 0, 0), (True, True, "x", True, 9, 9, 9, 9))).first()
    assert (r.cases_total, r.cases_legal, r.cases_offtopic, r.cases_errored) == (4, 2, 1, 1)
    assert (r.retry_rate, r.citation_rate, r.offtopic_accuracy, r.graph_enrichment_ratio, r.mean_graph_fraction) == (0.5, 0.5, 1.0, 0.2, 0.25)


def test_ngram_overlap_by_joins_as_by_expression(spark):
    from lexweave.functions.metrics import rouge_n

    df = table(spark, "id long, a string, b string", (1, "a a b", "a b c"), (2, "x", "y"), (3, "", "a"))
    for n in (1, 2):
        joined = rows(E.ngram_overlap(df, "id", X.words(F.col("a")), X.words(F.col("b")), n), "id")
        direct = rows(df.select("id", rouge_n(F.col("a"), F.col("b"), n).alias("s")).select("id", "s.*"), "id")
        assert joined == [pytest.approx(x) for x in direct]


def test_history_shows_the_last_six(spark):
    turns = table(spark, "conv_id long, turn int, question string, answer string", *[(1, i, f"q{i}", "a" * (250 + i % 2)) for i in range(8)])
    got = E.history(turns).first().history.split("\n")
    assert got[0] == "История разговора:" and got[1] == "В1: q2" and got[-2] == "В6: q7" and got[-1] == "О6: " + "a" * 250 + "…" and got[2] == "О1: " + "a" * 250
