import pytest

from lexweave.llm.html import content_lines, extract, extract_pages, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=1>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; sell</div>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head&amp;line</h1><p><b>First   one.<br><p>Second&nbsp;&mdash; <i>two</i>ful.</p><p>x</p>
<aside>side</aside><form><input><button>Go</button></form><table><tr><td>a<td>b</table><section class="comments"><p>I disagree with everything.</p></section></article></main>
<div id="sidebar">Links</div><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    assert extract(PAGE) == "Head&line First one. Second — twoful. x a b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<nav>only</nav>", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b</p></div>c", "a b c"),
        ("<article><p>one</p></article><p>two two two two two two two two two</p>", "one"),
        ("<body><div class=menu>m</div><div><p>" + "long text " * 30 + "</p><p>end.</p></div><div><a>l</a></div></body>", ("long text " * 30).strip() + " end."),
        ("<article><p>&lt;b&gt; &#233;&#x4e2d;</p><!-- <p>no</p> --></article>", "<b> é中"),
        ("<article><h1>cut off<p>in the mid", "cut off in the mid"),
        ("<article><svg><text>no</text></svg><p hidden>no</p><p style='display: none'>no</p>yes</article>", "yes"),
        ("<article class='post sidebar-left'><header><h1>Title</h1></header><p>Body</p><footer>f</footer></article>", "Title Body"),
        ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_smoothing_and_clusters():
    assert smooth([5.0] * 4) == pytest.approx([5.0] * 4)
    assert content_lines([0, 0, 0, 50, 60, 55, 0, 0, 0]) == [False, False, False, True, True, True, False, False, False]
    assert content_lines([]) == [] and content_lines([3.0]) == [True]


def test_table_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, n_chars int")
    got = extract_pages(df, "page_id", "url", "html")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, extract(h or ""), len(extract(h or ""))) for i, u, h in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert extract_pages(df.limit(0), "page_id", "url", "html").count() == 0


LONG, LESS = ("sixty of a hundred words " * 12).strip(), ("forty of a hundred words " * 8).strip()


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div id=content><section><p>{LONG}</p></section><section><p>{LESS}</p></section></div>", f"{LONG} {LESS}"),
        (f"<div><section><p>{LONG}</p></section><section><p>short.</p></section><section><p>{LESS}</p></section></div>", f"{LONG} short. {LESS}"),
        (f"<div><h1>Head</h1><p>{LESS}</p><ul><li>{LONG}</li><li>{LONG}</li></ul><p>End.</p></div>", f"Head {LESS} {LONG} {LONG} End."),
        (f"<div><h1>Head</h1><blockquote><p>{LONG}</p></blockquote><p>{LESS}</p></div>", f"Head {LONG} {LESS}"),
        (f"<div><h1>Head</h1><table><tr><td>{LONG}</td><td>{LONG}</td></tr></table></div>", f"Head {LONG} {LONG}"),
    ],
)
def test_all_siblings_of_a_page_without_article(body, text):
    links = "<div>" + "<p><a href=1>More</a></p>" * 4 + "</div>"
    assert extract(f"<body>{links}{body}{links}</body>") == text
    assert extract(f"<body>{body}</body>") == text


def plain_clusters(ratios, sigma, factor):
    """The definition, word by word: a Gaussian mean over five lines, and one standard deviation as threshold."""
    import math

    near = lambda i: [(math.exp(-((j - i) ** 2) / (2 * sigma**2)), ratios[j]) for j in range(len(ratios)) if abs(j - i) <= 2]
    soft = [sum(w * x for w, x in near(i)) / sum(w for w, _ in near(i)) for i in range(len(ratios))]
    if not soft:
        return []
    mean = sum(soft) / len(soft)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in soft) / len(soft))
    return [x >= min(factor * deviation, max(soft)) for x in soft]


def test_clusters_match_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        ratios = [rng.choice([0.0, rng.random() * 10, rng.random() * 200]) for _ in range(rng.randint(0, 30))]
        assert content_lines(ratios, 1.0, 1.0) == plain_clusters(ratios, 1.0, 1.0)


HEADLINE = "A headline of some words"
UNMARKED = (
    "<body><div><a href=/>Home</a></div><ul>" + "<li><a href=1>Menu</a></li>" * 6 + "</ul><div>Buy now</div><div><h1>" + HEADLINE + f"</h1><p>{LONG}</p><p>Short.</p><p>{LESS}</p></div>"
    "<div>" + "<p><a href=1>Other news</a></p>" * 5 + "</div><div>Terms and conditions</div></body>"
)


def test_clusters_decide_where_nothing_is_marked(monkeypatch):
    assert extract(UNMARKED) == f"{HEADLINE} {LONG} Short. {LESS}"
    monkeypatch.setattr("lexweave.llm.html.content_lines", lambda ratios: [True] * len(ratios))
    assert "Terms" in extract(UNMARKED)
    monkeypatch.setattr("lexweave.llm.html.content_lines", lambda ratios: [i == 0 for i in range(len(ratios))])
    assert LONG not in extract(UNMARKED)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><h1>{HEADLINE}</h1><p>{LONG}</p></div><div class="sidebar"><p>aside</p></div>', f"{HEADLINE} {LONG}"),
        (f'<div class="sidebar-page"><h1>{HEADLINE}</h1><p>{LONG}</p></div><div class="sidebar"><p>aside</p></div>', f"{HEADLINE} {LONG}"),
        (f'<div id="notice-board"><article><p>{LONG}</p></article></div>', LONG),
        (f'<article><h1>{HEADLINE}</h1><p>{LESS}</p></article><div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', f"{HEADLINE} {LESS}"),
        (f'<article><p>{LONG}</p><ul>' + "<li><a href=1>Read also</a></li>" * 4 + f"</ul><p>{LESS} <a href=2>link</a></p></article>", f"{LONG} {LESS} link"),
        (f'<article><p>{LONG}</p><p><a href=1>One link</a></p><p>{LESS}</p></article>', f"{LONG} One link {LESS}"),
        (f'<div class="cookie-notice"><p>{LESS}</p></div><article><p>{LONG}</p></article>', LONG),
        ("<article>" + "<p><a href=1>All of it is links</a></p>" * 5 + "</article>", " ".join(["All of it is links"] * 5)),
    ],
)
def test_names_are_hints_and_link_lists_go(page, text):
    assert extract(f"<body>{page}</body>") == text


def test_time_is_linear_in_lines_and_depth():
    import time

    def seconds(page):
        began = time.process_time()
        assert "end" in extract(page)
        return time.process_time() - began

    many = lambda n: "<article>" + f"<p>{LESS}</p>" * n + "<p>end</p></article>"
    deep = lambda n: "<div>" * n + f"<p>{LONG} end</p>" + "</b></div>" * n
    for page in (many, deep):
        seconds(page(500))
        assert seconds(page(16_000)) < 12 * max(0.02, seconds(page(4_000)))


def test_hints_within_hints(spark):
    page = f'<div class="page-header-wrap"><div class="promo"><p>ad</p></div><h1>{HEADLINE}</h1><p>{LONG}</p><div class="share"><span class="ad">x</span></div></div>'
    assert extract(page) == f"{HEADLINE} {LONG}"
