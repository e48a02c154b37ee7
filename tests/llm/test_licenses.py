import re

from lexweave.llm import licenses

from .conftest import same

EXTRA = [
    (500, "Released under the MIT License. Later: UNDER THE MIT\nlicense"),
    (501, "Apache-License, Version (2)"),
    (502, "cc by nc cc-by-nc CC BY  NC"),
    (503, "licensed under the GNU Lesser General Public License\nnothing"),
    (504, "This work is licensed under the GNU General Public License, version 3."),
    (505, "License reserved the rights all\nall rights\nreserved"),
    (506, "under the mit licenses"),
]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, places, found, best = words(text), [], set(), 0.0
    base = set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        mine = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += mine
        base |= {label} if mine else set()
    for line in (text or "").split("\n"):
        block = set(words(line))
        for template, label in licenses.TEMPLATES:
            t = set(words(template))
            if len(t & block) >= licenses.CONTAINMENT * len(t) - 1e-9:
                found.add(label)
                best = max(best, len(t & block) / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def test_as_all_pairs_of_blocks_and_templates(spark, documents, clashing, rows, empty):
    every = [(i, t) for i, t, _ in rows] + EXTRA
    df = spark.createDataFrame(every, "doc_id long, text string")
    got = licenses.summary(licenses.scan(df, "doc_id", "text"), "doc_id").collect()
    assert sorted((repr(r[0]), repr(tuple(r[1:]))) for r in got) == sorted((repr(i), repr(brute(t))) for i, t in every)
    assert same(licenses.scan(clashing, "doc_id", "text"), licenses.scan(documents, "doc_id", "text"))
    assert licenses.summary(licenses.scan(empty, "doc_id", "text"), "doc_id").count() == 0


def test_lower_containment_still_finds_every_block(spark):
    df = spark.createDataFrame(EXTRA, "doc_id long, text string")
    templates = (("alpha beta gamma delta epsilon", "greek"), ("all rights reserved license", "rights"))
    more = df.unionAll(spark.createDataFrame([(600, "alpha gamma epsilon zeta"), (601, "beta alpha"), (602, "epsilon delta gamma beta alpha")], "doc_id long, text string"))
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(more, "doc_id", "text", templates=templates, containment=0.6).collect()}
    assert got[600] == {"greek"} and got[601] == set() and got[602] == {"greek"} and got[505] == {"rights"}


def test_wrapped_notices(spark):
    """Every template, broken over lines of any width, between other words."""
    rows, want = [], {}
    for n, (template, label) in enumerate(licenses.TEMPLATES):
        w = template.split(" ")
        for width in range(1, len(w)):
            key = 100 * n + width
            rows.append((key, "some words before\n * " + "\n * ".join(" ".join(w[i : i + width]) for i in range(0, len(w), width)) + ",\nand after"))
            want[key] = label
    # Words all over a text are no notice.
    rows += [(9001, "all" + " of this\n" * 20 + "rights" + " are not\n" * 20 + "reserved")]
    got = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert [k for k in want if want[k] not in got[k]] == []
    assert got[9001] == set()
