import pytest

from signbridge.llm import licences

NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2.0"],
    "mit": ["Released under the MIT License.", licences.TEMPLATES["mit"][1]],
    "gpl": ["This work is licensed under the GNU General Public License, version 3."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "bsd": [licences.TEMPLATES["bsd"][0].upper()],
    "mpl": ["# " + licences.TEMPLATES["mpl"][0]],
}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return licences.train(docs)


def test_families(spark, model):
    rows = [(i, f"Some words here.\n{text}\nand more of them", family) for i, (family, text) in enumerate((f, t) for f, ts in NOTICES.items() for t in ts)]
    rows += [(100, "The software license of the public version is under review", ""), (101, None, ""), (102, "", ""), (103, "\n\n", ""),
             (104, "You may use this file\nunder the terms", ""), (105, "word " * 50000 + "\n" + NOTICES["mit"][0], "mit"), (None, NOTICES["gpl"][0], "gpl"),
             (106, NOTICES["mit"][0] + "\n" + NOTICES["apache"][0], "apache,mit"), (106, NOTICES["mit"][0] + "\n" + NOTICES["apache"][0], "apache,mit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    out = licences.scan(docs, model).collect()
    assert sorted((str(r.doc_id), ",".join(r.families)) for r in out) == sorted((str(a), c) for a, _, c in rows)
    by = {r.doc_id: r for r in out}
    assert by[101].n_paragraphs == by[102].n_paragraphs == by[103].n_paragraphs == 0 and by[104].n_paragraphs == 2
    assert [n.line for n in by[0].notices] == [1]


def test_every_document(spark, model):
    """Against the notices that the test table holds, found by their names."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = {"Apache License": "apache", "MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc"}
    want = {r.doc_id: sorted({f for n, f in names.items() if n in r.text}) for r in docs.collect()}
    assert {r.doc_id: r.families for r in licences.scan(docs, model).collect()} == want


def test_empty_table(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(docs, model).count() == 0
    assert licences.scan(docs, licences.train(docs)).count() == 0


def test_no_python_in_the_plan(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licences.scan(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_notices_inside_long_lines(spark, model):
    """A notice counts wherever it stands in a line, however long, and beside other notices."""
    prose = "In the middle of the week the work of the people in the city was under the care of a friend of the house and all of the rest in the end may be part of the story that is told to the children in the evening under the trees at the end of the road in the light of the old lamp on the wall. "
    mit, apache = NOTICES["mit"][0], NOTICES["apache"][0]
    rows = [(0, prose * 2 + mit, "mit"), (1, prose * 20 + mit + " " + prose + apache, "apache,mit"), (2, prose * 100, ""),
            (3, prose * 40 + licences.TEMPLATES["gpl"][1] + " " + prose * 40, "gpl"), (4, mit + " " + apache, "apache,mit"),
            (5, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc")]
    assert len(rows[3][1].split()) > 5000 or len(rows[2][1].split()) > 5000
    rows += [(100 + i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    rows += [(200 + i, prose * 3 + t + " " + prose * 3, f) for i, (f, t) in enumerate((f, t) for f, ts in licences.TEMPLATES.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    got = {r.doc_id: ",".join(r.families) for r in licences.scan(docs, model).collect()}
    assert got == {i: f for i, _, f in rows}


@pytest.mark.parametrize("width, prefix", [(72, ""), (50, " * "), (30, "# ")])
def test_wrapped_notices(spark, model, width, prefix):
    """Every template is found when it is wrapped, once, in the line in which it begins; its halves in paragraphs apart are no pair."""
    import textwrap
    texts = [(f, t) for f, ts in sorted(licences.TEMPLATES.items()) for t in ts]
    wrap = lambda t: "\n".join(prefix + line for line in textwrap.wrap(t, width))
    rows = [(i, "import os\n\n" + wrap(t) + "\n\nmain = 1", f) for i, (f, t) in enumerate(texts)]
    rows += [(100, "one\ntwo of the\n\nthree under the\nfour", ""), (101, wrap(texts[0][1]) + "\n" + "word " * 9000 + "\n" + wrap(texts[-1][1]), "agpl,proprietary")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    out = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    assert {i: ",".join(r.families) for i, r in out.items()} == {i: f for i, _, f in rows}
    assert [i for i in range(len(texts)) if [n.line for n in out[i].notices] not in ([2], [3])] == []
    assert [n.line for n in out[101].notices][0] == 0


def test_windows_at_block_ends(spark, model):
    """A notice is found wherever a block of places ends in it."""
    notice = licences.TEMPLATES["mit"][1]
    rows = [(i, "word " * (licences.BLOCK - i) + notice, "mit") for i in (0, 1, 7, 15, 30, 31)]
    rows += [(1000 + i, "word " * (licences.BLOCK - i) + notice.replace("copy", "copy\n"), "mit") for i in (3, 12, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, families string")
    assert {r.doc_id: ",".join(r.families) for r in licences.scan(docs, model).collect()} == {i: f for i, _, f in rows}


def test_background_is_every_document(spark):
    """Each paragraph of each row counts once, by the grams that it has; notices, and only they, are left out."""
    grams = set(licences.vocabulary())
    kinds_of = ["in the end of the story of a man and his dog by the sea\nmore", "nothing known here\n\nsolo", "the story of the end of the sea in the end", ""]
    rows = [(i if i % 7 else None, kinds_of[i % 4]) for i in range(1000)] + [(5, NOTICES["mit"][0]), (6, None)]
    found = licences.hits(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds, plain, single, documents = licences.background(found)
    want, none, one = {}, 0, 0
    for _, text in rows:
        for line in (text or "").split("\n"):
            all_ = licences._grams(licences._plain(line))
            own = tuple(sorted(g for g in all_ if g in grams))
            one += len(licences._plain(line)) == 1
            none += bool(all_) and not own
            if own and len(set(own)) < 0.3 * len(set(all_)):
                want[own] = want.get(own, 0) + 1
    assert {tuple(sorted(r.grams)): r.n for r in kinds.collect()} == want and sum(want.values()) == 500
    assert (plain, single, documents) == (none, one, len(rows)) == (250, 500, 1002)
