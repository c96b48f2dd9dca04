"""Vectors, languages, pages and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import htmltext, langid, nndescent


def test_nn_descent(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 16))
    rows = [centres[i % 30] + rng.standard_normal(16) * 0.08 for i in range(400)] + [centres[0] + rng.standard_normal(16) * 0.03 for _ in range(200)] + list(rng.standard_normal((300, 16)))
    rows += [rows[5]] * 40 + [rows[5] * 3]
    vectors = [list(map(float, r)) for r in rows]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]
    data = [(i, v) for i, v in enumerate(vectors + bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("component", F.lit(1)).withColumn("v", F.lit("x"))
    df = df.unionByName(df.where("vec_id = 7"))
    got = nndescent.link_vectors(df, leaf=64, block=50, audit_rows=2000, recall=1.0).toPandas()
    ids = [i for i in range(len(vectors))] + [7]
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = {i: int(n) for i, n in zip(ids, near.sum(axis=1))}
    out = {r.vec_id: r for r in got.itertuples()}
    assert len(got) == len(data) + 1
    assert sum(out[i].n_links for i in want) >= 0.99 * sum(want.values())
    assert all(out[i].n_links <= want[i] for i in want)
    for r in got.itertuples():
        assert r.kept == (r.vec_id == r.component_id)
        if r.vec_id >= len(vectors):
            assert r.n_links == 0 and r.component_id == r.vec_id
    assert nndescent.link_vectors(df.limit(0)).count() == 0


def test_full_lists_do_not_end_a_component(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(4):
        axis, other, third = np.linalg.qr(rng.standard_normal((24, 3)))[0].T
        # Three groups of near copies; only the first and second, and the second and third, are linked across.
        for angle in (0.0, 0.38, 0.76):
            centre = np.cos(angle) * axis + np.sin(angle) * other
            rows += [centre + rng.standard_normal(24) * 0.012 for _ in range(30)]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = near.sum(axis=1) - 1
    for options in ({}, {"recall": 1.1}):
        got = nndescent.link_vectors(df, leaf=64, block=50, **options).toPandas().sort_values("vec_id")
        assert (got.n_links.to_numpy() == want).all()
        assert (got.component_id.to_numpy() == np.repeat([0, 90, 180, 270], 90)).all()
        assert got.kept.sum() == 4


def test_components_have_no_link_just_below(spark):
    turn = lambda c: np.array([c, np.sqrt(1 - c * c)])
    a = np.array([1.0, 0.0])
    rows = {}
    # Axes of their own: 1-2 linked, 3-4 linked, 2-3 just below; 10 hangs on 11 by such a pair alone.
    for i, v in ((2, a), (3, turn(0.89995)), (1, turn(0.95) * [1, -1])):
        rows[i] = [*v, 0.0, 0.0]
    angle = np.arccos(0.89995) + np.arccos(0.95)
    rows[4] = [np.cos(angle), np.sin(angle), 0.0, 0.0]
    for i, v in ((10, turn(0.89992)), (11, a), (12, turn(0.97) * [1, -1])):
        rows[i] = [0.0, 0.0, *v]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.link_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 10: (0, 10, True), 11: (1, 11, True), 12: (1, 11, False)}


def test_different_lengths_do_not_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nndescent.link_vectors(df).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("die katze sitzt auf", "de"), (None, "en"), ("", None), ("123 !!", "en"), ("die katze sitzt", None)] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(3))
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in range(54) if i % 6 in (2, 3, 4))
    assert all(out[i].lang_pred == ("de" if i % 6 in (1, 5) else "en") for i in range(54) if i % 6 in (0, 1, 5))
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_rejected_languages_go(spark):
    rng = np.random.default_rng(1)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))
    rows = [(i, words("etaoinshr", 60), "en") for i in range(40)] + [(100 + i, words("uvwxyzäö", 60), "de") for i in range(40)]
    strange = [(200, words("бвгджз", 80), "en"), (201, words("#$%1234567890", 80), None), (202, "бв", "en"), (203, None, "en"), (204, words("etaoinshr", 5), None), (None, words("etaoinshr", 60), None)]
    df = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    out = langid.keep_told(df)
    assert out.columns == df.columns and {r.score for r in out.collect()} == {9}
    gone = {r.doc_id for r in df.collect()} - {r.doc_id for r in out.collect()}
    assert gone == {200, 201, 203}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in df.collect()} - {r.doc_id for r in langid.keep_told(unlabelled).collect()} == {201, 203}
    assert langid.keep_told(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.train(df)).where("doc_id < 40").collect()} == {"en"}


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(900)] + [(2000 + i, "gwyrdd bychan ydy hwn", "cy") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.train(df, max_train=20)) == {"cy", "en"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><div class="ad">Buy now. It is cheap, they say.</div>
<header><p>Site name and slogan.</p></header><aside>Related stories, many of them.</aside>
<article><h1>A &amp; B</h1><p>First <b>bold</b>   text,<br>with a break. It goes on, as prose does.
<p>Second paragraph&nbsp;&mdash; with an entity, and more words.</p><!-- note --><form><input><button>Send</button></form>
<div class="share-buttons">Share this</div></article>
<div id="comments"><p>Great post, thanks! I agree, really.</p></div><footer>&copy; 2024 Someone. All rights reserved.</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "A & B First bold text, with a break. It goes on, as prose does. Second paragraph — with an entity, and more words."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='x", "<!-- open", "<script>alert(1)", "plain", "<p>" * 3000, "<div class=" + '"' * 5000, "&#x110000; &#0; &bogus;"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(htmltext.main_text(page), str)


def test_plain_body_without_article():
    prose = "".join(f"<p>Sentence number {i}, which is long enough, ends here.</p>" for i in range(8))
    page = f"<body><ul><li><a href=x>Menu one</a><li><a href=y>Menu two</a></ul><div>{prose}</div><div><a href=z>next</a></div></body>"
    text = htmltext.main_text(page)
    assert text.startswith("Sentence number 0") and text.endswith("ends here.") and "Menu" not in text and "next" not in text


def test_blocks_outside_the_largest_stay():
    lead = "Lead sentence, with words of its own. " * 5
    paragraphs = [f"Paragraph {i} has words, and goes on. " * 10 for i in range(8)]
    inner = "".join(f"<p>{x}</p>" for x in paragraphs)
    page = f"<body><ul><li><a href=x>Menu one</a></ul><div><h1>Title</h1><p>{lead}<div>{inner}</div><div><a href=z>next</a></div></div></body>"
    assert htmltext.main_text(page) == " ".join(["Title", lead.strip(), *(x.strip() for x in paragraphs)])


def test_links_of_a_declared_article_stay():
    page = f"<body><article><p>{'Some prose, as it goes. ' * 9}</p><p><a href=x>The whole report, with all figures.</a></p></article><p><a href=y>next page</a></p></body>"
    assert htmltext.main_text(page).endswith("as it goes. The whole report, with all figures.")


def test_smoothing_equals_all_pairs_of_paths():
    rng = np.random.default_rng(2)
    for _ in range(30):
        paths = htmltext.Paths()
        for _ in range(rng.integers(1, 40)):
            paths.child(int(rng.integers(0, len(paths.tag))), "t" + str(rng.integers(0, 9)), False)
        n = len(paths.tag)
        values = {int(p): float(rng.random()) for p in rng.integers(0, n, 10)}

        def above(p):
            return [] if p < 0 else [*above(paths.parent[p]), p]

        got = htmltext.smooth(paths, values)
        for p in range(n):
            want = 0.0
            for q, x in values.items():
                a, b = above(p), above(q)
                same = sum(1 for i in range(min(len(a), len(b))) if a[i] == b[i])
                want += 0.5 ** (len(a) + len(b) - 2 * same) * x
            assert got[p] == pytest.approx(want)


def test_names_do_not_delete_prose():
    prose = lambda n: " ".join(f"Sentence {n} number {i}, which goes on, ends here." for i in range(6))
    page = f"""<body><nav><a href=a>Home</a></nav><article><h1>Title</h1><p>{prose('a')}</p><div class="side-effects"><p>{prose('b')}</p></div>
    <section id="social-history"><p>{prose('c')}</p></section><p><a href=x>{prose('d')}</a></p><div class="share-buttons">Share</div>
    <div class="comments"><p>{prose('e')}</p></div></article><div class="sidebar-left"><p>{prose('f')}</p></div></body>"""
    assert htmltext.main_text(page) == " ".join(["Title", *map(prose, "abcd")])
    # What holds the whole page says nothing of it.
    for whole in ("form", 'div class="page-sidebar-wrapper"', 'div id="content" class="legal"'):
        assert htmltext.main_text(f"<body><{whole}><p>{prose('a')}</p><p>{prose('b')}</p></{whole.split()[0]}></body>") == f"{prose('a')} {prose('b')}"


def test_ratios_find_the_article_without_its_tag(spark):
    """Word precision and recall on pages whose article and class names are taken away."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = wanted = got = 0
    for r in pages:
        want = htmltext.main_text(r.html).split()
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|main|footer|nav)\b", r"<\1div", r.html))
        words = htmltext.main_text(bare).split()
        from collections import Counter

        same += sum((Counter(want) & Counter(words)).values())
        wanted, got = wanted + len(want), got + len(words)
    assert same / wanted > 0.98 and same / got > 0.93, (same / wanted, same / got)


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<div><b></i>", "<p><span></div>", "<a></b>", "<li><ul>", "<td></table>"])
def test_long_nested_pages_take_seconds(unit):
    import time

    began = time.time()
    text = htmltext.main_text(f"<article><p>{'A word, and more of them. ' * 20}" + (unit + "x ") * (100_000 // unit.count("<")))
    assert "A word" in text and time.time() - began < 20


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "w", "<p>x y z.</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = htmltext.extract(df).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against what each should keep, and packed ids against the tokenizer."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(900001, None, None, "s", 0), (900002, "12 34 !!", None, "s", 8), (900003, "", "en", "s", 0)], docs.schema))
    columns, before = docs.columns, None
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != "packing":
            assert out.columns == columns
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert before is None or ids <= before
            before, docs = ids, out
        if name == "language ID":
            assert not {900001, 900002, 900003} & before
    final = {r.doc_id: r for r in docs.collect()}
    t = Tokenizer.from_file(cp.tokenizer_path())
    lengths = {}
    for r in out.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in final.items()}
    assert cp.run(spark, sf).select(F.sum("length")).first()[0] == sum(lengths.values())
