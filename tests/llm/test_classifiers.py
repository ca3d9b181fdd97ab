import collections
import unicodedata
import zlib

import numpy as np
import pytest

from spanloom.llm import html_text, langid, quality
from spanloom.llm.labelled_pages import labelled_pages


def test_quality_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    got = quality.op2_quality(spark, where).toPandas()
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)) == got.held_out).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{where}/labels.parquet").toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_dual_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.uint32) for _ in range(80)]
    labels = np.array([float(len(set(r.tolist()) & {1, 2, 3, 4, 5, 6, 7}) > 1) for r in rows])
    ratio = quality.log_ratios(rows, labels, least=1)
    w, b = quality.dual_descent(rows, ratio, labels, rounds=400)

    def loss(w, b):
        up, n = labels.sum(), len(labels)
        total = (w @ w + b * b) / 2
        for r, y in zip(rows, labels):
            x = ratio[r] / np.linalg.norm(ratio[r])
            total += n / (2 * (up if y else n - up)) * max(0, 1 - (2 * y - 1) * (w[r] @ x + b))
        return total

    best = loss(w, b)
    for _ in range(200):
        step = rng.normal(0, 0.02, 40)
        other = w.copy()
        other[:40] += step
        assert loss(other, b + rng.normal(0, 0.02)) > best - 1e-3


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", 5), (2, None, 6), (2, None, 6), (None, "!!! $$$", 7), (3, "", 8)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 0), (None, 1), (3, 5)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.scored(docs.drop("predicted"), model).count() == 5
    with pytest.raises(ValueError):
        quality.scored(docs, model)
    assert quality.accepted(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_langid_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    got = langid.op8_langid(spark, where).toPandas().merge(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1) == got.held_out).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_langid_filter_and_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate([("alpha beta", "a"), ("gamma delta", "b"), (None, "b"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    for gram in langid.word_grams("alpha"):
        assert model.holders(gram) & 1
    out = langid.identified(spark.createDataFrame([(1, None), (1, "123 !"), (2, ""), (None, "alpha " * 3), (3, "DELTA"), (4, "ж")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "a", "b", "b" if model.default else "a"]
    assert langid.identified(docs.select("text"), langid.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("text", ["²", "½ ①", "Ⅷ", "١٢", "_", "\u0301", "一", "²a"])
def test_only_letters_make_a_language(text):
    model = langid.Model(["x"], np.zeros(langid.SLOTS, np.uint64), 0)
    assert langid.Judge(model)(text)[0] == ("x" if any(unicodedata.category(c)[0] == "L" for c in text) else "und")


def test_langid_against_exact_sets(spark):
    """Brute force: sets in place of the filter, counted text by text. The filter's counts, less what it takes to be false, decide alike."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    model = langid.train(spark.createDataFrame(rows))
    shares = {code: [r.text for r in rows if r.lang == code and r.text] for code in model.languages}
    holders = [collections.Counter(g for t in shares[code] for g in set().union(*(langid.word_grams(w) for w in langid.letter_runs(t.lower())))) for code in model.languages]
    share = lambda i, g: holders[i][g] / max(1, len(shares[model.languages[i]]))
    judge, agree, total = langid.Judge(model), 0, 0
    for r in rows:
        grams = [g for w in langid.letter_runs((r.text or "").lower()) for g in langid.word_grams(w)]
        if not grams:
            assert judge(r.text or "") == ("und", 0.0)
            continue
        exact = [sum(share(i, g) >= langid.SHARE and share(i, g) >= langid.PART * max(share(j, g) for j in range(len(holders))) for g in grams) for i in range(len(holders))]
        agree += model.languages[exact.index(max(exact))] == judge(r.text)[0]
        total += 1
    assert agree >= 0.995 * total


def test_langid_with_very_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, la, 0, 0, 0) for i, (t, la) in enumerate([("alpha beta " * 100_000, "a"), ("gamma delta", "b")] * 3)], "doc_id long, text string, lang string, _k int, _l int, _rank int")
    model = langid.train(docs)
    got = langid.identified(docs, model).collect()
    assert [r.lang_pred for r in got] == ["a", "b"] * 3 and len(got[0]) == 7
    with pytest.raises(ValueError):
        langid.identified(docs.withColumn("score", docs["_k"]), model)


def test_best_region_against_all_regions():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = rng.integers(-4, 5, rng.integers(0, 12)).astype(float).tolist()
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.fixture(scope="module")
def weights():
    return html_text.fit(labelled_pages())


def test_held_out_pages(weights):
    good = total = 0
    for page, text in labelled_pages(150, seed=99):
        a, b = html_text.extract(page, weights).split("\n"), text.split("\n")
        good += len(set(a) & set(b))
        total += len(set(a) | set(b))
    assert good / total > 0.9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<p>", ""), ("<article><p>One&amp;two&nbsp; x<br>y</p><script>z</script><p>Z &lt;b&gt; &am", "One&two x y\nZ <b> &am"),
        ("<nav><a href=/>Menu</a></nav><article><h1>T</h1><p>Some <a href=x>linked</a> words.<aside>Ad text</aside><p>More.</article><footer>foot</footer>", "T\nSome linked words.\nMore."),
        ("<body><div class=cookie-notice><p>We use them</p></div><div class='post-content'><p>Real words stand here.</p></div><div class=comments><p>first!</p></div>", "Real words stand here."),
    ],
)
def test_pages(weights, page, text):
    assert html_text.extract(page, weights) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=it's>Hello there world</p><p>More it's here</p></article>", "Hello there world\nMore it's here"),
        ("<article><p data-x='a > b' title=a\"b>Hello there world</p><p class=\"c>d\">More words</p></article>", "Hello there world\nMore words"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.</p><p>A <svg><text>label</text></svg> and <object>what it shows</object> too.</p></article>", "Let x=2 hold here.\nA label and what it shows too."),
        ("<nav><a href=/>Home</a></nav><div class='ad-hoc-networks'><h1>On such networks</h1>" + "<p>Some words of an article that go on and on.</p>" * 4 + "</div><footer>imprint</footer>", "On such networks" + "\nSome words of an article that go on and on." * 4),
        ("<article><p>First words of it all.</p><div class='cookie-notice'><p>We use them here, and so on and on and on.</p></div><p>Last words of it all.</p></article>", "First words of it all.\nLast words of it all."),
    ],
)
def test_markup_that_is_easy_to_get_wrong(weights, page, text):
    assert html_text.extract(page, weights) == text


def test_the_scan_decides(weights):
    """By brute force over all regions of a page. Of the words that go, it takes most; some would not have been cut."""
    matters = by_scan = by_cut = 0
    for page, _ in labelled_pages(60, seed=3):
        parts = html_text.blocks(page, weights)
        sums = np.concatenate([[0.0], np.cumsum([b.score for b in parts])])
        gains = sums[None, :] - sums[:, None]
        best = np.triu(gains).max()
        a, b = html_text.best_region([x.score for x in parts])
        assert abs(gains[a, b] - best) < 1e-9
        want = "\n".join(x for t in html_text.cut(parts[a:b]) if (x := " ".join(t.split())))
        assert html_text.extract(page, weights) == want
        matters += want != html_text.extract(page, weights, scan=False)
        by_scan += sum(x.words for x in parts[:a] + parts[b:])
        by_cut += sum(x.words for x in parts[a:b]) - len(want.split())
    assert matters > 5 and by_scan > 4 * by_cut
    assert all(b.score > 0 for page, _ in labelled_pages(5, seed=4) for b in html_text.blocks(page, weights) if b.words > 20)


def test_page_columns_and_long_pages(spark, weights):
    pages = spark.createDataFrame([(1, "<article>" + "<p>" + "word " * 200_000 + "</p>" * 3 + "</article>", 1), (2, "", 2)], "page_id long, html string, score int")
    got = {r.page_id: r for r in html_text.main_text(pages, weights).collect()}
    assert got[1].n_chars == 999_999 and got[1].score == 1 and got[2].text == ""
    assert html_text.main_text(pages.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        html_text.main_text(pages.withColumn("Text", pages["html"]), weights)


def test_page_frames(spark, sf_dir, weights):
    rows = [(1, None, "u"), (2, "<article><p>a b", None), (2, "<article><p>a b", None), (None, "<" * 5000, "x"), (3, "<div " * 3000, "x")]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id long, html string, url string"), weights).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out)[1:4] == [(1, "", 0), (2, "a b", 3), (2, "a b", 3)]
    got = html_text.op4_html_text(spark, sf_dir).toPandas()
    assert len(got) == 50 and (got.n_chars > 0).all() and not got.text.str.contains("track\\(|&copy;|<p>").any()


@pytest.mark.parametrize("depth", [10, 255, 5000])
def test_elements_are_followed_at_any_depth(depth):
    weights = html_text.Weights({"n:body": 4.0, "n:menu": -8.0}, -1.0, {})
    page = "<div>" * depth + "<div class='body'><p>The first words.</p><div class='menu'><p>Home</p></div><p>The last words.</p></div>" + "</div>" * depth + "<p>after</p>"
    assert html_text.extract(page, weights) == "The first words.\nThe last words."
