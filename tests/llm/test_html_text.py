import re
import time

import pyarrow.parquet as pq
import pytest

import page_layouts

import tessera.llm.html_text as m

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x(1<2);</script></head><body>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>Head &amp; tail</h1><p><b>First
  line.<br><p>AT&amp;T &lt;b&gt; caf&eacute;&#33; <i>in</i>line<br>next</p><ul><li>Item a<li>Item b</ul>
<div class="comments"><p>I agree.</p></div></article><form><label>Mail</label><button>Go</button></form>
<footer>&copy; me &middot; All.</footer></body></html>"""


def test_blocks():
    got = [b.text for b in m.blocks(PAGE)]
    assert got == ["One", "Two", "Buy this now.", "Head & tail", "First line.", "AT&T <b> café! inline next", "Item a", "Item b", "I agree.", "Mail", "Go", "© me · All."]
    assert m.blocks("") == [] and [b.text for b in m.blocks("a < b & c <p>x")] == ["a < b & c", "x"]
    assert [b.text for b in m.blocks("<div>" * 5000 + "deep")] == ["deep"] and m.blocks("<script>never closed <p>x") == []


def test_main_text_of_a_page():
    assert m.main_text(PAGE, m.default_model()) == "Head & tail\n\nFirst line.\n\nAT&T <b> café! inline next\n\nItem a\n\nItem b"


def test_held_out_accuracy():
    right = total = 0
    for page, labels in m.labelled_pages(200, seed=99):
        own = m.blocks(page)
        y = m.default_model().viterbi(m.page_features(own))
        right += sum(a == b for a, b in zip(y, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


@pytest.mark.parametrize("name", page_layouts.LAYOUTS)
def test_layouts_that_training_never_saw(name):
    right = total = 0
    for page, labels in page_layouts.pages(name):
        own = m.blocks(page)
        y = m.default_model().viterbi(m.page_features(own))
        right += sum(a == b for a, b in zip(y, labels, strict=True))
        total += len(labels)
    assert right / total > 0.95, right / total


def test_viterbi_is_the_best_sequence():
    from itertools import product

    model = m.default_model()
    for page, labels in m.labelled_pages(40, seed=3):
        rows = m.page_features(m.blocks(page))[:9]
        e = model.emissions(rows)
        score = lambda y: model.ends[0, y[0]] + model.ends[1, y[-1]] + sum(e[i, k] for i, k in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731,B023
        assert score(model.viterbi(rows)) == pytest.approx(max(score(y) for y in product((0, 1), repeat=len(rows))))


def test_pages_table():
    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(re.sub("<[^>]*>", "", p).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        import html

        assert m.main_text(row["html"], m.default_model()) == "\n\n".join(html.unescape(p) for p in parts if p)


def test_frame(spark):
    rows = [(1, "u", PAGE, "old", 3), (1, "u", PAGE, None, None), (None, None, None, "x", 1), (2, "v", "", "x", 1), (3, "w", "<p>" + "word " * 60000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = m.extract_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", len(m.main_text(PAGE, m.default_model())))] * 2 + [("2", 0), ("3", 299999), ("None", 0)]
    assert m.extract_text(df.limit(0)).count() == 0


def test_embedded_elements_do_not_cut_a_page():
    texts = lambda page: [b.text for b in m.blocks(page)]
    for tag in ("svg", "math", "object", "canvas", "iframe", "noscript", "template", "select"):
        assert texts(f"<p>a</p><{tag}><p>b</p>") == ["a", "b"], tag
        assert texts(f"<p>a</p><{tag} class='x'/><p>b</p><{tag}></{tag}><p>c</p>") == ["a", "b", "c"], tag
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><title/><path d='M1'/><text>A</text><text>B</text></svg> end</p>") == ["So x=2 and A B end"]
    assert texts("<p>a <noscript><img src=x></noscript> b</p><noscript>c</noscript>d<select><option>e<option>f</select>") == ["a b", "c", "d", "e", "f"]
    assert texts("<template><p>x</p></template><iframe>y</iframe><iframe><p>a") == ["a"]
    assert len(m.blocks("<iframe><p>a" * 20000)) == 20000


def test_main_text_with_embedded_elements():
    page = "<html><body><noscript>Turn scripts on.</noscript><nav><a href='/'>Home</a></nav><article><h1>Sums</h1><p>As <math><mn>1</mn><mo>+</mo><mn>1</mn></math> shows, all is well.<svg/></p><object><p>A table of the sums that were made here.</p></object><p>The last of the words.</p></article><form><select><option>Ten</option><option>Two</option></select></form></body></html>"
    assert m.main_text(page, m.default_model()) == "Sums\n\nAs 1+1 shows, all is well.\n\nA table of the sums that were made here.\n\nThe last of the words."


def texts(page):
    return [b.text for b in m.blocks(page)]


def test_quotes_in_tags():
    assert texts("<p title=it's>First sentence.</p><p>It's the second.</p>") == ["First sentence.", "It's the second."]
    assert texts("<p title='a > b' class=\"x > y\">one</p><p data-x = \"it's\">two</p>") == ["one", "two"]
    assert texts('<p title="never ends>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p don't>one</p> 3 < 4 > 2 <p>two <3 you</p><!-- gone") == ["one", "3 < 4 > 2", "two <3 you"]


@pytest.mark.parametrize("page", ["<a " * 330_000, "<a " * 300_000 + ">", '<a b="' * 150_000, '<a b=">" ' * 100_000, "<" * 500_000 + ">", "<!" * 400_000, "<script></script " * 60_000, "<b>" * 50_000 + "<p>x" * 50_000 + "</b>" * 50_000,
                                  "<div><b>" * 60_000 + "</b>" * 60_000, "<div class='a b'><p>x</p>" * 40_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    m.blocks(page)
    assert time.process_time() - began < 4  # a second and less on an idle core


def test_prose_may_speak_of_copyright():
    prose = "© 2020 is a phrase that stands under most pages, and copyright is what the whole of this paragraph of an article speaks of."
    assert "rights" not in m.features(m.blocks(f"<article><p>{prose}</p></article>")[0])
    assert "rights" in m.features(m.blocks("<footer>&copy; 2020 Example Ltd</footer>")[0])
