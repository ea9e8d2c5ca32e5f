import itertools
import math
import time

from sparkfold.llm.html_text import ASIDE, Chain, default_chain, extract, features, labelled, labelled_pages, leaf_blocks, main_text_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>ad</p> --><div class="ad">Buy this now.</div>
<article><h1>Fish &amp; chips</h1><p><b>One&nbsp;two
 three.<br><p>Four <i>f</i>ive&#33;</p><ul><li>Six</ul><div class="share"><a href="#">Tweet</a></div></article>
<aside><h3>Related</h3><p>Other things to read here.</p></aside><section id="comments"><div class="comment"><p>I like this article a lot.</p></div></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; site &middot; all.</footer></body></html>"""
TEXT = "Fish & chips\nOne two three.\nFour five!\nSix"


def test_blocks_of_a_page():
    texts = [t for t, _, _ in leaf_blocks(PAGE)]
    assert [t for t in texts if t in TEXT.split("\n")] == TEXT.split("\n") and not any("no" == t or "ad" == t for t in texts)


def test_main_text_of_a_page():
    assert main_text_of(default_chain(), PAGE) == TEXT


def test_a_page_cut_anywhere_gives_what_it_has():
    chain, whole = default_chain(), TEXT.replace("\n", " ")
    for n in range(0, len(PAGE), 7):
        text = main_text_of(chain, PAGE[:n])
        assert "<" not in text and (not text or text.split()[0] in ("Fish", "T", "Home") or whole.startswith(text[:2]))


def test_held_out_blocks():
    chain, right, n = default_chain(), 0, 0
    for page in labelled_pages(150, seed=123):
        blocks, labels = labelled(page)
        found = chain.decode(features(blocks))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        n += len(labels)
    assert right / n > 0.99


def test_viterbi_and_gradient_equal_enumeration():
    chain = Chain({"a": 1.2, "b": -0.7, "c": 0.3}, [[0.2, -0.5], [-0.1, 0.6]])
    rows = [["a"], ["b", "c"], ["b"], ["c"]]
    total = lambda y: sum(s * v for s, v in zip(chain.scores(rows), y)) + sum(chain.steps[a][b] for a, b in zip(y, y[1:]))
    paths = list(itertools.product((0, 1), repeat=4))
    assert tuple(chain.decode(rows)) == max(paths, key=total)
    z = sum(math.exp(total(y)) for y in paths)
    blocks, pairs = chain.gradient(rows, [1, 0, 0, 1])
    for i, want in enumerate((1, 0, 0, 1)):
        p = sum(math.exp(total(y)) for y in paths if y[i]) / z
        assert abs(blocks[i] - (want - p)) < 1e-9
    p = sum(math.exp(total(y)) * sum(a == 0 and b == 1 for a, b in zip(y, y[1:])) for y in paths) / z
    assert abs(pairs[0][1] - (1 - p)) < 1e-9


def test_odd_pages(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (2, "", "", 3), (2, "", "", 3), (3, "x", "just words", 4), (4, "y", "<p" * 2000, 5), (5, "z", "<a b='" * 2000, 6), (6, "w", "<article><p>" + "long words " * 50_000, 7), (7, "v", "<div>" * 3000 + "deep", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got}[1] == TEXT and all(r.text is not None for r in got)
    assert len({r.page_id: r.text for r in got}[6]) == 549_999 and extract(df.limit(0)).count() == 0


def test_elements_of_any_depth_are_closed_in_their_place():
    deep = "<div>" * 300 + "<a href=x>far</a>" + "</div>" * 300
    page = f'<div class="sidebar">{deep}<p>Still beside.</p></div><article><p>Main text here.</p></article>'
    blocks = {t: (p, n) for t, p, n in leaf_blocks(page)}
    assert "about:side" in blocks["Still beside."][0][0] and "about:side" not in blocks["Main text here."][0][0]
    assert blocks["far"][1] == 3 and blocks["Still beside."][1] == blocks["Main text here."][1] == 0
    assert "in:article" in blocks["Main text here."][0][0]


def test_paths_tell_what_all_open_elements_say():
    (text, (inside, last), linked), *_ = leaf_blocks('<div class="content"><ul><li>x</li></ul></div>')
    assert (text, linked) == ("x", 0) and inside == {"in:div", "about:content", "in:ul", "in:li"} and last == ("in:li",)


def test_unclosed_elements_make_no_page_slow():
    began = time.time()
    leaf_blocks("<p><div>" + "<span>" * 100_000 + "<h2>x</h2></em>" * 20_000)
    assert time.time() - began < 20


def test_the_pages_table_agrees_with_its_own_structure(spark):
    """Pages of the table mark their article; what lies in it, and in no part beside it, is the main text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inside = [t for t, (path, _), _ in leaf_blocks(r.html or "") if "in:article" in path and not ASIDE.intersection(path)]
        assert found[r.page_id] == "\n".join(inside)
