"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. Features of a block are its
ancestors' tags, what their classes, ids and roles speak of, and the text's length, link share and
punctuation. The field is trained by stochastic gradient on the likelihood (forward-backward) over
labelled pages, and a page's blocks are labelled together by Viterbi. Labelled pages are composed
here from page parts whose label is known; no table has labels for pages.
"""

from __future__ import annotations

import html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|</?\Z", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "template", "noscript", "iframe", "noframes", "svg", "object", "canvas")}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
BLOCK_FEATURES = frozenset(f"in:{t}" for t in BLOCK)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: What words in classes, ids and roles speak of.
TOPICS = {
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adslot dfp",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap tabs",
    "side": "sidebar side aside widget widgets related recommend recommended popular trending rail more complementary",
    "foot": "footer foot contentinfo copyright legal colophon",
    "head": "header masthead topbar logo site toolbar",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall message toast warning disclaimer",
    "comment": "comment comments disqus reply replies respond discussion responses thread",
    "form": "form search login signin signup register contact feedback",
    "share": "share sharing social follow twitter facebook",
    "meta": "byline author meta date tags tag category categories published",
    "content": "content article post entry story main text body page prose",
}
TOPIC_OF = {w: t for t, words in TOPICS.items() for w in words.split()}
WORD = re.compile(r"[a-z]+")
#: Begins main text on labelled pages; an invisible character that no other page part has.
MARK = "\u2063"
#: Features of elements that usually hold no main text, and that usually do.
ASIDE = frozenset([f"about:{t}" for t in TOPICS if t not in ("content", "meta")] + [f"in:{t}" for t in ("nav", "aside", "footer", "form", "title", "button", "select")])
CORE = frozenset(["in:article", "in:main", "about:content"])


def _describe(tag: str, attributes: str) -> str:
    """An element as features: its tag, the topics of its class, id and role, and whether it is hidden."""
    found = {f"in:{tag}"}
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value and "display" in value:
            found.add("hidden")
        elif name in ("class", "id", "role"):
            found.update(f"about:{TOPIC_OF[w]}" for w in WORD.findall(value) if w in TOPIC_OF)
    return " ".join(sorted(found))


def leaf_blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, path, characters in links) of each block with text.

    A path is what the open elements say together: all their features, and those of the innermost
    block-level one. It is kept up to date as elements open, and for each tag the places of its open elements,
    so that neither depth nor unclosed elements make a page slow.
    """
    blocks: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple]] = []
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    linked = links = 0
    known: dict = {}
    paths: dict = {}
    nowhere = (frozenset(), ("in:none",))

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((text, stack[-1][1] if stack else nowhere, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(tags: set, within: set) -> None:
        """Pops up to the innermost open element of tags, unless one of within is further in."""
        nonlocal links
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=-1)
        if (found := last(tags)) > last(within):
            while len(stack) > found:
                gone, _ = stack.pop()
                places[gone].pop()
                links -= gone == "a"

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            close({tag}, set() if tag in BLOCK else {"td", "th", "table", "body"})
            continue
        if tag in RAW:
            if m[3].endswith("/"):
                continue
            end = RAW[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else len(page)
            if at == 0:
                at = len(page)
            continue
        if tag == "br":
            pieces.append("\n")
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("option", "label", "button"):
                close({"p"}, {"article", "section", "div", "td", "th", "li", "table", "body", "aside", "form"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPE[tag])
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            close({"a"}, {"td", "th", "table", "body", "li", "p", "div"})
            links += 1
        key = tag, m[3]
        if key not in known:
            known[key] = _describe(tag, m[3]) if m[3].strip() else f"in:{tag}"
        step = stack[-1][1] if stack else nowhere, known[key]
        if step not in paths:
            (inside, last), own = step[0], known[key].split(" ")
            paths[step] = inside.union(own), tuple(own) if not BLOCK_FEATURES.isdisjoint(own) else last
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, paths[step]))
    flush()
    return blocks


def features(blocks: list[tuple[str, tuple, int]]) -> list[list[str]]:
    out = []
    paths: dict = {}
    for i, (text, path, linked) in enumerate(blocks):
        if path not in paths:
            inside, last = sorted(path[0]), path[1]
            kind = ("side" if ASIDE.intersection(inside) else "plain") + ("-core" if CORE.intersection(inside) else "")
            paths[path] = [*inside, *[f"at:{f}" for f in last], kind, *[f"{kind}:{f}" for f in last]]
        n = len(text)
        out.append(
            [
                "bias",
                *paths[path],
                f"length:{min(9, n.bit_length())}",
                f"links:{(4 * linked + n - 1) // n}",
                "ends" if text[-1] in ".!?…»”\"'。" else "open",
                *(["sign"] if "©" in text or "(c)" in text.lower() else []),
                *(["first"] if i == 0 else []),
            ]
        )
    return out


class Chain:
    """A two-label chain: weights of label 1 over 0 per feature, and of each neighbouring pair of labels."""

    def __init__(self, weights: dict | None = None, steps: list | None = None):
        self.weights, self.steps = weights or {}, steps or [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi; a tie goes to label 0."""
        best, back = [0.0, 0.0], []
        for i, s in enumerate(self.scores(rows)):
            new, came = [0.0, 0.0], [0, 0]
            for y in (0, 1):
                a, b = best[0] + self.steps[0][y] * (i > 0), best[1] + self.steps[1][y] * (i > 0)
                came[y] = int(b > a)
                new[y] = max(a, b) + s * y
            best = new
            back.append(came)
        if not back:
            return []
        y = int(best[1] > best[0])
        out = [y]
        for came in reversed(back[1:]):
            y = came[y]
            out.append(y)
        return out[::-1]

    def gradient(self, rows: list[list[str]], labels: list[int]) -> tuple[list[float], list[list[float]]]:
        """Of the log likelihood: per block for label 1, and per pair of labels."""
        n, s, e = len(rows), self.scores(rows), [[math.exp(x) for x in r] for r in self.steps]
        ahead, behind = [[0.0, 0.0] for _ in rows], [[1.0, 1.0] for _ in rows]
        up = [math.exp(min(30.0, max(-30.0, x))) for x in s]
        for i in range(n):
            a = [1.0, up[i]] if i == 0 else [ahead[i - 1][0] * e[0][0] + ahead[i - 1][1] * e[1][0], (ahead[i - 1][0] * e[0][1] + ahead[i - 1][1] * e[1][1]) * up[i]]
            z = a[0] + a[1]
            ahead[i] = [a[0] / z, a[1] / z]
        for i in range(n - 2, -1, -1):
            b = [e[y][0] * behind[i + 1][0] + e[y][1] * up[i + 1] * behind[i + 1][1] for y in (0, 1)]
            z = b[0] + b[1]
            behind[i] = [b[0] / z, b[1] / z]
        blocks, pairs = [], [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n):
            p = ahead[i][1] * behind[i][1] / (ahead[i][0] * behind[i][0] + ahead[i][1] * behind[i][1])
            blocks.append(labels[i] - p)
            if i:
                q = [[ahead[i - 1][x] * e[x][y] * (up[i] if y else 1.0) * behind[i][y] for y in (0, 1)] for x in (0, 1)]
                z = sum(map(sum, q))
                for x in (0, 1):
                    for y in (0, 1):
                        pairs[x][y] += (labels[i - 1] == x and labels[i] == y) - q[x][y] / z
        return blocks, pairs


def labelled(page: str) -> tuple[list, list[int]]:
    """Blocks of a labelled page without their marks, and their labels."""
    blocks = leaf_blocks(page)
    return [(t.replace(MARK, "") or ".", p, n) for t, p, n in blocks], [int(t.startswith(MARK)) for t, _, _ in blocks]


def train(pages: list[str], epochs: int = 4, rate: float = 0.3, decay: float = 1e-2) -> Chain:
    """A chain fitted to labelled pages by AdaGrad steps, one page at a time."""
    chain, seen = Chain(), {}
    examples = []
    for page in pages:
        blocks, labels = labelled(page)
        examples.append((features(blocks), labels))
    step_seen = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(epochs):
        for rows, labels in examples:
            blocks, pairs = chain.gradient(rows, labels)
            slope: dict = {}
            for row, g in zip(rows, blocks, strict=True):
                for f in row:
                    slope[f] = slope.get(f, 0.0) + g
            for f, g in slope.items():
                g -= decay * chain.weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                chain.weights[f] = chain.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            for x in (0, 1):
                for y in (0, 1):
                    step_seen[x][y] += pairs[x][y] ** 2
                    chain.steps[x][y] += rate * pairs[x][y] / math.sqrt(step_seen[x][y])
    return chain


def labelled_pages(n: int = 1500, seed: int = 7) -> list[str]:
    """Pages composed of parts whose label is known: a block of main text begins with MARK."""
    pages = []
    for k in range(n):
        r = random.Random(seed * 100_003 + k)
        word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

        def words(count: int, r=r, word=word) -> str:
            return " ".join(word() for _ in range(count)).capitalize()

        def main_text(low: int, high: int, r=r, words=words) -> str:
            return MARK + words(r.randint(max(1, low), high)) + r.choice([".", ".", ".", ".", "", "?", "!", ","])

        def one(*options, r=r):
            return r.choice(options)

        links = lambda count: "".join(f'<li><a href="/{word()}">{words(r.randint(1, 3))}</a></li>' for _ in range(count))
        menu = lambda: one(f"<nav><ul>{links(r.randint(3, 8))}</ul></nav>", f'<div class="{one("menu", "navbar", "nav")}"><ul>{links(5)}</ul></div>', f'<ul id="menu">{links(4)}</ul>', f'<p class="breadcrumbs"><a href="/">{words(1)}</a> / {words(2)}</p>')
        ad = lambda: one(f'<div class="{one("ad", "ads", "advert", "banner", "sponsored", "promo")}">{words(r.randint(3, 25))}{one(".", "")}</div>', f'<aside class="ad"><p>{words(9)}.</p></aside>', f'<section class="promo"><h3>{words(3)}</h3><p>{words(20)}.</p></section>')
        notice = lambda: f'<div {one("class", "id")}="{one("cookie-notice", "consent", "alert", "newsletter", "popup", "notice", "cookie-banner")}"><p>{words(r.randint(6, 30))}.</p>{one("", "<button>" + words(1) + "</button>")}</div>'
        form = lambda: one(f'<form><label>{words(2)}</label><input name="q"><button>{words(1)}</button></form>', f'<form class="search"><p>{words(8)}.</p><select><option>{words(1)}<option>{words(2)}</select></form>')
        side = lambda: one(f"<aside><h3>{words(2)}</h3><ul>{links(5)}</ul></aside>", f'<div class="{one("sidebar", "related", "widget")}"><h4>{words(3)}</h4><p>{words(r.randint(8, 40))}.</p></div>', f"<aside><p>{words(25)}.</p></aside>")
        share = lambda: f'<div class="{one("share", "social")}"><a href="#">{words(1)}</a> <a href="#">{words(1)}</a></div>'
        foot = lambda: one(f"<footer>&copy; {word()}.example &middot; {words(r.randint(2, 20))}.</footer>", f"<footer><p>{words(12)}.</p><ul>{links(3)}</ul></footer>", f'<div id="footer">{words(8)}</div>')
        head = lambda: one(f'<header><a href="/">{words(2)}</a><p>{words(5)}</p></header>', f'<div class="header"><h1>{words(2)}</h1></div>', "")
        said = lambda: f'<{one("li", "div", "article")} class="comment"><b>{words(1)}</b><p>{words(r.randint(3, 45))}.</p></{one("li", "div", "article")}>'
        comments = lambda: one(f'<section class="comments"><h2>{words(2)}</h2>{said()}{said()}</section>', f'<div id="comments"><h3>{words(1)}</h3><ol>{said()}{said()}{said()}</ol></div>', f"<section id=comments>{said()}</section>")

        body = []
        for _ in range(r.randint(1, 9)):
            body.append(
                r.choices(
                    [
                        lambda: f"<p>{main_text(1, one(1, 4, 20, 70))}{one('</p>', '</p>', '')}",
                        lambda: f"<p><b>{main_text(0, 12)}<br><p>{main_text(0, 50)}</p>",
                        lambda: f'<p>{main_text(3, 30)} <a href="/x">{words(3)}</a> {words(4)}.</p>',
                        lambda: f"<h2>{main_text(1, 6)}</h2>",
                        lambda: f"<ul><li>{main_text(1, 12)}</li><li>{main_text(1, 12)}</li></ul>",
                        lambda: f"<blockquote><p>{main_text(5, 30)}</p></blockquote>",
                        lambda: f"<pre>{main_text(2, 20)}</pre>",
                        lambda: f"<table><tr><th>{main_text(1, 2)}<td>{main_text(1, 4)}</table>",
                        lambda: f"<figure><img src=a.png><figcaption>{main_text(2, 10)}</figcaption></figure>",
                        lambda: f"<div>{main_text(5, 40)}</div>",
                        ad,
                        share,
                        side,
                        form,
                    ],
                    [40, 10, 8, 8, 6, 3, 2, 2, 2, 6, 3, 2, 1, 1],
                )[0]()
            )
        inner = one(f"<h1>{main_text(1, 9)}</h1>", f"<h1>{main_text(1, 9)}</h1>", f"<header><h1>{main_text(2, 9)}</h1></header>", "") + "".join(body)
        if r.random() < 0.15:
            inner += comments()
        shell = one("<article>{}</article>", "<article>{}</article>", '<main><article class="post">{}</article></main>', "<main>{}</main>", '<div class="content">{}</div>', '<div id="main" class="entry">{}</div>', '<div class="article-body">{}</div>', "{}")
        parts = [head(), *[menu() for _ in range(r.randint(0, 2))], *[one(ad, notice, form, side)() for _ in range(r.randint(0, 2))], shell.format(inner)]
        parts += [one(ad, notice, form, side, share, comments)() for _ in range(r.randint(0, 3))] + [foot() if r.random() < 0.85 else ""]
        page = f"<!DOCTYPE html><html><head><title>{words(5)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(parts)}</body></html>"
        pages.append(page if r.random() < 0.9 else page[: r.randint(len(page) // 2, len(page))])
    return pages


def main_text_of(chain: Chain, page: str) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(t for (t, _, _), y in zip(blocks, chain.decode(features(blocks)), strict=True) if y)


_CHAIN: list[Chain] = []


def default_chain() -> Chain:
    """The chain fitted to ``labelled_pages()``, once in a process; about a second."""
    if not _CHAIN:
        _CHAIN.append(train(labelled_pages()))
    return _CHAIN[0]


def extract(pages: DataFrame, chain: Chain | None = None, column: str = "html") -> DataFrame:
    """pages (page_id, url and the html column) as page_id, url, text: the main text of each row.

    A null or empty page gives an empty text; a page cut off anywhere gives what it has, and one of any
    length or depth is taken whole; ids and urls, null or not, pass through; repeated rows are extracted
    each; a tie of labels goes to no main text; an empty table gives no rows; other columns are ignored.
    """
    ship_code(pages.sparkSession)
    chain = chain or default_chain()
    weights, steps = chain.weights, chain.steps

    def run(batches):
        mine = Chain(weights, steps)
        for batch in batches:
            texts = [main_text_of(mine, p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(column).cast("string")).mapInArrow(run, "page_id long, url string, text string")
