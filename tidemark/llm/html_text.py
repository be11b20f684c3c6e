"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

The trees are fitted to pages that `sample_page` composes with known main text (PAGES of them, from a fixed
seed) by `python -m tidemark.llm.html_text`, which writes them to TREES; nothing is fitted when pages are read. Each node of a page gets log odds of holding main text. Decoding picks for all nodes together the
likeliest labels under which a node without main text has none below it.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from functools import lru_cache
from math import log1p
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .dom import Node, parse

PAGES, SEED = 2000, 11
TREES = Path(__file__).with_name("html_trees.json")

# Words of class, id and role attributes, and elements, by what they usually mark.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager skip",
    "top": "header masthead banner topbar logo branding hero",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "side": "sidebar aside rail widget widgets complementary secondary",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay dialog newsletter subscribe subscription signup paywall",
    "talk": "comment comments commentlist reply replies respond disqus discussion thread feedback",
    "share": "share sharing social related recommended recommendations popular trending tags meta byline author",
    "form": "form search login signin register contact input",
    "main": "article content main post entry story body text page single prose hentry",
}
GROUPS = list(WORDS)
GROUP_OF = {w: i for i, name in enumerate(GROUPS) for w in WORDS[name].split()}
MAIN = GROUPS.index("main")
TAG_GROUP = {"nav": "menu", "menu": "menu", "header": "top", "footer": "foot", "aside": "side", "dialog": "notice", "form": "form", "fieldset": "form", "button": "form", "input": "form", "article": "main", "main": "main"}
TAG_GROUP = {t: GROUPS.index(g) for t, g in TAG_GROUP.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd menu".split())
STOPS = str.maketrans("", "", ".,;:!?")
WIDTH = 26 + 2 * len(GROUPS)
# Nodes that are scored at once (one page, if it has more).
NODES = 50_000


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its own subtree, its place among its siblings and on the page, its and its ancestors' marks."""
    n = len(nodes)
    chars, linked, stops, elements, runs, inputs = ([0] * n for _ in range(6))
    has_h1, has_main = [0] * n, [0] * n
    begin, total = [0] * n, 0
    for i, x in enumerate(nodes):
        begin[i] = total
        if not x.tag:
            chars[i], linked[i], runs[i] = len(x.text), x.linked, 1
            stops[i] = len(x.text) - len(x.text.translate(STOPS))
            total += len(x.text)
        else:
            elements[i] = 1
            inputs[i] = x.tag in ("input", "button", "select", "textarea")
            has_h1[i], has_main[i] = x.tag == "h1", x.tag in ("article", "main")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        elements[p] += elements[i]
        runs[p] += runs[i]
        inputs[p] += inputs[i]
        has_h1[p] |= has_h1[i]
        has_main[p] |= has_main[i]
    groups = len(GROUPS)
    own: list[list[int]] = [[0] * groups for _ in range(n)]
    up: list[list[int]] = [[0] * groups for _ in range(n)]
    rows, made = np.empty((n, WIDTH), np.float32), []
    place = [0] * n
    for x in nodes:
        for k, kid in enumerate(x.kids):
            place[kid] = k
    for i, x in enumerate(nodes):
        mine = own[i]
        for t in x.tokens:
            if (g := GROUP_OF.get(t)) is not None:
                mine[g] = 1
        if (g := TAG_GROUP.get(x.tag)) is not None:
            mine[g] = 1
        if i:
            above, its = up[x.parent], own[x.parent]
            up[i] = [a or b for a, b in zip(above, its)]
            kids = nodes[x.parent].kids
            k = place[i]
            before = chars[kids[k - 1]] if k else 0
            after = chars[kids[k + 1]] if k + 1 < len(kids) else 0
            many, share = len(kids), chars[i] / max(1, chars[x.parent])
        else:
            k = before = after = 0
            many = share = 1
        c = chars[i]
        made.append([
            x.depth, log1p(c), linked[i] / max(1, c), log1p(c / max(1, runs[i])), log1p(c / max(1, elements[i])), stops[i] / max(1, c), len(x.kids), k / max(1, many), many, share, c / max(1, total), begin[i] / max(1, total),
            log1p(before), log1p(after), inputs[i], has_h1[i], has_main[i], x.tag in HEADINGS, x.tag == "p", x.tag in LISTS, not x.tag, x.tag in ("body", "html", "#root"), x.tag in ("div", "section"),
            nodes[x.parent].tag in HEADINGS if i else 0, nodes[x.parent].tag == "p" if i else 0, nodes[x.parent].tag in LISTS if i else 0, *mine, *up[i],
        ])
        if len(made) == 4096 or i == n - 1:
            rows[i + 1 - len(made) : i + 1] = made
            made = []
    return rows


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The labels of least loss such that what lies under a node without main text has none either."""
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    with_, without = yes.tolist(), no.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        with_[p] += max(with_[i], without[i])
        without[p] += without[i]
    keep = [False] * len(nodes)
    for i, x in enumerate(nodes):
        keep[i] = (not i or keep[x.parent]) and (with_[i] >= without[i])
    return keep


def sample_page(rnd: random.Random) -> tuple[str, set[int]]:
    """A page, and the places of its runs of main text among all of its runs."""
    out: list[str] = []
    runs: list[bool] = []
    loose, quiet = rnd.choice(((0.0, 1.0), (0.15, 1.0), (0.9, 0.6), (0.7, 0.15))) if rnd.random() < 0.8 else (0.5, 0.0)
    bare, vague = rnd.choice(((0.0, 0.0), (0.1, 0.1), (0.1, 0.9), (0.3, 0.3), (1.0, 0.0)))

    def words(a: int, b: int, links: float = 0.0, stop: bool = True) -> str:
        got, count = [], rnd.randint(a, b)
        for k in range(count):
            w = "".join(rnd.choice("aeioubcdlmnrstéü") for _ in range(rnd.randint(2, 9)))
            w = w.capitalize() if k == 0 else w
            if stop and rnd.random() < 0.12:
                w += rnd.choice(".,.,;:")
            got.append(f'<a href="/x">{w}</a>' if rnd.random() < links else f"<b>{w}</b>" if rnd.random() < 0.02 else w)
        return " ".join(got) + ("." if stop and rnd.random() < 0.9 else "")

    def run(text: str, tag: str, main: bool, attr: str = "") -> None:
        out.append(f"<{tag}{attr}>{text}</{tag}>" if tag else text)
        runs.append(main)

    def box(mark: str) -> str:
        """Its attribute: a word that marks it, one that says nothing, or none, as the page's style has it."""
        if rnd.random() < bare:
            return ""
        word = rnd.choice(WORDS[mark].split()) if rnd.random() >= vague else "".join(rnd.choice("bcdgklmprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
        return f' {rnd.choice(("class", "id", "class"))}="{rnd.choice(("", "site-", "page-", "x-", "c1 "))}{word}{rnd.choice(("", "", "-wrap", " box", "-1"))}"'

    def menu() -> None:
        tag, listed = rnd.choice(("nav", "div", "ul")), rnd.random() < 0.8
        out.append(f"<{tag}{box('menu') if tag != 'nav' or rnd.random() < 0.3 else ''}>")
        out.append("<ul>" if listed and tag != "ul" else "")
        for _ in range(rnd.randint(2, 9)):
            run(f'<a href="/m">{words(1, 3, stop=False)}</a>', "li" if listed or tag == "ul" else "div", False)
        out.append("</ul>" if listed and tag != "ul" else "")
        out.append(f"</{tag}>")

    def plain(mark: str, tags: tuple, a: int, b: int, paragraphs: int, links: float = 0.1) -> None:
        tag = rnd.choice(tags)
        out.append(f"<{tag}{box(mark) if tag in ('div', 'section', 'ul') or rnd.random() < 0.3 else ''}>")
        inline = True
        for k in range(rnd.randint(1, paragraphs)):
            part = rnd.choice(("p", "p", "div", "", "span"))
            if k and inline and part in ("", "span"):
                part = "p"  # two inline runs would be one
            inline = part in ("", "span")
            run(words(a, b, links), part, False)
        out.append(f"</{tag}>")

    def comments() -> None:
        out.append(f"<{(tag := rnd.choice(('div', 'section', 'ol')))}{box('talk')}>")
        if rnd.random() < 0.5:
            run(words(1, 3, stop=False), "h3", False)
        for _ in range(rnd.randint(1, 6)):
            out.append(f"<{(t := 'li' if tag == 'ol' else 'div')}{box('talk') if rnd.random() < 0.7 else ''}>")
            run(words(1, 2, stop=False), "h4" if rnd.random() < 0.3 else "div", False)
            run(words(4, 70, 0.01), "p", False)
            out.append(f"</{t}>")
        out.append(f"</{tag}>")

    def form() -> None:
        out.append(f"<form{box('form') if rnd.random() < 0.5 else ''}>")
        run(words(1, 6), rnd.choice(("label", "p", "div")), False)
        out.append('<input type="text">')
        if rnd.random() < 0.6:
            run(words(1, 2, stop=False), "button", False)
        out.append("</form>")

    def links() -> None:
        out.append(f"<{(tag := rnd.choice(('div', 'section', 'aside')))}{box(rnd.choice(('share', 'side')))}>")
        if rnd.random() < 0.6:
            run(words(1, 3, stop=False), rnd.choice(("h3", "h4", "strong")), False)
        for _ in range(rnd.randint(2, 6)):
            run(f'<a href="/r">{words(2, 9, stop=False)}</a>', rnd.choice(("li", "div", "p")), False)
        out.append(f"</{tag}>")

    junk = {
        "menu": menu, "top": lambda: plain("top", ("header", "header", "div"), 1, 8, 2), "foot": lambda: plain("foot", ("footer", "footer", "div"), 3, 30, 2), "side": lambda: plain("side", ("aside", "aside", "div"), 3, 40, 3),
        "advert": lambda: plain("advert", ("div", "div", "section"), 2, 40, 2), "notice": lambda: plain("notice", ("div", "section"), 4, 40, 2), "share": lambda: plain("share", ("div", "ul"), 1, 12, 2), "talk": comments, "form": form, "links": links,
    }

    def clutter(names: str, chance: float) -> None:
        for name in names.split():
            if rnd.random() < chance * quiet:
                junk[name]()

    def article() -> None:
        style = rnd.random()
        # Some articles have no box of their own: they lie in the body, or in what the whole page lies in.
        tag = "" if style < loose else rnd.choice(("article", "article", "article", "main", "section", "div", "div"))
        if tag:
            out.append(f"<{tag}{box('main') if tag in ('div', 'section') and rnd.random() < 0.85 or rnd.random() < 0.25 else ''}>")
        if rnd.random() < 0.06:
            # Text without any element around it, line breaks and all.
            run("<br><br>".join(words(8, 90, 0.02) for _ in range(rnd.randint(1, 4))), "", True)
            out.append(f"</{tag}>" if tag else "<div></div>")
            return
        head = rnd.random() < (0.2 if tag else 0.03)
        out.append(f"<header{box('main') if rnd.random() < 0.3 else ''}>" if head else "")
        if rnd.random() < 0.85:
            run(words(2, 14, stop=False), rnd.choice(("h1", "h1", "h1", "h2")), True)
        if head and rnd.random() < 0.3:
            run(words(4, 25), "p", True)
        out.append("</header>" if head else "")
        inner = rnd.random() < 0.25
        out.append(f"<div{box('main')}>" if inner else "")
        for _ in range(rnd.choice((1, 1, 2, 2, 3, 4, 6, 9, 14, 25, 50))):
            kind = rnd.random()
            if kind < 0.02:
                out.append(f"<{(t := rnd.choice(('ul', 'ol')))}>")
                for _ in range(rnd.randint(2, 8)):
                    run(f'<a href="/t">{words(2, 12, stop=False)}</a>' + (" " + words(3, 20) if rnd.random() < 0.3 else ""), "li", True)
                out.append(f"</{t}>")
            elif kind < 0.04:
                out.append("<dl>")
                for _ in range(rnd.randint(1, 5)):
                    run(words(1, 3, stop=False), "dt", True)
                    run(words(3, 30), "dd", True)
                out.append("</dl>")
            elif kind < 0.06:
                out.append('<figure><img src="/i.png">')
                run(words(2, 20), "figcaption", True)
                out.append("</figure>")
            elif kind < 0.12:
                run(words(1, 8, stop=False), rnd.choice(("h2", "h3")), True)
            elif kind < 0.18:
                out.append("<ul>")
                for _ in range(rnd.randint(2, 6)):
                    run(words(2, 20, 0.02), "li", True)
                out.append("</ul>")
            elif kind < 0.23:
                out.append("<blockquote>")
                run(words(8, 60), "p", True)
                out.append("</blockquote>")
            elif kind < 0.27:
                run(words(3, 30), "pre", True)
            elif kind < 0.31:
                out.append("<table>")
                columns, titled = rnd.randint(1, 5), rnd.random() < 0.6
                for row in range(rnd.randint(1, 6)):
                    out.append("<tr>")
                    for _ in range(columns):
                        run(words(1, rnd.choice((1, 2, 6)), stop=rnd.random() < 0.3), "th" if titled and not row else "td", True)
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.38:
                run(words(1, 6, stop=rnd.random() < 0.6), "p", True)
            elif kind < 0.41:
                for _ in range(rnd.randint(1, 3)):
                    run(words(1, 2, stop=rnd.random() < 0.3), "p", True)
            elif kind < 0.45:
                run(words(10, 80), "div", True)
            else:
                run(words(8, 150, rnd.choice((0, 0.02, 0.08, 0.2))), "p", True)
            if rnd.random() < 0.05:
                junk[rnd.choice(("advert", "share", "form", "notice", "links"))]()
        out.append("</div>" if inner else "")
        if tag:
            clutter("share links talk form", 0.08)
            out.append(f"</{tag}>")

    out.append("<html><head><title>t</title></head><body>")
    wrap = rnd.random() < 0.4
    clutter("notice top menu", 0.5)
    out.append(f"<div{box('main') if rnd.random() < 0.4 else ' class=wrapper'}>" if wrap else "")
    clutter("menu advert notice side form", 0.25)
    if rnd.random() < 0.97:
        article()
    clutter("advert links talk side form share", 0.25)
    out.append("</div>" if wrap else "")
    clutter("talk side notice", 0.15)
    clutter("foot", 0.75)
    out.append("</body></html>")
    return "".join(out), {k for k, main in enumerate(runs) if main}


def fitted(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted to composed pages; a node's class is whether main text lies in it."""
    rnd, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        html, main = sample_page(rnd)
        nodes = parse(html)
        holds, k = [0] * len(nodes), 0
        for i, x in enumerate(nodes):
            if not x.tag:
                holds[i], k = int(k in main), k + 1
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].parent] |= holds[i]
        xs.append(features(nodes))
        ys += holds
    return boost(np.vstack(xs), np.array(ys, np.float64), trees=100, depth=5)


@lru_cache(maxsize=1)
def model() -> Boosted:
    """The trees of the file."""
    return Boosted.load(json.loads(TREES.read_text()))


def main_text(pages: list[str | None], trees: Boosted) -> list[str]:
    """Of each page; pages are scored together as long as they have no more than NODES nodes."""
    out: list[str] = []
    parsed: list[list[Node]] = []

    def flush() -> None:
        odds, at = trees.score(np.vstack([features(p) for p in parsed])), 0
        for nodes in parsed:
            keep = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append(" ".join(x.text for x, k in zip(nodes, keep) if k and not x.tag))
        parsed.clear()

    held = 0
    for p in pages:
        parsed.append(parse(p))
        held += len(parsed[-1])
        if held > NODES:
            flush()
            held = 0
    if parsed:
        flush()
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without main text, give an empty text; pages of any length and depth take linear time. Page ids
    and urls may be null or repeat; each row stays one. An empty table gives no rows; other columns aren't read.
    """
    trees = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                some = batch.slice(at, 128)
                texts = main_text(some.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    TREES.write_text(json.dumps(fitted().dump(), separators=(",", ":")))
