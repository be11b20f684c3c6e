"""Hand-written pages with known main text; none comes from the composer that the trees are fitted to."""

from tidemark.llm import html_text

P1 = "The ferry left the harbour at dawn, and nobody on the quay waved. By noon it was a dot beyond the lighthouse."
P2 = "Three weeks later a letter came with a foreign stamp. It said only that the winter there was mild, and that the bread was good."
P3 = "We kept the letter in the kitchen drawer, under the scissors, until the paper went soft at the folds."
H = "A letter from the north"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
DIVNAV = '<div class="menu"><a href="/">Home</a> <a href="/news">News</a> <a href="/shop">Shop</a> <a href="/help">Help</a></div>'
FOOT = "<footer><p>&copy; 2024 Example Press. All rights reserved.</p></footer>"
ASIDE = '<aside><h3>Popular</h3><ul><li><a href="/1">Ten things to see</a></li><li><a href="/2">How to bake bread</a></li><li><a href="/3">Old maps</a></li></ul></aside>'
TALK = '<div class="comments"><h3>Comments</h3><div class="comment"><p>Lovely, thank you for this one.</p></div><div class="comment"><p>I have been there too, it is like that.</p></div></div>'
COOKIE = '<div class="cookie-notice"><p>We use cookies to improve our service.</p><button>Accept</button></div>'
AD = '<div class="ad">Buy two lamps and get a third one free, this week only.</div>'
SIGNUP = '<form class="newsletter"><label>Get our newsletter</label><input type="email"><button>Sign up</button></form>'


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(body):
    return f"<!DOCTYPE html><html><head><title>Some title</title></head><body>{body}</body></html>"


PAGES = {
    "one paragraph": (f"<p>{P1}</p>", P1),
    "text with breaks": (f"{P1}<br><br>{P2}", f"{P1} {P2}"),
    "text in the body": (page(P1 + " " + P2), f"{P1} {P2}"),
    "heading and paragraphs in the body": (page(f"<h1>{H}</h1>{p(P1, P2)}"), f"{H} {P1} {P2}"),
    "the same with comments": (page(f"<h1>{H}</h1>{p(P1, P2)}{TALK}"), f"{H} {P1} {P2}"),
    "the same between menu and footer": (page(f"{NAV}<h1>{H}</h1>{p(P1, P2, P3)}{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "unknown names": (page(f'<div class="zq7">{NAV}</div><div class="k9x"><h1>{H}</h1>{p(P1, P2, "Short.")}</div>'), f"{H} {P1} {P2} Short."),
    "linked titles in an article": (page(f'{NAV}<article><h1>{H}</h1>{p(P1)}<ul><li><a href="/a">The second letter from the north</a></li><li><a href="/b">What the harbour master said</a></li></ul></article>{FOOT}'), f"{H} {P1} The second letter from the north What the harbour master said"),
    "heading in the article's header": (page(f"{NAV}<article><header><h1>{H}</h1></header>{p(P1, P2)}</article>{FOOT}"), f"{H} {P1} {P2}"),
    "blog": (page(f"{NAV}<article><h1>{H}</h1>{p(P1, P2, P3)}</article>{ASIDE}{TALK}{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "blog of plain boxes": (page(f'<div id="header">Example Press</div>{DIVNAV}<div id="content"><h1>{H}</h1>{p(P1, P2)}</div><div id="sidebar"><h3>About</h3><p>A paper of the coast.</p></div><div id="footer">Imprint</div>'), f"{H} {P1} {P2}"),
    "main element": (page(f"{COOKIE}<header><a href='/'>Example Press</a></header>{NAV}<main><h1>{H}</h1>{p(P1, P2, P3)}</main>{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "advert inside": (page(f"{NAV}<article><h1>{H}</h1>{p(P1)}{AD}{p(P2, P3)}</article>{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "sign-up inside": (page(f"<article><h1>{H}</h1>{p(P1, P2)}{SIGNUP}</article>{FOOT}"), f"{H} {P1} {P2}"),
    "comments inside": (page(f"{NAV}<article><h1>{H}</h1>{p(P1, P2)}{TALK}</article>{FOOT}"), f"{H} {P1} {P2}"),
    "sections with headings": (page(f"{NAV}<article><h1>{H}</h1>{p(P1)}<h2>The winter</h2>{p(P2)}<h2>The drawer</h2>{p(P3)}</article>{FOOT}"), f"{H} {P1} The winter {P2} The drawer {P3}"),
    "quote": (page(f"<article><h1>{H}</h1>{p(P1)}<blockquote><p>{P2}</p></blockquote>{p(P3)}</article>{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "table": (page(f"{NAV}<article><h1>{H}</h1>{p(P1)}<table><tr><th>Port</th><th>Day</th></tr><tr><td>Bergen</td><td>Monday</td></tr></table>{p(P2)}</article>{FOOT}"), f"{H} {P1} Port Day Bergen Monday {P2}"),
    "figure": (page(f"{NAV}<article><h1>{H}</h1><figure><img src='a.png'><figcaption>The quay in winter.</figcaption></figure>{p(P1, P2)}</article>{FOOT}"), f"{H} The quay in winter. {P1} {P2}"),
    "definitions": (page(f"{NAV}<article><h1>{H}</h1>{p(P1)}<dl><dt>Quay</dt><dd>Where ships lie and are loaded.</dd><dt>Stamp</dt><dd>What shows that a letter was paid for.</dd></dl></article>"), f"{H} {P1} Quay Where ships lie and are loaded. Stamp What shows that a letter was paid for."),
    "code": (page(f"{NAV}<main><h1>{H}</h1>{p(P1)}<pre>letter = open('north.txt')\nprint(letter.read())</pre>{p(P2)}</main>{FOOT}"), f"{H} {P1} letter = open('north.txt') print(letter.read()) {P2}"),
    "no heading": (page(f"{NAV}<article>{p(P1, P2, P3)}</article>{FOOT}"), f"{P1} {P2} {P3}"),
    "nested boxes": (page(f'{NAV}<div class="wrap"><div class="row"><div class="col"><article><div class="entry-content"><h1>{H}</h1>{p(P1, P2, P3)}</div></article></div><div class="col">{ASIDE}</div></div></div>{FOOT}'), f"{H} {P1} {P2} {P3}"),
    "unclosed paragraphs": (page(f"{NAV}<article><h1>{H}</h1><p>{P1}<p>{P2}<p>{P3}</article>{FOOT}"), f"{H} {P1} {P2} {P3}"),
    "scripts and styles": (page(f"<script>var a = '<p>no</p>';</script><style>p {{}}</style>{NAV}<article><h1>{H}</h1>{p(P1)}<script>b()</script>{p(P2)}</article>{FOOT}"), f"{H} {P1} {P2}"),
    "links within sentences": (page(f'{NAV}<article><h1>{H}</h1><p>The <a href="/f">ferry</a> left the harbour at dawn, and nobody on the <a href="/q">quay</a> waved.</p>{p(P2)}</article>{ASIDE}{FOOT}'), f"{H} The ferry left the harbour at dawn, and nobody on the quay waved. {P2}"),
    "section with a list": (page(f"{NAV}<section class='story'><h1>{H}</h1>{p(P1)}<ol><li>Pack a warm coat for the crossing.</li><li>Write once a week, at least.</li></ol>{p(P3)}</section>{FOOT}"), f"{H} {P1} Pack a warm coat for the crossing. Write once a week, at least. {P3}"),
    "references": (page(f"{NAV}<article><h1>Bread &amp; salt</h1><p>Caf&eacute;s &lt;opened&gt; late&#33; {P1}</p>{p(P2)}</article>"), f"Bread & salt Cafés <opened> late! {P1} {P2}"),
    "long": (page(f"{NAV}<article><h1>{H}</h1>{p(*[P1, P2, P3] * 12)}</article>{ASIDE}{FOOT}"), " ".join([H, *[P1, P2, P3] * 12])),
    "share buttons": (page(f'{NAV}<article><h1>{H}</h1>{p(P1, P2)}<div class="share"><a href="/t">Tweet</a> <a href="/m">Mail</a></div></article>{FOOT}'), f"{H} {P1} {P2}"),
    "only a menu": (page(f"{NAV}{FOOT}"), ""),
    "nothing": ("", ""),
}


def test_hand_written_pages():
    got = dict(zip(PAGES, html_text.main_text([html for html, _ in PAGES.values()], html_text.model())))
    wrong = {name: (got[name], want) for name, (_, want) in PAGES.items() if got[name] != want}
    assert len(PAGES) >= 30
    assert not wrong, wrong


def test_the_file_holds_what_fitting_gives():
    some = html_text.fitted(pages=30)
    again = html_text.Boosted.load(some.dump())
    x = html_text.features(html_text.parse(page(p(P1))))
    assert abs(some.score(x) - again.score(x)).max() < 1e-3
