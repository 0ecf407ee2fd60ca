"""Block rules on planted pages and edge cases."""

import html
import html.parser
import random
import re

from tracefuse.llm import html_text
from tracefuse.llm.common import table

PROSE = "the of and to in it was here and there with the others " * 5


def test_boilerplate_goes_and_article_stays():
    page = f"""<html><head><title>T</title><script>var t="</p><p>x</p>";</script><style>p{{}}</style></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="ad">Buy the best of it and more</div><div id="cookie-notice">We use the cookies of this site</div>
    <article><h1>Title &amp; more</h1><p>{PROSE}</p><p>Short   one.</p><ul><li>item a</li></ul><p>a<br>b &#x41;&eacute;</p>
    <div class="share-buttons">Share this</div><pre>x | y</pre></article>
    <aside><p>{PROSE}</p></aside><section class="comments"><p>{PROSE}</p></section>
    <form><p>{PROSE}</p><input></form><footer>&copy; the site of it</footer></body></html>"""
    assert html_text.main_text(page) == "\n".join(
        ["Title & more", PROSE.strip(), "Short one.", "item a", "a b Aé", "x | y"])


def test_pages_without_article_use_density_and_neighbours():
    links = "".join(f'<li><a href="#">link number {i} of the list and more of it</a></li>' for i in range(8))
    page = f"<body><ul>{links}</ul><p>{PROSE * 2}</p><p>Short one.</p><p>{PROSE * 2}</p><ul>{links}</ul><p>Imprint</p></body>"
    assert html_text.main_text(page) == f"{(PROSE * 2).strip()}\nShort one.\n{(PROSE * 2).strip()}"


def test_article_blocks_that_name_themselves_or_carry_links():
    page = f"""<article><h2 class="header"><a href="#s">Section</a></h2><p>{PROSE}</p><p class="advert">Buy the best of it</p>
    <p>See <a href="/x">this</a>, a note on the matter.</p><figure><img src="i"><figcaption>A view of it</figcaption></figure>
    <p id="newsletter">{PROSE}</p><p>{PROSE}</p><ul><li class="share">Share</li><li>One</li></ul></article>
    <p><a href="/y">more</a> of it</p>"""
    assert html_text.main_text(page) == "\n".join(
        ["Section", PROSE.strip(), "See this, a note on the matter.", "A view of it", PROSE.strip(), "One"])


def test_class_names_of_layouts_say_nothing_of_the_article():
    body = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>"
    want = f"Title\n{PROSE.strip()}\n{PROSE.strip()}"
    gone = f'<div class="sidebar"><p>{PROSE}</p></div><ol class="comment-list"><li><p>{PROSE}</p></li></ol>'
    for page in (f'<div class="wrap has-sidebar"><article>{body}</article>{gone}</div>',
                 f'<div class="post with-comments"><article>{body}</article>{gone}</div>',
                 f'<div class="layout no-sidebar"><main>{body}</main></div>{gone}',
                 f'<div class="sidebar-left"><div id="search-result"><main>{body}</main></div></div>{gone}',
                 f'<div class="content-sidebar-wrap"><article class="post tag-news">{body}</article></div>',
                 f'<form id="page"><div><article>{body}</article></div></form>{gone}',
                 f'<div class="with-comments"><div>{body}</div></div>{gone}',
                 f'<div class="legal-page search"><div>{body}</div></div>{gone}'):
        assert html_text.main_text(page) == want, page


def test_hints_inside_an_article():
    page = f"""<article><div class="article-header"><h1>Headline</h1></div><p class="legal">{PROSE}</p>
    <div class="search"><p>{PROSE}</p></div><div class="tags"><span>one</span> two</div><p class="copyright">(c) us</p>
    <div class="related"><p>{PROSE}</p></div><div class="notice"><p>{PROSE}</p></div></article>
    <div class="legal"><p>{PROSE}</p></div><div class="header"><p>{PROSE}</p></div>"""
    assert html_text.main_text(page) == "\n".join(["Headline", PROSE.strip(), PROSE.strip()])
    # comments that are articles of their own never make their list the core of the page
    page = f"""<div><p>{PROSE * 2}</p></div><ol class="comment-list"><li><article class="comment"><p>{PROSE * 4}</p>
    </article></li></ol><section class="related"><article><p>{PROSE}</p></article></section>"""
    assert html_text.main_text(page) == (PROSE * 2).strip()


def test_attribute_values_follow_the_rules_of_html():
    p = PROSE.strip()
    for tag in ("<p title=it's>", '<p title="a > b">', "<p title='a > b'>", "<p data-x=a\"b'c>", '<p title="class=ad">',
                "<p title = 'x' lang=en>", "<p it's>", "<p =x>", "<p title='class=\"ad\"'>", "<p style='color:red'>"):
        assert html_text.main_text(f"<article>{tag}{PROSE}</p><p>{PROSE}</p></article>") == f"{p}\n{p}", tag
    for tag in ("<p class=ad>", "<p class = 'x ad'>", "<p CLASS=AD>", "<p hidden>", "<p aria-hidden=true>",
                "<p style='display: none'>", "<p id=cookie-bar>"):
        assert html_text.main_text(f"<article>{tag}{PROSE}</p><p>{PROSE}</p></article>") == p, tag
    assert html_text.attributes("class=a CLASS='b' x") == {"class": "a", "x": ""}


def test_pages_in_other_scripts_are_decided_by_length_and_sentences():
    russian = "Это было давно, и никто из жителей города уже не помнил, с чего всё началось. " * 5
    chinese = "这座城市的历史可以追溯到很久以前，没有人记得它是怎样开始的。" * 6
    for prose in (russian, chinese):
        links = "".join(f'<li><a href="#">{prose[:30]}</a></li>' for _ in range(5))
        page = f"<body><ul>{links}</ul><div><p>{prose}</p><p>{prose[:12]}</p><p>{prose}</p></div><ul>{links}</ul></body>"
        assert html_text.main_text(page) == "\n".join([prose.strip(), prose[:12].strip(), prose.strip()])
    menu = "Главная Новости Погода Спорт Культура Наука " * 6
    assert html_text.main_text(f"<body><p>{menu}</p><p>{russian}</p></body>") == russian.strip()


def brute_inherit(labels, regions, dropped):
    """Every undecided block looks at all blocks of its region."""
    keep = []
    for i, label in enumerate(labels):
        if label in (html_text.GOOD, html_text.BAD):
            keep.append(label == html_text.GOOD)
            continue
        speaking = [j for j in range(len(labels)) if regions[j] == regions[i] and labels[j] in (html_text.GOOD, html_text.BAD)
                    and not (dropped[j] and regions[j])]
        left = max((j for j in speaking if j < i), default=None)
        right = min((j for j in speaking if j > i), default=None)
        own = bool(regions[i]) or label == html_text.NEAR
        sides = [(abs(i - j), labels[j] == html_text.GOOD) for j in (left, right) if j is not None]
        if not sides:
            keep.append(own)
        elif len({good for _, good in sides}) == 1:
            keep.append(sides[0][1])
        else:
            nearest = min(d for d, _ in sides)
            at = [good for d, good in sides if d == nearest]
            keep.append(at[0] if len(at) == 1 else own)
    return keep


def test_second_pass_against_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randint(0, 25)
        labels = [rnd.choice((html_text.GOOD, html_text.BAD, html_text.SHORT, html_text.NEAR)) for _ in range(n)]
        regions = [rnd.randint(0, 2) for _ in range(n)]
        dropped = [x == html_text.BAD and rnd.random() < 0.5 for x in labels]
        assert html_text.inherit(labels, regions, dropped) == brute_inherit(labels, regions, dropped)


class PlainParser(html.parser.HTMLParser):
    """Brute-force reading of well-formed pages with p and li blocks: (text, linked characters) by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.linked, self.link = [], "", "", False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag in ("p", "li"):
            self.text = self.linked = ""

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag in ("p", "li"):
            text = " ".join(self.text.split())
            if text:
                self.found.append((text, len(" ".join(self.linked.split()))))
            self.text = self.linked = ""

    def handle_data(self, data):
        self.text += data
        self.linked += data if self.link else ""


def brute_text(page):
    """Both passes over a page without articles, counted word by word."""
    parser = PlainParser()
    parser.feed(page)
    labels = []
    for text, linked in parser.found:
        words = [w.strip(html_text.WORD_EDGE) for w in text.lower().split()]
        density = sum(w in html_text.STOP_WORDS for w in words) / len(words)
        if linked > 0.4 * len(text) or len(text) < 70 and linked:
            labels.append(html_text.BAD)
        elif len(text) < 70:
            labels.append(html_text.SHORT)
        elif density >= 0.2 and len(text) > 200:
            labels.append(html_text.GOOD)
        else:
            labels.append(html_text.NEAR if density >= 0.1 else html_text.BAD)
    keep = brute_inherit(labels, [0] * len(labels), [False] * len(labels))
    return "\n".join(text for (text, _), k in zip(parser.found, keep) if k)


def test_both_passes_against_brute_force():
    rnd = random.Random(4)
    vocabulary = "the of and in river stone mill bridge &amp; caf&eacute; &#x41;x market winter tall".split()
    for _ in range(150):
        page = []
        for _ in range(rnd.randint(0, 14)):
            share, size = rnd.choice((0.0, 0.15, 0.5)), rnd.choice((3, 9, 20, 60))
            words = [rnd.choice(vocabulary[:4] if rnd.random() < share else vocabulary[4:]) for _ in range(size)]
            if rnd.random() < 0.4:
                at = rnd.randrange(size)
                words[at:] = ["<a href='/x'>", *words[at:], "</a>"]
            page.append(f"<{(t := rnd.choice(('p', 'li')))}>{rnd.choice((' ', chr(10))).join(words)}</{t}>")
        page = "<body><div>" + "".join(page) + "</div></body>"
        assert html_text.main_text(page) == brute_text(page), page


def test_broken_markup():
    for page in ("", "<", "<p", "<!-- open", "<script>never closed <p>x</p>", '<a title="open>text</a>', "</div></p>", "&#0;&#x110000;",
                 "<p>" * 5000, "<div>" * 5000 + "x", "a" * 100000, "<![CDATA[x]]>", "<p class='ad\">x", "\x00퟿"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text(f"<article><p><b>Bold<br><p>{PROSE}</article>") == f"Bold\n{PROSE.strip()}"


def test_given_pages_whole_article(lspark):
    pages = table(lspark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip()
                 for p in re.split(r"</?(?:p|h\d)>", body))
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_nulls_repeats_clashes_and_empty(lspark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>the x</p></article>"), (2, "u", "<article><p>the x</p></article>")]
    df = lspark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(map(tuple, html_text.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "the x", 5), (2, "u", "the x", 5)], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0
