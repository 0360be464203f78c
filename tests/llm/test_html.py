import math
import random
import re
import time

from skein.llm import html
from skein.llm.common import table
from tests.llm.helpers import rows

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a> best site</header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and this is a rather long notice, really. Please do accept it now.</div>
<div id="wrap"><main><article><header><h1>Head&shy;line &amp; more</h1><span>By me</span></header>
<p>First  paragraph, with <b>bold</b> and
 a <a href=x>link</a>; it goes on for a while.<br>And on.<p>Second one &lt;here&gt;. Short.
<ul><li>point one</li><li>point two</li></ul><div class="advert">Buy, buy, buy. Now, now.</div>
<form><p>Sign up here, please, for news.</p></form><blockquote>Quoted words, at last.</blockquote></article>
<section class="comments"><p>I like this article, a lot, says reader.</p></section></main>
<aside><p>Side, bar, text, all, along.</p></aside></div><script>var x = "<p>no</p>";</script><footer>&copy; us, 2020.</footer></body></html>"""


def test_made_page():
    assert html.main_text(PAGE).split("\n") == ["Head­line & more", "First paragraph, with bold and a link; it goes on for a while. And on.", "Second one <here>. Short.", "point one", "point two", "Quoted words, at last."]


def test_forms():
    """A form around the page is no more than a division; forms in the page, and their controls, are no text of it."""
    body = "<h1>T</h1><p>" + "Long text, of many words, here. " * 9 + "</p>"
    want = "T\n" + ("Long text, of many words, here. " * 9).strip()
    login = '<form action="/login"><p>User, name, please.</p><input name=u><button>Go</button><label>Keep me, please.</label></form>'
    search = "<form role=search><div>Search all, of it.</div><select><option>one</option></select></form>"
    assert html.main_text(f'<body><nav>Menu</nav><form id="aspnetForm"><input type=hidden><article>{body}</article><button>Go</button></form></body>') == want
    assert html.main_text(f'<body><form id="all" ACTION="x"><div class=x>{body}</div></form><footer>Foot, er.</footer></body>') == want
    assert html.main_text(f"<body><form id=all><main>{body}</main>") == want
    assert html.main_text(f"<body>{search}<article>{body}{login}</article>{login}</body>") == want
    assert html.main_text(f"<body>{login}</body>") == "User, name, please.\nKeep me, please."
    many = f"<body><article>{body}" + login * 3000 + "</article>"
    start = time.time()
    assert html.main_text(many) == want and time.time() - start < 5


def test_without_article_element():
    page = "<body><div class='menu'><p>Go, home.</p></div><div class=x><p>" + "Long text, of many words. " * 9 + "</p><p>Short.</p><h2>Next</h2></div><div><a href=1>one</a> <a href=2>two</a></div></body>"
    assert html.main_text(page) == ("Long text, of many words. " * 9).strip() + "\nShort.\nNext"


def test_corner_cases(spark):
    texts = [None, "", "plain words only", "<p>cut off", "<p>a</p><!-- open", "<<<>>>", "&amp;&#233;&unknown;", "<div>" * 3000 + "deep", "<p>" + "x" * 200_000, "<script>only()</script>"]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = rows(html.extract(pages), "page_id")
    assert [got[i]["text"] for i in (0, 1, 2, 3, 4, 7, 9)] == ["", "", "plain words only", "cut off", "a", "deep", ""] and got[8]["n_chars"] == 200_000
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html.extract(pages.limit(0)).count() == 0


def test_names_are_weights():
    body = "<p>" + "Some text, of an article, here. " * 5 + "</p>"
    want = ("Some text, of an article, here. " * 5).strip()
    for page in (f'<div class="site no-sidebar"><article>{body}</article></div>', f'<div class="post comments-open">{body}</div>', f'<div class="comments">{body}</div>', f'<div class="widget"><h1>T</h1>{body}</div>', f'<div id="header"><main>{body}</main></div>'):
        assert html.main_text(page).split("\n")[-1] == want, page
    beside = f'<main><article>{body}</article><section class="comments"><article class="comment"><p>{"I like it, really, a lot. " * 30}</p></article></section><div class="related-posts"><p>Other, things, here, too.</p></div></main>'
    assert html.main_text(beside) == want
    assert html.main_text(f'<article>{body}<div class="share-buttons"><p>Share, it.</p></div></article>') == want


def test_comments_and_declarations():
    assert html.main_text('<script>var x="<!--";</script><article><p>Whole, here.</p></article>') == "Whole, here."
    assert html.main_text("<style><!-- p{} </style><p>a</p>") == "a" and html.main_text("<p>a</p><!-- open <p>b</p>") == "a"
    assert html.main_text("<p>a</p><![foo[ x ]]><p>b</p>") == "a\nb" and html.main_text("<p>a</p><a href='x") == "a"


def test_time_is_linear():
    def seconds(page):
        start = time.process_time()
        html.main_text(page)
        return time.process_time() - start

    for make in (lambda n: "<div>x" * n, lambda n: "<x>" * n + "</b>" * n, lambda n: "<b><div>" + "<x>" * n + "</b>" * n, lambda n: "<a " * n, lambda n: "<a " * n + ">", lambda n: "<li>" * n):
        assert seconds(make(50_000)) < 30 * seconds(make(5000)) + 2
    assert html.main_text("<div>x" * 50_000) == "\n".join("x" * 50_000)


def plain_ratios(blocks):
    """Which paths are content, step by step from the definition: (text, path, length of link text)."""
    paths = [p for _, p, _ in blocks]
    mean = lambda f: [sum(f(b) for b in blocks if b[1] == p) / paths.count(p) for p in paths]

    def smooth(x):
        at = lambda i: x[i] if 0 <= i < len(x) else 0
        return [0.4 * x[i] + 0.24 * (at(i - 1) + at(i + 1)) + 0.06 * (at(i - 2) + at(i + 2)) for i in range(len(x))]

    length = mean(lambda b: max(0, len(b[0]) - b[2]))
    fused = [math.log1p(a) * (1 + math.log1p(b)) for a, b in zip(smooth(length), smooth(mean(lambda b: sum(c in ".,;:!?" for c in b[0]))), strict=True)]
    score = {p: sum(f for f, q in zip(fused, paths, strict=True) if q == p) * length[paths.index(p)] / paths.count(p) for p in paths}
    return {p for p in paths if score[p] >= 0.15 * max(score.values()) and length[paths.index(p)]}


def test_against_plain_ratios():
    rng = random.Random(4)
    for _ in range(60):
        blocks, page = [], ""
        for k in range(rng.randrange(1, 25)):
            kind = rng.choice(["a", "b", "c", "d"])
            words = rng.choice([2, 8, 40]) if kind != "d" else 1
            text = " ".join(rng.choice(["word", "words,", "end.", "more"]) for _ in range(words))
            page += f"<section><p class={kind}>{text}</p></section>"
            blocks.append((text, kind, 0))
        content = plain_ratios(blocks)
        # each block alone in its section: the holder is the root unless one block is content, and all blocks without links stay
        kept = html.main_text(page).split("\n")
        assert kept == ([t for t, _, _ in blocks] if sum(p in content for _, p, _ in blocks) > 1 else [t for t, p, _ in blocks if p in content])


def test_tables(spark, sf):
    """In these pages the article is all that stands in the article element, in h1 and p."""
    import html as entities

    for r in table(spark, sf, "pages").limit(60).collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:h1|p|article)>|<br>", body)]
        assert html.main_text(r.html) == "\n".join(x for x in blocks if x), r.page_id
