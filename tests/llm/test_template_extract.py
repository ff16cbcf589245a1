"""Main texts: golden pages, templates of hosts, and equivalence classes against brute force."""

import collections
import html
import random
import re

import pytest

from listinglab.llm import queries
from listinglab.llm.template_extract import Page, extract, templates

PAGES = "page_id long, url string, html string, host string, text string, drop int"


def texts(spark, pages, **how):
    df = spark.createDataFrame([(i, u, h, "h", "t", 1) for i, u, h in pages], PAGES)
    return collections.Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(df, **how).collect())


def alone(page):
    return Page(page).text(frozenset(), None, 0.6)


GOLDEN = [
    ("<article><h1>Ti&amp;tle</h1><p>a <b>b</b>c<br>d\n\t e&nbsp;f</p><p>  </p>g<div>h</div>i</article>", "Ti&tle\na bc d e f\ng\nh\ni"),
    ("<nav><ul><li>m</li></ul></nav><article><p><b>One<br><p>Two<ul><li>x<li>y</ul></article><footer>f</footer>", "One\nTwo\nx\ny"),
    ('<header><h1>Site</h1></header><main><header><h1>Head</h1><p>by me</p></header><p>Text</p><aside>side</aside><form>Mail <input></form><div class="ad">buy</div></main>', "Head\nText"),
    ('<article><p>Body</p><section id="comments"><article class="comment"><p>Reader</p></article></section></article><div class="cookie-notice">ok?</div>', "Body"),
    ('<form id="page"><div class="main-menu">m</div><article><p>In a form</p></article></form>', "In a form"),
    ("<article><p>a<!-- no --><script>if (1 < 2) '</p>'</script><style>p{}</style>b &lt;i&gt; 5 < 6 &#233; &am</p><!-- open <p>never</p></article>", "ab <i> 5 < 6 é &am"),
    ("<ARTICLE><P CLASS='x>y'>q</P><table><tr><td>1<td>2<tr><td>3</table><textarea>t</textarea></ARTICLE>", "q\n1\n2\n3"),
    ("<title>t</title><body class='with-sidebar'><div class='content has-sidebar'><p>c</p></div><div class='sidebar'>s</div>", "c"),
    ("no markup at all", "no markup at all"),
    ("", ""),
    ("<article></article>", ""),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "x</article>", "deep\nx"),
    ('<article>line <span class="ad">buy <b>now</b></span>goes on</article>', "line goes on"),
    ("<article><p>cut <a href='x", "cut"),
]


@pytest.mark.parametrize("page, text", GOLDEN)
def test_golden_pages(page, text):
    assert alone(page) == text


def soup(i, rnd):
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    paragraphs = [words(rnd.randint(5, 30)) + "." for _ in range(rnd.randint(1, 6))]
    links = "".join(f"<div><a href=/{k}>{words(1)}</a></div>" for k in range(rnd.randint(2, 9)))
    body = "".join(f"<div class=p>{p}</div>" for p in paragraphs)
    page = f"<html><body><div class=a>{links}</div><div class=b><div class=n>We are moving to a new address soon.</div>{body}<div class=n>All rights are ours.</div></div><div class=z>{words(2)}</div></body></html>"
    return page, "\n".join(paragraphs)


def test_templates_tell_content_without_marks(spark):
    rnd = random.Random(5)
    made = [soup(i, rnd) for i in range(40)]
    got = texts(spark, [(i, f"http://a.b/{i}", p) for i, (p, _) in enumerate(made)])
    assert got == collections.Counter((i, f"http://a.b/{i}", t, len(t)) for i, (_, t) in enumerate(made))


def test_copies_are_no_template(spark):
    page = "<article>" + "".join(f"<p>Sentence {k} of the article.</p>" for k in range(9)) + "</article>"
    text = "\n".join(f"Sentence {k} of the article." for k in range(9))
    near = [(i, "http://c.d/x", page.replace("Sentence 3", f"Phrase {i}")) for i in range(8)]
    got = texts(spark, near + [(9, "http://c.d/x", page)] * 3)
    assert got[9, "http://c.d/x", text, len(text)] == 3
    assert all(t == text.replace("Sentence 3", f"Phrase {i}") for i, _, t, _ in got if i < 8)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "no scheme", "<article>x</article>"), (2, "http://h/", "<article>" + "word " * 200_000 + "</article>"), (3, "http://h/", "<p>é😀</p>")]
    long = ("word " * 200_000).strip()
    assert texts(spark, rows) == collections.Counter({(1, None, "", 0): 2, (None, "no scheme", "x", 1): 1, (2, "http://h/", long, len(long)): 1, (3, "http://h/", "é😀", 2): 1})
    assert not texts(spark, [])


def test_classes_equal_brute_force(spark):
    """Tokens that are dropped: those of one occurrence vector, in one order, in one slot."""
    rnd = random.Random(8)
    pages = []
    for i in range(60):
        some = [f"<p>t{rnd.randrange(1000)}</p>" for _ in range(8)]
        pages.append((i, f"http://h{i % 3}.x/", f"<article><p>always</p>{''.join(some)}<p>{'odd' if i % 2 else 'even'}</p>" + "".join(f"<div>reply</div><div>by u{rnd.randrange(900)}</div>" for _ in range(rnd.randint(1, 4))) + (f"<p>x</p><p>y {i}</p>" if i % 6 else "<p>y</p><p>x</p>") + "<p>end</p></article>"))
    df = spark.createDataFrame([(*p, "", "", 0) for p in pages], PAGES)
    got = {r["host"]: {x & (2**64 - 1) for x in r["drop"] or ()} for r in templates(df).collect()}
    for h in range(3):
        read = {i: Page(p) for i, u, p in pages if u == f"http://h{h}.x/"}
        vector = collections.defaultdict(dict)
        for i, p in read.items():
            for t, n in collections.Counter(p.tokens).items():
                vector[t][i] = n
        classes = collections.defaultdict(list)
        for t, v in vector.items():
            if len(v) >= 0.9 * len(read):
                classes[tuple(sorted(v.items()))].append(t)
        root = set(max((c for v, c in classes.items() if all(n == 1 for _, n in v)), key=len))
        want = set()
        for c in classes.values():
            kinds = set()
            for p in read.values():
                slot, seen, first = 0, [], None
                for t in p.tokens:
                    if t in c:
                        first = t if first is None else first
                        seen += [[]] if t == first else []
                        seen[-1].append((t, -1 if t in root else slot + (t in root)))
                    slot += t in root
                kinds |= {tuple(r) for r in seen}
            if len(c) > 1 and len(kinds) == 1 and len({s for _, s in next(iter(kinds))}) == 1:
                want |= set(c)
        assert got[f"h{h}.x"] == want


def test_query_gives_the_articles(spark, data):
    def article(h):
        blocks = re.split(r"</?(?:p|h1)>", h[h.index("<article>") + 9 : h.index("</article>")])
        return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split())))

    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op12_template_extract(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert got == {r["page_id"]: (r["url"], article(r["html"]), len(article(r["html"]))) for r in rows}
