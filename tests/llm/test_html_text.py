"""Page text against hand-made pages, and templates found by subtree counts."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from matchloom.llm import html_text

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a b"), ("<b>bo</b>ld <i>it</i>al", "bold ital"),
    ("<html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body><article><h1>H</h1><p>A&amp;B &lt;c&gt; &eacute;&#33;</p></article></body></html>", "H A&B <c> é!"),
    ("<body><nav><a href=x>Menu</a></nav><header>Head</header><article><p>Text<br>more</p></article><aside>side</aside><footer>foot</footer></body>", "Text more"),
    ("<body><div class='ad'>buy</div><div id=main><p>Main</p></div></body>", "buy Main"),
    ("<main><p>In</p></main><div>out</div>", "In"), ("<div role=main><p>In</p></div><div>out</div>", "In"), ("<article>a</article><article>b</article>", "a b"),
    ("<article><p><b>open<br><p>next<div class=x>box</div><form>f<input></form><p>last</article>", "open next box last"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut</p><p cla", "cut"), ("<article>x<!-- note --> y<!-- open", "x y"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"), ("<article hidden>no</article><p>yes</p>", "no"), ("<article><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<article><p>a b c</p></article>", "a b c"), ("<article><textarea>t</textarea><noscript>n</noscript><button>b</button>ok</article>", "ok"), ("<nav>only</nav>", ""),
    ("<article><p>one<div><article>reply<p>more</article></div></article>", "one"), ("<main><article>a</article><article>b</article>c</main>", "a b"), ("<main>a<main>b</main></main>", "a b"), ("</p></div><p>stray</p></article>", "stray"), ("<p title='a>b'>quoted</p>", "quoted"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_extract(source, text):
    assert html_text.extract(source) == text


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 20_000 + "deep") == "deep"
    assert html_text.extract("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    assert html_text.subtrees("<ul>" * 5000 + "x")[0]
    for hostile in ("<div>" * 30_000 + "</zzz>" * 30_000, "<p>" * 30_000 + "<div>x</p>" * 30_000, "<ul>" + "<li><b>" * 30_000):
        began = time.perf_counter()
        html_text.extract(hostile, [])
        assert time.perf_counter() - began < 8


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")


def test_templates_are_removed_by_host(spark):
    rows = []
    for i in range(30):
        box = "<div><p>Read our guide</p><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></div>"
        rows.append((i, f"http://one.example/{i}?q", f"<body>{box}<div><p>Own words {i}</p></div>{box}</body>", "", ""))
        rows.append((100 + i, f"https://user@Two.example:80/{i}", f"<body><article><h1>T{i}</h1><p>Shared passage of all articles</p><div><a href=/x>More</a> <a href=/y>Links</a></div></article></body>", "", ""))
    rows.append((500, "http://three.example/", "<body><div><p>Read our guide</p></div><div><p>stays</p></div></body>", "", ""))
    rows += [(600, None, None, None, None), (601, "no host", "", None, None), (0, "http://one.example/0?q", rows[0][2], None, None), (None, "http://one.example/z", "<p>z</p>", None, None)]
    got = html_text.extract_pages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"Own words {i}" for i in range(30))
    assert all(text[100 + i] == f"T{i} Shared passage of all articles" for i in range(30))
    assert text[500] == "Read our guide stays" and text[600] == text[601] == "" and text[None] == "z"


def test_copies_of_one_article_keep_their_text(spark):
    page = "<body><nav>m</nav><article><h1>Same</h1><p>The same article many times.</p></article></body>"
    rows = [(i, "http://copy.example/", page, "", "") for i in range(40)]
    assert {r["text"] for r in html_text.extract_pages(frame(spark, rows)).collect()} == {"Same The same article many times."}


def test_copies_and_shared_passages_of_pages_without_article(spark):
    own = "<div><h1>Same</h1><p>The same page many times.</p><ul><li>Item</li></ul></div>"
    rows = [(i, "http://copy.example/", f"<body><nav>menu {i}</nav>{own}</body>", "", "") for i in range(40)]
    for i in range(20):
        box = "<div><p>Subscribe</p><a href=/s>here</a></div>"
        rows.append((100 + i, f"http://body.example/{i}", f"<body>{box}<h2>Shared heading</h2><p>Shared passage.</p><div><p>Own {i}</p><ul><li>Salt</li><li>Spice {i}</li></ul></div></body>", "", ""))
    text = {r["page_id"]: r["text"] for r in html_text.extract_pages(frame(spark, rows)).collect()}
    assert all(text[i] == "Same The same page many times. Item" for i in range(40))
    assert all(text[100 + i] == f"Shared heading Shared passage. Own {i} Salt Spice {i}" for i in range(20))


def test_counts_against_a_plain_recount(spark):
    """Templates whose texts change from page to page, recounted per host in plain Python; the generator knows every article."""
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "iota"]) + str(rng.randrange(50))
    say = lambda n: " ".join(word() for _ in range(n))
    rows, truth = [], {}
    for host, pages in (("large.example", 40), ("copies.example", 30), ("small.example", 5)):
        article = say(20), say(30)
        for i in range(pages):
            if host != "copies.example":
                article = say(20), say(30)
            links = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randint(2, 6)))
            boxes = [f"<div class='banner n{i}'>{say(4)}</div>", f"<div class=side><ul>{links}</ul></div>", f"<section id=reply{i}><p>{say(6)}</p></section>", "<p>© all rights</p>"]
            rng.shuffle(boxes)
            inner = "<div><p>Subscribe now</p></div>" if host == "large.example" else ""
            page_id = len(rows)
            rows.append((page_id, f"http://{host}/{i}", f"<body>loose{boxes[0]}<div id=wrap>{boxes[1]}<article><h1>{article[0]}</h1>{inner}<p>{article[1]}</p></article>{boxes[2]}</div>{boxes[3]}</body>", "", ""))
            truth[page_id] = f"{article[0]} {article[1]}"
    seen, contents = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for _, url, source, *_ in rows:
        host = url.split("/")[2]
        hashes, content = html_text.subtrees(source)
        contents[host].add(content)
        for x in hashes:
            seen[host][x].add(content)
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(frame(spark, rows)).collect()}
    without = 0
    for page_id, url, source, *_ in rows:
        host = url.split("/")[2]
        known = len(contents[host]) >= html_text.MIN_PAGES
        template = {x for x, found in seen[host].items() if len(found) >= html_text.MIN_PAGES and len(found) >= html_text.MIN_SHARE * len(contents[host])}
        assert got[page_id] == html_text.extract(source, template if known else None) == truth[page_id]
        without += known and html_text.extract(source, ()) != truth[page_id]
    assert without == 40 and len(contents["copies.example"]) == 1


def test_empty_table(spark):
    assert html_text.extract_pages(frame(spark, [])).collect() == []
