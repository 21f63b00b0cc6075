import html
import re

from edge_rows import SMALL

from corpusprep.llm import queries as Q
from corpusprep.llm.html_text import Page, extract, host_of, main_text, style_tree


def test_query_equals_the_articles(spark):
    """The pages' articles, taken by plain patterns that fit these tables."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = Q.op7_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><script>var a="</p><article>x</article>";</script><style>p{}</style></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href="a>b">Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <article>no</article> --><main><article>
<header><h1>The &amp; title&nbsp;here</h1></header><p>First <b>bold</b>text
 with  space<br>and break.<p>Second &lt;p&gt; &#233;&#x41; &unknown; 1 < 2 end.<ul><li>one<li>two</ul>
<div class="ad">Buy</div><form>Name <input></form><aside>side</aside><table><tr><td>c1<td>c2</table>
<section id="comments"><p>Great post!</p></section><div class="share">Share me</div></article></main>
<div id="sidebar">links</div><footer>&copy; x</footer></body>"""


def test_one_page():
    assert main_text(PAGE).split("\n") == ["The & title here", "First boldtext with space and break.", "Second <p> éA &unknown; 1 < 2 end.", "one", "two", "c1", "c2"]
    for broken in (None, "", "<", "<p", "text only", "<p>a<p>b", "a<!-- open", "<script>x", "</div>x</p>", "<a b='>", "<p>x<b", "&#0;&#xD800;&amp"):
        assert isinstance(main_text(broken), str)
    assert main_text("text only") == "text only" and main_text("<p>a<p>b") == "a\nb" and main_text("x</div>y") == "xy"
    assert main_text("<article>" * 3000 + "deep" + "</article>" * 3000) == "deep"


def test_names_on_what_holds_the_main_part():
    text = "<h1>Title</h1><p>The whole story is told here.</p>"
    want = "Title\nThe whole story is told here."
    for name in ("single right-sidebar", "no-sidebar", "has-banner", "post comments-open", "sidebar", "widget banner", "fixed-header", "header", "search"):
        for page in (f'<body class="{name}"><article>{text}</article></body>', f'<body class="{name}">{text}</body>', f'<html class="{name}"><body>{text}</body></html>',
                     f'<body><article class="{name}">{text}</article></body>', f'<body><main id="{name}">{text}</main><p>Else</p></body>',
                     f'<body><div class="{name}"><div><article>{text}</article></div></div><p>Else</p></body>', f'<body><div class="{name}"><main>{text}</main></div></body>',
                     f'<body><div class="{name}"><div class="content">{text}</div></div></body>'):
            assert main_text(page) == want, page
    for name in ("no-sidebar", "has-banner", "comments-open", "right-sidebar"):
        assert main_text(f'<body><div class="{name}">{text}</div></body>') == want, name
    for name in ("sidebar", "site-footer", "cookie-notice", "share_buttons", "comments-area", "widget widget_text", "ad-2", "masthead"):
        assert main_text(f'<body><div class="{name}"><p>Noise</p></div><div>{text}</div></body>') == want, name
        assert main_text(f'<body><article>{text}</article><div class="{name}"><article>Card</article><div class="content">Else</div></div></body>') == want, name
    assert main_text(f'<main>{text}<div id="comments"><article class="comment-body">Nice!</article></div></main>') == want


def test_style_tree_without_landmarks(spark):
    """Branches that are alike on the pages of a host go, also where nothing names them."""
    def page(k):
        return (f"<body><div class=top>Site of things<br>Old news</div><div class=x1><h2>Title {k} of {k * 7}</h2><p>Story {k} about {k * k}.</p></div>"
                f"<div class=x2><p>Call now!</p><p>Only today</p></div></body>")
    rows = [(k, f"http://a.example.com/{k}", page(k)) for k in range(8)] + [(100, "http://b.example.com/", page(0)), (101, None, page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for k in range(8):
        assert got[k] == f"Title {k} of {k * 7}\nStory {k} about {k * k}."
    assert got[100].startswith("Site of things") and got[101].endswith("Only today")  # too few pages to tell
    tree = {(r["host"], r["node"]): r for r in style_tree(df).collect()}
    assert tree["a.example.com", ">body>div.top"]["importance"] < 0.01 and tree["a.example.com", ">body>div.x1"]["pages"] == 8


def test_promotion_in_all_articles_of_a_host(spark):
    def page(k, copied=False):
        story = "A copied story that all pages tell in the same words." if copied else f"Story {k} about {k * k} things that no other page has."
        return f"<body><article><h1>Title {k}</h1><h2>Summary</h2><p>{story}</p><p>{story} Part {'two' if copied else k + 100}.</p><p>Buy our book now!</p></article></body>"
    rows = [(k, f"http://a.example.com/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://c.example.com/{k}", page(k, True)) for k in range(12)]
    rows += [(200 + k, f"http://few.example.com/{k}", page(k)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        story = f"Story {k} about {k * k} things that no other page has."
        assert got[k] == f"Title {k}\nSummary\n{story}\n{story} Part {k + 100}."
        assert got[100 + k].endswith("Buy our book now!") and "A copied story" in got[100 + k]  # copies stay whole
    assert all(got[200 + k].endswith("Buy our book now!") for k in range(3))


def test_importance_by_definition(spark):
    import math
    pages = [f"<body><div class=m>{'same' if k < 4 else f'own {k}'}</div></body>" for k in range(6)]
    df = spark.createDataFrame([(k, "http://h/", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    r = {x["node"]: x for x in style_tree(df).collect()}[">body>div.m"]
    content = (4 * (1 - math.log(4) / math.log(6)) + 2 * 1) / 6
    assert abs(r["content"] - content) < 1e-9 and abs(r["presentation"]) < 1e-9 and abs(r["importance"] - 0.9 * content) < 1e-9


def test_edge_rows(spark):
    rows = [(1, None, None), (None, "x", ""), (2, "http://h/", "<p>a</p>"), (2, "http://h/", "<p>a</p>"), (3, "http://H:80/x", "<p>" + "w " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", host_of("url")).withColumn("host", host_of("url"))
    got = sorted(((r["page_id"] or -1), r["n_chars"]) for r in extract(df).collect())
    assert got == [(-1, 0), (1, 0), (2, 1), (2, 1), (3, 99_999)]
    assert extract(df.limit(0)).count() == 0
    assert [r[0] for r in df.select("text").collect()] == ["?", "?x", "h", "h", "h"]
    assert Page("<p>a").blocks[0][1] == "a"


def test_random_sites_equal_brute_force(spark):
    """The style tree by its definition, over hosts whose branches nothing names; it really removes
    branches, nested ones too."""
    import math
    import random
    from collections import defaultdict

    rng = random.Random(4)
    rows = []
    for host in ("a.example", "b.example", "c.example"):
        fixed = {n: "".join(f"<p>{host} {n} line {k}</p>" for k in range(rng.randint(1, 3))) for n in range(5)}

        def branch(n, depth, page):
            own = fixed[n] if rng.random() < 0.85 else f"<p>{host} page {page} branch {n} {rng.random()}</p>"
            inner = branch((n + 1) % 5, depth + 1, page) if depth < 3 and rng.random() < 0.6 else ""
            return f'<div class="z{n}">{own}{inner}</div>' + (f"<div class=y{n}><h3>Story {page} {rng.random()}</h3></div>" if rng.random() < 0.5 else "")
        for page in range(rng.choice([4, 9, 14])):
            rows.append((len(rows), f"http://{host}/{page}", "<body>" + "".join(branch(n, 0, page) for n in range(3)) + f"<p>Own words {page}</p></body>"))
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    removed = 0
    for host in {u.split("/")[2] for _, u, _ in rows}:
        pages = {i: Page(x) for i, u, x in rows if u.split("/")[2] == host}
        blocks, styles = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
        for i, p in pages.items():
            below = defaultdict(set)
            for node, text, _, _ in p.blocks:
                path = p.path(node)
                while path:
                    below[path].add(text)
                    path = path.rpartition(">")[0]
            names = {p.path(k): k for k in range(len(p.nodes))}
            for path, texts in below.items():
                for t in texts:
                    blocks[path][t].add(i)
                steps = p.children.get(names[path], [])
                styles[path][tuple(x for k, x in enumerate(steps) if not k or steps[k - 1] != x)].add(i)
        low = set()
        for path in blocks:
            m = sum(len(v) for v in styles[path].values())
            if m < 5:
                continue
            shares = [len(v) / m for v in styles[path].values()]
            presentation = -sum(x * math.log(x) for x in shares) / math.log(m)
            ds = [len(v) for v in blocks[path].values()]
            content = sum(d * (1 - math.log(d) / math.log(m)) for d in ds) / sum(ds)
            g = 0.9 ** len(shares)
            if (1 - g) * presentation + g * content < 0.2:
                low.add(path)
        for i, p in pages.items():
            kept = [t for n, t, _, _ in p.blocks if not any(p.path(n) == x or p.path(n).startswith(x + ">") for x in low)]
            removed += len(p.blocks) - len(kept)
            assert got[i] == "\n".join(kept), (host, i)
    assert removed > 50


def test_no_markup_takes_long():
    from time import monotonic

    from corpusprep.llm.html_text import _features
    from corpusprep.llm.language import BUCKETS, TextModel
    start = monotonic()
    for page in ("<div><p>x" * 100_000, "<a " * 100_000, '<a "' * 100_001, '<a "' * 100_001 + ">", "<a " * 100_000 + '" >', "<li></li>" * 50_000,
                 "<ul><div>" * 20_000 + "<li></li>" * 50_000, "</b1>" * 100_000 + "<div>" * 100_000 + "</x>" * 100_000, "<p " + "a" * 300_000 + " =>x",
                 "<script></script " * 50_000, "<x '\"" * 50_000, "<!-- " * 100_000, "<![CDATA[" * 100_000):
        assert len(list(_features([("h", page)]))) < 1000
    import numpy as np
    model = TextModel(["a", "b"], np.ones((2, BUCKETS)))
    assert model.score("some words " * 100_000)[1] > 1_000_000
    assert monotonic() - start < 120
    deep = "<div>" * 70 + "<article>deep</article>"
    assert main_text(deep) == "deep" and len(Page(deep).nodes) == 65
