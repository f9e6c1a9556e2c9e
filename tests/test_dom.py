"""Trees, selectors and learned patterns against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import learning, patterns
from docketlake.sources import dom

PAGES = [
    '<html><head><title> T </title><style>p{}</style><script>var a="</p>"</script></head><body><nav id="top" class="menu main"><ul><li><a href="/a">A</a><li><a href="b.pdf" rel="x next">B <b>b</b></a></ul></nav>'
    '<article class="content"><h1>Head</h1><nav>inner</nav><p>One<p>Two <i>it</i><div class="content x"><p>Three</p><template>no</template></div><footer>f</footer></article><aside>side</aside><footer class="footer">end</footer></body></html>',
    "<body><div class='title'></div><div class='title'>second</div><header>h</header><div id='content'>text &amp; more<br>line</div></body>",
    "<div><div class='a b'><span>1</span><div class='a'><span>2</span></div></div></div><span>3</span>", "", "plain text", "<p>unclosed <b>bold <p>next</body>", "</div><table><tr><td>1<td>2<tr><th>3</table>",
]
SELECTORS = ["a", "li a", "nav > a", "ul > li > a", ".content", "article.content p", "article > p", ".content .x > p", "#top a[href]", 'a[href$=".pdf"]', 'a[rel~="next"]', "[class*=main]", "div.a span", "div > div > span", "*", "h1, .title, title", "a[href^='/']", "body *", "div div", "td", "nav#top.menu li", 'a[href="b.pdf"] b']


class Node:
    def __init__(self, n, tree, above):
        self.n, self.above, self.tag = n, above, tree["tag"][n]
        self.at = tree["attributes"][n]


def plain_tree(html):
    """The same elements with pointers upwards."""
    tree = dom.parse_tree(html)
    out = []
    for n, p in enumerate(tree["parent"]):
        out.append(Node(n, tree, out[p] if p >= 0 else None))
    return tree, out


def plain_step(node, step):
    name, rest = dom.STEP.fullmatch(step).groups()
    if name not in (None, "*") and node.tag != name:
        return False
    for p in dom.PART.finditer(rest):
        value = next((x for x in (p[5], p[6], p[7]) if x is not None), "")
        if p[1] == "#" and node.at.get("id") != p[2] or p[1] == "." and p[2] not in node.at.get("class", "").split():
            return False
        if p[3]:
            own = node.at.get(p[3])
            if own is None or not {None: True, "=": own == value, "^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own, "~=": value in own.split()}[p[4]]:
                return False
    return True


def plain_select(nodes, selector):
    def meets(node, steps):
        if not plain_step(node, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        up = node.above
        while up is not None:
            if meets(up, steps[:-1]):
                return True
            if steps[-1][0] == ">":
                return False
            up = up.above
        return False

    import re

    chains = [re.findall(r"\s*(>|\s)\s*((?:[^\s>\[]|\[[^\]]*\])+)", " " + s.strip()) for s in selector.split(",")]
    return [n.n for n in nodes if any(meets(n, c) for c in chains)]


@pytest.fixture(scope="module")
def trees(spark):
    return dom.parsed(spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")).persist()


def test_selectors(trees):
    got = trees.select("i", *[dom.select(F.col("tree"), s).alias(f"s{k}") for k, s in enumerate(SELECTORS)]).collect()
    for r in got:
        _, nodes = plain_tree(PAGES[r["i"]])
        for k, s in enumerate(SELECTORS):
            assert r[f"s{k}"] == plain_select(nodes, s), (r["i"], s)
    assert sum(len(r["s5"]) for r in got) > 0 and any(r["s17"] for r in got)
    for bad in ("", "a:hover", "a + b", "[x", "a >", "> a"):
        with pytest.raises(ValueError):
            dom.select(F.col("tree"), bad)


def test_any_tree(spark):
    """Ranges are what a walk over pointers finds, whatever the nesting."""
    r = random.Random(4)
    pages = []
    for _ in range(40):
        parts = []
        for _ in range(r.randrange(30)):
            tag = r.choice(["div", "p", "li", "span", "td"])
            parts.append(r.choice([f"<{tag} class='{r.choice('abc')} {r.choice('ab')}'>", f"</{tag}>", "t", "<br>"]))
        pages.append("".join(parts))
    rows = dom.parsed(spark.createDataFrame(list(enumerate(pages)), "i int, html string"))
    chains = [" ".join(r.choice(["div", ".a", "span.b", "*", "p > .c", "li", "> td"]) for _ in range(r.randrange(1, 4))).lstrip("> ") for _ in range(8)]
    for x in rows.select("i", *[dom.select(F.col("tree"), c).alias(f"s{k}") for k, c in enumerate(chains)]).collect():
        _, nodes = plain_tree(pages[x["i"]])
        assert [x[f"s{k}"] for k in range(len(chains))] == [plain_select(nodes, c) for c in chains]


def test_texts(trees):
    t = F.col("tree")
    rows = {r["i"]: r for r in trees.select("i", dom.title(t).alias("title"), dom.main_content(t).alias("main"), dom.page_content(t).alias("page"), dom.page_content(t, "aside").alias("own")).collect()}
    assert [rows[i]["title"] for i in range(4)] == ["Head", "", "", ""]
    assert rows[0]["main"] == "Head One Two it Three" and rows[1]["main"] == "second h text & more line" and rows[3]["main"] == "" == rows[4]["main"]
    assert rows[0]["page"] == "Head\ninner\nOne\nTwo\nit\nThree\nf" and rows[0]["own"] == "side" and rows[1]["page"] == "text & more\nline"
    assert rows[5]["page"] == "unclosed\nbold\nnext" and rows[2]["page"] == "1\n2"


def test_items(trees):
    t = F.col("tree")
    got = trees.where("i = 0").select(dom.items(t, dom.select(t, "li"), F.lit("http://h.org/x/")).alias("x"), dom.items(t, dom.select(t, "li a"), F.lit("http://h.org/x/"), 1).alias("y")).first()
    assert [tuple(x) for x in got["x"]] == [("A", "http://h.org/a"), ("Bb", "b.pdf")] and [tuple(x) for x in got["y"]] == [("A", "http://h.org/a")]


LISTING = "<html><body><div class='menu'><a href='/home'>Home</a></div><ul class='list big'>{}</ul><div><p><a href='/about'>About</a></p></div></body></html>"


def test_patterns_learnt_on_some_pages_read_the_others(spark):
    make = lambda s, k: LISTING.format("".join(f"<li class='item'><a href='/{s}/{k}/{j}'>Item {j}</a></li>" for j in range(3 + k)))
    other = lambda k: f"<body><table>{''.join(f'<tr><td><a href=/t/{k}/{j}>R{j}</a></td></tr>' for j in range(2))}</table><a href='/x'>x</a></body>"
    rows = [(10 * s + k, s, f"http://s{s}.org/", make(s, k) if s < 2 else other(k)) for s in range(3) for k in range(4)]
    pages = dom.parsed(spark.createDataFrame(rows, "page_id int, source_id int, url string, html string")).drop("html").persist()
    known = pages.where("page_id % 10 < 2")
    examples = spark.createDataFrame([(p, f"/{s}/{p % 10}/{j}" if s < 2 else f"/t/{p % 10}/{j}") for p, s, _, _ in rows if p % 10 < 2 for j in range(2)], "page_id int, href string")
    found = patterns.induced(known, examples)
    assert {r["source_id"]: r["pattern_value"] for r in found.collect()} == {0: "html > body > ul.list > li.item > a", 1: "html > body > ul.list > li.item > a", 2: "body > table > tr > td > a"}
    none = spark.createDataFrame([], "source_id int, pattern_id string, pattern_value string, success_count long, failure_count long")
    held = patterns.learned(none, found)
    assert [r["confidence"] for r in held.collect()] == [1.0] * 3
    out = patterns.tried(pages.where("page_id % 10 >= 2"), held)
    got = {r["page_id"]: [tuple(x) for x in r["items"]] for r in out.collect()}
    for p, s, u, _ in rows:
        if p % 10 >= 2:
            k = p % 10
            want = [(f"Item {j}", f"{u}{s}/{k}/{j}") for j in range(3 + k)] if s < 2 else [(f"R{j}", f"{u}t/{k}/{j}") for j in range(2)]
            assert got[p] == want
    totals = learning.use_totals(patterns.outcomes(out), "pattern_id").collect()
    assert sorted((r["success_count"], r["confidence"], r["avg_items"]) for r in totals) == [(2, 1.0, 2.0), (2, 1.0, 5.5), (2, 1.0, 5.5)]
    again = patterns.learned(held, found)
    assert [r["success_count"] for r in again.collect()] == [2] * 3
    pages.unpersist()


def test_first_pattern_that_finds_any_wins(spark):
    pages = dom.parsed(spark.createDataFrame([(1, "s", "http://h/", "<body><ul><li><a href='/1'>1</a></ul></body>"), (2, "t", "http://h/", "<p>")], "page_id int, source_id string, url string, html string"))
    held = spark.createDataFrame([("s", "p1", "table > a", 0.99), ("s", "p2", "li > a", 0.9), ("s", "p3", "a", 0.95), ("s", "p0", "a", 0.5)], "source_id string, pattern_id string, pattern_value string, confidence double")
    got = {r["page_id"]: (r["pattern_id"], len(r["items"])) for r in patterns.tried(pages, held).collect()}
    assert got == {1: ("p3", 1), 2: (None, 0)}
    assert {r["page_id"]: r["pattern_id"] for r in patterns.tried(pages, held, tries=1).collect()} == {1: None, 2: None}
