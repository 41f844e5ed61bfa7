import html as H
import random
import re

from pyspark.sql import types as T

from llm_fixtures import prose
from wardrank.llm import queries
from wardrank.llm.wrapper import Node, content_of, extract, fold, joined, matches, merge, read_page


def text_of(page, wrapper=None):
    read = read_page(page)
    return joined(read.nodes, read.breaks, read.texts, content_of(read.tree, wrapper or read_page(page).tree))


def node(label, *kids):
    return Node((label, False, False, 9), list(kids), [])


def test_simple_tree_matching():
    def plain(a, b):  # of two nodes of one label
        if not a or not b:
            return 0
        whole = 1 + plain(a[-1].kids, b[-1].kids) if a[-1].says == b[-1].says else 0
        return max(plain(a[:-1], b), plain(a, b[:-1]), plain(a[:-1], b[:-1]) + whole)

    rng = random.Random(2)

    def tree(depth):
        return node(rng.choice("abc"), *(tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)))

    for _ in range(300):
        a, b = tree(3), tree(3)
        total, pairs = matches(a.kids, b.kids)
        assert total == plain(a.kids, b.kids)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        assert total == sum(1 + plain(a.kids[i].kids, b.kids[j].kids) for i, j in pairs)
        if a.says == b.says:
            n = a.size + b.size - 1 - total
            assert merge(a, b).size == n


def test_fold():
    p = [node(x) for x in "aaabcbcbcd"]
    assert [x.says[0] for x in fold(p)] == ["a", "b", "c", "d"]
    many = fold([node("li", node("a")), node("li"), node("li", node("a"), node("b"))])
    assert len(many) == 1 and [x.says[0] for x in many[0].kids] == ["a", "b"]


def test_markup():
    assert text_of(None) == "" and text_of("") == ""
    assert text_of("<p>one <b>tw</b>o<p>three<br>four &amp; &lt;five&gt; &eacute;&#233;&nbsp; six") == "one two three four & <five> éé six"
    assert text_of("<p>a<!-- x > y -->b <!DOCTYPE html> c <script>var t='</p>';</script>d</p><style>p{}</style>e") == "ab c d e"
    assert text_of("<article><p>x < y and 1<2 </article>") == "x < y and 1<2"
    assert text_of("<article><p title='a>b' x=\"</article>\">in</p></article>") == "in"
    assert text_of("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>") == "a b c d e f g"
    assert text_of("<article>a<span class=ad>no<span>no</span>no</span>b<i>c</i></article>") == "abc"
    assert text_of("<article>" + "<div>" * 3000 + "deep<script>no</script>" + "</div>" * 3000 + "on</article>") == "deep on"
    assert text_of("<article>kept <a href='x'>link</a> <button>no</button><svg/> on <noscript>no</noscript></article><p>after") == "kept link on"
    assert text_of("<article><p>cut <a href=\"x") == "cut"
    assert text_of("<title>no <b>x</title><p>yes") == "yes"


CHROME = ["<nav><ul><li><a href=/a>Home {r}</a></li><li><a href=/b>News {r}</a></li></ul></nav>", '<div class="menu-main">Menu {r}</div>',
          '<div id="sidebar-2"><p>Side {r}</p></div>', '<div class="cookie-notice">We use cookies {r}</div>', '<aside>About {r}</aside>',
          '<header class="site-header"><h1>The Site</h1>{r}</header>', '<form action=/s><label>Search {r}</label><input name=q></form>',
          '<div class="ad">Buy {r}</div>', '<p class="promo">Offer {r}</p>', "<script>track('{r}')</script>"]
TAIL = ['<footer>&copy; {r} all rights</footer>', '<section id="comments"><article class="comment"><p>Nice {r}</p></article></section>',
        '<div class="related-posts"><a href=/c>More {r}</a></div>', '<div class="newsletter">Subscribe {r}</div>']
BODIES = ["<article>{x}</article>", "<main><div>{x}</div></main>", '<div class="post-content">{x}</div>', '<div id="content"><div>{x}</div></div>',
          '<div class="wrap"><div class="col-8">{x}</div></div>', '<div itemprop="articleBody">{x}</div>']


def site(rng, k, n):
    """Pages of one template and their main text."""
    head, tail = rng.sample(CHROME, rng.randrange(2, 8)), rng.sample(TAIL, rng.randrange(1, 4))
    constant = '<div class="strap">The paper of record</div>'
    body = BODIES[k % len(BODIES)]
    out = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(4, 40)).replace("\n", " \n ") for _ in range(rng.randrange(1, 9))]
        inner = f"<h1>{H.escape(parts[0])} {i}</h1>" + "".join(
            f"<p>{H.escape(p)}{rng.choice(['</p>', '', '<br>'])}" for p in parts[1:])
        around = lambda xs: "".join(x.replace("{r}", prose(rng, 3)) for x in xs)
        page = (f"<!DOCTYPE html><html><head><title>{parts[0]}</title></head><body class='has-sidebar'>{around(head)}{constant}"
                f"{body.replace('{x}', inner)}{around(tail)}</body></html>")
        out.append((page, " ".join(f"{parts[0]} {i} {' '.join(parts[1:])}".split())))
    return out


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_sites(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(12):
        for page, text in site(rng, k, 9):
            want[len(rows)] = text
            rows.append((len(rows), f"http://U@Host{k}.example:80/p/{len(rows)}?q=1", page))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(5), fan_in=2, held=1).collect()}
    assert got == want


def test_constant_nodes(spark):
    """Copies keep their text; what all pages of an unmarked template share goes."""
    rng = random.Random(1)
    copies = [(i, "http://copies.example/", site(random.Random(3), 0, 1)[0][0]) for i in range(20)]
    words = [prose(rng, 30) for _ in range(10)]
    shared = [(100 + i, "http://shared.example/", f"<div>Daily</div><div class=x><p>{H.escape(w)}</p></div><div class=y>All rights</div>")
              for i, w in enumerate(words)]
    out = extract(spark.createDataFrame(copies + shared, SCHEMA)).collect()
    got = {r.page_id: r.text for r in out}
    assert {got[i] for i in range(20)} == {site(random.Random(3), 0, 1)[0][1]}
    assert [got[100 + i] for i in range(10)] == [" ".join(w.split()) for w in words]


def test_given_pages(spark):
    """The given pages against a plain pattern."""
    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return " ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|pre|ul|li|div)\b[^>]*>", " ", inner))).split())

    sf = "/root/testdata/sf0.001"
    html = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op13_html_text(spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(html)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (html[r.page_id][0], plain(html[r.page_id][1]), len(r.text))


def test_cases(spark):
    extra = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("text", "host", "row", "shape", "stats", "key", "nodes"))])
    more = ("t", "h", "r", "s", "st", "k", "n")
    rows = [(1, None, None, *more), (1, None, None, *more), (None, "not a url", "", *more), (2, "http://a.example", "<p>x" + " y" * 200_000, *more),
            (3, "http://a.example", "<p>z", *more)]
    out = extract(spark.createDataFrame(rows, extra))
    assert out.columns == ["page_id", "url", "host", "row", "shape", "stats", "key", "nodes", "text"]
    assert sorted((r.page_id or 0, len(r.text), r.host) for r in out.collect()) == [(0, 0, "h"), (1, 0, "h"), (1, 0, "h"), (2, 400_001, "h"), (3, 1, "h")]
    none = extract(spark.createDataFrame([], extra))
    assert none.collect() == [] and none.columns == out.columns
