import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.dom import flowing, parse, pieces
from millrace.llm.wrapper import Node, Wrapper, by_tags, main_text, matched, numbered, tree


def text_of(page):
    return flowing(pieces(parse(page)))


def test_html_as_it_is_found():
    assert text_of("<p>a<b>b</b>c<p>d &amp; e&nbsp;f<br>g") == "abc d & e f g"
    assert text_of("x < y <3 a<!-- <p>no --> b<script>if (a<b) '</p>'</script>c") == "x < y <3 a bc"
    assert text_of("<style>p{}</style><div class='ad'>no</div>yes &am") == "yes &am"
    assert text_of("<div>a<p>b</div>c</p><p title='>'>d") == "a b c d"
    assert text_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a b c d"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert text_of("cut off <a href='x") == "cut off" and text_of("") == "" and text_of("<script>never ends") == ""
    assert text_of("<nav>m</nav><header>h</header><main><header>t</header>x<footer>f</footer></main><aside>s</aside>") == "t x"
    assert text_of("<div class='page nav-open'><article>kept</article><div class='comments'><article>no</article></div></div>") == "kept"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "after"
    assert text_of(deep) == "deep after" and matched(tree(deep), tree(deep))[0] > 100


def plain_match(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_match(x, y))
    return 1 + best[-1][-1]


def test_simple_tree_matching():
    rng = random.Random(2)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "section", "b", "i"], k=rng.randint(0, 4)))

    for _ in range(60):
        a, b = tree(page(3)), tree(page(3))
        size, pairs = matched(a, b)
        assert size == plain_match(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)
        numbered(a), numbered(b)
        order = [(x.number, y.number) for x, y in pairs]
        assert order == sorted(order) and [y for _, y in order] == sorted(y for _, y in order)


def site(spark, n=30):
    rng = random.Random(1)
    prose = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        title, body = prose(4), [prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        # no article tag: the place of the content must be learnt
        page = (
            f"<html><head><title>{title}</title></head><body><div class='nav'>{prose(3)}</div><div class='tagline'>The same on all pages</div><div class='x'>"
            f"<div class='body'><h2>{title}</h2><span>Share this text</span>" + "".join(f"<p>{b}</p>" for b in body) + f"</div></div><div class='legal'>Fixed words</div><footer>{prose(5)}</footer></body></html>"
        )
        rows.append((i, f"http://Site.example/{i}", page))
        want[i] = " ".join([title, *body])
    return rows, want


def test_template_and_content_are_learnt(spark):
    rows, want = site(spark)
    alone = "<body><div class='tagline'>Only page</div><article><p>one</p></article><div class='sidebar'>no</div></body>"
    rows += [(100, "http://other.example/", alone), (101, None, None), (102, "http://site.example/z", ""), (None, "http://site.example/n", rows[0][2]), (5, rows[5][1], rows[5][2])]
    want |= {100: "one", 101: "", 102: "", None: want[0]}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).selectExpr("*", "'h' as host", "1 as row", "'v' as votes")
    out = main_text(df).select("row.*", "text").collect()
    assert len(out) == len(rows) and out[0].host == "h"
    assert {r.page_id: r.text for r in out} == want


def test_a_page_that_does_not_align_is_read_by_its_tags(spark):
    rows, _ = site(spark, 12)
    rows.append((50, "http://site.example/odd", "<main><p>odd</p></main><form>no</form>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in main_text(df).collect()}
    assert got[50] == "odd"


def test_a_wrapper_without_votes():
    w = Wrapper("<article>x</article>", [], 0.9)
    assert w.nodes[w.place].tag == "article" and w.read("<article>y<nav>z</nav></article>") == "y"
    assert isinstance(w.nodes[0], Node)


def nameless(n, form, hosts=3):
    """Pages without a tag or name that tells anything: menus are links, the notice is short or the same everywhere, a list
    of links stands in the content, and the comments are fewer words than the text."""
    rng = random.Random(3)
    prose = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(k))
    rows, want = [], {}
    for host in range(hosts):
        k1, k2, k3, k4 = (form.format("xyz"[host], x) for x in "abcd")
        for i in range(n):
            title, body = prose(5), [prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
            links = "".join(f"<li><a href='/{x}'>{prose(2)}</a></li>" for x in range(rng.randint(2, 5)))
            page = (
                f"<html><body><div class='{k1}'><ul>{links}</ul></div><div class='{k2}'>Welcome to our pages</div><div class='{k3}'>{prose(3)}</div>"
                f"<div class='{k4}'><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"<ul>{links}</ul></div><div class='{k3}'>{prose(6)}</div></body></html>"
            )
            rows.append((host * 1000 + i, f"http://{host}.example/{i}", page))
            want[host * 1000 + i] = " ".join([title, *body])
    return rows, want


@pytest.mark.parametrize("form", ["q{}{}", "7{}{}"])  # a name with a digit is none
def test_names_that_mean_nothing(spark, form):
    rows, want = nameless(20, form)
    rows.append((9000, "http://sole.example/", rows[0][2]))  # the only page of its host
    want[9000] = want[0]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.row.page_id: r.text for r in main_text(df).collect()}
    by_name = {i: by_tags(parse(page)) for i, _, page in rows}
    assert all(by_name[i] != want[i] for i in want)  # tags and names alone find none of them
    # the content of the sole page, too, has its place by the text it holds
    assert got == want


def test_an_aside_that_holds_the_text_is_content_whatever_its_name(spark):
    rng = random.Random(8)
    prose = lambda k: " ".join(f"w{rng.randrange(999)}" for _ in range(k))
    rows, want = [], {}
    for i in range(10):
        body = prose(300)
        rows.append((i, f"http://a.example/{i}", f"<body><div class='top'>{prose(2)}</div><div class='promo'><h1>T{i}</h1><p>{body}</p></div></body>"))
        want[i] = f"T{i} {body}"
    got = {r.row.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).select(F.col("text")).count() == 0
