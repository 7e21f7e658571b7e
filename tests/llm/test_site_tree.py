import pytest

from latticeflow.llm import site_tree as T

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- x --><div class="ad">Buy</div><div id="cookie-notice">ok?</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp; block<br>goes on.<p>Second &lt;b&gt; block</p><form><input value="x">Search</form>Tail <span class="ad">spam <span>more</span></span>end
<ul><li>one<li>two</ul><section class="comments"><p>me first</p></section></article><aside>More</aside><footer>&copy; x</footer></body>"""


def texts(html):
    return [t for _, t, _ in T.blocks(html)]


def test_article_only():
    assert texts(PAGE) == ["A & B", "First block goes on.", "Second <b> block", "Tail end", "one", "two"]


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<article></article>", "</p></div>"])
def test_degenerate(html):
    assert texts(html) in ([], ["<"])


def test_plain_text_and_broken_markup():
    assert texts("just text &copy 1") == ["just text © 1"]
    assert texts("<div><p>a</div>b</p><p>c") == ["a", "b", "c"]
    assert texts("<p>x < y and <b>z") == ["x < y and z"]
    assert texts("<p>" + "w " * 100_000) == [" ".join(["w"] * 100_000)]


def test_low_importance_branches_go(spark):
    page = lambda i: (i, "http://Host.example/a", f"<body><div class=top>Menu one</div><div class=box><p>{'same' if i % 9 == 0 else f'text {i}'}</p></div><div class=end>Bye</div></body>")
    rows = [page(i) for i in range(40)] + [(100, "http://other.example/", "<body><div class=top>Menu one</div></body>"), (101, None, None), (None, "x", ""), (None, "x", "<p>q")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    got = T.extract(df).collect()
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    assert all(by[i] == ("same" if i % 9 == 0 else f"text {i}") for i in range(40))
    assert by[100] == "Menu one" and by[101] == ""
    assert sorted(r["text"] for r in got if r["page_id"] is None) == ["", "q"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert T.extract(df.limit(0)).count() == 0


def test_articles_are_never_pruned(spark):
    df = spark.createDataFrame([(i, "http://h/", "<article><p>the same</p></article><div>foot</div>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in T.extract(df).collect()} == {"the same"}


def test_boilerplate_in_articles_goes_and_text_beside_them_stays(spark):
    page = lambda i: f"<body><div class=top>Menu one</div><article><div class=box>Read more of us</div>{f'<p>text {i}</p>' if i % 2 else ''}</article><div class=body><p>beside {i}</p></div></body>"
    teaser = "<article><p>only here</p></article><div class=side>once</div>"
    rows = [(i, "http://h/", page(i)) for i in range(30)] + [(100, "http://few/", teaser)]
    got = {r["page_id"]: r["text"] for r in T.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\nbeside {i}" if i % 2 else f"beside {i}" for i in range(30)} | {100: "only here"}


def brute_importance(pages):
    """Presentation and content importance of every node of one host's pages, counted page by page."""
    import math
    from collections import Counter, defaultdict

    styles, texts, ups = defaultdict(Counter), defaultdict(Counter), {}
    for html in pages:
        found, nodes = T.page_tree(html)
        for n in nodes:
            styles[n["up"][-1]][n["n"], n["size"]] += 1
            ups[n["up"][-1]] = n["up"]
        for leaf, text in {(b["node"], b["text"]) for b in found}:
            texts[leaf][text] += 1
    pages_of = {k: sum(c.values()) for k, c in styles.items()}
    share = lambda counts, base: 1.0 if base < 2 else -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(base)
    own = {k: 1.0 if pages_of[k] < 2 else 1 - sum(c * math.log(c) for c in t.values()) / sum(t.values()) / math.log(pages_of[k]) for k, t in texts.items()}
    content = {}
    for k in styles:
        below = [leaf for leaf in texts if k in ups[leaf]]
        content[k] = sum(own[x] * sum(texts[x].values()) for x in below) / sum(sum(texts[x].values()) for x in below)
    return {k: (pages_of[k], share(list(styles[k].values()), pages_of[k]), content[k]) for k in styles}


def site(rng, i, article):
    """A page with a menu, an advert, reader comments and a foot line from a pool; the body has an article element or none."""
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    pool = [f"pooled line number {k} of the site" for k in range(9)]
    text = [words(rng.randint(3, 80)) for _ in range(rng.randint(1, 12))]
    body = f"<h1>{words(6)}</h1><div class=tag>Filed under news</div>" + "".join(f"<p>{t}</p>" for t in text)
    body = f"<article>{body}</article>" if article else f"<div class=story>{body}</div>"
    menu = "".join(f"<li><a href=/{k}>{rng.choice(pool).split()[k]}</a></li>" for k in range(4))
    said = "".join(f"<p>{words(rng.randint(3, 80))}</p>" for _ in range(rng.randint(0, 5)))
    return f"<html><body><div class=top><ul>{menu}</ul></div><div class=box0>{rng.choice(pool)}</div>{body}<section class=comments>{said}</section><div class=end>{rng.choice(pool)}</div></body></html>", text


@pytest.mark.parametrize("article", [True, False])
def test_importance_equals_brute_force_and_decides(spark, article):
    import random

    rng = random.Random(7)
    made = [site(rng, i, article) for i in range(60)]
    rows = [(i, "http://h/", html) for i, (html, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trees = T.parsed(df, keep=[T.F.col("page_id"), T.host(T.F.col("url")).alias("host")]).cache()
    got = {r["node"]: (r["pages"], r["presentation"], r["content"]) for r in T.importance(trees, least_pages=1).collect()}
    want = brute_importance([h for h, _ in made])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)

    out = {r["page_id"]: r["text"].split("\n") for r in T.extract(df).collect()}
    for i, (_, text) in enumerate(made):
        assert out[i][1:] == text and len(out[i][0].split()) == 6  # the heading, then the paragraphs; no menu, advert, label, comment or foot
    off = {r["page_id"]: r["text"] for r in T.extract(df, least_share=-1.0, least_content=-1.0).collect()}
    assert all("pooled line" in t and "Filed under news" in t for t in off.values())


def test_pages_without_a_host_long_pages_and_clashing_names(spark):
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "no address", long, 1, 2), (2, None, None, 1, 2), (2, None, "<p>a", 1, 2)], "page_id long, url string, html string, blocks int, nodes int")
    got = sorted((r["page_id"], r["blocks"], r["n_chars"], r["text"]) for r in T.extract(df, keep=[T.F.col("page_id"), T.F.col("blocks")]).collect())
    assert [g[:2] for g in got] == [(1, 1), (2, 1), (2, 1)] and got[0][3].count("\n") == 29_999 and got[2][3] == "a"
