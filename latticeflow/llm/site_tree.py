"""Main-text extraction with a site style tree.

The element trees of a host's pages are merged: nodes with equal paths of tags, classes and ids are one node, and its branch is the
node with all below it. Importance is by entropy over the pages that have the node, relative to the largest that so many pages allow:

* presentation: the entropy of the branch's styles, a style being the number of text blocks and the magnitude of their text on a page.
  A template's branch looks the same on every page and is near 0, an article's is near 1;
* content: 1 minus the mean entropy of the branch's texts over pages, 0 if every page has the same texts, 1 if each has its own;
* a branch's importance is their product; the names of some elements and classes lower it by a fixed prior.

A branch goes if its importance is far below that of the most important branch beside it, with all below it, unless no list names it
and none of its texts is on two pages: a page's own text stays however alike its pages look. Inside article and main
elements a block goes by its content alone, so headings and short paragraphs stay and a line repeated on the site's pages goes.
Nodes of too few pages cannot be judged: there, and only there, the lists of names decide.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, join_checked, small_batches

#: Pages that must have a node before it is judged; share of the importance of the most important branch beside it that a branch needs;
#: content importance that a text needs; factor on the importance of nodes that the lists name.
LEAST_PAGES, LEAST_SHARE, LEAST_CONTENT, PRIOR = 10, 0.6, 0.3, 0.75
#: Content importance from which a branch has no text that is on two pages.
OWN_TEXTS = 1 - 1e-9
#: Bytes of judged nodes up to which they are broadcast to the pages.
BROADCAST_BYTES = 48 << 20
#: Elements that begin a block, that by their name hold no main text, that have no end tag, whose content is no markup.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas object".split())
NOISE = frozenset("aside audio button canvas dialog fieldset footer form head iframe legend menu nav noscript object optgroup option search select svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promos promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola teaser toolbar widget".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Of the lists, what is never main text on any host, whatever its entropy: controls, forms, dialogs, metadata, comments of readers.
NEVER = frozenset("audio button canvas dialog fieldset form head iframe legend noscript object optgroup option search select svg template textarea title video".split())
NEVER_ROLES = frozenset("search form dialog alertdialog".split())
NEVER_WORDS = frozenset("comment comments disqus modal popup replies reply respond".split())
#: Kinds of nodes: open to judgement, named by the lists, never main text.
OPEN, NAMED, GONE = 0, 1, 2

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
#: Elements whose start ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _presentation(tag: str, attributes: str, in_main: bool) -> tuple[str, int]:
    """A node's name in the tree, and its kind."""
    kind = GONE if tag in NEVER else NAMED if tag in NOISE or (tag == "header" and not in_main) else OPEN
    if not attributes or not attributes.strip():
        return tag, kind
    label = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value).replace("/", "|")
            words = NAME.findall(value) if tag not in ("html", "body") else ()
            kind = max(kind, GONE if not NEVER_WORDS.isdisjoint(words) else NAMED if not NOISE_WORDS.isdisjoint(words) else OPEN)
        elif name == "role":
            kind = max(kind, GONE if value in NEVER_ROLES else NAMED if value in NOISE_ROLES else OPEN)
        elif name == "hidden" or value == "true":
            kind = GONE
    return tag + label, kind


def blocks(html: str | None) -> list[tuple[str, str, bool]]:
    """(path, text, in an article) of a page by itself, by the lists: if an article or main element has text, blocks elsewhere are left out."""
    out = [(p, t, m) for p, t, m, kind in all_blocks(html) if kind == OPEN]
    return [b for b in out if b[2]] or out


def all_blocks(html: str | None) -> list[tuple[str, str, bool, int]]:
    """(path, text, in an article, kind) of the page's blocks in order, without those that never are main text."""
    html = html or ""
    lower = None
    out: list[tuple[str, str, bool, int]] = []
    stack: list[tuple[str, str, int, bool]] = [("", "", OPEN, False)]  # tag, path, kind, in main
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            if stack[-1][2] != GONE:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((stack[-1][1], text, stack[-1][3], stack[-1][2]))
            parts.clear()

    while True:
        m = TOKEN.search(html, at)
        data = html[at : m.start()] if m else html[at:]
        if data and stack[-1][2] != GONE:
            parts.append(unescape(data) if "&" in data else data)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in MAIN and tag not in ("body", "html", "main", "article"):
                        break
            continue
        if tag in RAW:
            lower = html.lower() if lower is None and html.isascii() else lower
            end = (lower.find(f"</{tag}", at) if lower is not None else getattr(re.compile(f"</{tag}", re.I).search(html, at), "start", lambda: -1)())
            at = len(html) if end < 0 else end
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            if tag not in VOID and stack[-1][2] != GONE:
                _, kind = _presentation(tag, m[3], stack[-1][3])
                if kind != OPEN:  # an inline advert or notice: what follows up to its end is skipped
                    depth, close = 1, re.compile(rf"<(/?){re.escape(tag)}\b", re.I)
                    for e in close.finditer(html, at):
                        depth += -1 if e[1] else 1
                        if not depth:
                            at = e.start()
                            break
            continue
        flush()
        if tag == "hr":
            continue
        if stack[-1][0] == "p":
            stack.pop()
        for ended in ENDS.get(tag, ()):
            if stack[-1][0] == ended:
                stack.pop()
        name, kind = _presentation(tag, m[3], stack[-1][3])
        if m[3].rstrip().endswith("/") and tag in ("svg", "iframe"):
            continue
        path = stack[-1][1] if tag in ("html", "body") else f"{stack[-1][1]}/{name}"
        stack.append((tag, path, max(stack[-1][2], kind), stack[-1][3] or tag in MAIN))
    flush()
    return out


BLOCK = "node long, text string, main boolean, named boolean, feature long"
NODE = "up array<long>, named boolean, main boolean, fixed boolean, n int, size int"


def number(path: str) -> int:
    return xxh3_64_intdigest(path) - (1 << 63)


def page_tree(html: str | None) -> tuple[list[dict], list[dict]]:
    """A page's blocks, and its nodes: their ancestors from the root to themselves, and their style on this page.

    ``main``: strictly inside an article or main element; ``fixed``: a heading, or such an element itself.
    """
    found, nodes = [], {}
    for path, text, main, kind in all_blocks(html):
        found.append({"node": number(path), "text": text, "main": main, "named": kind == NAMED, "feature": number(text)})
        names, inside, up, here = path.split("/")[1:], False, [], ""
        for name in names or [""]:
            here = f"{here}/{name}" if name else ""
            up = [*up, number(here)]
            tag = re.split(r"[.#]", name, maxsplit=1)[0]
            one = nodes.get(here)
            if one is None:
                one = nodes[here] = {"up": up, "named": True, "main": inside, "fixed": tag in MAIN or tag in HEADINGS, "n": 0, "size": 0}
            one["named"] = one["named"] and kind == NAMED  # a branch is named if all its blocks are
            one["n"] += 1
            one["size"] += len(text)
            inside = inside or tag in MAIN
    for one in nodes.values():
        one["size"] = one["size"].bit_length()
    return found, list(nodes.values())


def parsed(pages: DataFrame, html: str = "html", keep: list[Column] | None = None) -> DataFrame:
    """Rows ``keep``, ``blocks`` and ``nodes``, as of ``page_tree``."""

    def trees(texts: pa.Array) -> pa.Array:
        got = [page_tree(h.as_py()) for h in texts]
        block = pa.struct([("node", pa.int64()), ("text", pa.string()), ("main", pa.bool_()), ("named", pa.bool_()), ("feature", pa.int64())])
        node = pa.struct([("up", pa.list_(pa.int64())), ("named", pa.bool_()), ("main", pa.bool_()), ("fixed", pa.bool_()), ("n", pa.int32()), ("size", pa.int32())])
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.list_(block)), pa.array([g[1] for g in got], pa.list_(node))], ["blocks", "nodes"])

    small_batches(pages.sparkSession)
    split = lambda fields: ", ".join(f"{a}:{b}" for a, b in (f.split(" ") for f in fields.split(", ")))
    tree = F.arrow_udf(trees, f"blocks array<struct<{split(BLOCK)}>>, nodes array<struct<{split(NODE)}>>")(F.col(html))
    own = keep or [F.col("page_id"), F.col("url")]
    out = pages.select(*own, tree.alias("__tree"))
    return out.select(*(F.col(f"`{c}`") for c in out.columns[:-1]), "__tree.blocks", "__tree.nodes")


def host(url: Column) -> Column:
    """The host of an address, lower-cased; empty for a null and where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def importance(trees: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_content: float = LEAST_CONTENT) -> DataFrame:
    """``(host, node, pages, presentation, content, importance, removed)`` for the nodes of ``trees`` (host, blocks, nodes) that at
    least ``least_pages`` pages have.

    Styles and texts are counted before the shuffle, by host and node, so a host with most of the pages is no bottleneck.
    """
    kind = ["host", "up", "named", "main", "fixed"]
    styles = trees.select("host", F.explode("nodes").alias("x")).groupBy("host", "x.up", "x.named", "x.main", "x.fixed", "x.n", "x.size").agg(F.count(F.lit(1)).alias("c"))
    styles = styles.groupBy("host", "up", "n", "size").agg(F.sum("c").alias("c"), F.min("named").alias("named"), F.max("main").alias("main"), F.max("fixed").alias("fixed"))
    whole = styles.groupBy("host", "up").agg(F.sum("c").alias("pages"), F.min("named").alias("named"), F.max("main").alias("main"), F.max("fixed").alias("fixed"), (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("entropy"))
    whole = whole.filter(F.col("pages") >= least_pages).withColumn("node", F.element_at("up", -1))
    whole = cut(whole.withColumn("presentation", F.when(F.col("pages") < 2, 1.0).otherwise(F.col("entropy") / F.log("pages"))).select(*kind, "node", "pages", "presentation"), "styles")

    features = F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["feature"].alias("feature"))))).alias("x")
    texts = trees.select("host", features).groupBy("host", "x.node", "x.feature").agg(F.count(F.lit(1)).alias("c"))
    texts = texts.groupBy("host", "node").agg(F.sum("c").alias("texts"), F.sum(F.col("c") * F.log("c")).alias("shared"))
    leaves = whole.join(texts, ["host", "node"]).withColumn("own", F.when(F.col("pages") < 2, 1.0).otherwise(1 - F.col("shared") / F.col("texts") / F.log("pages")))
    leaves = cut(leaves.select("host", "node", "up", "texts", "own"), "leaves")
    branches = leaves.select("host", F.explode("up").alias("node"), "texts", "own").groupBy("host", "node").agg((F.sum(F.col("texts") * F.col("own")) / F.sum("texts")).alias("content"))
    valued = whole.join(branches, ["host", "node"]).join(leaves.select("host", "node", "own"), ["host", "node"], "left")
    parent = F.when(F.size("up") > 1, F.element_at("up", -2)).otherwise(F.lit(0))
    valued = cut(valued.withColumn("importance", F.col("presentation") * F.col("content") * F.when(F.col("named"), PRIOR).otherwise(1.0)).withColumn("parent", parent), "valued")
    most = valued.groupBy("host", "parent").agg(F.max("importance").alias("most"))
    open_ = ~F.col("fixed") & (~F.col("main") | F.col("named"))
    repeats = F.col("named") | (F.col("content") < OWN_TEXTS)
    branch = open_ & repeats & (F.col("importance") < F.lit(least_share) * F.col("most"))
    low = F.col("branch") | F.coalesce(F.col("own") < least_content, F.lit(False))
    judged = cut(valued.join(most, ["host", "parent"]).withColumn("branch", branch).withColumn("low", low), "judged")
    above = judged.filter("branch").select("host", F.col("node").alias("top"))
    under = judged.filter("not main or named").select("host", "node", F.explode("up").alias("top")).join(above, ["host", "top"], "left_semi").select("host", "node").distinct().withColumn("under", F.lit(True))
    out = judged.join(under, ["host", "node"], "left")
    return out.select("host", "node", "pages", "presentation", "content", "importance", (F.col("low") | F.col("under").isNotNull()).alias("removed"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[Column] | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_content: float = LEAST_CONTENT) -> DataFrame:
    """Per page: ``keep``, ``text`` (the blocks left, joined by line feeds; empty if none) and ``n_chars``.

    Null and empty html is a page without a block; pages without a host form one site; repeated rows are pages of their own; whole
    pages of any length are read; an empty table gives an empty one. A block of a node that the tree did not judge stays if the lists
    do not name it and it is in an article or main element, or the page has none with text. A page of which the tree would leave
    nothing keeps what such an element has. Other columns are not read; ``keep`` may have any names.
    """
    own = keep or [F.col("page_id"), F.col("url")]
    trees = cut(parsed(pages, html, [*(c.alias(f"__k{i}") for i, c in enumerate(own)), host(F.col(url)).alias("host")]), "trees")
    judged = importance(trees, least_pages, least_share, least_content)
    judged = cut(judged.groupBy("host").agg(F.collect_set(F.expr("if(removed, node, null)")).alias("low"), F.collect_set(F.expr("if(removed, null, node)")).alias("fine")), "judged")
    held = int(judged.agg(F.coalesce(F.sum(F.size("low") + F.size("fine")) * 8 + F.count(F.lit(1)) * 100, F.lit(0))).first()[0])
    joined = join_checked(trees, judged, ["host"], "left", held, BROADCAST_BYTES)
    of = lambda name, b: F.array_contains(F.coalesce(name, F.array().cast("array<long>")), b["node"])
    article = F.exists("blocks", lambda b: b["main"] & ~b["named"])
    stays = lambda b: F.when(of("low", b), False).when(of("fine", b), True).otherwise(~b["named"] & (b["main"] | ~F.col("article")))
    joined = joined.withColumn("article", article).withColumn("left", F.filter("blocks", stays))
    left = F.when(F.col("article") & (F.size("left") == 0), F.filter("blocks", lambda b: b["main"] & ~b["named"])).otherwise(F.col("left"))
    names = pages.select(*own).columns
    out = joined.select(*(F.col(f"__k{i}").alias(n) for i, n in enumerate(names)), F.array_join(F.transform(left, lambda b: b["text"]), "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
