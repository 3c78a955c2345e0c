"""Main text of web pages: boosted trees over DOM nodes, decoded so that no node contradicts its ancestors.

A tolerant parser turns a page into its block elements. Every block gets
features of its own and of its subtree (text and link density, depth, tag,
sibling statistics), and the evidence of the tokens in its class, id and role
attributes and in those of its ancestors. Gradient-boosted trees (MLlib) give
each block a log-odds of being main text. The decoder then chooses for each
subtree, bottom-up, the best of: all kept, all dropped, or its own text by its
own sign and each child by itself at a fixed cost.

Trees are trained on pages composed here from texts of the caller's table and
common page furniture, so every block has a known label; a table of own
labelled blocks can take their place.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanyalah.llm.vectors import least_hashes

TRAINING_TEXTS = 500
TREES, DEPTH = 20, 5
MIXED_COST = 1.0
BATCH_PAGES = 256

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title head".split())
# Formulas, drawings and fallback content are text of the block around them.
EMBEDDED = frozenset("noscript object canvas audio video math svg".split())
MATHS = frozenset("mi mn mo ms mtext mrow mfrac msub msup msubsup msqrt mroot mfenced menclose munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd mspace mstyle mpadded mphantom merror maction semantics annotation annotation-xml".split())
DRAWN = frozenset("g defs symbol use text tspan textpath desc metadata foreignobject image switch view path rect circle ellipse line polyline polygon marker pattern mask clippath filter lineargradient radialgradient stop animate animatetransform set".split())
INLINE = EMBEDDED | MATHS | DRAWN | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}
GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div", "article main section", "nav", "aside", "header", "footer", "form fieldset button select option legend", "table tbody thead tr td th", "figure figcaption", "blockquote pre", "body html")
ABOVE = ("article main", "nav", "aside", "header", "footer", "form", "li", "table")
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
_ABOVE = {tag: k for k, tags in enumerate(ABOVE) for tag in tags.split()}

# A tag up to its end, or up to the next tag where it has none; quotes count after an equals sign only.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(>?)""", re.S)
MARKUP = re.compile(r"<[a-zA-Z!?/]")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|data-main|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")
N_OWN = 12
FEATURES = N_OWN + len(GROUPS) + len(ABOVE) + 4


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "main", "pieces", "depth", "order", "linked", "inline")

    def __init__(self, tag, parent, tokens=(), main=False):
        self.tag, self.parent, self.tokens, self.main = tag, parent, tokens, main
        self.children, self.pieces, self.linked, self.inline = [], [], 0, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    tokens, main = [], False
    for name, value in ATTRIBUTE.findall(raw) if raw.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "data-main":
            main = True
        elif name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                tokens.append("hidden")
        elif name == "style":
            if "none" in value.lower() and "display" in value.lower():
                tokens.append("hidden")
        else:
            tokens += [t.lower() for t in NAME_PART.findall(value)]
    return tuple(tokens), main


def _mark(page: str, at: int) -> int:
    """The next place from `at` where markup begins, or the end; a sign before anything but a name is text."""
    found = MARKUP.search(page, at)
    return found.start() if found else len(page)


def _behind(page: str, end: str, at: int) -> int:
    """The place behind the next `end`, or the page's end."""
    found = page.find(end, at)
    return len(page) if found < 0 else found + len(end)


def parse(page: str) -> list[Node]:
    """Block nodes of a page in page order; texts stay with the nearest block, with their place among all pieces.

    Every place of the page is read a bounded number of times, whatever is left open.
    """
    root = Node("body", None)
    nodes, stack, links = [root], [root], 0
    at, place, n = 0, 0, len(page)

    def text(piece: str) -> None:
        nonlocal place
        if piece:
            place += 1
            node = stack[-1]
            node.pieces.append((place, piece))
            if links:
                node.linked += len(piece.strip())

    def close(to: int) -> None:
        for node in stack[to:]:
            open_[node.tag] -= 1
        del stack[to:]

    open_: Counter[str] = Counter()
    headless = False
    while at < n:
        start = _mark(page, at)
        text(page[at:start])
        if start == n:
            break
        found = TAG.match(page, start)
        if not found:
            at = _behind(page, "-->", start + 4) if page.startswith("<!--", start) else _behind(page, ">", start)
            continue
        at = found.end()
        if at == n and not found[4]:
            # A tag that the page's end cuts off.
            break
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                links = 0
            elif tag in INLINE:
                pass
            elif tag == "br":
                text(" ")
            elif open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        links = 0
                        break
            continue
        if tag in RAW:
            if not found[3].rstrip().endswith("/"):
                if tag == "head" and headless:
                    continue
                stop = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, at)
                if stop:
                    at = _behind(page, ">", stop.end())
                elif tag == "head":
                    # Looked for once, else a page of such tags would be read once for each.
                    headless = True
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                else:
                    at = n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag == "a":
            links = 1
            stack[-1].inline += 1
            continue
        if tag in INLINE:
            stack[-1].inline += 1
            continue
        if tag in ("html", "body"):
            root.tokens += _attributes(found[3])[0]
            continue
        if tag in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("div", "article", "section", "main", "td", "li", "body", "blockquote", "aside", "nav", "footer", "header", "form", "figure"):
                    break
        if tag in SAME_LEVEL:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or (tag in ("dt", "dd") and stack[k].tag in ("dt", "dd")) or (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                    close(k)
                    break
                if stack[k].tag in SAME_LEVEL[tag].split():
                    break
        tokens, main = _attributes(found[3])
        node = Node(tag, stack[-1], tokens, main)
        nodes.append(node)
        stack.append(node)
        open_[tag] += 1
        links = 0
    return nodes


def features(nodes: list[Node], evidence: dict[str, float]) -> np.ndarray:
    """One row of FEATURES numbers for each node."""
    n = len(nodes)
    for k, node in enumerate(nodes):
        node.order = k
    own, linked, tags, stops, words, longest = (np.zeros(n) for _ in range(6))
    first = np.full(n, np.inf)
    for k, node in enumerate(nodes):
        if node.pieces:
            joined = "".join(p for _, p in node.pieces)
            own[k] = len(joined.strip())
            stops[k] = joined.count(".") + joined.count(",")
            words[k] = joined.count(" ") + 1 if own[k] else 0
            first[k] = node.pieces[0][0]
        linked[k], tags[k] = node.linked, node.inline + 1
    text, link, tag, stop, word, kids = own.copy(), linked.copy(), tags.copy(), stops.copy(), words.copy(), np.zeros(n)
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent.order
        for x in (text, link, tag, stop, word):
            x[up] += x[k]
        kids[up] += 1
        first[up] = min(first[up], first[k])
        longest[up] = max(longest[up], text[k])
    out = np.zeros((n, FEATURES))
    before = np.cumsum(own) - own
    total = max(1.0, own.sum())
    low, high = np.zeros(n), np.zeros(n)
    flags = np.zeros((n, len(ABOVE)), bool)
    of_tag = [Counter(x.tag for x in node.children) for node in nodes]
    for k, node in enumerate(nodes):
        worth = [evidence[t] for t in node.tokens if t in evidence]
        mine_low, mine_high = min(worth, default=0.0), max(worth, default=0.0)
        up = node.parent
        siblings = up.children if up else [node]
        if up:
            j = up.order
            low[k], high[k] = min(low[j], mine_low), max(high[j], mine_high)
            flags[k] = flags[j]
            if up.tag in _ABOVE:
                flags[k, _ABOVE[up.tag]] = True
        else:
            low[k], high[k] = min(0.0, mine_low), max(0.0, mine_high)
        same = of_tag[up.order][node.tag] if up else 1
        place = node.order - siblings[0].order
        span = siblings[-1].order - siblings[0].order or 1
        out[k, :N_OWN] = (node.depth, math.log1p(own[k]), math.log1p(text[k]), link[k] / max(1.0, text[k]), math.log1p(text[k] / tag[k]), math.log1p(kids[k]), place / span, math.log1p(len(siblings)), same / len(siblings), stop[k] / max(1.0, word[k]), text[k] / max(1.0, word[k]), before[k] / total)
        if node.tag in _GROUP:
            out[k, N_OWN + _GROUP[node.tag]] = 1.0
        out[k, FEATURES - 4 :] = mine_low, mine_high, low[k], high[k]
    out[:, N_OWN + len(GROUPS) : FEATURES - 4] = flags
    return out


def decode(nodes: list[Node], odds: np.ndarray, cost: float = MIXED_COST) -> np.ndarray:
    """Which nodes keep their own text: the best consistent choice over the tree."""
    n = len(nodes)
    weight = np.array([bool("".join(p for _, p in x.pieces).strip()) if x.pieces else False for x in nodes]) * odds
    every = weight.copy()
    mixed = np.abs(weight)
    best = np.zeros(n)
    for k in range(n - 1, -1, -1):
        best[k] = max(abs(every[k]), mixed[k] - (cost if nodes[k].children else 0.0))
        if k:
            up = nodes[k].parent.order
            every[up] += every[k]
            mixed[up] += best[k]
    keep = np.zeros(n, bool)
    fixed: list[bool | None] = [None] * n
    for k, node in enumerate(nodes):
        above = fixed[node.parent.order] if node.parent else None
        if above is not None:
            fixed[k] = keep[k] = above
        elif abs(every[k]) >= mixed[k] - (cost if node.children else 0.0):
            fixed[k] = keep[k] = every[k] > 0
        else:
            keep[k] = weight[k] > 0
    return keep


def joined_text(nodes: list[Node], keep: np.ndarray) -> str:
    """Kept texts in page order, references decoded, white space as one space."""
    pieces = sorted((place, k, piece) for k, node in enumerate(nodes) if keep[k] for place, piece in node.pieces)
    out, last = [], None
    for place, k, piece in pieces:
        if last is not None and k != last:
            out.append(" ")
        out.append(piece)
        last = k
    return SPACES.sub(" ", entities.unescape("".join(out))).strip()


# ---- training pages ----

# Names that sites give to the parts of a page.
DROPPED = {
    "nav": "nav navbar navigation menu mainmenu topnav submenu links breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "header": "header masthead banner topbar site-title logo branding tagline brand top",
    "footer": "footer colophon copyright legal bottom credits imprint sitemap contentinfo",
    "aside": "sidebar aside widget related recommended popular trending complementary rail recent teaser more tags archive categories blogroll right-column",
    "div": "ad ads advert advertisement adverts promo sponsored sponsor banner-ad adsense dfp commercial outbrain taboola promotion",
    "notice": "cookie cookies consent notice alert warning gdpr popup modal overlay dialog message paywall disclaimer announcement hint notification privacy",
    "form": "form search login signin signup subscribe newsletter contact poll survey register field",
    "share": "share social sharing follow facebook twitter print buttons tools actions",
    "comments": "comments comment commentlist reply replies respond discussion disqus responses reviews thread feedback user-comments",
    "hidden": "hidden invisible sr-only screen-reader",
}
KEPT = "article content post entry main story body text post-content entry-content article-body story-body main-content page-content articleBody post-body richtext prose blog-post".split()
NEUTRAL = "container wrapper wrap row col column inner outer layout grid section block module box region group page site clearfix left center".split()


def _name(rng: random.Random, words: list[str]) -> str:
    name = rng.choice(words)
    shape = rng.random()
    if shape < 0.2:
        name = f"{rng.choice(['site', 'page', 'js', 'c', 'm', 'the'])}-{name}"
    elif shape < 0.35:
        name = f"{name}-{rng.randint(1, 99)}"
    elif shape < 0.45:
        name = f"{name}__{rng.choice(NEUTRAL)}"
    return f' {rng.choice(["class", "class", "id"])}="{name}"' if rng.random() < 0.85 else ""


def training_page(texts: list[str], rng: random.Random) -> str:
    """A page whose main blocks carry data-main, from the lines of some texts; the first is the article."""
    escape = entities.escape
    others = [line for t in texts[1:] for line in t.split("\n") if line.strip()] or ["x"]
    other = lambda most=30: " ".join(rng.choice(others).split()[: rng.randint(1, most)])
    link = lambda: f'<a href="/{rng.randint(1, 999)}">{escape(other(3))}</a>'

    def part(kind: str) -> str:
        name = _name(rng, DROPPED[kind].split())
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else rng.choice(["div", "div", "section"])
        if tag == "nav" or kind == "hidden" or name == "":
            name = name if tag != "div" else f' class="{rng.choice(DROPPED[kind].split())}"'
        if kind == "nav":
            body = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>" if rng.random() < 0.7 else " | ".join(link() for _ in range(rng.randint(2, 7)))
        elif kind == "header":
            body = rng.choice([f"<h1>{escape(other(4))}</h1>", f"<p>{escape(other(8))}</p>", f"<div>{link()}</div><p>{escape(other(10))}</p>", escape(other(6))])
        elif kind == "footer":
            body = rng.choice([f"&copy; {escape(other(12))}", f"<p>{escape(other(20))}</p><ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{escape(other())}</p>"])
        elif kind == "comments":
            body = f"<h3>{escape(other(3))}</h3>" * rng.randint(0, 1) + "".join(f'<div{_name(rng, ["comment", "reply", "comment-body"])}><p>{escape(other(60))}</p></div>' if rng.random() < 0.6 else f"<p>{escape(other(60))}</p>" if rng.random() < 0.5 else f"<li><b>{escape(other(2))}</b> {escape(other(50))}</li>" for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            body = f'<label>{escape(other(3))}</label><input name="q"><button>{escape(other(2))}</button>' + f"<p>{escape(other(15))}</p>" * rng.randint(0, 1) + "<select><option>a<option>b</select>" * rng.randint(0, 1)
        elif kind == "aside":
            body = f"<h3>{escape(other(4))}</h3>" + rng.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", "".join(f"<p>{escape(other(40))}</p>" for _ in range(rng.randint(1, 4)))])
        elif kind == "share":
            body = " ".join(link() for _ in range(rng.randint(1, 4)))
        else:
            body = rng.choice([escape(other(40)), f"<p>{escape(other(50))}</p>", f"<p>{escape(other(20))}</p>{link()}", f"<span>{escape(other(30))}</span>"])
        return f"<{tag}{name}>{body}</{tag}>"

    lines = [x for x in texts[0].split("\n") if x.strip()] or ["x"]
    start = rng.randrange(len(lines))
    lines = lines[start : start + rng.randint(1, 14)]
    plain = rng.random() < 0.35
    rich = []
    if rng.random() < 0.7:
        rich.append(f"<h1 data-main>{escape(lines[0][:64])}</h1>")
    for line in lines:
        shape = rng.random()
        body = escape(line)
        if plain or shape < 0.6:
            rich.append(f"<p data-main>{body}</p>" if rng.random() < 0.8 else f"<p data-main><b>{body}<br>")
        elif shape < 0.7:
            rich.append(f"<h2 data-main>{escape(' '.join(line.split()[:6]))}</h2><p data-main>{body}")
        elif shape < 0.78:
            rich.append("<ul data-main>" + "".join(f"<li data-main>{escape(x)}</li>" for x in line.split(". ")[:5]) + "</ul>")
        elif shape < 0.84:
            rich.append(f"<blockquote data-main><p data-main>{body}</p></blockquote>")
        elif shape < 0.88:
            rich.append(f"<table data-main><tr data-main><td data-main>{body}</td><td data-main>{escape(other(2))}</td></tr></table>")
        elif shape < 0.95:
            rich.append(f'<div data-main{_name(rng, ["text", "paragraph", "para"])}>{body}</div>')
        else:
            rich.append(f"<pre data-main>{body}</pre>")
        if not plain and rng.random() < 0.12:
            rich.append(part(rng.choice(["div", "share", "form", "notice", "aside", "hidden"])))
    tag = rng.choice(["article", "article", "main", "div", "section"])
    name = _name(rng, KEPT) if tag != "article" else _name(rng, KEPT) * rng.randint(0, 1)
    body = "\n".join(rich) if rng.random() < 0.9 else "".join(rich)
    main = f"<{tag}{name} data-main>{body}</{tag}>"
    for _ in range(rng.randint(0, 2)):
        main = f"<div{_name(rng, NEUTRAL)}>{main}</div>"
    top = [part(k) for k in ("header", "nav", "notice", "form", "div") if rng.random() < 0.45]
    bottom = [part(k) for k in ("share", "comments", "aside", "div", "nav", "notice", "hidden") if rng.random() < 0.3]
    rng.shuffle(top)
    rng.shuffle(bottom)
    if rng.random() < 0.75:
        bottom.append(part("footer"))
    if rng.random() < 0.3:
        main = f"<div{_name(rng, NEUTRAL)}>{main}{part('aside')}</div>"
    return f"<html><head><title>{escape(other(5))}</title></head><body>{''.join(top)}{main}{''.join(bottom)}</body></html>"


def _labelled(pages_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = random.Random(seed)
                out += [training_page(texts[k:] + texts[:k], rng) for k in range(len(texts)) for _ in range(pages_each)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["html"])

    return run


def _training_rows(evidence: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for page in batch.column(0).to_pylist():
                nodes = parse(page)
                for node, row in zip(nodes, features(nodes, evidence)):
                    if row[1] > 0 and node.depth:
                        rows.append(row.tolist())
                        labels.append(float(node.main))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels)], names=["row", "label"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(t, int(node.main)) for page in batch.column(0).to_pylist() for node in parse(page) for t in set(node.tokens)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], pa.int64())], names=["token", "main"])


def training_pages(texts: DataFrame, rows: int = TRAINING_TEXTS) -> DataFrame:
    """Pages (html, main blocks marked) composed from at most `rows` of the texts (doc_id, text), those with the least hash.

    Texts of 40 to 20,000 characters serve, as a shorter one is no article and
    a longer one would be most of all training nodes. Ids are picked first, so
    that no task sorts texts.
    """
    able = texts.where("length(text) between 40 and 20000 and doc_id is not null")
    ids = able.select("doc_id")
    picked = least_hashes(ids, "doc_id", rows, ids.count())
    some = able.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # Ten texts at a time: one is the article, the others fill the rest of the page.
    groups = some.withColumn("_g", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(max(1, rows // 10)))).groupBy("_g")
    groups = groups.agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).getField("text").alias("texts")).select("texts", "_g")
    return groups.mapInArrow(_labelled(3), "html string")


def fit_pages(pages: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """Model from labelled pages (html): evidence of tokens, and trees as arrays; None without pages of both kinds."""
    from tanyalah.llm.components import written

    pages = written(pages, "pages")
    counts = pages.mapInArrow(_tokens, "token string, main long").groupBy("token").agg(F.sum("main").alias("g"), F.count("*").alias("n")).where("n >= 5")
    # Names in the generator's lists, or in the caller's labelled pages: a bounded table.
    evidence = {r["token"]: math.log((r["g"] + 0.5) / (r["n"] - r["g"] + 0.5)) for r in counts.collect()}
    rows = written(pages.mapInArrow(_training_rows(evidence), "row array<double>, label double"), "nodes")
    rows = rows.select(array_to_vector("row").alias("features"), "label")
    if rows.select("label").distinct().count() < 2:
        return None
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, maxBins=32).fit(rows)
    return evidence, [(w, _arrays(t)) for w, t in zip(fitted.treeWeights, fitted.trees)]


def _arrays(tree):
    """feature, threshold, left, right, value of a tree's nodes."""
    out: list[list[float]] = []

    def visit(node) -> int:
        k = len(out)
        out.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            out[k][:2] = [split.featureIndex(), split.threshold()]
            out[k][2], out[k][3] = visit(node.leftChild()), visit(node.rightChild())
        return k

    visit(tree._call_java("rootNode"))
    return tuple(np.array(x) for x in zip(*out))


def log_odds(x: np.ndarray, trees) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, (feature, threshold, left, right, value) in trees:
        at = np.zeros(len(x), int)
        feature, left, right = feature.astype(int), left.astype(int), right.astype(int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
            at = np.where(inner, go, at)
        total += weight * value[at]
    return 2 * total


def main_texts(pages: list[str | None], model) -> list[str]:
    """Main text of each page; empty for null."""
    if model is None:
        return ["" for _ in pages]
    evidence, trees = model
    parsed = [parse(p) if p else None for p in pages]
    found = [features(nodes, evidence) for nodes in parsed if nodes]
    if not found:
        return ["" for _ in pages]
    odds = log_odds(np.concatenate(found), trees)
    out, at = [], 0
    for nodes in parsed:
        if not nodes:
            out.append("")
            continue
        mine = odds[at : at + len(nodes)]
        at += len(nodes)
        out.append(joined_text(nodes, decode(nodes, mine)))
    return out


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH_PAGES):
                part = batch.slice(lo, BATCH_PAGES)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, model) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A null or empty html, or one without main text, gives an empty text. Page
    ids and urls pass through, nulls and repeated rows too; other columns are
    ignored. An empty table gives an empty result.
    """
    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(_extract(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
