"""Operator 1: main text of web pages by a tree-structured graphical model over the DOM.

Every element and text run is a variable with the states boilerplate, content and mixed (an element that holds both). An
element depends on its parent through a potential that was counted, per kind of child, on labelled pages; what a node shows
(tag, words of class and id, amount of text, share of it in links) is its evidence, with likelihoods counted likewise.
Sum-product messages pass up from the leaves and down from the root; a text run whose marginal says content is kept.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table, without
from .tokens import small

BOILER, CONTENT, MIXED = range(3)
#: Fixed values of the HTML standard: elements without content, with raw text, that are not rendered, and that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style title noscript iframe template head meta link svg math object embed xmp noembed noframes select option datalist textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag (left) closes an open element (right) up to the given borders.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",))}
TAG = re.compile(r"""<(?:!--(?P<note>.*?)(?:-->|--!>|$)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<odd>[!?/][^>]*)(?:>|$)|(?P<cut>/?[a-zA-Z][^>]*)(?:>|$))""", re.S)
NAMED = re.compile(r"""(?i)\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "words", "kids", "parent", "text", "size", "linked", "label", "obs", "up", "down", "depth", "line")

    def __init__(self, tag: str, parent: Node | None, words: tuple[str, ...] = (), text: str = ""):
        self.tag, self.parent, self.words, self.text, self.kids = tag, parent, words, text, []
        self.size = self.linked = 0
        self.label = None
        self.depth = 0 if parent is None else parent.depth + 1
        # The element whose lines this one stands in: itself, unless it is an inline element.
        self.line = parent.line if parent is not None and tag in INLINE else self
        if parent is not None:
            parent.kids.append(self)


def parse(page: str) -> Node:
    """A tree of elements and text runs (tag '#'); forgiving, whatever is left open or cut off. The open elements of each name are kept, so time follows the page's length at any depth."""
    root = Node("html", None)
    at, node = 0, root
    opened: dict[str, list[Node]] = {"html": [root]}

    def back_to(up: Node) -> Node:
        below = node
        while below is not up:
            opened[below.tag].pop()
            below = below.parent
        return up

    def text(raw: str) -> None:
        if raw:
            Node("#", node, text=html.unescape(raw))

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m["cut"] is None or not m[0].endswith(">"):
                continue
            name, end, rest = re.split(r"[\s/>]", m["cut"].lstrip("/"), maxsplit=1)[0].lower(), m["cut"].startswith("/"), m["cut"]
        else:
            name, end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
        if end:
            if name != "html" and opened.get(name):
                node = back_to(opened[name][-1].parent)
            continue
        if name == "html":
            continue
        if name in CLOSES_P and node.line.tag == "p":
            node = back_to(node.line.parent)
        if name in CLOSES:
            same, border = CLOSES[name]
            near = max((opened[t][-1] for t in (*same, *border) if opened.get(t)), key=lambda x: x.depth, default=None)
            if near is not None and near.tag in same:
                node = back_to(near.parent)
        words = tuple({p.lower() for a in NAMED.findall(rest) for x in a if x for p in PART.findall(x)}) if "=" in rest else ()
        new = Node(name, node, words)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(page, at)
            stop = close.start() if close else len(page)
            if name not in UNSEEN:
                Node("#", new, text=page[at:stop])
            gt = page.find(">", stop)
            at = len(page) if close is None or gt < 0 else gt + 1
        elif name not in VOID and (not rest.rstrip().endswith("/") or name not in ("svg", "path")):
            node = new
            opened.setdefault(name, []).append(new)
    return root


def prune(root: Node) -> list[Node]:
    """Takes out what is not rendered and empty text; returns the rest parents first, with sizes and what each node shows."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        n.kids = [k for k in n.kids if k.tag not in UNSEEN and (k.tag != "#" or not k.text.isspace() and k.text or k.text)]
        stack.extend(reversed(n.kids))
    for n in reversed(order):
        if n.tag == "#":
            n.size = len(n.text.strip())
        if n.tag == "a":
            n.linked = n.size
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.linked += n.linked
    for n in order:
        if n.tag == "#":
            t = n.text.strip()
            n.obs = ("#", f"len{min(8, len(t).bit_length())}", f"end{t[-1:] in '.!?:;…' if t else '-'}", f"in{n.parent.tag}")
        else:
            share = -1 if not n.size else round(4 * n.linked / n.size)
            n.obs = (f"tag{n.tag}", f"size{min(10, n.size.bit_length()) // 2}", f"links{share}", *(f"word{w}" for w in n.words))
    return order


def kind(n: Node) -> str:
    return n.tag


class TreeModel:
    """Counted potentials and evidence."""

    def __init__(self):
        self.moves: dict[str, list[list[float]]] = {}
        self.seen: dict[str, list[float]] = {}
        self.default = [[0.97, 0.015, 0.015], [0.02, 0.97, 0.01], [0.4, 0.3, 0.3]]

    @classmethod
    def train(cls, pages: list[tuple[str, set[str]]]) -> TreeModel:
        """Learns from pages and, for each, the texts of its content runs: a text run is content if it is one of them, an element by what it holds."""
        moves: dict[str, Counter] = defaultdict(Counter)
        seen: dict[str, Counter] = defaultdict(Counter)
        states: Counter = Counter()
        groups: dict[int, Counter] = defaultdict(Counter)
        for page, content in pages:
            order = prune(parse(page))
            for n in reversed(order):
                if n.tag == "#":
                    n.label = (CONTENT if n.text.strip() in content else BOILER) if n.size else None
                else:
                    below = {k.label for k in n.kids if k.label is not None}
                    n.label = None if not below else below.pop() if len(below) == 1 else MIXED
            for n in order:
                if n.label is None:
                    continue
                leaf = n.tag == "#"
                groups[leaf][n.label] += 1
                states[n.label] += 1
                for o in n.obs:
                    seen[o][n.label] += 1
                if n.parent is not None:
                    moves["*"][n.parent.label, n.label] += 1
                    moves[kind(n)][n.parent.label, n.label] += 1
        out = cls()
        prior = cls._rows(moves["*"], out.default, 5)
        out.moves = {k: cls._rows(c, prior, 5) for k, c in moves.items() if k != "*"}
        out.default = prior
        for o, c in seen.items():
            g = groups[o == "#" or o.startswith(("len", "end", "in"))]
            rates = [(c[s] + 0.5) / (g[s] + 8.0) for s in range(3)]
            total = sum(rates)
            # The exponents keep correlated evidence from adding up: an article's many short paragraphs are alike, not independent.
            out.seen[o] = [(r / total) ** (0.3 if o.startswith(("len", "size", "end")) else 0.7) for r in rates]
        return out

    @staticmethod
    def _rows(counts: Counter, prior: list[list[float]], weight: float) -> list[list[float]]:
        rows = []
        for p in range(3):
            got = [counts[p, s] + weight * prior[p][s] for s in range(3)]
            rows.append([g / sum(got) for g in got])
        return rows

    def marginals(self, order: list[Node]) -> None:
        """Upward and downward sum-product; leaves n.down, the marginal of content times the rest, in every node."""
        seen, moves, default = self.seen, self.moves, self.default
        for n in order:
            a = b = c = 1.0
            for o in n.obs:
                e = seen.get(o)
                if e is not None:
                    a *= e[0]
                    b *= e[1]
                    c *= e[2]
            if n.tag == "#":
                c = 0.0
            n.up = [a, b, c]
        for n in reversed(order):
            u = n.up
            total = u[0] + u[1] + u[2] or 1.0
            u[0] /= total
            u[1] /= total
            u[2] /= total
            if n.parent is not None and (n.size or n.tag != "#"):
                m, w = moves.get(n.tag, default), n.parent.up
                n.label = msg = [r[0] * u[0] + r[1] * u[1] + r[2] * u[2] for r in m]
                big = max(msg) or 1.0
                for s in range(3):
                    w[s] *= msg[s] / big
                if w[0] + w[1] + w[2] < 1e-200:
                    for s in range(3):
                        w[s] *= 1e200
        for n in order:
            if n.parent is None:
                n.down = [x * p for x, p in zip(n.up, (0.1, 0.1, 0.8), strict=True)]
            elif n.size or n.tag != "#":
                m, msg, d = moves.get(n.tag, default), n.label, n.parent.down
                without = [d[s] / msg[s] if msg[s] > 0 else 0.0 for s in range(3)]
                n.down = [n.up[s] * (without[0] * m[0][s] + without[1] * m[1][s] + without[2] * m[2][s]) for s in range(3)]
            else:
                n.down = [0.0, 0.0, 1.0]
            total = sum(n.down)
            n.down = [x / total for x in n.down] if total > 0 else [1.0, 0.0, 0.0]

    def extract(self, page: str | None) -> str:
        """The page's content: blocks in page order, joined by one space."""
        if not page:
            return ""
        order = prune(parse(page))
        self.marginals(order)
        out: list[str] = []
        stack: list[Node | str] = [order[0]]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "#":
                if n.down[CONTENT] >= 0.5 or not n.size:
                    out.append(n.text)
            else:
                block = n.tag not in INLINE
                if block:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(n.kids))
        return " ".join("".join(out).split())


# ---- labelled pages -------------------------------------------------------------------------------------------------

#: Words of class and id that page authors give to parts of a page: fixed values.
CONTENT_NAMES = "content article post entry story main body text page blog news detail markdown prose richtext".split()
BOILER_NAMES = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topbar tabs links pagination pager skip".split(),
    "header": "header masthead banner branding logo top site hero".split(),
    "footer": "footer bottom copyright legal colophon credits".split(),
    "aside": "sidebar side aside widget related recommended popular trending tags rail more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense".split(),
    "notice": "cookie consent notice alert popup modal overlay newsletter subscribe gdpr message warning toast".split(),
    "form": "form search login signup register contact newsletter subscribe field".split(),
    "comments": "comment comments discussion reply replies responses disqus reader feedback thread respond".split(),
    "share": "share social sharing follow author byline meta print".split(),
}


def labelled_pages(n: int = 1500, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Generated pages and the texts of their content runs, over the usual layouts, with unclosed tags among them."""
    rng = random.Random(seed)
    vowel, cons = "aeiou", "bcdfglmnprstv"
    word = lambda: "".join(rng.choice(cons) + rng.choice(vowel) for _ in range(rng.randint(1, 4)))
    uid = iter(range(10**9))

    def words(k: int) -> str:
        return f"{' '.join(word() for _ in range(max(1, k)))} {next(uid)}"

    def sentence(k: int) -> str:
        return words(k).capitalize() + rng.choice(["."] * 8 + ["", "!", "?"])

    def named(names: list[str], chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        got = [rng.choice(names) for _ in range(rng.choice([1, 1, 2]))]
        return f' {rng.choice(["class", "class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(got)}"'

    def boiler(part: str) -> str:
        names = BOILER_NAMES[part]
        own = {"nav": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form"], "comments": ["div", "section", "ol"]}.get(part, ["div", "section", "div", "aside", "p"])
        tag = rng.choice(own)
        sure = tag in ("div", "section", "p", "ol", "ul")
        if part in ("nav",):
            body = "".join(f'<li><a href="/x">{words(rng.randint(0, 2))}</a></li>' for _ in range(rng.randint(2, 9)))
            body = body if tag == "ul" else f"<ul>{body}</ul>"
        elif part == "form":
            body = f"<label>{words(2)}</label><input name=q><p>{sentence(rng.randint(2, 8))}</p><button>{words(1)}</button>"
        elif part == "comments":
            body = f"<h3>{words(1)}</h3>" * rng.randint(0, 1) + "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><b>{words(1)}</b><p>{sentence(rng.randint(2, 40))}</p></div>' for _ in range(rng.randint(1, 5)))
        elif part == "footer":
            body = rng.choice([f"&copy; {sentence(rng.randint(1, 12))} &middot; {words(2)}", f"<p>{sentence(6)}</p><ul><li><a href=#>{words(1)}</a></li></ul>"])
        elif part == "aside":
            body = f"<h3>{words(2)}</h3><ul>" + "".join(f'<li><a href="/x">{words(rng.randint(2, 7))}</a></li>' for _ in range(rng.randint(1, 6))) + "</ul>" if rng.random() < 0.6 else f"<h4>{words(1)}</h4><p>{sentence(rng.randint(3, 25))}</p>"
        elif part == "header":
            body = f'<a href="/">{words(1)}</a><p>{sentence(rng.randint(2, 7))}</p>' if rng.random() < 0.7 else f"<h2>{words(2)}</h2>"
        else:
            body = rng.choice([f"<p>{sentence(rng.randint(3, 30))}</p>", sentence(rng.randint(3, 30)), f"<span>{words(3)}</span> <a href=#>{words(1)}</a>"])
            if tag == "p":
                body = sentence(rng.randint(3, 25))
        return f"<{tag}{named(names, 1.0 if sure else 0.5)}>{body}</{tag}>"

    def article(content: set[str]) -> str:
        def keep(t: str) -> str:
            content.add(t)
            return t

        out = [f"<h1>{keep(words(rng.randint(1, 9)))}</h1>"] if rng.random() < 0.9 else []
        short = rng.random() < 0.15
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8, 13]) * (3 if short else 1)):
            k = rng.choice([0, 1, 2] if short else [0, 1, 2, 4, 8, 16, 30, 60, 120])
            what = rng.random()
            if what < 0.62:
                end = "</p>" if rng.random() < 0.93 else ""
                out.append(f"<p>{keep(sentence(k))}{end}")
            elif what < 0.70:
                out.append(f"<p><b>{keep(sentence(k))}<br>")
            elif what < 0.78:
                out.append(f"<p>{keep(sentence(k))} <a href=x>{keep(words(2))}</a> {keep(sentence(4))}</p>")
            elif what < 0.86:
                out.append(f"<h2>{keep(words(3))}</h2>")
            elif what < 0.92:
                out.append("<ul>" + "".join(f"<li>{keep(sentence(rng.randint(1, 14)))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif what < 0.94:
                out.append(f"<blockquote><p>{keep(sentence(k))}</p></blockquote>")
            elif what < 0.96:
                out.append(f"<pre><code>{keep(words(6))}</code></pre>")
            elif what < 0.98:
                out.append(f"<table><tr><td>{keep(words(1))}</td><td>{keep(words(2))}</td></tr></table>")
            else:
                out.append(boiler(rng.choice(["ad", "share", "form", "notice"])))
        return "".join(out)

    pages = []
    for _ in range(n):
        content: set[str] = set()
        inner = article(content)
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        main = f"<{tag}{named(CONTENT_NAMES, 1.0 if tag in ('div', 'section') else 0.4)}>{inner}</{tag}>"
        if rng.random() < 0.25:
            main = f"<main>{main}</main>"
        before = [boiler(p) for p in ("notice", "header", "nav", "ad", "aside") if rng.random() < 0.55]
        after = [boiler(p) for p in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        if rng.random() < 0.3:
            body = "".join(before[:1]) + f"<div{named(['wrapper', 'container', 'page', 'layout', 'row', 'site'])}>" + "".join([*before[1:], main, *after[:-1]]) + "</div>" + "".join(after[-1:])
        else:
            body = "".join([*before, main, *after])
        pages.append((f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(4)}</title><style>p{{}}</style></head><body>{body}</body></html>', content))
    return pages


def extract(pages: DataFrame, model: TreeModel, *, html: str = "html", to: str = "text") -> DataFrame:
    """Adds the main text and n_chars, its code points. A null or empty page gives '' and 0, and so does an empty table no rows.

    Rows are taken one by one, so rows that repeat come out alike; a run whose marginal is even is kept. Pages may be of any
    length and depth. Other columns pass through, columns of the added names are replaced.
    """
    pages = without(pages, to, "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*pages.schema.fields, StructField(to, StringType()), StructField("n_chars", LongType())])
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            texts = [shared.value.extract(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names, to, "n_chars"])

    return pages.mapInArrow(run, schema)


def op1_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = TreeModel.train(labelled_pages())
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model).drop("html")


