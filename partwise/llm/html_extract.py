"""Operator 8, HTML extraction: a linear-chain CRF over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from partwise.llm.shared import table, typed

# --- leaf blocks -------------------------------------------------------------

#: The name of a tag, and the rest of it up to a > outside of quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements by their part in HTML (fixed values of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title iframe textarea select".split())
#: Elements of other vocabularies, which may end in />.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button".split()
)
#: Open elements that a start tag ends, and those that stop the search for them.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button"}

HEAD_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that hint at one label or the other.
HINTS = {
    "main": "article post entry content main story body text prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "head": "header masthead banner topbar branding logo".split(),
    "foot": "footer foot copyright legal colophon".split(),
    "side": "sidebar side aside widget related recommended trending popular".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted".split(),
    "notice": "cookie cookies consent notice notification alert gdpr popup modal overlay dialog toast".split(),
    "talk": "comment comments reply replies discussion disqus respond".split(),
    "form": "form search login signup subscribe newsletter".split(),
    "share": "share sharing social follow tags meta byline author".split(),
}
HINT_OF = {w: name for name, words in HINTS.items() for w in words}


@dataclass(slots=True)
class Block:
    """Text between two block bounds, with what stands above it."""

    text: str
    features: list[str]
    linked: float
    main: bool | None = None


class Node:
    """An open element and what blocks below it inherit: features of all that stand above, the innermost of them apart."""

    __slots__ = ("tag", "features", "hint", "frame", "inner", "main")

    def __init__(self, tag: str, attributes: str, above: Node | None):
        self.tag = tag
        self.features, self.hint, self.frame, self.inner, self.main = (above.features, above.hint, above.frame, above.inner, above.main) if above else (frozenset(["bias"]), "", "", "none", None)
        new: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes) if attributes else ():
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-y":
                self.main = value == "1"
            else:
                hints = sorted({f"hint:{HINT_OF[w]}" for w in re.split(r"[^a-z]+", value.lower()) if w in HINT_OF})
                new.update(hints)
                self.hint = hints[-1] if hints else self.hint
        if tag in FRAMES:
            new.add(f"in:{tag}")
            self.frame = tag
        if tag in BLOCK:
            self.inner = tag
        if not new <= self.features:
            self.features = self.features | new


class Tags:
    """Where the tags of a page end, in time linear in the page whatever it holds."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.ends: tuple[list[int], list[int]] | None = None
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The place behind the > that ends a tag whose name ends at at: the next one outside of quotes, else the next one; -1 if there is none."""
        if at > self.last:
            return -1
        if self.ends is None:
            m = REST.match(self.source, at)
            if m:
                return m.end()
            self.ends = self.table()
        places, ends = self.ends
        k = bisect_left(places, at)
        found = ends[k] if k < len(places) else -1
        return found + 1 if found >= 0 else self.source.find(">", at) + 1

    def table(self) -> tuple[list[int], list[int]]:
        """For each > and quote, the next > outside of quotes if it is met outside of them."""
        outside = double = single = -1
        places, ends = [], []
        for m in reversed(list(SPECIAL.finditer(self.source))):
            if m[0] == ">":
                outside = m.start()
            elif m[0] == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            places.append(m.start())
            ends.append(outside)
        return places[::-1], ends[::-1]

    def closing(self, tag: str, at: int) -> int:
        """The place behind the end tag of an element without markup; -1 if there is none."""
        if tag in self.unclosed:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(self.source, at)
        if m is None:
            self.unclosed.add(tag)
        return m.end() if m else -1


def blocks_of(source: str) -> list[Block]:
    """The leaf blocks of a page in page order; hidden elements have none. Any string is read, in linear time; open elements end with the page."""
    stack: list[Node] = []
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag, in order
    out: list[Block] = []
    parts: list[str] = []
    linked, at, n, tags = 0, 0, len(source), Tags(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(described(text, stack[-1] if stack else None, linked / max(1, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        if any(x.tag in BLOCK for x in stack[k:]):
            flush()
        for x in stack[k:]:
            if x.tag:
                where[x.tag].pop()
        del stack[k:]

    while at < n:
        start = source.find("<", at)
        piece = source[at:start] if start >= 0 else source[at:]
        if piece:
            parts.append(piece)
            linked += len(piece) if where["a"] else 0
        if start < 0:
            break
        m = TAG.match(source, start)
        if m is None:
            if source.startswith("<!--", start):
                end = -1 if "-->" in tags.unclosed else source.find("-->", start + 4)
                if end < 0:
                    tags.unclosed.add("-->")
                at = end + 3 if end >= 0 else tags.end(start + 4)
            elif source.startswith(("<!", "<?"), start):
                at = source.find(">", start) + 1
            else:
                at = 0
            if at <= 0:
                parts.append("<")
                at = start + 1
            continue
        at = tags.end(m.end())
        if at < 0:
            parts.append("<")
            at = start + 1
            continue
        tag = m[2].lower()
        if m[1]:
            if where[tag]:
                close(where[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        if tag in HIDDEN:
            if tag == "title":
                flush()
            end = tags.closing(tag, at)
            at = end if end >= 0 else at
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID or (tag in FOREIGN and source[at - 2] == "/"):
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P and where["p"]:
            close(where["p"][-1])
        if tag in ENDED_BY:
            ended, stop = ENDED_BY[tag]
            above = max((where[t][-1] for t in stop if where[t]), default=-1)
            k = min((where[t][i] for t in ended if (i := bisect_left(where[t], above + 1)) < len(where[t])), default=len(stack))
            close(k)
        if tag in BLOCK:
            flush()
        if tag == "a" and where["a"]:
            stack[where["a"].pop()].tag = ""
        where[tag].append(len(stack))
        stack.append(Node(tag, source[m.end() : at - 1], stack[-1] if stack else None))
    flush()
    return out


def described(text: str, node: Node | None, linked: float) -> Block:
    """Features of a block: its ancestors' tags and hints, the innermost of them apart, and its text."""
    node = node or Node("", "", None)
    n = len(text)
    features = set(node.features)
    features.update((f"tag:{'h' if node.inner in HEAD_TAGS else node.inner}", f"frame:{node.frame}", f"long:{min(6, int(math.log2(n / 8 + 1)))}", f"link:{min(4, int(min(1.0, linked) * 4.999))}"))
    if node.hint:
        features.add(f"near{node.hint[4:]}")
    if text[-1] in ".!?…。\"'”":
        features.add("stop")
    if "©" in text or "(c)" in text:
        features.add("copyright")
    return Block(text, sorted(features), linked, node.main)


FRAMES = frozenset("article main section nav header footer aside form figure figcaption table ul ol dl blockquote pre button details dialog menu fieldset address".split())

# --- labelled pages ----------------------------------------------------------


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Made-up pages of many layouts; data-y tells whether a block is of the article (1) or not (0)."""
    rng = random.Random(seed)
    syllables = "ba de ki lo mu na pe ri so tu va ze sch ei on th er an qu ou ie".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", "", "", ",", "###", "!!"][: 6 if noisy < 0.8 else 8])

    def words(a: int, b: int) -> str:
        out = " ".join(word() for _ in range(rng.randint(a, b)))
        return out.upper() if noisy > 0.92 else out.capitalize()

    def prose() -> str:
        return " ".join(words(1, 18) + rng.choice([".", ".", ".", "!", "?", ""]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def el(tag: str, body: str, cls: str = "", y: int | None = None) -> str:
        return f"<{tag}" + f' {rng.choice(["class", "class", "id"])}="{cls}"' * bool(cls) + f' data-y="{y}"' * (y is not None) + f">{body}</{tag}>"

    def links(k: int) -> str:
        return "".join(el("li", f'<a href="/{word()}">{words(1, 3)}</a>') for _ in range(k))

    def inline(text: str) -> str:
        if rng.random() < 0.2 and " " in text:
            a, _, b = text.partition(" ")
            return rng.choice([f"<b>{a}</b> {b}", f'<a href="#">{a}</a> {b}', f"<em>{a}</em> {b}", f"<b>{a} {b}"])
        return text

    def maybe(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def cls(kind: str) -> str:
        return rng.choice(HINTS[kind]) + rng.choice(["", "", "-1", "-box", " clear", "-wrap"]) if rng.random() < 0.8 else ""

    def ad() -> str:
        return el(rng.choice(["div", "div", "aside", "section"]), rng.choice([prose, lambda: words(2, 8), lambda: f"<p>{prose()}</p>"])(), rng.choice(["ad", "ads", "advert", "sponsored", "ad-box", "promo"]), 0)

    def notice() -> str:
        return el(rng.choice(["div", "section", "p", "dialog"]), prose() + maybe(0.5, lambda: f"<button>{words(1, 2)}</button>"), rng.choice(["cookie-notice", "notice", "consent", "alert", "cookies", "gdpr-popup"]), 0)

    def comments() -> str:
        each = "".join(el(rng.choice(["div", "li", "article", "p"]), maybe(0.5, lambda: f"<b>{word()}</b> ") + f"<p>{prose()}</p>", rng.choice(["comment", "reply", "comment-body", ""])) for _ in range(rng.randint(1, 5)))
        return el(rng.choice(["section", "div", "ul"]), maybe(0.5, lambda: f"<h3>{words(1, 3)}</h3>") + each, rng.choice(["comments", "discussion", "comment-list", "comments-area"]), 0)

    def form() -> str:
        return el("form", f"<label>{words(1, 4)}</label><input type=text>" + maybe(0.6, lambda: f"<p>{words(3, 12)}</p>") + f"<button>{words(1, 2)}</button>", cls("form"), 0)

    def side() -> str:
        return el(rng.choice(["aside", "div", "section"]), maybe(0.6, lambda: f"<h3>{words(1, 3)}</h3>") + rng.choice([lambda: f"<ul>{links(5)}</ul>", lambda: f"<p>{prose()}</p>"])(), rng.choice(["sidebar", "related", "widget", "side", "recommended"]), 0)

    def share() -> str:
        return el(rng.choice(["div", "ul", "p"]), rng.choice([lambda: links(3), lambda: words(1, 6)])(), cls("share"), 0)

    def article() -> str:
        body = []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15])):
            kind = rng.random()
            if kind < 0.72:
                body.append(f"<p>{inline(prose())}" + rng.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            elif kind < 0.8:
                body.append(f"<h2>{words(1, 7)}</h2>")
            elif kind < 0.86:
                body.append(el(rng.choice(["ul", "ol"]), "".join(f"<li>{inline(rng.choice([prose, lambda: words(1, 6)])())}</li>" for _ in range(rng.randint(1, 5)))))
            elif kind < 0.9:
                body.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.93:
                body.append(f"<pre>{prose()}</pre>")
            elif kind < 0.96:
                body.append("<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                body.append(f"<figure><img><figcaption>{words(2, 9)}</figcaption></figure>")
            body.append(maybe(0.05, ad) + maybe(0.03, share) + maybe(0.03, form) + maybe(0.03, side))
        title = maybe(0.9, lambda: rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(words(1, 12)))
        inside = title + maybe(0.15, share) + "".join(body) + maybe(0.1, comments)
        frame = rng.random()
        if frame < 0.12:
            return el("span", inside, "", 1)  # an article without a frame of its own
        if frame < 0.2:
            return el("div", inside, "", 1)
        if frame < 0.55:
            return el("article", inside, cls("main") if rng.random() < 0.3 else "", 1)
        if frame < 0.75:
            return el("main", rng.choice([inside, f"<div>{inside}</div>"]), "", 1)
        return el(rng.choice(["div", "section", "td"]) if frame < 0.98 else "div", inside, rng.choice(HINTS["main"]), 1)

    out = []
    for _ in range(n):
        noisy = rng.random()
        menu = lambda: rng.choice([el("nav", f"<ul>{links(rng.randint(2, 8))}</ul>", "", 0), el("div", f"<ul>{links(5)}</ul>", cls("menu") or "menu", 0), el("nav", words(1, 9), cls("menu"), 0)])
        head = lambda: rng.choice([el("header", f"<h1>{words(1, 3)}</h1>" + maybe(0.5, menu), "", 0), el("div", f"<p>{words(1, 6)}</p>", cls("head") or "header", 0)])
        foot = lambda: rng.choice([el("footer", f"&copy; {words(1, 4)} &middot; {prose()}", "", 0), el("footer", f"<p>{prose()}</p><ul>{links(3)}</ul>", "", 0), el("div", f"<p>{words(2, 9)}</p>", cls("foot") or "footer", 0)])
        bare = rng.random() < 0.25
        body = "" if bare else maybe(0.4, head) + maybe(0.8, menu) + maybe(0.3, notice) + maybe(0.4, ad) + maybe(0.15, form)
        body += article() + maybe(0.35, comments) + maybe(0.4, side) + maybe(0.3, ad) + maybe(0.15, share) + maybe(0.1, notice) + maybe(0.85, foot)
        if rng.random() < 0.3:
            body = el("div", body, rng.choice(["wrap", "page", "container"]))
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{body}" + maybe(0.9, lambda: "</body></html>"))
    return out


# --- the chain ---------------------------------------------------------------


@dataclass
class Chain:
    """Weights of features for the label main (the other has none), and of label pairs."""

    weights: dict[str, float]
    between: list[list[float]]
    first: list[float]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels of all blocks together."""
        if not blocks:
            return []
        w, (stay0, to1), (to0, stay1) = self.weights, self.between[0], self.between[1]
        a = b = 0.0
        back = []
        for i, block in enumerate(blocks):
            own = sum(w.get(f, 0.0) for f in block.features)
            if i == 0:
                a, b = self.first[0], self.first[1] + own
                continue
            from0, from1 = a + stay0 >= b + to0, a + to1 >= b + stay1
            back.append((from0, from1))
            a, b = (a + stay0 if from0 else b + to0), (a + to1 if from1 else b + stay1) + own
        out = [b > a]
        for from0, from1 in reversed(back):
            out.append(not (from1 if out[-1] else from0))
        return out[::-1]


def train(pages: list[str], epochs: int = 150, rate: float = 0.1, l2: float = 0.002) -> Chain:
    """Maximum conditional likelihood by forward-backward over all labelled pages at once, with Adam steps."""
    parsed = [[x for x in blocks_of(p) if x.main is not None] for p in pages]
    parsed = [p for p in parsed if p]
    names = sorted({f for p in parsed for x in p for f in x.features})
    index = {f: i for i, f in enumerate(names)}
    n, t = len(parsed), max(map(len, parsed))
    x = np.zeros((n, t, len(names)), dtype=np.float32)
    y = np.zeros((n, t), dtype=np.int64)
    on = np.zeros((n, t), dtype=bool)
    for i, p in enumerate(parsed):
        for j, block in enumerate(p):
            x[i, j, [index[f] for f in block.features]] = 1
            y[i, j], on[i, j] = block.main, True
    size = len(names)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat, rows = x.reshape(n * t, size), np.arange(n)
    for step in range(1, epochs + 1):
        w, pair, first = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        own = np.zeros((n, t, 2))
        own[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, t)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = first + own[:, 0]
        for j in range(1, t):
            nxt = np.logaddexp(alpha[:, j - 1, 0, None] + pair[0], alpha[:, j - 1, 1, None] + pair[1]) + own[:, j]
            alpha[:, j] = np.where(on[:, j, None], nxt, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            nxt = beta[:, j + 1] + own[:, j + 1]
            prev = np.logaddexp(pair[:, 0][None] + nxt[:, 0, None], pair[:, 1][None] + nxt[:, 1, None])
            beta[:, j] = np.where(on[:, j + 1, None], prev, beta[:, j + 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * on[:, :, None]
        grad = np.zeros_like(theta)
        grad[:size] = flat.T @ ((y - p[:, :, 1]) * on).reshape(-1).astype(np.float32)
        both = on[:, 1:]
        edge = alpha[:, :-1, :, None] + pair[None, None] + (own[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(edge) * both[:, :, None, None]).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        grad[size : size + 4] = (seen - expected).ravel()
        start = np.zeros((n, 2))
        start[rows, y[:, 0]] = 1
        grad[size + 4 :] = (start - p[:, 0]).sum(axis=0)
        grad = grad / n - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[:size].tolist(), strict=True)), theta[size : size + 4].reshape(2, 2).tolist(), theta[size + 4 :].tolist())


def main_text(source: str, chain: Chain) -> str:
    blocks = blocks_of(source)
    return "\n\n".join(b.text for b, main in zip(blocks, chain.decode(blocks), strict=True) if main)


def html_extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    text: the blocks that the chain labels as the article's, white space inside
    a block as one space, joined by two line ends; empty if there are none.
    Markup may be broken; a null or empty page has no blocks. Repeated rows
    give equal rows; an empty table none.
    """
    bc = pages.sparkSession.sparkContext.broadcast(chain or train(labelled_pages(600)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py() or "", bc.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return typed(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
