"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks (runs of text between the edges of block elements) with their ancestors. Features of a block
are the tags and the class, id and role words of its ancestors and figures of its text; labels are main text or not; the
best label sequence is found by Viterbi. The model is trained on labelled pages that ``labelled_pages`` lays out by rule
from many kinds of templates, by gradient ascent on the conditional likelihood; it has no feature of any text's words.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import small_batches

#: A quote opens a value only behind an equals sign; possessive, so a tag without an end is given up after one scan.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, or to the end of the page.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Never shown: left out up to the end tag; where there is none or the tag closes itself, only the tag is.
HIDDEN = frozenset("template iframe metadata".split())
#: Stand in a line or hold blocks; text of theirs alone is a block.
EMBED = frozenset("noscript object canvas".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open one of these, unless one of the fences lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"})}
_FENCE = frozenset("body div section article td th li table blockquote aside nav main header footer form figure".split())


@dataclass
class Node:
    """An open element: its tag, all tags and marks from the root down to it, and how many of them are blocks."""

    tag: str
    tags: frozenset[str]
    marks: frozenset[str]
    deep: int


@dataclass
class Block:
    text: str
    node: Node
    linked: float


ROOT = Node("", frozenset(), frozenset(), 0)


def _marks(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(dict.fromkeys(w.lower() for m in _ATTR.finditer(attributes) for w in _PART.findall(m[2] or m[3] or m[4] or "")))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text decoded, white space in it made single spaces.

    One pass in time linear in the page: tags are looked up by name in the stack of open elements, a node shares the sets of
    its parent where it adds nothing, and what has no end is looked for once.
    """
    out: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}
    text: list[str] = []
    linked = 0
    alone = False
    endless: set[str] = set()
    last = page.rfind(">")
    tag_of = _TAG

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, stack[-1] if stack else ROOT, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def close_to(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def highest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def add(raw: str) -> None:
        nonlocal linked
        s = html.unescape(raw) if "&" in raw else raw
        text.append(s)
        if places.get("a"):
            linked += len(s.strip())

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at, last + 1)
        if start < 0:
            comment = page.find("<!--", at)  # one without an end
            add(page[at : comment if comment >= 0 else end])
            break
        m = None
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            m = _ASIDE.match(page, start)
        elif after == "/" or after.isalpha():
            m = tag_of.match(page, start)
            if m is None and tag_of is _TAG and _PLAIN_TAG.match(page, start):
                tag_of = _PLAIN_TAG  # quotes that never end: from here on they are like other characters
                m = tag_of.match(page, start)
        if m is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        if m.re is _ASIDE:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if places.get(tag):
                if tag in BLOCK or (tag in EMBED and alone):
                    flush()
                k = places[tag][-1]
                if tag in BLOCK or stack[-1].deep == (stack[k - 1].deep if k else 0):
                    close_to(k)
            continue
        shut = attributes.endswith("/")
        if tag in RAW and not (shut and (places.get("svg") or places.get("math"))):
            stop = _raw_end(tag).search(page, at) if at <= last else None
            at = stop.end() if stop else end
            continue
        if tag in HIDDEN:
            stop = None if shut or tag in endless or at > last else _raw_end(tag).search(page, at)
            if stop:
                at = stop.end()
            elif not shut:
                endless.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if places.get("p") and places["p"][-1] > highest(_FENCE):
                close_to(places["p"][-1])
            if tag in ENDS:
                ends, fences = ENDS[tag]
                k = highest(ends)
                if k >= 0 and k > highest(fences):
                    close_to(k)
        if tag in EMBED:
            alone = not any(map(str.strip, text))
        elif tag in ("text", "tspan") and places.get("svg"):
            text.append(" ")
        if not shut or tag in BLOCK:
            up = stack[-1] if stack else ROOT
            marks = _marks(attributes)
            places.setdefault(tag, []).append(len(stack))
            stack.append(Node(tag, up.tags if tag in up.tags else up.tags | {tag}, up.marks if up.marks.issuperset(marks) else up.marks.union(marks), up.deep + (tag in BLOCK)))
    flush()
    return out


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+>", re.I)


def features(b: Block) -> list[str]:
    """Features of a block by itself."""
    tags, marks = b.node.tags, b.node.marks
    out = ["bias", *(f"tag:{t}" for t in (tags & (BLOCK | EMBED)) - {"html", "body"})]
    out += [f"mark:{w}" for w in marks]
    if not tags & {"article", "main"} and "main" not in marks:
        out.append("outside")
    n, linked = _length(b), int(b.linked * 3.99)
    out += [f"words:{n}", f"linked:{linked}", f"words:{n}/linked:{linked > 1}"]
    if b.text[-1] in ".!?…»”\"'":
        out.append(f"sentence:{n}")
    if n <= 4 and re.match(r"\W*(?:©|\(c\)|copyright\b)|.*©", b.text, re.I):  # a line of its own; prose may speak of it
        out.append("rights")
    return out


def _length(b: Block) -> int:
    return min(6, (b.text.count(" ") + 1).bit_length())


def page_features(own: list[Block]) -> list[list[str]]:
    """Features of each block of a page: its own, the lengths and links of its neighbours, and whether a first heading came."""
    rows, headed = [], False
    for i, b in enumerate(own):
        row = features(b)
        for name, j in (("before", i - 1), ("after", i + 1)):
            row.append(f"{name}:{_length(own[j])}/{own[j].linked > 0.5}" if 0 <= j < len(own) else f"{name}:none")
        headed = headed or "h1" in b.node.tags
        row.append(f"headed:{headed}")
        rows.append(row)
    return rows


# Words in class and id that mark page parts, for the templates of the labelled pages.
OTHER = {
    "nav": "nav navbar menu breadcrumb breadcrumbs navigation pagination pager toc links tabs".split(),
    "header": "header masthead topbar banner branding logo site top".split(),
    "footer": "footer copyright legal bottom colophon credits imprint".split(),
    "aside": "sidebar aside related recommended widget popular trending teaser more rail".split(),
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion commercial partner".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay privacy warning disclaimer".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comment comments reply replies disqus discussion respond feedback reader".split(),
    "share": "share social sharing follow tags meta byline toolbar tools buttons".split(),
}
MAIN = "content article post entry story body main text page primary".split()


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of all kinds of layout with the label of each leaf block, the same for the same seed."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyzéñü", k=r.randint(2, 9)))

    def say(low: int, high: int) -> str:
        w = [word() for _ in range(r.randint(low, high))]
        return w[0].capitalize() + " " * (len(w) > 1) + " ".join(w[1:]) + r.choice([".", ".", ".", "", "!", "?"])

    plain = False

    def mark(words: list[str]) -> str:
        w = r.choice(words)
        if plain:  # words that say nothing
            return "" if r.random() < 0.5 else f' class="{word()}"'
        if words is not MAIN and r.random() < 0.25:  # the part's own word decides, whatever it is a part of
            w = "-".join(r.sample([w, r.choice(MAIN)], 2))
        elif words is MAIN and r.random() < 0.25:
            w = "-".join(r.sample([w, r.choice([*MAIN, word()])], 2))
        return f' {r.choice(["class", "class", "id"])}="{w}"' if r.random() < 0.85 else f' class="{word()} {w}"'

    pages = []
    for _ in range(n):
        body: list[str] = []
        labels: list[bool] = []
        plain = r.random() < 0.35

        def put(source: str, *own: bool, body=body, labels=labels) -> None:
            body.append(source)
            labels.extend(own)

        def other(kind: str, inside: bool = False, put=put) -> None:
            words = OTHER[kind]
            tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < (0.9 if plain else 0.7) else r.choice(["div", "div", "section"])
            attr = "" if tag == kind and r.random() < 0.5 else mark(words)
            if kind == "notice" and r.random() < 0.3:
                attr += ' role="alert"'
            style = r.random()
            if kind in ("nav", "share") or (kind in ("header", "footer", "aside") and style < 0.5):
                m = r.randint(2, 7)
                put(f"<{tag}{attr}><ul>" + "".join(f'<li><a href="/x">{say(1, 3)}</a></li>' for _ in range(m)) + f"</ul></{tag}>", *[False] * m)
            elif kind == "footer":
                put(f"<{tag}{attr}>&copy; {word()} &middot; {say(1, 12)}</{tag}>", False)
            elif kind == "form":
                put(f"<{tag}{attr}><p>{say(2, 12)}</p><label>{word()}</label><input><button>{word()}</button></{tag}>", False, False, False)
            elif kind == "comments":
                m = r.randint(1, 4)
                put(f"<{tag}{attr}>" + "".join(f"<div class=\"{r.choice(words)}\"><p>{say(2, 40)}</p></div>" for _ in range(m)) + f"</{tag}>", *[False] * m)
            else:
                inner = say(1, 30)
                put(f"<{tag}{attr}>" + r.choice([inner, f"<p>{inner}</p>", f'<p><a href="/y">{inner}</a></p>']) + f"</{tag}>", False)

        bare = r.random() < 0.2  # main text and nothing else, down to one block
        for kind in ("notice", "header", "nav", "ad"):
            if r.random() < 0.6 and not bare:
                other(kind)
        shell = r.choice(["article", "article", "main", "main><article", "div", "div", "div><section", "section", ""]) if not bare else r.choice(["", "", "article"])
        if shell:
            own = mark(MAIN) if shell.startswith(("div", "section")) or r.random() < 0.3 else ""
            put("<" + shell + own + (' role="main"' if r.random() < 0.15 else "") + ">")
        if r.random() < (0.3 if bare else 0.8):
            put(f"<h1>{say(1, 9)}</h1>", True)
            if shell and r.random() < 0.25:
                put(f"<{(tag := r.choice(['div', 'p', 'span']))}{mark(OTHER['share'])}>{say(2, 6)}</{tag}>", False)
        for _ in range(r.randint(1, 3 if bare else 9)):
            style = r.random()
            if bare and style < 0.4:
                put(f"<div>{say(1, 80)}</div>", True)
            elif style < 0.7 or not shell:
                put(f"<p>{say(1, 80) if r.random() < 0.5 else say(1, 5)}</p>", True)
            elif style < 0.75:
                put(f"<h2>{say(1, 6)}</h2>", True)
            elif style < 0.8:
                put(f"<blockquote><p>{say(3, 30)}</p></blockquote>", True)
            elif style < 0.85:
                m = r.randint(1, 5)
                put("<ul>" + "".join(f"<li>{say(1, 15)}</li>" for _ in range(m)) + "</ul>", *[True] * m)
            elif style < 0.88:
                put(f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>", True, True)
            elif style < 0.9:
                put(f"<pre>{say(2, 9)}</pre>", True)
            elif style < 0.93:
                put(f"<figure><figcaption>{say(2, 9)}</figcaption></figure>", True)
            elif style < 0.96:
                put(f'<p><a href="/z">{say(2, 9)}</a> {say(2, 20)}</p>', True)
            else:
                other(r.choice(["ad", "aside", "share", "notice", "form"]), True)
        if shell and r.random() < 0.25:
            other("comments", True)
        if shell:
            put("".join(f"</{t}>" for t in reversed(shell.split("><"))))
        for kind in ("share", "comments", "aside", "ad", "form", "footer"):
            if r.random() < 0.5 and not bare:
                other(kind)
        if r.random() < 0.15:
            put(f"<p>&copy; {say(1, 8)}</p>", False)
        pages.append(("<html><head><title>x</title></head><body>" + "".join(body) + "</body></html>", labels))
    return pages


def embedding_pages(n: int = 40, seed: int = 12) -> list[tuple[str, list[bool]]]:
    """Pages with noscript, object, canvas, svg and select: text as what is around it, but choices are never main text."""
    r = random.Random(seed)

    def say(low: int, high: int) -> str:
        return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzéñü", k=r.randint(2, 9))) for _ in range(r.randint(low, high))).capitalize() + "."

    def choices() -> tuple[str, list[bool]]:
        m = r.randint(1, 5)
        return "<select>" + "".join(f"<option>{say(1, 2)}</option>" for _ in range(m)) + "</select>", [False] * m

    pages = []
    for _ in range(n):
        parts: list[tuple[str, list[bool]]] = []
        if r.random() < 0.6:
            parts.append((f"<noscript>{say(3, 12)}</noscript>", [False]))
        parts.append((f'<nav><a href="/x">{say(1, 3)}</a></nav>', [False]))
        if r.random() < 0.4:
            parts.append(choices())
        shell = r.choice(["article", "main"])
        parts.append((f"<{shell}><h1>{say(2, 8)}</h1>", [True]))
        for _ in range(r.randint(2, 7)):
            tag, style = r.choice(sorted(EMBED)), r.random()
            if style < 0.5:
                parts.append((f"<p>{say(2, 60)}</p>", [True]))
            elif style < 0.9:
                parts.append((f"<{tag}>" + r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(say(2, 40)) + f"</{tag}>", [True]))
            else:
                parts.append(choices())
        parts.append((f"<p>{say(2, 60)}</p></{shell}>", [True]))
        if r.random() < 0.5:
            parts.append((f"<footer>{say(2, 9)}</footer>", [False]))
        pages.append(("<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [y for _, own in parts for y in own]))
    return pages


@dataclass
class Crf:
    """Weights of features by label, of label pairs, and of a label at either end; labels: 0 other, 1 main text."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    ends: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.names.get
        out = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            own = [k for k in map(get, row) if k is not None]
            out[i] = self.emit[own].sum(axis=0)
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        e = self.emissions(rows).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = e[0][0] + self.ends[0, 0], e[0][1] + self.ends[0, 1]
        back = []
        for x, y in e[1:]:
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((int(from0), int(from1)))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        now = int(a + self.ends[1, 0] < b + self.ends[1, 1])
        out = [now]
        for pair in reversed(back):
            now = pair[now]
            out.append(now)
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, ridge: float = 0.02) -> Crf:
    """Gradient ascent (Adam) on the mean conditional log-likelihood of the label sequences."""
    rows = [page_features(blocks(p)) for p, _ in pages]
    for r, (p, y) in zip(rows, pages, strict=True):
        if len(r) != len(y):
            raise ValueError(f"{len(y)} labels for {len(r)} blocks of {p[:200]}")
    names = {k: i for i, k in enumerate(sorted({k for page in rows for row in page for k in row}))}
    n, t = len(rows), max(map(len, rows))
    width = max(len(x) for page in rows for x in page)
    own = np.full((n, t, width), len(names))
    label, live = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (page, (_, y)) in enumerate(zip(rows, pages, strict=True)):
        live[i, : len(page)], label[i, : len(page)] = True, y
        for j, row in enumerate(page):
            own[i, j, : len(row)] = [names[k] for k in row]
    size = live.sum(axis=1)
    last, who = size - 1, np.arange(n)
    truth = np.eye(2)[label] * live[:, :, None]
    pairs_true = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    w = [np.zeros((len(names) + 1, 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for k in range(1, rounds + 1):
        emit, step, ends = w
        e = emit[own].sum(axis=2)
        f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = e[:, 0] + ends[0]
        for j in range(1, t):
            f[:, j] = np.where(live[:, j, None], _lse(f[:, j - 1, :, None] + step, 1) + e[:, j], f[:, j - 1])
        b[who, last] = ends[1]
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(live[:, j + 1, None], _lse(step + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), b[:, j])
        z = _lse(f[who, last] + ends[1], 1)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        both = np.exp(f[:, :-1, :, None] + step + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        diff = truth - p
        g = [np.zeros_like(emit), pairs_true - both.sum(axis=(0, 1)), np.stack([diff[:, 0].sum(axis=0), diff[who, last].sum(axis=0)])]
        for c in range(2):
            g[0][:, c] = np.bincount(own.reshape(-1), weights=np.repeat(diff[:, :, c].reshape(-1), width), minlength=len(names) + 1)
        for i in range(3):
            grad = g[i] / n - ridge * w[i] / 10
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.99 * v[i] + 0.01 * grad**2
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        w[0][-1] = 0
    return Crf(names, *w)


@lru_cache(1)
def default_model() -> Crf:
    return train(labelled_pages() + embedding_pages())


def main_text(page: str | None, model: Crf) -> str:
    own = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(own, model.viterbi(page_features(own)), strict=True) if y)


def extract_text(pages: DataFrame, model: Crf | None = None, html_col: str = "html") -> DataFrame:
    """The pages with ``text``, the main text (empty if there is none or the html is null), and n_chars, its code points.

    All other columns stay; columns named text or n_chars give way. One pass; no rows give no rows.
    """
    small_batches(pages.sparkSession)
    model = model or default_model()
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index(html_col)
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = []
            for x in batch.column(at).cast(pa.large_binary()).to_pylist():
                text = main_text(None if x is None else x.decode("utf-8", "replace"), model)
                texts.append(text.encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
