"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags. Each block is a vector
of its tag path (every open element, by name, class and id), its hashed words and a few measures
(length, share of links, punctuation, place). A bidirectional LSTM in numpy reads the whole sequence
and labels every block as main text or not, so a block's label depends on the document around it.

The network learns when it is first needed, from generated pages whose parts are known: menus, headers,
footers, sidebars, notices, adverts, forms and comments in many spellings around and inside articles.
Generation and training use a fixed seed.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import over_texts

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 48, 24, 8, 24
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
PAGES, EPOCHS, BATCH, SEED = 2400, 8, 32, 11

_BLOCK_TAGS = frozenset("html body article section nav header footer aside main div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog center hgroup menu label button select option optgroup iframe head".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg object canvas audio video iframe select".split())
#: Raw elements whose content is never markup: unclosed, they run to the end of the page, as in browsers, and
#: the first end tag closes them. Others nest, and unclosed they end with their tag.
_TEXT_ONLY = frozenset("script style textarea title".split())
#: Padded steps that the network reads at once, and blocks whose words are looked up at once.
CELLS, _AT_ONCE = 1 << 14, 4096
_CLOSES_P = _BLOCK_TAGS - {"label", "button", "select", "option", "optgroup", "html", "body", "head", "iframe"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div aside nav main body form".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)""", re.S)
#: As _TAG after the last > of a page, where no tag can end: so that nothing is searched to the end again and again.
_CUT = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|()()()<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Element:
    """An open element: its parent, depth, name and marks (classes, ids and role)."""

    __slots__ = ("parent", "depth", "name", "marks", "_sums")

    def __init__(self, parent: "Element | None", name: str, marks: list[str]):
        self.parent, self.depth, self.name, self.marks, self._sums = parent, parent.depth + 1 if parent else 0, name, marks, None

    def vector(self) -> np.ndarray:
        """The signs of all elements from the outermost to this one, which counts most."""
        todo, at = [], self
        while at._sums is None:
            todo.append(at)
            if at.parent is None:
                break
            at = at.parent
        for element in reversed(todo):
            above = element.parent._sums[0] if element.parent else np.zeros(PATH_DIMS, np.float32)
            own, leaf = np.zeros(PATH_DIMS, np.float32), np.zeros(PATH_DIMS, np.float32)
            for mark in element.marks:
                if mark not in ("html", "body", "div"):
                    own += _signs(mark, PATH_DIMS)
                    leaf += _signs(f"leaf {mark}", PATH_DIMS)
            element._sums = above + own * np.float32(0.35), above + own * np.float32(0.5) + leaf * np.float32(0.25)
        return self._sums[1]


_ROOT = Element(None, "", [])


def _ends(page: str, name: str) -> dict[int, int]:
    """Where each raw element of a name ends, by the end of its tag; elements without an end are left out."""
    last = page.rfind(">") + 1
    if name in _TEXT_ONLY:
        opens, closes = ([m.end() for m in re.compile(rx, re.I).finditer(page, 0, last)] for rx in (rf"<{name}(?![\w:-])[^>]*>", rf"</{name}\s*>"))
        at = np.searchsorted(closes, opens, "right").tolist()
        return {o: closes[k] for o, k in zip(opens, at) if k < len(closes)}
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){name}(?![\w:-])([^<>]*)>", page, re.I):
        if not m[1]:
            if not m[2].endswith("/"):
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def blocks(page: str) -> list[tuple[Element, str, int]]:
    """Element, text and number of characters in links of each leaf block, in page order.

    Character references are decoded and white space, line breaks included, becomes one space. Blocks
    without text are left out, as is what scripts, styles and other raw elements hold; those that may
    nest end where as many were closed as opened. A raw element without an end tag holds the rest of the
    page if it is a script, style, textarea or title, else nothing; a self-closed one holds nothing.
    """
    out: list[tuple[Element, str, int]] = []
    open_: list[Element] = [_ROOT]
    count: Counter[str] = Counter()
    parts: list[str] = []
    state = {"link": 0, "in": False}
    at, end, last = 0, len(page), page.rfind(">")
    closed: dict[str, dict[int, int]] = {}

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((open_[-1], text, min(state["link"], len(text))))
            parts.clear()
        state["link"] = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["in"]:
                state["link"] += len(text.strip())

    def close(*names: str) -> None:
        """Close the innermost element of these names and all in it."""
        while any(count[n] for n in names):
            gone = open_.pop().name
            count[gone] -= 1
            if gone in names:
                return

    def close_sibling(siblings: set[str]) -> None:
        """Close the innermost of these elements unless a container stands between."""
        if any(count[n] for n in siblings):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name in siblings:
                    return close(open_[k].name)
                if open_[k].name in _SCOPE:
                    return None

    while at < end:
        found = (_TAG if at <= last else _CUT).search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing = name.lower(), bool(found[1] or found[4])
        if name in _RAW and not closing:
            if name in _TEXT_ONLY or not page.endswith("/>", 0, at):
                if name not in closed:
                    closed[name] = _ends(page, name)
                at = closed[name].get(at, end if name in _TEXT_ONLY else at)
            if name in _BLOCK_TAGS:
                flush()
        elif name in ("br", "hr"):
            if name == "hr":
                flush()
            parts.append(" ")
        elif name == "a":
            state["in"] = not closing
        elif name in _BLOCK_TAGS:
            flush()
            if closing:
                close(name)
                state["in"] = False
                continue
            if name in _CLOSES_P:
                close("p")
            if name in _SIBLING:
                close_sibling(_SIBLING[name])
            marks = [name]
            for m in _NAMES.finditer(found[3] or found[6] or ""):
                marks += [f".{p}" for p in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
            open_.append(Element(open_[-1], name, marks))
            count[name] += 1
    flush()
    return out


@functools.lru_cache(200_000)
def _signs(word: str, dims: int) -> np.ndarray:
    bits = zlib.crc32(word.encode()) | zlib.crc32(word.encode() + b"+") << 32
    return np.array([1.0 if bits >> k & 1 else -1.0 for k in range(dims)], np.float32)


_WORD_SIGNS = np.stack([_signs(f"word {k}", WORD_DIMS) for k in range(8192)])


class _Buckets(dict):
    """The row of _WORD_SIGNS of a word; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = row = zlib.crc32(word.encode()) & 8191
        return row


_BUCKETS = _Buckets()


def vectors(found: list[tuple[Element, str, int]]) -> np.ndarray:
    """A row for each block; all words of a block count."""
    out = np.zeros((len(found), DIMS), np.float32)
    row_of = _BUCKETS
    for s in range(0, len(found), _AT_ONCE):
        words, counts, measures = [], [], []
        for k, (element, text, linked) in enumerate(found[s : s + _AT_ONCE], s):
            n, sums, rest = len(text), np.zeros(8192, np.int64), text.lower()
            if n > 1 << 16:  # a very long block is counted by bucket
                own = 0
                for w in _words(rest):
                    sums[row_of[w]] += 1
                    own += 1
                out[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.clip((sums @ _WORD_SIGNS) * 0.5 / max(own, 1) ** 0.5, -1.5, 1.5)
                counts.append(0)
            else:
                own = rest.split()
                words += [row_of[w] for w in own]
                counts.append(len(own))
            out[k, :PATH_DIMS] = element.vector()
            measures.append((min(n, 2000) / 500, math.log1p(n) / 4, linked / n, min(20, text.count(". ") + text.count(", ")) / 10, text[-1] in ".!?\"'", k / len(found), min(element.depth, 40) / 8, 1))
        some = np.flatnonzero(counts)
        if len(some):
            n = np.array(counts)[some]
            sums = np.add.reduceat(_WORD_SIGNS[words], np.cumsum([0, *n[:-1]]), axis=0)
            out[s + some, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.clip(sums * (0.5 / np.sqrt(n.astype(np.float32)))[:, None], -1.5, 1.5)
        out[s : s + _AT_ONCE, -MEASURES:] = measures
    return out


def _words(text: str) -> Iterator[str]:
    return (m[0] for m in re.finditer(r"\S+", text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """One layer in each direction and a logistic output for every step."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (r.normal(size=(DIMS, 4 * HIDDEN)) / DIMS**0.5).astype(np.float32)
            self.w[f"h{d}"] = (r.normal(size=(HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            self.w[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.w["o"] = (r.normal(size=2 * HIDDEN) / HIDDEN**0.5).astype(np.float32)
        self.w["p"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep):
        steps, size, _ = x.shape
        gates, base = np.zeros((0, 0), np.float32), None  # of as many steps as are worth a product
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out, kept = np.zeros((steps, size, HIDDEN), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            if t // _AT_ONCE != base:
                base = t // _AT_ONCE
                gates = x[base * _AT_ONCE : (base + 1) * _AT_ONCE] @ self.w[f"x{d}"] + self.w[f"c{d}"]
            g = gates[t % _AT_ONCE] + h @ self.w[f"h{d}"]
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, n = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * n
            squash = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                kept[t] = i, f, o, n, c, h, squash
            c, h = m * new + (1 - m) * c, m * (o * squash) + (1 - m) * h
            out[t] = h
        return out, kept

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["p"])

    def gradients(self, x, mask, y) -> dict[str, np.ndarray]:
        ran = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([ran[d][0] for d in "fb"], axis=2)
        error = (_sigmoid(both @ self.w["o"] + self.w["p"]) - y) * mask / mask.sum()
        out = {"o": (both * error[..., None]).sum((0, 1)), "p": np.array([error.sum()])}
        for d, half in (("f", self.w["o"][:HIDDEN]), ("b", self.w["o"][HIDDEN:])):
            above, kept = error[..., None] * half, ran[d][1]
            dx, dh, dc = np.zeros_like(self.w[f"h{d}"]), np.zeros_like(above[0]), np.zeros_like(above[0])
            all_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                i, f, o, n, c, h, squash = kept[t]
                m = mask[t][:, None]
                total = above[t] + dh
                inner = m * total * o * (1 - squash**2) + m * dc
                g = np.concatenate([inner * n * i * (1 - i), inner * c * f * (1 - f), m * total * squash * o * (1 - o), inner * i * (1 - n**2)], axis=1)
                all_gates[t] = g
                dx += h.T @ g
                dh = g @ self.w[f"h{d}"].T + (1 - m) * total
                dc = inner * f + (1 - m) * dc
            out[f"h{d}"], out[f"c{d}"] = dx, all_gates.sum((0, 1))
            out[f"x{d}"] = np.einsum("tbd,tbg->dg", x, all_gates)
        return out


_MAIN = ["article", "main", "section.content", "div.content", "div.post", "div.entry", "div.article", "div.story", "div.text", "section", "div", "div.page", "div.body"]
_JUNK = {
    "menu": ["nav", "ul.menu", "div.nav", "div.navbar", "div.navigation", "div.breadcrumbs", "nav.main", "div.menu", "ul.links", "div.pagination", "div.tags", "div.toolbar"],
    "header": ["header", "div.header", "div.masthead", "div.banner", "div.top", "div.logo", "header.site"],
    "footer": ["footer", "div.footer", "div.copyright", "footer.site", "div.legal", "div.bottom", "div.colophon"],
    "side": ["aside", "div.sidebar", "div.widget", "div.related", "aside.side", "section.related", "div.recommended", "div.more", "div.trending", "div.author", "div.bio"],
    "notice": ["div.cookie", "div.notice", "div.consent", "div.alert", "div.gdpr", "div.banner", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.message", "dialog", "section.notice", "p.notice", "div.disclaimer", "div.paywall"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "section.sponsor", "div.promotion", "ins.adsbygoogle", "p.ad"],
    "form": ["form", "form.search", "form.login", "div.form", "form.contact", "div.signup", "fieldset", "div.poll"],
    "comment": ["div.comments", "section.comments", "ol.commentlist", "div.comment", "div.replies", "div.discussion", "section.responses", "ul.comments", "div.disqus", "article.comment", "div.reader"],
    "share": ["div.share", "div.social", "ul.share", "div.meta", "p.byline", "div.rating"],
}
_SAID = {
    "menu": "home about contact news sports business archive blog login next previous page products services".split(),
    "header": "welcome site logo search your trusted source online daily".split(),
    "footer": "© copyright all rights reserved terms privacy policy contact imprint 2024".split(),
    "side": "related popular most read more stories you may also like trending about the author".split(),
    "notice": "we use cookies accept subscribe newsletter consent this site javascript enable agree notice".split(),
    "advert": "advertisement sponsored buy now sale discount offer free shipping click here order".split(),
    "form": "name email password submit search send login register username message".split(),
    "comment": "reply comment says posted ago report like i think great thanks agree anonymous".split(),
    "share": "share tweet facebook print email by posted updated min read".split(),
}


#: Marks that say nothing, on main parts and others alike.
_NEUTRAL = "container row col md lg grid box wrap inner outer left right page block unit clearfix layout cell span fluid default top wide".split()


def _generated(r: random.Random) -> tuple[str, set[str]]:
    """A page, and its main blocks; every block is a text of its own."""
    parts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéüñßø", k=r.randint(1, 3))) for _ in range(40)]
    main: set[str] = set()
    style, ended = r.choice(["", "", "", "", "!!", " |", "&&&", "$"]), r.choice([0.85, 0.85, 0.3])

    def text(n: int, said: list[str] = (), mix: float = 0.0) -> str:
        found = [r.choice(said) if said and r.random() < mix else "".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(max(1, n))]
        for k in range(0, len(found), 9):
            found[k] = found[k].capitalize()
            if k and r.random() < 0.8:
                found[k - 1] += r.choice([".", ",", "?", ";"])
        if r.random() < 0.04:
            found = [found[0]] * len(found)
        if style and r.random() < 0.7:
            found = [w + style for w in found] if r.random() < 0.6 else [w.upper() + style for w in found]
        return " ".join(found) + ("." if n > 1 and r.random() < ended else "")

    def wrap(spec: str, inside: str) -> str:
        name, _, mark = spec.partition(".")
        kind = "id" if r.random() < 0.3 else "class"
        extra = r.choice(["", "", "-wrap", " box", "-1", "_inner", " clearfix"])
        said = f"{mark}{extra}" if mark else ""
        if r.random() < 0.25:
            said = f"{neutral()} {said}" if r.random() < 0.7 else f"{said} {neutral()}"
        return f"<{name} {kind}=\"{said.strip()}\">{inside}</{name}>" if said else f"<{name}>{inside}</{name}>"

    def neutral() -> str:
        """Marks without a meaning: of layouts, or letters in any language."""
        return r.choice([f"{r.choice(_NEUTRAL)}-{r.choice(_NEUTRAL)}-{r.randrange(12)}", r.choice(_NEUTRAL), "".join(r.choices(parts, k=2))])

    def layers(inside: str) -> str:
        """Some meaningless elements around a part."""
        for _ in range(r.choice([0, 0, 1, 1, 2, 3]) if layered else 0):
            inside = f"<div class=\"{neutral()}\">{inside}</div>" if r.random() < 0.8 else f"<div>{inside}</div>"
        return inside

    def link(t: str) -> str:
        return f'<a href="/{r.randrange(99)}">{t}</a>'

    def junk(kind: str) -> str:
        said, spec = _SAID[kind], r.choice(_JUNK[kind])
        long = kind in ("notice", "advert", "comment", "side", "footer") and r.random() < 0.6
        items = []
        for _ in range(r.randrange(1, 8 if kind in ("menu", "comment", "side") else 4)):
            t = text(r.randrange(6, 45) if long else r.randrange(1, 6), said, r.choice([0.0, 0.3, 0.6]))
            items.append(link(t) if kind in ("menu", "share") or kind in ("side", "footer") and r.random() < 0.5 else t)
        if kind == "menu" and spec.split(".")[0] != "ul":
            inside = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)
        elif spec[:2] in ("ul", "ol"):
            inside = "".join(f"<li>{t}</li>" for t in items)
        elif kind == "form":
            inside = "".join(f"<label>{t}</label><input>" for t in items) + "<button>ok</button>"
        elif spec[:2] == "p." or len(items) == 1 and r.random() < 0.7:
            inside = items[0]
        else:
            inside = (f"<h3>{text(2, said, 0.5)}</h3>" if r.random() < 0.4 else "") + "".join(f"<{t}>{x}</{t}>" for x in items for t in [r.choice(["p", "div", "p"])])
        return wrap(spec, inside)

    def kept(t: str) -> str:
        main.add(t)
        return t

    layered = r.random() < 0.4
    body = []
    title = kept(text(r.randrange(2, 12)))
    if r.random() < 0.8:
        body.append(f"<h1>{title}</h1>")
    for _ in range(r.choice([1, 3, 6, 12, 25])):
        x = r.random()
        if x < 0.72:
            t = kept(text(r.choice([1, 3, 6, 15, 40, 90, 200])))
            body.append(f"<p><b>{t}<br>" if r.random() < 0.12 else f"<p>{t}</p>" if r.random() < 0.9 else f"<p>{t}")
        elif x < 0.79:
            body.append(f"<h{r.randrange(2, 4)}>{kept(text(r.randrange(1, 7)))}</h2>")
        elif x < 0.87:
            tag = r.choice(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(f"<li>{kept(text(r.randrange(2, 20)))}</li>" for _ in range(r.randrange(2, 6))) + f"</{tag}>")
        elif x < 0.91:
            body.append(f"<blockquote>{kept(text(r.randrange(8, 40)))}</blockquote>")
        elif x < 0.94:
            head = f"<tr><th>{kept(text(1))}</th><th>{kept(text(1))}</th></tr>" if r.random() < 0.4 else ""
            body.append("<table>" + head + "".join(f"<tr><td>{kept(text(r.randrange(1, 5)))}</td><td>{kept(text(2))}</td></tr>" for _ in range(r.randrange(1, 4))) + "</table>")
        elif x < 0.95:
            body.append(f"<pre>{kept(text(r.randrange(2, 12)))}</pre>" if r.random() < 0.5 else f"<figure><figcaption>{kept(text(r.randrange(2, 12)))}</figcaption></figure>")
        else:
            body.append(junk(r.choice(["advert", "side", "notice", "share"])))
    if r.random() < 0.3:
        body.insert(r.randrange(len(body) + 1), junk(r.choice(["share", "advert", "comment", "form"])))
    if r.random() < 0.25:
        body.append(junk("comment"))
    inside = wrap(r.choice(_MAIN), "".join(body))
    if r.random() < 0.08:
        inside = "".join(body)  # an article without an element of its own
    if r.random() < 0.3:
        side = junk("side") if r.random() < 0.5 else junk("menu") if r.random() < 0.2 else ""
        inside = wrap(r.choice(["div.container", "div.wrapper", "main", "div"]), layers(inside) + layers(side) if r.random() < 0.7 else layers(side) + layers(inside))
    elif r.random() < 0.15:
        cells = [f"<td class=\"{r.choice(['menu', 'nav', 'side', neutral()])}\">{junk(r.choice(['menu', 'side']))}</td>", f"<td class=\"{neutral()}\">{inside}</td>" if r.random() < 0.7 else f"<td>{inside}</td>"]
        inside = "<table><tr>" + "".join(cells if r.random() < 0.7 else cells[::-1]) + "</tr></table>"
    inside = layers(inside)
    before = [layers(junk(k)) for k in ("header", "menu", "notice", "advert", "form", "side") if r.random() < 0.45]
    after = [layers(junk(k)) for k in ("comment", "side", "advert", "share", "form", "notice", "menu", "footer") if r.random() < 0.45]
    page = "<html><head><title>x</title></head><body>" + "".join(before) + inside + "".join(after)
    return page + ("</body></html>" if r.random() < 0.9 else ""), main


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), DIMS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


@functools.lru_cache(1)
def trained() -> BiLstm:
    r, net, data, pages = np.random.default_rng(SEED), BiLstm(SEED), [], random.Random(SEED)
    while len(data) < PAGES:
        page, main = _generated(pages)
        if found := blocks(page):
            data.append((vectors(found), np.array([entities.unescape(t) in main for _, t, _ in found], np.float32)))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = sorted(r.permutation(len(data)).tolist(), key=lambda k: (len(data[k][0]) // 8, k % 7))
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for g in r.permutation(len(groups)):
            x, mask = _padded([data[k][0] for k in groups[g]])
            y = np.zeros_like(mask)
            for b, k in enumerate(groups[g]):
                y[: len(data[k][1]), b] = data[k][1]
            step += 1
            for name, grad in net.gradients(x, mask, y).items():
                grad = np.clip(grad, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.99 * second[name] + 0.01 * grad**2
                net.w[name] = (net.w[name] - 0.012 * (1 - epoch / EPOCHS) * (first[name] / (1 - 0.9**step)) / ((second[name] / (1 - 0.99**step)) ** 0.5 + 1e-8)).astype(np.float32)
    return net


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Numbers of pages by length, so many together that their padded steps stay within CELLS; a longer page is alone."""
    group: list[int] = []
    for k in sorted(range(len(lengths)), key=lengths.__getitem__):
        if group and lengths[k] * (len(group) + 1) > CELLS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def main_texts(net: BiLstm, pages: list[str | None]) -> list[str]:
    """The main text of each page, '' where there is none."""
    out = [""] * len(pages)
    found = [blocks(p) if p else [] for p in pages]
    for group in _groups([len(b) for b in found]):
        if group := [k for k in group if found[k]]:
            chances = net.chances(*_padded([vectors(found[k]) for k in group]))
            for b, k in enumerate(group):
                out[k] = "\n".join(t for (_, t, _), c in zip(found[k], chances[:, b]) if c >= 0.5)
                found[k] = []
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Main texts of pages (page_id, url, html, ...): page_id, url, text, n_chars for every row.

    text is the article without menus, headers, footers, sidebars, notices, adverts, forms, comments and
    markup; its blocks stand in page order, one in a line. Null, empty or text-free html gives ''.
    n_chars counts code points. Repeated rows give repeated results; null ids and urls stay null.
    """
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(over_texts(run, 2), f"page_id {kind}, url string, text string, n_chars long")
