"""HTML extraction (operator 8) by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, with the path of open tags and their classes above it.
A bidirectional LSTM in numpy reads a page's blocks in order, each as a vector of hashed path and word features, and labels every
block as main text or not, with the whole page as context. It is trained once a run, by a rule: ``teach`` writes pages of
many layouts whose labels are known, from a fixed seed, and the weights go to the workers.

Defined results: a null page is an empty one; pages without main text have an empty text; in broken markup a closing tag without its opening
one is ignored, inline tags close out of order, blocks that can't hold each other close, a slash closes void elements only, and a tag whose quote stays open
is skipped up to its next bracket; rows are independent, so ties, repeated rows and an empty table need nothing; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features of a block's path, its own words, and its measures.
PATH_BUCKETS, WORD_BUCKETS, MEASURES = 256, 24, 8
INPUTS = PATH_BUCKETS + WORD_BUCKETS + MEASURES
HIDDEN = 16
#: Blocks that are stepped together in one batch.
BATCH_BLOCKS = 60_000

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl li table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote hr address fieldset figure".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?=/?[A-Za-z])[^>]*(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|itemprop|type)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
PIECES = re.compile(r"[a-z]+")


@dataclass
class Piece:
    """A block: its text, and what stands above and within it."""

    text: str
    path: tuple[str, ...]
    linked: int = 0
    tags: set[str] = field(default_factory=set)


def _marks(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            out.append("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
        elif name != "type":
            out += [f"{name}.{w}" for w in PIECES.findall(value)]
    return tuple(out)


def blocks(page: str) -> list[Piece]:
    """The page's blocks in order; character references decoded and white space made one space."""
    out: list[Piece] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()  # of the stack, by name
    parts: list[str] = []
    linked, tags = 0, set()

    def flush() -> None:
        nonlocal parts, linked, tags
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                path = tuple(x for name, marks in stack for x in (marks if name in INLINE else (name, *marks)))
                out.append(Piece(text, path, linked, tags))
        parts, linked, tags = [], 0, set()

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            parts.append(m[4])
            if opened["a"]:
                linked += len(m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                i = len(stack) - 1 if opened[name] else -1
                while i >= 0 and stack[i][0] in INLINE and stack[i][0] != name:
                    i -= 1
                if i >= 0 and stack[i][0] == name:
                    del stack[i]
                    opened[name] -= 1
                continue
            flush()
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in INLINE:
            tags.add(name)
            if name not in VOID:
                stack.append((name, _marks(m[3])))
                opened[name] += 1
            continue
        flush()
        if name in VOID:
            continue
        while stack and (stack[-1][0] in INLINE or name in CLOSED_BY.get(stack[-1][0], ())):
            if stack[-1][0] in INLINE and not any(name in CLOSED_BY.get(n, ()) for n, _ in stack):
                break
            opened[stack.pop()[0]] -= 1
        stack.append((name, _marks(m[3])))
        opened[name] += 1
    flush()
    return out


def vectors(pieces: list[Piece]) -> np.ndarray:
    """One row of features for each block."""
    x = np.zeros((len(pieces), INPUTS), np.float32)
    total = sum(len(p.text) for p in pieces) or 1
    for row, p in zip(x, pieces, strict=True):
        for depth, name in enumerate(p.path):
            row[zlib.crc32(name.encode()) % PATH_BUCKETS] += 1.0 if depth else 0.5
            if "." in name:  # the start of a mark tells its kin: comment, comments, commentary
                row[zlib.crc32(name[: name.index(".") + 6].encode()) % PATH_BUCKETS] += 1.0
        words = p.text.split()
        share = 0.1 * min(1.0, 24 / max(len(words), 1))  # long blocks weigh no more than short ones
        for w in words:
            row[PATH_BUCKETS + zlib.crc32(w[:4].lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS] += share
        k = PATH_BUCKETS + WORD_BUCKETS
        n = len(p.text)
        row[k : k + MEASURES] = (min(len(words), 60) / 60, min(p.linked / n, 1.0), n / total, min(len(p.path), 20) / 20, any(c in ".!?" for c in p.text), "©" in p.text, len(words) < 4, 1.0)
    return np.minimum(x, 2.0)


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {}
        for side in ("f", "b"):
            self.w[side + "x"] = (rng.standard_normal((INPUTS, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.w[side + "h"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.w[side + "b"] = bias
        self.w["o"] = (rng.standard_normal((2 * HIDDEN + INPUTS, 1)) * 0.1).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * x))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False):
        """Hidden states (time, pages, HIDDEN); masked steps carry the state on."""
        steps, n, _ = x.shape
        given = x @ self.w[side + "x"] + self.w[side + "b"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w[side + "h"]
            i, f, o = (self._sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                trace.append((t, i, f, o, g, c, h, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        joint = np.concatenate([f, b, x], axis=2)
        p = self._sigmoid(joint @ self.w["o"] + self.w["ob"])[:, :, 0]
        return (p, joint, tf, tb) if keep else p

    def _back(self, x: np.ndarray, side: str, trace: list, gh: np.ndarray, grads: dict) -> None:
        """Back through time: adds the gradients of one direction's weights."""
        dh = np.zeros(gh.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        gz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gw = np.zeros_like(self.w[side + "h"])
        for t, i, f, o, g, c0, h0, tc, m in reversed(trace):
            dh = dh + gh[t]
            do, dnew = dh * m * tc, dh * m * o * (1 - tc * tc) + dc * m
            z = np.concatenate([dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            gz[t] = z
            gw += h0.T @ z
            dh = dh * (1 - m) + z @ self.w[side + "h"].T
            dc = dc * (1 - m) + dnew * f
        grads[side + "h"] = gw
        grads[side + "x"] = np.einsum("tni,tnj->ij", x, gz, optimize=True)
        grads[side + "b"] = gz.sum(axis=(0, 1))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the cross entropy of every block."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        turn = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                part = [pages[i] for i in order[lo : lo + batch]]
                x, mask = pad([p[0] for p in part])
                y = np.zeros(mask.shape, np.float32)
                for j, (_, labels) in enumerate(part):
                    y[: len(labels), j] = labels
                p, joint, tf, tb = self.scores(x, mask, True)
                d = ((p - y) * mask / max(1.0, mask.sum()))[:, :, None].astype(np.float32)
                grads = {"o": np.einsum("tni,tnj->ij", joint, d, optimize=True), "ob": d.sum(axis=(0, 1))}
                gj = d @ self.w["o"].T
                self._back(x, "f", tf, gj[:, :, :HIDDEN], grads)
                self._back(x, "b", tb, gj[:, :, HIDDEN : 2 * HIDDEN], grads)
                turn += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, INPUTS) and the mask of real blocks."""
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


_SYLLABLES = "an be che de el fer gra ha is jo ka lo mi ne or pa qua re so ti un va we xi za stra ble tion ment keit ción".split()


def teach(n: int, seed: int) -> Iterator[tuple[str, list[bool]]]:
    """Pages of random layouts with the label of every block, in order, true for main text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))
    shouts = ["", "!!", "###", "&amp;&amp;", "%%%", "***"]

    def words(lo: int, hi: int) -> str:
        tail = rng.choice(shouts) if rng.random() < 0.15 else ""
        text = " ".join(word() + tail for _ in range(rng.randint(lo, hi)))
        return text.upper() if rng.random() < 0.08 else text.capitalize()

    def prose(out: list, depth: int = 0) -> str:
        out.append(True)
        kind = rng.random()
        text = words(1, 40) + rng.choice([".", ".", "", "?"])
        if kind < 0.15:
            text = text.replace(" ", " <b>", 1) + rng.choice(["</b>", ""])
        elif kind < 0.25:
            text = text.replace(" ", ' <a href="/x">', 1) + "</a>"
        if rng.random() < 0.12:
            text += "<br>" + words(2, 12) + "."
            out.append(True)
        tag = rng.choice(["p"] * 8 + ["h2", "h3", "blockquote", "li", "td", "pre"])
        return f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.85 else "")

    def rich(out: list) -> str:
        """Text in other shapes: tables, definitions, code, figures, questions, lists, plain lines."""
        figure = lambda: str(rng.choice([rng.randint(1, 99), rng.randint(1900, 2030), f"{rng.randint(1, 9)}.{rng.randint(0, 99)}"]))
        short = lambda: rng.choice([words(1, 2), words(1, 4), figure(), figure()])
        kind = rng.randrange(7)
        if kind == 0:
            rows, wide, head = rng.randint(1, 5), rng.randint(1, 4), rng.random() < 0.6
            out += [True] * (wide * (rows + head))
            line = lambda tag, f: "<tr>" + "".join(f"<{tag}>{f()}</{tag}>" for _ in range(wide)) + "</tr>"
            return "<table>" + (line("th", lambda: words(1, 2)) if head else "") + "".join(line("td", short) for _ in range(rows)) + "</table>"
        if kind == 1:
            n = rng.randint(1, 4)
            out += [True] * (2 * n)
            return "<dl>" + "".join(f"<dt>{words(1, 3)}</dt><dd>{words(1, 10)}</dd>" for _ in range(n)) + "</dl>"
        if kind == 2:
            out.append(True)
            return f"<pre>{word()} {figure()} --{word()}\n{word()}/{word()} = {figure()}</pre>"
        if kind == 3:
            out.append(True)
            return f'<figure><img src="/x.jpg"><figcaption>{words(2, 12)}</figcaption></figure>'
        if kind == 4:
            out += [True, True]
            return f"<h3>{words(2, 8)}?</h3><p>{words(3, 20)}.</p>"
        if kind == 5:
            n = rng.randint(2, 6)
            out += [True] * n
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{rng.choice([words(1, 4), words(4, 14) + '.'])}</li>" for _ in range(n)) + f"</{tag}>"
        out += [True, True]
        return f"<h2>{words(1, 5)}</h2><p>{words(3, 8)}.</p>"

    def nav(out: list) -> str:
        k = rng.randint(2, 8)
        if rng.random() < 0.2:  # links side by side in one block
            out.append(False)
            return f"<div class='{word()}'>" + " ".join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(k)) + "</div>"
        out += [False] * k
        if rng.random() < 0.15:  # links side by side in a table
            return "<table><tr>" + "".join(f'<td><a href="/{word()}">{words(1, 3)}</a></td>' for _ in range(k)) + "</tr></table>"
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))
        return rng.choice(["<nav><ul>{}</ul></nav>", f'<ul class="{word()}">{{}}</ul>', '<div class="menu"><ul>{}</ul></div>', '<ul class="nav navbar">{}</ul>', '<div id="navigation" role="navigation"><ul>{}</ul></div>', '<div class="breadcrumb"><ol>{}</ol></div>']).format(items)

    def noise(out: list, shapes: list[str], lo: int = 2, hi: int = 30) -> str:
        out.append(False)
        return rng.choice(shapes).format(words(lo, hi) + rng.choice(["", "."]))

    ad = ['<div class="ad">{}</div>', '<div class="advert banner"><p>{}</p></div>', '<div id="ads">{}</div>', '<aside class="sponsored promo"><p>{}</p></aside>', '<div class="advertisement">{}</div>', '<div class="ad-slot">{}</div>', '<div class="promo-banner"><p>{}</p></div>']
    foot = ['<div class="legal">&copy; {}</div>', '<div class="copyright">{}</div>', "<footer>&copy; {}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">&copy; {}</div>', '<div id="footer"><p>{}</p></div>', "<footer>&copy; {} &middot; x.example.com</footer>", '<div class="footer">(c) {}</div>', '<div class="legal-notice"><p>{}</p></div>', "<footer><small>{}</small></footer>", "<address>{}@example.com</address>"]
    head = ['<div class="topbar">{}</div>', '<div class="top-bar {0}">{0}</div>', "<header>{}</header>", "<header><p>{}</p></header>", '<div class="header logo">{}</div>', '<div id="masthead"><p>{}</p></div>']
    side = ['<div class="rail"><h3>{}</h3></div>', '<div class="read-more also"><p><a href="/x">{}</a></p></div>', '<div class="archive"><h3>{}</h3></div>', f'<div class="{word()}"><p><a href="/y">{{}}</a></p></div>', "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div id="sidebar"><h3>{}</h3></div>', '<div class="widget related"><p>{}</p></div>', '<div class="share"><a href="/s">{}</a></div>', '<div class="tags"><a href="/t">{}</a></div>', '<div class="pager"><a href="/n">{}</a></div>']
    notice = ['<div class="cookie notice">{}</div>', '<div class="cookie-banner consent"><p>{}</p></div>', '<div role="alert" class="notice">{}</div>', '<div class="popup newsletter modal"><p>{}</p></div>', '<div class="disclaimer notice"><p>{}</p></div>']
    form = ["<form><p>{}</p></form>", "<form><label>{}</label><input></form>", '<form class="search">{}<button></button></form>', "<form><button>{}</button></form>"]
    reply = ['<div class="comment"><p>{}</p></div>', '<section class="comments"><p>{}</p></section>', '<ol id="comments" class="commentlist"><li>{}</li></ol>', '<div class="reader comments discussion"><p>{}</p></div>']
    hold = [("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post entry">', "</div>"), ('<section class="article body">', "</section>"), ('<div class="story text">', "</div>"), ("<body>", "")]
    hold += [('<div class="{0}">', "</div>")] * 5 + [('<div id="{0}"><div class="{1}-{0}">', "</div></div>")] * 3 + [('<section class="{0}">', "</section>")] * 2  # names that tell nothing
    for _ in range(n):
        labels: list[bool] = []
        page = rng.choice(["<!DOCTYPE html>", ""]) + f'<html lang="{word()}"><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        for part, chance in ((lambda: noise(labels, head), 0.35), (lambda: noise(labels, notice), 0.25), (lambda: nav(labels), 0.8), (lambda: noise(labels, ad), 0.6), (lambda: noise(labels, form, 1, 4), 0.2), (lambda: noise(labels, side), 0.25)):
            if rng.random() < chance:
                page += part()
        if rng.random() < 0.97:
            opened, closed = rng.choice(hold)
            page += opened.format(word(), word())
            if rng.random() < 0.85:
                labels.append(True)
                page += f"<h1>{words(1, 12)}</h1>"
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 30])):
                page += rich(labels) if rng.random() < 0.2 else prose(labels)
                if rng.random() < 0.05:
                    page += noise(labels, ad)
                if rng.random() < 0.03:
                    page += noise(labels, form + notice, 1, 12)
            page += closed
        for part, chance in ((lambda: noise(labels, side), 0.3), (lambda: noise(labels, reply), 0.3), (lambda: noise(labels, reply), 0.2), (lambda: noise(labels, form, 1, 4), 0.15), (lambda: nav(labels), 0.3), (lambda: noise(labels, ad), 0.2), (lambda: noise(labels, notice), 0.1), (lambda: noise(labels, foot), 0.85)):
            if rng.random() < chance:
                page += part()
        yield page + rng.choice(["</body></html>", ""]), labels


def lessons(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of taught pages whose blocks are as many as their labels."""
    out = []
    for page, labels in teach(n, seed):
        found = blocks(page)
        if len(found) == len(labels) and found:
            out.append((vectors(found), np.array(labels, np.float32)))
    return out


def train(pages: int = 1200, epochs: int = 5, seed: int = 11) -> dict[str, np.ndarray]:
    """The labeller's weights."""
    model = Labeller()
    model.fit(lessons(pages, seed), epochs)
    return model.w


def label(model: Labeller, pages: list[list[Piece]]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length are stepped together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi - lo + 1) <= BATCH_BLOCKS:
            hi += 1
        part = order[lo:hi]
        x, mask = pad([vectors(pages[i]) for i in part])
        p = model.scores(x, mask)
        for j, i in enumerate(part):
            out[i] = p[: len(pages[i]), j] > 0.5
        lo = hi
    return out


def _extract(batches: Iterable[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    model = Labeller()
    model.w = weights.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            pages = [blocks(h.as_py() or "") for h in part.column(2)]
            texts = [" ".join(b.text for b, ok in zip(p, keep, strict=True) if ok) for p, keep in zip(pages, label(model, pages), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """For every page: page_id, url, text (the main text) and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or train())  # 60 kB, whatever the input
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda batches: _extract(batches, sent), "page_id long, url string, text string, n_chars long")
