"""Operator 5, HTML extraction: a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks (runs of text between block-level tags), each with its
tag path (names, and the words of classes, ids and roles) and its words. A bidirectional LSTM in
numpy reads hashed vectors of path and words for the whole sequence, so each block is judged in the
light of the whole page, and the blocks it labels as content are the text. It alone decides; no rule
is among its inputs or after it.

Nobody labels blocks by hand: the labels to learn from are weak ones. On a bounded sample of pages
that mark their article (``article``, ``main``), blocks inside it are content unless some element
of their path says otherwise (``weak_label``). Copies of these pages teach what the sample happens
not to have, each block keeping its label: furniture of many kinds set at random places, parts of
an article under names of their own, and pages whose elements are renamed to plain ones or lose
their marks, on which only words, shape and neighbours tell what a block is. Pages without an
article are read by what those taught.

Defined results: null or empty html, or a page without content, gives an empty text with 0
characters; repeated rows get equal answers; an empty table gives an empty result; other columns
are ignored. Malformed markup (unclosed or stray tags, unclosed comments) is read to its end; a head
without end tag ends at the first text or element that cannot stand in one. Pages of very many
blocks are projected ``LONG`` blocks at a time, and read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: The labeller is fitted on about SAMPLE pages of at most PAGE characters; buckets of path and words; width of a direction.
SAMPLE, PAGE, PATHS, WORDS, HIDDEN = 200, 1 << 17, 256, 48, 20
DIM, EPOCHS, RATE = PATHS + WORDS + 6, 18, 0.02
#: Blocks whose vectors are held together; outermost and innermost elements that a path names.
LONG, DEPTH = 4096, 32
#: Elements of running text, those without an end tag, those whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noframes svg select annotation annotation-xml".split())
#: What can stand in a head; anything else ends one that is still open.
HEAD = set("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: What marks page furniture to a weak label: an element, or a class, id or role made up of these
#: words and of words that say nothing.
FURNITURE = set("nav header footer aside form button fieldset dialog menu".split())
FURNITURE_WORDS = set("ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo recommended related replies search share sidebar social sponsor sponsored subscribe toolbar widget".split())
PLAIN_WORDS = set("area bar block bottom box container content group inner item items left link links list main outer page panel right section side site text top wrap wrapper".split())
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: White space of this contract, for collapsing.
_SPACES = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float
    #: Vectors of the elements between those that the path names, summed; None where it names all.
    middle: np.ndarray | None = None


def _element(name: str, attributes: str) -> str:
    marks = " ".join((b or c or d).lower() for _, b, c, d in _ATTRIBUTE.findall(attributes))
    return f"{name} {marks}".strip()


def blocks_of(page: str | None, reader: Reader | None = None) -> list[Block]:
    """The leaf blocks of a page, in order; head, scripts and the like have none.

    A path names ``DEPTH`` outermost and innermost elements; those between are summed up as they open and
    close, so that a deep page takes no more than its tags.
    """
    out: list[Block] = []
    stack: list[str] = []
    sums: list[np.ndarray] = []  # of the vectors of elements from the outermost on
    counts: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text and not counts["head"]:
            near = stack if len(stack) <= 2 * DEPTH else stack[:DEPTH] + stack[-DEPTH:]
            out.append(Block(tuple(e for e in near if e.split(" ", 1)[0] not in INLINE), text, min(1.0, linked / len(text)), middle()))
        parts.clear()
        linked = 0

    def middle() -> np.ndarray | None:
        nonlocal reader
        if len(stack) <= 2 * DEPTH:
            return None
        reader = reader or Reader()
        for e in stack[len(sums) : len(stack) - DEPTH]:
            own = np.zeros(PATHS, np.float32) if e.split(" ", 1)[0] in INLINE else reader.element(e, False)
            sums.append(sums[-1] + own if sums else own)
        return sums[len(stack) - DEPTH - 1] - sums[DEPTH - 1]

    def cut(i: int) -> None:
        counts.subtract(e.split(" ", 1)[0] for e in stack[i:])
        del stack[i:]
        del sums[i:]

    def end_head() -> None:
        if counts["head"]:
            cut(next(i for i, e in enumerate(stack) if e.split(" ", 1)[0] == "head"))

    page = page or ""
    at, raw_end = 0, None
    while at < len(page):
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if not text.isspace():
                end_head()
            parts.append(text)
            if counts["a"] > 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and name not in HEAD:
            end_head()
        if name not in INLINE:
            if name not in RAW:
                close_block()
        elif name in ("br", "img", "wbr"):
            parts.append(" " if name == "br" else "")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if counts[name] > 0 else ():
                if stack[i].split(" ", 1)[0] == name:
                    cut(i)
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                at = end.end() if end else len(page)
            parts.append(" ")
        elif name not in VOID:
            if name not in INLINE:  # an open paragraph ends where a block begins, and so does a list item at the next
                ends = {"p", name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p"}
                for i in range(len(stack) - 1, -1, -1) if any(counts[e] > 0 for e in ends) else ():
                    tag = stack[i].split(" ", 1)[0]
                    if tag in ends:
                        cut(i)
                        break
                    if tag not in INLINE:
                        break
            if not m[3].rstrip().endswith("/"):
                stack.append(_element(name, m[3]))
                counts[name] += 1
            if name == "xmp":  # its tags are text, up to its own end
                end = re.compile(r"</xmp\s*>", re.I).search(page, at)
                raw_end = end.start() if end else len(page)
                parts.append(html.escape(page[at:raw_end]))
                at = raw_end
    close_block()
    return out


def _words(marks: str) -> list[str]:
    return [w for w in re.split(r"[-_\s]+", marks) if w]


def is_furniture(element: str) -> bool:
    """Whether an element's tag, or one of its classes, ids and roles as a whole, names page furniture."""
    tag, _, marks = element.partition(" ")
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    each = [[w for w in _words(m) if not w.isdigit()] for m in marks.split()]
    return any(set(m) & FURNITURE_WORDS and set(m) <= FURNITURE_WORDS | PLAIN_WORDS for m in each)


def weak_label(path: tuple[str, ...]) -> bool:
    """Content or not by structure alone: inside an article, and in no furniture."""
    return any(e.partition(" ")[0] in ("article", "main") or "main" in e.split()[1:] for e in path) and not any(map(is_furniture, path))


def _hash(text: str, buckets: int) -> tuple[int, float]:
    h = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return h % buckets, 1.0 if h & 0x80000000 else -1.0


class Reader:
    """Vectors of blocks: hashed path and words, length, link share, place and ending; hashes are kept."""

    def __init__(self):
        self.elements: dict[str, np.ndarray] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def element(self, e: str, leaf: bool) -> np.ndarray:
        key = f"{e}>" if leaf else e
        if key not in self.elements:
            v = np.zeros(PATHS, np.float32)
            tag, _, marks = e.partition(" ")
            for token, weight in ((tag, 1), *([(f">{tag}", 1)] if leaf else ()), *((f".{w}", 2) for w in _words(marks))):
                j, sign = _hash(token, PATHS)
                v[j] += sign * weight
            self.elements[key] = v
        return self.elements[key]

    def __call__(self, blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
        """``blocks``: those from number ``first`` on of a page of ``total``."""
        x, last = np.zeros((len(blocks), DIM), np.float32), max(1, (total or len(blocks)) - 1)
        for i, b in enumerate(blocks):
            for n, e in enumerate(b.path):
                x[i, :PATHS] += self.element(e, n == len(b.path) - 1)
            if b.middle is not None:
                x[i, :PATHS] += b.middle
            words = b.text.split()
            for w, n in Counter(words).items():
                if w not in self.words:
                    self.words[w] = _hash(w.lower(), WORDS)
                j, sign = self.words[w]
                x[i, PATHS + j] += sign * n
            scale = np.abs(x[i, PATHS : PATHS + WORDS]).sum()
            x[i, PATHS : PATHS + WORDS] *= 1 / max(scale, 1.0)
            x[i, -6:] = (np.log1p(len(b.text)) / 4, b.linked, (first + i) / last, 1.0, b.text[-1] in ".!?…。", np.log1p(len(words)) / 4)
        for known in (self.elements, self.words):
            if len(known) > 100_000:
                known.clear()
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.15, (DIM, 4 * h)), f"h{d}": rng.normal(0, 0.15, (h, 4 * h)), f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
        self.w |= {"o": rng.normal(0, 0.15, 2 * h), "c": np.zeros(1)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the gates of both directions read of the blocks themselves."""
        return {d: x @ self.w[f"x{d}"] + self.w[f"b{d}"] for d in "fb"}

    def _run(self, pre: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, t, _ = pre.shape
        h = HIDDEN
        state, cell = np.zeros((n, h), pre.dtype), np.zeros((n, h), pre.dtype)
        out, tape = np.zeros((n, t, h), pre.dtype), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = pre[:, s] + state @ self.w[f"h{d}"]
            i, f, o, g = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            new = f * cell + i * g
            on = mask[:, s, None]
            if keep:
                tape.append((s, state, cell, i, f, o, g, new))
            cell = np.where(on, new, cell)
            state = np.where(on, o * np.tanh(new), state)
            out[:, s] = state
        return out, tape

    def forward(self, pre: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        f, tf = self._run(pre["f"], mask, "f", keep)
        b, tb = self._run(pre["b"], mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.w["o"] + self.w["c"], both, tf, tb

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        logit, both, tf, tb = self.forward(self.project(x), mask, True)
        e = (_sigmoid(logit) - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["c"] = np.einsum("nt,nth->h", e, both), np.array([e.sum()])
        up = e[:, :, None] * self.w["o"]
        for d, tape, part in (("f", tf, up[:, :, :h]), ("b", tb, up[:, :, h:])):
            dh, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
            for s, state, cell, i, f, o, c, new in reversed(tape):
                on = mask[:, s, None]
                dh_all = dh + part[:, s]
                dh_on = np.where(on, dh_all, 0)
                th = np.tanh(new)
                dnew = np.where(on, dc + dh_on * o * (1 - th * th), 0)
                da = np.concatenate([dnew * c * i * (1 - i), dnew * cell * f * (1 - f), dh_on * th * o * (1 - o), dnew * i * (1 - c * c)], axis=1)
                g[f"x{d}"] += x[:, s].T @ da
                g[f"h{d}"] += state.T @ da
                g[f"b{d}"] += da.sum(axis=0)
                dh = np.where(on, da @ self.w[f"h{d}"].T, dh_all)
                dc = np.where(on, dnew * f, dc)
        return g

    def label(self, pages: list[list[Block]], reader: Reader) -> list[np.ndarray]:
        """Whether each block of each page is content; pages of similar length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            n = max(1, min(256, 4 * LONG // len(pages[order[min(at + 255, len(order) - 1)]])))
            these = order[at : at + n]
            if n == 1:
                page = pages[these[0]]
                parts = [self.project(reader(page[k : k + LONG], k, len(page))) for k in range(0, len(page), LONG)]
                pre, mask = {d: np.concatenate([p[d] for p in parts])[None] for d in "fb"}, np.ones((1, len(page)), bool)
            else:
                x, mask = padded([reader(pages[i]) for i in these])
                pre = self.project(x)
            logit = self.forward(pre, mask)[0]
            for r, i in enumerate(these):
                out[i] = logit[r, : len(pages[i])] > 0
            at += n
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, DIM), np.float32), np.zeros((len(pages), t), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


_TAGS = ("div", "section", "span", "ul", "td")
_ARTICLES = ("", "content", "post", "entry", "story", "body-text", "page-content", "main-column")
_PARTS = (("section", "related-work"), ("div", "figure"), ("section", "methods"), ("blockquote", ""), ("ul", ""), ("div", "summary"), ("table", "data"), ("div", "note-on-method"), ("div", "lead"), ("pre", ""))


def _furniture_element(rng: np.random.Generator) -> str:
    if rng.random() < 0.4:
        return str(rng.choice(sorted(FURNITURE)))
    word, plain = str(rng.choice(sorted(FURNITURE_WORDS))), str(rng.choice(sorted(PLAIN_WORDS)))
    return f"{rng.choice(_TAGS)} {rng.choice((word, f'{word}-{plain}', f'{plain}-{word}', f'{word} {plain}'))}"


def furnished(blocks: list[Block], labels: list[bool], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A copy of a page with page furniture, and parts of its article under other names, at random places."""
    out, on = list(blocks), list(labels)
    words = [w for b in blocks for w in b.text.split()[:20]] or ["x"]
    inside = [b.path[: next(i for i, e in enumerate(b.path) if weak_label(b.path[: i + 1])) + 1] for b, y in zip(blocks, labels, strict=True) if y]
    for i, (b, y) in enumerate(zip(out, on, strict=True)):
        if y and rng.random() < 0.15:
            tag, mark = _PARTS[int(rng.integers(len(_PARTS)))]
            inner = ("li",) if tag == "ul" else ("tr", "td") if tag == "table" else b.path[-1:] if tag != "pre" else ()
            out[i] = Block((*b.path[:-1], f"{tag} {mark}".strip(), *inner), b.text, b.linked)
    for at in sorted(rng.integers(0, len(out), 4).tolist(), reverse=True):
        if on[at] and rng.random() < 0.7:
            kind, few = (("h2",), ("h3",), ("ul", "li"), ("ol", "li"))[int(rng.integers(4))], out[at].text.split()
            for k in range(int(rng.integers(1, 6)) if kind[-1] == "li" else 1):
                text = " ".join(few[(3 * k) % len(few) :][: int(rng.integers(1, 12))])
                out.insert(at, Block((*out[at].path[:-1], *kind), text, 0.0))
                on.insert(at, True)
    for _ in range(int(rng.integers(2, 8))):
        at = int(rng.integers(0, len(out) + 1))
        base = inside[int(rng.integers(len(inside)))] if inside and rng.random() < 0.5 else ("html", "body")
        element = _furniture_element(rng)
        inner = (("p",), ("ul", "li"), (), ("div",), ("p",), ("h1",), ("h3",))[int(rng.integers(7))]
        for _ in range(int(rng.integers(1, 5))):
            size = int(rng.integers(1, 10)) if rng.random() < 0.6 else int(rng.integers(10, 60))
            text = " ".join(str(words[int(rng.integers(len(words)))]) for _ in range(size))
            out.insert(at, Block((*base, element, *inner), text, float(rng.random() < 0.4)))
            on.insert(at, False)
    return out, on


def renamed(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """A copy whose articles, and often whose furniture, are plain elements: what is left are words, shape and neighbours."""
    article, names = f"{'main' if rng.random() < 0.2 else 'div'} {rng.choice(_ARTICLES)}".strip(), {}

    def other(e: str) -> str:
        if e.partition(" ")[0] in ("article", "main"):
            return article
        if is_furniture(e) and e not in names:
            names[e] = "div" if rng.random() < 0.5 else e
        return names.get(e, e)

    return [Block(tuple(map(other, b.path)), b.text, b.linked) for b in blocks]


def shortened(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """A copy in which some blocks have only a word or a few left: length alone says little."""
    return [Block(b.path, " ".join(b.text.split()[: int(rng.integers(1, 5))]), b.linked) if rng.random() < 0.25 else b for b in blocks]


def train(pages: list[str], seed: int = 3) -> Labeller:
    """Fit on pages that mark their article (all of them, if none does) and on copies of these."""
    rng = np.random.default_rng(seed)
    model, reader = Labeller(), Reader()
    read = [b for p in pages if (b := blocks_of(p))]
    marked = [b for b in read if any(weak_label(x.path) for x in b)]
    data = []
    for b in marked or read:
        y = [weak_label(x.path) if marked else len(x.text) > 80 and x.linked < 0.3 and not any(map(is_furniture, x.path)) for x in b]
        for copy, labels in ((b, y), (shortened(b, rng), y), (renamed(b, rng), y), f := furnished(b, y, rng) if marked else (b, y), (renamed(f[0], rng), f[1]), furnished(b, y, rng) if marked else (b, y)):
            data.append((reader(copy), np.array(labels, float)))
    data.sort(key=lambda d: len(d[0]))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    groups = [data[i : i + 16] for i in range(0, len(data), 16)]
    step, steps = 0, EPOCHS * len(groups)
    for _ in range(EPOCHS):
        for j in rng.permutation(len(groups)):
            x, mask = padded([d[0] for d in groups[j]])
            y = np.zeros(mask.shape)
            for i, d in enumerate(groups[j]):
                y[i, : len(d[1])] = d[1]
            step += 1
            rate = RATE * (1 - 0.95 * step / steps)
            for k, g in model.gradient(x, mask, y).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.w[k] = model.w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """Train on at most about ``sample`` pages of up to ``PAGE`` characters, chosen by a hash of their id."""
    rows = pages.where(F.length(html_col).between(1, PAGE))
    share = min(1.0, sample / max(rows.count(), 1))
    few = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    picked = few.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).limit(2 * sample).collect()
    return train([r["h"] for r in sorted(picked, key=lambda r: (r["i"], r["h"]))])


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    weights = pages.sparkSession.sparkContext.broadcast((model or fit(pages, id_col=id_col, html_col=html_col)).w)

    def read(batches):
        labeller, reader = Labeller(), Reader()
        labeller.w = {k: v.astype(np.float32) for k, v in weights.value.items()}
        for batch in batches:
            pages = [blocks_of(p, reader) for p in batch.column(2).to_pylist()]
            on = labeller.label(pages, reader)
            texts = ["\n".join(b.text for b, k in zip(p, keep, strict=True) if k) if p else "" for p, keep in zip(pages, on, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
