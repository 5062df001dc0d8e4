"""Main text of web pages by a recurrent block labeller (operator 9).

A page is cut into its leaf blocks: runs of text between block-level tags, with the path of open tags (names, classes, ids,
roles).  A numpy bidirectional LSTM reads, for the whole sequence of a page, hashed vectors of all open tags and of all
words of a block, and a few numbers, and labels every block as main text or not.

Pages carry no labels, so the labeller learns from pages whose structure names its parts: a sample of at most ``SAMPLE``
pages with an ``article`` or ``main`` element, each of at most ``LONGEST`` characters, teaches which blocks are the article: those of
an ``article`` inside ``main``, else of ``main``, else of an ``article``, and in all cases outside of elements that tag, class, id or role
name as another part (``OTHER``, ``OTHER_WORDS``).  In a table without such pages, a sample of all pages teaches by ``shaped``.  Each sampled page is also learned in
variants that rename its parts the ways that pages name them (``MAIN_NAMES``, ``OTHER_NAMES``) and insert further menus,
notices, adverts, forms and reader comments made of the sample's own blocks; so the labeller does not rest on one template.
A page of more than ``PADDED`` blocks is read in windows of that many, whose states are carried over in both directions.

Edge cases: null and empty html give an empty text; text, a body tag or any tag that has no place in a head ends an open head; tags that are never closed, and stray end tags, are taken as browsers do
in the plain cases (a new block ends an open paragraph); a declaration of no known kind is a comment; a tag that the page
breaks off in is text; repeated rows give one row each; pages without such elements are labelled by the same network; without a labeller (a sample without any prose) every block outside scripts and styles counts as main text;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortweave.llm.common import steps

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head noscript script style svg template textarea title iframe object".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Names that pages give to their main part, and to the others.
MAIN_NAMES = ("article", "main", "div.content", "div.article-body", "div.post-content", "div.entry-content", "section.story", "div#main-content", "div.text")
OTHER_NAMES = ("nav", "header", "footer", "aside", "form", "div.menu", "div.navbar", "div.sidebar", "div.ad", "div.advert", "div.banner", "div.promo",
               "div.cookie-notice", "div.notice", "div.consent", "div.newsletter", "div.related", "div.share", "div.breadcrumb", "div.comments",
               "section.comments", "div.comment", "ol.comment-list", "div#disqus_thread", "div.footer", "div.header", "div.widget", "div.popup", "ul.links")
# Further words of roles that are not main text.
OTHER_ROLES = ("navigation", "contentinfo", "complementary", "dialog", "alertdialog")
SAMPLE = 240
#: Characters of the longest page that teaches.
LONGEST = 60_000
VARIANTS = 3
#: Blocks, padding included, that one step of the network reads; a longer page is read in windows of so many.
PADDED = 8000
#: Characters from which a block of few links is prose for ``shaped``.
PROSE = 60
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN_SIZE = 64, 64, 6, 24
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
# Open elements that a path names: the outermost and the innermost ones of a deeper nest.  ``Block.sums`` holds all of them.
OUTER, INNER = 48, 16
MAIN = frozenset(("article", "main"))
OTHER = frozenset("nav header footer aside form button".split())
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z0-9]+")


def _renamed(name: str) -> tuple[str, ...]:
    """The path of an element written as in ``MAIN_NAMES``."""
    tag, names = re.match(r"(\w+)(.*)", name).groups()
    return (tag, *("." + w for w in _WORDS.findall(names.lower())))


#: First words of the names of parts that are not main text.
OTHER_WORDS = frozenset(_renamed(n)[1][1:] for n in OTHER_NAMES if len(_renamed(n)) > 1) | frozenset(OTHER_ROLES)
_OTHER_TOKENS = OTHER | {"." + w for w in OTHER_WORDS}
_MAIN_PATHS = tuple(map(_renamed, MAIN_NAMES))
_slots: dict[str, tuple[int, int]] = {}


def _crc(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _apart(tag: str, names: list[str]) -> bool:
    """Whether a class, id or role says that an element is another part: by its first word or, but for a main element, its last."""
    words = [w for v in names for n in v.lower().split() if (w := _WORDS.findall(n))]
    return any(w[0] in OTHER_WORDS or tag not in MAIN and w[-1] in OTHER_WORDS for w in words)


def _slot(token: str) -> tuple[int, int]:
    """Place and sign of a token in the vector of a path."""
    found = _slots.get(token)
    if found is None:
        if len(_slots) > 20_000:
            _slots.clear()
        h = _crc(token)
        found = _slots[token] = (h % PATH_SIZE, 0 if token in ("html", "body") else 1 if h & (1 << 20) else -1)
    return found


def _sums(tokens: tuple[str, ...] | list[str]) -> np.ndarray:
    out = np.zeros(PATH_SIZE, dtype=np.int32)
    for k, sign in map(_slot, tokens):
        out[k] += sign
    return out


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0
    #: int32 sums of the hashed tokens of all open elements, and, inside an article, of the tags after the innermost one.
    sums: bytes | None = None
    tail: bytes | None = None
    #: The innermost article: 1 an article, 2 main, 3 an article in main.
    rank: int = 1

    def __post_init__(self) -> None:
        if self.sums is None:
            self.sums = _sums(self.path).tobytes()
            at = max((i for i, t in enumerate(self.path) if t in MAIN), default=None)
            if at is not None and not _OTHER_TOKENS & set(self.path[at:]):
                self.rank = 2 if self.path[at] == "main" else 3 if "main" in self.path[:at] else 1
                self.tail = _sums([t for t in self.path[at + 1:] if t[0] != "."]).tobytes()


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())
    #: In an article: the sums of the tags up to the innermost one.
    before: np.ndarray | None = None
    rank: int = 0
    #: Below an element that its names set apart.
    apart: bool = False


class Blocks(HTMLParser):
    """Leaf blocks of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0
        self.found: list[Block] = []
        self.path: tuple[str, ...] = ()
        self.sums, self.tags = array("i", bytes(4 * PATH_SIZE)), array("i", bytes(4 * PATH_SIZE))
        self.unended = False
        self.seen: dict[bytes, bytes] = {}

    def _once(self, value: bytes) -> bytes:
        """The same object for equal values, which the blocks of a long page share."""
        if len(self.seen) > 20_000:
            self.seen.clear()
        return self.seen.setdefault(value, value)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            before = self.open[-1].before if self.open else None
            tail = None if before is None else self._once((np.frombuffer(self.tags.tobytes(), dtype=np.int32) - before).tobytes())
            self.found.append(Block(self.path, text, self.linked, self._once(self.sums.tobytes()), tail, self.open[-1].rank if self.open else 0))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self._close("head", HIDDEN - {"head", "noscript"})
        elif tag not in IN_HEAD:
            self._end_head()
        if tag in INLINE:
            self.in_link += tag == "a"
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        if tag in ENDS_PARAGRAPH:
            self._close("p", ENDS_PARAGRAPH - {"p"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, {"ul", "ol", "dl", "table", "tr", "select"} - {tag})
        if tag in VOID:
            return
        names = [v for k, v in attrs if k in ("class", "id", "role") and v]
        opened = _Open(tag, tuple("." + w for v in names for w in re.findall(r"[a-z0-9]+", v.lower())))
        self._count(opened, 1)
        outer = self.open[-1] if self.open else _Open("")
        opened.apart = (outer.apart and tag != "main") or _apart(tag, names)
        opened.rank = outer.rank if tag not in MAIN else 2 if tag == "main" else 3 if outer.rank > 1 else 1
        if tag in MAIN and not opened.apart:
            opened.before = np.frombuffer(self.tags.tobytes(), dtype=np.int32)
        elif tag not in OTHER and not opened.apart:
            opened.before = outer.before
        self.open.append(opened)
        self.hidden += tag in HIDDEN
        self._set_path()

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.in_link -= tag == "a" and self.in_link > 0
            return
        self.flush()
        if tag not in VOID:
            self._close(tag, frozenset())

    def _end_head(self) -> None:
        if self.open and self.open[-1].tag == "head":
            self._close("head", frozenset())

    def _close(self, tag: str, walls: frozenset[str] | set[str]) -> None:
        """Close the innermost open ``tag`` and what stands in it, unless a wall stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.hidden -= sum(o.tag in HIDDEN for o in self.open[k:])
                for o in self.open[k:]:
                    self._count(o, -1)
                del self.open[k:]
                self.in_link = 0
                self._set_path()
                return
            if self.open[k].tag in walls:
                return

    def _count(self, o: _Open, times: int) -> None:
        k, sign = _slot(o.tag)
        self.tags[k] += times * sign
        self.sums[k] += times * sign
        for k, sign in map(_slot, o.names):
            self.sums[k] += times * sign

    def _set_path(self) -> None:
        named = self.open if len(self.open) <= OUTER + INNER else self.open[:OUTER] + self.open[-INNER:]
        self.path = tuple(t for o in named for t in (o.tag, *o.names))

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The place after a comment; the end that one comment lacks is not searched again for those after it."""
        if self.unended:
            return -1
        end = super().parse_comment(i, report)
        self.unended = end < 0
        return end

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # the parser knows few marked sections; browsers take the others as comments
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if self.hidden and data.strip(" \t\n\f\r"):
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def page_blocks(html: str | None) -> list[Block]:
    parser, html = Blocks(), html or ""
    # No tag or comment ends in the tail, and a search for its end from every "<" would take quadratic time.
    end = html.rfind(">") + 1
    parser.feed(html[:end] + html[end:].replace("<", "&lt;"))
    parser.close()
    parser.flush()
    return parser.found


_inner_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _inner_vector(path: tuple[str, ...]) -> np.ndarray:
    """The three innermost tokens of a path once more, apart from the others."""
    inner = path[-3:]
    found = _inner_vectors.get(inner)
    if found is None:
        if len(_inner_vectors) > 20_000:
            _inner_vectors.clear()
        found = _inner_vectors[inner] = _sums([f"<{t}" for t in inner])
    return found


def encode(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, INPUT): every open element, every word; of the blocks from ``first`` of a page of ``total``."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), INPUT), dtype=np.float32)
    if not blocks:
        return out
    paths = np.frombuffer(b"".join(b.sums for b in blocks), dtype=np.int32).reshape(-1, PATH_SIZE) + [_inner_vector(b.path) for b in blocks]
    out[:, :PATH_SIZE] = np.clip(paths, -2, 2)
    for k, b in enumerate(blocks):
        words = b.text.lower().split(" ")
        h = np.fromiter(map(_crc, words), dtype=np.int64, count=len(words))
        out[k, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.bincount(h % WORD_SIZE, np.where(h & (1 << 20), 1.0, -1.0), WORD_SIZE) / len(words) ** 0.5
        n = len(b.text)
        out[k, -NUMBERS:] = (np.log1p(n) / 8, b.linked / n, b.text[-1] in ".!?…", (first + k) / total, b.text.count(",") / (1 + n / 50), 1)
    return out


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 9):
        rng, h = np.random.default_rng(seed), HIDDEN_SIZE
        self.w = [rng.normal(0, (INPUT + h) ** -0.5, (INPUT + h, 4 * h)) for _ in range(2)]
        self.b = [np.concatenate([np.ones(h), np.zeros(3 * h)]) for _ in range(2)]
        self.out, self.bias = rng.normal(0, (2 * h) ** -0.5, 2 * h), np.zeros(1)

    def _direction(self, k: int, x: np.ndarray, mask: np.ndarray, keep: bool, start: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """Hidden states (time, pages, hidden) of one reading direction from ``start`` on, and the last state; states of ended pages stay."""
        h = HIDDEN_SIZE
        state, cell = start or (np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h)))
        outs, tape = np.zeros((*x.shape[:2], h)), []
        drive = x @ self.w[k][:INPUT] + self.b[k]
        inner = self.w[k][INPUT:]
        for t in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
            z = drive[t] + state @ inner
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * h], -30, 30)))
            f, i, o, g = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(z[:, 3 * h:])
            new = f * cell + i * g
            squashed = np.tanh(new)
            on = mask[t][:, None]
            if keep:
                tape.append((t, state, cell, f, i, o, g, squashed, on))
            cell = np.where(on, new, cell)
            state = np.where(on, o * squashed, state)
            outs[t] = state
        return outs, tape, (state, cell)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Probabilities (time, pages) of main text."""
        (a, ta, _), (b, tb, _) = (self._direction(k, x, mask, keep) for k in (0, 1))
        both = np.concatenate([a, b], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.out + self.bias, -30, 30))), [both, ta, tb]

    def long_page(self, blocks: list[Block], window: int = PADDED) -> np.ndarray:
        """Probabilities of one page, read in windows from either end; equal to those of the page in one piece."""
        h, found = HIDDEN_SIZE, np.full(len(blocks), self.bias[0])
        for k in (0, 1):
            state, begins = None, range(0, len(blocks), window)
            for a in begins if k == 0 else reversed(begins):
                x = encode(blocks[a:a + window], a, len(blocks))[:, None]
                outs, _, state = self._direction(k, x, np.ones(x.shape[:2], dtype=bool), False, state)
                found[a:a + window] += outs[:, 0] @ self.out[k * h:(k + 1) * h]
        return 1 / (1 + np.exp(-np.clip(found, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = HIDDEN_SIZE
        p, (both, *tapes) = self.forward(x, mask, keep=True)
        d = (p - y) * mask / mask.sum()
        grads = [np.einsum("tn,tnh->h", d, both), np.array([d.sum()])]
        for k, tape in enumerate(tapes):
            dw, db = np.zeros_like(self.w[k]), np.zeros_like(self.b[k])
            d_state, d_cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for t, state, cell, f, i, o, g, squashed, on in reversed(tape):
                d_state = d_state + d[t][:, None] * self.out[k * h:(k + 1) * h]
                ds, dc = np.where(on, d_state, 0), np.where(on, d_cell, 0)
                dc = dc + ds * o * (1 - squashed ** 2)
                dz = np.concatenate([dc * cell * f * (1 - f), dc * g * i * (1 - i), ds * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
                dw[:INPUT] += x[t].T @ dz
                dw[INPUT:] += state.T @ dz
                db += dz.sum(axis=0)
                d_state = np.where(on, dz @ self.w[k][INPUT:].T, d_state)
                d_cell = np.where(on, dc * f, d_cell)
            grads += [dw, db]
        return grads

    def params(self) -> list[np.ndarray]:
        return [self.out, self.bias, self.w[0], self.b[0], self.w[1], self.b[1]]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUT), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def taught(blocks: list[Block]) -> np.ndarray:
    """Which blocks the page's own elements name as the article: those of the strongest rank that the page has."""
    ranks = np.array([0 if b.tail is None else b.rank for b in blocks], dtype=int)
    return (ranks > 0) & (ranks == ranks.max(initial=0))


def shaped(blocks: list[Block]) -> np.ndarray:
    """Which blocks look like the article of a page whose tags do not name it.

    Outside of elements named as other parts: the blocks below an element of a main name, if there are any; else prose (``PROSE``
    characters and more, at most a quarter of them linked), and the headings right before it.
    """
    free = np.array([not _OTHER_TOKENS & set(b.path) for b in blocks], dtype=bool)
    named = np.array([any(b.path[i:i + len(m)] == m for m in _MAIN_PATHS for i in range(len(b.path))) for b in blocks], dtype=bool) & free
    if named.any():
        return named
    prose = np.array([len(b.text) >= PROSE and 4 * b.linked <= len(b.text) for b in blocks], dtype=bool) & free
    heading = np.array([re.fullmatch("h[1-6]", b.path[-1] if b.path else "") is not None for b in blocks], dtype=bool) & free
    return prose | (heading & np.append(prose[1:], False))


def variant(blocks: list[Block], main: np.ndarray, pool: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with its parts named anew and with further parts that are not main text."""
    own, parts, out, labels = _renamed(MAIN_NAMES[rng.integers(len(MAIN_NAMES))]), {}, [], []

    def other() -> tuple[str, ...]:
        return _renamed(OTHER_NAMES[rng.integers(len(OTHER_NAMES))])

    def insert() -> None:
        inside = own if rng.random() < 0.25 else ()
        path = ("html", "body", *inside, *other())
        leaf = ("p", "li", "div", "span")[rng.integers(4)]
        for _ in range(int(rng.integers(1, 6))):
            b = pool[rng.integers(len(pool))]
            out.append(Block((*path, leaf) if leaf != "span" else path, b.text, b.linked if rng.random() < 0.5 else len(b.text)))
            labels.append(False)

    cuts = set(rng.integers(0, len(blocks) + 1, int(rng.integers(1, 4))).tolist())
    for k, (b, is_main) in enumerate(zip(blocks, main, strict=True)):
        if k in cuts:
            insert()
        if is_main and b.tail is None:
            out.append(Block(("html", "body", *own, *(t for t in b.path[-1:] if not t.startswith("."))), b.text, b.linked))
        elif is_main:
            at = max((i for i, t in enumerate(b.path) if t in MAIN), default=-1)  # a deep nest may not name it
            tail = tuple(t for t in b.path[at + 1:] if not t.startswith("."))
            sums = _sums(own) + np.frombuffer(b.tail, dtype=np.int32)
            out.append(Block(("html", "body", *own, *tail), b.text, b.linked, sums.tobytes()))
        else:
            part = parts.setdefault(b.path[:3], other())
            sums = np.frombuffer(b.sums, dtype=np.int32) - _sums(b.path[:3]) + _sums(part)
            out.append(Block(("html", "body", *part, *b.path[3:]), b.text, b.linked, sums.tobytes()))
        labels.append(bool(is_main))
    if len(blocks) in cuts:
        insert()
    return out, np.array(labels)


def train(pages: list[list[Block]], *, rounds: int = 260, size: int = 24, seed: int = 9) -> Labeller | None:
    """Adam on the log loss of all blocks of ``size`` pages a round; long pages are learned in windows of 80 blocks."""
    pages = [(b, m) for b in pages if (m := taught(b)).any()] or [(b, m) for b in pages if (m := shaped(b)).any()]
    if not pages:
        return None
    rng, net = np.random.default_rng(seed), Labeller(seed)
    pool = [b for blocks, _ in pages for b in blocks]
    data = [(encode(b), m) for b, m in pages]
    data += [(encode(v), m) for b, main in pages for _ in range(VARIANTS) for v, m in [variant(b, main, pool, rng)]]
    moment, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for t in range(1, rounds + 1):
        chosen = [data[k] for k in rng.integers(0, len(data), size)]
        chosen = [(x[s:s + 80], y[s:s + 80]) for x, y in chosen for s in [int(rng.integers(0, max(1, len(x) - 79)))]]
        x, mask = _padded([a for a, _ in chosen])
        y = np.zeros(mask.shape)
        for k, (_, labels) in enumerate(chosen):
            y[: len(labels), k] = labels
        rate = 0.01 * min(1.0, 2 * (1 - t / (rounds + 1)))
        for k, (p, g) in enumerate(zip(net.params(), net.gradients(x, mask, y), strict=True)):
            g = g * min(1.0, 5 / (np.linalg.norm(g) + 1e-12))
            moment[k] = 0.9 * moment[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p -= rate * (moment[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    return net


def fit(pages: DataFrame, *, sample: int = SAMPLE, longest: int = LONGEST) -> Labeller | None:
    """Learn from the ``sample`` pages first by a hash of the url, among those of at most ``longest`` characters that name their article, or of all such pages if none does."""
    short = pages.where(F.length("html").between(1, longest)).select("html", F.xxhash64("url", "html").alias("h"))
    for able in (short.where(F.lower("html").rlike("<(article|main)[ >]")), short):
        least = [r["h"] for r in able.select("h").orderBy("h").limit(sample).collect()]  # hashes first: no html but the sample's is sent
        if least:
            rows = able.where(F.col("h") <= F.lit(least[-1])).orderBy("h", "html").limit(sample).select("html").collect()
            return train([page_blocks(r["html"]) for r in rows])
    return None


def label(net: Labeller | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Main or not, for all blocks of each page."""
    out = [np.ones(len(b), dtype=bool) for b in pages]
    if net is None:
        return out
    for k, blocks in enumerate(pages):
        if len(blocks) > PADDED:
            out[k] = net.long_page(blocks) > 0.5
    order, a = sorted((k for k, b in enumerate(pages) if 0 < len(b) <= PADDED), key=lambda k: len(pages[k])), 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(pages[order[b]]) <= PADDED:
            b += 1
        x, mask = _padded([encode(pages[k]) for k in order[a:b]])
        p, _ = net.forward(x, mask)
        for i, k in enumerate(order[a:b]):
            out[k] = p[: len(pages[k]), i] > 0.5
        a = b
    return out


def extract(pages: DataFrame, net: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            htmls = batch["html"].tolist()
            for a, b in steps((len(h or "") for h in htmls), 1 << 20):
                found = [page_blocks(h) for h in htmls[a:b]]
                texts = ["\n".join(x.text for x, on in zip(blocks, main, strict=True) if on) for blocks, main in zip(found, label(held.value, found), strict=True)]
                yield pd.DataFrame({"page_id": batch["page_id"].iloc[a:b].array, "url": batch["url"].iloc[a:b].array, "text": texts,
                                    "n_chars": [len(t) for t in texts]})

    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
