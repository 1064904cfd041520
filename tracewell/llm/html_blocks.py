"""Main text of web pages: a bidirectional LSTM labels every block of a page with the whole page in view.

A page becomes a sequence of blocks, the texts between block-level tags. A block is a vector of its hashed tag path
(tags, classes and ids of all elements around it), its hashed words and a few shares. The network reads the
sequence both ways and gives each block a probability of being main text. It is trained here, on blocks of a bounded
sample of pages that their own markup labels, and on variants of them: other containers, and inserted menus, notices,
forms, adverts and comments. Then every block of every page is labelled; nothing is cut or dropped by length.

Defined cases: null, empty and text-free pages give an empty text; unclosed and stray tags are tolerated; a page cut
inside a tag ends there; repeated rows are extracted one by one; without any labelled block the markup alone decides. Pages
of any length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import prepared, read

# The bound of the training sample: pages, and blocks of one training sequence (training alone).
SAMPLE_PAGES, TRAIN_BLOCKS, VARIANTS = 240, 60, 3
PATH_DIMS, WORD_DIMS, SHARES = 192, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + SHARES
HIDDEN, EPOCHS, BATCH, RATE = 16, 8, 24, 0.02
PAGES_AT_ONCE = 64

# Fixed values of the markup language: elements without content, with raw content, and those inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "template", "noscript", "textarea", "svg", "iframe", "object")
UNCLOSED = frozenset(("svg", "object"))  # without an end tag these hide nothing; the others hide the rest of the page
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
# An element that starts here ends these, if they are open.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main menu nav ol p pre section table ul".split())

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<held>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z0-9]+")

# What the sample's own markup says: containers of main text, and of everything else.
MAIN = frozenset("article main content post entry story body-text articlebody".split())
OTHER = frozenset("nav aside footer header form head menu sidebar ad ads advert advertisement sponsored cookie consent notice "
                  "banner comment comments reply share social related recommended newsletter popup modal breadcrumb "
                  "breadcrumbs pagination promo widget login search".split())

Block = tuple[tuple[str, ...], str, float]  # path, text, share of characters inside links


def _names(tag: str, rest: str) -> str:
    """An element in a path: its tag, and the parts of its class, id and role."""
    found = [part for values in NAMED.findall(rest) for value in values for part in PARTS.findall(value.lower())]
    return ".".join([tag, *found])


def page_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order."""
    blocks: list[Block] = []
    path: list[tuple[str, str]] = []
    pieces: list[str] = []
    links, linked, plain = 0, 0, 0

    def flush() -> None:
        nonlocal linked, plain
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append((tuple(name for _, name in path), text, linked / max(1, linked + plain)))
            pieces.clear()
            linked = plain = 0

    def close(names: tuple[str, ...], stop: tuple[str, ...] = ("table", "ul", "ol", "dl", "select")) -> None:
        for at in range(len(path) - 1, -1, -1):
            if path[at][0] in names:
                del path[at:]
                return
            if path[at][0] in stop:
                return

    page, at = page or "", 0
    endless: set[str] = set()
    while at < len(page):
        piece = PIECES.match(page, at)
        at = piece.end()
        text, tag, rest = piece["text"], piece["tag"], piece["rest"]
        if piece["raw"] is not None:
            name = piece["raw"].lower()
            if name == "svg" and piece["held"].endswith("/"):
                continue
            end = None if name in endless else RAW_ENDS[name].search(page, at)
            if end:
                at = end.end()
                continue
            if name not in UNCLOSED:
                break
            endless.add(name)
            tag, rest = name, piece["held"]
        if text is not None:
            pieces.append(text)
            if links:
                linked += len(text)
            else:
                plain += len(text)
        elif tag is not None:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "a":
                    links = max(0, links + (-1 if piece["close"] else 1))
                continue
            flush()
            links = 0
            if piece["close"]:
                close((tag,), ())
            elif tag not in VOID:
                if tag in ENDS_P:
                    close(("p",))
                if tag in CLOSES:
                    close(CLOSES[tag])
                if not rest.endswith("/"):
                    path.append((tag, _names(tag, rest)))
    flush()
    return blocks


def markup_label(path: tuple[str, ...]) -> bool:
    """Whether the innermost telling element around a block holds main text."""
    for element in reversed(path):
        parts = element.split(".")
        if parts[0] == "header" and any(p.split(".")[0] == "article" for p in path):
            continue  # an article's own heading
        if OTHER & set(parts):
            return False
        if MAIN & set(parts):
            return True
    return False


def _bucket(name: str, dims: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % dims


class WordBuckets(dict):
    """Bucket of a word's hash, made once per word while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORD_DIMS
        return value


class Vectors:
    """Blocks as rows of numbers; the rows of paths and the hashes of words are kept while they are few."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words = WordBuckets()

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            names = {part for element in path for part in element.split(".")}
            names |= {f"in {element}" for element in path[-2:]}
            found = self.paths[path] = np.zeros(PATH_DIMS, np.float32)
            found[[_bucket(name, PATH_DIMS) for name in names]] = 1.0
        return found

    def rows(self, blocks: list[Block]) -> np.ndarray:
        if not blocks:
            return np.zeros((0, DIMS), np.float32)
        split = [text.split(" ") for _, text, _ in blocks]
        counts = np.array([len(words) for words in split])
        buckets = np.array([bucket for words in split for bucket in map(self.words.__getitem__, words)])
        place = np.repeat(np.arange(len(blocks)) * WORD_DIMS, counts) + buckets
        words = np.bincount(place, minlength=len(blocks) * WORD_DIMS).reshape(-1, WORD_DIMS) / counts[:, None]
        shares = np.array([(share, text.count(".") + text.count(","), text[-1] in ".!?") for _, text, share in blocks], float)
        more = [np.log1p(counts) / 5, shares[:, 0], np.minimum(1.0, shares[:, 1] / counts),
                np.arange(len(blocks)) / len(blocks), counts < 4, shares[:, 2]]
        paths = np.stack([self._path(path) for path, _, _ in blocks])
        return np.concatenate([paths, words, np.stack(more, axis=1)], axis=1, dtype=np.float32)


class Network:
    """Bidirectional LSTM with one output per step."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.p = {"wo": draw.normal(0, 0.3, (2 * HIDDEN,)), "bo": np.zeros(1)}
        for side in "fb":
            self.p["wx" + side] = draw.normal(0, 0.15, (DIMS, 4 * HIDDEN))
            self.p["wh" + side] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN:2 * HIDDEN] = 1.0  # remember at first
            self.p["b" + side] = bias
        self.p = {name: value.astype(np.float32) for name, value in self.p.items()}

    @staticmethod
    def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence reversed within its own length."""
        at = np.arange(x.shape[1])
        index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
        return np.take_along_axis(x, index[:, :, None], axis=1)

    def _run(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        rows, steps, _ = x.shape
        gates_x = x.reshape(rows * steps, -1) @ self.p["wx" + side] + self.p["b" + side]
        gates_x = gates_x.reshape(rows, steps, -1)
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out = np.empty((rows, steps, HIDDEN), np.float32)
        for t in range(steps):
            g = gates_x[:, t] + h @ self.p["wh" + side]
            ifo = 1 / (1 + np.exp(-np.clip(g[:, :3 * HIDDEN], -15, 15)))
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
            u = np.tanh(g[:, 3 * HIDDEN:])
            before, c = c, f * c + i * u
            last, h = h, o * np.tanh(c)
            out[:, t] = h
            if keep is not None:
                keep.append((i, f, o, u, before, c, last))
        return out

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (rows x steps)."""
        hidden = []
        for side in "fb":
            seen = x if side == "f" else self._flip(x, lengths)
            steps: list | None = [] if keep is not None else None
            out = self._run(seen, side, steps)
            hidden.append(out if side == "f" else self._flip(out, lengths))
            if keep is not None:
                keep[side] = (seen, steps)
        both = np.concatenate(hidden, axis=2)
        if keep is not None:
            keep["both"] = both
        return 1 / (1 + np.exp(-np.clip(both @ self.p["wo"] + self.p["bo"], -15, 15)))

    def gradients(self, x: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all real steps, by back-propagation through time."""
        keep: dict = {}
        mask = np.arange(x.shape[1]) < lengths[:, None]
        error = ((self.forward(x, lengths, keep) - wanted) * mask / mask.sum()).astype(np.float32)
        grads = {"wo": np.einsum("rt,rth->h", error, keep["both"]), "bo": error.sum(keepdims=True).reshape(1)}
        for k, side in enumerate("fb"):
            seen, steps = keep[side]
            d_out = error[:, :, None] * self.p["wo"][k * HIDDEN:(k + 1) * HIDDEN]
            if side == "b":
                d_out = self._flip(d_out, lengths)
            wh = self.p["wh" + side]
            d_gates = np.empty((*error.shape, 4 * HIDDEN), np.float32)
            d_wh, d_h, d_c = np.zeros_like(wh), 0.0, 0.0
            for t in range(len(steps) - 1, -1, -1):
                i, f, o, u, before, c, last = steps[t]
                d_h = d_out[:, t] + d_h
                squashed = np.tanh(c)
                d_c = d_h * o * (1 - squashed ** 2) + d_c
                g = np.concatenate([d_c * u * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o),
                                    d_c * i * (1 - u ** 2)], axis=1)
                d_gates[:, t] = g
                d_wh += last.T @ g
                d_h, d_c = g @ wh.T, d_c * f
            flat = d_gates.reshape(-1, 4 * HIDDEN)
            grads |= {"wx" + side: seen.reshape(len(flat), -1).T @ flat, "wh" + side: d_wh, "b" + side: flat.sum(axis=0)}
        return grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities per block of each page. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, page in enumerate(pages) if len(page)), key=lambda i: len(pages[i]))
        for start in range(0, len(order), PAGES_AT_ONCE):
            part = order[start:start + PAGES_AT_ONCE]
            x, lengths = _padded([pages[i] for i in part])
            for i, length, row in zip(part, lengths, self.forward(x, lengths)):
                out[i] = row[:length]
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(row) for row in rows])
    x = np.zeros((len(rows), lengths.max(), rows[0].shape[1] if rows[0].ndim > 1 else 1), np.float32)
    for i, row in enumerate(rows):
        x[i, :len(row)] = row if row.ndim > 1 else row[:, None]
    return x, lengths


def _variant(blocks: list[tuple[Block, bool]], words: list[str], draw: random.Random) -> list[tuple[Block, bool]]:
    """The page in another dress: a different main container, and boilerplate put in."""
    new = draw.choice(["article", "main", "div.content", "div.post", "div.entry", "section.article", "div.story"])

    def dressed(element: str) -> str:
        return new if element.split(".")[0] == "article" else element

    out = [((tuple(dressed(e) for e in path), text, share), label) for (path, text, share), label in blocks]
    body = next((path[:2] for (path, _, _), label in out if label), ("html", "body"))
    inside = next((path[:-1] for (path, _, _), label in out if label), body)

    def sentence(least: int, most: int) -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(least, most)))

    kinds = [
        (("div.cookie.notice",), "p", 0.1, (8, 25)), (("aside.sidebar",), "li", 0.9, (2, 6)), (("aside",), "p", 0.1, (10, 40)),
        (("header",), "div", 0.3, (2, 6)), (("header", "ul.menu"), "li", 1.0, (1, 3)), (("form.search",), "div", 0.0, (2, 5)),
        (("form",), "p", 0.0, (2, 20)), (("section.comments", "div.comment"), "p", 0.0, (5, 60)),
        (("div.comments", "ul", "li.comment"), "p", 0.05, (5, 60)), (("div.ad",), "", 0.3, (3, 20)), (("div.advert.banner",), "p", 0.3, (3, 20)),
        (("div.related",), "li", 1.0, (3, 9)), (("div.share",), "", 0.9, (1, 4)), (("div.newsletter.popup",), "p", 0.1, (5, 25)),
        (("nav.breadcrumb",), "li", 1.0, (1, 3)), (("footer",), "p", 0.2, (3, 30)), (("footer", "div"), "", 0.4, (3, 12)),
    ]
    for extra, tag, share, size in draw.sample(kinds, draw.randint(2, 6)):
        root = draw.choice([body, body, inside])
        path = (*root, *extra, *([tag] if tag else []))
        at = draw.choice([0, len(out), draw.randint(0, len(out))])
        out[at:at] = [((path, sentence(*size), share), False) for _ in range(draw.randint(1, 5))]
    return out


def train(pages: list[str | None], seed: int = 7) -> Network | None:
    """The network from sample pages, in their own markup and in variants; null without blocks of both kinds."""
    draw = random.Random(seed)
    labelled = [[(block, markup_label(block[0])) for block in page_blocks(page)] for page in pages]
    labelled = [page for page in labelled if page]
    words = sorted({word for page in labelled for (_, text, _), _ in page for word in text.split(" ")[:50]})[:20_000]
    kinds = {label for page in labelled for _, label in page}
    if len(kinds) < 2:
        return None
    sequences = list(labelled)
    for _ in range(VARIANTS):
        sequences += [_variant(page, words, draw) for page in labelled]
    vectors, data = Vectors(), []
    for page in sequences:
        start = draw.randint(0, max(0, len(page) - TRAIN_BLOCKS))
        rows = vectors.rows([block for block, _ in page])[start:start + TRAIN_BLOCKS]
        data.append((rows, np.array([label for _, label in page], np.float32)[start:start + TRAIN_BLOCKS]))
    net = Network(seed)
    moment = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        draw.shuffle(data)
        for start in range(0, len(data), BATCH):
            part = data[start:start + BATCH]
            x, lengths = _padded([rows for rows, _ in part])
            wanted, _ = _padded([labels for _, labels in part])
            step += 1
            for name, grad in net.gradients(x, lengths, wanted[:, :, 0]).items():
                first, second = moment[name]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad ** 2 - second)
                net.p[name] -= (RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def train_on(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Network | None:
    """Train on the pages whose ids come first by hash, at most ``sample_pages``."""
    rows = pages.select("page_id", "html").filter("html IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html"))
    return train([row["html"] for row in rows.limit(sample_pages).collect()])


def main_texts(pages: list[str | None], net: Network | None, vectors: Vectors) -> list[str]:
    blocks = [page_blocks(page) for page in pages]
    if net is None:
        chosen = [[markup_label(path) for path, _, _ in page] for page in blocks]
    else:
        chosen = [row >= 0.5 for row in net.label([vectors.rows(page) for page in blocks])]
    return ["\n".join(text for (_, text, _), keep in zip(page, marks) if keep) for page, marks in zip(blocks, chosen)]


def extract(pages: DataFrame, net: Network | None) -> DataFrame:
    """``pages`` with ``text``: the main text of ``html``."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors()
        for batch in batches:
            yield pa.array(main_texts(batch.to_pylist(), net, vectors), pa.string())

    return pages.withColumn("text", texts("html"))


def op7(spark, sf_dir: str) -> DataFrame:
    spark = prepared(spark)
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, train_on(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
