"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between the tags that start or end a block. Each block is described by its
ancestors (tags, class and id words) and by its text (length, links, punctuation, place), and the chain of blocks is
labelled main or other by Viterbi with weights trained by gradient ascent on the likelihood of labelled pages. The
labelled pages are generated: many layouts, with and without telling tags, so that the weights carry over.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, blocks array<string>"
_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.string()))])
# Attributes as HTML reads them: a quote opens a value only right after "="; elsewhere, or when nothing closes it, it is an ordinary character.
ATTRIBUTES = r"""(?:[\t\n\f\r /]+|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >]++|(?=>)))?+)*+"""
TOKEN, PLAIN = (re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![A-Za-z])[^>]*>|</?([A-Za-z][^\t\n\f\r />]*)({x})>|[^<]+|<(?![A-Za-z/!?])", re.DOTALL) for x in (ATTRIBUTES, "[^>]*"))
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.!?,;:]")
# The tags of HTML by how they behave.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head math noscript object script style svg template title".split())
FOREIGN = frozenset(("math", "svg"))
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*/>$")  # the stroke is the last character of a value
DEEPEST = 512  # open elements, as browsers have it: one more takes the place of the innermost
RAW = frozenset("script style textarea title xmp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"article", "aside", "button", "div", "li", "section", "table", "td", "th"}}


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # ancestors: tag, class and id words
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order; hidden elements, comments and markup leave none."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked, hidden, links, foreign = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
            held.clear()
        linked = 0

    def pop_to(at: int) -> None:
        nonlocal hidden, links, foreign
        while len(stack) > at:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            links -= tag == "a"
            foreign -= tag in FOREIGN

    at, end, token = 0, len(page), TOKEN
    while at < end:
        m = token.match(page, at)
        if m is None:
            if token is PLAIN or page.find(">", at) < 0:  # a tag that the page's end cuts off
                break
            token = PLAIN  # quotes run into the page's end: from here on the next ">" ends a tag
            continue
        at = m.end()
        part = m[0]
        if m[1] is None:
            if part[0] == "<" and len(part) > 1:
                continue  # comment or declaration
            if not hidden:
                held.append(part)
                linked += len(part) if links else 0
            continue
        tag = m[1].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            held.append(" ")
        if part[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        closes, scope = ({"p"}, SCOPE["p"]) if tag in CLOSES_P else (SIBLING.get(tag), SCOPE.get(tag, frozenset()))
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop_to(i)
                    break
                if stack[i][0] in scope:
                    break
        if tag in VOID or ((foreign or tag in FOREIGN) and part.endswith("/>") and not UNQUOTED_END.search(part)):
            continue  # elsewhere the stroke means nothing
        pop_to(DEEPEST - 1)
        words = " ".join(x[1].strip("\"'").lower() for x in ATTRIBUTE.findall(m[2])) if m[2] else ""
        stack.append((tag, words))
        hidden += tag in HIDDEN
        links += tag == "a"
        foreign += tag in FOREIGN
        if tag in RAW:
            close = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            stop = close.start() if close else end
            if tag == "textarea":
                held.append(page[at:stop])
            at = stop
    flush()
    return blocks


@lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    found = {f"tag={tag}" for tag, _ in path}
    found |= {f"word={w}" for _, words in path for w in re.findall(r"[a-z]+", words)}
    if path:
        found |= {f"leaf={path[-1][0]}", f"two={path[-2][0] if len(path) > 1 else ''}>{path[-1][0]}"}
    return tuple(sorted(found))


def text_features(block: Block, nth: int, of: int) -> tuple[str, ...]:
    n = len(block.text)
    dense = block.linked / n
    stops = len(PUNCTUATION.findall(block.text))
    return (
        "always", f"size={min(n.bit_length(), 10)}", f"links={0 if dense < 0.05 else 1 if dense < 0.5 else 2}", f"stops={min(stops, 4)}",
        f"ends={block.text[-1] in '.!?…'}", f"copy={'©' in block.text}", f"place={nth * 4 // of}",
    )


@dataclass
class BlockCRF:
    """weights: feature -> score of main over other; moves[a, b]: score of b after a; first: score of starting main."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0

    def features(self, blocks: list[Block]) -> list[tuple[str, ...]]:
        return [path_features(b.path) + text_features(b, i, len(blocks)) for i, b in enumerate(blocks)]

    def viterbi(self, rows: list[tuple[str, ...]]) -> list[int]:
        get = self.weights.get
        (oo, om), (mo, mm) = self.moves.tolist()
        other, main, back = 0.0, self.first, []
        for i, row in enumerate(rows):
            score = sum(get(f, 0.0) for f in row)
            if i:
                from_o, from_m = (other >= main + mo - oo), (other + om > main + mm)
                other, main = (other + oo if from_o else main + mo), (other + om if from_m else main + mm)
                back.append((0 if from_o else 1, 0 if from_m else 1))
            main += score
        label = int(main > other)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if rows else []

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> BlockCRF:
        """AdaGrad on the log-likelihood, by forward-backward, a page at a time."""
        seen: dict[str, float] = {}
        seen_moves, seen_first = np.full((2, 2), 1e-6), 1e-6
        for _ in range(epochs):
            for rows, labels in pages:
                n = len(rows)
                emit = np.zeros((n, 2))
                emit[:, 1] = [sum(self.weights.get(f, 0.0) for f in row) for row in rows]
                emit[0, 1] += self.first
                fore, back = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = emit[0]
                for i in range(1, n):
                    fore[i] = np.logaddexp(fore[i - 1, 0] + self.moves[0], fore[i - 1, 1] + self.moves[1]) + emit[i]
                for i in range(n - 2, -1, -1):
                    ahead = back[i + 1] + emit[i + 1]
                    back[i] = np.logaddexp(self.moves[:, 0] + ahead[0], self.moves[:, 1] + ahead[1])
                total = np.logaddexp(*fore[-1])
                error = np.array(labels) - np.exp(fore[:, 1] + back[:, 1] - total)
                for row, e in zip(rows, error.tolist(), strict=True):
                    for f in row:
                        g = e - decay * self.weights.get(f, 0.0)
                        seen[f] = seen.get(f, 1e-6) + g * g
                        self.weights[f] = self.weights.get(f, 0.0) + rate * g / seen[f] ** 0.5
                pull = np.zeros((2, 2))
                for i in range(1, n):
                    pull[labels[i - 1], labels[i]] += 1
                    pull -= np.exp(fore[i - 1][:, None] + self.moves + (emit[i] + back[i])[None] - total)
                seen_moves += pull * pull
                self.moves = self.moves + rate * pull / np.sqrt(seen_moves)
                seen_first += error[0] ** 2
                self.first += rate * error[0] / seen_first**0.5
        return self


def training_pages(n: int = 400, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """Generated labelled pages: html and a label per leaf block, 1 for main text."""
    rng = np.random.default_rng(seed)
    parts = ("al", "be", "con", "der", "e", "fa", "gen", "ha", "il", "jo", "ka", "le", "mon", "no", "or", "pre", "qua", "re", "sta", "tion", "un", "ve")
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(rng.choice(parts, int(rng.integers(1, 5))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(3, 16).capitalize() + pick(".", ".", ".", "?", "!")
    para = lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 8))))
    short = lambda: pick(words(1, 3).capitalize() + pick(".", ""), sentence(), para())
    junk = lambda: " ".join(w + pick("###", "$$$", "***", "", "&amp;") for w in words(3, 30).split())

    for _ in range(n):
        labels: list[int] = []

        def put(tag: str, text: str, main: int, close: bool = True, labels=labels) -> str:
            labels.append(main)
            return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else "")

        def link_list(labels=labels) -> str:
            found = []
            for _ in range(int(rng.integers(2, 8))):
                labels.append(0)
                found.append(f'<li><a href="/{word()}">{words(1, 3)}</a></li>')
            return "<ul>" + "".join(found) + "</ul>"

        def boiler(kind: str, put=put, link_list=link_list) -> str:
            if kind == "menu":
                return pick("<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav-bar">{}</div>', '<div role="navigation">{}</div>').format(link_list())
            if kind == "ad":
                return pick('<div class="ad">{}</div>', '<div class="advert sponsored">{}</div>', '<aside class="promo">{}</aside>', '<div id="banner-ads">{}</div>').format(pick(sentence, para)()) if labels.append(0) is None else ""
            if kind == "aside":
                return pick("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related">{}</div>').format(put("h3", words(1, 3), 0) + link_list())
            if kind == "notice":
                return put(pick('div class="cookie-notice"', 'div class="notice"', 'div id="consent-banner"', 'div class="newsletter popup"'), para(), 0)
            if kind == "form":
                return "<form>" + put("label", words(1, 3) + ":", 0) + '<input name="q">' + put("p", sentence(), 0) + put("button", word(), 0) + "</form>"
            if kind == "comments":
                inner = "".join(pick('<div class="comment">{}</div>', '<li class="comment">{}</li>').format(put("p", pick(sentence, para)(), 0)) for _ in range(int(rng.integers(1, 5))))
                return pick('<section id="comments">{}</section>', '<div class="comments">{}</div>', '<div class="reader-comments">{}</div>').format(put("h3", words(1, 3), 0) + inner)
            if kind == "share":
                return put('div class="share"', " ".join(f'<a href="#">{word()}</a>' for _ in range(3)), 0)
            return pick("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>').format(put("p", "&copy; " + sentence(), 0, close=True) if pick(0, 1) else (labels.append(0), "&copy; " + words(2, 8))[1])

        out = ["<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"]
        if pick(0, 1, 1):
            out.append(pick("<header>{}</header>", '<div class="header">{}</div>').format(put(pick("h1", "p", "div"), words(1, 4), 0)))
        out += [boiler(k) for k in ("notice", "menu", "ad", "form", "aside") if rng.random() < 0.6]
        opening, closing = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ('<div class="article-text entry">', "</div>"), ("<main><article>", "</article></main>"), ("<div><div>", "</div></div>"))
        noisy = rng.random() < 0.15
        body = junk if noisy else para
        out.append(opening)
        if pick(0, 1, 1):
            out.append(put(pick("h1", "h1", "h2"), words(1, 10), 1))
        for _ in range(int(rng.integers(1, 12))):
            roll = rng.random()
            if roll < 0.7:
                out.append(put("p", pick(body, body, short)(), 1, close=rng.random() < 0.85))
            elif roll < 0.78:
                out.append(put("p", f"<b>{sentence()}<br>", 1, close=False))
            elif roll < 0.84:
                out.append("<ul>" + "".join(put("li", pick(sentence, lambda: words(1, 5))(), 1) for _ in range(3)) + "</ul>")
            elif roll < 0.9:
                out.append(put(pick("h2", "h3"), words(1, 6), 1))
            elif roll < 0.94:
                out.append("<blockquote>" + put("p", para(), 1) + "</blockquote>")
            else:
                out.append(boiler(pick("ad", "share", "aside", "form", "notice")))
        out.append(closing)
        out += [boiler(k) for k in ("share", "comments", "aside", "menu") if rng.random() < 0.35]
        out.append(boiler("footer"))
        yield "".join(out) + "</body></html>", labels


@lru_cache(maxsize=2)
def trained_crf(pages: int = 400, seed: int = 5) -> BlockCRF:
    crf = BlockCRF()
    rows = []
    for page, labels in training_pages(pages, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a training page's labels do not match its blocks")
        rows.append((crf.features(blocks), labels))
    return crf.fit(rows)


def extract_main(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html_: str = "html", crf: BlockCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the blocks of every page labelled main, in page order, joined by newlines.

    Null html counts as empty; pages without main blocks give an empty text. White space inside a block becomes one
    space. Repeated rows give repeated results; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or trained_crf())  # some hundred weights

    def extract(batches):
        model = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                out = []
                for page in batch.column(2).to_pylist():
                    blocks = leaf_blocks(page or "")
                    labels = model.viterbi(model.features(blocks))
                    out.append([b.text for b, label in zip(blocks, labels, strict=True) if label])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], schema=_PAGES)

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_).alias("html")).mapInArrow(extract, PAGES)
    text = F.array_join("blocks", "\n")
    return rows.select(F.col("page_id").alias(page_id), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
