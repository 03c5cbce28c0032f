"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the runs of text between block tags. Each block has features from
its ancestors (tags, words of class and id) and its text. The field labels the sequence of blocks
as main text or not; Viterbi finds the best labelling. It is trained on labelled pages: a bounded
sample of pages whose main text is known, and a few pages written here that show the parts of a
page which a sample may lack.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import map_columns

#: HTML's block elements, elements without content, and elements without text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template textarea svg iframe object canvas head title".split())
#: Tags that end an open paragraph, and tags that end an open one of their own kind.
SIBLINGS = frozenset("li dt dd option tr td th".split())

#: Words in class and id names that say what a part of a page is.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead topbar banner logo",
    "foot": "footer copyright legal colophon",
    "side": "sidebar side aside widget related recommended recommendations more rail teaser trending",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion adsense",
    "notice": "cookie cookies consent notice gdpr popup modal alert newsletter subscribe paywall overlay",
    "comment": "comment comments reply replies discussion disqus respond",
    "share": "share social sharing follow",
    "form": "form login signup search register",
}
#: Roles of elements; a header is the page's own only outside of the article.
TAG_ROLES = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "form": "form", "dialog": "notice"}
TEXT_TAGS = frozenset(("article", "main"))
ROLE_OF = {word: role for role, listed in ROLES.items() for word in listed.split()}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

SAMPLE = 300  # labelled pages to learn from, about
EPOCHS, RATE, RIDGE = 40, 0.2, 1e-4
MAIN, OTHER = 1, 0


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    roles: frozenset[str]
    linked: int  # characters inside links


class BlockParser(HTMLParser):
    """Cuts a page into leaf blocks; closes tags that are left open as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0  # open elements whose text does not count
        self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            roles = frozenset().union(*[r for _, r in self.open])
            self.blocks.append(Block(text, frozenset(t for t, _ in self.open), roles, self.linked))
        self.parts, self.linked = [], 0

    def _push(self, tag: str, roles: frozenset[str]) -> None:
        self.open.append((tag, roles))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def _pop_to(self, place: int) -> None:
        for tag, _ in self.open[place:]:
            self.silent -= tag in SILENT_TAGS
            self.links -= tag == "a"
        del self.open[place:]

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop_to(i)
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            if tag == "body":
                self._close("head")
            elif "p" in {t for t, _ in self.open}:
                self._close("p", frozenset(("td", "th", "li", "div", "blockquote", "article", "section")) if tag != "p" else frozenset())
            if tag in SIBLINGS:
                self._close(tag, frozenset(("ul", "ol", "dl", "table", "select", "tbody")))
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID_TAGS:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            roles = {ROLE_OF[w] for w in map(str.lower, _NAME.findall(names)) if w in ROLE_OF}
            if tag in TAG_ROLES:
                roles.add(TAG_ROLES[tag])
            if tag == "header" and not TEXT_TAGS & {t for t, _ in self.open}:
                roles.add("head")
            self._push(tag, frozenset(roles))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in {t for t, _ in self.open}:
            self._close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data) * (self.links > 0)


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page, in its order; none for null or empty pages."""
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def block_features(block: Block) -> list[str]:
    text = block.text
    n = len(text.split())
    linked = block.linked / len(text)
    inside = bool(TEXT_TAGS & block.tags)
    found = [f"tag={t}" for t in block.tags if t in BLOCK_TAGS and t not in ("html", "body")]
    found += [f"role={r}" for r in block.roles]
    found += [
        "always",
        f"words={min(n.bit_length(), 7)}",
        f"links={int(linked * 3)}",
        f"stop={text[-1] in '.!?'}",
        f"symbol={not text[0].isalnum()}",
        f"inside={inside}",
        f"plain={inside and not block.roles}",
    ]
    return found


@dataclass
class Field:
    """Weights of the field: by feature and label, and by pair of neighbouring labels."""

    state: dict[str, np.ndarray] = field(default_factory=dict)
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, page: Sequence[Sequence[str]]) -> np.ndarray:
        none = np.zeros(2)
        return np.array([np.sum([self.state.get(f, none) for f in found], axis=0) for found in page])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def marginals(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each block's label, and the expected number of each pair of labels."""
    n = len(scores)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = scores[0]
    for i in range(1, n):
        ahead[i] = scores[i] + _logsum(ahead[i - 1][:, None] + move, 0)
    for i in range(n - 2, -1, -1):
        back[i] = _logsum(move + (scores[i + 1] + back[i + 1])[None, :], 1)
    total = _logsum(ahead[-1], 0)
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs += np.exp(ahead[i - 1][:, None] + move + (scores[i] + back[i])[None, :] - total)
    return np.exp(ahead + back - total), pairs


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """Best labelling; the smaller label at a tie."""
    best, came = scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + move
        came.append(ways.argmax(0))
        best = ways.max(0) + row
    path = [int(best.argmax())]
    for step in reversed(came):
        path.append(int(step[path[-1]]))
    return path[::-1]


def train(pages: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], epochs: int = EPOCHS) -> Field:
    """Fit the field by gradient steps (Adagrad) on the likelihood of labelled pages."""
    model = Field({f: np.zeros(2) for page, _ in pages for found in page for f in found})
    seen = {f: np.full(2, 1e-6) for f in model.state}
    seen_move = np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for page, labels in pages:
            if not page:
                continue
            p, pairs = marginals(model.scores(page), model.move)
            gap = np.eye(2)[np.asarray(labels)] - p
            grads: dict[str, np.ndarray] = {}
            for found, g in zip(page, gap):
                for f in found:
                    grads[f] = grads.get(f, 0) + g
            for f, g in grads.items():
                g = g - RIDGE * model.state[f]
                seen[f] += g * g
                model.state[f] = model.state[f] + RATE * g / np.sqrt(seen[f])
            g = np.zeros((2, 2))
            for a, b in zip(labels, labels[1:]):
                g[a, b] += 1
            g -= pairs
            seen_move += g * g
            model.move = model.move + RATE * g / np.sqrt(seen_move)
    return model


def _flat(text: str) -> str:
    return "".join(text.split())


def labelled(html: str, main: str) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page whose main text is known.

    A block is main text if its text, white space aside, is a line of the main text or begins it.
    """
    lines = {_flat(x) for x in main.split("\n")}
    whole = _flat(main)
    found = blocks(html)
    marks = [MAIN if (t := _flat(b.text)) in lines or whole.startswith(t) else OTHER for b in found]
    return [block_features(b) for b in found], marks


def sampled(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` of the pages with an id and html, by hash of the id."""
    known = pages.filter("page_id is not null and html is not null")
    place = F.pmod(F.xxhash64("page_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    return known.filter(place < sample / max(1, known.count()))


def fit(pages: DataFrame, truth: DataFrame) -> Field:
    """Train on ``pages`` (page_id, html), a bounded sample, and on the pages written here.

    ``truth``: page_id, main; the main text of some of the pages.
    """
    known = truth.filter("page_id is not null and main is not null").select("page_id", "main")
    rows = pages.select("page_id", "html").join(known, "page_id").orderBy("page_id").limit(2 * SAMPLE).collect()
    examples = [labelled(r["html"], r["main"]) for r in rows]
    # a page of which no block was recognised says nothing
    examples = [x for x in examples if MAIN in x[1]]
    return train(examples + written_pages())


def written_pages() -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages for the parts that pages have in general; MAIN in a text marks main text."""
    par = "MAIN the river was low that summer, and the boats lay on the sand for weeks before rain came."
    short = "MAIN A short line"
    parts = [
        '<header><h1>Site</h1><p>The daily paper of the valley, since long ago.</p></header>',
        '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>',
        '<aside><h2>Related</h2><p>Another story that you could read after this one is done.</p></aside>',
        '<div class="sidebar"><h3>More</h3><p>Most read in this week are these stories, among others.</p></div>',
        '<div class="cookie-notice"><p>We use cookies to make this site work, and to count visits.</p></div>',
        '<div id="notice">This page will move to a new address soon, please be patient.</div>',
        '<div class="ad">Buy two lamps and pay for one, only in this week and only here.</div>',
        '<form><label>Name</label><p>Sign up and we will write to you every week.</p><button>Send</button></form>',
        '<div class="newsletter"><p>Our letter comes on Mondays. Leave your address to get it.</p></div>',
        '<section class="comments"><h3>Comments</h3><p>I was there and it was just as this says.</p><div class="comment"><p>No, it rained.</p></div></section>',
        '<ul class="share"><li><a href="#">Send</a></li><li><a href="#">Print</a></li></ul>',
        '<footer><p>&copy; The paper. All rights are with the writers of the texts.</p></footer>',
    ]
    bodies = [
        f"<h1>{short}</h1><p>{par}</p><p>{par}</p>",
        f"<h1>{short}</h1><p>{short}</p><h2>{short}</h2><p>{par}</p><ul><li>{short}</li><li>{par}</li></ul>",
        f"<h1>{short}</h1><blockquote><p>{par}</p></blockquote><table><tr><td>{short}</td><td>{short}</td></tr></table>",
        f'<header><h1>{short}</h1></header><div class="text"><p>{par}</p><p>{short}</p></div><pre>{short}</pre>',
        f"<section><h2>{short}</h2><p>{par}<br>{short}</p></section><div>{par}</div>",
        f'<h1>{short}</h1><p><a href="#">{short}</a></p><p>{par}</p><figure><figcaption>{short}</figcaption></figure>',
    ]
    pages = []
    for i, body in enumerate(bodies):
        for k, inner in enumerate(parts):
            before = "".join(parts[(i + k + j) % len(parts)] for j in range(3))
            after = "".join(parts[(i + k + 5 + j) % len(parts)] for j in range(3))
            if inner.startswith("<header"):
                inner = ""
            cut = body.rfind("<p>") if k % 2 else len(body)
            tag = ("article", "main")[(i + k) % 4 == 3]
            html = f"<body>{before}<{tag}>{body[:cut]}{inner}{body[cut:]}</{tag}>{after}</body>"
            found = blocks(html)
            pages.append(([block_features(b) for b in found], [int("MAIN" in b.text) for b in found]))
    return pages


def main_text(html: str | None, model: Field) -> str:
    """Text of the blocks that Viterbi labels as main text, one per line."""
    found = blocks(html)
    if not found:
        return ""
    path = viterbi(model.scores([block_features(b) for b in found]), model.move)
    return "\n".join(b.text for b, label in zip(found, path) if label == MAIN)


def extract(pages: DataFrame, model: Field, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of ``pages`` with text and n_chars (its code points).

    A null html is empty, and a page without main text has an empty text. Rows with equal or null
    ids are read one by one; an empty table gives an empty result.
    """

    def make():
        def run(pages_: list[str | None]) -> list[list]:
            texts = [main_text(h, model) for h in pages_]
            return [texts, [len(t) for t in texts]]

        return run

    return map_columns(pages, keep, [F.col("html")], "text string, n_chars long", make)
