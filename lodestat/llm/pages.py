"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of a page as text or surroundings."""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.exchange import add_columns

#: Bounds on the pages of the table a model is fitted on: those with the smallest hash of page_id among pages of at most so many characters.
TRAINING_PAGES, TRAINING_CHARS = 400, 100_000
#: Arranged pages added to them, blocks of one training sequence, feature slots, passes over the training pages.
ARRANGED_PAGES, SEQUENCE, SLOTS, PASSES = 900, 64, 1 << 16, 120

# HTML's elements by kind, and the names under which pages keep their text and what surrounds it.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style title noscript template iframe svg math object canvas".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "p": set(), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
HOLDERS = set("ul ol dl table select menu".split())
NAMES = {
    "text": "content post entry article story text body main blog page news essay",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs toc pagination pager tabs links",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer copyright legal imprint bottom colophon",
    "sidebar": "sidebar aside widget related recommended trending rail popular bio tags archive",
    "notice": "notice cookie cookies consent alert gdpr modal popup subscribe newsletter overlay paywall message warning share social",
    "advert": "ad ads advert advertisement sponsored sponsor promo adsbygoogle commercial",
    "form": "form search login signup register contact",
    "comments": "comments comment disqus discussion replies reply responses reviews",
}
ELEMENTS = {"text": "article main", "menu": "nav menu", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "dialog", "advert": "aside", "form": "form fieldset", "comments": "section"}
ROLES = {"text": "main", "menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}
AFFIXES = "main site page top left right box block area wrapper container list inner section item primary col row".split()
INSIDE_TEXT = ["sidebar", "notice", "advert", "form", "comments", "menu"]
PHRASES = {
    "menu": "Home|About|News|Contact|Products|Next page|Previous|Archive|Topics|Index",
    "header": "Welcome|Site name|Log in|Sign up|Search|The daily page",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Powered by|Contact us|&copy; example.com",
    "sidebar": "Related articles|Most read|Popular posts|You may also like|Tags|Follow us|About the author|Read more",
    "notice": "We use cookies.|Accept all|This site uses cookies to improve your experience.|Subscribe to our newsletter|Share|Your browser is out of date.|Sign in to continue reading",
    "advert": "Advertisement|Sponsored|Buy now|Anzeige|Publicidad|Publicité|Special offer",
    "form": "Name|E-mail|Password|Submit|Search|Send|Leave a reply|Your message",
    "comments": "Comments|3 replies|Reply|Report|Posted by guest|Leave a comment|Anonymous says",
}
# End of fixed values.

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>|([^<]++|<)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GONE = re.compile(r"""(?:\s|^)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in HIDDEN}
_SENTENCE = tuple(".!?…:;\"'»”)。！？")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % SLOTS


@dataclass
class Block:
    text: str
    features: list[int]
    path: tuple[str, ...]  # names of the elements around it, outermost first


class _Frames:
    """Features of an element's tag and names, kept by its spelling."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple[int, ...]] = {}

    def of(self, tag: str, attributes: str) -> tuple[int, ...]:
        found = self.known.get((tag, attributes))
        if found is None:
            names = [f"t:{tag}"]
            for m in _ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                names += [f"c:{w.lower()}" for w in _NAME.findall(value)]
            if _GONE.search(attributes):
                names.append("gone")
            found = tuple(dict.fromkeys(map(_slot, names)))
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[tag, attributes] = found
        return found


_frames = _Frames()


def _text_features(text: str, linked: int, tag: str) -> list[int]:
    words = text.split(" ")
    share = 0 if not linked else 1 if 2 * linked < len(text) else 2
    length = min(len(words).bit_length(), 8)
    names = [f"p:{tag}", f"n:{length}", f"l:{share}", f"nl:{length}:{share}", f"e:{text.endswith(_SENTENCE)}", f"u:{text[:1].isupper()}"]
    if "©" in text:
        names.append("sign")
    if len(words) <= 12:
        names += [f"w:{w.lower()}" for w in words]
    return [_slot(n) for n in names]


def blocks(source: str | None) -> list[Block]:
    """The leaf blocks of a page in its order: runs of text between the borders of elements that are not inline.

    Scripts, styles and other hidden elements give none. Character references are decoded, white space becomes one space, blocks
    without text are left out. Elements left open end where their parent ends; a block ends an open paragraph.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                outer = [name for name, _ in stack if name not in INLINE]
                features = {f for _, frame in stack for f in frame}
                features.update(_text_features(text, min(linked, len(text)), outer[-1] if outer else ""))
                out.append(Block(text, sorted(features), tuple(outer)))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal in_link
        in_link -= sum(name == "a" for name, _ in stack[upto:])
        del stack[upto:]

    source, at = source or "", 0
    while at < len(source):
        m = _TAG.match(source, at)
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            if text == "<" and source[at : at + 1].isalpha():  # a tag that never ends
                break
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in HIDDEN and not closing:
            if not attributes.endswith("/"):
                end = _CLOSE[name].search(source, at)
                at = end.end() if end else len(source)
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if name == "br":
            parts.append(" ")
        elif closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
        elif name not in VOID:
            if not inline:
                ended = CLOSED_BY.get(name, set()) | {"p"}
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ended:
                        close(k)
                        if stack and name == "tr":
                            continue
                        break
                    if stack[k][0] not in INLINE and not (name == "tr" and stack[k][0] in ("td", "th", "tr")):
                        break
            stack.append((name, _frames.of(name, attributes)))
            in_link += name == "a"
    flush()
    return out


@dataclass
class BlockField:
    weights: np.ndarray  # (SLOTS,) of the state "text"
    bias: float
    moves: np.ndarray  # (2, 2) scores of one state before another

    def emissions(self, page: list[Block]) -> np.ndarray:
        sizes = np.array([len(b.features) for b in page])
        flat = np.fromiter((f for b in page for f in b.features), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) + self.bias

    def decode(self, page: list[Block]) -> np.ndarray:
        """The likeliest labels of a page's blocks together, by Viterbi; ties go to text."""
        if not page:
            return np.zeros(0, bool)
        (s00, s01), (s10, s11) = self.moves.tolist()
        other, text, back = 0.0, 0.0, []
        for k, e in enumerate(self.emissions(page).tolist()):
            if k:
                from_text = (text + s10 >= other + s00, text + s11 >= other + s01)
                back.append(from_text)
                other, text = (text + s10 if from_text[0] else other + s00), (text + s11 if from_text[1] else other + s01)
            text += e
        state = text >= other
        out = [state]
        for from_text in reversed(back):
            state = from_text[state]
            out.append(state)
        return np.array(out[::-1], bool)


def log_likelihood(field: BlockField, flat: np.ndarray, cell: np.ndarray, labels: np.ndarray, used: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Log-likelihood of labelled sequences (sequences, length) and its gradient by weights, bias and moves.

    Feature slot flat[i] belongs to the block at position cell[i] of the flattened sequences.
    """
    s, length = labels.shape
    e = np.where(used, np.bincount(cell, field.weights[flat], s * length).reshape(s, length) + field.bias, 0.0)
    m = field.moves
    alpha = np.empty((s, length, 2))
    beta = np.zeros((s, length, 2))
    both = np.stack([np.zeros_like(e), e], axis=2)
    alpha[:, 0] = both[:, 0]
    for k in range(1, length):
        new = np.logaddexp(alpha[:, k - 1, 0, None] + m[0], alpha[:, k - 1, 1, None] + m[1]) + both[:, k]
        alpha[:, k] = np.where(used[:, k, None], new, alpha[:, k - 1])
    for k in range(length - 1, 0, -1):
        ahead = both[:, k] + beta[:, k]
        new = np.logaddexp(ahead[:, 0, None] + m[:, 0], ahead[:, 1, None] + m[:, 1])
        beta[:, k - 1] = np.where(used[:, k, None], new, beta[:, k])
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
    error = np.where(used, labels - p, 0.0)
    here = used[:, 1:] & used[:, :-1]
    pair = np.exp(alpha[:, :-1, :, None] + m[None, None] + (both + beta)[:, 1:, None, :] - total[:, None, None, None])
    truth = np.stack([1.0 - labels, labels], axis=2)
    real = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    value = (e * labels * used).sum() + (real * here[..., None, None] * m).sum() - total.sum()
    gradient = np.bincount(flat, error.ravel()[cell], SLOTS)
    return float(value), gradient, float(error.sum()), ((real - pair) * here[..., None, None]).sum(axis=(0, 1))


def fit(pages: list[tuple[list[Block], list[int]]], passes: int = PASSES, ridge: float = 0.05) -> BlockField:
    """A field that maximises the ridged likelihood of labelled pages, by full-batch Adagrad; long pages are cut into sequences."""
    cuts = [(page[a : a + SEQUENCE], labels[a : a + SEQUENCE]) for page, labels in pages for a in range(0, len(page), SEQUENCE)]
    field = BlockField(np.zeros(SLOTS), 0.0, np.zeros((2, 2)))
    if not cuts:
        return field
    length = max(len(page) for page, _ in cuts)
    labels, used = np.zeros((len(cuts), length)), np.zeros((len(cuts), length), bool)
    flat, cell = [], []
    for k, (page, marks) in enumerate(cuts):
        labels[k, : len(page)], used[k, : len(page)] = marks, True
        for j, b in enumerate(page):
            flat += b.features
            cell += [k * length + j] * len(b.features)
    flat, cell = np.array(flat), np.array(cell)
    seen_w, seen_b, seen_m = np.full(SLOTS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(passes):
        _, g_w, g_b, g_m = log_likelihood(field, flat, cell, labels, used)
        g_w -= ridge * field.weights
        seen_w, seen_b, seen_m = seen_w + g_w**2, seen_b + g_b**2, seen_m + g_m**2
        field.weights += 0.5 * g_w / np.sqrt(seen_w)
        field.bias += 0.5 * g_b / np.sqrt(seen_b)
        field.moves += 0.5 * g_m / np.sqrt(seen_m)
    return field


def _opening(draw: random.Random, kind: str) -> str:
    """The start tag of a part of this kind: an element made for it, or a plain one with a telling class, id or role."""
    way = draw.random()
    if way < 0.2 and kind not in ("advert", "comments"):
        return f"<{draw.choice(ELEMENTS[kind].split())}>"
    if way < 0.25 and kind in ROLES:
        return f'<div role="{ROLES[kind]}">'
    if way < 0.3 and kind == "text":
        return draw.choice(["<div>", '<div itemprop="articleBody">'])
    names = [draw.choice(NAMES[kind].split())]
    if draw.random() < 0.4:
        names.insert(draw.randint(0, 1), draw.choice(AFFIXES))
    element = draw.choice(["div"] * 5 + ["section", "ul" if kind in ("menu", "comments") else "div", *ELEMENTS[kind].split()])
    return f'<{element} {draw.choice(["class", "class", "id"])}="{draw.choice("-_ ").join(names)}">'


def _end_of(opening: str) -> str:
    return "".join(f"</{name}>" for name in reversed(re.findall(r"<([a-z]+)", opening)))


def marked(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its text by an article or main element; None for other pages."""
    own = [bool({"article", "main"} & set(b.path)) for b in page]
    if not any(own):
        return None
    around = {"nav", "aside", "footer", "form", "dialog"}
    return [int(x and not around & set(b.path)) for x, b in zip(own, page, strict=True)]


def arranged(texts: list[str], heads: list[str], shorts: list[str], seed: int) -> tuple[list[Block], list[int]]:
    """A page that lays out these texts at random under the names pages use, and the labels of its blocks.

    Long ``texts`` and short ``heads`` are text, ``shorts`` surroundings; comments and side columns hold long texts too.

    Every part is given its own block, so labels follow from the layout.
    """
    draw = random.Random(seed)
    out: list[tuple[str, int]] = []  # piece of html, label of the block in it or -1

    def some(kind: str) -> None:
        opening = _opening(draw, kind)
        out.append((opening, -1))
        phrases, item = PHRASES[kind].split("|"), "li" if kind == "menu" or draw.random() < 0.2 else "p"
        count = draw.randint(2, 7) if kind in ("menu", "sidebar", "comments") else draw.randint(1, 3)
        for _ in range(count):
            own = draw.random()
            text = draw.choice(phrases) if own < 0.5 else html.escape(draw.choice(shorts if own < 0.8 or kind in ("menu", "form") else texts))
            if kind == "menu" or draw.random() < 0.2:
                text = f'<a href="/x">{text}</a>'
            if kind == "comments" and draw.random() < 0.5:
                out.append((f'<div class="comment"><p>{text}</p></div>', 0))
            elif kind == "form" and draw.random() < 0.6:
                out.append((f"<label>{text}</label>", 0))
            elif count == 1:
                out.append((text, 0))
            else:
                out.append((f"<{item}>{text}</{item}>", 0))
        out.append((_end_of(opening), -1))

    outside = draw.random() < 0.5
    for kind in ("notice", "header", "menu", "advert", "sidebar"):
        if draw.random() < 0.5:
            some(kind)
    opening = _opening(draw, "text")
    out.append((opening, -1))
    if draw.random() < 0.8:
        title = html.escape(draw.choice(heads + texts))
        head = draw.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"])
        out.append((head.format(title), 1))
    for _ in range(draw.randint(1, 12)):
        kind = draw.random()
        text = html.escape(draw.choice(texts if kind < 0.85 else heads))
        form = draw.choice(["<p>{}</p>"] * 12 + ["<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<p><b>{}</b>", "<p>{}", '<section class="text"><p>{}</p></section>', "<figure><figcaption>{}</figcaption></figure>"])
        out.append((form.format(text), 1))
        if draw.random() < 0.08:
            some(draw.choice(INSIDE_TEXT))
    if outside and draw.random() < 0.5:
        some("comments")
    out.append((_end_of(opening), -1))
    for kind in ("sidebar", "comments", "advert", "form", "menu", "footer", "notice"):
        if draw.random() < 0.5:
            some(kind)
    page = blocks("<body>" + "".join(piece for piece, _ in out) + "</body>")
    labels = [label for piece, label in out if label >= 0 and blocks(piece)]
    return (page, labels) if len(page) == len(labels) else ([], [])


def train(pages: DataFrame, seed: int = 1) -> BlockField:
    """A field fitted on labelled pages: sampled pages whose own markup names their text, and arrangements of their texts.

    At most TRAINING_PAGES pages of at most TRAINING_CHARS characters reach the driver. Without such pages the arrangements use
    placeholder texts.
    """
    small = pages.where(F.length("html") <= TRAINING_CHARS).select("page_id", "html")
    rows = small.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(TRAINING_PAGES).collect()
    labelled, texts, heads, shorts = [], [], [], []
    for row in rows:
        page = blocks(row.html)
        labels = marked(page)
        if labels is None:
            continue
        labelled.append((page, labels))
        for b, label in zip(page, labels, strict=True):
            if len(b.text) < 4000:
                (shorts if not label else texts if len(b.text) > 60 else heads).append(b.text)
    filler = random.Random(seed)
    texts = texts or [" ".join("word" + str(filler.randint(0, 99)) for _ in range(filler.randint(12, 60))) + "." for _ in range(50)]
    heads, shorts = heads or texts, shorts or [" ".join("word" + str(filler.randint(0, 99)) for _ in range(filler.randint(1, 5))) for _ in range(50)]
    return fit(labelled + [arranged(texts, heads, shorts, seed * 1_000_003 + k) for k in range(ARRANGED_PAGES)])


def main_text(source: str | None, field: BlockField) -> str:
    page = blocks(source)
    return "\n".join(b.text for b, keep in zip(page, field.decode(page), strict=True) if keep)


def extract(pages: DataFrame, field: BlockField) -> DataFrame:
    """``pages`` with text, the main text of the whole ``html``, and n_chars, its code points; columns of these names are replaced.

    Null, empty and text-less pages give an empty text. Each row is handled by itself, so repeated rows get equal texts; nothing is
    cut from a long page. A page that is plain text without markup is one block.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [main_text(source, field) for source in batch.column("html").to_pylist()]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return add_columns(pages, new, compute, by="html")
