"""Main text of web pages by a linear-chain conditional random field over the page's leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, in page order, each with the tags and the class,
id and role words of its ancestors. The field has two states, main text and the rest; its features are those ancestors
and the block's own text (length, share of links, punctuation), its transitions link neighbouring blocks. It is
trained by stochastic gradients of the log-likelihood (forward-backward) and decoded by Viterbi.

Training pages are a bounded sample of the table's pages that mark their article themselves (by the article or main
element) and pages laid out here in many common ways around the sample's own sentences, where every block is labelled.
The marks of the article are hidden in part of the training, so that the other features are learned too.

Null html gives the empty text, and so does a page without a main block. Broken markup is read as browsers do in the
plain cases: unknown end tags are skipped, open elements end with their parent. Repeated pages give repeated rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import batches

SAMPLE_PAGES = 150
LAID_OUT_PAGES = 500
EPOCHS = 6
SEED = 7

# Fixed values of HTML: elements that start a new block, that have no end tag, and that a head may hold; any other ends it.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section
select summary table tbody td textarea tfoot th thead title tr ul label iframe""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_PARTS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_ITSELF = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",)}
STOPS_AT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
            "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}

#: Elements whose text is never shown, whole. A name ends at a space, slash or >, so svg-icon is not svg; <svg/> is empty. Only
#: script and style run to the end of the page when they are not closed; others then count as a tag like any.
_RAW = (r"<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?<=/)>"
        r"|<(?P<raw>noscript|template|title|svg|math|object|iframe|canvas|audio|video)(?=[\s/>])[^>]*>.*?</(?P=raw)\s*>"
        r"|<(?P<code>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=code)\s*>|\Z)")
_PART = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|" + _RAW
    + r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("text", "path", "names", "linked", "label")

    def __init__(self, text: str, path: tuple[str, ...], names: frozenset[str], linked: int, label: str):
        self.text, self.path, self.names, self.linked, self.label = text, path, names, linked, label


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str], str, bool]] = []  # tag, names of it and its ancestors, label, whether in a link
    pieces: list[str] = []
    linked = 0
    nothing = frozenset()

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                path = tuple(s[0] for s in stack)
                if "head" not in path:
                    top = stack[-1] if stack else ("", nothing, "", False)
                    out.append(Block(text, path, top[1], linked, top[2]))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and not text.isspace():
            stack.pop()
        pieces.append(text)
        if stack and stack[-1][3]:
            linked += len(text)

    at = 0
    for m in _PART.finditer(html):
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[0] in BLOCK for s in stack[i:]):
                        close()
                    del stack[i:]
                    break
            else:
                if tag == "p":
                    close()
            continue
        if tag not in HEAD_PARTS and any(s[0] == "head" for s in stack):
            close()
            del stack[next(i for i, s in enumerate(stack) if s[0] == "head"):]
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            close()
            if tag == "body":
                stack = [s for s in stack if s[0] == "html"]
            ends = ENDS_ITSELF.get(tag, ("p",) if tag not in ("html", "body") else ())
            stops = STOPS_AT.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in stops or (stack[i][0] in BLOCK and stack[i][0] not in ("p", "li", "dt", "dd", "td", "th")):
                    break
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCK:
            continue
        names, label = (stack[-1][1], stack[-1][2]) if stack else (nothing, "")
        if "=" in m["rest"]:
            own = set()
            for a in _ATTRIBUTE.finditer(m["rest"]):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-label":
                    label = value
                else:
                    own.update(_NAME.findall(_CAMEL.sub(" ", value).lower()))
            if own:
                names = names | own
        stack.append((tag, names, label, tag == "a" or bool(stack) and stack[-1][3]))
    if at < len(html):
        add(html[at:])
    close()
    return out


def features(blocks: list[Block], hide: bool = False) -> list[list[str]]:
    """Feature names of every block. ``hide`` leaves out the marks that name the article outright."""
    out = []
    for b in blocks:
        n = len(b.text)
        words = b.text.count(" ") + 1
        share = b.linked / max(1, n)
        f = ["bias", "words:%d" % min(7, words.bit_length()), "links:%d" % (0 if share == 0 else 1 if share < 0.4 else 2),
             "end:" + ("stop" if b.text[-1] in ".!?:;\"”»…" else "none"), "tag:" + (b.path[-1] if b.path else "")]
        if "©" in b.text[:40]:
            f.append("owner")
        if b.text.isupper():
            f.append("upper")
        f += ["in:" + t for t in set(b.path) if not (hide and t in ("article", "main"))]
        f += ["as:" + t for t in b.names if not (hide and t in ("article", "main", "content", "post", "entry", "body"))]
        out.append(f)
    return out


class Field:
    """Weights of the two-state field; state 1 is main text. The score of a labelling is linear in them."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.step: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self.move_step = [[1e-6, 1e-6], [1e-6, 1e-6]]

    def scores(self, page: list[list[str]]) -> list[float]:
        """For each block, how much state 1 is preferred to state 0."""
        get = self.weight.get
        return [sum(get(f, 0.0) for f in block) for block in page]

    def learn(self, page: list[list[str]], labels: list[int], rate: float = 0.3, decay: float = 1e-4) -> None:
        """One gradient step of the page's log-likelihood; each weight has its own step size (AdaGrad)."""
        s, n = self.scores(page), len(page)
        move = self.move
        add = lambda a, b: max(a, b) + log(1 + exp(-abs(a - b)))
        forward = [[0.0, s[0]]]
        for t in range(1, n):
            a = forward[-1]
            forward.append([add(a[0] + move[0][0], a[1] + move[1][0]), add(a[0] + move[0][1], a[1] + move[1][1]) + s[t]])
        backward = [[0.0, 0.0]] * n
        for t in range(n - 2, -1, -1):
            b = backward[t + 1]
            backward[t] = [add(move[k][0] + b[0], move[k][1] + s[t + 1] + b[1]) for k in (0, 1)]
        total = add(*forward[-1])
        for t in range(n):
            p = exp(min(0.0, forward[t][1] + backward[t][1] - total))
            for f in page[t]:
                w = self.weight.get(f, 0.0)
                g = labels[t] - p - decay * w
                self.step[f] = self.step.get(f, 1e-6) + g * g
                self.weight[f] = w + rate * g / self.step[f] ** 0.5
            if t + 1 < n:
                for j in (0, 1):
                    for k in (0, 1):
                        q = exp(min(0.0, forward[t][j] + move[j][k] + k * s[t + 1] + backward[t + 1][k] - total))
                        g = float(labels[t] == j and labels[t + 1] == k) - q - decay * move[j][k]
                        self.move_step[j][k] += g * g
                        move[j][k] += rate * g / self.move_step[j][k] ** 0.5

    def decode(self, page: list[list[str]]) -> list[int]:
        """The labelling of the highest score; ties go to the rest."""
        if not page:
            return []
        s, move = self.scores(page), self.move
        best, back = (0.0, s[0]), []
        for t in range(1, len(page)):
            to = []
            nxt = []
            for k in (0, 1):
                stay = best[1] + move[1][k] > best[0] + move[0][k]
                to.append(int(stay))
                nxt.append((best[1] + move[1][k] if stay else best[0] + move[0][k]) + k * s[t])
            back.append(to)
            best = tuple(nxt)
        state = int(best[1] > best[0])
        states = [state]
        for to in reversed(back):
            state = to[state]
            states.append(state)
        return states[::-1]


# --- labelled pages ----------------------------------------------------------------------------------------------

#: Names by which pages commonly call what is not main text.
_OTHER_NAMES = {
    "menu": "menu nav navbar navigation topnav mainmenu breadcrumb breadcrumbs toolbar tabs links".split(),
    "header": "header masthead banner topbar logo branding site-header page-header".split(),
    "footer": "footer bottom copyright colophon site-footer legal credits".split(),
    "sidebar": "sidebar aside related widget rail secondary recommended popular trending tags share social".split(),
    "notice": "notice cookie cookies consent alert gdpr banner modal popup overlay message subscribe paywall promo".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promoted banner-ad adsbygoogle promo".split(),
    "comments": "comments comment comment-list replies reply discussion disqus responses feedback reader-comments".split(),
    "form": "form search login signup newsletter contact subscribe".split(),
}
_MAIN_NAMES = "content main article post entry story text body article-body post-content entry-content main-content page-content".split()


def laid_out_page(draw: random.Random, sentences: list[str]) -> str:
    """A page in one of many layouts; data-label is 1 on main text and 0 elsewhere."""
    say = lambda k=1: " ".join(draw.choice(sentences) for _ in range(k))
    short = lambda: " ".join(draw.choice(sentences).split()[: draw.randint(1, 4)]) or "Home"

    def named(kind: str, tags: tuple[str, ...], inner: str) -> str:
        names = _OTHER_NAMES[kind]
        tag = draw.choice(tags)
        attribute = draw.choice(("class", "class", "id"))
        return f'<{tag} {attribute}="{draw.choice(names)}" data-label="0">{inner}</{tag}>'

    def bare(tag: str, inner: str) -> str:
        return f'<{tag} data-label="0">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>"

    def loose() -> str:
        return draw.choice((f"<p>{say()}</p>", say(), f"<p>{say(2)}</p>", f"<div>{say()}</div>", f"<span>{short()}</span>"))

    menu = draw.choice((bare("nav", links(draw.randint(3, 8))), named("menu", ("div", "ul", "nav"), links(draw.randint(3, 8))),
                        named("menu", ("div",), " | ".join(f'<a href="/y">{short()}</a>' for _ in range(5)))))
    header = draw.choice(("", bare("header", f"<h1>{short()}</h1>" + loose()), named("header", ("div", "header"), loose() + menu)))
    notice = draw.choice(("", "", named("notice", ("div", "section", "p"), loose() + "<button>OK</button>")))
    advert = lambda: draw.choice((named("advert", ("div", "aside", "section"), loose()), named("advert", ("div",), say())))
    side = draw.choice(("", bare("aside", f"<h3>{short()}</h3>" + draw.choice((links(4), loose()))),
                        named("sidebar", ("div", "section", "aside"), f"<h3>{short()}</h3>" + draw.choice((links(4), loose(), say(2))))))
    form = lambda: draw.choice(("", bare("form", f"<label>{short()}</label><input><button>{short()}</button><p>{say()}</p>"),
                                named("form", ("div", "section"), f"<p>{say()}</p><form><input><button>{short()}</button></form>")))
    comment = lambda: named("comments", ("div", "li", "article"), f"<b>{short()}</b><p>{say(draw.randint(1, 3))}</p>")
    comments = draw.choice(("", named("comments", ("div", "section", "ol"), f"<h3>{short()}</h3>" + "".join(
        draw.choice((comment(), f"<div><p>{say(2)}</p></div>", f"<p>{say()}</p>")) for _ in range(draw.randint(1, 4))))))
    footer = draw.choice((bare("footer", f"&copy; {short()} &middot; {say()}"), named("footer", ("div", "footer"), loose()),
                          bare("p", f"&copy; 2020 {short()}"), bare("footer", links(4) + loose())))

    def paragraph() -> str:
        k = draw.randint(1, 6)
        return draw.choice((f"<p>{say(k)}</p>", f"<p>{say(k)}</p>", f"<p>{say(k)}", f"<p><b>{say()}<br>", f"<p>{short()}</p>",
                            f'<p>{say()} <a href="/z">{short()}</a> {say(k)}</p>', f"<h2>{short()}</h2><p>{say(k)}</p>",
                            f"<ul><li>{say()}</li><li>{say()}</li></ul>",
                            f"<ol><li>{say()}</li><li>{say(2)}</li></ol>", f"<section><h2>{short()}</h2><p>{say(k)}</p><p>{say(k)}</p></section>",
                            f"<section><h3>{short()}</h3><p>{say(k)}</p></section>", f"<table><tr><td>{short()}</td><td>{say()}</td></tr></table>",
                            f"<pre>{say(2)}</pre>", f"<blockquote>{say(2)}</blockquote>", f"{say(k)}<br><br>", f"{say()}<br>", f"<div>{say(k)}</div>"))

    parts = [f"<h1>{short() if draw.random() < 0.5 else say()}</h1>"] if draw.random() < 0.8 else []
    alone = draw.random() < 0.1
    for _ in range(draw.randint(1, 2) if alone else draw.randint(1, 9)):
        parts.append(paragraph())
        if draw.random() < 0.12:
            parts.append(draw.choice((advert(), side, form())))
    inner = "".join(parts)
    inside = comments if draw.random() < 0.3 else ""
    if draw.random() < 0.15:
        inner = f"<section>{inner}</section>"
    wrap = draw.random()
    if wrap < 0.3:
        body = f'<article data-label="1">{inner}{inside}</article>'
    elif wrap < 0.45:
        body = f'<main data-label="1">{inner}{inside}</main>'
    elif wrap < 0.85:
        body = f'<div {draw.choice(("class", "id"))}="{draw.choice(_MAIN_NAMES)}" data-label="1">{inner}{inside}</div>'
    else:
        body = f'<div data-label="1">{inner}{inside}</div>'
    before, after = [header, menu if menu not in header else "", notice], [side, form(), "" if inside else comments]
    if draw.random() < 0.6:
        draw.choice((before, after)).append(advert())
    draw.shuffle(after)
    if draw.random() < 0.25:  # pages that are all or nearly all article
        before, footer = [], footer if draw.random() < 0.4 else ""
    if draw.random() < 0.25:
        after, footer = [], footer if draw.random() < 0.4 else ""
    if alone:
        before, after, footer = [], [], ""
    return f"<html><body>{''.join(before)}{body}{''.join(after)}{footer}</body></html>"


def _marked(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself, else None."""
    other = ("nav", "aside", "footer", "form", "button", "select")
    names = {n for kind in _OTHER_NAMES.values() for one in kind for n in _NAME.findall(one)} - {"banner", "message", "text", "body", "page", "site"}
    labels = [int(("article" in b.path or "main" in b.path) and not any(t in b.path for t in other) and not (b.names & names))
              for b in blocks]
    return labels if any(labels) else None


def train(pages: list[str], seed: int = SEED) -> Field:
    draw = random.Random(seed)
    parsed = [leaf_blocks(p) for p in pages]
    sentences = [s for blocks in parsed for b in blocks for s in re.findall(r"[^.!?]+[.!?]", b.text)[:3] if 10 < len(s) < 300][:3000]
    sentences = sentences or ["The way to the sea is long.", "It was a quiet day in the old town by the river.", "Read on."]
    examples = [(blocks, labels) for blocks in parsed if blocks and (labels := _marked(blocks))]
    for _ in range(LAID_OUT_PAGES):
        blocks = leaf_blocks(laid_out_page(draw, sentences))
        examples.append((blocks, [int(b.label == "1") for b in blocks]))
    field = Field()
    for _ in range(EPOCHS):
        draw.shuffle(examples)
        for blocks, labels in examples:
            field.learn(features(blocks, hide=draw.random() < 0.15), labels)
    return field


def main_text(field: Field, html: str | None) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, state in zip(blocks, field.decode(features(blocks))) if state)


def sample_pages(pages: DataFrame, page_id: str, html: str, n: int = SAMPLE_PAGES) -> list[str]:
    """n pages by the hash of their id, the training sample."""
    rows = pages.filter(F.col(html).isNotNull()).select(F.xxhash64(page_id).alias("h"), F.xxhash64(html).alias("t"), page_id)
    chosen = rows.orderBy("h", "t").limit(n).select(F.col(page_id).alias("_llm_id"))
    return [r[0] for r in pages.join(F.broadcast(chosen), pages[page_id].eqNullSafe(F.col("_llm_id"))).select(html)
            .filter(F.col(html).isNotNull()).limit(2 * n).collect()]


def extract(pages: DataFrame, keep: list[str], field: Field, html: str = "html") -> DataFrame:
    """The columns ``keep`` of every page with text and n_chars, its length in code points."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts = [main_text(field, h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=keep + ["text", "n_chars"])

    narrow = pages.select(*keep, F.col(html).alias("_llm_html"))
    schema = ", ".join([f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])
    return narrow.mapInArrow(run, schema)
