"""HTML to flat text blocks with the features that the block classifier reads."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""",
    re.DOTALL)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"[a-z]+")
# Element names of HTML and usual words in class, id and role attributes.
RAW = frozenset("script style title textarea noscript template iframe svg math object select datalist canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
 figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table
 tbody td tfoot th thead tr ul caption button label""".split())
OPEN_ENDED = frozenset("p li dd dt tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6".split())
CHROME_TAGS = frozenset("nav aside footer menu dialog button".split())
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar
 navigation menu breadcrumb breadcrumbs sidebar aside widget footer foot copyright legal cookie cookies consent gdpr notice
 notices alert popup modal overlay dialog newsletter subscribe subscription signup login register share sharing social follow
 related recommended recommendations trending popular comment comments reply replies respond discussion disqus pagination
 pager toolbar skip masthead topbar search contentinfo complementary""".split())
SOFT_WORDS = frozenset("header head form".split())
WITHOUT = frozenset("has with no without".split())  # "has-sidebar" says something about the page, not of this element
MAIN_WORDS = frozenset("article content main post entry story body text prose".split())


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    hard: bool
    soft: bool
    main: bool
    weak: bool
    heading: bool
    item: bool


def _kind(tag: str, attrs: str) -> str:
    """What an element says about its inside: 'hard' (page furniture), 'soft' (furniture unless the
    article is inside), 'main', 'weak' (a hint of the article) or ''."""
    words: set[str] = set()
    if attrs and tag not in ("html", "body"):
        low = attrs.lower()
        for name, a, b, c in ATTR.findall(low):
            if name in ("class", "id", "role"):
                words.update(TOKEN.findall(a or b or c))
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*.?true|display\s*:\s*none", low):
            return "hard"
    if tag in CHROME_TAGS:
        return "hard"
    if words & WITHOUT:
        words = set()
    if words & CHROME_WORDS:
        return "hard"
    if tag in ("header", "form") or words & SOFT_WORDS:
        return "soft"
    if tag in ("article", "main"):
        return "main"
    return "weak" if words & MAIN_WORDS else ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; white space collapsed, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements: tag, kind
    text: list[str] = []
    links, in_link, heading, at, low = 0, 0, "", 0, None

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                kinds = [k for _, k in stack]
                inner = max((i for i, k in enumerate(kinds) if k == "main"), default=-1)
                out.append(Block(joined, joined.count(" ") + 1, links, "hard" in kinds,
                                 "soft" in kinds[inner + 1:], inner >= 0, "weak" in kinds, bool(heading),
                                 any(t == "li" for t, _ in stack)))
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if in_link:
                links += len(piece.split())

    pos, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            break
        add(page[pos:m.start()])
        pos = at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            add(" ")
        elif tag in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                low = low if low is not None else page.lower() if len(page.lower()) == n else page
                end = low.find(f"</{tag}", at)
                if end < 0:
                    pos = at = n
                else:
                    close = page.find(">", end)
                    pos = at = n if close < 0 else close + 1
            add(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK or closing or tag not in VOID:
            block = tag in BLOCK
            if block:
                flush()
                in_link = 0
            if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = "" if closing else tag
            elif block:
                heading = ""
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif block and tag not in VOID and not m[3].endswith("/"):
                if tag in OPEN_ENDED and stack and stack[-1][0] == tag:
                    stack.pop()
                if tag != "p":  # a paragraph holds no blocks
                    stack.append((tag, _kind(tag, m[3])))
                elif m[3] and _kind(tag, m[3]) == "hard":
                    stack.append((tag, "hard"))
    add(page[pos:] if pos < n else "")
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture",
            "soft", "main", "weak", "heading", "item", "page_has_main")


def features(bs: list[Block]) -> list[list[float]]:
    """One row of ``FEATURES`` per block: its own and its neighbours' word count and link density,
    and where it stands."""
    own = [(float(min(b.words, 200)), min(1.0, b.link_words / b.words)) for b in bs]
    any_main = float(any(b.main and not b.hard for b in bs))
    out = []
    for i, b in enumerate(bs):
        before = own[i - 1] if i else (0.0, 0.0)
        after = own[i + 1] if i + 1 < len(bs) else (0.0, 0.0)
        out.append([*own[i], *before, *after, float(b.hard), float(b.soft), float(b.main), float(b.weak),
                    float(b.heading), float(b.item), any_main])
    return out
