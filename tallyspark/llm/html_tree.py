"""A small forgiving HTML reader: events of a page in order, with a hash for each element's subtree."""

from __future__ import annotations

import html
import re

import xxhash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("table ul ol dl article section main body div td".split())

# What isn't the article's text, by element, role, and word of a class or id.
NOT_TEXT = frozenset("nav header footer aside form script style noscript template iframe svg canvas button select input textarea dialog menu head title object audio video".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that a name of those may hold besides; with any other word (share-price) it says nothing.
LAYOUT_WORDS = frozenset("area bar block bottom box button buttons container content global holder inner left link links list main module outer page panel primary right row section secondary site top unit wrap wrapper".split())
INLINE = frozenset("br b i em strong a span code sub sup q cite u s small mark abbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PROSE = INLINE | PARAGRAPHS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    """An element. above: the enclosing elements that matter here, of article, main and an article's header."""

    __slots__ = ("tag", "attrs", "hash", "parts", "above", "prose")

    def __init__(self, tag: str, attrs: dict[str, str], above: frozenset[str] = frozenset()):
        self.tag, self.attrs, self.hash, self.parts, self.above, self.prose = tag, attrs, 0, [], above, False

    def kind(self) -> str:
        """article, main, header (an article's own), heading or nothing: what it is to the elements in it."""
        if self.tag == "main" or self.attrs.get("role", "").lower() == "main":
            return "main"
        if self.tag == "header" and "article" in self.above:
            return "header"
        return "heading" if self.tag in HEADINGS else self.tag if self.tag == "article" else ""

    def is_text(self) -> bool:
        """Whether element, role, class and id allow it to be part of an article.

        Of an article's own header the headings count. Names say nothing of inline elements, nor of an article's paragraphs.
        """
        a = self.attrs
        if (self.tag in NOT_TEXT and self.kind() != "header") or a.get("role", "").lower() in NOT_ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower():
            return False
        if self.tag in INLINE or self.tag in ("html", "body", "article", "main") or (self.tag in PARAGRAPHS and self.above & {"article", "main"}):
            return True
        return self.kind() == "header" or not any(map(_names_other, f"{a.get('class', '')} {a.get('id', '')}".split()))


def _names_other(name: str) -> bool:
    """Whether a class or id names something that isn't the article: words for such things, and no other but layout words."""
    words = _WORD.findall(_CAMEL.sub("-", name).lower())
    return not NOT_WORDS.isdisjoint(words) and all(w in NOT_WORDS or w in LAYOUT_WORDS for w in words)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2].strip("\"'")) if m[2] else "" for m in _ATTR.finditer(raw)} if raw.strip() else {}


def read(page: str) -> list[tuple[str, object]]:
    """("text", str), ("open", Node) and ("close", Node) in page order; every opened node is closed. Nodes have their subtree's hash."""
    events: list[tuple[str, object]] = []
    stack: list[Node] = [Node("", {})]
    open_tags: dict[str, int] = {}

    def text(s: str) -> None:
        if s:
            events.append(("text", s))
            if s := " ".join(s.split()):
                stack[-1].parts.append(s)

    def close() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        label = f"{node.tag}\x00{node.attrs.get('class', '')}\x00{node.attrs.get('id', '')}\x00"
        node.prose = node.prose or (node.tag in PARAGRAPHS and bool(node.parts))
        stack[-1].prose = stack[-1].prose or node.prose
        # The lowest bit tells of elements that hold paragraphs.
        node.hash = ((xxhash.xxh64_intdigest(label + "\x01".join(node.parts)) - 2**63) & ~1) | (node.prose and node.tag not in PROSE)
        stack[-1].parts.append(f"\x02{node.hash}")
        events.append(("close", node))

    def close_through(tags: tuple[str, ...], fences: frozenset[str] = frozenset()) -> None:
        if not any(open_tags.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in fences:
                return

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            close_through((name,))
            continue
        if name in ENDS_P:
            close_through(("p",), FENCES)
        if name in SIBLINGS:
            close_through(SIBLINGS[name], FENCES - frozenset(SIBLINGS[name]))
        kind = stack[-1].kind()
        node = Node(name, _attributes(m[3] or m[6] or ""), stack[-1].above | {kind} if kind else stack[-1].above)
        stack.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
        events.append(("open", node))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            stack[-1].parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            close()
        elif name in VOID:
            close()
    text(page[at:])
    while len(stack) > 1:
        close()
    return events


ROOTS = ("html", "body", "article", "main")


def subtrees(events: list[tuple[str, object]]) -> set[int]:
    """Hashes of the elements that may be template, those with text."""
    return {n.hash for kind, n in events if kind == "close" and n.tag not in ROOTS and n.parts}


class _Reader:
    """What is left of a page's events once elements that aren't text, and those of a template, are cut out."""

    def __init__(self, events: list[tuple[str, object]], gone):
        self.events = []
        skip = 0
        for kind, n in events:
            if kind in ("open", "close") and (skip or (kind == "open" and gone(n))):
                skip += 1 if kind == "open" else -1
                # A cut block still ends the block before.
                if not skip and n.tag in BLOCKS:
                    self.events.append(("cut", n))
            elif not skip:
                self.events.append((kind, n))

    def __bool__(self) -> bool:
        return any(kind == "text" and x.strip() for kind, x in self.events)

    def inside(self, wanted) -> list[tuple[str, object]]:
        """The events inside the outermost wanted elements."""
        kept, within = [], 0
        for kind, n in self.events:
            hit = kind in ("open", "close") and wanted(n)
            if hit and kind == "open":
                within += 1
            if within:
                kept.append((kind, n))
            if hit and kind == "close":
                within -= 1
        return kept

    def blocks(self) -> list[str]:
        out: list[str] = []
        block: list[str] = []

        def end() -> None:
            if words := html.unescape("".join(block)).split():
                out.append(" ".join(words))
            block.clear()

        for kind, n in self.events:
            if kind == "text":
                block.append(n)
            elif n.tag in BLOCKS or n.tag in ("article", "main"):
                end()
            elif n.tag == "br" and kind == "open":
                block.append(" ")
        end()
        return out


def _in_header(n: Node) -> bool:
    """Whether an article's header holds it outside a heading."""
    return "header" in n.above and "heading" not in n.above and n.kind() != "heading"


def _without_bylines(events: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """Text of an article's header that no heading holds goes."""
    out, stack = [], []
    for kind, n in events:
        if kind == "open":
            stack.append(n)
        elif kind == "close" and stack:
            stack.pop()
        if kind == "text" and stack and (stack[-1].kind() == "header" or _in_header(stack[-1])):
            continue
        out.append((kind, n))
    return out


def fingerprint(events: list[tuple[str, object]]) -> int:
    """A hash of a page's paragraphs, without what isn't an article's text: equal for copies of one article."""
    out, depth = [], 0
    for kind, n in _Reader(events, lambda n: not n.is_text()).events:
        if kind == "text" and depth:
            out.append(n)
        elif kind in ("open", "close") and n.tag in PARAGRAPHS:
            depth += 1 if kind == "open" else -1
    return xxhash.xxh64_intdigest(" ".join("".join(out).split())) - 2**63


def _own_prose(events: list[tuple[str, object]]) -> bool:
    """Whether paragraphs with text stand outside articles."""
    stack: list[Node] = []
    for kind, n in events:
        if kind == "open":
            stack.append(n)
        elif kind == "close" and stack:
            stack.pop()
        elif kind == "text" and n.strip() and any(x.tag in PARAGRAPHS for x in stack) and not any(x.tag == "article" for x in stack):
            return True
    return False


def main_text(events: list[tuple[str, object]], template: frozenset[int], steady: frozenset[int] = frozenset()) -> str:
    """The article's blocks, one a line: of main where it has prose besides its articles, else of the articles, else of main, else of all, without the template's elements. Prose goes only where it stands on the site's pages steadily."""

    def recurs(n: Node) -> bool:
        return n.tag not in ROOTS and n.hash in (steady if n.tag in PROSE else template)

    whole = _Reader(events, lambda n: not n.is_text())
    left = _Reader(whole.events, recurs)
    # Nothing left: the page itself is printed many times.
    left = left or whole
    left.events = _without_bylines(left.events) or left.events
    main, articles = left.inside(lambda n: n.kind() == "main"), left.inside(lambda n: n.tag == "article")
    for scope in ([main] if _own_prose(main) else []) + [articles, main]:
        if any(kind == "text" and x.strip() for kind, x in scope):
            left.events = scope
            break
    return "\n".join(left.blocks())
