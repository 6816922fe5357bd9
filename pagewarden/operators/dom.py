"""Parses a page into its elements, and the JSON-LD in it.

A tokenizer of one pattern and a tree builder for a subset of the HTML standard: void elements, raw text (noscript
too, as with scripts on), text with character references only (title, textarea), implied html, head and body, implied
ends of p, li, dt, dd, option, tr, td, th, a and button; unmatched end tags are ignored and noted. Any text is a page:
what is no tag is text, what is cut short is left out. Every element costs the same, however deep it lies.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link script style base noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "a": {"a"}, "button": {"button"}}
_P = {"p"}
FENCES = frozenset("table ul ol dl select td th body html button object".split())
#: Elements that end without an end tag where another one ends.
IMPLIED = frozenset("p li dt dd option optgroup tr td th tbody thead tfoot".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
TEXT_ONLY = frozenset("title textarea".split())
SECTIONS = frozenset("article aside main nav section".split())

_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+))"""
_ATTRIBUTE = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+{_VALUE})?+")
_INSIDE = _ATTRIBUTE.pattern.replace("([", "(?:[").replace("((", "(?:(")
#: A comment, a tag (slash, name, attributes, its end unless the page ends before) or what else is no text.
_TOKEN = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[\s/=]++|{_INSIDE})*+)(>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAME = r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*+)"
_REFERENCE = re.compile(rf"{_NAME};|{_NAME}(?![;=A-Za-z0-9])")


class Node:
    """An element: its number, the number after its last descendant, tag, attributes and what is around it."""

    __slots__ = ("attrs", "end", "first", "head", "i", "label", "last", "section", "tag")

    def __init__(self, i: int, tag: str, attrs: dict[str, str]):
        self.i, self.tag, self.attrs = i, tag, attrs
        self.end = i + 1

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def low(self, name: str) -> str:
        """An attribute in lower case, empty if there is none."""
        return (self.attrs.get(name) or "").lower()


def attributes(raw: str) -> tuple[dict[str, str], list[str]]:
    """(attributes, names given again)."""
    own: dict[str, str] = {}
    again = []
    for name, double, single, plain in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), double or single or plain
        if name in own:
            again.append(name)
        else:
            own[name] = _REFERENCE.sub(lambda m: _html.unescape(m[0]), value) if "&" in value else value
    return own, again


class Tree:
    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.depth: Counter = Counter()  # open elements of each tag
        self.chunks: list[str] = []
        self.errors: list[str] = []
        self.body = self.headed = False
        self.sections = 0  # open ones
        self._push("html", {})
        at = 0
        while at < len(page):
            found = _TOKEN.search(page, at)
            self._text(page[at : found.start()] if found else page[at:])
            if not found:
                break
            at = found.end()
            if found[2] and found[4]:
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                else:
                    self._start(tag, found[3])
                    if tag in RAW or tag in TEXT_ONLY:
                        at = self._raw(page, at, tag)
        if not self.body:
            self._place("body")
            self._push("body", {})
        while self.open:
            self._pop()

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(len(self.nodes), tag, attrs)
        node.head, node.label, node.section = self.depth["head"] > 0, self.depth["label"] > 0, self.sections > 0
        node.first = node.last = len(self.chunks)
        self.nodes.append(node)
        self.open.append(node)
        self.depth[tag] += 1
        self.sections += tag in SECTIONS

    def _pop(self) -> None:
        node = self.open.pop()
        node.end, node.last = len(self.nodes), len(self.chunks)
        self.depth[node.tag] -= 1
        self.sections -= node.tag in SECTIONS

    def _place(self, tag: str) -> None:
        """Opens head or body where the document leaves them out."""
        if self.body:
            return
        if tag in HEAD:
            if not self.headed:
                self.headed = True
                self._push("head", {})
        else:
            while len(self.open) > 1:
                self._pop()
            if not self.headed:
                self.headed = True
                self._push("head", {})
                self._pop()
            self.body = True
            if tag != "body":
                self._push("body", {})

    def _start(self, tag: str, raw: str) -> None:
        attrs, again = attributes(raw)
        self.errors += [f"Duplicate attribute '{x}'" for x in again]
        if tag in ("html", "head", "body"):
            at = self.nodes[0] if tag == "html" else None
            if tag == "head" and not self.headed and not self.body:
                self.headed = True
                self._push("head", attrs)
                return
            if tag == "body" and not self.body:
                self._place("body")
                self._push("body", attrs)
                return
            if tag == "body":
                at = next((n for n in self.nodes if n.tag == "body"), None)
            if at is not None:  # a second tag adds what attributes are new
                for k, v in attrs.items():
                    at.attrs.setdefault(k, v)
            return
        if not self.body and (len(self.open) == 1 or (tag not in HEAD and self.open[-1].tag == "head")):
            self._place(tag)
        self._imply(tag)
        self._push(tag, attrs)
        if tag in VOID:
            self._pop()

    def _imply(self, tag: str) -> None:
        closing = CLOSED_BY.get(tag) or (_P if tag in CLOSES_P else None)
        if closing is None or not any(self.depth[x] for x in closing):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth].tag
            if name in closing:
                while len(self.open) > depth:
                    self._pop()
                if tag == "tr":
                    self._imply(tag)
                return
            if name in FENCES and not (tag == "tr" and name in ("td", "th")):
                return

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if not self.depth[tag]:
            if tag not in VOID:
                self.errors.append(f"Stray end tag '{tag}'")
            return
        depth = len(self.open) - 1
        while self.open[depth].tag != tag and self.open[depth].tag in IMPLIED:
            depth -= 1
        if self.open[depth].tag != tag:
            self.errors.append(f"End tag '{tag}' seen, but there were open elements")
        while self.open[-1].tag != tag:
            self._pop()
        self._pop()

    def _raw(self, page: str, at: int, tag: str) -> int:
        """The text up to the element's end tag; the place behind it."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            self.chunks.append(_html.unescape(text) if tag in TEXT_ONLY and "&" in text else text)
        while self.open[-1].tag != tag:
            self._pop()
        self._pop()
        return found.end() if found else len(page)

    def _text(self, text: str) -> None:
        if not text:
            return
        if not self.body and self.open[-1].tag in ("html", "head"):
            if not text.strip():
                self.chunks.append(text)
                return
            self._place("#text")
        self.chunks.append(_html.unescape(text) if "&" in text else text)


def parse(page: str | None) -> Tree:
    """The tree of a page; a null page is an empty one. Every page has html, head and body."""
    return Tree(page or "")


#: Properties that a type must have (fixed values).
REQUIRED = {"Article": ["headline"], "NewsArticle": ["headline"], "BlogPosting": ["headline"], "BreadcrumbList": ["itemListElement"], "Organization": ["name"], "LocalBusiness": ["name"], "Person": ["name"], "Product": ["name"], "WebSite": ["name", "url"], "FAQPage": ["mainEntity"]}
ARTICLES = ("Article", "NewsArticle", "BlogPosting")


def _items(value: object) -> list[dict]:
    graph = value.get("@graph") if isinstance(value, dict) else None
    if isinstance(graph, list):
        return [x for x in graph if isinstance(x, dict)]
    return [value] if isinstance(value, dict) else []


def _type(entity: dict) -> str | None:
    kind = entity.get("@type")
    if isinstance(kind, list):
        kind = next((x for x in kind if isinstance(x, str)), None)
    return kind if isinstance(kind, str) else None


def _nodes(value: object) -> Iterator[dict]:
    """Objects of a block in order: itself or its items, and whatever lies in @graph; of any depth."""
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, list):
            waiting += reversed(x)
        elif isinstance(x, dict):
            yield x
            waiting.append(x.get("@graph"))


def _all_types(value: object) -> list[str]:
    kinds = (x.get("@type") for x in _nodes(value))
    return [t for kind in kinds for t in (kind if isinstance(kind, list) else [kind]) if isinstance(t, str)]


def _entities(value: object) -> list[dict]:
    text = lambda x, k: x[k] if isinstance(x.get(k), str) else None
    return [{"id": text(x, "@id") or text(x, "url"), "type": _type(x), "name": text(x, "name"), "url": text(x, "url")} for x in _nodes(value) if text(x, "@id") or text(x, "url")]


def _author(value: object) -> bool:
    graph = value.get("@graph") if isinstance(value, dict) else None
    among = [x for x in graph if isinstance(x, dict)] if isinstance(graph, list) else [value] if isinstance(value, dict) else []
    return any(k in x for x in among for k in ("author", "publisher", "creator"))


def linked_data(blocks: list[str]) -> tuple[list[tuple], list[str], bool, list[dict]]:
    """(findings, types, whether an author is named, entities) of a page's JSON-LD blocks."""
    found, types, author, entities, seen = [], [], False, [], []

    def no_constant(name: str) -> None:
        raise ValueError(name)

    for n, raw in enumerate(blocks, 1):
        where = f"script[type='application/ld+json']:nth({n})"
        say = lambda level, rule, message: found.append((level, f"structured-data/{rule}", where, message))  # noqa: B023, E731
        if not raw.strip():
            say("error", "empty", "JSON-LD block is empty")
            continue
        try:
            value = json.loads(raw, parse_constant=no_constant)
        except (ValueError, RecursionError) as e:
            say("error", "invalid-json", f"Invalid JSON in JSON-LD block: {e}")
            continue
        types += _all_types(value)
        author |= _author(value)
        entities += _entities(value)
        seen.append((n, [t for e in _items(value) if (t := _type(e))]))
        root = value if isinstance(value, dict) else {}
        if "@context" not in root and "@graph" not in root:
            say("warning", "missing-context", "JSON-LD block has no @context")
        elif isinstance(root.get("@context"), str) and "schema.org" not in root["@context"]:
            say("warning", "unusual-context", f"Unusual @context: {root['@context']}")
        for e in _items(value):
            kind = _type(e)
            if e and "@type" not in e:
                say("warning", "missing-type", "JSON-LD entity has no @type")
            for k in REQUIRED.get(kind, []):
                if k not in e:
                    say("warning", "missing-property", f"{kind} lacks the property '{k}'")
            if kind in ARTICLES:
                for k, level, rule in (("author", "warning", "author"), ("datePublished", "warning", "date-published"), ("dateModified", "info", "date-modified"), ("image", "warning", "image")):
                    if k not in e:
                        say(level, f"article-missing-{rule}", f"{kind} lacks '{k}'")
            if kind == "NewsArticle" and "publisher" not in e:
                say("error", "news-article-missing-publisher", "NewsArticle lacks 'publisher'")
            if kind in ("Organization", "LocalBusiness") and "url" not in e:
                say("warning", "organization-missing-url", f"{kind} lacks 'url'")
            if kind == "LocalBusiness":
                for k in ("telephone", "address"):
                    if k not in e:
                        say("info", f"local-business-missing-{k}", f"LocalBusiness lacks '{k}'")
            if kind == "FAQPage" and "mainEntity" in e:
                asked = e["mainEntity"] if isinstance(e["mainEntity"], list) else [e["mainEntity"]]
                if any(not isinstance(q, dict) or "acceptedAnswer" not in q for q in asked):
                    say("error", "faq-missing-answer", "A question of FAQPage lacks 'acceptedAnswer'")
            if kind == "WebSite" and "potentialAction" not in e:
                say("info", "website-missing-search-action", "WebSite lacks 'potentialAction'")
            if kind == "BreadcrumbList" and isinstance(e.get("itemListElement"), list):
                for i, item in enumerate(e["itemListElement"]):
                    item = item if isinstance(item, dict) else {}
                    if "position" not in item:
                        say("error", "breadcrumb-missing-position", f"Breadcrumb item {i} lacks 'position'")
                    inner = item.get("item") if isinstance(item.get("item"), dict) else {}
                    if not any(isinstance(x, str) and x for x in (inner.get("name"), item.get("name"))):
                        say("error", "breadcrumb-missing-name", f"Breadcrumb item {i} lacks a name")
    if len(seen) >= 2:
        where: dict[str, list[int]] = {}
        for n, kinds in seen:
            for t in kinds:
                where.setdefault(t, []).append(n)
        for t, at in sorted(where.items()):
            if len(at) > 1:
                found.append(("warning", "structured-data/duplicate-type", ", ".join(f"script[type='application/ld+json']:nth({n})" for n in at), f"Type '{t}' is declared {len(at)} times"))
    return found, types, author, entities
