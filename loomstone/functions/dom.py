"""A small HTML tree and selectors for it, on the standard library's tokenizer.

Selectors: tag, .class, #id, [attr], [attr="value"], compounds of them, descendant
(space), child (>) and general sibling (~), and at the end ::text or ::attr(name).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that opens ends these that are still open.
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = frozenset({"ul", "ol", "table", "div", "article", "section", "body", "dl", "select"})
_ENDS = {t: frozenset(ENDS.get(t, set()) | ({"p"} if t in BLOCKS else set())) for t in {*ENDS, *BLOCKS}}
#: Elements whose content some versions of the tokenizer read in a way of its own.
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
#: Text, and a tag that needs none of the tokenizer's tolerance: a name, and attributes in quotes, each after one space.
_TOKEN = re.compile(r"""([^<]*)(?:<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z_][a-zA-Z0-9_:-]*=(?:"[^"]*"|'[^']*'))*))>)?""")
_ATTR = re.compile(r""" ([a-zA-Z_][a-zA-Z0-9_:-]*)=(?:"([^"]*)"|'([^']*)')""")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "index", "at", "by")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.index = len(parent.kids) if parent else 0
        #: Place in document order; the root has all nodes by tag, class and id, in that order.
        self.at, self.by = 0, None

    def walk(self):
        """All nodes below in document order, to any depth."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            yield n
            if n.kids:
                todo += [k for k in reversed(n.kids) if isinstance(k, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.root.by = self.by = {"": []}

    def goahead(self, end):
        """Plain tags and the text between them up to the first other thing, without the tokenizer; it gives the same nodes."""
        html, i, n = self.rawdata, 0, len(self.rawdata)
        token, attributes = _TOKEN.match, _ATTR.findall
        while i < n and not self.cdata_elem:
            m = token(html, i)
            words, end_tag, tag, rest = m.groups()
            if words:
                self.handle_data(unescape(words) if "&" in words else words)
            if end_tag:
                self.handle_endtag(end_tag.lower())
            elif tag and (tag := tag.lower()) not in RAW:
                attrs: dict[str, str] = {}
                if rest:
                    for name, double, single in attributes(rest):
                        value = double or single
                        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
                self.opened(tag, attrs)
            else:
                i += len(words)
                break
            i = m.end()
        self.rawdata = html[i:]
        super().goahead(end)

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def handle_starttag(self, tag, attrs):
        self.opened(tag, {k: v or "" for k, v in reversed(attrs)})

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        ends, at = _ENDS.get(tag), self.open
        while ends and at is not self.root and at.tag not in HOLDS:
            if at.tag in ends:
                self.open = at.parent
            at = at.parent
        node = Node(tag, attrs, self.open)
        self.open.kids.append(node)
        # What opens later comes later in the document, as it goes to the end of an open element.
        by = self.by
        by[""].append(node)
        node.at = len(by[""])
        by.setdefault(tag, []).append(node)
        if attrs:
            if "class" in attrs:
                for c in {*attrs["class"].split()}:
                    by.setdefault("." + c, []).append(node)
            if "id" in attrs:
                by.setdefault("#" + attrs["id"], []).append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.open
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is not self.root:
            self.open = at.parent

    def handle_data(self, data):
        kids = self.open.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


_PART = re.compile(r"\s*([>~])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]|::text|::attr\(([\w:-]+)\)")


@lru_cache(maxsize=256)
def compiled(selector: str):
    """(steps, what): steps are (relation, tests); what is None, 'text' or an attribute name."""
    steps, tests, rel, what, at = [], [], " ", None, 0
    selector = selector.strip()
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m or what:
            raise ValueError(f"unsupported selector: {selector}")
        at = m.end()
        if m[1] or m[2]:
            steps.append((rel, tests))
            rel, tests = m[1] or " ", []
        elif m[3]:
            tests.append(("tag", m[3].lower(), None))
        elif m[4]:
            tests.append(("class", m[4], None))
        elif m[5]:
            tests.append(("attr", "id", m[5]))
        elif m[6]:
            tests.append(("attr", m[6].lower(), m[7]))
        else:
            what = ("attr", m[8].lower()) if m[8] else ("text", "")
    steps.append((rel, tests))
    return steps, what


def _fits(n: Node, tests) -> bool:
    for kind, a, b in tests:
        if kind == "tag" and a != "*" and n.tag != a:
            return False
        if kind == "class" and a not in n.attrs.get("class", "").split():
            return False
        if kind == "attr" and (a not in n.attrs or b is not None and n.attrs[a] != b):
            return False
    return True


def _matches(n: Node, steps, k: int, top: Node) -> bool:
    if not _fits(n, steps[k][1]):
        return False
    if k == 0:
        return True
    rel = steps[k][0]
    if rel == "~":
        return any(isinstance(s, Node) and _matches(s, steps, k - 1, top) for s in n.parent.kids[: n.index])
    up = n.parent
    while up is not None and up is not top.parent and up.tag:
        if _matches(up, steps, k - 1, top):
            return True
        if rel == ">":
            return False
        up = up.parent
    return False


class Below:
    """The nodes below one, found by tag, class or id for any number of selectors."""

    __slots__ = ("top", "by", "end")

    def __init__(self, top: Node):
        self.top = root = last = top
        while root.parent is not None:
            root = root.parent
        self.by = root.by
        while inner := next((k for k in reversed(last.kids) if isinstance(k, Node)), None):
            last = inner
        self.end = last.at

    def nodes(self, selector: str) -> list[Node]:
        steps, _ = compiled(selector)
        last = steps[-1][1]
        key = min((k for k in map(_key, last) if k), default="")  # ids before classes before tags
        some = self.by.get(key, [])
        if some and self.top.parent is not None:
            some = some[bisect_right(some, self.top.at, key=_at) : bisect_right(some, self.end, key=_at)]
        if len(steps) == 1 and len(last) == 1 and key:
            return list(some)
        return [n for n in some if _matches(n, steps, len(steps) - 1, self.top)]

    def select(self, selector: str) -> list[str]:
        _, what = compiled(selector)
        out: list[str] = []
        for n in self.nodes(selector):
            if what is None:
                out.append(text(n))
            elif what[0] == "text":
                out += [k for k in n.kids if isinstance(k, str)]
            elif what[1] in n.attrs:
                out.append(n.attrs[what[1]])
        return out


_at = attrgetter("at")


def _key(test: tuple) -> str:
    kind, a, b = test
    if kind == "tag":
        return "" if a == "*" else a
    if kind == "class":
        return "." + a
    return "#" + b if a == "id" and b is not None else ""


def nodes(top: Node, selector: str) -> list[Node]:
    return Below(top).nodes(selector)


def select(top: Node, selector: str) -> list[str]:
    """Texts or attribute values in document order; without ::text or ::attr, the text of whole elements."""
    return Below(top).select(selector)


def text(n: Node) -> str:
    out, todo = [], [n]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        else:
            todo += reversed(k.kids)
    return "".join(out)
