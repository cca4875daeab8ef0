"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

``html.parser`` cuts the page into tags and text; the builder closes what the page leaves open (p, li, dd,
td, tr, option and so on) and adds rows that cells need. Text, or a tag that a head cannot hold, ends an open head; a slash
closes elements of svg and math only, and a tag that these cannot hold ends them. Of a drawing its texts are shown. The renderer walks the tree without recursion, leaves out
what a browser does not show, and writes lines: blocks on lines of their own, a blank line around paragraphs,
headings, lists and tables, list marks with indent, preformatted text as it is, and table cells padded to their columns.

One page is one row, so pages are spread by Spark and nothing is shuffled. Defined cases: null or empty html gives the
empty text; unclosed, stray and deeply nested tags are accepted; repeated rows give the same text. Other columns
pass through; columns named ``text`` and ``n_words`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, word_count

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: never shown
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe object audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article main nav header footer aside address li dt dd figcaption legend summary details option "
    "optgroup tr td th caption thead tbody tfoot center text".split()
)
#: a head holds these; any other tag ends it
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
FOREIGN = frozenset(("svg", "math"))
#: HTML again within svg and math
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: these end an open svg or math
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
#: parts of a drawing that are not drawn themselves
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
#: an opening tag ends these open elements, looking up to the given borders
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
CLOSES_P = SPACED | frozenset("div section article main nav header footer aside address li dt dd details center".split())
BORDERS = frozenset(("table", "td", "th", "caption", "html"))
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*(none|hidden|collapse|visible)\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Builder(HTMLParser):
    """Builds the tree; ``open`` are the elements not yet closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.headed = False  # a head has been opened, or stands no more
        self.count: Counter[str] = Counter()  # of open elements, so that ends without a start cost nothing

    def _end(self, tags: frozenset | set, borders: frozenset | set) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i].tag in borders:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or (tag == "head" and self.headed):
            return
        self.headed = True
        foreign = self._foreign()
        if foreign and (tag in BREAKOUT or (tag == "font" and {"color", "face", "size"} & {k for k, _ in attrs})):
            while len(self.open) > foreign:
                self._pop()
            foreign = self._foreign()
        if foreign:
            node = Node(tag, {k: v or "" for k, v in attrs})
            if tag in UNDRAWN:
                node.attrs["hidden"] = ""
            self._push(node)
            return
        if tag in CLOSES_P:
            self._end({"p"}, BORDERS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _end_head(self) -> None:
        if self.open[-1].tag == "head":
            self._pop()

    def _foreign(self) -> int:
        """Place of the open svg or math that a new element belongs to, 0 if it is HTML."""
        if self.count["svg"] or self.count["math"]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in FOREIGN:
                    return i
                if self.open[i].tag in INTEGRATION:
                    return 0
        return 0

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def _pop(self) -> None:
        self.count[self.open.pop().tag] -= 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        # a slash closes void elements, and what belongs to svg and math
        if self.open[-1].tag == tag and (tag in FOREIGN or (tag not in BREAKOUT and self._within_foreign())):
            self._pop()

    def _undrawn(self) -> bool:
        """Whether text here is part of a drawing, but of no text element."""
        for node in reversed(self.open):
            if node.tag in ("text", "math") or node.tag in INTEGRATION:
                return False
            if node.tag == "svg":
                return True
        return False

    def _within_foreign(self) -> bool:
        last = self.open.pop()
        found = self._foreign() > 0
        self.open.append(last)
        return found

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._end_head()
            self.open[-1].children.append(Node("br"))
        elif tag not in VOID and tag != "html":
            self._end({tag}, BORDERS - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {tag})

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self.headed = True
            self._end_head()
        if self.count["svg"] and self._undrawn():
            return
        self.open[-1].children.append(data)


class Lines:
    """Collapses inline blanks and collects lines; remembers how many line ends are due."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.gap = False  # a blank is due before the next word
        self.blank = False  # an empty line is due before the next line

    def text(self, data: str) -> None:
        words = _BLANKS.split(data)
        for i, word in enumerate(words):
            self.gap = self.gap or i > 0
            if word:
                if self.gap and self.current:
                    self.current.append(" ")
                self.current.append(word)
                self.gap = False

    def raw(self, data: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline(True)
            if line:
                self.current.append(line)

    def newline(self, force: bool = False) -> None:
        line = "".join(self.current).rstrip()
        if line or force:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.lines.append(line)
            self.blank = False
        self.current, self.gap = [], False

    def space(self) -> None:
        self.newline()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        self.newline()
        for line in lines:
            if line or not self.blank:
                self.current = [line]
                self.newline(True)

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def hidden(node: Node, before: bool) -> tuple[bool, bool]:
    """(leave the whole element out, its text is invisible); ``before`` is the parent's second answer."""
    attrs = node.attrs
    if node.tag in UNSEEN or "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return True, before
    if node.tag == "input":
        return True, before
    for name, value in _HIDING.findall(attrs.get("style", "")):
        if name.lower() == "display":
            if value.lower() == "none":
                return True, before
        else:
            before = value.lower() != "visible"
    return False, before


def columns(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells (lists of lines) as aligned lines."""
    count = max((len(r) for r in rows), default=0)
    widths = [max((len(line) for r in rows if k < len(r) for line in r[k]), default=0) for k in range(count)]
    lines = []
    for r in rows:
        for n in range(max((len(c) for c in r), default=0)):
            cells = [(r[k][n] if k < len(r) and n < len(r[k]) else "").ljust(widths[k]) for k in range(count)]
            lines.append("  ".join(cells).rstrip())
    return lines


def render(root: Node) -> str:
    out = [Lines()]
    lists: list[list] = []  # [ordered, next number] of the open lists
    tables: list[list] = []  # rows of the open tables
    stack: list = [("open", root, False, False)]
    while stack:
        what, node, invisible, pre = stack.pop()
        if what == "close":
            tag, target = node.tag, out[-1]
            if tag in ("td", "th") and tables:
                cell = out.pop().done()
                if not tables[-1]:
                    tables[-1].append([])
                span = node.attrs.get("colspan", "1")
                tables[-1][-1] += [cell] + [[]] * (min(int(span), 1000) - 1 if span.isascii() and span.isdigit() and span != "0" else 0)
            elif tag == "table":
                rows = tables.pop()
                out[-1].add(columns(rows))
                out[-1].space()
            elif tag == "li":
                lines = out.pop().done()
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out[-1].add([(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)])
            else:
                if tag in ("ul", "ol"):
                    lists.pop()
                if tag in SPACED:
                    target.space()
                elif tag in BLOCK:
                    target.newline()
            continue
        if isinstance(node, str):
            if not invisible:
                (out[-1].raw if pre else out[-1].text)(node)
            elif not pre:
                out[-1].gap = True
            continue
        skip, invisible = hidden(node, invisible)
        if skip:
            continue
        tag = node.tag
        if tag == "br":
            out[-1].newline(True)
            continue
        if tag == "wbr":
            continue
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            out[-1].space()
        elif tag in BLOCK:
            out[-1].newline()
        if tag in ("ul", "ol"):
            start = node.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1])
        elif tag == "li" or (tag in ("td", "th") and tables):
            out.append(Lines())
        elif tag == "table":
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        stack.append(("close", node, invisible, pre))
        inner = pre or tag in ("pre", "textarea")
        stack += [("open", child, invisible, inner) for child in reversed(node.children)]
    return "\n".join(out[0].done())


def text_of(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the visible text of column ``html``, and its ``n_words``."""

    @F.pandas_udf("string")
    def visible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(text_of, na_action=None)

    names = [c for c in pages.columns if c not in ("text", "n_words")]
    shown = pages.select(*[F.col(f"`{c}`") for c in names], visible(F.col(f"`{html}`")).alias("text"))
    return shown.withColumn("n_words", word_count(F.col("text")))


def op1_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The visible text of every page."""
    return extract(read(spark, sf, "pages").select("page_id", "html")).select("page_id", "text", "n_words")
