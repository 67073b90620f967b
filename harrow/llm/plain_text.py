"""Markup residue: texts with HTML, XML, entities, Markdown, wiki or LaTeX markup become clean text.

HTML is parsed into a tree of block nodes; each stretch of text between blocks, with its inline elements (``i``, ``sub``,
...), is a leaf of its own.  Each node has a composite text density: its characters per tag, adjusted by the share of
characters and tags that stand in links.  The node whose children's densities sum highest is the content (of equal ones
the innermost); the least density on its path to the body is the threshold.  Outside the content a block stays if it
reaches the threshold; inside it a block goes only if it is below the threshold and mostly links.  Headings stay.

Structure stays visible in one notation: headings ``# ...``, items ``- ...``, code between ``` fences or single
backticks, formulas between ``$`` or ``$$``, table rows ``| a | b |``.

Defined results: null and blank texts and texts without markup give no row; texts that end up empty give ''.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan
from . import markup

# fixed values: elements that begin a block, that hold no content, that never have an end tag
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figure figcaption footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead title tr ul sec abstract "
    "list list-item disp-formula caption".split()
)
EMPTY = set("script style noscript template svg iframe object head select textarea button".split())
VOID = set("br hr img input meta link col wbr area base embed source".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "title"}
FORMULAS = {"math", "disp-formula", "inline-formula"}
NAVIGATION = {"nav", "aside", "footer", "menu"}


class Node:
    __slots__ = ("tag", "parent", "parts", "leaves", "sealed", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list[Node | str] = []
        self.leaves: list[Node] = []  # stretches of text, measured as nodes of their own
        self.sealed = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def blocks(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


class Tree(HTMLParser):
    """Block nodes with their texts; inline elements leave their text and, for some, a sign."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.skipped = 0
        self.links = 0
        self.formulas = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        tag = tag.rpartition(":")[2]
        if tag in EMPTY:
            self.skipped += 1
        if self.skipped or tag in ("body", "html"):
            return
        if tag == "br":
            self._text("\n")
        elif tag in FORMULAS and not self.formulas:
            self.formulas += 1
            self._text("$")
        elif tag in ("code", "tt", "kbd", "samp") and self.at.tag != "pre":
            self._text("`")
        elif tag in BLOCKS and tag not in VOID:
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and self.at.tag == tag:
                self.at = self.at.parent
            self.at.sealed = True
            node = Node(tag, self.at)
            self.at.parts.append(node)
            self.at = node
            node.link_tags += self.links > 0
            return
        elif tag == "a":
            self.links += 1
        leaf = self._leaf()
        leaf.tags += 1
        leaf.link_tags += self.links > 0

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag.rpartition(":")[2] not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        tag = tag.rpartition(":")[2]
        if tag in EMPTY:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag in FORMULAS and self.formulas:
            self.formulas -= 1
            self._text("$")
        elif tag in ("code", "tt", "kbd", "samp") and self.at.tag != "pre":
            self._text("`")
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            node = self.at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:  # an end without its start is dropped
                self.at = node.parent

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self._text(data)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def _text(self, data: str) -> None:
        self.at.parts.append(data)
        leaf = self._leaf()
        n = sum(not c.isspace() for c in data)
        leaf.chars += n
        if self.links:
            leaf.link_chars += n

    def _leaf(self) -> Node:
        """The stretch of text in hand: as long as no block begins or ends, the same."""
        last = self.at.leaves[-1] if self.at.leaves else None
        if last is None or self.at.sealed:
            last = Node("#text", self.at)
            self.at.leaves.append(last)
            self.at.sealed = False
        return last


def _measure(root: Node) -> None:
    """Composite text densities of all nodes, from the leaves up (no recursion: trees may be deep).

    The density of a node with C characters, T tags, of them LC and LT in links, N = C - LC, in a body with CB and LCB:
    C/T * log(C/LC * T/LT) to the base ln(C/N * LC + LCB/CB * C + e).  Counts that are 0 below a fraction line, and the
    links of texts that have none, are taken as 1.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.blocks()
    for node in reversed(order):
        for child in [*node.leaves, *node.blocks()]:
            node.chars += child.chars
            node.tags += child.tags + (child.tag != "#text")
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in order:
        for x in [node, *node.leaves]:
            if x.chars:
                tags, links, link_tags = max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
                base = math.log(x.chars / max(1, x.chars - x.link_chars) * links + share * x.chars + math.e)
                x.density = x.chars / tags * math.log(max(1.0, x.chars / links * tags / link_tags)) / math.log(base)
    for node in order:
        node.total = sum(c.density for c in [*node.leaves, *node.blocks()])


def content(root: Node) -> tuple[set[int], list[Node]]:
    """Ids of the nodes to keep, and the outermost blocks that go."""
    _measure(root)
    best, todo = root, [root]
    while todo:
        node = todo.pop()
        if node.total > best.total or (node.total == best.total and node.total > 0 and _above(best, node)):
            best = node
        todo += [c for c in node.blocks() if c.tag not in NAVIGATION]
    threshold, at = best.density, best.parent
    while at is not None:
        threshold = min(threshold, at.density)
        at = at.parent
    path = set()
    at = best
    while at is not None:
        path.add(id(at))
        at = at.parent
    keep: set[int] = set()
    gone: list[Node] = []
    todo2 = [(root, False)]
    while todo2:
        node, inside = todo2.pop()
        dense = node.density >= threshold
        if id(node) in path or node.tag in HEADINGS:
            stays = True
        elif inside:
            stays = dense or node.link_chars * 2 <= node.chars
        else:
            stays = dense and node.tag not in NAVIGATION
        if not stays:
            gone.append(node)
            continue
        keep.add(id(node))
        todo2 += [(c, inside or node is best) for c in node.blocks()]
    return keep, gone


def _above(node: Node, best: Node) -> bool:
    at = best
    while at is not None:
        if at is node:
            return True
        at = at.parent
    return False


def _render(root: Node, keep: set[int]) -> str:
    out: list[str] = []
    todo: list[tuple[Node | str, str]] = [(root, "")]
    while todo:
        x, context = todo.pop()
        if isinstance(x, str):
            out.append(x if context == "pre" else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*|[ \t\r\f\v]+", lambda m: "\n" if x == "\n" else " ", x))
            continue
        if id(x) not in keep:
            continue
        before, after = "", ""
        if x.tag in HEADINGS:
            before, after = "\n\n# ", "\n\n"
        elif x.tag in ("li", "list-item"):
            before, after = "\n- ", ""
        elif x.tag == "pre":
            before, after = "\n\n```\n", "\n```\n\n"
        elif x.tag == "tr":
            before, after = "\n|", ""
        elif x.tag in ("td", "th"):
            before, after = " ", " |"
        elif x.tag != "body":
            before = after = "\n" if context in ("li", "td", "th") else "\n\n"
        todo.append((after, "pre"))
        todo += [(p, "pre" if x.tag == "pre" else x.tag) for p in reversed(x.parts)]
        todo.append((before, "pre"))
    return "".join(out)


def parsed(text: str) -> Node:
    """Tree of a text that holds HTML or XML, whole or broken."""
    text = re.sub(r"<!--.*?(?:-->|\Z)", " ", text, flags=re.S)
    text = re.sub(r"<(?![A-Za-z/!?])", "&lt;", text)  # comparisons
    text = re.sub(rf"(</?{markup.NAME}(?:{markup.ATTRIBUTE})*)\s*(?=<|\Z)(?<!>)", r"\1>", text, flags=re.I)
    tree = Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def from_html(text: str) -> str:
    """Content of a text that holds HTML or XML, whole or broken."""
    root = parsed(text)
    return _render(root, content(root)[0])


def boilerplate(text: str) -> list[str]:
    """Texts of the blocks that ``from_html`` leaves out for their density."""
    gone = content(parsed(text))[1]
    whole = []
    for node in gone:
        keep, todo = set(), [node]
        while todo:
            x = todo.pop()
            keep.add(id(x))
            todo += x.blocks()
        if shown := re.sub(r"\s+", " ", _render(node, keep)).strip():
            whole.append(shown)
    return whole


class _Kept:
    """Code and formulas, put aside while the text around them is cleaned."""

    def __init__(self) -> None:
        self.texts: list[str] = []

    def put(self, text: str) -> str:
        self.texts.append(text)
        return f"\ue000{len(self.texts) - 1}\ue001"

    def back(self, text: str) -> str:
        while "\ue000" in text and self.texts:
            new = re.sub("\ue000(\\d+)\ue001", lambda m: self.texts[int(m[1])] if int(m[1]) < len(self.texts) else m[0], text)
            if new == text:
                break
            text = new
        return text


_group = re.compile(r"\\[\\{}]|(\\[A-Za-z]+\*?\s*(?:\[[^\]\n]*\])?\{|\{\\[A-Za-z]+\s+)|([{}])")


def _ungrouped(text: str) -> str:
    """Commands with a group become what the group holds, however deep they are nested; plain groups stay."""
    out: list[str] = []
    open_: list[bool] = []  # of every open group: does its end go with it
    at = 0
    for m in _group.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            open_.append(True)
        elif m[2] == "{":
            open_.append(False)
            out.append("{")
        elif m[2] == "}":
            if not open_ or not open_.pop():
                out.append("}")
        else:
            out.append(m[0])
    return "".join([*out, text[at:]])


def _without_templates(text: str) -> str:
    """Templates between double braces go, however deep they are nested; unmatched signs alone go too."""
    out: list[str] = []
    open_: list[int] = []
    for x in re.split(r"(\{\{|\}\})", text):
        if x == "{{":
            open_.append(len(out))
        elif x == "}}":
            if open_:
                del out[open_.pop() :]
        else:
            out.append(x)
    return "".join(out)


def from_latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: kept.put(f"\n```\n{m[2].strip()}\n```\n"), text, flags=re.S)
    display = r"\\begin\{(?:equation|align|gather|displaymath|math|eqnarray|multline)\*?\}(.*?)\\end\{[a-z]+\*?\}|\\\[(.*?)\\\]|\$\$(.+?)\$\$"
    text = re.sub(display, lambda m: kept.put("$$ " + next(x for x in m.groups() if x is not None).strip() + " $$"), text, flags=re.S)
    text = re.sub(r"\\\((.*?)\\\)", lambda m: kept.put(f"${m[1].strip()}$"), text, flags=re.S)
    text = re.sub(r"(?<![\w$\\])\$(?=[^$\s])([^$\n]*[\\^_{}=][^$\n]*|[A-Za-z])\$(?!\w)", lambda m: kept.put(f"${m[1]}$"), text)
    text = re.sub(r"\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{([^{}]*)\}", r"\n# \1\n", text)
    text = re.sub(r"\\item(?:\[[^\]]*\])?\s*", "\n- ", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\s*\\(?:cite[a-z]*|ref|eqref|label|pageref|input|includegraphics|bibliography)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = _ungrouped(text)
    text = re.sub(r"\{\\[A-Za-z]+\s+|\\\\(?=\s|$)", " ", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    return re.sub(r"\\(?:[A-Za-z]{2,})(?![A-Za-z])\s?", "", text)


def from_wiki(text: str) -> str:
    def rows(m: re.Match) -> str:
        lines = []
        for row in re.split(r"^\|-.*$", re.sub(r"^\{\|.*$|^\|\}\s*$|^\|\+.*$", "", m[0], flags=re.M), flags=re.M):
            cells = [c.strip() for line in row.strip().split("\n") if line.strip() for c in re.split(r"\|\||!!", line.lstrip("|!"))]
            if any(cells):
                lines.append("| " + " | ".join(cells) + " |")
        return "\n" + "\n".join(lines) + "\n"

    text = re.sub(r"^\{\|.*?(?:^\|\}|\Z)", rows, text, flags=re.S | re.M)
    text = _without_templates(text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", lambda m: re.sub(r"^\w+:(?=\S)", "", m[1]), text)
    text = re.sub(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"# \2", text, flags=re.M)
    text = re.sub(r"\[(?:https?://\S+)\s+([^\]]+)\]", r"\1", text)
    text = re.sub(r"'{3}(.*?)'{3}", r"\1", text, flags=re.S)
    text = re.sub(r"(?<!')''(.*?)''(?!')", r"\1", text, flags=re.S)
    return re.sub(r"'{2,}|\[\[(?:\w+:)?|\{\{|\}\}", "", text)


def from_markdown(text: str, kept: _Kept) -> str:
    text = re.sub(r"(?:```|~~~)[^\n`~]*\n(.*?)(?:\n(?:```|~~~)|\Z)", lambda m: kept.put(f"```\n{m[1]}\n```"), text, flags=re.S)
    text = re.sub(r"(?<![\w`])`([^`\n]+)`(?!\w)", lambda m: kept.put(f"`{m[1]}`"), text)
    text = re.sub(r"^([^\n|>-][^\n]*)\n(?:={3,}|-{3,})[ \t]*$", r"# \1", text, flags=re.M)
    text = re.sub(r"^\s{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", r"# \1", text, flags=re.M)
    text = re.sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"^\s{0,3}>\s?", "", text, flags=re.M)
    text = re.sub(r"^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*\n?", "", text, flags=re.M)
    text = re.sub(r"^[ \t]{0,3}[*+-][ \t]+(?=\S)", "- ", text, flags=re.M)
    for sign in (r"\*{3,}", r"\*\*", r"__", "~~"):
        text = re.sub(rf"(?<![\w*_]){sign}(?=\S)(.+?)(?<=\S){sign}(?![\w*_])", r"\1", text, flags=re.S)
    for sign in (r"\*", "_"):
        text = re.sub(rf"(?<![\w*_]){sign}(?=[^\s*_])([^*_\n]*?)(?<=[^\s*_]){sign}(?![\w*_])", r"\1", text)
    return text


def clean(text: str) -> tuple[str, list[str]]:
    """Clean text and the kinds of markup that were found; a text without markup comes back as it is."""
    kinds = markup.find(text)
    if not kinds:
        return text, kinds
    kept = _Kept()
    if "latex" in kinds:
        text = from_latex(text, kept)
    if "markdown" in kinds:
        text = from_markdown(text, kept)
    if "wiki" in kinds:
        text = from_wiki(text)
    if "html" in kinds:
        text = from_html(text)
    elif "entity" in kinds:
        text = html.unescape(text)
    text = kept.back(text)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![ \t]*```)", "\n", text)) if "```" not in text else text
    return re.sub(r"\n{3,}", "\n\n", text).strip(), kinds


def cleaned(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), id_col: str = "id") -> DataFrame:
    """``id, field, kinds, clean_text`` of every field that holds markup.

    Only texts with one of the signs markup is made of leave the JVM; the parser decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, kinds, texts = [], [], [], []
            for key, name, text in zip(*(c.to_pylist() for c in b.columns)):
                new, found = clean(text)
                if found:
                    ids.append(key), names.append(name), kinds.append(found), texts.append(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, b.column(0).type),
                    pa.array(names, pa.string()),
                    pa.array(kinds, pa.list_(pa.string())),
                    pa.array(texts, pa.string()),
                ],
                names=[id_col, "field", "kinds", "clean_text"],
            )

    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    rows = df.select(F.col(id_col), each.alias("x")).select(id_col, "x.field", "x.text")
    rows = rows.where(F.col("text").rlike(markup.SIGNS.pattern))
    kind = df.schema[id_col].dataType.simpleString()
    return spread_scan(rows).mapInArrow(run, f"`{id_col}` {kind}, field string, kinds array<string>, clean_text string")


def dropped(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract"), id_col: str = "id") -> DataFrame:
    """``id, field, block``: the blocks of HTML texts that are left out of the clean text for their density."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, name, text in zip(*(c.to_pylist() for c in b.columns)):
                if "html" in markup.find(text):
                    out += [(key, name, block) for block in boilerplate(text)]
            kinds = (b.column(0).type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[id_col, "field", "block"])

    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    rows = df.select(F.col(id_col), each.alias("x")).select(id_col, "x.field", "x.text").where(F.contains("text", F.lit("<")))
    return spread_scan(rows).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, field string, block string")
