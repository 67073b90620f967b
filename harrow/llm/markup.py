"""Signs of markup in a text: HTML and XML, character entities, Markdown, wiki and LaTeX, whole or broken.

``find`` gives the kinds it holds.  Signs that stand for themselves are none: comparisons (P < 0.05), prices ($5 or $7),
names (A&B, R&D), codes (#4), products (3*4), significance stars (2.1**) and remarks in square brackets.
"""

from __future__ import annotations

import re
from html.entities import html5

# fixed values: element names of HTML, of the usual XML of articles, and of MathML
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details "
    "dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img "
    "input ins kbd label legend li link main mark math menu meta nav noscript object ol option p pre q s samp script "
    "section select small span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead "
    "time title tr tt u ul var video wbr xml sec italic bold sc list list-item disp-formula inline-formula xref ext-link "
    "fig abstract para mml mrow mi mn mo msup msub mfrac"
).split()
# fixed values: entities so common that they are told without their semicolon
OPEN_ENTITIES = "amp nbsp lt gt quot apos plusmn ndash mdash hellip deg times middot micro alpha beta eacute copy".split()

NAME = "(?:" + "|".join(sorted(map(re.escape, ELEMENTS), key=len, reverse=True)) + ")"
ATTRIBUTE = r"""\s+[\w:-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""

HTML = re.compile(
    rf"</?(?:{NAME}|[A-Za-z][\w.-]*:[A-Za-z][\w.-]*)(?:{ATTRIBUTE}|\s+\w+(?=\s*/?>))*\s*/?>"  # a whole tag
    rf"|</?[A-Za-z][\w.-]*(?:{ATTRIBUTE})+\s*/?>|</[A-Za-z][\w.:-]*\s*>|<[A-Za-z][\w.:-]*\s*/>"  # of any name
    r"|<!--|-->|<!DOCTYPE\b|<!\[CDATA\[|\]\]>|<\?xml"
    rf"|</[A-Za-z][\w.:-]*"  # broken: a closing tag without its end
    rf"|<{NAME}(?:{ATTRIBUTE})*\s*(?:$|(?=<))|<{NAME}{ATTRIBUTE}|<(?:[A-Za-z][\w.-]*:)[A-Za-z][\w.-]*",
    re.I,
)
_names = {k.rstrip(";") for k in html5}
ENTITY = re.compile(r"&#\d{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&([A-Za-z][A-Za-z0-9]{1,30});|&(?:" + "|".join(OPEN_ENTITIES) + r")\b")

LATEX = re.compile(
    r"\\(?:begin|end)\s*\{|\\[A-Za-z]{2,}(?![A-Za-z\\])|\\[A-Za-z]\{|\\[%&$#_{}]|\\[()\[\]]|\\\\(?=\s|$)|\{\\[A-Za-z]+"
    r"|\$\$.+?\$\$|(?<![\w$])\$(?=[^$\s])[^$\n]*(?:[\\^_{}=][^$\n]*)\$(?!\w)|\$[A-Za-z]\$|(?<=\w)[_^]\{[^{}]*\}",
    re.S,
)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\[\[\w+:|\{\{[^{}\n]|\{\|(?=[\s\w])|^\|[-}]\s*$|'{3}(?=\S)|(?<!')''(?=[^'\s])[^'\n]*(?:'[^'\n]+)*''(?!')"
    r"|^={2,6}\s*[^=\n]+?\s*={2,6}\s*$|^={2,6}\s+\S|\S\s+={2,6}\s*$|\}\}",
    re.M,
)
LINE = r"(?:[^\n]|\n(?!\s*\n))"  # of one paragraph
MARKDOWN = re.compile(
    r"^\s{0,3}#{1,6}\s+\S"  # heading
    r"|^\S[^\n]*\n(?:={3,}|-{3,})\s*$"  # underlined heading
    r"|```|~~~|~~(?=\S)[^~\n]+~~|(?<![\w*])\*{3,}(?=\S)"  # fences, runs of stars
    r"|(?<![\w`])`[^`]+`(?!\w)"  # code
    r"|!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"]*\")?\)|^\s{0,3}\[[^\]\n]+\]:\s+\S+|\]\((?:https?:|\w+\.\w+)"  # links
    rf"|(?<![\w*])\*\*(?=[^\s*])(?:(?!\*){LINE})*(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_]){LINE}*?(?<=[^\s_])__(?![\w_])"  # strong
    rf"|(?<![\w*\\])\*(?=[^\s*])(?:(?!\*){LINE})*(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])(?:(?!_){LINE})*(?<=[^\s_])_(?![\w_])"  # emphasis
    r"|(?:^|\n)\s{0,3}>\s+[^\s\d]"  # quotation
    r"|^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$",  # table rule
    re.M,
)
BULLETS = re.compile(
    r"(?:^|\n)[ \t]{0,3}[*+-][ \t]+\S[^\n]*\n[ \t]{0,3}[*+-][ \t]+\S|(?:\A|[^\w\s,;(–-]\s*\n|\n\s*\n)[ \t]{0,3}[*+][ \t]+\S"
)
SIGNS = re.compile(r"[<>&\\{}#*`|~=_$]|\[\[|\]\]|\]\(|''|\n\s*[-+>]\s|\n-{3,}")

# what every alternative of the two patterns holds: most texts are told without them
_WIKI_SIGNS = ("[[", "{{", "{|", "|-", "|}", "''", "==", "}}")
_MARKDOWN_SIGNS = ("#", "`", "~", "*", "_", ">", "](", "]:", "---", "===", "--|", "-|", "-:", "|-", "--")


def find(text: str) -> list[str]:
    """Kinds of markup in ``text``: html, entity, latex, wiki, markdown; in this order."""
    if not SIGNS.search(text):
        return []
    kinds = []
    if "<" in text and HTML.search(text) or "-->" in text:
        kinds.append("html")
    if "&" in text and any(m[1] is None or m[1] in _names for m in ENTITY.finditer(text)):
        kinds.append("entity")
    if ("\\" in text or "$" in text or "{" in text) and LATEX.search(text):
        kinds.append("latex")
    if any(x in text for x in _WIKI_SIGNS) and WIKI.search(text) or ("]]" in text and text.count("]") > text.count("[")):
        kinds.append("wiki")
    if any(x in text for x in _MARKDOWN_SIGNS) and MARKDOWN.search(text) or ("\n" in text or text.lstrip(" \t")[:1] in "*+-") and BULLETS.search(text):
        kinds.append("markdown")
    return kinds
