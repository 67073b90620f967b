"""Sentence boundaries in any script, after the sentence-break rules of Unicode with language-specific suppressions.

Characters have the sentence-break properties of the Unicode standard: terminators that always end a sentence (``!``,
``?``, ideographic and Indic stops, ...), the ambiguous full stop, closing marks that belong to the sentence they
close, and white space.  On top of the rules stand: abbreviations (by language, by initials, by ordinals), numbers,
quotations and brackets, which are not divided inside, attributions after a quotation, full stops glued to the next
word, texts in one case only, and Thai, where a blank ends a sentence.

Defined results: null and blank texts have no sentences; every character that is not white space belongs to exactly
one sentence; a line break alone ends nothing; a text without any terminator is one sentence; texts of any length are
read whole.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan
from . import markup

_all = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(sys.maxunicode + 1))
# by the properties of the Unicode standard: what always ends a sentence, full stops, and closing marks of any script
STERM = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _all))
ATERM = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _all)) + "…"
CLOSERS = "".join(regex.findall(r"[\p{Pe}\p{Pf}\"']", _all))
del _all
OPENERS = "“„«「『‹《〈‟｢"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》", "〈": "〉", "‟": "”", "｢": "｣"}

# fixed values, by language ("" for all): abbreviations before a name: titles, varieties
BEFORE_NAME = {
    "": "cv cvs var dr prof st",
    "en": "drs mr mrs ms ste gen col capt lt rev hon gov sen rep",
    "es": "drs dra sr sra srta ing lic sto sta",
    "pt": "drs dra sr sra ing eng sto sta",
    "it": "dott sig ing",
    "fr": "mme mlle ste ing",
    "de": "drs ing mag dipl hr fr frl",
    "ru": "проф акад доц г-н г-жа им ул",
    "hi": "डॉ प्रो श्री श्रीमती",
}
# fixed values: abbreviations before a number, months among them
BEFORE_NUMBER = {
    "": "no nos nr fig figs tab tabs eq eqs eqn vol vols pp pg art par ref refs ex app ca cca circa vs ver n°",
    "en": "sect sec ch chap cap para ann approx env jan feb mar apr jun jul aug sep sept oct nov dec",
    "es": "nro núm cap pág págs aprox env ene feb mar abr jun jul ago sep sept oct nov dic",
    "pt": "núm cap pág págs aprox jan fev abr mai jun jul ago set out nov dez",
    "it": "cap pag pagg tav gen feb apr mag giu lug ago set ott nov dic",
    "fr": "tabl chap sect env janv févr avr juil août sept oct nov déc",
    "de": "abb tbl tabl kap sect bd hrsg ungef etwa ann jan feb mär apr jun jul aug sep sept okt nov dez",
    "ru": "стр рис табл гл п янв фев апр авг сент окт нояб дек тыс млн млрд",
}
# fixed values: abbreviations inside a sentence, whatever follows
INSIDE = {
    "": "cf e.g i.e e.g. resp incl excl publ s.d ssp subsp var spp comp orig u.n viz exc",
    "es": "p.ej",
    "fr": "p.ex",
    "pt": "p.ex",
    "de": "vgl bzw inkl exkl usw u.a z.b d.h",
    "ru": "см ср т.е т.к т.д т.п",
}
# fixed values: abbreviations that may be a sentence's last word
PERHAPS_LAST = {
    "": "etc al ltd inc corp co llc plc bros jr sr a.m p.m u.s u.k u.s.a ph.d m.sc b.sc univ assoc min max sp s.a s.l gmbh ag",
    "en": "dept",
    "it": "ecc",
    "de": "usw",
    "ru": "г гг др",
}
# fixed values: common words that tell a language written in Latin letters
COMMON_WORDS = {
    "en": "the of and was were with for that which by from",
    "es": "el la los las del una que con por para según entre en durante se fue",
    "pt": "os das dos uma que com por para não foram em segundo da do ao às mais",
    "it": "il gli della delle una che con nel di dei sono",
    "fr": "le la les du une que avec pour dans selon et au par ont",
    "de": "der das und mit von den dem eine wurde wurden für um im auf bei",
}
SAYING = [[w] for w in "said says say saying answered answer replied reply was is say, said, was: is:".split()]
TITLES_IN_CAPITALS = set("gen col capt lt rev hon gov sen rep ms mr mrs".split())  # English: in small letters they are words


class Lists(NamedTuple):
    """The abbreviations that hold for a text."""

    before_name: frozenset[str]
    before_number: frozenset[str]
    inside: frozenset[str]
    perhaps_last: frozenset[str]
    english: bool


@lru_cache(maxsize=256)
def lists(languages: tuple[str, ...]) -> Lists:
    """Lists of some languages together with those of all."""
    own = lambda table: frozenset(w for k in ("", *languages) for w in table.get(k, "").split())
    return Lists(own(BEFORE_NAME), own(BEFORE_NUMBER), own(INSIDE), own(PERHAPS_LAST), languages == ("en",))


_latin = {k: frozenset(v.split()) for k, v in COMMON_WORDS.items()}
_cyrillic, _devanagari = re.compile(r"[\u0400-\u04ff]"), re.compile(r"[\u0900-\u097f]")


def languages(text: str) -> tuple[str, ...]:
    """Languages of a text: by its scripts, and by common words where the script is Latin; all where nothing tells.

    A text in several languages has all of them.
    """
    found = []
    words = set(text.lower().split())
    score = {k: len(words & v) for k, v in _latin.items()}
    found += [k for k, n in score.items() if n]
    if _cyrillic.search(text):
        found.append("ru")
    if _devanagari.search(text):
        found.append("hi")
    return tuple(found) or tuple(_latin)


ORDINAL_BEFORE = set("am im vom zum zur der dem den des die das bis seit ab beim und jeder jedem".split())
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jahr jahrhundert".split()
)

_mark = re.compile(f"[{re.escape(STERM + ATERM)}]+")
_quote = re.compile(f"[\"“”„«»「」『』‹›《》〈〉‟｢｣]")
_word_before = re.compile(r"[^\s\"“”„«»「」『』()\[\]（）,;:!?/]*$")
_thai = re.compile(r"[฀-๿]")
_space = re.compile(r"\s+")
_number = re.compile(r"\d{1,2}$")
_address = re.compile(r"://|^www\.|@|\.(?:com|org|net|example|png|jpe?g|gif|pdf|html?|csv|txt|xml)\b", re.I)

# single marks that quote; others are apostrophes
_single = re.compile(r"(?<!\S)[‘'](?=[^\s'’])(?:(?!\s[‘'])[^\n])+?[.!?,…][’'](?!\w)")
_break = re.compile(r"\n[ \t\r]*\n")
_item = re.compile(r"(?:^|[.;:!?\n])\s*\w{1,2}$")


def _spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Quotations and bracketed remarks as (opening, closing) positions, of any length; unmatched marks give none.

    A mark is matched within its paragraph.  Straight marks are told by what stands around them: one that can only open
    begins a new quotation, one that can only close (an inch) begins none.
    """
    breaks = [m.start() for m in _break.finditer(text)] if "\n" in text else []
    quotes: list[tuple[int, int]] = []
    if _quote.search(text):
        open_at, wanted = -1, ""
        for m in _quote.finditer(text):
            c, k = m[0], m.start()
            if open_at >= 0 and breaks and bisect_left(breaks, k) != bisect_left(breaks, open_at):
                open_at = -1
            if c == '"' and (open_at < 0 or wanted == '"'):
                before, after = text[k - 1 : k], text[k + 1 : k + 2]
                starts_word = not before or before.isspace() or before in "([{（"
                ends_word = not after or after.isspace() or after in ".,;:!?)]}）"
                if open_at >= 0 and not (starts_word and not ends_word):
                    quotes.append((open_at, k))
                    open_at = -1
                elif open_at >= 0 or starts_word or not ends_word:
                    open_at, wanted = k, '"'
            elif open_at >= 0:
                if c in wanted:
                    quotes.append((open_at, k))
                    open_at = -1
                elif c in PAIRS and (wanted in ("”", "“”") or PAIRS[c] == wanted):
                    open_at, wanted = k, PAIRS[c]
            elif c in PAIRS:
                open_at, wanted = k, PAIRS[c]
        edges = len(text) - len(text.lstrip()), len(text.rstrip()) - 1
        quotes = [q for q in quotes if q != edges]  # marks around the whole text quote nothing in it
    if "'" in text or "‘" in text:
        single = [(m.start(), m.end() - 1) for m in _single.finditer(text)]
        quotes = sorted(quotes + [s for s in single if not any(a <= s[0] <= b for a, b in quotes)])
    brackets: list[tuple[int, int]] = []
    stack: list[int] = []
    if "(" in text or "（" in text:
        for m in re.finditer(r"[()（）]", text):
            k = m.start()
            if stack and breaks and bisect_left(breaks, k) != bisect_left(breaks, stack[-1]):
                stack.clear()
            if m[0] in "(（":
                stack.append(k)
            elif stack and not (m[0] == ")" and _item.search(text, max(stack[-1] + 1, k - 8), k)):
                start = stack.pop()
                while brackets and brackets[-1][0] > start:  # those inside
                    brackets.pop()
                brackets.append((start, k))
    return quotes, brackets


def starts(text: str) -> list[int]:
    """0-based positions of the first characters of the sentences of ``text``."""
    first = len(text) - len(text.lstrip())
    if first == len(text):
        return []
    out = [first]
    upper = sum(map(str.isupper, text))
    lower = sum(map(str.islower, text))
    one_case = upper * 50 < lower or lower * 10 < upper  # case tells nothing about sentences
    small_case = one_case and lower > upper
    quotes, brackets = _spans(text)
    thai = _thai.search(text) is not None
    own = lists(languages(text))
    nq = nb = 0
    end = len(text)
    cuts: list[int] = []
    at = first  # start of the current sentence
    for m in _mark.finditer(text):
        i, j = m.span()
        if i < at:
            continue
        while nb < len(brackets) and brackets[nb][1] < i:
            nb += 1
        if nb < len(brackets) and brackets[nb][0] < i:
            continue  # inside brackets
        while nq < len(quotes) and quotes[nq][1] < i:
            nq += 1
        quote = quotes[nq] if nq < len(quotes) and quotes[nq][0] < i else None
        k = j
        while k < end and text[k] in CLOSERS and not (text[k] in "\"“" and any(q[0] == k for q in quotes[nq : nq + 2])):
            k += 1
        if quote and quote[1] >= k:
            # French and others put a blank before the closing mark
            gap = _space.match(text, k)
            if not (gap and gap.end() == quote[1]):
                continue  # inside a quotation
            k = quote[1] + 1
        if k >= end:
            break
        blank = _space.match(text, k)
        n = blank.end() if blank else k
        if n >= end:
            break
        nxt = text[n]
        if _ends(text, m[0], i, j, k, n, nxt, at, quote, blank is not None, one_case, small_case, own):
            cuts.append(n)
            at = n
    if thai:
        cuts = _thai_cuts(text, first, cuts)
    return out + cuts


def _ends(text, mark, i, j, k, n, nxt, at, quote, blank, one_case, small_case, own) -> bool:
    if nxt in ",;:،؛，；：、)]}）」』»›”":
        return False
    after = text[n : n + 2]
    small = nxt.islower() and not (after[1:].isupper())  # mRNA and pH may begin a sentence
    strong = mark[-1] in STERM or mark[0] in STERM
    if quote and quote[1] < k:
        before = text[at : quote[0]].rstrip()
        introduced = before[-1:] in ":：,，،" if before else False
        if before and introduced:
            return True
        if before:
            return not small and (nxt.isupper() or nxt.isdigit() or nxt in OPENERS + '"¿¡(') and not one_case
        if mark[0] in "?!？！؟":  # a quotation that begins the sentence: what follows says whose it is
            return nxt.isupper() and not one_case
        return not small or one_case
    if strong:
        return True
    if mark[0] == "…" or len(mark) > 1:  # an ellipsis
        return not small and not one_case or (one_case and not text[i - 1 : i].isspace() and blank)
    word = _word_before.search(text, max(at, i - 40), i)[0]
    if not blank and k == j:
        return _glued(text, word, nxt, n, small_case, own)
    bare = word.lower().strip("([{'’-–—.")
    if not bare:
        return not small
    if nxt in "-–—" and not text[n + 1 : n + 2].isspace():
        return False
    if k > j:  # closing marks after the stop, such as a bracket
        return not small or one_case
    if bare in own.inside:
        return False
    if bare in own.before_name and (one_case or not own.english or bare not in TITLES_IN_CAPITALS or word.strip("([{'’-–—.")[:1].isupper()):
        return False
    if bare == "no" and own.english and text[max(at, i - 24) : i - len(word)].lower().split()[-1:] in SAYING:
        return True  # an answer, not a number
    if bare in own.before_number:
        return not (nxt.isdigit() or nxt in ".§" or small)
    last = bare.rpartition(".")[2]
    if bare in own.perhaps_last:
        return not small and not (one_case and bare != "etc") if nxt.isalpha() else not nxt.isdigit() or bare == "etc"
    if len(last) == 1 and last.isalpha() and not _cjk(last):  # initials, genera, N.E., z. B.
        return False
    if _number.search(bare) and bare.isdigit():
        before = text[max(at, i - 24) : i - len(word)].split()
        following = re.match(r"\w+", text[n : n + 20])
        if (before and before[-1].lower() in ORDINAL_BEFORE) or (following and following[0].lower() in MONTHS):
            return False
        if not before:  # a numbered heading or item
            return False
    return not small or one_case


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "一" <= c <= "鿿"


def _glued(text: str, word: str, nxt: str, n: int, small_case: bool, own: Lists) -> bool:
    """A full stop without a blank after it: decimals, addresses and dotted abbreviations go on."""
    tail = re.match(r"\S*", text[n : n + 40])[0]
    if _address.search(word + "." + tail):
        return False
    prev = text[n - 2 : n - 1]
    if not prev or prev.isspace():
        return False
    if nxt.isdigit():
        return prev in ")%»”]" or (prev.isalpha() and len(word) > 3 and "." not in word and prev.islower())
    if nxt in OPENERS + '"¿¡([©':
        return "." not in word or prev.isdigit() or prev in ")%"
    if not nxt.isalpha():
        return False
    letters = re.search(r"[^\W\d_]+$", word)
    if letters and "." in word and len(letters[0]) < 3:
        return False
    if nxt.isupper() or text[n + 1 : n + 2].isupper():
        if prev.isdigit() or prev in ")%»”]":
            return True
        if letters and any(letters[0].lower() in x for x in (own.before_name, own.inside, own.before_number)):
            return False
        return bool(letters) and len(letters[0]) > 1 and text[n + 1 : n + 2] != "."
    if _cjk(nxt) or not (nxt.isupper() or nxt.islower()):
        return prev in ")%»”]" or prev.isdigit() or bool(letters)
    if small_case:
        return prev in ")%»”]" or (bool(letters) and len(letters[0]) > 3 and letters[0] == word.lstrip("([\"'«“"))
    return prev in ")%»”]"


def _thai_cuts(text: str, first: int, cuts: list[int]) -> list[int]:
    """Also end the sentences that hold Thai at every blank."""
    bounds = [first, *cuts, len(text)]
    out = set(cuts)
    for a, b in zip(bounds, bounds[1:]):
        begun = a
        for m in _space.finditer(text, a, b):
            if m.end() >= b:
                break
            if _thai.search(text, begun, m.start()) or _thai.match(text, m.end()):
                if _thai.match(text, m.end()) or _thai.match(text, m.start() - 1) or text[m.start() - 1].isdigit():
                    out.add(m.end())
                    begun = m.end()
    return sorted(out)


def segment(
    df: DataFrame, id_col: str = "id", text_col: str = "abstract", with_text: bool = True, plain_only: bool = False
) -> DataFrame:
    """One row per sentence: ``id, sentence_no, start_pos`` (both from 1) and, if wanted, ``sentence``.

    ``plain_only`` leaves out texts that hold markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, positions, texts = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if plain_only and markup.find(text):
                    continue
                at = starts(text)
                ids += [key] * len(at)
                nos += range(1, len(at) + 1)
                positions += [x + 1 for x in at]
                if with_text:
                    texts += [text[x:y].rstrip() for x, y in zip(at, [*at[1:], len(text)])]
            columns = [pa.array(ids, b.column(0).type), pa.array(nos, pa.int32()), pa.array(positions, pa.int32())]
            names = [id_col, "sentence_no", "start_pos"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("sentence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, sentence_no int, start_pos int" + ", sentence string" * with_text
    rows = df.select(id_col, F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    return spread_scan(rows).mapInArrow(run, schema)
