"""Normal forms of typed titles of journals and organisations: tokens, abbreviations, inversions, departments."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

# fixed values: words that carry no meaning in a name, words that head a department, spellings of one word
STOP = {"of", "for", "the", "and", "de", "on", "in"}
DEPARTMENT = re.compile(
    r"^\W*(dept|department|lab|laboratory|fac|faculty|school|div|division|unit|section|chair|programme|program)\b", re.I
)
SAME = {"center": "centre", "labor": "labour", "ctr": "centre"}

_paren = re.compile(r"\(([^()]*)\)")
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    return [SAME.get(w, w) for w in _word.findall(plain(text.replace("&", "and"))) if w not in STOP]


def near_stop(word: str) -> bool:
    """One typing error away from "of", "for", "and" or "the"."""
    for stop in ("of", "for", "and", "the"):
        if abs(len(word) - len(stop)) <= 1 and len(word) <= 4:
            start = next((k for k, (a, b) in enumerate(zip(word, stop)) if a != b), min(len(word), len(stop)))
            a, b = word[start:], stop[start:]
            if a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[1::-1] and a[2:] == b[2:] and len(b) > 1):
                return True
    return False


def abbreviates(short: str, word: str) -> bool:
    """A prefix of the word, or letters of it in order with its first and last (natl, ctr)."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    if short[-1] != word[-1] and short[-1] not in word[-3:] or len(short) < 3:
        return False
    at = iter(word)
    return all(c in at for c in short)


class Vocabulary:
    """Words of a reference list; ``expand`` gives the words a token may abbreviate, most frequent first."""

    def __init__(self, names: Iterable[str]):
        self.names = [list(dict.fromkeys(tokens(name))) for name in names]
        self.count = Counter(w for own in self.names for w in own)
        self._by_first: dict[str, list[str]] = {}
        for w, _ in self.count.most_common():
            self._by_first.setdefault(w[0], []).append(w)
        self._memo: dict[str, list[str]] = {}
        self._holders: dict[str, set[int]] = {}
        for k, own in enumerate(self.names):
            for w in own:
                self._holders.setdefault(w, set()).add(k)

    def expand(self, token: str) -> list[str]:
        if token in self.count:
            return [token]
        if token not in self._memo:
            same_start = self._by_first.get(token[0], [])
            found = [w for w in same_start if w.startswith(token) and w != token]
            if not found and len(token) >= 3:
                found = [w for w in same_start if abbreviates(token, w) and len(token) <= len(w) - 2]
            self._memo[token] = found or [token]
        return self._memo[token]

    def expanded(self, words: list[str]) -> list[str]:
        """Every reading of abbreviated words in which those of one name of the list stand for them, as joined strings.

        Where no name has words for all of them, each is read as the most frequent word it may abbreviate.
        """
        short = {w: found for w in words if (found := self.expand(w)) != [w]}
        if not short:
            return [" ".join(words)]
        names: set[int] | None = None
        for found in sorted(short.values(), key=len):
            own = set().union(*(self._holders[w] for w in found))
            names = own if names is None else names & own
            if not names:
                return [" ".join(short[w][0] if w in short else w for w in words)]
        out: dict[str, None] = {}
        for k in sorted(names):
            own = set(self.names[k])
            read = {w: next(x for x in found if x in own) for w, found in short.items()}
            out[" ".join(read.get(w, w) for w in words)] = None
        return list(out)


def rotations(words: list[str]) -> list[list[str]]:
    """The words, and with the first one last or the last one first."""
    return [words] if len(words) < 2 else [words, words[1:] + words[:1], words[-1:] + words[:-1]]


def journal_forms(value: str, vocabulary: Vocabulary) -> list[str]:
    """Strings to look a typed journal up by: whole, and without volume, year, pages and remarks."""
    bare = re.sub(r"\b(vol|no|nr|iss|issue)\b\.?\s*\d.*$|[\s,:(]*\d.*$", "", _paren.sub(" ", value), flags=re.I | re.S)
    forms: list[str] = []
    for words in (tokens(bare), tokens(value)):
        if words:
            forms += [" ".join(words), *vocabulary.expanded(words)]
            sure = [w for w in words if w in vocabulary.count or not near_stop(w)]
            forms += [" ".join(sure)] * (0 < len(sure) < len(words))
    return list(dict.fromkeys(forms))


def journal_entries(name: str, short: str | None) -> list[str]:
    """Ways a listed journal is written: in full, inverted at "of", abbreviated."""
    out = [" ".join(tokens(name))]
    if head := re.match(r"(.*?)\s+of\s+(.*)", name, re.I | re.S):
        out.append(" ".join(tokens(head[2]) + tokens(head[1])))
    if short:
        out.append(" ".join(tokens(short)))
    return [x for x in dict.fromkeys(out) if x]


def organisation_parts(value: str) -> tuple[list[list[str]], list[str]]:
    """Token lists of the parts between commas, without departments where others remain; and what stood in brackets."""
    inner = [" ".join(tokens(x)) for x in _paren.findall(value)]
    parts = [p for p in _paren.sub(" ", value).split(",") if p.strip()]
    kept = [p for p in parts if not DEPARTMENT.match(p)] or parts
    return [t for t in map(tokens, kept) if t], [x for x in inner if x]


def organisation_forms(value: str, vocabulary: Vocabulary) -> list[str]:
    """Strings to look a typed organisation up by: all its parts; the first alone, which also serves for acronyms."""
    parts, _ = organisation_parts(value)
    if not parts:
        return []
    whole = [w for p in parts for w in p]
    forms = [" ".join(whole), *vocabulary.expanded(whole)]
    sure = [w for w in whole if w in vocabulary.count or not near_stop(w)]
    forms += [" ".join(sure)] * (0 < len(sure) < len(whole))
    if len(parts) > 1 and len(parts[0]) == 1:
        forms.append(parts[0][0])
    return list(dict.fromkeys(forms))


def organisation_entries(raw: str, name: str, city: str | None, country: str | None) -> list[str]:
    """Ways a listed organisation is written: in its order or turned by a word, alone or with its place; its acronym."""
    words = tokens(name)
    town, land = tokens(city or ""), tokens(country or "")
    out = [
        " ".join(w + place)
        for w in rotations(words)
        for place in ([], land, town, town + land)
    ]
    out += organisation_parts(raw)[1]
    return [x for x in dict.fromkeys(out) if x]
