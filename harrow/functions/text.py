"""String functions as Column expressions.  All stay inside the JVM but ``unaccent_exact``, ``token_lists`` and the bracket fixpoint."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: English stop words with the units that count as such
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it "
    "its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()

_STOP = set(STOP_WORDS)
LONGEST_PARTITIONED = 20
WORD_GAP = r"[^\p{L}\p{N}]+"
Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letters that are left of them when they are decomposed."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [x for x in unicodedata.normalize("NFD", chr(c)) if ord(x) < 128]
        if len(base) == 1:
            pairs.append((chr(c), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(x: Text) -> Column:
    """Latin letters without their marks; other characters outside ASCII are dropped."""
    return F.regexp_replace(F.translate(col(x), *_latin()), r"[^\x00-\x7F]", "")


@F.pandas_udf(StringType())
def unaccent_exact(x):  # pandas Series
    """The same by full compatibility decomposition (ligatures, fractions)."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def squeeze(x: Text) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def similarity(a: Text, b: Text) -> Column:
    """1 - edit distance / longer length; null for two empty strings."""
    return 1 - F.try_divide(F.levenshtein(col(a), col(b)), F.greatest(F.length(col(a)), F.length(col(b))))


def is_abbreviation(w: Text) -> Column:
    """All upper case, or all upper case with a final s."""
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    body = F.regexp_replace(col(w), "s$", "")
    return upper(col(w)) | (col(w).endswith("s") & (F.length(col(w)) > 1) & upper(body))


def normal_abbreviation(w: Text) -> Column:
    return F.regexp_replace(col(w), "s$", "")


def normal_words(x: Text, lower: bool = True) -> Column:
    """Words without digit-led ones, marks and punctuation; abbreviations keep their case and lose a final s."""
    spaced = F.regexp_replace(F.coalesce(col(x), F.lit("")), WORD_GAP, " ")
    undigited = F.regexp_replace(spaced, "(^| )[0-9][^ ]*", " ")
    words = F.filter(F.split(unaccent(undigited), " +"), lambda w: w != "")
    if not lower:
        return words
    return F.transform(words, lambda w: F.when(is_abbreviation(w), normal_abbreviation(w)).otherwise(F.lower(w)))


def normal_text(x: Text) -> Column:
    return F.array_join(normal_words(x), " ")


def lemma(w: Text) -> Column:
    """Noun plurals folded by detachment rules."""
    w = col(w)
    return (
        F.when(~(w.endswith("s") | w.endswith("men")), w)
        .when(w.isin("assess", "assesses"), "assess")
        .when(w.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("^.{2,}ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.endswith("men"), F.regexp_replace(w, "men$", "man"))
        .when(w.rlike("^.{2,}s$") & ~w.rlike("(ss|us|is)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def token_list(x: Text) -> Column:
    """Index tokens: no stop words, abbreviations kept, other words of two letters or more folded to their lemma."""
    kept = F.filter(normal_words(x), lambda w: ~w.isin(*STOP_WORDS) & ((F.length(w) > 1) | is_abbreviation(w)))
    return F.transform(kept, lambda w: F.when(is_abbreviation(w), w).otherwise(lemma(w)))


def index_token(w: str) -> str | None:
    """The token of ``token_list`` for one of the words that ``normal_words(lower=False)`` gives, all ASCII; None if there is none."""
    upper = lambda x: x.upper() == x and x.lower() != x
    short = lambda x: upper(x) or (len(x) > 1 and x.endswith("s") and upper(x[:-1]))
    w = w.removesuffix("s") if short(w) else w.lower()
    if short(w):
        return None if w in _STOP else w
    if w in _STOP or len(w) < 2:
        return None
    if not w.endswith(("s", "men")):
        return w
    if w in ("assess", "assesses"):
        return "assess"
    if w.endswith(("sses", "xes", "zes", "ches", "shes")):
        return w[:-2]
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("men"):
        return w[:-3] + "man"
    return w[:-1] if len(w) > 2 and not w.endswith(("ss", "us", "is")) else w


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}
    for batch in batches:
        lists = batch.column(0)
        words = pc.list_flatten(lists).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known |= {w: index_token(w) for w in distinct if w not in known}
        tokens = pa.array([known[w] for w in distinct], pa.string()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(tokens.is_valid().to_numpy(zero_copy_only=False))])
        ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.drop_null())], ["l"])


def token_lists(df: DataFrame, x: Text) -> DataFrame:
    """``l``: ``token_list`` of each row; a task folds each distinct word once."""
    return df.select(normal_words(x, lower=False).alias("l")).mapInArrow(_listed, "l array<string>")


def normal_sentence(x: Text) -> Column:
    return F.array_join(token_list(x), " ")


def stems_with_numbers(x: Text) -> Column:
    """Stems of the words of a text, numbers kept: no stop words, no single letters but digits; null is empty."""
    from .stem import stems

    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    return stems(F.transform(kept, lemma))


def key_sorted(x: Text) -> Column:
    """Word-order-free key of a sentence."""
    return F.array_join(F.array_sort(token_list(x)), " ")


def sorted_words(x: Text) -> Column:
    return F.array_join(F.array_sort(F.split(squeeze(F.lower(col(x))), " ")), " ")


def drop_escapes(x: Text) -> Column:
    """``<U+00E9>`` and the like become `` ; `` and the punctuation around is tidied."""
    mark = r"<\s*U\s*\+([A-Za-z0-9_]{4})\s*>"
    y = F.regexp_replace(col(x), mark, " ; ")
    y = F.regexp_replace(y, r"([.:;!?])\s*;", "$1")
    y = F.regexp_replace(F.regexp_replace(y, r"^\s*;\s*", ""), r"\s*;\s*", " ; ")
    return F.when(col(x).rlike(mark), y).otherwise(col(x))


def strip(x: Text) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(x), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def drop_copyright(x: Text) -> Column:
    """Everything from a copyright sign on; "no abstract available" becomes empty."""
    head = strip(F.regexp_extract(col(x), r"(?s)^(.*?)(?:©|\(c\)|\(C\)|\z)", 1))
    bare = F.regexp_replace(F.regexp_replace(head, r"([C|c])opyright ?\.?", ""), r"\s+", " ")
    none = F.lower(F.regexp_replace(col(x), r"[\[\]]", "")) == "no abstract available"
    return F.when(none, F.lit("")).otherwise(strip(bare))


def drop_html(x: Text) -> Column:
    """Tags that end in their line, empty brackets, the usual entities."""
    y = F.regexp_replace(col(x), r"<.+?>", "")
    y = F.regexp_replace(F.regexp_replace(y, r"\(\s*\)", ""), r"\[\s*\]", "")
    for entity, sign in (("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&nbsp;", " ")):
        y = F.replace(y, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(y, r"&[A-Za-z0-9_]+;", " "), r"\s+", " ")


def drop_braces(x: Text) -> Column:
    """``{A}`` becomes A, ``{%}`` becomes %, other braces go with what they hold."""
    y = F.regexp_replace(col(x), r"\{[^A-Za-z0-9_%&#}]*(?:([A-Za-z0-9])(?:[^A-Za-z0-9_}][^}]*)?|([%&#])[^}]*)\}", "$1$2")
    return F.regexp_replace(y, r"\{[^}\n]*\}", "")


def trim_punctuation(x: Text) -> Column:
    """Punctuation and blanks off both ends; of the closing run the first final mark before its last sign stays."""
    y = F.regexp_replace(col(x), r"^[,.;?!\s]+", "")
    run = F.regexp_extract(y, r"([,.;?!\s]*)\z", 1)
    mark = F.regexp_extract(F.regexp_replace(run, r"(?s).\z", ""), r"([.?!])", 1)
    return F.concat(F.regexp_replace(y, r"[,.;?!\s]+\z", ""), mark)


def keyword_parts(x: Text) -> Column:
    """Parts between commas and semicolons, without blank ones and those that say "full text"."""
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), "[,;]"), lambda w: F.trim(w))
    return F.filter(parts, lambda w: (w != "") & ~F.lower(w).contains("full text"))


def keyword_search(x: Text) -> Column:
    normal = F.transform(keyword_parts(x), lambda w: F.array_join(normal_words(w, lower=False), " "))
    return F.array_join(F.filter(normal, lambda w: w != ""), " ; ")


def split_parts(x: Text, and_or: bool = True) -> Column:
    """Parts of a sentence between commas; short bracketed remarks, brackets and, if wanted, and/or count as commas."""
    y = F.regexp_replace(col(x), r"\b(and|or)\b", ",") if and_or else col(x)
    y = F.regexp_replace(y, r"\(\s*[A-Za-z0-9_]{1,4}\s*\)|\[\s*[A-Za-z0-9_]{1,4}\s*\]", ",")
    y = F.regexp_replace(y, r"[()\[\];:]", ",")
    return F.filter(F.transform(F.split(y, ","), lambda w: F.trim(w)), lambda w: w != "")


def split_punctuation(x: Text) -> Column:
    return F.filter(F.split(F.regexp_replace(col(x), r"[,;.!?:()]+|\b(and|or)\b", "\u0001"), "\u0001"), lambda w: w != "")


def split_sentences(x: Text) -> Column:
    """Plain sentence pieces: after a final mark and white space."""
    return F.filter(F.split(F.regexp_replace(col(x), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda w: F.trim(w) != "")


def country_name(x: Text) -> Column:
    bare = F.regexp_replace(F.trim(F.split_part(col(x), F.lit(","), F.lit(1))), r"\(.*?\)|\[.*?\]", " ")
    return unaccent(squeeze(bare))


def contains_any(x: Text, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(col(x), w))


def contains_full(x: Text, words: list[str]) -> Column:
    return col(x).rlike("(?:^|[^A-Za-z0-9_])(?:" + "|".join(words) + ")s?s?(?:[^A-Za-z0-9_]|$)")


def contains_verb(x: Text, verbs: list[str]) -> Column:
    forms = F.array(*(F.lit(f) for v in verbs for f in (v, v[:-1] if v.endswith("e") else v)))
    return F.exists(forms, lambda w: F.contains(col(x), w))


def has_lone_digit(x: Text) -> Column:
    """A word with a digit and fewer than two other characters."""
    return F.exists(F.split(col(x), r"\s+"), lambda w: w.rlike("[0-9]") & (F.length(F.regexp_replace(w, "[0-9]", "")) < 2))


def has_word(x: Text, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(col(x)), r"\s+"), F.array(*map(F.lit, words)))


def zs_variant(a: Text, b: Text) -> Column:
    """Equal but for one inner s or z (words of more than five letters)."""
    a, b = col(a), col(b)
    n = F.length(a)
    same = (F.translate(a, "z", "s") == F.translate(b, "z", "s")) & (F.substring(a, 1, 2) == F.substring(b, 1, 2))
    return (n > 5) & (n == F.length(b)) & same & (F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & (F.levenshtein(a, b) == 1)


def similar(a: Text, b: Text, threshold: float) -> Column:
    return (similarity(a, b) >= threshold) | zs_variant(a, b)


def keep_content(x: Text) -> Column:
    """Words that are no stop words, their case kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(F.split(squeeze(x), " "), lambda w: ~F.array_contains(stop, F.lower(w)) & ~F.array_contains(stop, lemma(F.lower(w))))
    return F.array_join(words, " ")


def title_case(w: Text) -> Column:
    return F.when((F.upper(col(w)) == col(w)) & (F.lower(col(w)) != col(w)), F.initcap(col(w))).otherwise(col(w))


def geo_words(x: Text) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.split(squeeze(F.split_part(col(x), F.lit(","), F.lit(1))), " ")
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)) & ~is_abbreviation(w)), " ")


def journal_part(x: Text) -> Column:
    """The part of a journal field that names it: the first if a part gives a volume, else the last up to its comma."""
    parts = F.transform(F.split(drop_braces(drop_html(x)), ";"), lambda w: F.trim(w))
    volume = F.exists(parts, lambda w: F.lower(w).startswith("vol."))
    return F.when(volume, F.element_at(parts, 1)).otherwise(F.trim(F.split_part(F.element_at(parts, -1), F.lit(","), F.lit(1))))


def keyword_columns(x: Text) -> Column:
    """Keywords; of more than five that are half in capitals, the capital ones are lowered."""
    words = keyword_parts(x)
    upper = F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
    many = (F.size(words) > 5) & (upper * 2 >= F.size(words))
    lowered = F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), F.lower(w)).otherwise(w))
    return F.array_join(F.when(many, lowered).otherwise(words), "; ")


def sub_phrases(x: Text, longest: int = 3) -> Column:
    """All contiguous sub-phrases of up to ``longest`` words."""
    words = F.split(col(x), " ")
    n = F.size(words)
    at = F.sequence(F.lit(1), n)
    spans = F.transform(
        at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " "))
    )
    return F.array_distinct(F.flatten(spans))


def drop_ocr_junk(x: Text) -> Column:
    return F.regexp_replace(col(x), "[sencmaruotv]{15,}", "")


def access_to(x: Text) -> Column:
    return F.regexp_replace(col(x), "(access|accessing|accessed) ", "access to ")


def semicolon_head(x: Text) -> Column:
    """Without the short fragments (fewer than two words) before the first longer part."""
    parts = F.split(col(x), ";")
    short = lambda w: w.rlike(r"^[\p{L}\p{N}_ -]*$") & (F.size(F.filter(F.split(w, r"\s+"), lambda v: v != "")) < 2)
    first = F.array_min(F.filter(F.transform(parts, lambda w, i: F.when(~short(w), i + 1)), lambda i: i.isNotNull()))
    kept = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(parts, F.coalesce(first, F.lit(1)), F.size(parts)))
    return F.when(~F.contains(col(x), F.lit(";")) | (first == 1), col(x)).otherwise(F.trim(F.array_join(kept, ";")))


def _n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda v: v != ""))


def semicolon_tail(x: Text) -> Column:
    """Up to a sentence end before a fragment of fewer than three words; of that, the parts of more than three words."""
    parts = F.split(col(x), ";")
    n = F.size(parts)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    stops = F.filter(at, lambda i: F.element_at(parts, i).rlike(r"\.\s*$") & (_n_words(F.element_at(parts, i + 1)) < 3))
    first = F.array_min(stops)
    kept = F.filter(F.slice(parts, 1, F.coalesce(first, F.lit(1))), lambda w: _n_words(w) > 3)
    return F.when(first.isNull(), col(x)).otherwise(F.array_join(kept, ";"))


def english_parts(x: Text) -> Column:
    """The parts between semicolons that hold an English function word; the whole text if none does."""
    parts = F.split(col(x), ";")
    words = lambda w: F.split(F.regexp_replace(F.lower(w), "[^a-z]+", " "), " ")
    english = F.filter(parts, lambda w: F.exists(words(w), lambda v: v.isin("the", "of", "and", "in", "for", "with", "on", "to", "under")))
    return F.when(F.size(english) > 0, F.array_join(english, ";")).otherwise(col(x))


def abbreviation_runs(x: Text) -> Column:
    """Runs of two or more adjacent words in capitals."""
    return F.regexp_extract_all(col(x), F.lit(r"\b[A-Z]{2,}(?: [A-Z]{2,})+\b"), F.lit(0))


def _unbracket(text: str | None) -> str | None:
    """Drop or open the last square brackets until nothing changes."""
    if text is None:
        return None
    words = lambda t: [w for w in re.findall(r"\w+", t) if len(w) > 1 and w.lower() not in _STOP and not w[0].isdigit()]
    while found := re.findall(r"\[.*?\]", text):
        last = found[-1]
        if len(words(text.replace(last, ""))) < 2:
            new = text.replace("[", " ").replace("]", " ").strip()
        elif len(words(text.split(last)[1])) > 2:
            new = text
        else:
            new = text.replace(last, "").strip()
        if new == text:
            break
        text = new
    return text


@F.pandas_udf(StringType())
def drop_last_brackets(x):  # pandas Series
    """Remarks in square brackets at the end of a text; a text that is all in brackets loses only the marks."""
    return x.map(_unbracket)


def _chunks(text: str | None) -> list[list[str]] | None:
    if text is None:
        return None
    words = text.split()
    if len(words) > LONGEST_PARTITIONED:
        return None
    out: list[list[str]] = [[]] if not words else []
    todo: list[tuple[int, list[str]]] = [(0, [])] if words else []
    while todo:
        at, parts = todo.pop()
        if at == len(words):
            out.append(parts)
        else:
            todo += [(at + n, [*parts, " ".join(words[at : at + n])]) for n in (1, 2, 3) if at + n <= len(words)]
    return sorted(out)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def partitions(x):  # pandas Series
    """All ways to cut an expression into pieces of at most three words; null above ``LONGEST_PARTITIONED`` words, where
    they would be millions."""
    return x.map(_chunks)


def bigrams(words: Column) -> Column:
    """Adjacent pairs of words."""
    n = F.size(words)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def windows(words: Column, size: int, stride: int) -> Column:
    """Sliding windows of ``size`` words; the last one may be shorter."""
    n = F.greatest(F.size(words), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
