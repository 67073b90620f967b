"""Variant spellings of persons and organisations, linked by noisy-channel attribution.

Distinct spellings are parsed to normal forms; equal forms are one.  Candidates for the canonical form of a form x are
found by equal keys and ranked by prior times likelihood:

* typing errors: forms within two edits (one below ten letters, none below four), found by a join on the hashes of their deletion
  neighbourhoods.  Prior: the number of spellings that attest each word that differs; likelihood: ``TYPO`` per edit.
* short given names: from a table, or cut after three letters or more, with the same family name.
* initials: same family name, first letter, and no other middle initial than the one attested; prior: mentions.
* organisations: words abbreviated (expanded to the most frequent fitting word), turned round, with or without their
  place, department or acronym; the shortest attested word set wins.

Each variant is attached to the candidate of the highest posterior, and only if it beats staying by itself; chains are
followed to their ends.  All tables here are of distinct spellings and are joined on keys of high entropy; pairs are
made inside an entity only, as they are the result.

Defined results: null, empty and blank entries and entries that name no one ("et al.", "Anonymous", "retired", boxes and
farms without a name) have no links; a spelling is compared with all it holds; repeated mentions raise the prior only;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread, spread_join
from .canonical import parts
from .name_forms import Vocabulary, near_stop, organisation_parts, plain

TYPO = 0.3  # likelihood of an edit against the odds of the words' attestations
RARE = 2.5
SHORT, RARER = 6, 20  # forms below so many letters are mistypings only of words attested so many times as often
OWN = 12  # spellings up to which a word is one organisation's own
COMMON = 0.0005  # share of spellings from which a word may be what others abbreviate: at most some thousand words

# fixed values: entries that name no one in particular, titles and remarks
NO_PERSON = re.compile(
    r"^\W*(?:et al|and others|anon|anonymous|unknown|n/?a|none|nil|no author.*|various|authors?|staff|editors?|"
    r"editorial board|corresponding author)\W*$",
    re.I,
)
NO_ORGANISATION = re.compile(
    r"^\W*(?:retired|unknown|n/?a|none|nil|unaffiliated|self[- ]employed|freelance\w*|private\b.*|independent\b.*|"
    r"p\.?\s*o\.?\s*box\b.*|postfach\b.*|home address.*|c/o\b.*)\W*$",
    re.I | re.S,
)
TITLES = re.compile(r"\b(?:dr|prof|professor|mr|mrs|ms|sir|ing|phd|ph\.d|md|msc|jr|sr)\b\.?,?", re.I)

_initials = re.compile(r"^(?:[^\W\d_]\.?[- ]?){1,3}$")


def person(spelling: str) -> tuple[str, str, str] | None:
    """(given name or '', initials, family name) in lower case; None if it names no one."""
    if NO_PERSON.match(spelling):
        return None
    text = TITLES.sub(" ", re.sub(r"\([^()]*\)", " ", spelling)).strip(" ,.") + ("." if spelling.rstrip().endswith(".") else "")
    if not re.search(r"[^\W\d_]", text):
        return None
    if "," in text:
        family, _, rest = text.partition(",")
        first = rest.split()
    else:
        words = text.split()
        short = [bool(re.fullmatch(r"(?:[^\W\d_]\.){1,3}|[^\W\d_]{1,3}", w)) and w.rstrip(".").upper() == w.rstrip(".") for w in words]
        if len(words) > 1 and short[-1] and not all(short):
            family, first = " ".join(w for w, s in zip(words, short) if not s), [w for w, s in zip(words, short) if s]
            if not short[0] and len(words) - sum(short) > 1:  # Given Family J
                family, first = " ".join(words[1:-1]), [words[0], words[-1]]
        elif len(words) > 1:
            k = 1
            while k < len(words) - 1 and short[k]:
                k += 1
            family, first = " ".join(words[k:]), words[:k]
        else:
            family, first = text, []
    given, initials = "", ""
    for w in first:
        bare = w.strip(".,")
        if len(bare) <= 3 and bare.upper() == bare or "." in bare or len(bare) == 1:
            initials += re.sub(r"\W", "", bare)
        elif not given:
            given = bare
        else:
            initials += bare[:1]
    if given:
        initials = given[0] + initials
    family = plain(re.sub(r"[^\w' -]", "", family)).strip()
    return plain(given), plain(initials), family


def _deletions(text: str, most: int) -> set[str]:
    out = {text}
    layer = {text}
    for _ in range(most):
        layer = {t[:k] + t[k + 1 :] for t in layer for k in range(len(t))}
        out |= layer
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two strings; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


def _most(form: str) -> int:
    return 0 if len(form) < 4 else 1 if len(form) < 10 else 2


def _neighbourhoods_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _neighbourhoods(batches, lambda form: 0 if len(form) < 4 else 1 if len(form) < 8 else 2)


def _neighbourhoods(batches: Iterator[pa.RecordBatch], most=_most) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        forms, hashes = [], []
        for form in b.column(0).to_pylist():
            own = {xxhash.xxh64_intdigest(t) - (1 << 63) for t in _deletions(form, most(form))}
            forms += [form] * len(own)
            hashes += own
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(hashes, pa.int64())], names=["form", "key"])


def _score(form: str, candidate: str, own: list[int], other: list[int], mentions: tuple[int, int]) -> float:
    """Log posterior odds that ``form`` is a mistyping of ``candidate``; not positive: it stays by itself.

    Prior odds: attestations of the words that differ.  A word seen in three spellings or fewer is so unlikely to be
    another name within one edit, all other words being equal, that ``RARE`` is added.
    """
    most = min(_most(form), _most(candidate))
    d = edits(form, candidate, most)
    x, y = form.split(), candidate.split()
    if not 0 < d <= most or ("." in x[0] or "." in y[0]) and x[0] != y[0]:
        return -1.0
    if len(x) == len(y) == len(own) == len(other):
        changed = [(n, m) for n, m, u, v in zip(own, other, x, y) if u != v]
    else:  # a blank came or went
        changed = [(min(own), min(other))]
    odds = sum(math.log(m / n) for n, m in changed)
    if odds < 0 or odds == 0 and (mentions, candidate) <= (mentions[::-1], form):
        return -1.0
    if min(len(form), len(candidate)) < SHORT and odds < math.log(RARER):
        return -1.0
    rare = all(n <= 3 for n, _ in changed) and (d == 1 or min(map(len, x[-1:] + y[-1:])) > 7 and odds > 0)
    return odds + d * math.log(TYPO) + RARE * rare


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple[str, str, float]] = []
        for form, candidate, own, other, m1, m2 in zip(*(c.to_pylist() for c in b.columns)):
            score = _score(form, candidate, own, other, (m2, m1))
            if score > 0:
                out.append((form, candidate, score))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))],
            names=["form", "candidate", "score"],
        )


def typo_parents(forms: DataFrame) -> DataFrame:
    """``form, root``: forms that are more likely mistypings of another form, with the end of their chain.

    ``forms``: distinct ``form`` strings with ``n``, their numbers of spellings, and ``m``, of mentions.
    """
    word = forms.select("form", "n", F.posexplode(F.split("form", " ")).alias("at", "word"))
    attested = word.groupBy("word").agg(F.sum("n").alias("a"))
    counts = word.join(attested, "word").groupBy("form").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x.a).alias("counts")
    ).join(forms.select("form", "m"), "form")
    counts = cut(counts)
    # one exchange by key serves both sides of the join
    keys = spread(forms.select("form")).mapInArrow(lambda batches: _neighbourhoods(batches), "form string, key bigint").repartition("key")
    pairs = keys.join(keys.select(F.col("form").alias("candidate"), "key"), "key").where("form <> candidate")
    pairs = pairs.select("form", "candidate").distinct()
    pairs = pairs.join(counts, "form").join(
        counts.select(F.col("form").alias("candidate"), F.col("counts").alias("other"), F.col("m").alias("m2")), "candidate"
    )
    judged = pairs.select("form", "candidate", "counts", "other", "m", "m2").mapInArrow(_judge, "form string, candidate string, score double")
    best = judged.groupBy("form").agg(F.max(F.struct("score", "candidate")).alias("b")).select("form", F.col("b.candidate").alias("root"))
    return ends(best)


def ends(links: DataFrame) -> DataFrame:
    """Follow ``form, root`` to the ends of the chains by pointer doubling.

    Links that point at each other keep the one to the smaller string; longer loops can't be, as ranks rise on all
    links but those from tables.
    """
    back = links.select(F.col("form").alias("root"), F.col("root").alias("form"))
    mutual = links.join(back, ["form", "root"], "left_semi").where("form < root")
    links = cut(links.join(mutual, ["form", "root"], "left_anti"))
    while True:
        up = links.select(F.col("form").alias("root"), F.col("root").alias("next"))
        stepped = cut(links.join(up, "root", "left").select("form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = stepped.select("form", "root")
        if stepped.where("moved").isEmpty():
            return links


def _spellings(df: DataFrame, column: str) -> DataFrame:
    return parts(df, column).groupBy("value").agg(F.count("*").alias("mentions"))


def given_names(spelled: DataFrame, short_forms: DataFrame) -> DataFrame:
    """``given, long``: given names that are short for, cut from or mistypings of another; the likeliest one.

    Priors are the numbers of spellings with each name.  A table says which forms are short; other names are short for
    one they begin, or mistyped from one an edit or two away, if that is at least ``1 / TYPO`` times as frequent an edit.
    """
    counts = cut(spelled.where("given <> ''").groupBy("given").agg(F.count("*").alias("n")))
    other = counts.select(F.col("given").alias("long"), F.col("n").alias("n2"))
    table = short_forms.select(F.lower("short_form").alias("given"), F.lower("given_name").alias("long")).dropna().distinct()
    told = counts.join(table, "given").join(other, "long", "left")
    told = told.select("given", "long", (F.lit(100.0) + F.log(F.coalesce("n2", F.lit(1)))).alias("score"))
    # every beginning of a longer name is a key, so that no bucket of first letters is compared with itself
    begun = other.where(F.length("long") >= 5).select("long", "n2", F.explode(F.sequence(F.lit(3), F.length("long") - 2)).alias("k"))
    begun = begun.select("long", "n2", F.substring("long", F.lit(1), F.col("k")).alias("given"))
    cut_off = counts.join(begun, "given").where(F.col("n2") >= 3 * F.col("n"))
    cut_off = cut_off.select("given", "long", F.log(F.col("n2") / F.col("n")).alias("score"))
    keys = cut(counts.select(F.col("given").alias("form")).mapInArrow(_neighbourhoods_short, "form string, key bigint"))
    near = keys.join(keys.select(F.col("form").alias("long"), "key"), "key").where("form <> long").select("form", "long").distinct()
    near = near.withColumnRenamed("form", "given").join(counts, "given").join(other, "long")
    d = F.levenshtein("given", "long")
    swapped = (d == 2) & (F.array_sort(F.split("given", "")) == F.array_sort(F.split("long", "")))
    cost = F.when(swapped, 1).otherwise(d)
    odds = F.log(F.col("n2") / F.col("n")) + cost * F.lit(math.log(TYPO))
    near = near.where((cost <= F.when(F.length("given") < 8, 1).otherwise(2)) & (odds > 0)).select("given", "long", odds.alias("score"))
    links = told.unionAll(cut_off).unionAll(near).groupBy("given").agg(F.max(F.struct("score", "long")).alias("b"))
    links = links.select(F.col("given").alias("form"), F.col("b.long").alias("root")).where("form <> root")
    return ends(links).select(F.col("form").alias("given"), F.col("root").alias("long"))


def persons(df: DataFrame, short_forms: DataFrame, column: str = "raw_authors") -> DataFrame:
    """``value, mentions, entity`` of every spelling of a person."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value, mentions in zip(*(c.to_pylist() for c in b.columns)):
                if found := person(value):
                    rows.append((value, mentions, *found))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["value", "mentions", "given", "initials", "family"],
            )

    schema = "value string, mentions bigint, given string, initials string, family string"
    spelled = cut(spread(_spellings(df, column)).mapInArrow(run, schema).where("family <> ''"))
    known = given_names(spelled, short_forms)
    spelled = spelled.join(known, "given", "left").withColumn("given", F.coalesce("long", "given")).drop("long")
    first = F.when(F.col("given") != "", F.translate("given", " ", "-"))
    form = F.concat_ws(" ", F.coalesce(first, F.concat(F.substring("initials", 1, 1), F.lit("."))), F.translate("family", " ", "-"))
    spelled = cut(spelled.withColumn("form", form))
    forms = spelled.groupBy("form").agg(F.count("*").alias("n"), F.sum("mentions").alias("m"))
    fixed = typo_parents(forms)
    spelled = spelled.join(fixed, "form", "left").withColumn("form", F.coalesce("root", "form")).drop("root")
    spelled = cut(spelled.withColumn("family", F.element_at(F.split("form", " "), -1)))
    roots = spelled.where("given <> ''").groupBy(F.col("form").alias("root"), "family").agg(
        F.sum("mentions").alias("m"),
        F.max(F.when(F.length("initials") > 1, F.substring("initials", 2, 1))).alias("middle"),
    )
    roots = cut(roots.withColumn("letter", F.substring("root", 1, 1)))
    # initials: the likeliest full name
    few = spelled.where("given = ''").withColumn("letter", F.substring("initials", 1, 1)).withColumn(
        "second", F.when(F.length("initials") > 1, F.substring("initials", 2, 1))
    )
    few = few.select("letter", "second", "family").distinct()
    fit = spread_join(roots, few, ["letter", "family"]).withColumn(
        "score",
        F.log("m")
        + F.when(F.col("second").isNull() | F.col("middle").isNull(), 0.0).when(F.col("second") == F.col("middle"), 3.0).otherwise(-6.0),
    )
    # contradicted by the only middle initial attested: another person, unless nobody else fits
    fit = fit.where(F.col("second").isNull() | F.col("middle").isNull() | (F.col("second") == F.col("middle")))
    fit = fit.groupBy("letter", F.coalesce("second", F.lit("")).alias("second"), "family").agg(F.max(F.struct("score", "root")).alias("b"))
    fit = fit.select("letter", "second", "family", F.col("b.root").alias("root"))
    named = spelled.where("given <> ''").select("value", "mentions", F.col("form").alias("entity"))
    unnamed = spelled.where("given = ''").withColumn("letter", F.substring("initials", 1, 1)).withColumn(
        "second", F.when(F.length("initials") > 1, F.substring("initials", 2, 1)).otherwise(F.lit(""))
    )
    # without a full name: initials agree while only one middle initial is known
    alone = unnamed.join(fit.select("letter", "second", "family"), ["letter", "second", "family"], "left_anti")
    alone = alone.groupBy("letter", "family").agg(
        F.countDistinct(F.when(F.col("second") != "", F.col("second"))).alias("seconds")
    )
    unnamed = unnamed.join(fit, ["letter", "second", "family"], "left").join(alone, ["letter", "family"], "left")
    own = F.concat_ws(" ", F.concat("letter", F.when(F.col("seconds") > 1, F.col("second")).otherwise(F.lit("")), F.lit(".")), F.col("family"))
    unnamed = unnamed.select("value", "mentions", F.coalesce("root", own).alias("entity"))
    return named.unionAll(unnamed)


def organisations(df: DataFrame, column: str = "raw_affiliation") -> DataFrame:
    """``value, mentions, entity`` of every spelling of an organisation."""

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value, mentions in zip(*(c.to_pylist() for c in b.columns)):
                if NO_ORGANISATION.match(value):
                    continue
                found, inner = organisation_parts(value)
                if found:
                    rows.append((value, mentions, found, inner[0] if inner else None))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.list_(pa.string())), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["value", "mentions", "parts", "acronym"]
            )

    schema = "value string, mentions bigint, parts array<array<string>>, acronym string"
    spelled = cut(spread(_spellings(df, column)).mapInArrow(first_pass, schema))
    n = spelled.count()
    each = spelled.select("value", F.explode(F.array_distinct(F.flatten("parts"))).alias("word"))
    words = cut(each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    # every word is judged by its own count; the list below only holds the words others may stand for
    counts = each.join(words, "word").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    counted = spelled.join(counts, "value", "left")
    # at most (words a spelling) / COMMON words
    common = {r["word"]: r["n"] for r in words.where(F.col("n") >= F.lit(max(2.0, COMMON * n))).collect()}

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary([])
        vocabulary.count.update(common)
        for w in sorted(common, key=lambda w: (-common[w], w)):
            vocabulary._by_first.setdefault(w[0], []).append(w)

        def expand(word: str, value: str) -> str:
            dotted = re.search(rf"\b{re.escape(word)}\.", plain(value)) is not None
            if not (dotted or len(word) <= 4) or len(word) < 3:
                return word
            own, listed = count(word), vocabulary.count.pop(word, 0)
            vocabulary._memo.pop(word, None)
            least = 2 * own if dotted else max(3 * own, OWN + 1)
            long = [w for w in vocabulary.expand(word) if vocabulary.count.get(w, 0) >= least and w != word]
            if listed:
                vocabulary.count[word] = listed
            return max(long, key=lambda w: vocabulary.count[w]) if long else word

        near: dict[str, list[str]] = {}
        for w in common:
            if len(w) >= 4:
                for t in _deletions(w, 1 if len(w) < 8 else 2):
                    near.setdefault(t, []).append(w)
        memo: dict[str, str] = {}
        held: dict[str, int] = {}  # spellings with each word of the value in hand

        def count(word: str) -> int:
            return common.get(word) or held.get(word, 1)

        def slip(word: str) -> bool:
            """A mistyped "of", "for", ..."""
            return count(word) <= OWN and near_stop(word)

        def correct(word: str) -> str:
            """The common word this one is most likely a mistyping of, or itself."""
            if len(word) < 3:
                return word
            if word not in memo:
                own, best = math.log(count(word)), (0.0, word)
                most = 1 if len(word) < 8 else 2
                for w in {w for t in _deletions(word, most) for w in near.get(t, ())}:
                    odds = math.log(common[w]) - own
                    if w != word and odds > math.log(5 if len(word) > 4 else 50) * (d := edits(word, w, most)) and d <= most:
                        best = max(best, (odds + d * math.log(TYPO), w))
                memo[word] = best[1]
            return memo[word]

        for b in batches:
            rows = []
            for value, mentions, found, acronym, counts in zip(*(c.to_pylist() for c in b.columns)):
                held.clear()
                held.update(counts or ())
                found = [[correct(expand(w, value)) for w in p if not slip(w)] for p in found]
                found = [p for p in found if p] or [[value.lower()]]
                whole = " ".join(w for p in found for w in p)
                sets = [" ".join(sorted({w for p in found[: len(found) - k] for w in p})) for k in range(len(found))]
                alone = found[0][0] if len(found[0]) == 1 else None
                # a first part with a word of its own names the organisation without its places
                own = len(found[0]) > 1 and min(map(count, found[0])) <= OWN
                rows.append((value, mentions, acronym, whole, len(found), sets, alone, own))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                names=["value", "mentions", "acronym", "form", "n_parts", "sets", "alone", "own"],
            )

    schema = "value string, mentions bigint, acronym string, form string, n_parts int, sets array<string>, alone string, own boolean"
    read = cut(spread(counted.select("value", "mentions", "parts", "acronym", "counts")).mapInArrow(second_pass, schema))
    fixed = typo_parents(read.groupBy("form").agg(F.count("*").alias("n"), F.sum("mentions").alias("m")))
    # a corrected spelling takes the word sets of the spelling it was meant to be
    of_form = read.groupBy("form").agg(F.max(F.struct("n_parts", "sets", "own")).alias("x")).select(F.col("form").alias("root"), "x.sets", "x.own")
    read = read.join(fixed, "form", "left")
    names = ["value", "mentions", "acronym", "sets", "alone", "own"]
    right = read.where("root is null").select(*names)
    wrong = read.where("root is not null").drop("sets", "own").join(of_form, "root").select(*names)
    read = cut(right.unionAll(wrong))
    whole = read.select(F.element_at("sets", 1).alias("k")).unionAll(read.where("own").select(F.element_at("sets", -1).alias("k"))).distinct()
    # the shortest set left by dropping places at the end that someone wrote as a whole
    tried = read.select("value", F.posexplode("sets").alias("dropped", "k")).join(whole, "k")
    chosen = tried.groupBy("value").agg(F.max(F.struct("dropped", "k")).alias("b")).select("value", F.col("b.k").alias("entity"))
    read = cut(read.join(chosen, "value"))
    meaning = read.where("acronym is not null").groupBy(F.col("acronym").alias("alone"), F.col("entity").alias("meant")).agg(F.sum("mentions").alias("m"))
    best = Window.partitionBy("alone").orderBy(F.desc("m"), "meant")  # meanings of one acronym
    meaning = meaning.withColumn("r", F.row_number().over(best)).where("r = 1").select("alone", "meant")
    return read.join(meaning, "alone", "left").select("value", "mentions", F.coalesce("meant", "entity").alias("entity"))


def pairs(linked: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of spellings of one entity, in order of their code points.

    This is the form of the result that was asked for; ``persons`` and ``organisations`` give a row per spelling.
    """
    linked = cut(linked.select("entity", "value"))
    a = linked.withColumnRenamed("value", "name_a")
    b = linked.withColumnRenamed("value", "name_b")
    return spread_join(a, b, ["entity"], least=2000).where("name_a < name_b").select("name_a", "name_b")
