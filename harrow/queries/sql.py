"""Pieces of SQL that several statements share."""

from ..functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def unaccent(x: str) -> str:
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def upper(w: str) -> str:
    return f"(upper({w}) = {w} AND lower({w}) <> {w})"


def abbreviation(w: str) -> str:
    body = f"regexp_replace({w}, 's$', '')"
    return f"({upper(w)} OR ({w} LIKE '%s' AND length({w}) > 1 AND {upper(body)}))"


def words(x: str, lower: bool = True) -> str:
    raw = rf"list_filter(string_split(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]'))"
    bare = f"list_filter(list_transform({raw}, lambda w: {unaccent('w')}), lambda w: w <> '')"
    if not lower:
        return bare
    return f"list_transform({bare}, lambda w: CASE WHEN {abbreviation('w')} THEN regexp_replace(w, 's$', '') ELSE lower(w) END)"


def lemma(w: str) -> str:
    return (
        f"CASE WHEN {w} IN ('assess', 'assesses') THEN 'assess' WHEN regexp_matches({w}, '(ss|x|z|ch|sh)es$') THEN regexp_replace({w}, 'es$', '') "
        f"WHEN regexp_matches({w}, '^.{{2,}}ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, 'men$') THEN regexp_replace({w}, 'men$', 'man') "
        f"WHEN regexp_matches({w}, '^.{{2,}}s$') AND NOT regexp_matches({w}, '(ss|us|is)$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    )


def tokens(x: str) -> str:
    kept = f"list_filter({words(x)}, lambda w: ({abbreviation('w')} OR length(w) > 1) AND NOT list_contains({STOP}, w))"
    return f"list_transform({kept}, lambda w: CASE WHEN {abbreviation('w')} THEN w ELSE {lemma('w')} END)"


def join(x: str, sep: str = " ") -> str:
    return f"array_to_string({x}, '{sep}')"


def trimmed(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '^ +| +$', '', 'g')"
