"""String functions over whole columns."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merging
from ..session import spread_scan, table
from . import query, sql

A = "articles_df"


def each(name, expression, statement, source=A, key="id", words=None):
    """Register a query that gives ``key`` and ``out`` for each row of a table."""

    def run(spark, d):
        rows = spread_scan(table(spark, d, source))
        if words is not None:  # tokenised once, not once in every lambda
            rows = rows.select(key, words().alias("words"))
        return rows.select(key, expression().alias("out"))

    query(f"SELECT {key}, {statement} AS out FROM {source}", name)(run)


each("str_lev", lambda: F.round(T.similarity(F.lower("dataset"), F.lower("exact_study_type")), 6),
     "round(1 - levenshtein(lower(dataset), lower(exact_study_type)) / greatest(length(dataset), length(exact_study_type)), 6)", "study_type_df")
each("str_unaccent", lambda: T.unaccent("title"), sql.unaccent("title"))
each("str_unaccent_exact", lambda: T.unaccent_exact("journal"), sql.unaccent("journal"))
each("str_unicode_esc", lambda: T.drop_escapes("abstract"),
     r"CASE WHEN regexp_matches(abstract, '<\s*U\s*\+([A-Za-z0-9_]{4})\s*>') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract, '<\s*U\s*\+([A-Za-z0-9_]{4})\s*>', ' ; ', 'g'), '([.:;!?])\s*;', '\1', 'g'), '^\s*;\s*', ''), '\s*;\s*', ' ; ', 'g') ELSE abstract END")
each("str_norm", lambda: T.normal_text("abstract"), sql.join(sql.words("abstract")))
each("str_is_abbr", lambda: F.size(F.filter(T.normal_words("title", lower=False), T.is_abbreviation)),
     f"length(list_filter({sql.words('title', lower=False)}, lambda w: {sql.abbreviation('w')}))::INT")
each("str_norm_abbr", lambda: F.array_join(F.transform(F.filter(T.normal_words("abstract", lower=False), T.is_abbreviation), T.normal_abbreviation), " "),
     sql.join(f"list_transform(list_filter({sql.words('abstract', lower=False)}, lambda w: {sql.abbreviation('w')}), lambda w: regexp_replace(w, 's$', ''))"))
each("str_lemma", lambda: F.array_join(F.transform(T.normal_words("title"), T.lemma), " "),
     sql.join(f"list_transform({sql.words('title')}, lambda w: {sql.lemma('w')})"))
each("str_tokens", lambda: T.token_list("abstract"), sql.tokens("abstract"))
each("str_norm_sentence", lambda: T.normal_sentence("title"), sql.join(sql.tokens("title")))
each("str_key_full", lambda: T.key_sorted("title"), sql.join(f"list_sort({sql.tokens('title')})"))
_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
each("str_copyright", lambda: T.drop_copyright("abstract"),
     r"CASE WHEN lower(regexp_replace(abstract, '[\[\]]', '', 'g')) = 'no abstract available' THEN '' ELSE "
     + _STRIP.format(x=r"regexp_replace(regexp_replace(" + _STRIP.format(x=r"regexp_extract(abstract, '(?s)^(.*?)(?:©|\(c\)|\(C\)|\z)', 1)") + r", '([C|c])opyright ?\.?', '', 'g'), '\s+', ' ', 'g')") + " END")
each("str_html", lambda: T.drop_html("abstract"),
     r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(abstract, '<.+?>', '', 'g'), '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '&amp;', '&'), '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&nbsp;', ' '), '&[A-Za-z0-9_]+;', ' ', 'g'), '\s+', ' ', 'g')""")
_BRACES = r"regexp_replace(regexp_replace({x}, '\{{[^A-Za-z0-9_%&#}}]*(?:([A-Za-z0-9])(?:[^A-Za-z0-9_}}][^}}]*)?|([%&#])[^}}]*)\}}', '\1\2', 'g'), '\{{[^}}\n]*\}}', '', 'g')"
each("str_braces", lambda: T.drop_braces("journal"), _BRACES.format(x="journal"))
each("str_trim_punct", lambda: T.trim_punctuation("title"),
     r"regexp_replace(regexp_replace(title, '^[,.;?!\s]+', ''), '[,.;?!\s]+$', '') || regexp_extract(regexp_replace(regexp_extract(regexp_replace(title, '^[,.;?!\s]+', ''), '([,.;?!\s]*)$', 1), '(?s).$', ''), '([.?!])', 1)")
_PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(keywords, ''), '[,;]'), lambda w: trim(w)), lambda w: w <> '' AND NOT contains(lower(w), 'full text'))"
each("str_kw_search", lambda: T.keyword_search("keywords"),
     sql.join(f"list_filter(list_transform({_PARTS}, lambda k: {sql.join(sql.words('k', lower=False))}), lambda w: w <> '')", " ; "))
each("str_split_parts", lambda: T.split_parts(T.unaccent("title")),
     rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({sql.unaccent('title')}, '\b(and|or)\b', ',', 'g'), '\(\s*[A-Za-z0-9_]{{1,4}}\s*\)|\[\s*[A-Za-z0-9_]{{1,4}}\s*\]', ',', 'g'), '[()\[\];:]', ',', 'g'), ','), lambda w: trim(w)), lambda w: w <> '')")
each("str_split_punct", lambda: T.split_punctuation(T.unaccent("abstract")),
     rf"list_filter(string_split(regexp_replace({sql.unaccent('abstract')}, '[,;.!?:()]+|\b(and|or)\b', chr(1), 'g'), chr(1)), lambda w: w <> '')")
each("str_sent", lambda: T.split_sentences("abstract"),
     r"list_filter(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '')")
each("str_country", lambda: T.country_name("raw_university_name"),
     sql.unaccent(sql.trimmed(r"regexp_replace(trim(split_part(raw_university_name, ',', 1)), '\(.*?\)|\[.*?\]', ' ', 'g')")), "affiliation_map", "affiliation_id")
each("str_contains_any", lambda: T.contains_any(F.lower("abstract"), ["irrigation", "compost", "maize"]),
     "list_bool_or([contains(lower(abstract), 'irrigation'), contains(lower(abstract), 'compost'), contains(lower(abstract), 'maize')])")
each("str_contains_full", lambda: T.contains_full(F.lower("abstract"), ["farmer", "plot", "goat"]),
     "regexp_matches(lower(abstract), '(?:^|[^A-Za-z0-9_])(?:farmer|plot|goat)s?s?(?:[^A-Za-z0-9_]|$)')")
each("str_contains_verb", lambda: T.contains_verb(F.lower("abstract"), ["reduce", "lower"]),
     "(contains(lower(abstract), 'reduce') OR contains(lower(abstract), 'reduc') OR contains(lower(abstract), 'lower'))")
each("str_digit1", lambda: T.has_lone_digit("title"),
     r"length(list_filter(regexp_split_to_array(title, '\s+'), lambda w: regexp_matches(w, '[0-9]') AND length(regexp_replace(w, '[0-9]', '', 'g')) < 2)) > 0")
each("str_word_in", lambda: T.has_word("title", ["study", "survey", "trial"]),
     r"list_has_any(regexp_split_to_array(lower(title), '\s+'), ['study', 'survey', 'trial'])")
each("str_keep_nonstop", lambda: T.keep_content("title"),
     sql.join(f"list_filter(string_split({sql.trimmed('title')}, ' '), lambda w: NOT list_contains({sql.STOP}, lower(w)) AND NOT list_contains({sql.STOP}, {sql.lemma('lower(w)')}))"))
each("str_geo_norm", lambda: T.geo_words("raw_university_name"),
     sql.join(f"list_filter(string_split({sql.trimmed(chr(40) + 'split_part(raw_university_name, ' + repr(',') + ', 1))')}, ' '), lambda w: NOT list_contains({sql.STOP}, lower(w)) AND NOT {sql.abbreviation('w')})"), "affiliation_map", "affiliation_id")
each("str_journal", lambda: T.journal_part("journal"), r"""(WITH p AS (SELECT list_transform(string_split(%s, ';'), lambda w: trim(w)) AS l)
 SELECT CASE WHEN length(list_filter(l, lambda w: lower(w) LIKE 'vol.%%')) > 0 THEN l[1] ELSE trim(split_part(l[-1], ',', 1)) END FROM p)""" % _BRACES.format(
    x=r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(journal, '<.+?>', '', 'g'), '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '&amp;', '&'), '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&nbsp;', ' '), '&[A-Za-z0-9_]+;', ' ', 'g'), '\s+', ' ', 'g')"""))
each("str_keywords", lambda: F.filter(F.transform(T.keyword_parts("keywords"), lambda w: F.lower(T.normal_text(w))), lambda w: w != ""),
     f"list_filter(list_transform({_PARTS}, lambda k: lower({sql.join(sql.words('k'))})), lambda w: w <> '')")
each("str_kw_cols", lambda: T.keyword_columns("keywords"),
     f"array_to_string(CASE WHEN length({_PARTS}) > 5 AND 2 * length(list_filter({_PARTS}, lambda w: {sql.upper('w')})) >= length({_PARTS}) THEN list_transform({_PARTS}, lambda w: CASE WHEN {sql.upper('w')} THEN lower(w) ELSE w END) ELSE {_PARTS} END, '; ')")
each("str_title_case", lambda: F.array_join(F.transform(T.normal_words("journal", lower=False), T.title_case), " "),
     sql.join(f"list_transform({sql.words('journal', lower=False)}, lambda w: CASE WHEN {sql.upper('w')} THEN upper(w[1]) || lower(w[2:]) ELSE w END)"))
each("str_subexpr", lambda: F.array_sort(T.sub_phrases(F.lower("journal_name"))),
     "list_sort(list_distinct(flatten(list_transform(range(1, length(string_split(lower(journal_name), ' ')) + 1), lambda i: list_transform(range(1, least(3, length(string_split(lower(journal_name), ' ')) - i + 1) + 1), lambda k: array_to_string(string_split(lower(journal_name), ' ')[i:i + k - 1], ' '))))))", "journal_list", "journal_id")
each("str_sorted_words", lambda: T.sorted_words("normalized_name"),
     sql.join(f"list_sort(string_split({sql.trimmed('lower(normalized_name)')}, ' '))"), "affiliation_map", "affiliation_id")
each("str_ocr_junk", lambda: T.drop_ocr_junk("text"), "regexp_replace(text, '[sencmaruotv]{15,}', '', 'g')", "documents", "doc_id")
each("str_access_to", lambda: T.access_to("abstract"), "regexp_replace(abstract, '(access|accessing|accessed) ', 'access to ', 'g')")
_SHORT = r"(regexp_matches(w, '^[\p{L}\p{N}_ -]*$') AND length(list_filter(regexp_split_to_array(w, '\s+'), lambda v: v <> '')) < 2)"
each("str_semi_head", lambda: T.semicolon_head("keywords"),
     rf"""(WITH p AS (SELECT string_split(keywords, ';') AS l), q AS (SELECT l, list_min(list_filter(list_transform(range(1, length(l) + 1), lambda i: CASE WHEN NOT (list_transform(l, lambda w: {_SHORT}))[i] THEN i END), lambda i: i IS NOT NULL)) AS f FROM p)
 SELECT CASE WHEN NOT contains(keywords, ';') OR f = 1 THEN keywords ELSE trim(coalesce(array_to_string(CASE WHEN f IS NULL THEN [] ELSE l[f:] END, ';'), '')) END FROM q)""")
each("ngram_win", lambda: T.bigrams(F.col("words")),
     f"(WITH p AS (SELECT {sql.tokens('title')} AS l) SELECT list_transform(range(1, length(l)), lambda i: l[i] || ' ' || l[i + 1]) FROM p)", words=lambda: T.token_list("title"))
each("win_text", lambda: T.windows(F.col("words"), 256, 128),
     f"(WITH p AS (SELECT string_split({sql.trimmed('text')}, ' ') AS l) SELECT list_transform(range(0, greatest(length(l), 1), 128), lambda i: array_to_string(l[i + 1:i + 256], ' ')) FROM p)", "documents", "doc_id", words=lambda: F.split(T.squeeze("text"), " "))


@query(f"""WITH w AS (SELECT DISTINCT unnest({sql.tokens('title')}) AS w FROM articles_df), v AS (SELECT w FROM w WHERE length(w) > 5 AND regexp_matches(w, '^[a-z]+$'))
SELECT a.w AS word_a, b.w AS word_b FROM v a JOIN v b ON substr(a.w, 1, 2) = substr(b.w, 1, 2) AND length(a.w) = length(b.w) AND a.w < b.w
WHERE length(list_filter(range(3, length(a.w)), lambda i: substr(a.w, 1, i - 1) = substr(b.w, 1, i - 1) AND substr(a.w, i + 1) = substr(b.w, i + 1) AND ((a.w[i] = 's' AND b.w[i] = 'z') OR (a.w[i] = 'z' AND b.w[i] = 's')))) > 0""")
def str_zs(spark, d):
    w = table(spark, d, A).select(F.explode(T.token_list("title")).alias("w")).distinct().where("length(w) > 5 and w rlike '^[a-z]+$'")
    pairs = merging.sibilant_pairs(w.toDF("item"), w.toDF("other")).where("item < other")
    return pairs.distinct().toDF("word_a", "word_b")


@query(r"SELECT lower(journal_name) AS a, lower(short_name) AS b, (1 - levenshtein(lower(journal_name), lower(short_name)) / greatest(length(journal_name), length(short_name))) >= 0.7 AS similar FROM journal_list WHERE short_name IS NOT NULL")
def str_similar(spark, d):
    j = table(spark, d, "journal_list").where("short_name is not null")
    a, b = F.lower("journal_name"), F.lower("short_name")
    return j.select(a.alias("a"), b.alias("b"), T.similar(a, b, 0.7).alias("similar"))


@query(f"""WITH df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT id, unnest({sql.tokens('title')}) AS w FROM articles_df) GROUP BY w),
r AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM df), k AS (SELECT w, r FROM r WHERE r <= 5000),
x AS (SELECT id, unnest({sql.tokens('title')}) AS w FROM articles_df)
SELECT id, round(avg(coalesce(r, 5000) / 5000), 6) AS score FROM x LEFT JOIN k USING (w) GROUP BY id""")
def str_common(spark, d):
    """Mean frequency rank (of 5000) of the words of each title."""
    from pyspark.sql import Window

    a = table(spark, d, A)
    words = a.select("id", F.explode(T.token_list("title")).alias("w"))
    df = words.distinct().groupBy("w").agg(F.count("*").alias("n"))
    top = df.orderBy(F.desc("n"), "w").limit(5000)  # the list has 5000 ranks
    ranks = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "w"))).select("w", "r")
    scored = words.join(F.broadcast(ranks), "w", "left")
    return scored.groupBy("id").agg(F.round(F.avg(F.coalesce("r", F.lit(5000)) / 5000), 6).alias("score"))
