"""Authors, affiliations, geography, relations, extractors and word repair."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import labelling as L
from ..operators import merging
from ..operators import relations as X
from ..session import table
from . import query, sql

A = "articles_df"


def lit(x):
    return "'" + x.replace("'", "''") + "'"


@query(r"""WITH p AS (SELECT id, list_transform(string_split(regexp_replace(regexp_replace(raw_authors, '\bet al\.?|\([^()]*\)|\[[^\[\]]*\]|[0-9]+', ' ', 'g'), '\band\b', ';', 'g'), ';'),
 lambda w: regexp_replace(regexp_replace(regexp_replace(w, ',', ' ', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g')) AS l FROM articles_df),
q AS (SELECT id, list_transform(l, lambda w: regexp_replace(CASE WHEN (length(split_part(w, ' ', 1)) < 3 OR contains(split_part(w, ' ', 1), '.')) AND regexp_extract(w, '^[^ ]+ (.*)$', 1) <> ''
 THEN regexp_extract(w, '^[^ ]+ (.*)$', 1) || ' ' || split_part(w, ' ', 1) ELSE w END, '\.', '', 'g')) AS l FROM p)
SELECT id, list_filter(l, lambda w: length(w) > 3 AND NOT contains(w, '?')) AS names FROM q""")
def au_names(spark, d):
    return table(spark, d, A).select("id", E.author_names("raw_authors").alias("names"))


_AFF = rf"""e AS (SELECT id, unnest(string_split(raw_affiliation, ';')) AS x FROM articles_df),
p AS (SELECT id, trim(x) AS raw, list_filter(list_transform(string_split(trim(x), ','), lambda w: array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(w),
 'p\.? ?o\.? box *[0-9]*|\([^()]*\)|[0-9]+|campus', ' ', 'g'), '[^a-z'' ]', ' ', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g'), ' '), lambda v: length(v) > 1 AND NOT list_contains({sql.STOP}, v)), ' ')), lambda w: w <> '') AS l FROM e WHERE trim(x) <> ''),
i AS (SELECT id, raw, coalesce({", ".join(f"list_filter(l, lambda w: contains(w, {lit(m)}))[-1]" for m in E.INSTITUTION)}, array_to_string(l, ' ')) AS institution, l FROM p)"""


def _affiliations(spark, d):
    e = table(spark, d, A).select("id", F.explode(F.split("raw_affiliation", ";")).alias("x")).select("id", F.trim("x").alias("raw")).where("raw <> ''")
    e = e.select("id", "raw", E.affiliation_parts(F.col("raw")).alias("l"))
    return e.select("id", "raw", "l", E.institution(F.col("l")).alias("institution"))


@query(f"WITH {_AFF} SELECT id, raw, institution FROM i")
def af_parse(spark, d):
    return _affiliations(spark, d).select("id", "raw", "institution")


@query(f"WITH {_AFF}, c AS (SELECT DISTINCT lower(country) AS country FROM affiliation_map) SELECT id, raw, CASE WHEN regexp_matches(raw, '\\b(USA|US)\\b') THEN 'united states' ELSE c.country END AS country FROM i LEFT JOIN c ON c.country = l[-1]")
def af_country(spark, d):
    c = table(spark, d, "affiliation_map").select(F.lower("country").alias("country")).distinct()
    a = _affiliations(spark, d).withColumn("last", F.try_element_at("l", F.lit(-1)))
    j = a.join(c, F.col("last") == F.col("country"), "left")
    return j.select("id", "raw", F.when(F.col("raw").rlike(r"\b(USA|US)\b"), "united states").otherwise(F.col("country")).alias("country"))


@query("""WITH n AS (SELECT affiliation_id AS id, country, lower(normalized_name) AS n, regexp_replace(regexp_replace(regexp_replace(lower(normalized_name), 'university|institute|research|center|centre|department|college', ' ', 'g'), '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS c FROM affiliation_map)
SELECT a.id AS id_a, b.id AS id_b FROM n a JOIN n b ON a.country = b.country AND a.id < b.id WHERE 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.88 OR 1 - levenshtein(a.c, b.c) / greatest(length(a.c), length(b.c), 1) >= 0.88
OR 1 - levenshtein(array_to_string(list_sort(string_split(a.c, ' ')), ' '), array_to_string(list_sort(string_split(b.c, ' ')), ' ')) / greatest(length(a.c), length(b.c), 1) >= 0.88""")
def af_remap_country(spark, d):
    n = table(spark, d, "affiliation_map").select(F.col("affiliation_id").alias("id"), "country", F.lower("normalized_name").alias("n"))
    n = n.withColumn("c", E.core_name(F.col("n"))).withColumn("s", F.array_join(F.array_sort(F.split("c", " ")), " "))
    found = None
    for form in ("n", "c", "s"):  # the name, its own words, and these in order of the alphabet
        x = n.select(F.col(form).alias("item"))
        near = merging.similar_pairs(x, 0.88).unionAll(x.select("item", F.col("item").alias("other")).distinct())
        j = near.join(n.select(F.col("id").alias("id_a"), F.col("country").alias("land_a"), F.col(form).alias("item")), "item")
        j = j.join(n.select(F.col("id").alias("id_b"), F.col("country").alias("land_b"), F.col(form).alias("other")), "other")
        j = j.where("id_a < id_b and land_a = land_b").select("id_a", "id_b")
        found = j if found is None else found.unionAll(j)
    return found.distinct()


@query("""SELECT a.affiliation_id AS id_a, b.affiliation_id AS id_b FROM affiliation_map a JOIN affiliation_map b ON substr(lower(a.normalized_name), 1, 2) = substr(lower(b.normalized_name), 1, 2) AND a.affiliation_id < b.affiliation_id
AND (a.country = b.country OR a.city = b.city) WHERE 1 - levenshtein(lower(a.normalized_name), lower(b.normalized_name)) / greatest(length(a.normalized_name), length(b.normalized_name)) >= 0.8""")
def af_remap_prefix(spark, d):
    n = table(spark, d, "affiliation_map").select("affiliation_id", F.lower("normalized_name").alias("n"), "city", "country")
    near = merging.similar_pairs(n.select(F.col("n").alias("item")), 0.8).where("left(item, 2) = left(other, 2)")
    near = near.unionAll(n.select(F.col("n").alias("item"), F.col("n").alias("other")).distinct()).toDF("na", "nb")
    j = near.join(n.toDF("id_a", "na", "city_a", "land_a"), "na").join(n.toDF("id_b", "nb", "city_b", "land_b"), "nb")
    return j.where("id_a < id_b and (land_a = land_b or city_a = city_b)").select("id_a", "id_b")


_SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"


@query(f"""WITH {_AFF}, h AS (SELECT id, raw, {_SORTED.format(x=sql.unaccent("trim(lower(split_part(raw, ',', 1)))"))} AS k FROM i),
m AS (SELECT {_SORTED.format(x=sql.unaccent('lower(normalized_name)'))} AS k, min(affiliation_id) AS ref FROM affiliation_map GROUP BY 1),
s AS (SELECT d.k, ref, 1 - levenshtein(d.k, m.k) / greatest(length(d.k), length(m.k)) AS s FROM (SELECT DISTINCT k FROM h WHERE k <> '') d, m WHERE m.k <> ''),
best AS (SELECT k, arg_min(ref, (-s, ref)) AS ref FROM s WHERE s >= 0.88 GROUP BY k) SELECT id, raw, ref FROM h JOIN best USING (k)""")
def af_pipeline(spark, d):
    """Affiliations with the listed name most like their first part, words in any order, from a similarity of 0.88 on."""
    words = lambda c: F.array_join(F.array_sort(F.split(T.unaccent(c), " ")), " ").alias("k")
    m = table(spark, d, "affiliation_map").groupBy(words(F.lower("normalized_name"))).agg(F.min("affiliation_id").alias("ref")).where("k <> ''")
    a = _affiliations(spark, d).select("id", "raw", words(F.trim(F.lower(F.split_part("raw", F.lit(","), F.lit(1))))))
    typed, listed = a.select("k").where("k <> ''").distinct(), m.select("k")
    near = merging.near_pairs(typed.toDF("item"), listed.toDF("other"), 0.88).toDF("k", "name")
    near = near.unionAll(merging.near_pairs(listed.toDF("item"), typed.toDF("other"), 0.88).toDF("name", "k").select("k", "name")).distinct()
    like = near.withColumn("s", T.similarity("k", "name")).where("s >= 0.88").join(m.toDF("name", "ref"), "name")
    best = like.groupBy("k").agg(F.min(F.struct((-F.col("s")).alias("s"), "ref")).alias("b")).select("k", F.col("b.ref").alias("ref"))
    return a.join(best, "k").select("id", "raw", "ref")


_GAZ = r"""w AS (SELECT id, string_split(regexp_replace(abstract, '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS l FROM articles_df WHERE abstract IS NOT NULL),
t AS (SELECT id, unnest(l) AS name, unnest(range(0, length(l)))::INT AS pos FROM w)"""


def _mentions(spark, d, column):
    gaz = table(spark, d, "affiliation_map").select(F.col(column).alias("name"))
    return E.place_mentions(table(spark, d, A).select("id", "abstract"), "id", "abstract", gaz)


@query(f"WITH {_GAZ} SELECT id, list_sort(list_distinct(list(name))) AS countries FROM t WHERE name IN (SELECT country FROM affiliation_map) GROUP BY id")
def gx_country(spark, d):
    return _mentions(spark, d, "country").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("countries"))


@query(f"WITH {_GAZ} SELECT id, arg_max(name, pos) AS city FROM t WHERE name IN (SELECT city FROM affiliation_map) GROUP BY id")
def gx_city(spark, d):
    return _mentions(spark, d, "city").groupBy("id").agg(F.max_by("name", "pos").alias("city"))


@query(f"WITH {_GAZ}, c AS (SELECT DISTINCT city, country FROM affiliation_map) SELECT id, list_sort(list_distinct(list(country || '/' || city))) AS places FROM t JOIN c ON name = city GROUP BY id")
def gx_prefix(spark, d):
    c = table(spark, d, "affiliation_map").select(F.col("city").alias("name"), "country").distinct()
    return _mentions(spark, d, "city").join(c, "name").groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "country", "name"))).alias("places"))


@query("SELECT n_nationkey, n_name, list_sort(list_distinct(list(r_name))) AS regions, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def gx_regions(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return n.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_set("r_name")).alias("regions"), F.max(F.coalesce("n", F.lit(0))).alias("n_suppliers"))


@query("""SELECT id, list_sort(list_distinct(list(country))) AS countries FROM (SELECT id, unnest(string_split(regexp_replace(lower(title), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM articles_df) JOIN (SELECT DISTINCT lower(country) AS k, country FROM affiliation_map) ON w = k GROUP BY id""")
def gx_search(spark, d):
    w = table(spark, d, A).select("id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("title"), "[^a-z]+", " "), " "))).alias("k"))
    c = table(spark, d, "affiliation_map").select(F.lower("country").alias("k"), "country").distinct()
    return w.join(c, "k").groupBy("id").agg(F.array_sort(F.collect_set("country")).alias("countries"))


@query("""WITH w AS (SELECT DISTINCT id, unnest(string_split(regexp_replace(lower(title), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM articles_df) SELECT id, w AS name FROM w WHERE w IN (SELECT lower(city) FROM affiliation_map UNION SELECT lower(country) FROM affiliation_map)""")
def se_small_ctx(spark, d):
    """All gazetteer names of each text in one join, instead of an index over one text at a time."""
    a = table(spark, d, "affiliation_map")
    g = a.select(F.lower("city").alias("name")).union(a.select(F.lower("country"))).distinct()
    w = table(spark, d, A).select("id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("title"), "[^a-z]+", " "), " "))).alias("name"))
    return w.join(g, "name", "left_semi").select("id", "name")


# ---- relations

_REL = X.hearst_sql()


def relations(spark, d):
    return X.hearst(table(spark, d, A).select("id", "abstract"), "id", "abstract")


@query(f"WITH {_REL} SELECT id, general, special FROM rel")
def rx_hearst(spark, d):
    return relations(spark, d)


@query(f"WITH {_REL} SELECT general, special, count(*) AS n, count(DISTINCT id) AS n_docs FROM rel GROUP BY ALL")
def ag_total_freq(spark, d):
    return X.pair_counts(relations(spark, d), "id")


@query(f"""WITH {_REL} SELECT special AS source, general AS target, 'relation' AS type, count(DISTINCT id) AS weight FROM rel GROUP BY ALL
UNION ALL SELECT special, string_split(special, ' ')[-1], 'last word', count(DISTINCT id) FROM rel WHERE contains(special, ' ') GROUP BY special""")
def hs_edges(spark, d):
    return X.edges(relations(spark, d), "id")


_W = f"w AS (SELECT DISTINCT id, unnest({sql.tokens('abstract')}) AS w FROM articles_df), f AS (SELECT w, count(*) AS df FROM w GROUP BY w)"


@query(f"WITH {_REL}, {_W} SELECT special, any_value(df) AS df, count(DISTINCT rel.id) AS n_related FROM rel JOIN f ON w = special GROUP BY special")
def hs_mentions(spark, d):
    freq = table(spark, d, A).select("id", F.explode(F.array_distinct(T.token_list("abstract"))).alias("special")).groupBy("special").agg(F.count("*").alias("df"))
    r = relations(spark, d).groupBy("special").agg(F.count_distinct("id").alias("n_related"))
    return r.join(freq, "special").select("special", "df", "n_related")


@query(f"WITH {_REL} SELECT DISTINCT special, array_to_string(list_filter(string_split(special, ' '), lambda w: length(w) > 1 AND NOT list_contains({sql.STOP}, w)), ' ') AS clean FROM rel")
def hs_clean(spark, d):
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    words = F.filter(F.split("special", " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    return relations(spark, d).select("special").distinct().select("special", F.array_join(words, " ").alias("clean"))


@query(f"""WITH {_REL}, p AS (SELECT special, general, count(DISTINCT id) AS m FROM rel GROUP BY ALL), s AS (SELECT special, count(DISTINCT id) AS n FROM rel GROUP BY special)
SELECT special AS narrow, general AS broad, n AS narrow_docs, m AS pair_docs, length(string_split(special, ' '))::INT AS n_words, {sql.upper('special')} AS is_abbreviation FROM p JOIN s USING (special)""")
def hs_info(spark, d):
    r = relations(spark, d)
    p = r.groupBy("special", "general").agg(F.count_distinct("id").alias("pair_docs"))
    s = r.groupBy("special").agg(F.count_distinct("id").alias("narrow_docs"))
    return p.join(s, "special").select(
        F.col("special").alias("narrow"), F.col("general").alias("broad"), "narrow_docs", "pair_docs",
        F.size(F.split("special", " ")).alias("n_words"), ((F.upper("special") == F.col("special")) & (F.lower("special") != F.col("special"))).alias("is_abbreviation"),
    )


@query(f"""WITH {_REL}, c AS (SELECT special, count(DISTINCT id) AS df FROM rel WHERE general IN ('legumes', 'crops', 'cereals') GROUP BY special) SELECT special AS crop, df FROM c WHERE df < least(3000, (SELECT count(*) FROM articles_df) / 10)""")
def ce_crops(spark, d):
    n = table(spark, d, A).count()
    c = relations(spark, d).where("general in ('legumes', 'crops', 'cereals')").groupBy(F.col("special").alias("crop")).agg(F.count_distinct("id").alias("df"))
    return c.where(F.col("df") < min(3000, n / 10))


@query(f"WITH {_REL} SELECT a.general, a.special AS special_a, b.special AS special_b, count(DISTINCT a.id) AS n FROM rel a JOIN rel b ON a.id = b.id AND a.general = b.general AND a.special < b.special GROUP BY ALL")
def rx_pairs(spark, d):
    r = relations(spark, d)
    j = r.withColumnRenamed("special", "special_a").join(r.withColumnRenamed("special", "special_b"), ["id", "general"]).where("special_a < special_b")
    return j.groupBy("general", "special_a", "special_b").agg(F.count_distinct("id").alias("n"))


@query(f"WITH {_REL} SELECT general, list_sort(list_distinct(list(regexp_replace(special, 's$', '')))) AS specials FROM rel GROUP BY general")
def rx_merge(spark, d):
    return relations(spark, d).groupBy("general").agg(F.array_sort(F.collect_set(F.regexp_replace("special", "s$", ""))).alias("specials"))


# ---- extractors

_SENT = r"s AS (SELECT id, unnest(list_filter(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '')) AS s FROM articles_df)"


def _sentences(spark, d):
    return table(spark, d, A).select("id", F.explode(T.split_sentences("abstract")).alias("s"))


_MARKED = r"regexp_replace(regexp_replace(lower(abstract), '\s+', ' ', 'g'), 'compared ([a-z -]+) and ([a-z -]+) for their effect', 'comparison of \1 and \2 with', 'g')"


@query(f"WITH src AS (SELECT id, {_MARKED} AS abstract FROM articles_df), {X.hearst_sql('src', comparison=True)} SELECT id, list_sort(list_distinct(list(special))) AS compared FROM rel WHERE general = 'compared' GROUP BY id")
def lb_compare(spark, d):
    """What each article compares with each other, by the cues of comparison."""
    return L.compared_terms(table(spark, d, A).select("id", "abstract"), ["abstract"])


_PROG = r"((?:[A-Z][a-z]+ )+(?:Program|Programme|Project|Initiative|Centre|Trust))"


@query(f"SELECT program, count(*) AS n FROM (SELECT unnest(regexp_extract_all(raw_affiliation, '{_PROG}')) AS program FROM articles_df) WHERE length(program) > 12 GROUP BY program")
def pe_find(spark, d):
    p = table(spark, d, A).select(F.explode(F.regexp_extract_all("raw_affiliation", F.lit(_PROG), F.lit(0))).alias("program"))
    return p.where("length(program) > 12").groupBy("program").agg(F.count("*").alias("n"))


_OUT = {"Income": ["income", "returns", "costs"], "Yield": ["yield", "yields", "germination"], "Water": ["water", "runoff", "irrigation"]}


@query(r"""SELECT id, CASE WHEN p < 0.1 THEN 'Unlikely' WHEN p < 0.4 THEN 'Less likely' ELSE 'More likely' END AS priority FROM (SELECT id, least(1.0, length(regexp_extract_all(lower(coalesce(abstract, '')), 'trial|survey|evidence|randomised')) / 4.0) AS p FROM articles_df)""")
def lb_priority(spark, d):
    p = F.least(F.lit(1.0), F.size(F.regexp_extract_all(F.lower(F.coalesce("abstract", F.lit(""))), F.lit("trial|survey|evidence|randomised"), F.lit(0))) / 4.0)
    return table(spark, d, A).select("id", F.when(p < 0.1, "Unlikely").when(p < 0.4, "Less likely").otherwise("More likely").alias("priority"))


_EXT = ["intervention", "systems", "services", "plans", "tests"]


# ---- word repair

_FREQ = f"f AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT id, unnest(string_split(regexp_replace({sql.unaccent('abstract')}, '[^A-Za-z]+', ' ', 'g'), ' ')) AS w FROM articles_df WHERE abstract IS NOT NULL) WHERE w <> '' GROUP BY w)"


@query(f"WITH {_FREQ} SELECT a.w, b.w AS low FROM f a JOIN f b ON lower(a.w) = b.w WHERE a.w = upper(a.w) AND length(a.w) > 1 AND a.w <> b.w AND b.df > 3 * a.df")
def nz_upper(spark, d):
    return X.upper_to_lower(X.word_df(table(spark, d, A).select("id", "abstract"), "id", "abstract"))


@query(f"""WITH {_FREQ}, s AS (SELECT unnest({sql.STOP}) AS stop), c AS (SELECT w FROM f WHERE w = lower(w) AND df > 70 AND length(w) > 3), r AS (SELECT w FROM f WHERE w = lower(w) AND df <= 5)
SELECT DISTINCT r.w, stop || ' ' || c.w AS fixed FROM r, s, c WHERE length(stop) > 1 AND r.w = stop || c.w UNION SELECT DISTINCT r.w, c.w || ' ' || stop FROM r, s, c WHERE length(stop) > 1 AND r.w = c.w || stop""")
def nz_glued(spark, d):
    return X.glued(X.word_df(table(spark, d, A).select("id", "abstract"), "id", "abstract"))


@query(r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract, '<.+?>', '', 'g'), '\{[^}\n]*\}', '', 'g'), '<\s*U\s*\+([A-Za-z0-9_]{4})\s*>', ' ; ', 'g'), '\s+', ' ', 'g'), '^ +| +$', '', 'g') AS clean FROM articles_df""")
def nz_pipeline(spark, d):
    """The ordered cleaners over whole abstracts."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace("abstract", "<.+?>", ""), r"\{[^}\n]*\}", ""), r"<\s*U\s*\+([A-Za-z0-9_]{4})\s*>", " ; ")
    return table(spark, d, A).select("id", T.squeeze(x).alias("clean"))


_NW = r"length(list_filter(regexp_split_to_array({w}, '\s+'), lambda v: v <> ''))"


@query(rf"""WITH p AS (SELECT id, keywords, string_split(keywords, ';') AS l FROM articles_df WHERE keywords IS NOT NULL),
q AS (SELECT id, keywords, l, list_min(list_filter(list_transform(range(1, length(l)), lambda i: CASE WHEN regexp_matches(l[i], '\.\s*$') AND {_NW.format(w='l[i + 1]')} < 3 THEN i END), lambda i: i IS NOT NULL)) AS f FROM p)
SELECT id, CASE WHEN f IS NULL THEN keywords ELSE array_to_string(list_filter(l[1:f], lambda w: {_NW.format(w='w')} > 3), ';') END AS out FROM q""")
def str_semi_tail(spark, d):
    return table(spark, d, A).where("keywords is not null").select("id", T.semicolon_tail("keywords").alias("out"))
