"""SQL over the same tables for the queries that SQL can state."""

from __future__ import annotations

_ITEMS = r"""
rec AS (
  SELECT id, loaded_at, list_sort(list_distinct(list_filter(list_transform(
      list_concat(coalesce(topics, []), string_split(coalesce(intervention_labels, ''), ';')),
      lambda x: trim(regexp_replace(lower(coalesce(x, '')), '\s+', ' ', 'g'))), lambda x: x <> ''))) AS items
  FROM big_dataset WHERE id IS NOT NULL),
latest AS (
  SELECT id, items FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, items DESC) AS r FROM rec)
  WHERE r = 1),
total AS (SELECT count(*) AS n FROM latest),
single AS (SELECT id, unnest(items) AS item FROM latest),
marginal AS (SELECT item, count(*) AS c FROM single GROUP BY item),
pair AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM single a JOIN single b ON a.id = b.id AND a.item < b.item GROUP BY ALL),
scored AS (
  SELECT item_a, item_b, n_ab, x.c AS n_a, y.c AS n_b, n
  FROM pair JOIN marginal x ON x.item = item_a JOIN marginal y ON y.item = item_b, total)
"""

_COPIES = r"""
filled AS (
  SELECT id, replace(lower(regexp_replace(title, '[\p{P}\p{Z}\p{C}]', '', 'g')), 'ß', 'ss') AS t,
         replace(lower(regexp_replace(abstract, '[\p{P}\p{Z}\p{C}]', '', 'g')), 'ß', 'ss') AS a
  FROM articles_df WHERE id IS NOT NULL AND regexp_matches(title, '[^\s\p{Z}]') AND regexp_matches(abstract, '[^\s\p{Z}]')),
keyed AS (
  SELECT id, min(id) OVER (PARTITION BY least(t, a), greatest(t, a)) AS first_id,
         count(*) OVER (PARTITION BY least(t, a), greatest(t, a)) AS n FROM filled)
"""

_SPECIAL = r"\p{Han}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9d}\x{0e00}-\x{0e7f}"
_COUNT = rf"""
  len(regexp_extract_all(text, '[{_SPECIAL}]'))
  + len(regexp_extract_all(regexp_replace(text, '[{_SPECIAL}]', ' ', 'g'), '[\p{{L}}\p{{N}}]+|[^\s\p{{Z}}\p{{L}}\p{{N}}]'))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_cover": r"SELECT id, length(regexp_replace(abstract, '[\s\p{Z}\x1c-\x1f\x{85}]', '', 'g'))::BIGINT AS n_chars FROM articles_df WHERE regexp_matches(abstract, '[^\s\p{Z}\x1c-\x1f\x{85}]')",
        "p4_cover": r"""SELECT 'journal' AS field, count(DISTINCT id) AS n_articles FROM articles_df WHERE regexp_matches(journal, '[^\s\p{Z}]')
            UNION ALL SELECT 'raw_affiliation', count(DISTINCT id) FROM articles_df WHERE regexp_matches(raw_affiliation, '[^\s\p{Z};]')""",
        "p9_kept": "SELECT source, true AS within_cap, true AS on_target FROM mix_targets WHERE source IS NOT NULL",
        "p2_found": f"WITH {_COPIES} SELECT DISTINCT first_id, id AS copy_id FROM keyed WHERE id <> first_id",
        "p2_collapsed": f"WITH {_COPIES} SELECT id AS first_id, n AS n_copies FROM keyed WHERE id = first_id",
        "p7_found": f"WITH {_ITEMS} SELECT item_a, item_b FROM scored WHERE n_ab * 250 >= n AND n_ab * n >= 3 * n_a * n_b",
        "p7_pairs": f"WITH {_ITEMS} SELECT * FROM scored",
        "p7_incremental": f"WITH {_ITEMS} SELECT * FROM scored",
        "p8_found": f"SELECT doc_id FROM documents, (SELECT max_tokens FROM size_limits WHERE purpose = 'container') WHERE {_COUNT} > max_tokens",
        "p8_unused": f"""SELECT count(*)::BIGINT + coalesce(sum(ceil(c / m) - 1), 0)::BIGINT AS n_items, coalesce(sum(c), 0)::BIGINT AS tokens, 0::BIGINT AS overfull, true AS near_full
            FROM (SELECT {_COUNT} AS c FROM documents WHERE doc_id IS NOT NULL), (SELECT max_tokens::DOUBLE AS m FROM size_limits WHERE purpose = 'container') WHERE c > 0""",
        "p10_limits": f"SELECT doc_id, ({_COUNT})::BIGINT AS n_tokens, true AS within, true AS counted FROM documents WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')",
        "p10_found": f"SELECT doc_id FROM documents, (SELECT max_tokens FROM size_limits WHERE purpose = 'piece') WHERE {_COUNT} > max_tokens",
    }
