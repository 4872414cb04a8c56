"""SQL of the filter interaction audit: every order is walked for every set of failed filters."""

AUDIT_SQL = r"""WITH d AS (SELECT doc_id AS id, coalesce(source, '') AS part, coalesce(text, '') AS t, md5(coalesce(text, '')) AS copy FROM documents),
w AS (SELECT id, part, t, copy, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
firsts AS (SELECT copy, min(id) AS first FROM d GROUP BY copy),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
  concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.id > first THEN 'E' ELSE '' END) AS failed
  FROM w JOIN firsts USING (copy) LEFT JOIN l ON w.id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS filter, substr(filter_order, 1, step::INTEGER - 1) AS before FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, filter,
  coalesce(sum(n) FILTER (NOT regexp_matches(failed, '[' || before || filter || ']')), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (contains(failed, filter) AND NOT regexp_matches(failed, '[' || before || '0]')), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (contains(failed, filter) AND regexp_matches(failed, '[' || before || '0]')), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = filter), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (contains(failed, filter) AND NOT regexp_matches(failed, '[' || before || '0]')), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (contains(failed, filter) AND NOT regexp_matches(failed, '[' || before || '0]')), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""
