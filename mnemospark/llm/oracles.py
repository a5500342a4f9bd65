"""SQL twins of queries that SQL can state over whole tables at test scale."""

from __future__ import annotations

_TOKENS = "array_to_string(list_transform(regexp_extract_all({0}, '[0-9]+(?:\\.[0-9]+)+|[\\pL\\pN]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+$') THEN regexp_replace(t, '\\.?0+$', '') ELSE t END), ' ')"
_KEY = _TOKENS.format("regexp_extract(p, '^([^=:]*)[=:]', 1)")
_VALUE = _TOKENS.format("regexp_replace(p, '^[^=:]*[=:]', '')")


def _listed(text: str, separator: str) -> str:
    parts = f"list_filter(string_split({text}, {separator}), lambda p: regexp_matches(p, '[\\pL\\pN]'))"
    good = f"len({parts}) >= 2 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, '^[^\\pL\\pN]*[\\pL\\pN_\\-]+\\s*[=:]\\s*\\S'))) = 0"
    return f"WHEN {good} THEN 'f ' || array_to_string(list_sort(list_transform({parts}, lambda p: {_KEY} || '=' || {_VALUE})), chr(31))"


_JSON = f"'f ' || array_to_string(list_sort(list_transform(json_keys(x), lambda k: {_TOKENS.format('k')} || '=' || {_TOKENS.format(chr(40) + 'json_extract_string(x, concat(chr(36), chr(46), chr(34), k, chr(34)))' + chr(41))})), chr(31))"
_CANON = f"""RECS, folded AS (SELECT id, claim, trim(lower(regexp_replace(claim, '[\\p{{Cf}}\\p{{Cc}}]+', ' ', 'g'))) AS x, trim(lower(regexp_replace(claim, '[\\p{{Cf}}\\r]+', ' ', 'g'))) AS y FROM recs WHERE claim IS NOT NULL),
 canon AS (SELECT id, claim, CASE WHEN starts_with(x, '{{') AND ends_with(x, '}}') AND json_valid(x) THEN {_JSON} {_listed('y', 'chr(10)')} {_listed('x', "';'")} {_listed('x', "'|'")} {_listed('x', "','")} ELSE 't ' || {_TOKENS.format('x')} END AS c FROM folded WHERE regexp_matches(x, '[\\pL\\pN]'))"""

_BELIEFS = "recs AS (SELECT DISTINCT belief_id AS id, claim FROM beliefs)"
_BOTH = "recs AS (SELECT DISTINCT belief_id AS id, claim FROM beliefs UNION ALL SELECT candidate_id, claim FROM candidates)"

P6 = f"WITH {_CANON.replace('RECS', _BOTH)} SELECT min(id) AS first_id, count(*) AS copies FROM canon GROUP BY c HAVING count(*) > 1"

_CLASS = "regexp_replace(lower(coalesce({0}, '')), '[^\\pL\\pN]+', '', 'g')"
P2 = f"""WITH {_CANON.replace('RECS', _BELIEFS)}, b AS (SELECT DISTINCT ON (belief_id) * FROM beliefs), tr AS (SELECT {_CLASS.format('source_class')} AS k, min(trust_rank) AS r FROM source_trust GROUP BY 1),
 m AS (SELECT canon.c, b.belief_id AS id, coalesce(tr.r, 2147483647) AS r, CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence END AS conf, list_distinct(list_filter(list_transform(coalesce(evidence_ids, []), lambda e: lower(trim(e))), lambda e: e <> '')) AS ev, updated_at FROM canon JOIN b ON b.belief_id = canon.id LEFT JOIN tr ON tr.k = {_CLASS.format('b.source_class')}),
 k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY r, conf DESC NULLS LAST, len(ev) DESC, updated_at DESC NULLS LAST, id) AS o, row_number() OVER (PARTITION BY c ORDER BY conf DESC NULLS LAST, id) AS oc FROM m)
 SELECT min(id) AS group_id, min(CASE WHEN o = 1 THEN id END) AS survivor_id, min(CASE WHEN oc = 1 THEN CASE WHEN conf IS NULL THEN '' ELSE id END END) AS confidence_from, CAST(len(list_distinct(flatten(list(ev)))) AS BIGINT) AS n_evidence FROM k GROUP BY c HAVING count(*) > 1"""

_GROUPS = """w AS (SELECT id, list_distinct(regexp_extract_all(lower(claim), '[\\pL\\pN]+')) AS ws FROM recs WHERE claim IS NOT NULL), v AS (SELECT id, ws FROM w WHERE len(ws) > 0),
 l0 AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id AND least(len(x.ws), len(y.ws)) >= 0.75 * greatest(len(x.ws), len(y.ws)) WHERE len(list_intersect(x.ws, y.ws)) >= 0.75 * greatest(len(x.ws), len(y.ws))
  UNION SELECT x.id, y.id FROM canon x JOIN canon y ON x.c = y.c AND x.id < y.id),
 l AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0), r AS (SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other)"""
P5 = f"WITH RECURSIVE {_CANON.replace('RECS', _BELIEFS)}, {_GROUPS} SELECT id AS belief_id_a, other AS belief_id_b FROM r WHERE id < other"
P5_GROUPS = f"""WITH RECURSIVE {_CANON.replace('RECS', _BELIEFS)}, {_GROUPS}, g AS (SELECT id, min(other) AS low FROM r GROUP BY id), s AS (SELECT id, list_sort(ws) AS ws FROM v), k AS (SELECT ws, min(id) AS class_id FROM s GROUP BY ws)
 SELECT s.id AS belief_id, least(s.id, coalesce(g.low, s.id)) AS group_id, class_id FROM s JOIN k USING (ws) LEFT JOIN g USING (id)"""
_HASH = "regexp_replace(regexp_replace(lower(sha256), '^[^\\pL\\pN]*sha-?256', ''), '[^0-9a-f]+', '', 'g')"
P4 = f"""WITH RECURSIVE {_CANON.replace('RECS', _BOTH)}, {_GROUPS}, h AS (SELECT archive_id AS id, {_HASH} AS h FROM archives WHERE length({_HASH}) = 64)
 SELECT min(other) AS first_id, id AS dup_id FROM r WHERE starts_with(id, 'C-') GROUP BY id HAVING min(other) < id
 UNION ALL SELECT f.id, h.id FROM h JOIN (SELECT h, min(id) AS id FROM h GROUP BY h) f ON f.h = h.h WHERE f.id < h.id"""

SQL = {"p2_found": P2, "p4_found": P4, "p5_found": P5, "p5_groups": P5_GROUPS, "p6_found": P6}
