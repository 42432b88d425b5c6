"""The queries of small_queries as SQL for an independent engine."""

from .oracle import _NOISE, _host, _link_score, _part
from .table_oracle import _PROFILES, _ROLE_RANK

_SOCIAL = ("github.com", "x.com", "twitter.com", "linkedin.com", "instagram.com", "facebook.com", "tiktok.com", "youtube.com", "threads.net", "discord.gg")
_FORM = "CASE k % 12 " + " ".join(f"WHEN {i} THEN {p[0] if p else chr(39) + 'https://other.net/@x' + chr(39) + ' || k'}" for i, p in enumerate(_PROFILES)) + " END"
_CITED = f"""cited AS (SELECT k // 10 AS page_id, k * 3 + i AS pos, CASE i WHEN 0 THEN {_FORM} WHEN 1 THEN 'https://plain.net/the-tion-' || k ELSE 'http://10.0.0.1/the-tion/' || k END AS target, CASE i WHEN 1 THEN 'of' ELSE 'the tion of' END AS anchor, (k // 10) % 3 AS depth, (k // 10) % 2 = 1 AS relevant
 FROM (SELECT c_custkey AS k FROM customer), (VALUES (0), (1), (2)) AS v(i)), l AS (SELECT *, target AS url, {_link_score('target', 'anchor')} AS score FROM cited),
social AS (SELECT page_id, target, max(score) AS score, min(depth) AS depth, arg_min(pos, -score * 1000000 + pos / 1000000) AS pos FROM l WHERE NOT ({_NOISE}) AND score >= 0.15 AND ({' OR '.join(f"contains({_host('target')}, '{h}')" for h in _SOCIAL)}) GROUP BY 1, 2),
top AS (SELECT * FROM social QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) <= 20)"""
_NAME = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"

ORACLE = {
    "profile_links": f"WITH {_CITED} SELECT page_id, target, round(score, 6) AS score FROM top",
    "topic_children": f"""WITH {_CITED}, c AS (SELECT page_id, target AS url, depth, 90 - depth AS priority FROM top UNION ALL SELECT page_id, target, depth, floor(score * 100 + 0.5) - depth FROM l WHERE target NOT LIKE 'http://10.%' AND NOT ({_NOISE})
 AND score >= CASE WHEN relevant THEN 0.1::DOUBLE * 0.6::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN {' OR '.join(f"contains({_host('target')}, '{h}')" for h in _SOCIAL)} THEN 0 ELSE 0.05::DOUBLE END) SELECT page_id, url, max(depth) + 1 AS depth, max(priority)::BIGINT AS priority FROM c GROUP BY 1, 2""",
    "api_gate_decision": f"""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'ok' WHEN event_id % 11 = 0 THEN 'RATE_LIMITED' WHEN event_id % 13 = 0 THEN 'ORGANISM_LOCKDOWN' WHEN event_id % 17 = 0 THEN 'CLIENT_NOT_ALLOWLISTED' WHEN user_id % 4 = 3 THEN 'UNAUTHORIZED'
 WHEN {_ROLE_RANK.format("['viewer', 'operator', 'admin'][user_id % 4 + 1]")} < {_ROLE_RANK.format("['viewer', 'operator', 'operator', 'admin', 'admin', 'operator'][event_id % 6 + 1]")} THEN 'FORBIDDEN' ELSE 'ok' END AS told FROM events""",
    "preflight_checked": f"""SELECT DISTINCT url, CASE WHEN regexp_extract(url, '^([a-z]+)://', 1) NOT IN ('http', 'https') THEN 'scheme_not_allowed' WHEN NOT regexp_matches({_host('url')}, '(^|\\.)example\\.(com|net)$') THEN 'domain_not_allowed'
 WHEN {_part('url', 3)} LIKE '/fr%' AND {_part('url', 3)} NOT LIKE '/fr/1%' THEN 'robots_disallowed' ELSE 'ok' END AS reason FROM pages""",
    "current_place_mentions": f"""WITH n AS (SELECT c_custkey AS id, c_custkey % 5 AS k, {_NAME} AS n FROM customer)
SELECT id, unnest(CASE k WHEN 0 THEN [n || ', Texas', n || ', Texas now'] WHEN 1 THEN [n || ', TX'] WHEN 3 THEN [n || ', Ohio'] ELSE []::VARCHAR[] END) AS place FROM n""",
    "colleague_mentions": f"SELECT c_custkey AS id, 'colleague' AS kind, {_NAME} || CASE c_custkey % 5 WHEN 2 THEN ' and' ELSE ' lives' END AS value FROM customer WHERE c_custkey % 5 IN (2, 3)",
    "page_entity_merge": """WITH p AS (SELECT c_custkey AS k, least(0.95, c_custkey % 10 / 10.0 + 0.4) AS sure FROM customer),
e AS (SELECT 'name' AS type, 'Jane Roe' AS value, sure * 0.9 AS c FROM p UNION ALL SELECT 'email', 'a' || (k % 9) || '@b.net', sure * 0.85 FROM p UNION ALL SELECT 'phone', '415-555-01' || lpad((k % 7)::VARCHAR, 2, '0'), sure * 0.85 FROM p
 UNION ALL SELECT 'connection', 'affiliation: Guild', sure * 0.72 FROM p UNION ALL SELECT 'handle', '@u' || (k % 5), sure * 0.7 FROM p UNION ALL SELECT 'url', 'https://github.com/g' || (k % 4), sure * 0.75 FROM p)
SELECT type, value, round(max(c), 6)::DOUBLE AS confidence, count(*) AS n_sources FROM e GROUP BY 1, 2""",
    "historic_findings": """SELECT strftime(ts, '%Y-%m-%d') AS period, 'http://u' || (user_id % 3) AS url, coalesce(string_agg(event_type || '-' || event_id, ',' ORDER BY event_id) FILTER (WHERE event_id % 4 > 0), '') AS findings FROM events GROUP BY 1, 2 ORDER BY min(event_id) LIMIT 40""",
}
