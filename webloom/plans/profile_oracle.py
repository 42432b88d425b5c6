"""The queries of profile_queries as SQL for an independent engine."""

from .table_oracle import _PROFILES, _s

_CASE = lambda i: "CASE k % 12 " + " ".join(f"WHEN {n} THEN {x}" for n, p in enumerate(_PROFILES) if p and (x := (p[0], f"'{p[1]}'", p[2] or "NULL", f"{_s(p[3])} || lower({p[2]})" if p[2] else "NULL")[i])) + " END"
_OF = f"of AS (SELECT k, {_CASE(0)} AS url, {_CASE(1)} AS platform, {_CASE(2)} AS name, {_CASE(3)} AS profile_url FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders))"
_FOUND = f"""{_OF}, f AS (SELECT profile_url, platform, lower(name) AS username, 'order/' || (o_orderkey % 5) AS source, 0.35 + (o_orderkey % 10) / 20.0 AS confidence FROM orders JOIN of ON k = o_custkey WHERE o_custkey % 4 < 3 AND profile_url IS NOT NULL),
d AS (SELECT profile_url, platform, username, max(confidence) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM f GROUP BY 1, 2, 3)"""

ORACLE = {
    "profiles_discovered": f"WITH {_FOUND} SELECT profile_url, platform, username, round(confidence, 6)::DOUBLE AS confidence, sources FROM d",
    "profile_trail": f"""WITH {_FOUND}, p AS (SELECT profile_url, platform, name, url, CASE WHEN k % 3 > 0 THEN c_name END AS display, CASE WHEN k % 5 > 0 THEN lower(c_mktsegment) END AS bio FROM customer JOIN of ON k = c_custkey WHERE k % 4 > 1 AND profile_url IS NOT NULL)
SELECT profile_url, coalesce(d.platform, p.platform) AS platform, coalesce(p.name, username) AS username, round(coalesce(confidence, 0.55), 6)::DOUBLE AS confidence, coalesce(sources, url) AS sources, display, bio FROM d FULL JOIN p USING (profile_url)""",
    "trail_posts": "SELECT min(l_orderkey * 100 + l_linenumber) AS seq, 'https://x.com/o' || l_orderkey AS link, l_returnflag AS flag FROM lineitem GROUP BY 2, 3",
}
