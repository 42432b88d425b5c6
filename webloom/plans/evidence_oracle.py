"""The queries of evidence_queries as SQL for an independent engine, from what each form must tell."""

_ROWS = """rows AS (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Acme ' || (o_custkey % 7) || ' Works' AS c FROM orders),
told AS (SELECT o_orderkey, o_custkey, date, ['employment_start', 'employment_start', 'employment_end', 'job_post', 'location', 'business', 'general'][k + 1] AS category,
 CASE k WHEN 4 THEN NULL WHEN 5 THEN 'The startup ' || c ELSE c END AS entity, CASE k WHEN 1 THEN 'tea taster' END AS role FROM rows)"""

ORACLE = {
    "dated_evidence": f"WITH {_ROWS} SELECT o_orderkey, date, category, entity, role, CASE WHEN entity IS NULL THEN 0.55 ELSE 0.7 END::DOUBLE AS confidence FROM told",
    "employment_spans": f"""WITH {_ROWS}, g AS (SELECT o_custkey % 50 AS who, lower(entity) AS key, arg_min(entity, o_orderkey) AS company, arg_min(role, o_orderkey) FILTER (WHERE role IS NOT NULL) AS role,
 min(date) FILTER (WHERE category IN ('employment_start', 'job_post')) AS opened, min(date) AS first, max(date) FILTER (WHERE category = 'employment_end') AS "end" FROM told WHERE entity IS NOT NULL AND category NOT IN ('location', 'business') GROUP BY 1, 2)
SELECT who, key, company, role, coalesce(opened, first) AS start, "end", CASE WHEN opened IS NOT NULL AND "end" IS NULL THEN 'current' WHEN "end" >= coalesce(opened, first) THEN 'past' ELSE 'inferred_past' END AS status FROM g""",
}
