"""The queries of composition_queries as SQL for an independent engine."""

from ..operators import regions
from .oracle import _DOMAIN_LIST, _LINKS, _RANKED, _region

_PLACES = ", ".join(f"({i}, '{r[0]}', '{r[1]}')" for i, r in enumerate(regions.REGIONS))
_BASE = f"""{_RANKED}, rel AS (SELECT r.*, {_region()} AS region FROM (SELECT * FROM ranked WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY url)) r JOIN (SELECT page_id, html FROM pages) USING (page_id)),
places AS (SELECT * FROM (VALUES {_PLACES}) AS t(place, region, name)),
views AS (SELECT region, name, place, count(*) AS n_pages, arg_min(title, -relevance * 1000000 + page_id / 1000000) FILTER (WHERE length(title) >= 15) AS claim FROM rel JOIN places USING (region) GROUP BY 1, 2, 3),
total AS (SELECT count(*) AS n_pages, count(DISTINCT url) AS n_urls FROM pages),
domains AS (SELECT DISTINCT unnest({_DOMAIN_LIST}) AS domain FROM (SELECT concat_ws(' ', 'the tion of', title) AS text FROM rel))"""
_DOMAIN_ORDER = "list_position(['Artificial Intelligence', 'Prompt Engineering', 'Cybersecurity', 'Web Crawling & Data', 'Blockchain', 'Cloud & DevOps', 'Finance', 'Healthcare & Life Sciences', 'Law & Policy'], domain)"

ORACLE = {
    "report_findings": f"""WITH {_BASE} SELECT 0 AS n, 'Global knowledge search for "the tion of" — algorithm seeks regional perspectives, not US-only sources.' AS line
UNION ALL SELECT 1, 'Primary domains: ' || coalesce((SELECT string_agg(domain, ', ' ORDER BY {_DOMAIN_ORDER}) FROM domains), 'the tion of')
UNION ALL SELECT 2, 'Regional coverage: ' || string_agg(region, ', ' ORDER BY place) || ' (' || sum(n_pages)::BIGINT || ' source pages).' FROM views HAVING count(*) > 0
UNION ALL SELECT 3, 'Still seeking perspectives from: ' || string_agg(region, ', ' ORDER BY place) || '.' FROM (SELECT * FROM places WHERE region <> 'GLOBAL' AND region NOT IN (SELECT region FROM views) ORDER BY place LIMIT 6) HAVING count(*) > 0
UNION ALL SELECT 3 + row_number() OVER (ORDER BY n_pages DESC, place), name || ': ' || substr(coalesce(substr(claim, 1, 160), n_pages || ' source(s)'), 1, 180) FROM views QUALIFY row_number() OVER (ORDER BY n_pages DESC, place) <= 6
UNION ALL SELECT 100, 'Top sources: ' || string_agg(url, ' · ' ORDER BY relevance DESC, page_id) FROM (SELECT * FROM rel ORDER BY relevance DESC, page_id LIMIT 3) HAVING count(*) > 0""",
    "report_summary": f"""WITH {_BASE} SELECT 'Global knowledge synthesis for "the tion of". Collected ' || n_pages || ' pages across 1 expansion wave(s). '
 || coalesce('Regional perspectives captured: ' || (SELECT string_agg(region, ', ' ORDER BY place) FROM views) || '.', 'Seeking regional perspectives (India, China, Russia, and others) — add --seed URLs or increase page budget.')
 || coalesce(' Perspective map: ' || (SELECT string_agg(name || ' (' || n_pages || ' sources)', '; ' ORDER BY n_pages DESC, place) FROM (SELECT * FROM views ORDER BY n_pages DESC, place LIMIT 4)) || '.', '') AS line FROM total""",
    "report_lines": f"""WITH {_BASE}, {_LINKS}, best AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, page_id) AS n FROM rel), g AS (SELECT n AS place, url, target, min(pos) AS pos FROM best JOIN links USING (page_id) WHERE n <= 20 GROUP BY 1, 2, 3)
SELECT 2 AS section, i AS n, line FROM (SELECT unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT ['| Total pages | ' || n_pages || ' |', '| Live web | ' || n_pages || ' |', '| Unique URLs | ' || n_urls || ' |', '| Expansion waves | 1 |', '| Saturated | no |'] AS l FROM total))
UNION ALL SELECT 4, n * 100, printf('### [%.2f] ', floor(relevance * 100 + 0.5) / 100) || url FROM best WHERE n <= 25
UNION ALL SELECT 5, row_number() OVER (ORDER BY place, pos, target), '- `' || url || '` → `' || target || '` (links_to)' FROM g QUALIFY row_number() OVER (ORDER BY place, pos, target) <= 30
UNION ALL SELECT 6, n, printf('| %.2f | live | ', floor(relevance * 100 + 0.5) / 100) || url || ' | ' || substr(replace(coalesce(title, ''), '|', '/'), 1, 60) || ' |' FROM best WHERE n <= 100""",
    "report_markdown": """SELECT 'Executive Summary|Key Findings|Crawl Statistics|Subtopics|Relevant Pages|Connection Graph|Source Links (All Crawled URLs)' AS sections, '# Intelligence Report' || chr(10) || chr(10) || '**Subject:** the tion of' AS head FROM pages LIMIT 1""",
}
