"""The report queries as SQL for an independent engine."""

from ..operators import regions, reports
from .oracle import _RANKED, ORACLE as BASE, _host, _normal, _region, _s, _TITLE

_DOCS = "(SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(text, '') AS text FROM documents)"
_HEADINGS = r"""h AS (SELECT page_id, unnest(x) AS raw, unnest(range(len(x))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) AS x FROM pages)),
k AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS heading FROM h)"""
_THEMES = " UNION ALL ".join(f"SELECT source, '{name}' AS theme, count(*) FILTER (WHERE regexp_matches(lower(text), {_s(chr(92) + 'b(' + p + ')' + chr(92) + 'b')})) AS n_docs FROM {_DOCS} GROUP BY 1" for name, p in reports.THEMES.items())
_SEEDS = ", ".join(f"'https://{r[2]}.wikipedia.org/wiki/Special:Search?search='" for r in regions.REGIONS)

ORACLE = {
    "page_upsert_latest": "WITH p AS (SELECT url, 0 AS seq, length(html) AS n FROM pages), b AS (SELECT * FROM p UNION ALL SELECT url, 1, n + 1 FROM p WHERE n % 3 = 0) SELECT url, n FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC, n DESC) AS r FROM b) WHERE r = 1",
    "crawl_stats": f"SELECT count(*) AS n_pages, count(DISTINCT {_normal('url')}) AS n_urls, count(DISTINCT {_host('url')}) AS n_hosts, (SELECT count(*) FROM pages) AS n_live, (SELECT count(*) FILTER (WHERE needs_js) FROM ({BASE['needs_js_flag']})) AS n_scripted FROM pages",
    "topic_report_urls": f"WITH {_RANKED} SELECT address, page_id, relevance FROM (SELECT {_normal('url')} AS address, page_id, relevance, row_number() OVER (PARTITION BY {_normal('url')} ORDER BY page_id) AS r FROM ranked) WHERE r = 1",
    "knowledge_subtopics": f"WITH {_HEADINGS} SELECT heading, n_pages FROM (SELECT lower(heading) AS key, arg_min(heading, page_id * 100000 + pos) AS heading, min(page_id * 100000 + pos) AS first, count(DISTINCT page_id) AS n_pages FROM k WHERE length(heading) BETWEEN 8 AND 120 GROUP BY 1) ORDER BY first LIMIT 30",
    "regional_sources": f"WITH {_RANKED}, g AS (SELECT page_id, {_region()} AS region FROM pages) SELECT * FROM (SELECT region, row_number() OVER (PARTITION BY region ORDER BY relevance DESC, page_id) AS rank, page_id, relevance FROM ranked JOIN g USING (page_id)) WHERE rank <= 8",
    "theme_counts": _THEMES,
    "first_person_voice": f"SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(lower(text), '\\b({reports.FIRST_PERSON})\\b'))) AS BIGINT) AS n_first_person FROM {_DOCS} GROUP BY 1",
    "live_documents": f"SELECT page_id, coalesce({_TITLE}, url) AS title, length(text) AS n_chars FROM pages JOIN ({BASE['page_plain_text']}) USING (page_id) WHERE length(text) >= 80",
    "report_slugs": "SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM benchmark",
}
