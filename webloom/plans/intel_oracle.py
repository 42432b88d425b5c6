"""The queries on pages, seeds and captures as SQL for an independent engine."""

from .oracle import _DOMAIN_LIST, _DOCS, _LINKS, _RANKED, ORACLE as BASE, _host, _normal, _TITLE

_CAPTURES = "caps AS (SELECT 'u' || CAST(user_id % 20 AS VARCHAR) AS url, ts, CASE WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status FROM events)"
_META = r"""(?is)<meta[^>]*(?:name|property)=["'']{0}["''][^>]*content=["'']([^"'']*)["'']"""
_DESCRIPTION = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(html, '{_META.format(n)}', 1)), '')" for n in ("description", "og:description")) + ")"
_HEADS = "list_concat(" + ", ".join(f"regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1)" for n in (1, 2, 3)) + ")"
_HEADINGS = rf"list_filter(list_transform({_HEADS}, lambda h: trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))), lambda h: h <> '')[1:10]"
_NOISE_URL = r"regexp_matches(lower(url), '\.(png|jpg|jpeg|svg|gif|ico|webp)(\?|$)') OR regexp_matches(lower(url), 'github\.com/(features|marketplace|mcp|security|enterprise|team|solutions|resources|customer-stories|orgs|trust-center|partners|sponsors|accelerator|topics|why-github|login|signup|search|settings|explore|pricing|about|contact|site|trending|premium-support|user-attachments)') OR regexp_matches(lower(url), 'github\.com/collections') OR regexp_matches(lower(url), 'x\.com/(home|explore|login|i/flow)')"
_PLACES = lambda term: f"list_transform(range(1, least(len(string_split(lower(text), '{term}')), 9)), lambda k: CAST(list_sum(list_transform(string_split(lower(text), '{term}')[1:k], lambda g: length(g))) AS BIGINT) + (k - 1) * {len(term)})"
_SNIPPETS = "list_concat(" + ", ".join(f"list_transform({_PLACES(t)}, lambda p: trim(substr(text, greatest(p - 80, 0) + 1, least(p, 80) + 120)))" for t in ("tion",)) + ")"

ORACLE = {
    "captured_originals": f"WITH {_CAPTURES} SELECT DISTINCT url FROM caps WHERE status = 200 AND url LIKE 'u1%' ORDER BY url LIMIT 30",
    "captured_pairs": f"WITH {_CAPTURES} SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT DISTINCT url, ts FROM caps WHERE status = 200 AND url LIKE 'u1%' ORDER BY ts, url LIMIT 20)",
    "historical_snapshots": f"WITH {_CAPTURES} SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT url, ts FROM (SELECT url, ts, day, row_number() OVER (PARTITION BY url ORDER BY day) AS n FROM (SELECT url, CAST(ts AS DATE) AS day, min(ts) AS ts FROM caps WHERE status = 200 GROUP BY 1, 2)) WHERE n <= 10 ORDER BY ts, url LIMIT 30)",
    "seed_hosts": f"SELECT DISTINCT regexp_replace({_host('url')}, '^www\\.', '') AS host FROM pages WHERE {_host('url')} <> ''",
    "frontier_seeds": f"WITH {_LINKS} SELECT url, max(priority) AS priority FROM (SELECT {_normal('url')} AS url, CASE WHEN page_id % 3 = 0 THEN 100 ELSE 70 END AS priority FROM pages UNION ALL SELECT target, 90 FROM links) GROUP BY 1",
    "pages_accepted": f"SELECT page_id, length(html) + CASE WHEN needs_js AND page_id % 2 = 0 THEN 17 ELSE 0 END AS n_chars FROM pages JOIN ({BASE['needs_js_flag']}) USING (page_id) WHERE page_id % 5 <> 0 AND length(html) > 0",
    "plain_children": f"WITH {_LINKS} SELECT page_id, target AS url, min(pos) AS pos, CAST(50 - page_id % 3 AS INT) AS priority FROM links WHERE pos < 200 GROUP BY 1, 2",
    "seed_bundle": f"WITH {_LINKS}, c AS (SELECT DISTINCT target AS url FROM links) SELECT url FROM c WHERE NOT ({_NOISE_URL}) AND {_host('url')} NOT IN ('localhost', '127.0.0.1', '::1', '0.0.0.0') AND NOT regexp_matches({_host('url')}, '\\.(local|internal)$') AND NOT regexp_matches({_host('url')}, '^(10|127)\\.[0-9]+\\.[0-9]+\\.[0-9]+$|^192\\.168\\.[0-9]+\\.[0-9]+$|^169\\.254\\.[0-9]+\\.[0-9]+$|^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9]+\\.[0-9]+$') AND url NOT IN (SELECT {_normal('url')} FROM pages WHERE page_id % 2 = 0)",
    "same_host_links": f"WITH {_LINKS} SELECT l.page_id, count(*) FILTER (WHERE {_host('p.url')} = {_host('l.target')}) AS n_same FROM links l JOIN pages p USING (page_id) GROUP BY 1",
    "seed_host_pages": f"SELECT page_id, regexp_matches({_host('url')}, '(^|\\.)example\\.(com|org)$') AS seeded FROM pages",
    "jobs_by_time": "SELECT o_orderkey AS job, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
    "wave_totals": "SELECT count(DISTINCT event_id // 1000) AS n_waves, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, (SELECT bool_and(wave NOT IN (SELECT min(event_id // 1000) FROM events GROUP BY user_id)) FROM (SELECT DISTINCT event_id // 1000 AS wave FROM events) WHERE wave > 0) AS all_saturated FROM events",
    "page_intel": f"SELECT page_id, {_TITLE} AS title, {_DESCRIPTION} AS description, array_to_string({_HEADINGS}, '|') AS headings, CAST(len(list_distinct(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS BIGINT) AS n_emails FROM pages",
    "page_claims": f"SELECT page_id, substr({_DESCRIPTION}, 1, 240) AS claim FROM pages WHERE length({_DESCRIPTION}) >= 30 UNION ALL SELECT page_id, substr({_TITLE}, 1, 160) FROM pages WHERE length({_TITLE}) >= 15",
    "topic_snippets": f"WITH {_DOCS}, x AS (SELECT doc_id, list_filter({_SNIPPETS}, lambda s: s <> '') AS s FROM docs), y AS (SELECT doc_id, unnest(s) AS snippet, unnest(range(len(s))) AS i FROM x), z AS (SELECT doc_id, snippet, min(i) AS i FROM y GROUP BY 1, 2) SELECT doc_id, pos, snippet FROM (SELECT doc_id, snippet, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM z) WHERE pos < 8",
    "source_links": f"WITH {_RANKED} SELECT page_id, url, title, relevance FROM ranked",
    "archive_candidates": f"WITH {_RANKED}, l AS (SELECT *, regexp_replace({_host('url')}, '^www\\.', '') AS h FROM ranked) SELECT {_normal('url')} AS url, max(relevance) AS relevance FROM l WHERE h NOT IN ('example.com', 'example.org', 'example.net', 'localhost', '127.0.0.1', '0.0.0.0', 'test', 'invalid') AND NOT regexp_matches(h, '\\.(local|test|localhost)$|^127\\.|^10\\.|^192\\.168\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.') AND regexp_matches(trim(url), '(?i)^https?://') AND NOT regexp_matches(trim(url), '(?i)(^|[\\\\/])(tests?|fixtures?|mocks?|data[\\\\/]reports|__tests__|node_modules)([\\\\/]|$)|\\.(test|spec)\\.[a-z]+$') GROUP BY 1 ORDER BY relevance DESC, url LIMIT 5",
    "mention_counts": f"WITH {_DOCS} SELECT name, count(*) AS n FROM (SELECT DISTINCT doc_id, i, lower(unnest(regexp_extract_all(text, '@([a-zA-Z0-9_]{{2,30}})', 1))) AS name FROM (SELECT *, row_number() OVER () AS i FROM docs)) GROUP BY 1",
    "document_hashtags": f"WITH {_DOCS} SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, i, lower(unnest(regexp_extract_all(text, '#([a-zA-Z0-9_]{{2,40}})', 1))) AS tag FROM (SELECT *, row_number() OVER () AS i FROM docs)) GROUP BY 1",
    "clean_captures": r"SELECT item_id, regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), '[.,;]+$', '') AS text FROM benchmark",
    "title_case_names": r"SELECT item_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || lower(w[2:])), ' ') AS name FROM benchmark",
    "unique_turns": "WITH t AS (SELECT conv_id, lower(trim(text)) AS k, min({'turn': turn, 'role': role, 't': trim(text)}) AS x FROM conversations WHERE conv_id IS NOT NULL AND length(trim(text)) >= 12 GROUP BY 1, 2) SELECT conv_id, rank, x.t AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY x.turn, x.role, k) AS rank FROM t) WHERE rank <= 5",
    "continuation_cursor": "WITH t AS (SELECT conv_id, turn, coalesce(max(length(text)) % 2 = 0, false) AS goes_on FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, count(*) FILTER (WHERE NOT goes_on) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM t) SELECT conv_id, turn, (count(*) FILTER (WHERE goes_on) OVER (PARTITION BY conv_id, part ORDER BY turn)) % 3 AS cursor FROM p",
}
ORACLE["document_domains"] = f"WITH {_DOCS} SELECT doc_id, unnest({_DOMAIN_LIST}) AS domain FROM docs"
ORACLE["entity_sources"] = BASE["entity_merge"].rsplit("SELECT type, arg_min", 1)[0] + "SELECT type, lower(value) AS key, 'doc:' || CAST(doc_id AS VARCHAR) AS source, max(confidence) AS confidence FROM e GROUP BY 1, 2, 3"
