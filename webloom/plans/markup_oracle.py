"""The queries of markup_queries as SQL for an independent engine: over the tables, not over what Spark wrote of them."""

from .oracle import ORACLE as BASE

_BARE = "regexp_replace({}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<!--.*?-->', '', 'g')"


def _text(x: str) -> str:
    plain = f"regexp_replace({_BARE.format(x)}, '<[^>]*>', '', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


_ORDER = "'Order ' || o_orderkey || ' of customer ' || o_custkey || ' #c' || o_custkey"
_HAS_LINES = "o_orderkey IN (SELECT l_orderkey FROM lineitem)"

ORACLE = {
    "page_text_dom": f"SELECT page_id, {_text('html')} AS text FROM pages",
    "page_links_dom": BASE["link_anchor_last"],
    "page_posts": f"""SELECT page_id, pos - 1 AS pos, text FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS pos, text
FROM (SELECT page_id, {_text('x')} AS text, place FROM (SELECT page_id, unnest(a) AS x, unnest(range(len(a))) AS place FROM (SELECT page_id, regexp_extract_all(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM pages)))
WHERE length(text) > 15 AND length(text) < 4000 AND NOT regexp_matches(text, '(?i)\\bRT @|\\bretweeted\\b|\\brepost(ed|ing)?\\b|\\bshared (a )?post\\b|\\bshared from\\b|\\bvia @'))""",
    "order_images": """SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Line ' || l_linenumber || ' is part ' || l_partkey) - 1 AS pos, 'https://shop.net/i/' || l_partkey || '.png' AS image,
 'https://shop.net/part/' || l_partkey AS post, 'part ' || l_partkey AS alt FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "order_profiles": "SELECT o_orderkey AS page_id, 'Shop & order' AS display, NULL::VARCHAR AS bio, NULL::VARCHAR AS avatar FROM orders",
    "order_mentions": f"SELECT 'clerk_' || o_orderpriority[1] AS name, count(*) AS n, count(*) AS n_tags FROM orders WHERE {_HAS_LINES} GROUP BY 1",
    "embedded_posts": f"""SELECT o_orderkey AS page_id, {_ORDER} AS text, 'https://shop.net/o/' || o_orderkey AS link, strftime(o_orderdate, '%Y-%m-%d') AS published, 'c' || o_custkey AS hashtags FROM orders
UNION ALL SELECT l_orderkey, 'Line ' || l_linenumber || ' is part ' || l_partkey, 'https://shop.net/o/' || l_orderkey || '/' || l_linenumber, NULL, '' FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "embedded_images": """SELECT l_orderkey AS page_id, 'https://img.net/' || l_partkey || '.jpg' AS image, l_returnflag AS alt, 'https://shop.net/o/' || l_orderkey || tail AS post
FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES (0), (1)) AS o(k), LATERAL (SELECT CASE WHEN k = 0 THEN '' ELSE '/' || l_linenumber END AS tail)""",
    "social_content": f"""SELECT 'embedded' AS origin, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS n_posts, (SELECT count(*) FROM orders) AS n_pages
UNION ALL SELECT 'markup', count(*), count(*) FROM orders WHERE {_HAS_LINES} HAVING count(*) > 0""",
}
