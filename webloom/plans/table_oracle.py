"""The queries of table_queries as SQL for an independent engine: what each form must come to, written from the forms."""

from .oracle import _CHAT_MODE, _DOCS, _DOMAIN_LIST, _LINKS, _SEARCH_MODE, _host, _normal, _part, _s

_H = _host("url")
#: (form, why it is not fetched, whether it is live, what a preflight says)
_ADDRESSES = (
    ("'http://127.0.0.1/' || k", "blocked_host", False, "domain_not_allowed"), ("'http://10.1.2.' || k || '/'", "private_ip", False, "domain_not_allowed"), ("'ftp://' || h || '/' || k", "scheme_not_allowed", False, "scheme_not_allowed"),
    ("'https://h' || k || '.local/'", "blocked_tld", False, "domain_not_allowed"), ("'http://172.20.0.1/' || k", "private_ip", False, "domain_not_allowed"), ("'http://192.168.1.1/' || k", "private_ip", False, "domain_not_allowed"),
    ("'http://169.254.169.254/' || k", "link_local_ip", True, "domain_not_allowed"), ("'https://' || h || '/tests/' || k", "ok", False, None), ("'https://' || h || '/' || k || '.png'", "ok", True, None),
    ("'https://www.example.com/' || k", "ok", False, "domain_blocked"), ("'https://' || h || '.fine.net/page/' || k", "ok", True, "ok"), ("'nonsense ' || k", "invalid_url", False, "scheme_not_allowed"),
    ("'https://github.com/features/' || k", "ok", True, "domain_not_allowed"), ("'http://localhost:8080/' || k", "blocked_host", False, "domain_not_allowed"),
)


def _addresses(column: int) -> str:
    told = lambda x: "NULL" if x is None else _s(x) if isinstance(x, str) else str(x).lower()
    return " UNION ALL ".join(f"SELECT {a[0]} AS url, h, {told(a[column])} AS told FROM (SELECT page_id AS k, {_H} AS h FROM pages)" for a in _ADDRESSES)


_S, _A, _P = (f"lower({_part('url', 1)})", _part("url", 2), _part("url", 3))
_ROOT = f"{_S} || '://' || {_H}"
#: Segments of the page's folder, as a list; links by their number and what they come to.
_FOLDER = f"list_filter(string_split(regexp_replace({_P}, '[^/]*$', ''), '/'), lambda x: x <> '')"
_UP = "array_to_string(list_concat(f[1:greatest(len(f) - {up}, 0)], {tail}), '/')"
_TARGETS = (
    (0, f"root || '/' || {_UP.format(up=1, tail=['a', 'b'])}"), (1, f"root || '/' || {_UP.format(up=0, tail=['x', 'y'])}"), (2, f"root || '/' || {_UP.format(up=0, tail=['y'])}"), (3, f"root || '/' || {_UP.format(up=3, tail=['z'])}"),
    (4, "root || '/p/r'"), (5, f"root || '/' || {_UP.format(up=0, tail='[]')}"), (6, f"root || '/' || {_UP.format(up=1, tail=['up'])}"), (7, "CASE WHEN s = 'http' THEN 'http://other.net/y' ELSE 'https://other.net:80/y' END"),
    (8, "root || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END || '?q=' || page_id"), (11, f"root || '/' || {_UP.format(up=0, tail='[' + chr(39) + 'd%20%C3%A9' + chr(39) + ', page_id::VARCHAR]')}"), (12, "'http://' || page_id || '.net/'"),
)

#: (form, platform, user name, canonical beginning)
_PROFILES = (
    ("'https://x.com/Some_' || k", "twitter", "'Some_' || k", "https://x.com/"), ("'https://www.facebook.com/groups/' || k", "facebook", None, None), ("'https://facebook.com/some.' || k || '/'", "facebook", "'some.' || k", "https://facebook.com/"),
    ("'https://www.linkedin.com/in/Some-' || k", "linkedin", "'Some-' || k", "https://linkedin.com/in/"), ("'https://github.com/search'", "github", None, None), ("'https://github.com/Some-' || k", "github", "'Some-' || k", "https://github.com/"),
    ("'https://m.youtube.com/@Chan' || k", "youtube", "'Chan' || k", "https://youtube.com/@"), ("'https://fosstodon.social/@Bob' || k", "mastodon", "'Bob' || k", "https://fosstodon.social/@"),
    ("'https://mastodon.social/@Bob' || k", "mastodon", "'Bob' || k", "https://mastodon.social/@"), ("'https://www.tiktok.com/@t.' || k", "tiktok", "'t.' || k", "https://tiktok.com/@"), None,
    ("'https://www.threads.net/@A' || k || '?x=1'", "threads", "'A' || k", "https://threads.net/@"),
)
_PROFILE_ROWS = " UNION ".join(
    f"SELECT {p[0]} AS url, '{p[1]}' AS platform, {p[2] or 'NULL'} AS username, {f'{_s(p[3])} || lower({p[2]})' if p[2] else 'NULL'} AS profile_url FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 12 = {i})"
    for i, p in enumerate(_PROFILES) if p
)

_FIRM = f"firms AS (SELECT s_suppkey AS id, s_acctbal, array_to_string(list_transform(string_split(replace(n_name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || s_suppkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_SLUG = lambda c: f"replace(lower({c}), ' ', '-')"
_CRAWL = f"{_LINKS}, e AS (SELECT DISTINCT {_normal('p.url')} AS parent, l.target AS child FROM links l JOIN pages p USING (page_id)), seeds AS (SELECT DISTINCT {_normal('url')} AS url FROM pages WHERE page_id % 10 = 0)"
_CUE = ("'tell me more about ' || t", "'What is ' || t || '?'", "'ok'", "'I want to die, always'", "'my mother called'", "'I am tired of ' || t", "'why does ' || t || ' rain?'", "t", "''", "'Hello there'")
_CUED = f"SELECT conv_id, turn, CASE (conv_id + turn) % 10 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_CUE))} END AS text FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)"

_KEY = b"a key of the test chain".ljust(64, b"\0")
_PAD = lambda byte: "'" + "".join(f"\\x{b ^ byte:02X}" for b in _KEY) + "'::BLOB"
_MAC = lambda message: f"sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode({message}))))"
_ENTRY = "SELECT event_id, 'e' || event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_, event_type AS kind, coalesce(props, '') AS detail, coalesce('e' || lag(event_id) OVER (ORDER BY event_id), '') AS prev FROM events"
_MESSAGE = lambda detail: f"concat_ws('|', id, at_, kind, CASE WHEN prev = '' THEN 'GENESIS' ELSE prev END, {detail})"
_FAULTS = f"""chain AS ({_ENTRY}), kept AS (SELECT *, CASE WHEN event_id % 97 = 5 THEN 'changed' ELSE detail END AS now FROM chain WHERE event_id % 89 <> 0 OR event_id = 0),
seen AS (SELECT *, coalesce(lag(id) OVER (ORDER BY event_id), '') AS expected FROM kept),
faults AS (SELECT event_id, id, 'mac' AS fault, 0 AS o FROM seen WHERE now <> detail UNION ALL SELECT event_id, id, 'link', 1 FROM seen WHERE prev <> expected)"""

#: The limiter's state, one request after another: admissions of the last minute, ends of what is open.
_TIMES, _OPEN = "list_filter(s.times, lambda v: v >= e.t - 60)", "list_filter(s.ends, lambda v: v > e.t)"
_ROOM = f"len({_TIMES}) < 6 AND len({_OPEN}) < 4"
_HALF = lambda n: f"('0x' || substr(md5(k), {n}, 15))::BIGINT"
_ROLE_RANK = "CASE {} WHEN 'viewer' THEN 1 WHEN 'operator' THEN 2 WHEN 'admin' THEN 3 WHEN 'sovereign' THEN 4 ELSE 0 END"

ORACLE = {
    "ssrf_reason": f"SELECT url, told AS reason FROM ({_addresses(1)})",
    "live_url_flag": f"SELECT url, told AND NOT (h LIKE '%.test' OR h IN ('example.com', 'example.org', 'example.net')) AS live FROM ({_addresses(2)})",
    "preflight_reason": f"SELECT url, coalesce(told, CASE WHEN h = 'www.example.com' THEN 'domain_blocked' WHEN h = 'example.com' OR h LIKE '%.example.com' OR h = 'fine.net' OR h LIKE '%.fine.net' THEN 'ok' ELSE 'domain_not_allowed' END) AS reason FROM ({_addresses(3)})",
    "link_resolution": f"WITH b AS (SELECT page_id, {_S} AS s, {_P} AS p, {_ROOT} AS root, {_FOLDER} AS f FROM pages) " + " UNION ALL ".join(f"SELECT page_id, {i} AS form, CASE WHEN t LIKE '%://%/_%' THEN regexp_replace(t, '/$', '') ELSE t END AS target FROM (SELECT page_id, {t} AS t FROM b)" for i, t in _TARGETS),
    "social_profiles": _PROFILE_ROWS,
    "knowledge_domains": f"WITH {_DOCS} SELECT doc_id, array_to_string({_DOMAIN_LIST}, '|') AS domains FROM docs",
    "business_mentions": f"WITH {_FIRM} SELECT id, 'registered entity' AS kind, 'We buy from ' || n || CASE id % 4 WHEN 0 THEN ' Works' ELSE '' END AS value FROM firms WHERE id % 4 = 0",
    "compensation_mentions": f"WITH {_FIRM}, m AS (SELECT id, printf('$%.2f', abs(s_acctbal)) AS pay FROM firms) SELECT id, 'compensation' AS kind, pay || '/hr' AS value FROM m WHERE id % 4 = 0 UNION ALL SELECT id, 'compensation', 'pays ' || pay || CASE id % 4 WHEN 0 THEN '/hr' WHEN 2 THEN ' annually' ELSE '' END FROM m",
    "hashtag_counts": "SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_concat([regexp_extract(p_brand, '#(.*)', 1)], list_transform(string_split(p_type, ' '), lambda x: lower(x)))) AS tag FROM part) WHERE length(tag) >= 2 GROUP BY 1",
    "date_mentions": """SELECT o_orderkey AS id, strftime(CASE WHEN o_orderkey % 6 = 3 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 6 = 3 THEN 'month' ELSE 'day' END AS precision FROM orders
UNION ALL SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), 'month' FROM orders WHERE o_orderkey % 6 = 1 UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), 'day' FROM orders WHERE o_orderkey % 6 = 5""",
    "capture_list_rows": "SELECT user_id AS id, strftime(ts, '%Y%m%d%H%M%S') AS ts, 'http://u' || user_id || '/' || event_type AS url FROM events",
    "crawl_budgeted": f"""WITH {_CRAWL}, w0 AS (SELECT url, 0 AS depth, 0 AS wave FROM seeds ORDER BY url LIMIT 30), left0 AS (SELECT url, 100 AS priority, 0 AS depth FROM seeds WHERE url NOT IN (SELECT url FROM w0)),
c1 AS (SELECT child AS url, 49 AS priority, 1 AS depth FROM w0 JOIN e ON parent = url), f1 AS (SELECT url, max(priority) AS priority, min(depth) AS depth FROM (SELECT * FROM left0 UNION ALL SELECT * FROM c1) WHERE url NOT IN (SELECT url FROM w0) GROUP BY 1),
w1 AS (SELECT url, depth, 1 AS wave FROM f1 ORDER BY priority DESC, depth, url LIMIT least(30, 40 - (SELECT count(*) FROM w0))) SELECT url, depth, wave FROM w0 UNION ALL SELECT url, depth, wave FROM w1""",
    "api_key_verify": "SELECT c_custkey, sha256('key-' || c_custkey) AS hash, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'none' END AS role FROM customer",
    "rbac_decision": f"""SELECT event_id, needs, {_ROLE_RANK.format('role')} >= {_ROLE_RANK.format('needs')} AS allowed FROM (SELECT event_id, ['viewer', 'operator', 'admin', 'sovereign', 'nobody'][user_id % 5 + 1] AS role, ['viewer', 'operator', 'operator', 'admin', 'admin', 'operator'][event_id % 6 + 1] AS needs FROM events)""",
    "robots_decision": f"""SELECT url, CASE WHEN length(h) % 3 = 0 THEN true WHEN p LIKE '/fr/1%' THEN true WHEN p LIKE '/de/2%' THEN false WHEN p LIKE '/en/%' THEN true WHEN p LIKE '/fr%' THEN false ELSE true END AS allowed FROM (SELECT DISTINCT url, {_H} AS h, {_P} AS p FROM pages)""",
    "domain_seed_resolve": f"""SELECT {_SLUG('r_name')} || '.' || {_SLUG('n_name')} AS domain, CASE WHEN n_nationkey % 6 = 0 THEN 'https://whole.net/' || {_SLUG('n_name')} WHEN n_nationkey % 3 = 0 THEN 'https://n.net/' || {_SLUG('n_name')} WHEN r_regionkey % 2 = 0 THEN 'https://r.net/' || {_SLUG('r_name')} ELSE 'https://d.net/' END AS seed FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "sitemap_nested": "SELECT 'world' AS url, 0 AS level UNION ALL SELECT 'r/' || r_regionkey, 1 FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'n/' || n_nationkey, 2 FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'c/' || c_custkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3",
    "sitemap_locations": f"SELECT {_H} AS host, url AS loc FROM pages",
    "robots_sitemaps": f"SELECT h AS host, unnest(['https://' || h || '/a.xml', 'http://' || h || '/b.xml']) AS loc FROM (SELECT DISTINCT {_H} AS h FROM pages)",
    "regional_seeds": "SELECT topic, 'https://' || wiki || '.wikipedia.org/wiki/Special:Search?search=' || replace(topic, ' ', '%20') || '&fulltext=1' AS seed FROM (SELECT DISTINCT p_type AS topic FROM part), (SELECT unnest(['en', 'hi', 'zh', 'ru', 'ja', 'de', 'pt', 'ar', 'ko', 'fr']) AS wiki)",
    "engine_select": "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'http' WHEN 3 THEN 'http' WHEN 4 THEN 'playwright' ELSE CASE WHEN user_id % 3 > 0 THEN 'archive' WHEN value > 50 THEN 'playwright' ELSE 'http' END END AS engine FROM events",
    "firm_names": f"""WITH {_FIRM} SELECT id, trim(regexp_replace(lower(n) || CASE id % 4 WHEN 0 THEN ' works' WHEN 1 THEN ' inc' ELSE '' END, '[^a-z0-9]+', ' ', 'g')) AS key, CASE id % 4 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Inc' END AS form,
 id || ' north st town' AS address, CASE WHEN id % 3 = 0 THEN true WHEN id % 3 = 1 THEN false ELSE id::VARCHAR NOT LIKE '___%' AND false END AS same_place FROM firms""",
    "chat_mode": _CHAT_MODE.replace("{rows}", _CUED),
    "search_mode_classify": _SEARCH_MODE.replace("{rows}", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'how does ' || lower(p_type) || ' algorithm work' WHEN 1 THEN 'Jane Doe, family in Ohio and ' || lower(p_type) WHEN 2 THEN lower(p_type) WHEN 3 THEN 'what is quantum ' || lower(p_type) ELSE 'find John Smith of ' || lower(p_type) END AS q FROM part"""),
    "audit_chain_append": f"SELECT id, prev, {_MAC(_MESSAGE('detail'))} AS mac FROM ({_ENTRY})",
    "audit_chain_verify": f"WITH {_FAULTS} SELECT event_id, id, fault FROM faults",
    "vital_state": f"WITH {_FAULTS} SELECT 'broken' AS chain, count(*) = 0 AS vital, arg_min(id || ' ' || fault, event_id * 2 + o) AS reason FROM faults UNION ALL SELECT 'whole', true, NULL",
    "global_limiter": f"""WITH q AS (SELECT event_id AS id, (epoch_us(ts) // 20000000)::DOUBLE AS t, (user_id % 5) * 20 + 1 AS d FROM events), l AS (SELECT list({{'id': id, 't': t, 'u': t + d}} ORDER BY t, id) AS x FROM q),
s AS (SELECT list_reduce(x, lambda s, e: struct_pack(times := CASE WHEN {_ROOM} THEN list_append({_TIMES}, e.t) ELSE {_TIMES} END, ends := CASE WHEN {_ROOM} THEN list_append({_OPEN}, e.u) ELSE {_OPEN} END, good := CASE WHEN {_ROOM} THEN list_append(s.good, e.id) ELSE s.good END),
 struct_pack(times := []::DOUBLE[], ends := []::DOUBLE[], good := []::BIGINT[])) AS r FROM l) SELECT event_id AS id, event_id IN (SELECT unnest(r.good) FROM s) AS admitted FROM events""",
    "key_fingerprint": f"""WITH k AS (SELECT DISTINCT event_type || s AS who, 'k' || user_id AS k FROM events, (VALUES (''), ('-again')) AS v(s)),
a AS (SELECT who, count(*) AS n_keys, bit_xor({_HALF(1)}) AS x, sum({_HALF(1)}) AS s, bit_xor({_HALF(17)}) AS y, sum({_HALF(17)}) AS t FROM k GROUP BY 1) SELECT who, n_keys, sha256(concat_ws(':', n_keys, x, s, y, t)) AS fingerprint FROM a""",
}
