"""The same queries as SQL for an independent engine."""

from ..functions import text as T
from ..functions import urls as U
from ..operators import chat, entities, regions, timeline, topic
from .queries import TOPIC

_Q = "'"


def _s(text: str) -> str:
    return _Q + text.replace(_Q, _Q * 2) + _Q


def _re(pattern: str) -> str:
    return _s(pattern.replace(T.B, r"\b").replace(T.E, r"\b"))


def _any(column: str, names) -> str:
    return f"{column} IN ({', '.join(map(_s, names))})"


_UNSAFE = r"""\x00-\x20"<>`{}\x7F-\x{10FFFF}"""


def _escaped(part: str) -> str:
    """Percent forms of the signs that an address can't hold, run by run."""
    runs = f"regexp_extract_all({part}, '[{_UNSAFE}]+|[^{_UNSAFE}]+')"
    return f"array_to_string(list_transform({runs}, lambda x: CASE WHEN regexp_matches(x, '^[{_UNSAFE}]') THEN url_encode(x) ELSE x END), '')"


_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"


def _part(url: str, g: int) -> str:
    return f"regexp_extract(trim({url}), {_PARTS}, {g})"


def _host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_part(url, 2)}, '^.*@', ''), ':[0-9]*$', ''))"


def _normal(url: str) -> str:
    port = f"regexp_extract({_part(url, 2)}, ':([0-9]+)$', 1)"
    path = f"CASE WHEN {_part(url, 3)} IN ('', '/') THEN '/' ELSE regexp_replace({_part(url, 3)}, '/$', '') END"
    scheme = f"lower({_part(url, 1)})"
    shown = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    return f"CASE WHEN {scheme} <> '' THEN {scheme} || '://' || {_host(url)} || ({shown}) || {_escaped(path)} || {_escaped(_part(url, 4))} || {_escaped(_part(url, 5))} END"




_LANG = r"""lower(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']+)["'']', 1))"""
_TITLE = r"nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '')"
_TAG = r"""'(?is)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)["''][^>]*>(.*?)</a>'"""
_LINKS = f"""raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, {_TAG}, 1)) AS href, unnest(regexp_extract_all(html, {_TAG}, 2)) AS a, unnest(range(len(regexp_extract_all(html, {_TAG}, 1)))) AS pos FROM pages),
links AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS anchor, target FROM (SELECT *, (SELECT {_normal('w')} FROM (SELECT CASE WHEN h = '' OR h LIKE '#%' OR regexp_matches(h, '(?i)^(mailto|javascript|tel|data):') THEN NULL
 WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN h LIKE '//%' THEN lower({_part('url', 1)}) || ':' || h WHEN h LIKE '/%' THEN lower({_part('url', 1)}) || '://' || {_part('url', 2)} || h
 WHEN h LIKE '?%' THEN lower({_part('url', 1)}) || '://' || {_part('url', 2)} || {_part('url', 3)} || h
 ELSE lower({_part('url', 1)}) || '://' || {_part('url', 2)} || regexp_replace(CASE WHEN {_part('url', 3)} = '' THEN '/' ELSE {_part('url', 3)} END, '[^/]*$', '') || regexp_replace(h, '^(\\./)+', '') END AS w)) AS target FROM (SELECT *, trim(href) AS h FROM raw)) WHERE target IS NOT NULL)"""


def _hits(text: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_s(n)}) AS INT)" for n in needles) + ")" if needles else "0"


def _score(text: str, t=TOPIC) -> str:
    low = f"lower(coalesce({text}, ''))"
    return f"least(1.0, {_hits(low, t.phrases[:6])} * 0.35::DOUBLE + least(0.55::DOUBLE, {_hits(low, t.terms)} / {float(max(1, len(t.terms)))}::DOUBLE * 0.55::DOUBLE))"


def _url_score(url: str, t=TOPIC) -> str:
    return f"least(1.0, {_score(url)} + {_hits(f'lower({url})', t.slugs)} * 0.25::DOUBLE + {_hits(url, U.SOCIAL_HOSTS)} * 0.05::DOUBLE)"


def _link_score(url: str, anchor: str) -> str:
    return f"least(1.0, {_url_score(url)} * 0.65::DOUBLE + {_score(anchor)} * 0.35::DOUBLE + CASE WHEN {_hits(url, U.SOCIAL_HOSTS)} > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)"


_RANKED = f"ranked AS (SELECT page_id, url, title, floor(x * 1000 + 0.5) / 1000 AS relevance FROM (SELECT page_id, url, {_TITLE} AS title, least(1.0, {_score(_TITLE)} * 0.35::DOUBLE + {_score('html')} * 0.45::DOUBLE + {_url_score('url')} * 0.2::DOUBLE) AS x FROM pages) WHERE x >= 0.12)"
_BLOCKED = f"""CASE WHEN {_part('url', 1)} = '' THEN 'invalid_url' WHEN lower({_part('url', 1)}) NOT IN ('http', 'https') THEN 'scheme_not_allowed' WHEN {_host('url')} IN ('localhost', '127.0.0.1', '::1', '0.0.0.0') THEN 'blocked_host'
 WHEN {_host('url')} LIKE '%.local' OR {_host('url')} LIKE '%.internal' THEN 'blocked_tld' WHEN regexp_matches({_host('url')}, '^10\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR regexp_matches({_host('url')}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9]+\\.[0-9]+$') OR regexp_matches({_host('url')}, '^192\\.168\\.[0-9]+\\.[0-9]+$') THEN 'private_ip'
 WHEN regexp_matches({_host('url')}, '^127\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'loopback_ip' WHEN regexp_matches({_host('url')}, '^169\\.254\\.[0-9]+\\.[0-9]+$') THEN 'link_local_ip' ELSE 'ok' END"""
_BARE = f"regexp_replace({_host('url')}, '^www\\.', '')"
_LIVE = f"""NOT (trim(url) = '' OR regexp_matches(url, {_s(U.BLOCKED_SCHEME)}) OR regexp_matches(url, {_s(U.BLOCKED_PATH)}) OR regexp_matches(url, {_s(U.SPEC_FILE)})) AND lower({_part('url', 1)}) IN ('http', 'https')
 AND NOT ({_any(_BARE, U.PLACEHOLDER_HOSTS)} OR regexp_matches({_BARE}, '\\.(local|test|localhost)$') OR regexp_matches({_BARE}, {_s(U.PRIVATE_PREFIX)})) AND NOT regexp_matches({_part('url', 3)}, {_s(U.BLOCKED_PATH)})"""
_NOISE = " OR ".join(f"regexp_matches(lower(url), {_s(p)})" for p in (U.IMAGE_URL, *U.CHROME_URLS))


def _plain() -> str:
    text = "html"
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "iframe", "svg"):
        text = f"regexp_replace({text}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    text = f"regexp_replace({text}, '(?s)<[^>]*>', '', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
    return f"CASE WHEN starts_with(trim(html), '<') THEN {squeeze(text)} ELSE {squeeze('html')} END"


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 40 AND 520)"""
_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


_DEFINITION = r"regexp_matches(sentence, '(?i)\b(is|are|was|were|means|refers?\s+to|defined\s+as|consists\s+of|involves|describes|known\s+as)\b')"
_DEFINES = rf"({_DEFINITION} OR regexp_matches(sentence, '(?i)^(an?\s+)?[a-z][\w\s-]{{0,60}}\s+(is|are|was|were)\s+(a|an|the)\b'))"
#: Points of a sentence as a definition; the tables' sentences have no address, so nothing is taken off for one.
_STYLE = rf"""(CASE WHEN {_DEFINES} THEN 4 ELSE 0 END - CASE WHEN regexp_matches(sentence, '(?i)\b(github|click here|sign up|subscribe|cookie|privacy policy|terms of service|download now|get started|our platform|self-evolving memory|portable memory layer)\b') THEN 6 ELSE 0 END
 - CASE WHEN regexp_matches(sentence, '(?i)\b(comments:\s*\d+\s+pages|subjects:|figures,\s+\d+\s+appendices|arxiv:|doi:|(vol\.|pp\.)\s*\d)\b') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(sentence, '(?i)\b(modular|runtime|repository|repo|agent|platform)\b') AND NOT {_DEFINITION} THEN 2 ELSE 0 END)"""


def _ranked_sentences(question: str) -> str:
    q = topic.Question.parse(question)
    n = " + ".join(f"CAST(contains(low, {_s(t)}) OR contains(low, {_s(t[:-1] if t.endswith('s') and len(t) > 4 else t if t.endswith('s') else t + 's')}) AS INT)" for t in q.terms)
    extra = f"+ {_STYLE} + CASE WHEN contains(low, {_s(q.focus.lower())}) THEN 2 ELSE 0 END" if q.definition else ""
    keep = f"WHERE {_DEFINES}" if q.definition else ""
    return f"""WITH {_DOCS}, s AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS x FROM docs)), t AS (SELECT *, lower(sentence) AS low FROM s),
 u AS (SELECT *, ({n}) AS n FROM t {keep}) SELECT doc_id, pos, sentence, score FROM (SELECT doc_id, pos, sentence, CASE WHEN n > 0 THEN CAST(n + n / {float(len(q.terms))}::DOUBLE * 2 {extra} AS DOUBLE) ELSE 0 END AS score FROM u) WHERE score > 0 ORDER BY score DESC, length(sentence) DESC, doc_id, pos LIMIT 50"""




def _ordered_distinct(items: str) -> str:
    return f"list_filter({items}, lambda one, i: list_position({items}, one) = i)"


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE = r"(\+?1[-.\s]?)?(\(?[2-9][0-9]{2}\)?[-.\s]?)[2-9][0-9]{2}[-.\s]?[0-9]{4}\b"
_EMAIL_LIST = _ordered_distinct(f'regexp_extract_all(text, {_s(_EMAIL)})')
_PHONE_ALL = f"""list_filter(regexp_extract_all(text, {_s(_PHONE)}), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) IN (10, 11) AND NOT regexp_matches(regexp_replace(p, '[^0-9]', '', 'g'), '^(19|20)[0-9][0-9]'))"""
_PHONE_LIST = _ordered_distinct(_PHONE_ALL)
_DOMAINS = (
    ("Artificial Intelligence", "artificial intelligence|ai\\b|machine learning|ml\\b|deep learning|neural network|llm|large language model"), ("Prompt Engineering", "prompt engineering|prompt expert|prompt design|chain-of-thought"),
    ("Cybersecurity", "cybersecurity|infosec|penetration testing|osint|threat intelligence"), ("Web Crawling & Data", "web scraping|crawling|spider|data extraction"), ("Blockchain", "blockchain|cryptocurrency|web3|smart contract"),
    ("Cloud & DevOps", "cloud computing|devops|kubernetes|docker|aws|azure|gcp"), ("Finance", "finance|economics|investment|trading|accounting"),
    ("Healthcare & Life Sciences", "medicine|healthcare|clinical|pharmaceutical|biology"), ("Law & Policy", "law|legal|jurisprudence|litigation|regulation"),
)
_DOMAIN_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b({p})') THEN {_s(n)} END" for n, p in _DOMAINS) + "], lambda x: x IS NOT NULL)"
_BUSINESS = r"""'\b([A-Z][A-Za-z0-9&.''-]*(?: [A-Z][A-Za-z0-9&.''-]*){0,4}) (?:LLC|Inc\.|Corp\.|Corporation|Company|Co\.)'"""
_PAY = "list_concat(" + ", ".join(f"regexp_extract_all(lower(text), {_s(p)})" for p in entities.COMPENSATION) + ")"


def _region() -> str:
    host = _host("url")
    by_host = "CASE " + " ".join("WHEN " + " OR ".join([*(f"{host} = '{d}' OR {host} LIKE '%.{d}'" for d in domains), *(f"{host} LIKE '%{t}'" for t in tlds)]) + f" THEN '{code}'" for code, _, _, tlds, domains, _ in regions.REGIONS) + " END"
    by_lang = "CASE " + " ".join(f"WHEN {_any(_LANG, hints)} OR {_any(f'string_split({_LANG}, {_s(chr(45))})[1]', hints)} THEN '{code}'" for code, *_, hints in regions.REGIONS) + " END"
    scripts = {"RU": "\\x{0400}-\\x{04FF}", "CN": "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}", "IN": "\\x{0900}-\\x{097F}", "SA": "\\x{0600}-\\x{06FF}", "KR": "\\x{AC00}-\\x{D7AF}", "JP": "\\x{3040}-\\x{30FF}"}
    by_script = "CASE " + " ".join(f"WHEN regexp_matches(html, '[{p}]') THEN '{code}'" for code, p in scripts.items()) + " END"
    return f"(SELECT coalesce(CASE WHEN h <> 'GLOBAL' THEN h END, l, s, h, 'GLOBAL') FROM (SELECT {by_host} AS h, {by_lang} AS l, {by_script} AS s))"


_REGION_COUNTS = f"SELECT {_region()} AS region, count(*) AS n_pages FROM pages GROUP BY 1"
_ORDERS_TEXT = "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Left the team on ' WHEN 'O' THEN 'Joined the team on ' ELSE 'Met on ' END || strftime(o_orderdate, '%Y-%m-%d') || '.' AS text, o_orderdate, o_orderstatus FROM orders"
_EMPLOYED = "SELECT o_custkey AS who, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS company, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders"
_SPANS = f"spans AS (SELECT who, company, min(CASE WHEN s = 'O' THEN date END) AS start, max(CASE WHEN s = 'F' THEN date END) AS \"end\" FROM ({_EMPLOYED}) GROUP BY 1, 2)"
_CAPTURES = "captures AS (SELECT 'u' || CAST(user_id % 20 AS VARCHAR) AS url, ts, event_id % 7 <> 0 AS ok FROM events)"


def _values(rows: str, columns: str) -> str:
    return f"(VALUES {rows}) AS t({columns})"


def _rule(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(trim({text})), {_re(p)}) THEN '{n}'" for n, p in chat.RULES) + " ELSE 'none' END"


_HAS = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
_EXPLAINS, _TECHNICAL, _NAMED = f"regexp_matches(lower(q), {_re(chat.KNOWLEDGE)})", f"regexp_matches(lower(q), {_re(chat.TECHNICAL)})", f"regexp_matches(q, {_re(chat.NAME)})"
_WORDS = "regexp_split_to_array(q, '\\s+')"

#: Modes of what is said and asked; {rows} stands for the rows.
_CHAT_MODE = f"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(lower(text), {_re(chat.CONTINUE)}) THEN 'continuation' WHEN rule <> 'none' THEN 'rule' WHEN len(regexp_extract_all(text, '\\S+')) <= 3 AND NOT contains(text, '?') THEN 'two_phrase' ELSE 'reflect' END AS mode, rule FROM (SELECT *, {_rule('text')} AS rule FROM ({{rows}}))"
_SEARCH_MODE = f"""SELECT p_partkey, CASE WHEN p + {_HAS(f"proper >= 2 AND proper >= len({_WORDS}) * 0.4", 2)} + {_HAS(f"regexp_matches(lower(q), {_re(chat.LOOKUP)})", 2)} >= k THEN 'people' ELSE 'knowledge' END AS mode FROM (SELECT *, CASE WHEN {_EXPLAINS} AND {_TECHNICAL} THEN greatest(p0 - 2, 0) ELSE p0 END AS p FROM (SELECT p_partkey, q, {_HAS(f"regexp_matches(lower(q), {_re(chat.PERSON)})", 3)} + {_HAS(_NAMED, 2)} AS p0,
 {_HAS(_EXPLAINS, 3)} + {_HAS(f"regexp_matches(lower(q), '{chr(92)}b(is|are|was|were){chr(92)}b') AND {_TECHNICAL}", 2)} + {_HAS(f"{_TECHNICAL} AND NOT {_NAMED}", 2)} + {_HAS(f"{_EXPLAINS} AND {_TECHNICAL}", 2)} + {_HAS(f"len({_WORDS}) <= 2 AND {_TECHNICAL}", 2)} AS k, len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[A-Z][a-z]+'))) AS proper
 FROM ({{rows}})))"""

ORACLE = {
    "url_normalize": f"SELECT page_id, {_normal('url')} AS url FROM pages",
    "url_host": f"SELECT page_id, {_BARE} AS host FROM pages",
    "host_page_counts": f"SELECT {_host('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1",
    "noise_url_flag": f"WITH {_LINKS}, u AS (SELECT unnest([target, target || '.PNG?x', replace(target, {_host('target')}, 'github.com/features')]) AS url FROM links UNION SELECT url FROM pages) SELECT url, {_NOISE} AS noise FROM u",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_content_hash": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "content_shard_counts": "SELECT substr(sha256(html), 1, 2) AS shard, count(*) AS n FROM pages GROUP BY 1",
    "page_html_lang": f"SELECT page_id, nullif({_LANG}, '') AS lang FROM pages",
    "page_plain_text": f"SELECT page_id, {_plain()} AS text FROM pages",
    "needs_js_flag": f"SELECT page_id, length(html) < 500 OR (regexp_matches(html, '(?i)<noscript') AND len(regexp_extract_all(html, '(?i)<a\\s+href=')) < 3) OR regexp_matches(html, {_s(T.FRAMEWORKS)}) AS needs_js FROM pages",
    "link_edges": f"WITH {_LINKS} SELECT page_id, target, min(pos) AS pos FROM links GROUP BY 1, 2",
    "link_outdegree": f"WITH {_LINKS} SELECT page_id, count(DISTINCT target) AS n_links FROM links GROUP BY 1",
    "link_indegree": f"WITH {_LINKS} SELECT target, count(DISTINCT page_id) AS n_pages FROM links GROUP BY 1",
    "link_anchor_last": f"WITH {_LINKS} SELECT page_id, target, min(pos) AS pos, arg_max(anchor, pos) AS anchor FROM links GROUP BY 1, 2",
    "child_cap_per_page": f"WITH {_LINKS}, c AS (SELECT page_id, target AS url, max(round({_link_score('target', 'anchor')} * 100)) AS priority, min(pos) AS pos FROM links GROUP BY 1, 2) SELECT page_id, url, CAST(priority AS INT) AS priority, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pos) AS rank FROM c) WHERE rank <= 3",
    "topic_terms": f"SELECT item_id, array_to_string({_ordered_distinct('x')}, ' ') AS terms FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_@.-]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT {_any('t', T.TOPIC_STOP)}) AS x FROM benchmark)",
    "topic_phrases": "SELECT item_id, array_to_string(" + _ordered_distinct("p") + ", '|') AS phrases FROM (SELECT item_id, list_filter(list_concat(" + ", ".join(f"list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: lower(array_to_string(list_slice(w, i, i + {n - 1}), ' ')))" for n in (4, 3, 2)) + "), lambda x: length(x) > 4) AS p FROM (SELECT item_id, regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f]+') AS w FROM benchmark))",
    "topic_slugs": f"SELECT item_id, array_to_string({_ordered_distinct('y')}, '|') AS slugs FROM (SELECT item_id, list_concat(CASE WHEN len(x) >= 2 THEN [array_to_string(x[1:2], '-'), array_to_string(x[1:3], '-'), array_to_string(x[1:2], '_')] ELSE [] END, list_filter(x, lambda t: length(t) > 3)) AS y FROM (SELECT item_id, {_ordered_distinct('z')} AS x FROM (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9_@.-]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT {_any('t', T.TOPIC_STOP)}) AS z FROM benchmark)))",
    "topic_page_ranking": f"WITH {_RANKED} SELECT page_id, title, relevance FROM ranked ORDER BY relevance DESC, page_id LIMIT 20",
    "topic_report_stats": f"WITH {_RANKED} SELECT count(*) AS n_pages, count(DISTINCT {_host('url')}) AS n_hosts, max(relevance) AS best FROM ranked",
    "topic_follow_links": f"WITH {_LINKS}, l AS (SELECT *, target AS url FROM links) SELECT page_id, count(*) AS n_followed FROM l WHERE NOT ({_NOISE}) AND {_link_score('target', 'anchor')} >= CASE WHEN {' OR '.join(f'contains({_host("target")}, {_s(h)})' for h in U.SOCIAL_HOSTS)} THEN 0.1::DOUBLE ELSE 0.1::DOUBLE + 0.05::DOUBLE END GROUP BY 1",
    "doc_tokens": f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}'), lambda t: NOT {_any('t', T.QUESTION_STOP)}))) AS n_tokens FROM documents",
    "doc_sentences": f"WITH {_DOCS} SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM docs) GROUP BY 1",
    "sentence_topk": _ranked_sentences("thing ingthe hationtion"),
    "definition_topk": _ranked_sentences("what is thing"),
    "entity_emails": f"WITH {_DOCS} SELECT doc_id, unnest({_EMAIL_LIST}) AS email FROM docs",
    "entity_phones": f"WITH {_DOCS} SELECT doc_id, unnest({_PHONE_LIST}) AS phone FROM docs",
    "entity_merge": f"""WITH {_DOCS}, e AS (SELECT doc_id, 'email' AS type, unnest({_EMAIL_LIST}) AS value, unnest(range(len({_EMAIL_LIST}))) AS pos, 0.9::DOUBLE AS confidence FROM docs
 UNION ALL SELECT doc_id, 'phone', unnest({_PHONE_LIST}), 100 + unnest(range(len({_PHONE_LIST}))), 0.85::DOUBLE FROM docs UNION ALL SELECT doc_id, 'domain', unnest({_DOMAIN_LIST}), 200 + unnest(range(len({_DOMAIN_LIST}))), 0.7::DOUBLE FROM docs)
 SELECT type, arg_min(value, doc_id * 1000 + pos) AS value, max(confidence) AS confidence, count(DISTINCT doc_id) AS n_sources FROM e GROUP BY type, lower(value)""",
    "region_counts": _REGION_COUNTS,
    "region_coverage": f"SELECT region, name, coalesce(n_pages, 0) AS n_pages, n_pages IS NULL AS missing FROM (VALUES {', '.join(f'({_s(r[0])}, {_s(r[1])})' for r in regions.REGIONS)}) AS d(region, name) LEFT JOIN ({_REGION_COUNTS}) USING (region)",
    "dated_events": f"SELECT doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'day' AS precision, CASE o_orderstatus WHEN 'F' THEN 'employment_end' WHEN 'O' THEN 'employment_start' ELSE 'general' END AS category FROM ({_ORDERS_TEXT})",
    "dated_event_dedupe": "SELECT l_orderkey, month, category, confidence, seq FROM (SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS category, l_discount AS confidence, CAST(l_linenumber AS BIGINT) AS seq, row_number() OVER (PARTITION BY l_orderkey, strftime(l_shipdate, '%Y-%m'), l_returnflag ORDER BY l_discount DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "timeline_spans": f"WITH {_SPANS} SELECT who, company, start, \"end\", CASE WHEN \"end\" IS NOT NULL THEN 'past' WHEN start IS NOT NULL THEN 'current' ELSE 'unknown' END AS status FROM spans",
    "timeline_transitions": f"WITH {_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY start, company) AS i FROM spans WHERE start IS NOT NULL) SELECT a.who, a.company AS from_company, b.company AS to_company, b.start AS moved FROM n a JOIN n b ON a.who = b.who AND a.i < b.i AND a.company <> b.company WHERE a.\"end\" IS NOT NULL AND b.start >= a.\"end\"",
    "timeline_recent": f"WITH {_SPANS} SELECT who, company, coalesce(\"end\", '9999') AS shown FROM spans ORDER BY shown DESC, who, company LIMIT 50",
    "snapshot_daily_collapse": f"WITH {_CAPTURES}, d AS (SELECT url, strftime(ts, '%Y%m%d') AS day, min(ts) AS ts FROM captures WHERE ok GROUP BY 1, 2) SELECT url, day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts) AS n FROM d) WHERE n <= 10",
    "snapshot_asof_latest": f"WITH {_CAPTURES}, w AS (SELECT url, CAST((epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS BIGINT) AS upto FROM captures GROUP BY 1), v AS (SELECT url, upto FROM w UNION ALL SELECT url, NULL FROM w) SELECT v.url, v.upto IS NULL AS latest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM v JOIN captures c ON c.url = v.url AND (v.upto IS NULL OR epoch_us(c.ts) <= v.upto) GROUP BY v.url, v.upto",
    "frontier_dedupe": f"WITH {_LINKS} SELECT target AS url, min(page_id * 1000 + pos) AS seq FROM links WHERE target NOT IN (SELECT {_normal('url')} FROM pages WHERE page_id % 2 = 0) GROUP BY 1",
    "frontier_pop_topk": "SELECT job, priority, depth, seq FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY priority DESC, depth, seq) AS n FROM (SELECT event_type AS job, CAST(floor(value) AS BIGINT) AS priority, CAST(user_id % 4 AS INT) AS depth, event_id AS seq FROM events)) WHERE n <= 5",
    "crawl_reachability": f"WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT {_normal('p.url')} AS parent, l.target AS child FROM links l JOIN pages p USING (page_id)), r AS (SELECT {_normal('url')} AS url, 0 AS depth FROM pages WHERE page_id % 50 = 0 UNION SELECT child, depth + 1 FROM r JOIN e ON parent = r.url WHERE depth < 3) SELECT url, min(depth) AS depth FROM r GROUP BY 1",
    "crawl_saturation": "WITH s AS (SELECT CAST(event_id // 1000 AS INT) AS wave, user_id FROM events), f AS (SELECT user_id, min(wave) AS wave FROM s GROUP BY 1) SELECT wave, count(f.user_id) AS n_new, count(f.user_id) = 0 AS saturated FROM (SELECT DISTINCT wave FROM s) LEFT JOIN f USING (wave) GROUP BY 1",
    "pages_limit_offset": "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10 OFFSET 20",
    "jobs_latest_status": "SELECT job, status, n AS n_changes FROM (SELECT o_custkey AS job, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1",
    "rate_window_60s": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_window FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "host_slot_spacing": "SELECT event_id, CAST(max(s - n * 500) OVER (PARTITION BY user_id ORDER BY s, event_id) + n * 500 AS BIGINT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))",
    "replay_dedupe": "SELECT event_id, coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 3600, false) AS replay FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "allowlist_semijoin": "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "chat_phrase_alternation": "SELECT conv_id, turn, CASE WHEN (n - 1) % 2 = 0 THEN 'Tell me more.' ELSE 'This is interesting.' END AS reply FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL)",
    "network_edges_top": f"WITH {_RANKED}, {_LINKS}, top AS (SELECT page_id FROM ranked ORDER BY relevance DESC, page_id LIMIT 20) SELECT page_id, target FROM (SELECT page_id, target, min(pos) AS pos FROM links WHERE page_id IN (SELECT page_id FROM top) GROUP BY 1, 2) ORDER BY page_id, pos, target LIMIT 100",
}
