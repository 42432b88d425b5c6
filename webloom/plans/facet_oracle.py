"""The queries on what phrases name as SQL for an independent engine."""

from ..operators import chat, facets
from .facet_queries import ALT, IMAGES, SENTENCES
from .oracle import _re


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def _clean(v: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({v}, '[ \t\n\r\f]+', ' ', 'g')), '[.,;]+$', '')"


_SAID = f"said AS (SELECT id, name, replace({_list(SENTENCES)}[id % {len(SENTENCES)} + 1], '{{}}', name) AS text FROM (SELECT c_custkey AS id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || c_custkey AS name FROM customer))"


def _rows(phrases) -> str:
    """id, kind, value of every match, cleaned."""
    return " UNION ALL ".join(f"SELECT id, {_s(kind)} AS kind, {_clean('v')} AS value FROM (SELECT id, unnest(regexp_extract_all(text, {_s(p)}, {g})) AS v FROM said)" for kind, p, g in phrases)


def _named(phrases, least: int = 0, most: int = 10**6) -> str:
    return f"WITH {_SAID} SELECT DISTINCT id, kind, value FROM ({_rows(phrases)}) WHERE length(value) BETWEEN {least} AND {most}"


_PAST = f"SELECT id, {_clean('v')} AS role, {_clean('v')} AS company FROM (SELECT id, unnest(regexp_extract_all(text, {_s(facets.PAST_FIRM)}, 1)) AS v FROM said) UNION ALL SELECT id, {_clean('r')}, {_clean('c')} FROM (SELECT id, unnest(regexp_extract_all(text, {_s(facets.PAST_ROLE)}, 1)) AS r, unnest(regexp_extract_all(text, {_s(facets.PAST_ROLE)}, 2)) AS c FROM said)"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_WORK = f"SELECT DISTINCT id, CASE WHEN regexp_matches({_DIGITS}, '^[2-9]') OR length({_DIGITS}) >= 10 THEN 'phone' ELSE 'address' END AS kind, value FROM ({_rows(facets.WORKPLACES)})"
_IMAGES = f"images AS (SELECT *, replace({_list(IMAGES)}[id % {len(IMAGES)} + 1], '{{}}', CAST(id AS VARCHAR)) AS image, {_list(ALT)}[(id // 3) % {len(ALT)} + 1] AS alt FROM said)"
_FACETS = {"connection": (facets.CONNECTIONS, 2, 80), "expertise": (facets.EXPERTISE, 0, 10**6), "government": (facets.GOVERNMENT, 0, 10**6), "place": (facets.PAST_PLACES + facets.ORIGINS, 0, 10**6)}
_Q = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_has = lambda condition, n: f"CASE WHEN {condition} THEN {n} ELSE 0 END"
_low = lambda p: f"regexp_matches(lower(q), {_re(p)})"

ORACLE = {
    "connection_mentions": _named(facets.CONNECTIONS, 2, 80),
    "past_employment_mentions": f"WITH {_SAID} SELECT DISTINCT * FROM ({_PAST}) WHERE length(company) >= 2",
    "expertise_mentions": _named(facets.EXPERTISE),
    "organisation_mentions": _named(facets.ORGANISATIONS),
    "business_kinds": _named(facets.BUSINESSES, 2),
    "pay_mentions": _named(facets.PAY),
    "workplace_mentions": f"WITH {_SAID} SELECT * FROM ({_WORK}) WHERE kind = 'phone' OR length(value) >= 5",
    "government_mentions": _named(facets.GOVERNMENT),
    "place_mentions": _named(facets.PAST_PLACES + facets.ORIGINS),
    "company_names": f"WITH {_SAID} SELECT DISTINCT id, trim(string_split(v, '@')[-1]) AS company FROM (SELECT id, value AS v FROM ({_rows(facets.CONNECTIONS)}) WHERE length(value) >= 2 UNION ALL SELECT id, company FROM ({_PAST}) WHERE length(company) >= 2 UNION ALL SELECT id, value FROM ({_rows(facets.BUSINESSES)}) WHERE length(value) >= 2 UNION ALL SELECT id, value FROM ({_rows(facets.ORGANISATIONS)})) WHERE length(trim(string_split(v, '@')[-1])) >= 3",
    "facet_counts": f"WITH {_SAID} SELECT facet, kind, lower(value) AS value, count(DISTINCT id) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS facet, * FROM ({_rows(p)}) WHERE length(value) BETWEEN {a} AND {b}" for n, (p, a, b) in _FACETS.items()) + ") GROUP BY 1, 2, 3",
    "repost_reasons": f"WITH {_SAID}, x AS (SELECT id, text || CASE WHEN id % 4 = 1 THEN chr(10) || '{{\"is_retweet\" : true}}' ELSE '' END AS b FROM said) SELECT id, CASE " + " ".join(f"WHEN regexp_matches(b, {_s('(?i)' + p)}) THEN {_s(p)}" for p in facets.REPOSTS) + " END AS reason FROM x",
    "post_images": f"WITH {_SAID}, {_IMAGES} SELECT id, image FROM images WHERE starts_with(image, 'http') AND NOT regexp_matches(image, {_s(facets.TRACKING_IMAGE)}) AND NOT regexp_matches(lower(image), '\\.(svg|ico)(\\?|$)') AND (NOT regexp_matches(lower(image), 'emoji|icon|logo|badge|sprite|favicon') OR regexp_matches(lower(image), 'profile|avatar|photo|media'))",
    "self_images": f"WITH {_SAID}, {_IMAGES}, r AS (SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(image || ' ' || alt || ' ' || text), {_s(p)}) THEN {_s(p[:40])}" for p in facets.SELF_IMAGES) + f" WHEN contains(lower(alt), 'motion') THEN 'alt text matches subject term \"motion\"' WHEN contains(image, '7.jpg') THEN 'matches profile avatar' WHEN regexp_matches(text, {_s(facets.FIRST_PERSON)}) AND regexp_matches(lower(image || alt || text), {_s(facets.PICTURE)}) THEN 'first-person + photo context' END AS reason FROM images) SELECT * FROM r WHERE reason IS NOT NULL",
    "company_near_date": f"WITH {_SAID} SELECT id, coalesce(" + ", ".join(f"nullif({_clean(f'regexp_extract(text, {_s(p)}, 1)')}, '')" for p in facets.NEAR_DATE) + ") AS company FROM said",
    "json_unescaped": r"""SELECT doc_id, md5(replace(replace(replace(coalesce(text, '') || '\nsaid \"so\" \\n', '\n', chr(10)), '\"', '"'), '\\', '\')) AS md5 FROM documents""",
    "address_organisations": f"WITH {_SAID}, s AS (SELECT id, lower(replace(name, ' ', '-')) AS site FROM said) SELECT id, CASE WHEN id % 4 IN (0, 1) THEN site END AS organisation, CASE WHEN id % 4 = 3 THEN 'https://' || site || '.gov' END AS government FROM s",
    "search_mode_scores": f"""WITH {_SAID}, a AS (SELECT id, {_Q} AS q FROM said), b AS (SELECT id, q, regexp_extract_all(q, '[^ ]+') AS w, {_low(chat.KNOWLEDGE)} AS e, {_low(chat.TECHNICAL)} AS t, regexp_matches(q, {_re(chat.NAME)}) AS n FROM a),
 c AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z]+'))) AS proper, {_has(f"regexp_matches(q, {_s(chat.PERSON)})", 3)} + {_has(f"regexp_matches(q, {_s(chat.LOCATION)})", 2)} + {_has(f"regexp_matches(q, {_s(chat.COUNTRY)})", 1)} + {_has("n", 2)} AS p0,
 {_has("e", 3)} + {_has("t AND regexp_matches(lower(q), '" + chr(92) + "b(is|are|was|were)" + chr(92) + "b')", 2)} + {_has("t AND NOT n", 2)} + {_has("e AND t", 2)} + {_has("len(w) <= 2 AND t", 2)} AS k FROM b),
 d AS (SELECT id, k, CASE WHEN e AND t THEN greatest(p0 - 2, 0) ELSE p0 END + {_has("proper >= 2 AND proper >= len(w) * 0.4", 2)} + {_has(_low(chat.LOOKUP), 2)} AS p FROM c)
 SELECT id, CASE WHEN p >= k THEN 'people' ELSE 'knowledge' END AS mode, least(0.98::DOUBLE, greatest(0.55::DOUBLE, abs(p - k) / greatest(p + k, 1)::DOUBLE + 0.5::DOUBLE)) AS confidence FROM d""",
}
