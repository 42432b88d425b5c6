"""The queries of organisation_queries as SQL for an independent engine: every name is tried on every text."""

from .table_oracle import _FIRM

_FORMS = (
    "'Jane is the founder of ' || f || ' and lives here. Call 415-555-0199 now.'", "'She works at ' || f || ' since May; see 12 Main Street, Austin, TX 78701 for more.'", "f || ' sells tea to everyone.'", "'A note on nothing at all in this long enough text.'",
    "upper(f) || ': its president spoke, the president of ' || f || ' did.'", "'Two mentions: ' || f || ' and ' || f || ', a member of a guild.'", "'mailing address: ' || f || ', 7 Long Road, Reno, NV; +1 702 555 0100'",
)
_NORM = "trim(regexp_replace(regexp_replace(lower(name), '\\s+(llc|inc|corp|corporation|co\\.?)$', ''), '[^a-z0-9]+', ' ', 'g'))"
_HAS = lambda p: f"regexp_matches(text, '(?i)\\b({p})')"
#: The texts are shorter than a window, so each window is its text.
_TOLD = f"""{_FIRM}, orgs AS (SELECT id, name, {_NORM} AS norm FROM (SELECT id, n || CASE id % 4 WHEN 0 THEN ' Works LLC' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' Corp' ELSE '' END AS name FROM firms)),
texts AS (SELECT c_custkey AS id, CASE c_custkey % 7 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_FORMS))} END AS text FROM (SELECT c_custkey, name AS f FROM customer JOIN orgs ON orgs.id = c_custkey % (SELECT count(*) FROM supplier))),
m AS (SELECT name, norm, t.id, text, len(string_split(lower(text), lower(name))) - 1 AS k FROM orgs, texts t WHERE contains(lower(text), lower(name)) OR contains(lower(text), norm)),
told AS (SELECT *, CASE WHEN k > 0 THEN k WHEN length(norm) >= 4 THEN 1 ELSE 0 END AS n_windows, {_HAS('founder of|owner of|owns')} OR {_HAS('(CEO|president|owner) (of|at) ')} AS own,
 CASE WHEN {_HAS('founder of|owner of|owns')} OR {_HAS('(CEO|president|owner) (of|at) ')} THEN 'owned_business' WHEN {_HAS('works? at ')} THEN 'employer' WHEN regexp_matches(name, '(?i)\\b(LLC|Corp\\.)\\b') THEN 'registered_entity' WHEN {_HAS('(affiliated|member of|partner)')} THEN 'affiliation' ELSE 'unknown' END AS kind,
 list_filter([CASE WHEN {_HAS('founder of ')} THEN 'founder: founder/owner language' END, CASE WHEN {_HAS('president of ')} THEN 'executive: executive/owner title' END, CASE WHEN {_HAS('works at ')} THEN 'employee: employment language' END, CASE WHEN {_HAS('mailing address:')} THEN 'address_match: registered filing address context' END], lambda x: x IS NOT NULL) AS links,
 regexp_extract_all(text, '(\\+?1[-.\\s]?)?(\\(?[2-9][0-9]{{2}}\\)?[-.\\s]?)[2-9][0-9]{{2}}[-.\\s]?[0-9]{{4}}') AS phones FROM m)"""

ORACLE = {
    "organisation_windows": f"WITH {_TOLD} SELECT name, id, n_windows, kind, own AS owned, len(list_distinct(phones)) AS n_phones FROM told",
    "organisation_map": f"""WITH {_TOLD}, listed AS (SELECT DISTINCT a.norm FROM orgs a, orgs b WHERE b.id % 11 = 0 AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm))),
one AS (SELECT name, norm, max_by(kind, id) FILTER (WHERE kind <> 'unknown') AS kind, bool_or(own) OR norm IN (SELECT norm FROM listed) AS owned, count(*) AS n_texts, list(id ORDER BY id)[:10] AS texts,
 list_sort(list_distinct(flatten(list(links)))) AS links, list_sort(list_distinct(flatten(list(phones)))) AS phones FROM told GROUP BY name, norm)
SELECT name, norm, CASE WHEN owned THEN 'owned_business' ELSE coalesce(kind, 'unknown') END AS kind, owned, n_texts, array_to_string(texts, ',') AS texts, CASE WHEN links <> [] THEN array_to_string(links, '|') END AS links, CASE WHEN phones <> [] THEN array_to_string(phones, '|') END AS phones FROM one""",
    "organisation_groups": f"""WITH RECURSIVE {_TOLD}, e AS (SELECT DISTINCT a.norm AS a, b.norm AS b FROM orgs a, orgs b WHERE contains(a.norm, b.norm) OR contains(b.norm, a.norm)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS norm, min(b) AS leader FROM r GROUP BY 1""",
}
