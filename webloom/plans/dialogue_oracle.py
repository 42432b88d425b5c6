"""The queries of dialogue_queries as SQL for an independent engine; a question here has one term, or one and another that nothing holds."""

from ..functions import text as T
from .oracle import _DEFINES, _DOCS, _SENTENCES, _STYLE, _any, _re
from .table_oracle import _CUED

_FORMS = ("'what is ' || t || '?'", "'tell me more'", "'Go on please'", "'define ' || t", "t", "'continue'", "''", "t || ' qqqzz'", "'say more'")
_TURNS = f"""said AS (SELECT conv_id, turn, k, t, trim(CASE k {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(_FORMS))} END) AS question FROM (SELECT conv_id, turn, (conv_id * 5 + turn) % 9 AS k,
 coalesce(regexp_extract_all(lower(coalesce(min(text), '')), '[a-z0-9]+').list_filter(lambda w: length(w) >= 3)[-1], '') AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn))"""
#: Terms by question: those that the cues hold, or the word.
_RANKED = f"""asked AS (SELECT DISTINCT question, list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN k IN (0, 3) THEN t ELSE question END), '[a-z0-9]{{3,}}'), lambda w: NOT {_any('w', T.QUESTION_STOP)})) AS terms, CASE WHEN k IN (0, 3) THEN t ELSE '' END AS t, k IN (0, 3) AND t <> '' AS def FROM said WHERE question <> ''),
sent AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS x FROM docs)),
told AS (SELECT *, lower(sentence) AS low, {_DEFINES} AS defines, {_STYLE} AS style FROM sent),
terms AS (SELECT DISTINCT unnest(terms) AS term FROM asked),
held AS (SELECT term, doc_id, pos FROM told, terms WHERE contains(low, term) OR (term LIKE '%s' AND length(term) > 4 AND contains(low, term[:-2]))),
found AS (SELECT question, t, terms, def, doc_id, pos, count(*) AS n FROM (SELECT DISTINCT question, t, terms, def FROM asked) JOIN held ON list_contains(terms, term) GROUP BY ALL),
scored AS (SELECT question, doc_id, pos, sentence, n + n / len(terms)::DOUBLE * 2 + CASE WHEN def THEN style + CASE WHEN contains(low, t) THEN 2 ELSE 0 END ELSE 0 END AS score FROM found JOIN told USING (doc_id, pos) WHERE NOT def OR defines),
best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, length(sentence) DESC, doc_id, pos) AS rank FROM scored WHERE score > 0)"""

ORACLE = {
    "question_ranking": f"WITH {_DOCS}, {_TURNS}, {_RANKED} SELECT question, rank, sentence, score::DOUBLE AS score FROM best WHERE rank <= 5",
    "chat_session": f"""WITH RECURSIVE {_DOCS}, {_TURNS}, {_RANKED}, top AS (SELECT * FROM best WHERE rank <= 50), sizes AS (SELECT question, count(*) AS size FROM top GROUP BY 1),
line AS (SELECT said.*, coalesce(size, 0) AS size, k IN (1, 2, 5, 8) AS cue, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM said LEFT JOIN sizes USING (question) WHERE question <> ''),
walk AS (SELECT conv_id, turn, i, question AS now, size AS now_size, 0 AS cursor, false AS goes_on FROM line WHERE i = 1 UNION ALL
 SELECT l.conv_id, l.turn, l.i, CASE WHEN cue AND now_size > 0 THEN now ELSE question END, CASE WHEN cue AND now_size > 0 THEN now_size ELSE size END, CASE WHEN cue AND now_size > 0 THEN cursor + 1 ELSE 0 END, cue AND now_size > 0 FROM walk w JOIN line l ON l.conv_id = w.conv_id AND l.i = w.i + 1)
SELECT w.conv_id, w.turn, CASE WHEN goes_on THEN 'continuation' WHEN now_size > 0 THEN 'retrieval' ELSE 'reflect' END AS mode,
 coalesce(sentence, 'I crawled live sources but did not find a clear definitional sentence for that question. Try a more specific domain or rephrase.') AS reply FROM walk w LEFT JOIN top ON top.question = now AND rank = cursor % greatest(now_size, 1) + 1
UNION ALL SELECT conv_id, turn, 'eliza', 'Is something troubling you?' FROM said WHERE question = ''""",
    "small_talk": f"""WITH c AS (SELECT conv_id, turn, trim(min(text)) AS text FROM ({_CUED}) GROUP BY 1, 2), n AS (SELECT *, (conv_id + turn) % 10 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM c),
r AS (SELECT *, {{rule}} AS rule FROM n), v AS (SELECT *, rule = '' AND text <> '' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 3 AND NOT contains(text, '?') AS vague FROM r),
b AS (SELECT *, sum(vague::INT) OVER (PARTITION BY conv_id ORDER BY turn) - vague::INT AS before FROM v)
SELECT conv_id, turn, CASE WHEN text = '' OR rule <> '' OR vague THEN 'eliza' ELSE 'reflect' END AS mode, CASE WHEN text = '' THEN 'Is something troubling you?' WHEN rule <> '' THEN rule WHEN vague THEN CASE before % 2 WHEN 0 THEN 'Tell me more.' ELSE 'This is interesting.' END
 WHEN regexp_replace(text, '[.!?]+$', '') = '' THEN 'Is something troubling you?' ELSE 'Do you often think about ' || lower(regexp_replace(text, '[.!?]+$', '')) || '?' END AS reply FROM b""",
}
#: (pattern, answer for even numbers, for odd ones); \1 and \2 are its groups.
_RULES = (
    (r"\b(kill myself|suicide|end my life|want to die)\b", "I'm a simple pattern matcher, not a counselor. Please talk to a real person you trust or a crisis line.", "That sounds very serious. This chatbot cannot help with that — please reach out to someone who can."),
    (r"\b(hello|hi|hey|good morning|good evening)\b", "Hello. How are you feeling today?", "Hi there. Is something troubling you?"), (r"\b(bye|goodbye|see you|quit|exit)\b", "Goodbye. It was good talking with you.", "Take care. Feel free to come back anytime."),
    (r"\b(depressed|depression|sad|unhappy|miserable)\b", "I'm sorry to hear that you're depressed.", "Why do you think you feel depressed much of the time?"), (r"\b(mother|mom|father|dad|family|parents)\b", "Tell me more about your family.", "How does your family figure into this?"),
    (r"\b(boyfriend|girlfriend|partner|relationship|married|wife|husband)\b", "Is it important to you that your relationship is going this way?", "Can you think of a specific example from your relationship?"),
    (r"\b(always|never|all men|all women|everyone)\b", "Can you think of a specific example?", "What connection do you suppose they're always doing that?"), (r"\bi am ([^\n]+)", r"Why do you say you are \1?", r"Do you enjoy being \1?"),
    (r"\bi'm ([^\n]+)", r"Why do you say you're \1?", r"How long have you been \1?"), (r"\bi ([^\n]+)", r"Why do you say you \1?", r"You say you \1 — can you elaborate?"),
    (r"\b(you are|you're) ([^\n]+)", r"What makes you think I am \2?", r"Does it matter to you that I am \2?"), (r"\bwhat is ([^\n]+)\?", r"Why do you ask what \1 is?", r"What do you already know about \1?"),
    (r"\bwhy ([^\n]+)\?", r"Why do you think \1?", r"What reason comes to mind for why \1?"), (r"\?$", "Why do you ask that?", "What do you think the answer might be?"),
)


def _answer(pattern: str, even: str, odd: str) -> str:
    told = "CASE i % 2 WHEN 0 THEN '" + even.replace("'", "''") + "' ELSE '" + odd.replace("'", "''") + "' END"
    for g in (1, 2):
        if f"\\{g}" in even:
            told = f"replace({told}, '\\{g}', regexp_extract(text, {_re('(?i)' + pattern)}, {g}))"
    return f"WHEN regexp_matches(text, {_re('(?i)' + pattern)}) THEN {told}"


ORACLE["small_talk"] = ORACLE["small_talk"].replace("{rule}", f"CASE {' '.join(_answer(*r) for r in _RULES)} ELSE '' END")
