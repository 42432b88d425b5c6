"""How a dialogue reacts to what is said, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import B, E, bounded

#: What goes on with the answer before, and the dialogue's rules by name. The crisis rule comes first here.
CONTINUE = B + r"(tell me more|more about that|go on|continue|keep going|what else|elaborate|expand on|say more|go deeper|dive deeper)" + E
RULES = (
    ("crisis", B + r"(kill myself|suicide|end my life|want to die)" + E),
    ("greeting", B + r"(hello|hi|hey|good morning|good evening)" + E),
    ("farewell", B + r"(bye|goodbye|see you|quit|exit)" + E),
    ("sadness", B + r"(depressed|depression|sad|unhappy|miserable)" + E),
    ("family", B + r"(mother|mom|father|dad|family|parents)" + E),
    ("relationship", B + r"(boyfriend|girlfriend|partner|relationship|married|wife|husband)" + E),
    ("always", B + r"(always|never|all men|all women|everyone)" + E),
    ("i_am", B + r"i am (.+)"),
    ("i_m", B + r"i'm (.+)"),
    ("i", B + r"i (.+)"),
    ("you_are", B + r"(you are|you're) (.+)"),
    ("what_is", B + r"what is (.+)\?"),
    ("why", B + r"why (.+)\?"),
    ("question", r"\?$"),
)
#: Two answers to each rule, $1 and $2 being what its groups matched; what is said in turn; what is said where nothing is found.
REPLIES = {
    "crisis": ("I'm a simple pattern matcher, not a counselor. Please talk to a real person you trust or a crisis line.", "That sounds very serious. This chatbot cannot help with that — please reach out to someone who can."),
    "greeting": ("Hello. How are you feeling today?", "Hi there. Is something troubling you?"),
    "farewell": ("Goodbye. It was good talking with you.", "Take care. Feel free to come back anytime."),
    "sadness": ("I'm sorry to hear that you're depressed.", "Why do you think you feel depressed much of the time?"),
    "family": ("Tell me more about your family.", "How does your family figure into this?"),
    "relationship": ("Is it important to you that your relationship is going this way?", "Can you think of a specific example from your relationship?"),
    "always": ("Can you think of a specific example?", "What connection do you suppose they're always doing that?"),
    "i_am": ("Why do you say you are $1?", "Do you enjoy being $1?"),
    "i_m": ("Why do you say you're $1?", "How long have you been $1?"),
    "i": ("Why do you say you $1?", "You say you $1 — can you elaborate?"),
    "you_are": ("What makes you think I am $2?", "Does it matter to you that I am $2?"),
    "what_is": ("Why do you ask what $1 is?", "What do you already know about $1?"),
    "why": ("Why do you think $1?", "What reason comes to mind for why $1?"),
    "question": ("Why do you ask that?", "What do you think the answer might be?"),
}
IN_TURN = ("Tell me more.", "This is interesting.")
NOTHING_SAID = "Is something troubling you?"
NOT_FOUND = "I crawled live sources but did not find a clear definitional sentence for that question. Try a more specific domain or rephrase."
#: Cues of a search for knowledge or for people.
KNOWLEDGE = r"^(what|how|why|when|where|explain|define|tutorial|guide to|introduction to|overview of|history of|compare|difference between)" + E
TECHNICAL = B + r"(algorithm|protocol|framework|architecture|api|database|compiler|encryption|blockchain|quantum|biology|physics|chemistry|mathematics|theorem|specification|rfc|documentation|intelligence|artificial|learning|technology|science|economics|philosophy|history|politics|culture|medicine|engineering)" + E
PERSON = r"(?i)\b(mr\.|mrs\.|ms\.|dr\.|born|age\s+[0-9]{1,3}|lives in|resides|hometown|family|married|linkedin\.com/in|facebook\.com/|instagram\.com/)\b"
LOCATION = r"\b(united states|usa|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY))\b"
COUNTRY = r"(?i)\b(india|china|russia|japan|germany|france|brazil|mexico|canada|australia|uk|united kingdom|nigeria|south africa|korea|pakistan|indonesia|vietnam|thailand|egypt|saudi arabia|uae|singapore|taiwan|hong kong|europe|asia|africa|latin america)\b"
NAME = B + r"[A-Z][a-z]+\s+[A-Z][a-z]+(\s+[A-Z][a-z]+)?" + E
LOOKUP = B + r"(search|find|lookup|who is|person|profile)" + E


def rule(text: Column) -> Column:
    """The first rule that what is said matches, or none."""
    low = F.lower(F.trim(text))
    out = F.when(low.rlike(RULES[0][1]), RULES[0][0])
    for name, pattern in RULES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("none")


def mode(text: Column) -> Column:
    said = F.trim(text)
    words = F.size(F.filter(F.split(said, r"\s+"), lambda w: w != ""))
    return F.when(said == "", "empty").when(F.lower(said).rlike(CONTINUE), "continuation").when(rule(said) != "none", "rule").when((words <= 3) & ~said.contains("?"), "two_phrase").otherwise("reflect")


def search_scores(query: Column) -> Column:
    """(mode, confidence): people or knowledge, by weighed cues; ties go to people. The confidence is between 0.55 and 0.98."""
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    low = F.lower(q)
    has = lambda c, n: F.when(c, n).otherwise(0)
    explains, technical, called = low.rlike(KNOWLEDGE), low.rlike(TECHNICAL), q.rlike(NAME)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    proper = F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+")))
    people = has(q.rlike(bounded(PERSON)), 3) + has(q.rlike(bounded(LOCATION)), 2) + has(q.rlike(bounded(COUNTRY)), 1) + has(called, 2)
    people = F.when(explains & technical, F.greatest(people - 2, F.lit(0))).otherwise(people) + has((proper >= 2) & (proper >= F.size(words) * 0.4), 2) + has(low.rlike(LOOKUP), 2)
    knowledge = has(explains, 3) + has(low.rlike(B + "(is|are|was|were)" + E) & technical, 2) + has(technical & ~called, 2) + has(explains & technical, 2) + has((F.size(words) <= 2) & technical, 2)
    sure = F.abs(people - knowledge) / F.greatest(people + knowledge, F.lit(1)) + F.lit(0.5)
    return F.struct(F.when(people >= knowledge, "people").otherwise("knowledge").alias("mode"), F.least(F.lit(0.98), F.greatest(F.lit(0.55), sure)).alias("confidence"))


def search_mode(query: Column) -> Column:
    return search_scores(query)["mode"]


def rule_reply(text: Column, number: Column) -> Column:
    """The answer of the first rule that what is said matches, one of its two by number; null where none does."""
    said = F.trim(text)
    out = None
    for name, pattern in RULES:
        answers = F.when(F.pmod(number, F.lit(2)) == 0, REPLIES[name][0]).otherwise(REPLIES[name][1])
        for group in (1, 2):
            if f"${group}" in REPLIES[name][0]:
                answers = F.replace(answers, F.lit(f"${group}"), F.regexp_extract(said, f"(?i){pattern}", group))
        out = F.when(F.lower(said).rlike(pattern), answers) if out is None else out.when(F.lower(said).rlike(pattern), answers)
    return out


def reflected(text: Column) -> Column:
    said = F.regexp_replace(F.trim(text), "[.!?]+$", "")
    return F.when(said == "", NOTHING_SAID).otherwise(F.concat(F.lit("Do you often think about "), F.lower(said), F.lit("?")))
