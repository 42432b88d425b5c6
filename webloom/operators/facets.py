"""What phrases of a text name: employers, past posts, expertise, firms, pay, workplaces, offices, places; and marks of posts and their images.

Patterns stand in their plain form; `bounded` makes a word boundary that of ASCII words. Where a text is null, so is what is found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bounded, clean_capture
from .entities import COMPENSATION

#: Fixed values: (kind, pattern, group) of phrases.
CONNECTIONS = (
    ("employer", r"(?i)\b(?:works? at|working at|employed (?:by|at)|employee of|staff at|job at)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})", 1),
    ("founder", r"(?i)\b(?:founder of|co-founder of|created|built|owner of|owns)\s+([A-Z][A-Za-z0-9\s&.#'-]{2,50})", 1),
    ("executive", r"(?i)\b(?:CEO|CTO|COO|CFO|president|director|manager|engineer|developer|specialist|analyst|consultant|designer|architect|prompt expert)\s+(?:of|at|,?\s+at)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})", 1),
    ("affiliation", r"(?i)\b(?:member of|affiliated with|associated with|part of)\s+([A-Z][A-Za-z0-9\s&.#'-]{2,50})", 1),
    ("collaborator", r"(?i)\b(?:collaborat(?:e|es|ed|ing) with|partnered with|teamed with)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})", 1),
)
ORGANISATIONS = (("organization", r"\b(?:at|@)\s+([A-Z][A-Za-z0-9\s&.#-]{2,40})", 1),)
EXPERTISE = (
    ("AI / Prompt Engineering", r"(?i)\b(prompt expert|prompt engineering|prompt engineer|AI specialist|AI expert|machine learning engineer|ML engineer)\b", 1),
    ("Cybersecurity", r"(?i)\b(cybersecurity specialist|security researcher|OSINT analyst|ethical hacker)\b", 1),
    ("Software Engineering", r"(?i)\b(software engineer|full.?stack developer|web developer|data scientist|devops engineer)\b", 1),
    ("domain", r"(?i)\b(?:specialist in|expert in|focused on|niche in|training in|specializes in)\s+([A-Za-z0-9\s&/-]{3,40})", 1),
    ("niche", r"(?i)\b(?:niche)[:\s]+([A-Za-z0-9\s&/-]{3,40})", 1),
)
BUSINESSES = (
    ("registered entity", r"(?i)\b([A-Z][A-Za-z0-9\s&.'-]{2,40})\s+(?:LLC|L\.L\.C\.|Inc\.|Corp\.|Corporation|Company|Co\.)\b", 1),
    ("DBA", r"(?i)\b(?:registered business|business name|DBA|doing business as)[:\s]+([A-Za-z0-9\s&.'-]{2,50})", 1),
    ("startup", r"(?i)\b(?:founded|started|launched|established)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})", 1),
)
PAY = tuple(("compensation", p, 0) for p in COMPENSATION) + (
    ("compensation", r"(?i)\b(?:salary|compensation|pay(?:s|ing)?|earns?|income)[:\s]+\$?\s?[0-9,]+(?:\.[0-9]{2})?(?:\s*(?:/\s?(?:hr|hour|yr|year)|per hour|per year|k|annually))?", 0),
)
WORKPLACES = (
    ("workplace", r"(?i)\b(?:office(?:s)? at|store at|branch at|located at|headquarters at|building at)\s+([0-9]{0,5}\s?[A-Za-z0-9\s,.'-]{5,80})", 1),
    ("workplace", r"(?i)\b(?:company phone|office phone|business phone|main line)[:\s]+((?:\+?1[-.\s]?)?(?:\(?[2-9][0-9]{2}\)?[-.\s]?)[2-9][0-9]{2}[-.\s]?[0-9]{4})", 1),
)
GOVERNMENT = (("government", r"(?i)\b(federal employee|state employee|government employee|public servant|military|veteran|us army|us navy|department of|city of [A-Z][a-z]+|county of [A-Z][a-z]+)\b", 0),)
PAST_PLACES = (
    ("past", r"(?i)\b(?:formerly (?:in|of|from|lived in)|previously (?:in|from|lived in)|used to live in|lived in)\s+([A-Z][a-z]+(?:[\s,]+[A-Z][a-z]+){0,3}(?:,\s*(?:FL|Florida|[A-Z]{2}))?)", 1),
    ("past", r"(?i)\b(?:moved from|relocated from|transferred from)\s+([A-Z][a-z]+(?:[\s,]+[A-Z][a-z]+){0,3})", 1),
    ("past", r"(?i)\b(?:attended|graduated from|studied at|alumni of)\s+([A-Z][a-z]+(?:[\s,]+[A-Z][a-z]+){0,4})", 1),
)
ORIGINS = (
    ("origin", r"(?i)\b(?:born in|birthplace[:\s]+|native of|from)\s+([A-Z][a-z]+(?:[\s,]+[A-Z][a-z]+){0,3}(?:,\s*(?:FL|Florida|[A-Z]{2}))?)", 1),
    ("origin", r"(?i)\b(?:raised in|grew up in|hometown[:\s]+|originally from)\s+([A-Z][a-z]+(?:[\s,]+[A-Z][a-z]+){0,3})", 1),
    ("origin", r"(?i)\b(?:roots in|heritage from|descended from|family from)\s+([A-Za-z\s,]+?)(?:\.|,|$)", 1),
)
#: Places by their state, by two letters (but ST and DR), and as where somebody or something is now; colleagues.
STATE_PLACE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}),?\s+(Alabama|AL|Alaska|AK|Arizona|AZ|Arkansas|AR|California|CA|Colorado|CO|Connecticut|CT|Delaware|DE|Florida|FL|Georgia|GA|Hawaii|HI|Idaho|ID|Illinois|IL|Indiana|IN|Iowa|IA|Kansas|KS|Kentucky|KY|Louisiana|LA|Maine|ME|Maryland|MD|Massachusetts|MA|Michigan|MI|Minnesota|MN|Mississippi|MS|Missouri|MO|Montana|MT|Nebraska|NE|Nevada|NV|New Hampshire|NH|New Jersey|NJ|New Mexico|NM|New York|NY|North Carolina|NC|North Dakota|ND|Ohio|OH|Oklahoma|OK|Oregon|OR|Pennsylvania|PA|Rhode Island|RI|South Carolina|SC|South Dakota|SD|Tennessee|TN|Texas|TX|Utah|UT|Vermont|VT|Virginia|VA|Washington|WA|West Virginia|WV|Wisconsin|WI|Wyoming|WY|United States|USA)\b"
LETTERS_PLACE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}),?\s+([A-Z]{2})\b"
NOW_PLACE = r"(?i)\b(?:lives in|living in|based in|located in|resides in|currently in|now in|lives at|resides at)\s+([A-Z][a-z0-9]+(?:[\s,]+[A-Za-z0-9]+){0,6}(?:,\s*(?:FL|Florida|[A-Z]{2}))?)"
COLLEAGUES = (("colleague", r"(?i)\b(?:colleague|co-worker|coworker|teammate|team member|works with|partnered with)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),)
#: Posts held before; the first names the firm alone, the second the role and the firm.
PAST_FIRM = r"(?i)\b(?:formerly (?:at|with)|previously (?:at|worked at)|used to work at|ex-employee of|past role at|retired from)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})"
PAST_ROLE = r"(?i)\b(?:former|ex-)\s+(CEO|CTO|engineer|developer|manager|director|analyst|specialist|consultant)\s+(?:at|of)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50})"
#: What tells a repost, an image of oneself, an image that is no post's.
REPOSTS = (r"\bRT @", r"\bretweeted\b", r"\brepost(?:ed|ing)?\b", r"\bshared (?:a )?post\b", r"\bshared from\b", r"\bvia @", r'"retweeted_status"', r'"is_retweet"\s*:\s*true', r'"reposted"\s*:\s*true', r'aria-label="[^"]*repost')
SELF_IMAGES = (r"\bselfie\b", r"\bheadshot\b", r"\bprofile (?:pic|photo|picture|image)\b", r"\bmy face\b", r"\bphoto of me\b", r"\bpicture of me\b", r"\bmirror (?:pic|selfie|shot)\b", r"\/avatar", r"\/profile", r"profile_pic", r"\/self\/")
FIRST_PERSON, PICTURE = r"(?i)\b(?:i am|i'm|myself|me in|of myself)\b", r"photo|pic|image|selfie"
TRACKING_IMAGE = r"(?i)(?:pixel|spacer|1x1|beacon|analytics|doubleclick|facebook\.com/tr|\.gif\?)"
#: A firm in the words around a date, the first pattern that fits.
NEAR_DATE = (
    r"\b(?:at|@|with|for)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50}?)(?:\s+(?:as|until|through|in|on|from|where|\.|,|;|$|\s+(?:LLC|Inc|Corp)))",
    r"(?i)\b(?:works? at|working at|employed at|job at|worked at|new job at)\s+([A-Z][A-Za-z0-9\s&.'-]{2,50}?)(?:\s+(?:as|until|in|on|from|\.|,|;|$))",
    r"\b([A-Z][A-Za-z0-9\s&.'-]{2,40})\s+(?:LLC|L\.L\.C\.|Inc\.|Corp\.|Corporation|Co\.)\b",
)

def named(text: Column, phrases: tuple, least: int = 0, most: int = 2**31 - 1) -> Column:
    """Distinct (kind, value) of all that the phrases name, cleaned, of `least` to `most` characters."""

    def of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(bounded(pattern)), F.lit(group)), lambda v: F.struct(F.lit(kind).alias("kind"), clean_capture(v).alias("value")))

    found = F.concat(*(of(*p) for p in phrases))
    return F.array_distinct(F.filter(found, lambda x: F.length(x["value"]).between(least, most)))


def connections(text: Column) -> Column:
    return named(text, CONNECTIONS, 2, 80)


def employment(text: Column) -> Column:
    """(kind, value) of posts held now: the same phrases, names of any length."""
    return named(text, CONNECTIONS, 2)


def past_employment(text: Column) -> Column:
    """Distinct (role, company); where only the firm is named it stands for the role, too."""
    get = lambda p, n: F.transform(F.regexp_extract_all(text, F.lit(bounded(p)), F.lit(n)), clean_capture)
    pair = lambda role, firm: F.struct(role.alias("role"), firm.alias("company"))
    found = F.concat(F.transform(get(PAST_FIRM, 1), lambda f: pair(f, f)), F.zip_with(get(PAST_ROLE, 1), get(PAST_ROLE, 2), pair))
    return F.array_distinct(F.filter(found, lambda x: F.length(x["company"]) >= 2))


def workplaces(text: Column) -> Column:
    """(kind, value): phone where the digits begin like an area or are ten and more, else address of five characters and more."""

    def told(x: Column) -> Column:
        digits = F.regexp_replace(x["value"], "[^0-9]", "")
        return F.struct(F.when(digits.rlike("^[2-9]") | (F.length(digits) >= 10), "phone").otherwise("address").alias("kind"), x["value"].alias("value"))

    return F.filter(F.transform(named(text, WORKPLACES), told), lambda x: (x["kind"] == "phone") | (F.length(x["value"]) >= 5))


def places(text: Column) -> Column:
    """(kind, value) of places that a text leaves (past) or comes from (origin); no addresses."""
    return named(text, PAST_PLACES + ORIGINS)


def company_names(text: Column) -> Column:
    """Distinct firms of three characters and more: employers now and before, firms, organisations."""
    values = lambda found, field: F.transform(found, lambda x: x[field])
    all_ = F.concat(values(employment(text), "value"), values(past_employment(text), "company"), values(named(text, BUSINESSES, 2), "value"), values(named(text, ORGANISATIONS), "value"))
    after = F.transform(all_, lambda v: F.trim(F.element_at(F.split(v, "@"), -1)))
    return F.array_distinct(F.filter(after, lambda v: F.length(v) >= 3))


def repost_reason(text: Column, html: Column) -> Column:
    """The first mark of a repost in a post's text or markup, as its pattern; null where there is none."""
    both = F.concat_ws("\n", F.coalesce(text, F.lit("")), F.coalesce(html, F.lit("")))
    return F.coalesce(*(F.when(both.rlike("(?i)" + bounded(p)), F.lit(p)) for p in REPOSTS))


#: A mark of a repost holds one of these words; the marks as one pattern.
REPOST_WORDS = ("rt @", "retweet", "repost", "shared ", "via @")
_REPOST = re.compile("|".join(REPOSTS), re.I | re.A)


def has_mark(text: str) -> bool:
    """Whether a text has a mark of a repost, for code within tasks: what repost_reason() finds."""
    low = text.lower()
    return any(w in low for w in REPOST_WORDS) and bool(_REPOST.search(text))


def is_own(text: Column, html: Column) -> Column:
    """Whether a post has no mark of a repost: all marks hold one of a few words, which most posts do not have."""
    both = F.concat_ws("\n", F.coalesce(text, F.lit("")), F.coalesce(html, F.lit("")))
    low = F.lower(both)
    marked = reduce(lambda a, w: a | low.contains(w), REPOST_WORDS[1:], low.contains(REPOST_WORDS[0]))
    return ~marked | repost_reason(text, html).isNull()


def is_post_image(url: Column) -> Column:
    """A picture of a post: no tracking, no vector or icon file, and no icon unless it says that it is media."""
    low = F.lower(url)
    icon = low.rlike("emoji|icon|logo|badge|sprite|favicon") & ~low.rlike("profile|avatar|photo|media")
    return url.startswith("http") & ~url.rlike(TRACKING_IMAGE) & ~low.rlike(r"\.(svg|ico)(\?|$)") & ~icon


def self_image_reason(url: Column, alt: Column, text: Column, terms: list[str], avatars: Column) -> Column:
    """Why an image may show the topic itself: a pattern, a term in its alt text, an avatar's file name (avatars: names), first person with a picture; else null."""
    blob = F.lower(F.concat_ws(" ", url, F.coalesce(alt, F.lit("")), text))
    out = [F.when(blob.rlike(bounded(p)), F.lit(p[:40])) for p in SELF_IMAGES]
    out += [F.when(F.lower(alt).contains(t), F.lit(f'alt text matches subject term "{t}"')) for t in terms if len(t) >= 4]
    out.append(F.when(F.exists(avatars, lambda a: (a != "") & url.contains(a)), F.lit("matches profile avatar")))
    out.append(F.when(text.rlike(bounded(FIRST_PERSON)) & blob.rlike(PICTURE), F.lit("first-person + photo context")))
    return F.coalesce(*out)


def company_near(context: Column) -> Column:
    """The first firm that the words around a date name; null where none does."""
    first = (F.regexp_extract(context, bounded(p), 1) for p in NEAR_DATE)
    return F.coalesce(*(F.when(x != "", clean_capture(x)) for x in first))


def unescaped(text: Column) -> Column:
    r"""\n, \" and \\ of JSON, in this order."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\")), text)


def organisation_of(url: Column) -> Column:
    """The organisation in an address of the code host; null without one and for the host's own pages."""
    name = F.regexp_extract(url, r"(?i)github\.com/(?:orgs/)?([A-Za-z0-9_-]{2,40})", 1)
    return F.when((name != "") & ~F.lower(name).isin("orgs", "features", "settings", "login"), name)


def government_of(url: Column) -> Column:
    return F.when(url.rlike(r"(?i)\.gov(?:/|$)"), url)


def current_places(text: Column) -> Column:
    """Distinct places that a text names with their state, or as where somebody or something is now, cleaned; no street addresses."""
    lettered = F.filter(F.regexp_extract_all(text, F.lit(bounded(LETTERS_PLACE)), F.lit(0)), lambda v: ~F.substring(v, -2, 2).isin("ST", "DR"))
    found = F.concat(F.regexp_extract_all(text, F.lit(bounded(STATE_PLACE)), F.lit(0)), lettered, F.regexp_extract_all(text, F.lit(bounded(NOW_PLACE)), F.lit(1)))
    return F.array_distinct(F.transform(found, clean_capture))


def colleagues(text: Column) -> Column:
    return named(text, COLLEAGUES, 2)
