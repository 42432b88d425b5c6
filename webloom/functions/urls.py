"""Addresses as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Hosts that are never live, paths of tests and fixtures, hosts of social networks, ends of image addresses, a code host's own pages.
PLACEHOLDER_HOSTS = ("example.com", "example.org", "example.net", "localhost", "127.0.0.1", "0.0.0.0", "test", "invalid")
BLOCKED_PATH = r"(?i)(^|[\\/])(tests?|fixtures?|mocks?|data[\\/]reports|__tests__|node_modules)([\\/]|$)"
BLOCKED_SCHEME = r"(?i)^(file|data|blob|javascript|about):"
SPEC_FILE = r"(?i)\.(test|spec)\.[a-z]+$"
PRIVATE_PREFIX = r"^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\."
SOCIAL_HOSTS = ("github.com", "x.com", "twitter.com", "linkedin.com", "instagram.com", "facebook.com", "tiktok.com", "youtube.com", "threads.net", "discord.gg")
IMAGE_URL = r"\.(png|jpg|jpeg|svg|gif|ico|webp)(\?|$)"
CHROME_URLS = (
    r"github\.com/(features|marketplace|mcp|security|enterprise|team|solutions|resources|customer-stories|orgs|trust-center|partners|sponsors|accelerator|topics|why-github|login|signup|search|settings|explore|pricing|about|contact|site|trending|premium-support|user-attachments)",
    r"github\.com/collections",
    r"x\.com/(home|explore|login|i/flow)",
)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where the address has none."""
    return _name(part(url, 2))


def _name(authority: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no default port, one trailing slash off unless it is the root; query and fragment stay."""
    return let(F.trim(url), lambda u: let(F.struct(*(F.regexp_extract(u, _PARTS, k).alias(f"p{k}") for k in range(1, 6))), lambda p: put_together(*(p[f"p{k}"] for k in range(1, 6)))))


def put_together(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """normalized() of an address by its parts, for callers that have them as columns; null without a scheme."""
    scheme, port = F.lower(scheme), F.regexp_extract(authority, r":([0-9]+)$", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    short = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(_undotted(path), "(?<=.)/$", ""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), _escaped(short), _escaped(query), _escaped(fragment)))


#: Signs that an address holds in percent form only, and dot segments.
_UNSAFE = r"\x00-\x20\"<>`{}\x7F-\x{10FFFF}"
_DOTS = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"


def _escaped(part: Column) -> Column:
    runs = F.regexp_extract_all(part, F.lit(f"[{_UNSAFE}]+|[^{_UNSAFE}]+"), F.lit(0))
    coded = F.transform(runs, lambda x: F.when(x.rlike(f"^[{_UNSAFE}]"), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x))
    return F.when(part.rlike(f"[{_UNSAFE}]"), F.array_join(coded, "")).otherwise(part)


def _undotted(path: Column) -> Column:
    """path without dot segments: a fold over its segments, the array being the stack of those that stay. A last dot segment leaves its slash."""
    one, two = (lambda x: F.lower(x).isin(".", "%2e")), (lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e"))
    up = lambda stack: F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
    stay = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.array().cast("array<string>"), lambda s, x: F.when(two(x), up(s)).when(one(x), s).otherwise(F.concat(s, F.array(x))))
    end = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$"), "/").otherwise("")
    folded = F.concat(F.lit("/"), F.array_join(stay, "/"), end)
    return F.when(path.rlike(_DOTS), F.regexp_replace(folded, "^//$", "/")).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """An absolute, normalised http(s) address for a link on a page; null for fragments and other schemes. Dot segments go, wherever they stand."""
    return let(F.struct(scheme(base).alias("s"), part(base, 2).alias("a"), part(base, 3).alias("p")), lambda b: placed(b, link)["url"])


def placed(base: Column, link: Column) -> Column:
    """struct (url, host) of a link on the page whose address has the parts (s, a, p); null as resolved() says."""
    whole = lambda x: let(F.struct(*(F.regexp_extract(x, _PARTS, k).alias(f"p{k}") for k in range(1, 6))), lambda p: let(put_together(*(p[f"p{k}"] for k in range(1, 6))), lambda u: F.when(u.isNotNull(), F.struct(u.alias("url"), _name(p["p2"]).alias("host")))))
    return let(F.trim(joined(base["s"], base["a"], base["p"], F.trim(link))), whole)


#: Paths of plain segments, of which none begins with a dot and nothing is normalised.
_PLAIN = "[A-Za-z0-9_~-][A-Za-z0-9._~-]*"
_PLAIN_PATH, _PLAIN_FOLDER = rf"{_PLAIN}(?:/{_PLAIN})*\z", rf"^/(?:{_PLAIN}/)*\z"


def base(url: Column) -> Column:
    """What placed_on() needs of a page's address, once for all its links: its parts and, as prefixes of addresses, its host, its folder and the folder above (null where they are not plain)."""
    parts = F.struct(scheme(url).alias("s"), part(url, 2).alias("a"), part(url, 3).alias("p"))

    def told(x: Column) -> Column:
        root = F.regexp_replace(put_together(x["s"], x["a"], F.lit("/-"), F.lit(""), F.lit("")), "/-$", "")
        folder = F.regexp_replace(F.when(x["p"] == "", "/").otherwise(x["p"]), r"[^/]*$", "")
        plain = F.when(folder.rlike(_PLAIN_FOLDER), folder)
        return F.struct(x["s"].alias("s"), x["a"].alias("a"), x["p"].alias("p"), root.alias("root"), F.concat(root, plain).alias("folder"), F.concat(root, F.regexp_replace(plain, "[^/]+/$", "")).alias("up"))

    return let(parts, told)


def placed_on(base: Column, link: Column) -> Column:
    """placed(base, link)["url"] for many links of a page: a plain path is put behind the page's host or folder, any other link goes through placed()."""
    return (
        F.when(base["root"].isNotNull() & link.rlike(f"^/{_PLAIN_PATH}"), F.concat(base["root"], link))
        .when(base["folder"].isNotNull() & link.rlike(f"^{_PLAIN_PATH}"), F.concat(base["folder"], link))
        .when(base["up"].isNotNull() & link.rlike(rf"^\.\./{_PLAIN_PATH}"), F.concat(base["up"], F.substring(link, 4, 1 << 30)))
        .otherwise(placed(base, link)["url"])
    )


def joined(scheme: Column, authority: Column, path: Column, link: Column) -> Column:
    """The absolute address of a link, without blanks around it, on the page of these parts; not normalised."""
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#") | link.rlike(r"(?i)^(mailto|javascript|tel|data):"), None)
        .when(link.rlike(r"(?i)^https?://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link)).otherwise(F.concat(root, folder, link))
    )


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def within(name: Column, hosts: list[str]) -> Column:
    """Whether a host is one of hosts or below one."""
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (name == h) | name.endswith(F.concat(F.lit("."), h)))


def blocked_reason(url: Column) -> Column:
    """Why an address must not be fetched, the first reason that holds; null if it may be."""
    parts = F.struct(scheme(url).alias("s"), part(url, 2).alias("a"), F.trim(url).alias("u"))
    name = lambda a: F.when(a.rlike(r"^\["), F.lower(F.regexp_extract(a, r"^\[([^\]]*)\]", 1))).otherwise(_name(a))
    return let(parts, lambda x: let(F.struct(x["s"].alias("s"), name(x["a"]).alias("h"), x["u"].alias("u")), _blocked))


def _blocked(x: Column) -> Column:
    s, h = x["s"], x["h"]
    ip = h.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    n = lambda k: F.get(F.split(h, r"\."), F.lit(k)).cast("int")
    return (
        F.when((s == "") | ~s.isin("http", "https") & x["u"].rlike(r"^[a-z]+:$"), "invalid_url").when(~s.isin("http", "https"), "scheme_not_allowed")
        .when(h.isin("localhost", "127.0.0.1", "::1", "0.0.0.0"), "blocked_host").when(h.endswith(".local") | h.endswith(".internal"), "blocked_tld")
        .when(ip & (n(0) == 10), "private_ip").when(ip & (n(0) == 172) & n(1).between(16, 31), "private_ip").when(ip & (n(0) == 192) & (n(1) == 168), "private_ip")
        .when(ip & (n(0) == 127), "loopback_ip").when(ip & (n(0) == 169) & (n(1) == 254), "link_local_ip")
    )


def is_live(url: Column) -> Column:
    h = bare_host(url)
    local = (F.trim(url) == "") | F.trim(url).rlike(BLOCKED_SCHEME) | F.trim(url).rlike(BLOCKED_PATH) | F.trim(url).rlike(SPEC_FILE)
    off = h.isin(*PLACEHOLDER_HOSTS) | h.endswith(".local") | h.endswith(".test") | h.endswith(".localhost") | h.rlike(PRIVATE_PREFIX)
    return F.coalesce(~local & scheme(url).isin("http", "https") & ~off & ~part(url, 3).rlike(BLOCKED_PATH), F.lit(False))


def is_noise(url: Column) -> Column:
    low = F.lower(url)
    noise = low.rlike(IMAGE_URL)
    for pattern in CHROME_URLS:
        noise = noise | low.rlike(pattern)
    return noise
