"""Social addresses: platform, user name and whether they are profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .binding import let

#: Platform, pattern of its hosts, pattern of a profile's path, form of a profile's address.
PLATFORMS = (
    ("twitter", r"(?i)(?:^|\.)((?:x|twitter)\.com)$", r"^\/([a-zA-Z0-9_]{1,15})\/?(?:\?|#|$)", "https://x.com/"),
    ("facebook", r"(?i)(?:^|\.)facebook\.com$", r"^\/(?!groups|pages|events|watch|share|photo|story|reel)([a-zA-Z0-9.]{2,50})\/?(?:\?|#|$)", "https://facebook.com/"),
    ("instagram", r"(?i)(?:^|\.)instagram\.com$", r"^\/(?!p|reel|stories|explore|accounts|direct)([a-zA-Z0-9._]{1,30})\/?(?:\?|#|$)", "https://instagram.com/"),
    ("linkedin", r"(?i)(?:^|\.)linkedin\.com$", r"^\/in\/([a-zA-Z0-9_-]{2,100})\/?(?:\?|#|$)", "https://linkedin.com/in/"),
    ("tiktok", r"(?i)(?:^|\.)tiktok\.com$", r"^\/@([a-zA-Z0-9._]{2,24})\/?(?:\?|#|$)", "https://tiktok.com/@"),
    ("youtube", r"(?i)(?:^|\.)youtube\.com$", r"^\/(?:@|c\/|user\/)([a-zA-Z0-9._-]{2,50})\/?(?:\?|#|$)", "https://youtube.com/@"),
    ("github", r"(?i)(?:^|\.)github\.com$", r"^\/(?!orgs|topics|marketplace|features|settings|login|search|explore)([a-zA-Z0-9_-]{1,39})\/?(?:\?|#|$)", "https://github.com/"),
    ("threads", r"(?i)(?:^|\.)threads\.net$", r"^\/@([a-zA-Z0-9._]{1,30})\/?(?:\?|#|$)", "https://threads.net/@"),
    ("mastodon", r"(?i)mastodon\.|\.social$", r"^\/@([a-zA-Z0-9_]{1,30})\/?(?:\?|#|$)", None),
)


def classified(url: Column) -> Column:
    """struct (platform, username, profile) by the first platform whose hosts fit; null for other hosts. Profiles have a username, as it is written."""

    def of(x: Column) -> Column:
        out = None
        for platform, hosts, profile, _ in PLATFORMS:
            name = F.regexp_extract(x["path"], profile, 1)
            value = F.struct(F.lit(platform).alias("platform"), F.when(name != "", name).alias("username"), (name != "").alias("profile"))
            out = F.when(x["host"].rlike(hosts), value) if out is None else out.when(x["host"].rlike(hosts), value)
        return out

    return let(F.struct(U.bare_host(url).alias("host"), U.part(url, 3).alias("path")), of)


def profile_url(url: Column) -> Column:
    """The canonical address of a profile, user name in lower case; null where it is none. A federated user stays on the own instance."""
    table = F.create_map(*(F.lit(x) for platform, _, _, form in PLATFORMS if form for x in (platform, form)))

    def of(x: Column) -> Column:
        start = F.coalesce(table[x["platform"]], F.concat(F.substring_index(url, "/@", 1), F.lit("/@")))
        return F.when(x["profile"], F.concat(start, F.lower(x["username"])))

    return let(classified(url), of)
