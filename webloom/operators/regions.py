"""Regions of pages: by host, declared language or script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.binding import let

#: Fixed values in order of precedence: code, name, wiki language, top-level domains, hosts, languages.
REGIONS = (
    ("GLOBAL", "Global (English)", "en", (".org", ".int"), ("wikipedia.org", "britannica.com", "bbc.com", "reuters.com"), ("en",)),
    ("IN", "India", "hi", (".in",), ("timesofindia.indiatimes.com", "thehindu.com", "indiatoday.in", "livemint.com"), ("hi", "en-in", "bn", "ta", "te", "mr")),
    ("CN", "China", "zh", (".cn",), ("163.com", "sina.com.cn", "xinhuanet.com", "people.com.cn", "baidu.com"), ("zh", "zh-cn", "zh-hans")),
    ("RU", "Russia", "ru", (".ru",), ("tass.com", "ria.ru", "rt.com", "kommersant.ru"), ("ru",)),
    ("JP", "Japan", "ja", (".jp",), ("nhk.or.jp", "asahi.com", "mainichi.jp"), ("ja",)),
    ("DE", "Germany / EU (German)", "de", (".de",), ("dw.com", "spiegel.de", "zeit.de"), ("de",)),
    ("BR", "Brazil / Latin America (Portuguese)", "pt", (".br",), ("globo.com", "uol.com.br"), ("pt", "pt-br")),
    ("SA", "Middle East (Arabic)", "ar", (".sa", ".ae", ".eg"), ("aljazeera.com", "arabnews.com"), ("ar",)),
    ("KR", "South Korea", "ko", (".kr",), ("yna.co.kr", "koreaherald.com"), ("ko",)),
    ("FR", "France / Francophone", "fr", (".fr",), ("lemonde.fr", "france24.com"), ("fr",)),
)
#: Fixed values in order of precedence: script ranges and their regions.
SCRIPTS = (("RU", "[\\u0400-\\u04FF]"), ("CN", "[\\u4E00-\\u9FFF\\u3400-\\u4DBF]"), ("IN", "[\\u0900-\\u097F]"), ("SA", "[\\u0600-\\u06FF]"), ("KR", "[\\uAC00-\\uD7AF]"), ("JP", "[\\u3040-\\u30FF]"))


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for holds, code in cases[1:]:
        out = out.when(holds, code)
    return out


def by_host(host: Column) -> Column:
    """The first region that lists the host, a parent of it or its top-level domain."""
    return _first([(F.lit(False) if not (domains or tlds) else F.greatest(*(((host == d) | host.endswith(f".{d}")) for d in domains), *(host.endswith(t) for t in tlds)), code) for code, _, _, tlds, domains, _ in REGIONS])


def by_lang(lang: Column) -> Column:
    base = F.split(lang, "-")[0]
    return _first([(lang.isin(*hints) | base.isin(*hints), code) for code, *_, hints in REGIONS])


def by_script(text: Column) -> Column:
    head = text
    return _first([(head.rlike(p), code) for code, p in SCRIPTS])


def region(url: Column, html: Column) -> Column:
    """Host unless that says GLOBAL, then declared language, script, and host again."""
    told = lambda h: F.coalesce(F.when(h != "GLOBAL", h), let(T.html_lang(html), by_lang), by_script(html), h, F.lit("GLOBAL"))
    return let(let(U.host(url), by_host), told)


def coverage(counts: DataFrame) -> DataFrame:
    """Every region with its count, and whether it is missing."""
    dim = counts.sparkSession.createDataFrame([(r[0], r[1]) for r in REGIONS], "region string, name string")
    joined = dim.join(counts, "region", "left")
    return joined.select("region", "name", F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"), F.col("n_pages").isNull().alias("missing"))
