"""Posts in data that pages embed: JSON of any depth, walked where its page is read.

A page goes through once, in Arrow batches; there is no limit of depth but that of the parser. Malformed blocks are left out.
A node knows the posts around it, so an image belongs to each post whose node it lies in. Posts have no order.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.binding import let
from . import facets, markup

#: The data's types, and the full text of a post as it stands in scripts.
LINKED, PLAIN = "application/ld+json", "application/json"
FULL_TEXT = r'"full_text"\s*:\s*"((?:\\.|[^"\\])*+)"'
IMAGE_FILE = r"(?i)\.(?:jpg|jpeg|png|webp)"
#: What is told of a node.
NODE = "block int, path string, text string, link string, published string, alt string, post boolean, image string, owners array<struct<path: string, link: string>>"
NODE_COLUMNS = ("block", "path", "text", "link", "published", "alt", "post", "image", "owners")

_IMAGE = re.compile(IMAGE_FILE, re.A)


def blocks(dom: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, block, body): the data that scanned pages embed; plain data of 51 to 499,999 characters."""
    each = dom.select(id_col, "url", F.posexplode("dom.scripts").alias("block", "s")).select(id_col, "url", "block", "s.type", F.trim("s.body").alias("body"))
    size = F.length("body")
    return each.filter(((F.col("type") == LINKED) & (size > 0)) | ((F.col("type") == PLAIN) & (size > 50) & (size < 500_000))).drop("type")


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def _constant(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant, parse_int=lambda x: 0, parse_float=lambda x: 0)  # only texts are told, so a number of any length is read


def _parsed(body: str) -> object:
    """The JSON that body begins with; None where it is malformed, has a key of an object twice or is deeper than the parser goes."""
    try:
        return _JSON.raw_decode(body, len(body) - len(body.lstrip(" \t\n\r")))[0]
    except (ValueError, RecursionError):
        return None


def _told(url: str | None, body: str) -> list[dict[str, object]]:
    """Posts and images of one block, as `NODE` lists them: a walk with a stack of its own, so of any depth."""
    top, out = _parsed(body), []
    # a mark of a repost in a node's JSON stands in the block, or is hidden there by an escape
    low = body.lower()
    doubtful = "\\u" in low or any(w in low for w in facets.REPOST_WORDS)
    waiting: list[tuple[object, str, tuple]] = [(top, "$", ())]
    while waiting:
        node, path, owners = waiting.pop()
        if isinstance(node, list):
            waiting.extend((x, f"{path}.{n}", owners) for n, x in enumerate(node) if isinstance(x, (dict, list)))
            continue
        if not isinstance(node, dict):
            continue

        def told(key: str) -> str | None:
            value = node.get(key)
            return value if isinstance(value, str) and value else None

        text = told("full_text") or told("text") or told("caption") or (told("description") if node.get("@type") == "SocialMediaPosting" else None)
        own = told("url")
        link = own or told("permalink") or url
        post = text is not None and 5 < len(text) < 5000 and not (doubtful and (facets.has_mark(text) or facets.has_mark(_written(node))))
        if post:
            owners = (*owners, {"path": path, "link": link})
        image = told("display_url") or told("media_url_https") or (own if own and _IMAGE.search(own) else None)
        if post or image:
            out.append({"path": path, "text": text, "link": link, "published": told("created_at"), "alt": told("alt_text"), "post": post, "image": image, "owners": list(owners) if image else []})
        waiting.extend((x, f"{path}.{key}", owners) for key, x in node.items() if isinstance(x, (dict, list)))
    return out


def _whole(text: str | None) -> str | None:
    return text if text is None else text.encode("utf-8", "replace").decode()  # half a pair of surrogates is no text


def _written(node: object) -> str:
    """node as JSON without blanks, members by key: what marks of reposts are looked for in."""
    try:
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except RecursionError:
        return ""


def _of_block(url: str | None, body: str) -> list[dict[str, object]]:
    found = _told(url, body)
    if "\\u" in body:
        for x in found:
            x |= {k: _whole(x[k]) for k in ("path", "text", "link", "published", "alt", "image")}
            x["owners"] = [{k: _whole(v) for k, v in o.items()} for o in x["owners"]]
    return found


def _is_block(kind: str, body: str) -> bool:
    return bool(body) and kind == LINKED or kind == PLAIN and 50 < len(body) < 500_000


def _of_page(url: str | None, scripts: list[dict[str, str]]) -> list[dict[str, object]]:
    bodies = ((n, s["type"], s["body"].strip(" ")) for n, s in enumerate(scripts))
    return [{"block": n, **x} for n, kind, body in bodies if _is_block(kind, body) for x in _of_block(url, body)]


def _nodes(each: DataFrame, id_col: str) -> DataFrame:
    """Rows of `NODE` of (id, url, dom.nodes); an image is only what may be one of a post."""
    rows = each.select(id_col, "url", F.explode("dom.nodes").alias("n")).select(id_col, "url", "n.*")
    return rows.withColumn("image", F.when(facets.is_post_image(F.col("image")), F.col("image")))


def walked(bodies: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The posts and images in bodies (id, url, block, body): (id, url, block, path, text, link, published, alt, post, image, owners), owners of an image being (path, link) of the posts around it and of its own node."""
    rows = bodies.select(F.struct(id_col, "block").alias("of"), "url", "body")
    told = markup.scanned(rows, "of", "body", f"nodes array<struct<{NODE}>>", lambda url, body: {"nodes": [{"block": None, **x} for x in _of_block(url, body or "")]})
    return _nodes(told, "of").drop("block").select(f"of.{id_col}", "url", "of.block", *(c for c in NODE_COLUMNS if c != "block"))


def read(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """walked() of the data that pages (id, url, html) embed, in one pass over them."""
    return _nodes(markup.scanned(pages, id_col, ddl=f"nodes array<struct<{NODE}>>", told=lambda url, page: {"nodes": _of_page(url, markup.scripts(page))}), id_col)


def posts(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, block, path, text, link, published, hashtags, mentions) of the posts among walked nodes."""
    return nodes.filter("post").select(id_col, "block", "path", "text", "link", "published", T.hashtags(F.col("text")).alias("hashtags"), T.mentions(F.col("text")).alias("mentions"))


def images(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, block, path, image, alt, post): the images within each post, `path` and `post` being the post's."""
    return nodes.filter("image is not null").select(id_col, "block", F.explode("owners").alias("o"), "image", "alt").select(id_col, "block", "o.path", "image", "alt", F.col("o.link").alias("post"))


def _has_full_texts() -> Column:
    return F.contains("html", F.lit('"full_text"')) & facets.is_own(F.lit(None), F.col("html"))


def full_texts(pages: DataFrame, most: int | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, pos, text): all full texts of posts in a page's source, or its first `most`, unescaped, without reposts; a mark anywhere in the page makes all of them reposts."""
    found = F.regexp_extract_all("html", F.lit(FULL_TEXT), F.lit(1))
    rows = pages.filter(_has_full_texts()).select(id_col, F.posexplode(found if most is None else F.slice(found, 1, most)).alias("pos", "raw")).withColumn("text", facets.unescaped(F.col("raw")))
    return rows.filter(facets.is_own(F.col("text"), F.lit(None))).select(id_col, "pos", "text")


def content(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, origin, text, link) of all posts of pages (id, url, html), a row being a page that is read once: embedded, by full text, by markup; a page's description only where it has no post."""

    def told(url: str | None, page: str | None) -> dict[str, object]:
        found = markup.scan(page)
        return found | {"nodes": [x for x in _of_page(url, found["scripts"]) if x["post"]]}

    rows = pages.select(F.struct(id_col, F.when(_has_full_texts(), F.regexp_extract_all("html", F.lit(FULL_TEXT), F.lit(1))).alias("full")).alias("of"), "url", "html")
    dom = markup.scanned(rows, "of", ddl="posts array<string>, metas array<struct<name string, content string>>, nodes array<struct<text string, link string>>", told=told)
    post = lambda origin, text, link: F.struct(F.lit(origin).alias("origin"), text.alias("text"), link.alias("link"))
    of = lambda origin, texts: F.transform(texts, lambda t: post(origin, t, F.col("url")))
    none = F.array().cast("array<struct<origin: string, text: string, link: string>>")
    full = F.filter(F.transform("of.full", facets.unescaped), lambda t: facets.is_own(t, F.lit(None)))
    found = F.concat(F.transform("dom.nodes", lambda n: post("embedded", n["text"], n["link"])), F.coalesce(of("full_text", full), none), of("markup", markup.own_posts(F.col("dom.posts"))))
    every = let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(of("description", markup.description())))
    return dom.select(F.col(f"of.{id_col}"), F.explode_outer(every).alias("p")).filter("p is not null").select(id_col, "p.*")
