"""Queries on the markup of pages and on data embedded in pages; the latter over a page that Spark writes for each order and its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedded, markup
from ..sources.tables import kept, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def order_pages(spark, d):
    """(page_id, url, html): each order as a post with its lines as posts within, each with a picture, and once more as markup."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # what is shuffled are numbers, once; texts are written behind, in as many tasks
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), whole("l_partkey"), "l_returnflag").repartition(tasks, "page_id")
    inner = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), whole("o_custkey"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")).repartition(tasks, "page_id")
    order, join = F.coalesce(F.col("page_id").cast("string"), F.lit("null")), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = orders.join(inner, "page_id", "left").withColumn("url", join("https://shop.net/o/", order))
    told = join("Order ", order, " of customer ", F.col("o_custkey"), " #c", F.col("o_custkey"))

    def item(x):
        n = F.coalesce(x["n"].cast("string"), F.lit("null"))
        media = F.array(F.struct(join("https://img.net/", x["part"], ".jpg").alias("display_url"), x["flag"].alias("alt_text")))
        return F.struct(join("Line ", n, " is part ", x["part"]).alias("text"), join("https://shop.net/o/", order, "/", n).alias("permalink"), media.alias("media"))

    shown = F.transform("lines", lambda x: join('<li><a href="../part/', x["part"], '">Part<img src=/i/', x["part"], '.png alt="part ', x["part"], '"></a>'))
    data = F.to_json(F.struct(F.lit("SocialMediaPosting").alias("@type"), told.alias("description"), "url", "created_at", F.struct(F.transform("lines", item).alias("lines")).alias("content")))
    markup_ = join("<article><p>", told, " by @clerk_", F.substring("o_orderpriority", 1, 1), ".<ul>", F.array_join(shown, ""), "</article>")
    html = join("<h1>Order</h1><meta property=og:title content='Shop &amp; order'><script type='application/ld+json'>", data, "</script>", F.coalesce(markup_, F.lit("")))
    return rows.select("page_id", "url", html.alias("html"))


@query
def page_text_dom(spark, d):
    return markup.scanned(table(spark, d, "pages")).select("page_id", "dom.text")


@query
def page_links_dom(spark, d):
    return markup.links(markup.scanned(table(spark, d, "pages"))).select("page_id", "target", F.col("pos").cast("long").alias("pos"), "anchor")


@query
def page_posts(spark, d):
    return markup.posts(markup.scanned(table(spark, d, "pages")), None).select("page_id", F.col("pos").cast("long").alias("pos"), "text")


@query
def order_images(spark, d):
    pages = markup.scanned(order_pages(spark, d), ddl="images array<struct<src string, alt string, link string>>, metas array<struct<name string, content string>>")
    return markup.images(kept(pages)).select("page_id", F.col("pos").cast("long").alias("pos"), "image", "post", "alt")


@query
def order_profiles(spark, d):
    return markup.profiles(markup.scanned(order_pages(spark, d))).select("page_id", "display", "bio", "avatar")


@query
def order_mentions(spark, d):
    posts = markup.posts(markup.scanned(order_pages(spark, d)), None)
    return posts.select(F.explode("mentions").alias("name"), F.size("hashtags").cast("long").alias("n_tags")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tags").alias("n_tags"))


@query
def embedded_posts(spark, d):
    return embedded.posts(embedded.read(order_pages(spark, d))).select("page_id", "text", "link", "published", F.array_join("hashtags", ",").alias("hashtags"))


@query
def embedded_images(spark, d):
    return embedded.images(embedded.read(order_pages(spark, d))).select("page_id", "image", "alt", "post")


@query
def social_content(spark, d):
    return embedded.content(order_pages(spark, d)).groupBy("origin").agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("page_id").alias("n_pages"))
