"""Queries that write a topic's report from all captured pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition, reports
from ..sources.tables import table
from .queries import _links

QUERIES = {}
ABOUT = "the tion of"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _lines(spark, d):
    pages = table(spark, d, "pages")
    return composition.lines(composition.gathered(pages, ABOUT), reports.subtopics(pages), _links(pages).select("page_id", "target", "pos"))


@query
def report_findings(spark, d):
    return composition.findings(composition.gathered(table(spark, d, "pages"), ABOUT)).select(F.col("n").cast("long").alias("n"), "line")


@query
def report_summary(spark, d):
    return composition.summary(composition.gathered(table(spark, d, "pages"), ABOUT))


@query
def report_lines(spark, d):
    """The lines of statistics, the graph and the index, and the heads of pages."""
    return _lines(spark, d).filter("section in (2, 5, 6) or section = 4 and n % 100 = 0").select(F.col("section").cast("long").alias("section"), "n", "line")


@query
def report_markdown(spark, d):
    """The report as one text: how many lines it has, and its sections."""
    text = composition.markdown(ABOUT, _lines(spark, d))
    return text.select(F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^## (.*)$"), F.lit(1)), "|").alias("sections"), F.substring_index("text", "\n", 3).alias("head"))
