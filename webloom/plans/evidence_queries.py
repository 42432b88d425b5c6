"""Queries on dated evidence: what is told about orders, each with a firm and a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline
from ..sources.tables import spread, table
from .table_queries import _put, chosen

QUERIES = {}
#: What is told of an order, by its number; {c} is a firm and {d} the date.
TOLD = (
    "Joined the team at {c} as analyst on {d}.", "Until then nothing; {d} started at {c} as a tea taster.", "He worked at {c} until {d} and left.", "{d}: we are hiring, apply now at {c} in town.",
    "She moved to a town on {d} with nobody.", "The startup {c} LLC was seen on {d}.", "On {d} there was a talk with {c} in town.",
)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _events(spark, d):
    firm = F.format_string("Acme %d Works", F.pmod("o_custkey", F.lit(7)))
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select("o_orderkey", "o_custkey", _put(_put(chosen(TOLD, F.col("o_orderkey")), "{c}", firm), "{d}", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text"))
    return timeline.events(orders.select(F.struct("o_orderkey", "o_custkey").alias("doc_id"), "text"))


@query
def dated_evidence(spark, d):
    return _events(spark, d).select("doc_id.o_orderkey", F.date_format("date", "yyyy-MM-dd").alias("date"), "category", "entity", "role", "confidence")


@query
def employment_spans(spark, d):
    rows = _events(spark, d).select((F.col("doc_id.o_custkey") % 50).alias("who"), F.col("doc_id.o_orderkey").alias("seq"), "date", "category", "entity", "role")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return timeline.employment(rows).select("who", "key", "company", "role", day("start"), day("end"), "status")
