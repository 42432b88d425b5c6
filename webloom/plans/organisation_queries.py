"""Queries on organisations: those that supply, in what is told about customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import organisations
from ..sources.tables import table
from .table_queries import _put, _supplied, chosen

QUERIES = {}
#: What is told about customers, by their number; {f} is a supplier, {F} in capitals.
TOLD = (
    "Jane is the founder of {f} and lives here. Call 415-555-0199 now.", "She works at {f} since May; see 12 Main Street, Austin, TX 78701 for more.", "{f} sells tea to everyone.", "A note on nothing at all in this long enough text.",
    "{F}: its president spoke, the president of {f} did.", "Two mentions: {f} and {f}, a member of a guild.", "mailing address: {f}, 7 Long Road, Reno, NV; +1 702 555 0100",
)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _orgs(spark, d):
    return _supplied(spark, d).select(F.col("firm").alias("name"), "id")


def _texts(spark, d):
    orgs = _orgs(spark, d).withColumnRenamed("id", "s")
    n = table(spark, d, "supplier").count()
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_custkey", F.lit(n)).alias("s"))
    told = _put(_put(chosen(TOLD, F.col("id")), "{f}", F.col("name")), "{F}", F.upper("name"))
    return people.join(orgs, "s").select("id", told.alias("text"))


@query
def organisation_windows(spark, d):
    return organisations.details(organisations.mentions(_orgs(spark, d), _texts(spark, d))).select("name", "id", "n_windows", "kind", "owned", F.size("phones").cast("long").alias("n_phones"))


@query
def organisation_map(spark, d):
    told = organisations.merged(organisations.details(organisations.mentions(_orgs(spark, d), _texts(spark, d))), _orgs(spark, d).filter("id % 11 = 0"))
    return told.select("name", "norm", "kind", "owned", "n_texts", F.array_join("texts", ",").alias("texts"), F.array_join("links", "|").alias("links"), F.array_join("phones", "|").alias("phones"))


@query
def organisation_groups(spark, d):
    return organisations.groups(_orgs(spark, d))
