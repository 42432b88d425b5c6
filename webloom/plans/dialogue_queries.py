"""Queries on dialogues that go on: what users say in conversations is made short by a list of forms, their words are the tables'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import table
from .queries import _texts
from .table_queries import _cued, _put, chosen

QUERIES = {}
#: Forms of what is said; {t} is the last word of three letters and more of the turn.
SAID = ("what is {t}?", "tell me more", "Go on please", "define {t}", "{t}", "continue", "", "{t} qqqzz", "say more")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _said(spark, d):
    turns = table(spark, d, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    word = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "^(?s:.*)(?<![a-z0-9])([a-z0-9]{3,})", 1)
    return turns.select("conv_id", "turn", _put(chosen(SAID, F.col("conv_id") * 5 + F.col("turn")), "{t}", word).alias("text"))


@query
def question_ranking(spark, d):
    asked = _said(spark, d).filter("text <> ''").select(F.col("text").alias("question"))
    return retrieval.ranked(asked, _texts(table(spark, d, "documents")), 5).select("question", F.col("rank").cast("long").alias("rank"), "sentence", "score")


@query
def chat_session(spark, d):
    return retrieval.sessions(_said(spark, d), _texts(table(spark, d, "documents")))


@query
def small_talk(spark, d):
    return retrieval.small_talk(_cued(spark, d).groupBy("conv_id", "turn").agg(F.min("text").alias("text")))
