"""Facets of hand-made sentences, with what they have to name."""

from pyspark.sql import functions as F

from webloom.operators import chat, facets


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def pairs(found):
    return [tuple(x) for x in found]


def test_phrases(spark):
    assert pairs(one(spark, facets.connections, "Jo works at Acme Corp, founder of Blue Kite; member of X.")) == [("employer", "Acme Corp"), ("founder", "Blue Kite")]
    assert pairs(one(spark, facets.past_employment, "Formerly at Red Barn. Former CTO of Green Hill")) == [("Red Barn. Former CTO of Green Hill",) * 2, ("CTO", "Green Hill")]
    assert pairs(one(spark, lambda t: facets.named(t, facets.PAY), "pay: $90,000 per year, $30/hr")) == [("compensation", x) for x in ("$30/hr", "$90,000 per year", "pay: $90,000 per year")]
    assert pairs(one(spark, facets.workplaces, "Office at 12 Long Road; main line: 415-555-0199")) == [("address", "12 Long Road"), ("phone", "415-555-0199")]
    assert pairs(one(spark, facets.places, "She moved from Oslo. Born in Paris.")) == [("past", "Oslo"), ("origin", "Oslo"), ("origin", "Paris")]
    assert one(spark, facets.company_names, "Nothing here.") == []
    assert one(spark, facets.connections, None) is None


def test_posts_and_addresses(spark):
    assert one(spark, lambda t: facets.repost_reason(t, F.lit(None).cast("string")), "seen via @kite") == r"\bvia @"
    assert one(spark, facets.is_post_image, "https://x.org/icon-media.png") and not one(spark, facets.is_post_image, "https://x.org/logo.png")
    assert one(spark, facets.unescaped, r"a\nb \"c\" \\d") == 'a\nb "c" \\d'
    assert one(spark, facets.company_near, "She was at Acme Works until May") == "Acme Works"
    assert one(spark, facets.organisation_of, "https://github.com/orgs/kites") == "kites" and one(spark, facets.organisation_of, "https://github.com/login") is None
    assert one(spark, facets.government_of, "https://a.gov/x") == "https://a.gov/x" and one(spark, facets.government_of, "https://a.gov.uk") is None


def test_search_mode_confidence(spark):
    assert tuple(one(spark, chat.search_scores, "explain the tcp protocol")) == ("knowledge", 0.98)
    # a name 2, a place 2, two proper names of four words 2, no cue of knowledge
    assert tuple(one(spark, chat.search_scores, "Jane Doe, Austin, TX")) == ("people", 0.98)
    assert tuple(one(spark, chat.search_scores, "")) == ("people", 0.55)
