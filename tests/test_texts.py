from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import markup


def test_sentences_keep_digits_at_their_ends(spark):
    """The number of a sentence in its text is nothing to cut off its ends."""
    said = [f"{i}{i} is how this sentence of some length begins and ends, {i}{i}" for i in range(12)]
    text = ".  ".join(said) + "."
    got = spark.createDataFrame([(text,)], "text string").select(T.sentences(F.col("text")).alias("s")).first().s
    assert got == [f"{x}." for x in said]
    ends = " ".join(f"A sentence of some length whose end is a {i}? {i}" for i in range(3))
    assert spark.createDataFrame([(ends + " " * 3,)], "text string").select(T.sentences(F.col("text"), 1).alias("s")).first().s[-1] == "2"


def test_references_without_a_semicolon_are_text():
    d = markup.scan("<p>cut off &amp; here &amp, &ampx; &lt;b&gt; &#39;&#x41; &copy 1<a href='/?a=1&copy=2&amp;b=3'>&nbsp;on &amp</a>")
    assert d["text"] == "cut off & here &amp, &ampx; <b> 'A &copy 1 on &amp" and d["links"] == [{"href": "/?a=1&copy=2&b=3", "anchor": "on &amp"}]
