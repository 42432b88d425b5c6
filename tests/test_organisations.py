from webloom.operators import matching, organisations


def test_containing_equals_all_pairs(spark):
    needles = ["acme", "acme inc", "e co", "zeta-works", "яндекс", "no where", "a", "--", "works"]
    texts = [(1, "the acme incident"), (2, "we like co and acme"), (3, "great zeta-works!"), (4, "яндексы"), (5, ""), (6, None), (7, "nowhere"), (8, "zeta works")]
    got = {(r.id, n) for r in matching.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "id long, text string")).collect() for n in r.needles}
    assert got == {(i, n) for i, t in texts for n in needles if t and n in t and any(c.isalnum() for c in n)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in matching.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_details_and_merge(spark):
    far = "x" * 300
    texts = [
        (1, f"She is the founder of Acme Works LLC. {far} Then Acme Works LLC at 12 Main Street, Austin, TX 78701 called 415-555-0199."), (2, "acme works is a member of nothing"), (3, "He works at Bolt & Co daily"),
        (4, f"registered agent: {far} Bolt & Co {far} employee of others"), (5, "Red Kite Trust and Cart"),
    ]
    orgs = spark.createDataFrame([("Acme Works LLC",), ("Bolt & Co",), ("Kite Trust",), ("Nobody",)], "name string")
    told = organisations.details(organisations.mentions(orgs, spark.createDataFrame(texts, "id long, text string")), ["kite"])
    rows = {(r["name"], r.id): r for r in told.collect()}
    assert set(rows) == {("Acme Works LLC", 1), ("Acme Works LLC", 2), ("Bolt & Co", 3), ("Bolt & Co", 4), ("Kite Trust", 5)}
    acme = rows["Acme Works LLC", 1]
    assert (acme.n_windows, acme.kind, acme.owned, acme.form) == (2, "registered_entity", False, "LLC") and acme.links == ["founder: founder/owner language"]
    assert [a.address for a in acme.addresses] == ["12 Main Street, Austin, TX 78701"] and acme.phones == ["415-555-0199"]
    assert rows["Acme Works LLC", 2].n_windows == 1 and rows["Bolt & Co", 3].kind == "employer" and rows["Bolt & Co", 4].kind == "unknown"
    assert rows["Kite Trust", 5].owned
    merged = {r["name"]: r for r in organisations.merged(told, spark.createDataFrame([("Acme Works Holding",)], "name string")).collect()}
    assert merged["Acme Works LLC"].kind == "owned_business" and merged["Bolt & Co"].kind == "employer" and merged["Bolt & Co"].texts == [3, 4]


def test_empty(spark):
    orgs, texts = spark.createDataFrame([], "name string"), spark.createDataFrame([], "id long, text string")
    assert organisations.details(organisations.mentions(orgs, texts)).count() == 0 and organisations.groups(orgs).count() == 0


def test_names_that_share_a_word_are_few_candidates(spark):
    """Names of one country don't meet all its texts: the rarest of a name's words leads."""
    names = spark.range(300).selectExpr("concat('west land ', id, ', inc.') as needle")
    texts = spark.range(300).selectExpr("id", "concat('they sell to West Land ', id, ', inc. now') as text").selectExpr("id", "lower(text) as text")
    found = matching.containing(names, texts).selectExpr("id", "explode(needles) as needle").collect()
    assert {(r.id, r.needle) for r in found} == {(i, f"west land {i}, inc.") for i in range(300)}
    assert matching.candidates(names, texts).selectExpr("sum(size(needles)) as n").first().n <= 2 * 300
