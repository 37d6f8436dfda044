from spanloom.operators.similarity import search_entities


def test_long_labels_are_found_by_many_queries(spark):
    """More than 10,000 queries, and a label that is over three times as long as the query."""
    long = "low dose aspirin for the prevention of strokes in adults"
    labels = spark.createDataFrame([(long, "u1", ["c"])], "label string, uri string, kinds array<string>")
    many = spark.range(10_001).selectExpr("concat('zz', id) AS text").union(spark.createDataFrame([("aspirin",), ("of",)], "text string"))
    assert sorted((r.q, r.uri) for r in search_entities(many, labels).collect()) == [("aspirin", "u1"), ("of", "u1")]
