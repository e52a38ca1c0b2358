"""Citation check, masking, nearest vectors."""

import math


from pyspark.sql import functions as F

from ledgerwatch.functions.text import masked, ungrounded
from ledgerwatch.operators import retrieval

ROW = "narrative string, cited array<string>, allowed array<string>, context string"


def bad(spark, *rows):
    df = spark.createDataFrame(rows, ROW)
    return [r[0] for r in df.select(ungrounded(F.col("narrative"), F.col("cited"), F.col("allowed"), F.col("context"))).collect()]


def test_fabricated_and_grounded_references(spark):
    label = "AML-POL 4.2 Money Mule Red Flags"
    got = bad(
        spark,
        ("See Section 45-IA and [AML-POL 9.9] and [AML-POL 4.2(c)]", [], [label], ""),
        ("Per [AML-POL 4.2(a)] and [AML-POL 6.1]", ["[AML-POL 4.2]"], [label, "AML-POL 6.1 STR Filing Timeline"], ""),
    )
    assert got == [["Section 45-IA", "[AML-POL 9.9]"], []]


def test_missing_inputs_fail_closed(spark):
    assert bad(spark, ("See [AML-POL 4.2]", None, None, None), (None, ["[AML-POL 4.2]"], ["AML-POL 4.2 X"], None), (None, None, None, None)) == [
        ["[AML-POL 4.2]"], [], [],
    ]


def test_prefix_leniency_of_the_context(spark):
    """A short reference passes when the context holds a longer one that starts with it."""
    assert bad(spark, ("See Section 1", [], [], "as Section 12 says"), ("See Section 2", [], [], "as Section 12 says")) == [[], ["Section 2"]]


def test_masking_longest_first(spark):
    df = spark.createDataFrame([("Rule 12 and Rule 1 and [X 1]", ["Rule 1", "Rule 12", "[X 1]"])], "t string, refs array<string>")
    text = df.select(masked(F.col("t"), F.col("refs"))).first()[0]
    assert text.endswith("and [MANUAL POLICY LOOKUP REQUIRED: X 1]")
    assert text.count("MANUAL POLICY LOOKUP REQUIRED") >= 3
    assert df.select(masked(F.col("t"), F.array().cast("array<string>"))).first()[0] == "Rule 12 and Rule 1 and [X 1]"


def test_nearest_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    rows = retrieval.nearest_vectors(corpus, F.array(F.lit(2.0), F.lit(0.0)), 3).collect()
    assert [(r.vec_id, r.cosine) for r in rows] == [(1, 1.0), (3, round(math.sqrt(0.5), 6)), (2, 0.0)]
    assert retrieval.centroid(corpus).first().vector == [0.75, 1.25]
