"""Golden rows at and around every threshold."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions.numeric import half_up
from claimloom.functions.texts import service_date
from claimloom.operators import adjudicate, attribution, risk, rules


def column(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.withColumn("o", expression).orderBy("i").select("o").collect()]


def test_half_up(spark):
    out = column(spark, [(2.5,), (-2.5,), (-0.0,), (0.125,), (None,)], "x double", half_up(F.col("x"), 0))
    assert out == [3.0, -3.0, 0.0, 0.0, None]
    assert str(out[2]) == "0.0"


@pytest.mark.parametrize(
    ("billed", "verdict"),
    [
        (None, "AUTO_REJECT_MISSING"), (0.0, "AUTO_REJECT_MISSING"), (175.01, "AUTO_REJECT_HIGH"), (175.0, "CONDITIONAL"), (125.01, "CONDITIONAL"),
        (125.0, "FLAG_HIGH_WARN"), (115.01, "FLAG_HIGH_WARN"), (115.0, "ACCEPT"), (85.0, "ACCEPT"), (84.99, "FLAG_LOW_WARN"), (75.0, "FLAG_LOW_WARN"),
        (74.99, "FLAG_LOW"), (50.0, "FLAG_LOW"), (49.99, "FLAG_VERY_LOW"), (-1.0, "FLAG_VERY_LOW"),
    ],
)
def test_billing_verdict(spark, billed, verdict):
    assert column(spark, [(billed, 100.0)], "billed_amount double, expected double", rules.billing_verdict()) == [verdict]


def test_outcome_ladder(spark):
    cases = [
        (("APPROVED", 0.19, "ACCEPT"), "APPROVED"), (("APPROVED", 0.20, "ACCEPT"), "APPROVED_WITH_WARNING"), (("APPROVED", 0.35, "ACCEPT"), "MANUAL_REVIEW"),
        (("APPROVED", 0.01, "CONDITIONAL"), "MANUAL_REVIEW"), (("APPROVED", 0.01, "FLAG_LOW"), "APPROVED_WITH_WARNING"),
        (("DENIED", 0.64, "ACCEPT"), "MANUAL_REVIEW"), (("DENIED", 0.65, "ACCEPT"), "AT_RISK"), (("DENIED", 0.80, "ACCEPT"), "HOLD_FOR_CORRECTION"),
    ]
    out = column(spark, [c for c, _ in cases], "predicted_status string, denial_prob double, billing_verdict string", adjudicate.granular_outcome())
    assert out == [o for _, o in cases]


def test_score_and_probability_tiers(spark):
    assert column(spark, [(i,) for i in range(8)], "s int", risk.score_tier(F.col("s"))) == ["None", "Low", "Low", "Medium", "Medium", "High", "High", "Critical"]
    assert column(spark, [(i,) for i in range(8)], "p int", risk.points_probability(F.col("p"))) == [0.05, 0.20, 0.40, 0.65, 0.78, 0.88, 0.95, 0.95]
    assert column(spark, [(0.8,), (0.79,), (0.55,), (0.54,), (0.35,), (0.34,)], "p double", attribution.risk_level(F.col("p"))) == [
        "CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_calibration(spark):
    assert column(spark, [(1.0,), (0.5,), (0.4,), (0.0,)], "p double", attribution.calibrated_denial(F.col("p"))) == [0.0, 0.25, 0.8, 1.0]


def test_service_dates(spark):
    texts = ["2024-01-31", "31/12/2024", "12-31-2024", "1.2.2024", "2024-13-01", "01/02/24", "", None]
    out = column(spark, [(t,) for t in texts], "t string", service_date(F.col("t")).cast("string"))
    assert out == ["2024-01-31", "2024-12-31", "2024-12-31", "2024-02-01", None, None, None, None]
