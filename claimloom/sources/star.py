"""The claim star built from the given TPC-H-like tables.

Claims are order lines with codes and gaps derived from their keys; providers are
suppliers; benchmark costs are aggregated from the claims. Everything reads whole tables
and is lazy but for the provider, diagnosis and cost dimensions: Spark takes a join or an aggregate
for as large as the product of its inputs, rows from Python for as large as can be, and would
shuffle every claim to meet them, so all three are written once and joined by their measured size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import fixed_values as fixed
from claimloom.sources.scratch import written

UNIT = "decimal(18,2)"

CLAIM_COLUMNS = [
    "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code",
    "billed_amount", "claim_date", "policy_id",
]


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.col(value).cast("string")


def _provider_id(suppkey: str) -> Column:
    return F.concat(F.lit("PR"), F.lpad(_text(suppkey), 5, "0"))


def _billed() -> Column:
    price = F.col("l_extendedprice").cast(UNIT)
    return (
        F.when(F.expr("(l_orderkey + l_suppkey * 5) % 3 = 0"), F.lit(None).cast(UNIT))
        .when(F.expr("(l_orderkey + l_partkey) % 97 = 0"), (-price).cast(UNIT))
        .otherwise(price)
    )


def _procedure() -> Column:
    return F.when(
        F.expr("(l_orderkey + l_partkey * 3) % 4 <> 0"), F.concat(F.lit("PROC"), _text(F.col("l_partkey") % 60))
    )


def _row_key() -> Column:
    """A text that orders the copies of a claim id totally."""
    money = lambda c, w: F.lpad(_text(F.col(c).cast(UNIT)), w, "0")
    return F.concat_ws(
        "|",
        F.lpad(_text("l_partkey"), 12, "0"),
        F.lpad(_text("l_suppkey"), 10, "0"),
        money("l_extendedprice", 16),
        _text(F.col("l_shipdate").cast("date")),
        money("l_quantity", 8),
        money("l_discount", 5),
        money("l_tax", 5),
        F.col("l_returnflag"),
        F.col("l_linestatus"),
    )


@dataclass(frozen=True)
class ClaimStar:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def claims(self) -> DataFrame:
        """One row per submitted claim line, claim ids repeat; gaps are NULL."""
        return claims_from_lines(self.lines, self.table("orders"))

    @cached_property
    def providers(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_name")
        rows = (
            self.table("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                _provider_id("s_suppkey").alias("provider_id"),
                F.col("s_name").alias("doctor_name"),
                F.element_at(
                    F.array(F.lit("Cardiology"), F.lit("General"), F.lit("Neurology"), F.lit("Orthopedic"),
                            F.lit(None).cast("string")),
                    (F.col("s_suppkey") % 5 + 1).cast("int"),
                ).alias("specialty"),
                F.when(F.col("s_suppkey") % 6 != 0, F.col("n_name")).alias("location"),
            )
        )
        return written(rows, "providers")

    @cached_property
    def diagnosis(self) -> DataFrame:
        rows = self.spark.createDataFrame(fixed.DIAGNOSIS_ROWS, "diagnosis_code string, category string, severity string")
        return written(rows.coalesce(1), "diagnosis")

    @cached_property
    def cost(self) -> DataFrame:
        """Benchmarks per procedure: mean billed amount of its lines, never more than 58 rows."""
        return written(cost_from_lines(self.lines, self.table("region")), "cost")

    @cached_property
    def policies(self) -> DataFrame:
        number = F.col("n")
        covered = F.array_join(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(59)), lambda p: p % 6 != number),
                lambda p: F.concat(F.lit("PROC"), p.cast("string")),
            ),
            ", ",
        )
        return self.spark.range(6).select(F.col("id").cast("int").alias("n")).select(
            F.concat(F.lit("POL"), F.lpad(_text(number + 1), 3, "0")).alias("policy_id"),
            F.concat(F.lit("Plan "), _text(number + 1)).alias("policy_name"),
            covered.alias("procedures_covered"),
            F.date_add(F.to_date(F.lit("1995-06-01")), number * 90).alias("policy_start_date"),
            F.when(number % 2 == 1, F.to_date(F.lit("2001-01-31"))).alias("policy_end_date"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Claims of finished orders, as an append-only log of earlier submissions."""
        return self.claims.where(F.col("order_status") == "F").select(
            *CLAIM_COLUMNS, "row_key", "submitted_at", "submitted_by"
        )

    @cached_property
    def batch(self) -> DataFrame:
        """All claims sent again: returned lines carry one unit more, untaxed accepted
        lines come under a new claim id."""
        return self.claims.select(
            F.when((F.col("return_flag") == "A") & (F.col("tax") == 0), F.regexp_replace("claim_id", "^C", "C9"))
            .otherwise(F.col("claim_id")).alias("claim_id"),
            "patient_id", "provider_id", "diagnosis_code", "procedure_code",
            F.when(F.col("return_flag") == "R", (F.col("billed_amount") + 1).cast(UNIT))
            .otherwise(F.col("billed_amount")).alias("billed_amount"),
            F.col("claim_date").cast("string").alias("service_date"),
            "policy_id",
            F.concat_ws("|", F.col("claim_id"), F.col("row_key")).alias("row_key"),
        )


def claims_from_lines(lineitem: DataFrame, orders: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    order_part = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return lineitem.join(order_part, F.col("l_orderkey") == F.col("o_orderkey"), "inner").select(
        F.concat(F.lit("C"), F.lpad(_text(F.col("l_orderkey") * 10 + F.col("l_linenumber")), 8, "0")).alias("claim_id"),
        F.concat(F.lit("P"), F.lpad(_text("o_custkey"), 6, "0")).alias("patient_id"),
        F.when(F.expr("(l_orderkey * 3 + l_linenumber) % 29 <> 0"), _provider_id("l_suppkey")).alias("provider_id"),
        F.when(
            F.expr("(l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 10 >= 3"),
            F.concat(F.lit("D"), _text((F.col("o_custkey") % 7 + 1) * 10)),
        ).alias("diagnosis_code"),
        _procedure().alias("procedure_code"),
        _billed().alias("billed_amount"),
        F.when(F.col("l_orderkey") % 53 != 0, F.col("l_shipdate").cast("date")).alias("claim_date"),
        F.concat(F.lit("POL"), F.lpad(_text(F.col("o_custkey") % 8 + 1), 3, "0")).alias("policy_id"),
        _row_key().alias("row_key"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_tax").cast(UNIT).alias("tax"),
        (
            F.col("o_orderdate").cast("timestamp_ntz")
            + F.make_dt_interval(secs=F.expr("cast((l_orderkey * 7 + l_linenumber) % 86400 as decimal(18,6))"))
        ).alias("submitted_at"),
        F.concat(F.lit("agent"), _text(F.col("o_custkey") % 7), F.lit("@example.com")).alias("submitted_by"),
        *carry,
    )


def cost_from_lines(lineitem: DataFrame, region: DataFrame) -> DataFrame:
    number = F.regexp_extract("procedure_code", r"(\d+)$", 1).cast("int")
    benchmark = (
        lineitem.select(_procedure().alias("procedure_code"), _billed().alias("billed"), (F.col("l_partkey") % 60).alias("n"))
        .where(F.col("procedure_code").isNotNull() & (F.col("billed") >= 0) & (F.col("n") < 58))
        .groupBy("procedure_code")
        # Scale 15 keeps the one rounding to cents exact.
        .agg((F.sum("billed").cast("decimal(24,2)") / F.count("billed").cast("decimal(12,0)")).cast(UNIT).alias("average_cost"))
    )
    regions = region.select(F.col("r_regionkey"), F.col("r_name").alias("region"))
    return benchmark.join(regions, number % 5 == F.col("r_regionkey"), "left").select(
        "procedure_code",
        "average_cost",
        F.when(number % 11 != 0, F.col("average_cost")).alias("expected_cost"),
        "region",
    )
