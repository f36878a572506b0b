"""How the driver's tables play the roles of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.operators.panel import PanelSpec
from panelfx.operators.tokenstats import sequence_statistics, token_statistics

ORDERS = PanelSpec(unit="unit", time="t", cohort="g", target="y")
SEGMENTS = PanelSpec(unit="unit", time="t", cohort="g", target="y", by=("model_size",))
SEGMENT_ORDER = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_index(date: Column) -> Column:
    return ((F.year(date) - 1995) * 4 + F.quarter(date)).cast("bigint")


def orders_panel(spark: SparkSession, sf_dir: str, segments: bool = False) -> DataFrame:
    """Customer x quarter spend in 7,919s (a large prime keeps rounding free of ties); cohort = quarter of the first urgent order.

    Orders are added up per customer and quarter before anything is gathered per customer, so a
    customer's group has at most one entry per quarter.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("unit"),
        quarter_index(F.col("o_orderdate")).alias("t"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("p"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    spend = orders.groupBy("unit", "t").agg(
        (F.sum("p").cast("double") / 7919).alias("y"), F.bool_or("urgent").alias("urgent")
    )
    units = spend.groupBy("unit").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("ys"),
        F.min(F.when(F.col("urgent"), F.col("t"))).alias("g"),
    )
    if segments:
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("model_size")
        )
        units = units.join(customer, "unit")
    ends = orders.agg(F.struct(F.min("t").alias("first"), F.max("t").alias("last"))).scalar()
    kept = ["unit", "g", *(["model_size"] if segments else [])]
    quarters = F.explode(F.sequence(ends["first"], ends["last"]))
    spend_then = F.coalesce(F.try_element_at("ys", F.col("t")), F.lit(0.0))
    return units.select(*kept, "ys", quarters.alias("t")).select(*kept, "t", spend_then.alias("y"))


def numbered_panel(spark: SparkSession, sf_dir: str, sizes: dict[str, float]) -> DataFrame:
    """Customer x quarter spend as an exported panel: customers are numbered units, every fifth a control (below zero).

    Each size has the same units; its accuracy is the spend times the size's factor.
    """
    panel = orders_panel(spark, sf_dir)
    unit = F.when(F.col("unit") % 5 == 0, -F.col("unit")).otherwise(F.col("unit"))
    size = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("factor")) for n, f in sizes.items()]))
    rows = panel.select(unit.alias("seq_idx"), F.col("t").cast("int").alias("step"), "y", size.alias("size"))
    none = F.lit(0.0)
    return rows.select(
        "seq_idx", "step", none.alias("sup_seq"), none.alias("entr_seq"), (F.col("y") * F.col("size.factor")).alias("acc_seq"),
        none.alias("avg_rank"), F.col("size.name").alias("model_size"),
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x day summed values in parts of a large prime, days without events left out: an unbalanced panel.

    Cohort = day of the user's first purchase above 100, if any.
    """
    daily = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("unit"),
            F.dayofmonth("ts").cast("bigint").alias("t"),
            F.col("value").cast("decimal(18,2)").alias("v"),
            ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("bought"),
        )
        .groupBy("unit", "t")
        .agg((F.sum("v").cast("double") * 1000 / 7919).alias("y"), F.bool_or("bought").alias("bought"))
    )
    first = daily.groupBy("unit").agg(F.min(F.when(F.col("bought"), F.col("t"))).alias("g"))
    return daily.join(first, "unit").select("unit", "t", "g", "y")


def scored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a token's logits, its label the true token; ten vectors make a sequence."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_idx"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
        F.col("label").alias("target"),
    )


def raw_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_statistics(token_statistics(scored_tokens(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles (adding zero turns -0.0 into 0.0) so that summation order does not show."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles})
