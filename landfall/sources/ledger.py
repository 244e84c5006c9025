"""The sales ledger: the driver's star schema seen as order lines, and CSV files in and out.

Money is kept in exact integers (1e-4 units), so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import folder

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")
#: Order lines that meet their orders in one task.
LINES_A_TASK = 200_000

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("order_no", T.StringType()), ("line_no", T.LongType()), ("order_date", T.DateType()), ("customer_code", T.StringType()), ("customer_name", T.StringType()),
            ("customer_area", T.StringType()), ("branch", T.StringType()), ("department", T.StringType()), ("sales_rep", T.StringType()), ("product", T.StringType()),
            ("category", T.StringType()), ("quantity", T.LongType()), ("list_price", T.LongType()), ("discount", T.DoubleType()), ("unit_price", T.LongType()),
            ("amount", T.LongType()), ("unit_cost", T.LongType()), ("cost", T.LongType()), ("profit", T.LongType()),
        )
    ]
)
LABEL_SCHEMA = T.StructType([T.StructField("order_no", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())])


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """KeyError for columns that df lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def _cents(column: Column) -> Column:
    return F.round(column * 100).cast("bigint")


def split_finely(spark: SparkSession, path: str, parts: int) -> None:
    """From here on the session reads no more of a file in one task than one of so many parts of the table at path, or one row group.

    A shuffle to more partitions than Spark writes one file each for holds what its task has read in memory.
    """
    system, place = folder(spark, path)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(now, max(1 << 20, system.getContentSummary(place).getLength() // parts))))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line; lines of returned and finished orders are negative.

    Dimensions are joined on their keys and left to the optimizer, which broadcasts what is small. Where the
    cores alone would leave a task more than LINES_A_TASK lines, they are read in as many parts and dealt to more
    tasks by order; customers then meet the orders, not the lines, and large dimensions are joined in as many
    tasks, since what Spark deals out by itself goes to a fixed number of partitions.
    """
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    parts = -(-t["lineitem"].count() // LINES_A_TASK)
    many = parts > spark.sparkContext.defaultParallelism
    if many:
        split_finely(spark, f"{sf_dir}/lineitem.parquet", parts)
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))  # fewer would be dealt anew to so many
        t["lineitem"] = t["lineitem"].repartition(parts, "l_orderkey")

    def joined_to(rows: DataFrame, name: str, key: str, own: str) -> DataFrame:
        """rows with a dimension; one of more than LINES_A_TASK rows is dealt out with the rows by its key."""
        if not many or t[name].count() <= LINES_A_TASK:
            return rows.join(t[name], F.col(key) == F.col(own))
        return rows.repartition(parts, key).join(t[name].repartition(parts, own).hint("merge"), F.col(key) == F.col(own))

    numbered = t["lineitem"].withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in t["lineitem"].columns if c != "l_orderkey"])).cast("bigint"))
    placed = (
        joined_to(t["orders"], "customer", "o_custkey", "c_custkey")
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    if many:
        placed = placed.repartition(parts, "o_orderkey")
    joined = joined_to(numbered.join(placed, F.col("l_orderkey") == F.col("o_orderkey")), "part", "l_partkey", "p_partkey")
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), -1).otherwise(1).cast("bigint")
    quantity = sign * F.col("l_quantity").cast("bigint")
    amount = sign * _cents(F.col("l_extendedprice")) * (100 - _cents(F.col("l_discount")))
    return joined.select(
        F.col("l_orderkey").alias("order_no"), "line_no", F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_custkey").alias("customer_code"),
        F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("customer_area"), F.col("r_name").alias("department"), F.col("n_name").alias("sales_rep"),
        F.col("p_type").alias("product"), F.col("p_brand").alias("category"), quantity.alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        amount.alias("amount"), (quantity * _cents(F.col("p_retailprice")) * 100).alias("cost"),
    ).withColumn("profit", F.col("amount") - F.col("cost"))


def anomaly_labels(fact: DataFrame) -> DataFrame:
    """order_no, line_no, kind: one row for each rule that a line meets."""
    rules = F.array(
        F.when(F.abs("quantity") == 50, F.lit("quantity_typo")),
        F.when((F.col("discount") == 0.10) & (F.col("tax") == 0.08), F.lit("discount_error")),
        F.when((F.col("quantity") < 0) & (F.dayofmonth("order_date") >= 25), F.lit("push_sale")),
    )
    return fact.select("order_no", "line_no", F.explode(F.array_compact(rules)).alias("kind"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, force: bool = False, one_file: bool = False) -> None:
    """Without force an existing target is an error."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def sniff_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), separators: tuple[str, ...] = (",", "\t", ";")) -> DataFrame:
    """The first reading with more than one column; types are inferred from the rows."""
    for encoding in encodings:
        for separator in separators:
            options = {"header": True, "sep": separator, "encoding": encoding}
            if len(spark.read.options(**options).csv(path).columns) > 1:
                return spark.read.options(**options, inferSchema=True, samplingRatio=1.0).csv(path)
    raise ValueError(f"no separator gives several columns in {path}")


def first_months(df: DataFrame, months: int = 3, date: str = "order_date") -> DataFrame:
    """The rows of the first calendar months of the table."""
    start = df.agg(F.add_months(F.trunc(F.min(date), "MM"), months).alias("_until"))
    return df.join(F.broadcast(start), F.col(date) < F.col("_until")).drop("_until")
