"""Daily refresh of the roll-up from a stream of order lines.

Lines are kept in a ledger partitioned by month and batch; a batch overwrites its own partitions, so a batch
that runs twice counts once. The months that a batch touches are rolled up anew from the ledger and replaced.
Distinct counts stay exact and late lines count, however late; only the months touched are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.landing import daily_with_company

_REPLACE = {"partitionOverwriteMode": "dynamic"}


def refresh(ledger_path: str, daily_path: str) -> Callable[[DataFrame, int], None]:
    """The work of one batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        month = F.year("order_date") * 100 + F.month("order_date")
        kept = batch.filter("order_date is not null").withColumns({"sales_month": month, "batch": F.lit(batch_id).cast("bigint")})
        kept.write.options(**_REPLACE).mode("overwrite").partitionBy("sales_month", "batch").parquet(ledger_path)
        spark = batch.sparkSession
        whole = spark.read.schema(kept.schema).parquet(ledger_path)
        touched = whole.filter(F.col("batch") == batch_id).select("sales_month").distinct()
        months = whole.join(F.broadcast(touched), "sales_month", "left_semi")  # a row a month
        daily = daily_with_company(months).withColumn("sales_month", month)
        daily.write.options(**_REPLACE).mode("overwrite").partitionBy("sales_month").parquet(daily_path)

    return run


def start(stream: DataFrame, ledger_path: str, daily_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Refreshes daily_path from a streaming frame of order lines; available_now stops after what is there."""
    writer = stream.writeStream.foreachBatch(refresh(ledger_path, daily_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
