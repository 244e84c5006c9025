from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from landfall.operators.landing import daily_with_company
from landfall.sources.generator import LedgerConfig, generate
from landfall.streaming import refresh


def _rows(df):
    return sorted(tuple(r) for r in df.select("department", "order_date", "amount", "orders", "customers").collect())


def test_stream_equals_batch_with_late_lines_and_reruns(spark, tmp_path):
    fact = generate(spark, LedgerConfig(date(2023, 1, 1), date(2023, 5, 31), 20, 2), 7).transactions.persist()
    source, store, daily = (str(tmp_path / n) for n in ("in", "ledger", "daily"))
    late = F.pmod(F.xxhash64("order_no", "line_no"), F.lit(10)) == 0

    def arrive(rows):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(fact.schema).parquet(source)
        query = refresh.start(stream, store, daily, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    arrive(fact.filter((F.col("order_date") < date(2023, 4, 1)) & ~late))
    assert _rows(spark.read.parquet(daily)) == _rows(daily_with_company(fact.filter((F.col("order_date") < date(2023, 4, 1)) & ~late)))
    arrive(fact.filter((F.col("order_date") >= date(2023, 4, 1)) | late))
    assert _rows(spark.read.parquet(daily)) == _rows(daily_with_company(fact))

    again = fact.filter((F.col("order_date") >= date(2023, 4, 1)) | late)
    refresh.refresh(store, daily)(again, 1)
    assert _rows(spark.read.parquet(daily)) == _rows(daily_with_company(fact))
