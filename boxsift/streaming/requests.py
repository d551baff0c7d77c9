"""JSON requests as a stream, evaluated batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from boxsift.plans.evaluate import evaluate_requests
from boxsift.rules import RuleSet
from boxsift.sources.boxes import REQUEST, keyed


def evaluate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: RuleSet | None = None, **trigger) -> StreamingQuery:
    """Evaluate the JSON files that arrive in folder and append a document row for each request to out, as Parquet.

    Each request gets a request_key of its own; the keyed requests of a batch are written below checkpoint. A line that
    does not parse counts as a request without text.
    """
    rules = rules or RuleSet()
    requests = spark.readStream.schema(REQUEST).json(folder)

    def judge(batch: DataFrame, number: int) -> None:
        requests = keyed(batch, f"{checkpoint}/requests/batch={number}")
        evaluate_requests(requests, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same again if retried

    return requests.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
