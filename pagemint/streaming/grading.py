"""Grading as predictions arrive: a file stream of predictions, each micro-batch graded and appended by page.

An extension: a run resumes because files already graded are in the stream's checkpoint; so are the ids of pages already
graded, as the state of the stream, so a page that is delivered twice is graded once and the sink is never read. Each
micro-batch has its own folder in the sink and replaces it, so a batch that is run again leaves no line twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemint.operators.grade import grade

PREDICTIONS = "page_id string, html string, blocks array<struct<label:string,bbox:array<double>,text:string>>"


def grade_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, tests: DataFrame, pages: DataFrame):
    """Start a query that grades JSON prediction lines under ``source`` into Parquet under ``sink``, as far as there are any."""

    def one(batch: DataFrame, number: int) -> None:
        mine = tests.join(batch.select("page_id"), "page_id", "left_semi")
        grade(mine, batch, pages).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(PREDICTIONS).json(source).dropDuplicates(["page_id"])
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
