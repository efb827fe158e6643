"""Systems that read pages, as a pluggable stage: ask each page once, keep the raw answers, derive outputs from them.

A system states the requests that answer a page's wanted outputs, sends one, and parses its raw answer; only ``send`` touches
the network. ``ask`` runs the requests of pages that have no record yet, in Arrow batches on the executors, and appends records;
``outputs`` parses records into predictions, so reading them again is one projection and costs no call.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemint.session import shared_folder

from pagemint.sources.dataset import BLOCK


class SystemFailed(Exception):
    """The system's fault: the page fails with cause ``system``; ``transient`` failures are tried again."""

    def __init__(self, message: str, transient: bool = False):
        super().__init__(message)
        self.transient = transient


@dataclass(frozen=True)
class Request:
    outputs: tuple[str, ...]
    sent: dict = field(default_factory=dict, hash=False)


class System(ABC):
    """One system; instances travel to executors, so they hold settings, not connections."""

    name = "system"
    supports = ("html", "blocks", "markdown")

    def requests(self, wants: list[str]) -> list[Request]:
        known = tuple(w for w in wants if w in self.supports)
        return [Request(known)] if known else []

    @abstractmethod
    def send(self, page: bytes, request: Request, timeout: float) -> dict:
        """The raw answer; raises SystemFailed."""

    @abstractmethod
    def parse(self, raw: dict, request: Request) -> dict:
        """Outputs (html, blocks) of a raw answer; raises SystemFailed where it holds none."""


RECORDS = "page_id string, raw string, error string, seconds double, tries int"


def load(path: str) -> System:
    """A system by ``module:Class``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)()


def answer(system: System, page: bytes, wants: list[str], timeout: float, tries: int, wait: float) -> tuple[str | None, str | None, float, int]:
    """A page's raw answers as JSON, or an error, within one time budget for all its requests and tries."""
    began, made, raw = time.monotonic(), 0, []
    for request in system.requests(wants):
        for attempt in range(tries):
            left = timeout - (time.monotonic() - began)
            if left <= 0:
                return None, f"no answer within {timeout:g} s", time.monotonic() - began, made
            made += 1
            try:
                raw.append({"outputs": request.outputs, "sent": request.sent, "raw": system.send(page, request, left)})
                break
            except SystemFailed as e:
                if not e.transient or attempt + 1 == tries:
                    return None, str(e), time.monotonic() - began, made
                time.sleep(min(wait * 2**attempt, max(0.0, left)))
    return json.dumps(raw), None, time.monotonic() - began, made


def held(spark: SparkSession, records: str) -> DataFrame:
    try:
        return spark.read.schema(RECORDS).parquet(records)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORDS)


def ask(pages: DataFrame, system: System, records: str, timeout: float = 900.0, tries: int = 4, wait: float = 1.0, workers: int = 8, batch: int = 256, retry_failed: bool = False) -> int:
    """Ask about pages (page_id, content, outputs) without a record under ``records``; returns how many were left to ask.

    ``workers`` partitions ask at once, whatever the number of pages: the bound is the system's, not the cluster's. Answers
    are stored for some ``batch`` pages at a time, so a run that is lost loses the answers of one group at most.
    """
    spark = pages.sparkSession
    known = held(spark, records)
    known = known.where("error is null") if retry_failed else known
    asked = pages.select("page_id").join(known.select("page_id"), "page_id", "left_anti")
    path = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    n = asked.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, content, wants in zip(*(batch.column(c).to_pylist() for c in ("page_id", "content", "outputs"))):
                raw, error, seconds, made = answer(system, content, wants, timeout, tries, wait)
                yield pa.RecordBatch.from_pylist(
                    [{"page_id": page_id, "raw": raw, "error": error, "seconds": seconds, "tries": made}],
                    pa.schema([("page_id", pa.string()), ("raw", pa.string()), ("error", pa.string()), ("seconds", pa.float64()), ("tries", pa.int32())]),
                )

    groups = -(-n // batch)
    group = F.pmod(F.xxhash64("page_id"), F.lit(max(1, groups)))
    for g in range(groups):
        # what earlier groups stored is left out by the group, not by what the folder holds now
        some = pages.join(asked, "page_id", "left_semi").where(group == g)
        some.select("page_id", "content", "outputs").repartition(workers).mapInArrow(run, RECORDS).write.mode("append").parquet(records)
    return n


def settled(records: DataFrame) -> DataFrame:
    """One record for each page: an answer rather than an error."""
    own = [c for c in records.columns if c != "page_id"]
    best = F.min_by(F.struct(*own), F.struct(F.col("error").isNotNull(), "seconds", "raw"))
    return records.groupBy("page_id").agg(best.alias("best")).select("page_id", "best.*")


def outputs(records: DataFrame, system: System) -> DataFrame:
    """Predictions (page_id, html, blocks, error) of records; error is the cause a report counts: system or unusable."""

    def one(raw: str | None, error: str | None) -> dict:
        if error is not None or raw is None:
            return {"html": None, "blocks": None, "error": "system"}
        found: dict = {}
        try:
            for part in json.loads(raw):
                found |= system.parse(part["raw"], Request(tuple(part["outputs"]), part["sent"]))
        except SystemFailed:
            return {"html": None, "blocks": None, "error": "unusable"}
        return {"html": found.get("html"), "blocks": found.get("blocks"), "error": None}

    kind = pa.list_(pa.struct([("label", pa.string()), ("bbox", pa.list_(pa.float64())), ("text", pa.string())]))
    schema = pa.schema([("page_id", pa.string()), ("html", pa.string()), ("blocks", kind), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "raw", "error")))
            yield pa.RecordBatch.from_pylist([{"page_id": p, **one(r, e)} for p, r, e in rows], schema)

    return records.select("page_id", "raw", "error").mapInArrow(run, f"page_id string, html string, blocks {BLOCK}, error string")


def latency(records: DataFrame) -> DataFrame:
    """One row: pages, failed, median and tail seconds of the answers."""
    of = lambda q: F.percentile("seconds", F.lit(q))
    return records.agg(
        F.count("*").alias("pages"), F.count("error").alias("failed"), of(0.5).alias("p50"), of(0.9).alias("p90"), of(0.95).alias("p95"), F.max("seconds").alias("max")
    )
