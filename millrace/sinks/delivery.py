"""Deliver requests and record the outcome of each.

The transport is any picklable callable ``transport(request, payload)`` that
returns ``(status, body)`` and raises on I/O errors.  A failed batch is dropped
by default: its outcome row says so and the others go on.

Delivery is a side effect.  Evaluating :func:`send` twice sends twice, so jobs
go through :func:`deliver`, which sends while writing the outcome table, notes
each response in a journal at once, and skips requests that an earlier,
interrupted run or task has already sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.encoding import parsed_json
from millrace.session import drop_folder, folder_names
from millrace.sinks.journal import Journal

Transport = Callable[[dict[str, Any], str], tuple[int, str]]

# Failure texts of the two POST destinations.
BULK_ERRORS = "Elasticsearch bulk request contained errors"
BULK_NOT_JSON = "Elasticsearch response is not valid JSON"

_SENT = (
    "request_id string, route_id bigint, batch_id bigint, part bigint, n_entries bigint, "
    "type string, url string, status int, body string, io_error string"
)
_KEYS = ["request_id", "route_id", "batch_id", "part", "n_entries", "type", "url"]


def send(requests: DataFrame, transport: Transport, journal: Journal | None = None) -> DataFrame:
    """Send every request; returns the raw response per request.

    The payloads of a request go out in order and the first I/O error abandons
    the rest of them.  A transport that has ``close`` is closed with its task.
    With a journal, a repeated task returns what it has noted and sends the rest.
    """

    def send_one(request: dict[str, Any]) -> tuple:
        status, body = None, None
        try:
            for payload in request["payloads"]:
                status, body = transport(request, payload)
        except Exception as problem:  # noqa: BLE001 - any failure becomes an outcome
            return None, None, f"{type(problem).__name__}: {problem}"
        return status, body, None

    def send_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notes = None if journal is None else journal.open()

        def sent_once(request: dict[str, Any]) -> tuple:
            if notes is None:
                return send_one(request)
            noted = notes.known.get(request["request_id"])
            if noted is not None:
                return noted["status"], noted["body"], noted["io_error"]
            answer = send_one(request)
            notes.add(request, *answer)
            return answer

        for pdf in frames:
            rows = pdf.to_dict("records")
            for row in rows:
                row["headers"] = dict(row["headers"])
            answers = pd.DataFrame(
                [sent_once(row) for row in rows], columns=["status", "body", "io_error"]
            ).astype({"status": "Int32"})
            yield pd.concat([pdf[_KEYS].reset_index(drop=True), answers], axis=1)
        getattr(transport, "close", lambda: None)()
        if notes is not None:
            notes.close()

    return requests.mapInPandas(send_all, _SENT)


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def bulk_problem(body: Column) -> Column:
    """Why an accepted bulk response still means failure, else NULL.

    The body must be JSON, and its ``errors`` member must not be the boolean
    true; a missing member or any other value is no error.
    """
    parsed = parsed_json(body)
    flag = F.try_variant_get(parsed, "$.errors", "variant")
    flagged = (F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(
        parsed, "$.errors", "boolean"
    )
    return F.when(parsed.isNull(), F.lit(BULK_NOT_JSON)).when(
        F.coalesce(flagged, F.lit(False)), F.lit(BULK_ERRORS)
    )


def check_bulk_response(responses: DataFrame) -> DataFrame:
    """Add ``ok`` and ``error`` to responses ``(status, body, …)`` of bulk requests."""
    error = F.when(
        ~is_success(F.col("status")),
        F.concat(F.lit("Elasticsearch HTTP "), F.col("status").cast("string"), F.lit(": "), "body"),
    ).otherwise(bulk_problem(F.col("body")))
    return responses.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def settle(sent: DataFrame, on_failure: str = "drop") -> DataFrame:
    """Judge responses: ``(request_id, …, ok, status, error)``.

    ``on_failure='drop'`` records failures; ``'fail'`` fails the job instead,
    so that Spark repeats the work and delivery becomes at-least-once.
    """
    if on_failure not in ("drop", "fail"):
        raise ValueError("on_failure must be 'drop' or 'fail'")
    status, body = F.col("status"), F.coalesce("body", F.lit("<no body>"))
    refused = ~is_success(status)
    code = F.coalesce(status.cast("string"), F.lit("error"))
    http_error = F.when(
        refused, F.concat(F.lit("HTTP "), code, F.lit(" from "), "url", F.lit(": "), body)
    )
    bulk_error = F.when(
        refused, F.concat(F.lit("Elasticsearch HTTP "), code, F.lit(": "), body)
    ).otherwise(bulk_problem(F.col("body")))
    error = F.coalesce(
        "io_error",
        F.when(F.col("type") == "http", http_error).when(
            F.col("type") == "elasticsearch", bulk_error
        ),
    )
    outcomes = sent.withColumn("error", error).select(
        "request_id",
        "route_id",
        "batch_id",
        "part",
        "n_entries",
        F.col("error").isNull().alias("ok"),
        "status",
        "error",
    )
    if on_failure == "drop":
        return outcomes
    return outcomes.withColumn(
        "ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    )


def deliver(
    spark: SparkSession,
    requests: DataFrame,
    transport: Transport,
    outcomes_path: str,
    on_failure: str = "drop",
    groups: int = 1,
    ordered: bool = False,
    journal: bool = True,
    sending_tasks: int | None = None,
) -> DataFrame:
    """Send the requests and write their outcomes to ``outcomes_path``.

    Requests with an outcome there are not sent again, so an interrupted job can
    be repeated.  Tasks note each response in :func:`journal_path` as it comes,
    and a repeated job first settles what it finds there.  Where tasks
    cannot write to that store, or without ``journal``, outcomes are durable by
    ``groups``: those of a group are stored before the next one starts.  With ``on_failure="fail"`` all outcomes
    are stored before the job fails, and a repeated job sends again only what
    has not succeeded.  ``ordered`` sends the batches of a route one after the
    other, each route in one task.  No more than ``sending_tasks`` tasks send at
    a time.  Speculative task copies would send twice and are refused.
    """
    if on_failure not in ("drop", "fail"):
        raise ValueError("on_failure must be 'drop' or 'fail'")
    if spark.conf.get("spark.speculation", "false").lower() == "true":
        raise RuntimeError("switch spark.speculation off for delivery jobs")
    notes = journal_path(outcomes_path)
    _settle_journal(spark, notes, outcomes_path)
    keep = Journal.at(spark, notes) if journal else None
    settled = _existing(spark, outcomes_path)
    if settled is not None and on_failure == "fail":
        settled = settled.filter("ok")
    if settled is not None:
        requests = requests.join(settled.select("request_id"), "request_id", "left_anti")
    spread = F.pmod(F.xxhash64("route_id" if ordered else "request_id"), F.lit(groups))
    for group in range(groups):
        part = requests if groups == 1 else requests.filter(spread == group)
        if ordered:
            order = ("route_id", "batch_id", "part")
            spread_by_route = (
                part.repartition("route_id")
                if sending_tasks is None
                else part.repartition(sending_tasks, "route_id")
            )
            part = spread_by_route.sortWithinPartitions(*order)
        elif sending_tasks is not None:
            part = part.coalesce(sending_tasks)
        settle(send(part, transport, keep)).write.mode("append").parquet(outcomes_path)
    drop_folder(spark, notes)
    outcomes = spark.read.parquet(outcomes_path)
    if on_failure == "drop":
        return outcomes
    # A request that was repeated counts by its success.
    latest = F.max_by(F.struct("*"), F.col("ok")).alias("latest")
    outcomes = outcomes.groupBy("request_id").agg(latest).select("latest.*")
    failed = outcomes.filter(~F.col("ok")).select("request_id", "error").take(1)
    if failed:
        raise RuntimeError(f"request {failed[0]['request_id']}: {failed[0]['error']}")
    return outcomes


def journal_path(outcomes_path: str) -> str:
    """Beside the outcomes and hidden from their readers."""
    folder, _, name = outcomes_path.rstrip("/").rpartition("/")
    return f"{folder}/_journal-{name}"


def _settle_journal(spark: SparkSession, notes: str, outcomes_path: str) -> None:
    """Outcomes of what an interrupted run has sent, from its journals."""
    if not folder_names(spark, notes):
        return
    # A line that was cut short has no request.
    sent = spark.read.schema(_SENT).json(notes).filter("request_id is not null")
    settled = _existing(spark, outcomes_path)
    if settled is not None:
        sent = sent.join(settled.select("request_id"), "request_id", "left_anti")
    settle(sent.dropDuplicates(["request_id"])).write.mode("append").parquet(outcomes_path)
    drop_folder(spark, notes)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as problem:  # noqa: BLE001 - only a missing table is expected
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise
