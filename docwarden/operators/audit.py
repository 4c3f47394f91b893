"""Audit events: acceptance, phases per operation, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docwarden import vocab
from docwarden.functions import jsontree
from docwarden.functions.jsontree import sanitize_json, sanitize_text
from docwarden.functions.secrets import has_credential_value, is_sensitive_key
from docwarden.operators.checks import violations
from docwarden.session import materialize

TERMINAL_PHASES = ("completed", "failed", "cancelled", "timed_out", "uncertain")


def status_normalize(status: Column, operation_id: Column) -> Column:
    """Phase of a mutation response: pending states and a bare operation id are acknowledged."""
    return (
        F.when(
            status.isin(*vocab.PENDING_STATES) | status.isNull(),
            F.when(F.coalesce(operation_id != "", F.lit(False)), "acknowledged").otherwise(
                "uncertain"
            ),
        )
        .when(status.isin(*vocab.TERMINAL_STATES), status)
        .otherwise("uncertain")
    )


def poll_status(status: Column) -> Column:
    """Phase while polling: ``queued`` is not accepted there."""
    return (
        F.when(status.isin(*vocab.TERMINAL_STATES), status)
        .when(status.isin("pending", "processing"), "acknowledged")
        .otherwise("uncertain")
    )


def reject_secrets(events: DataFrame, *, key: str, json: str, family: str = "audit") -> DataFrame:
    """Violations of rows whose JSON holds a secret or body field or a credential, or that hold no
    JSON object; such text is looked through as plain text as well."""
    text, whole = F.col(json), jsontree.is_json_object(F.col(json))
    secret = jsontree.has_secrets(text, family) | (~whole & has_credential_value(text, family))
    reason = F.when(secret, "secret").when(~whole, "not_an_object")
    return events.select(key, reason.alias("violation")).filter("violation IS NOT NULL")


def secret_places(events: DataFrame, *, key: str, json: str, family: str = "audit") -> DataFrame:
    """Where the secrets of nested JSON lie: (key, place, rule) with the JSON path of every sensitive key
    (``sensitive_key``) and of every text that holds a credential (``credential_value``); ``not_an_object``
    at ``$`` for text that is no JSON object. Values are never returned.

    Members are unfolded a level at a time by ``variant_explode``; the containers among them are written
    as the next level, until there is none, so the depth has no limit but the parser's."""
    spark = events.sparkSession
    given = events.select(F.col(key), F.lit("$").alias("place"), F.col(json).alias("node"))
    whole = jsontree.is_json_object(F.col("node"))
    found = given.filter(~whole).select(key, "place", F.lit("not_an_object").alias("rule"))
    level = given.filter(whole)
    while True:
        level = materialize(level, "secret-level")
        if level.isEmpty():
            return found
        parsed = level.withColumn("node", F.try_parse_json("node"))
        members = spark.sql(f"SELECT l.`{key}`, l.place, e.pos, e.key AS _name, e.value FROM {{level}} l, LATERAL variant_explode(l.node) AS e", level=parsed)
        kind = F.schema_of_variant("value")
        step = F.when(F.col("_name").isNotNull(), F.concat(F.lit("."), "_name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        text = F.when(kind == "STRING", F.col("value").try_cast("string"))
        members = members.withColumns({"place": F.concat("place", step), "_text": text, "_kind": kind})
        rules = {
            "sensitive_key": F.col("_name").isNotNull() & is_sensitive_key(F.col("_name"), family),
            "credential_value": F.col("_text").isNotNull() & has_credential_value(F.col("_text"), family),
        }
        found = found.unionByName(violations(members, [key, "place"], rules).withColumnRenamed("violation", "rule"))
        inner = F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY")
        level = members.filter(inner).select(key, "place", F.to_json("value").alias("node"))


def accepted_events(events: DataFrame, *, json: str) -> DataFrame:
    """Rows that may be appended to the audit log."""
    return events.filter(jsontree.is_json_object(F.col(json)) & ~jsontree.has_secrets(F.col(json)))


def audit_lifecycle(events: DataFrame) -> DataFrame:
    """Phases of each operation in the order of their first occurrence.

    The vocabulary of phases is fixed, so the order is taken from one first time per phase. These
    are plain minimums and counts: an operation with very many events costs one row per task."""
    firsts = {p: F.min(F.when(F.col("phase") == p, F.col("ts"))) for p in vocab.PHASES}
    counted = events.groupBy("operation_id").agg(
        *[first.alias(f"_{p}") for p, first in firsts.items()],
        F.count("*").alias("events"),
        F.count_if(F.col("phase").isin(*TERMINAL_PHASES)).alias("terminal_events"),
    )
    listed = F.filter(
        F.array(
            *[
                F.struct(
                    F.col(f"_{p}").alias("ts"), F.lit(i).alias("rank"), F.lit(p).alias("phase")
                )
                for i, p in enumerate(vocab.PHASES)
            ]
        ),
        lambda x: x["ts"].isNotNull(),
    )
    phases = F.array_sort(listed)
    last_terminal = F.element_at(
        F.filter(phases, lambda x: x["phase"].isin(*TERMINAL_PHASES)), -1
    )
    counted = counted.withColumn("_phases", phases)
    return counted.select(
        "operation_id",
        F.array_join(F.transform("_phases", lambda x: x["phase"]), ">").alias("phase_order"),
        F.when(F.col("terminal_events") > 0, last_terminal["phase"])
        .otherwise("open")
        .alias("outcome"),
        "events",
        "terminal_events",
        F.col("_intended").isNotNull().alias("has_intent"),
    )


def lifecycle_sessions(events: DataFrame, *, deadline_seconds: int = vocab.DEADLINE_SECONDS) -> DataFrame:
    """One row per session of an operation, on tables and, with a watermark on ``ts``, on streams: first_ts,
    intended_ts, acknowledged_ts, end_ts, phase_order and outcome.

    A session ends when an operation is silent for longer than the deadline. Its state is one first time
    per phase, so neither repeated events nor many starts grow it, and starts are never paired with
    ends. The outcome is the first terminal phase if it came within the deadline of the intent (of the
    session's first event where none was recorded), else ``timed_out``."""
    first = {p: F.min(F.when(F.col("phase") == p, F.col("ts"))) for p in vocab.PHASES}
    sessions = events.groupBy("operation_id", F.session_window("ts", f"{int(deadline_seconds)} seconds").alias("_session")).agg(
        *[column.alias(f"_{p}") for p, column in first.items()]
    )
    listed = F.array(*[F.struct(F.col(f"_{p}").alias("ts"), F.lit(i).alias("rank"), F.lit(p).alias("phase")) for i, p in enumerate(vocab.PHASES)])
    phases = F.array_sort(F.filter(listed, lambda x: x["ts"].isNotNull()))
    began = F.col("_session.start")
    due = F.coalesce("_intended", began) + F.expr(f"INTERVAL {int(deadline_seconds)} SECONDS")
    end = F.get(F.filter(phases, lambda x: x["phase"].isin(*TERMINAL_PHASES)), F.lit(0))
    return sessions.select(
        "operation_id",
        began.alias("first_ts"),
        F.col("_intended").alias("intended_ts"),
        F.col("_acknowledged").alias("acknowledged_ts"),
        F.when(end["ts"] <= due, end["ts"]).alias("end_ts"),
        F.array_join(F.transform(phases, lambda x: x["phase"]), ">").alias("phase_order"),
        F.when(end["ts"] <= due, end["phase"]).otherwise("timed_out").alias("outcome"),
    )


def first_of_phase(events: DataFrame, phases: tuple[str, ...], name: str) -> DataFrame:
    return events.filter(F.col("phase").isin(*phases)).select(
        F.col("operation_id"), F.col("phase").alias(f"{name}_phase"), F.col("ts").alias(f"{name}_ts")
    )


def join_outcomes(
    starts: DataFrame, ends: DataFrame, *, deadline_seconds: int = vocab.DEADLINE_SECONDS
) -> DataFrame:
    """Starts with the terminal event within the deadline, else ``timed_out``. The same join runs
    on tables and, with watermarks on both sides, on streams."""
    s, t = starts.alias("s"), ends.alias("t")
    deadline = F.expr(f"INTERVAL {int(deadline_seconds)} SECONDS")
    on = (
        (F.col("s.operation_id") == F.col("t.operation_id"))
        & (F.col("t.end_ts") >= F.col("s.start_ts"))
        & (F.col("t.end_ts") <= F.col("s.start_ts") + deadline)
    )
    return s.join(t, on, "left_outer").select(
        F.col("s.operation_id").alias("operation_id"),
        "start_ts",
        "end_ts",
        F.coalesce("end_phase", F.lit("timed_out")).alias("outcome"),
    )


def first_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per start: the first terminal event, of several at one time the first by name."""
    first = F.min(F.struct(F.col("end_ts").isNull().alias("none"), "end_ts", "outcome")).alias("_first")
    return outcomes.groupBy("operation_id", "start_ts").agg(first).select(
        "operation_id", "start_ts", "_first.end_ts", "_first.outcome"
    )


def operation_outcomes(
    events: DataFrame, *, deadline_seconds: int = vocab.DEADLINE_SECONDS
) -> DataFrame:
    """Batch twin of the stream and its reader: each start with the first terminal event within the
    deadline. Repeated (operation, phase, time) events count once.

    One pass over an operation's events, the last first, carries the nearest end back to each start;
    starts and ends are never paired."""
    once = events.select("operation_id", "phase", "ts").distinct()
    is_end = F.col("phase").isin(*vocab.TERMINAL_STATES)
    back = Window.partitionBy("operation_id").orderBy(F.desc("ts"), F.desc(is_end), F.desc("phase"))
    nearest = F.last(F.when(is_end, F.struct(F.col("ts").alias("end_ts"), "phase")), ignorenulls=True)
    seen = once.filter(is_end | (F.col("phase") == "intended")).withColumn("_end", nearest.over(back))
    deadline = F.expr(f"INTERVAL {int(deadline_seconds)} SECONDS")
    end = F.when(F.col("_end.end_ts") <= F.col("ts") + deadline, F.col("_end"))
    return seen.filter("phase = 'intended'").select(
        "operation_id",
        F.col("ts").alias("start_ts"),
        end["end_ts"].alias("end_ts"),
        F.coalesce(end["phase"], F.lit("timed_out")).alias("outcome"),
    )


def operation_summary(operations: DataFrame) -> DataFrame:
    """Whitelisted columns of operation rows; an error text only after failure or cancellation."""
    columns = [
        c
        for c in (
            "operation_id", "status", "created_at", "updated_at", "total_tokens", "input_tokens",
            "output_tokens", "content_hash",
        )
        if c in operations.columns
    ]
    picked = [F.col(c) for c in columns]
    if "error_message" in operations.columns:
        failed = F.col("status").isin("failed", "cancelled")
        picked.append(
            F.when(failed, sanitize_text(F.col("error_message"))).alias("error_message")
        )
    if "progress" in operations.columns:
        value = F.from_json("progress", "stage string, at string, processed bigint, total bigint")
        picked.append(sanitize_json(F.to_json(value)).alias("progress"))
    return operations.select(*picked)
