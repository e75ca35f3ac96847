"""The call log: resume, reconciliation, attempts, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(expected: DataFrame, done: DataFrame, on: str = "call_id") -> DataFrame:
    """Calls still to be sent: those not in the log, whatever their recorded status. Failed calls never enter the log."""
    return expected.join(done.select(on), on, "left_anti")


def refuse_duplicates(calls: DataFrame, on: str = "call_id") -> DataFrame:
    """The log as it is, or an error if a call stands in it twice."""
    dup = calls.groupBy(on).count().filter("count > 1").limit(5).collect()
    if dup:
        raise ValueError(f"duplicate {on}: {[r[0] for r in dup]}")
    return calls


def append_once(log: DataFrame, new: DataFrame, on: str = "call_id") -> DataFrame:
    """The log with new calls added; calls that it has are skipped, repeats within new collapse to one."""
    return log.unionByName(new.join(log.select(on), on, "left_anti").dropDuplicates([on]))


def start_refusals(lock_present: bool, recorded_hash: str | None, config_hash: str, recorded_harness: str | None, harness: str) -> list[str]:
    """Reasons not to start a session; all are checked before anything is written."""
    checks = [
        (lock_present, "another session holds the lock"),
        (recorded_hash is not None and recorded_hash != config_hash, "the configuration changed since the first session"),
        (recorded_harness is not None and recorded_harness != harness, "the log belongs to another harness"),
    ]
    return [why for bad, why in checks if bad]


def last_attempts(attempts: DataFrame, on: str = "call_id", order: str = "attempt") -> DataFrame:
    """(call_id, n_attempts, n_ok, final_status)."""
    return attempts.groupBy(on).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.max_by("status", order).alias("final_status")
    )


def reconcile(expected: DataFrame, calls: DataFrame, attempts: DataFrame, on: str = "call_id") -> DataFrame:
    """One row: expected, done, missing, unexpected, duplicates, failed, no_attempt, resent. One full join over one line per call each."""
    e = expected.select(on).distinct().withColumn("e", F.lit(1))
    c = calls.groupBy(on).agg(F.count(F.lit(1)).alias("c"))
    a = last_attempts(attempts, on).select(on, "n_attempts", "n_ok")
    j = e.join(c, on, "full_outer").join(a, on, "full_outer")
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    E, C, A = F.col("e").isNotNull(), F.col("c").isNotNull(), F.col("n_attempts").isNotNull()
    return j.agg(
        n(E, "expected"), n(C, "done"), n(E & ~C, "missing"), n(C & ~E, "unexpected"), n(F.col("c") > 1, "duplicates"), n(A & ~C, "failed"),
        n(C & (F.coalesce("n_ok", F.lit(0)) == 0), "no_attempt"), n(F.col("n_ok") > 1, "resent"),
    )


def field_mismatches(calls: DataFrame, expected: DataFrame, fields: list[str], on: str = "call_id") -> DataFrame:
    """(field_name, n): expected calls whose recorded field differs from the expected value, null-safe."""
    want = expected.select(on, *[F.col(f).alias(f"_w_{f}") for f in fields])
    off = F.array(*[F.struct(F.lit(f).alias("field_name"), (~F.col(f).eqNullSafe(F.col(f"_w_{f}"))).cast("int").alias("bad")) for f in fields])
    return calls.join(want, on).select(F.explode(off).alias("x")).groupBy("x.field_name").agg(F.sum("x.bad").alias("n"))


def counters(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.counter", "x.value").agg(F.count(F.lit(1)).alias("n"))


def validate_run(expected: DataFrame, calls: DataFrame, attempts: DataFrame, fields: list[str], bad_lines: int = 0, torn_tail: bool = False) -> DataFrame:
    """One row: the reconciliation, mismatching fields, harnesses, bad lines, and whether the run is complete and passes."""
    rec = reconcile(expected, calls, attempts)
    mism = field_mismatches(calls, expected, fields).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mismatches"))
    kinds = calls.agg(F.count_distinct("harness").alias("harnesses"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "invalid").alias("invalid"))
    row = rec.crossJoin(mism).crossJoin(kinds)  # one row each
    classes = {
        "duplicates": F.col("duplicates") > 0, "bad_lines": F.lit(bad_lines > 0 or torn_tail), "unexpected": F.col("unexpected") > 0, "mismatches": F.col("mismatches") > 0,
        "harnesses": F.col("harnesses") > 1, "resent": F.col("resent") > 0, "no_attempt": F.col("no_attempt") > 0,
    }
    problems = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in classes.items()]), lambda x: x.isNotNull())
    none = reduce(lambda a, b: a & b, [~v for v in classes.values()])
    return row.withColumns({"complete": F.col("missing") == 0, "problems": F.array_join(problems, ","), "passes": none & (F.col("missing") == 0)})
