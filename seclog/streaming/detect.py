"""Exact detection and correlation over micro-batches, with the batch operators.

Every micro-batch is judged together with the rows it can still depend on: events
inside the longest window, and earlier firings inside the longest cooldown. These
rows are the state; they live in tables, one version per batch id, so a batch that
runs again reads the same state and replaces its own results. Nothing is held per
key in one task: the operators split hot addresses as they do in batch.

Rows are judged once the event-time bound has passed them, in event order, so the
results equal the batch results over the same events. Rows that come later than the
bound allows are kept in a table of their own, which ``late_rows`` reads and counts.
State older than the previous batch is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclog.config import HOUR_US, SECOND_US, BaselineLimits, BlockLimits, DetectionLimits, ForestLimits, checked
from seclog.operators.baseline import login_anomalies, login_state, profiles_of_state
from seclog.operators.correlate import RuleSpec, correlate, correlation_alerts
from seclog.operators.detect import (
    escalate_repeat_offenders,
    fired_incidents,
    handled,
    incident_candidates,
)
from seclog.operators.features import anomaly_reasons, ip_window_features
from seclog.operators.iforest import fit_state, sample_state, score
from seclog.operators.suppress import suppress_within
from seclog.sources.sinks import append_table, read_appended
from seclog.sources.staging import remove, staged

_START = -(2**62)


@dataclass(frozen=True)
class _State:
    """Where the rows carried between batches are, and up to when rows are judged."""

    folder: str

    def _at(self, batch: int, name: str) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def load(self, spark: SparkSession, batch: int, name: str, like: DataFrame) -> DataFrame:
        if batch < 0:
            return like.limit(0)
        return spark.read.schema(like.schema).parquet(self._at(batch, name))

    def save(self, rows: DataFrame, batch: int, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._at(batch, name))
        return rows.sparkSession.read.schema(rows.schema).parquet(self._at(batch, name))

    def forget(self, spark: SparkSession, batch: int, name: str) -> None:
        if batch >= 0:
            remove(spark, self._at(batch, name))

    def judged_until(self, spark: SparkSession, batch: int) -> int:
        if batch < 0:
            return _START
        return spark.read.parquet(self._at(batch, "judged")).first()["us"]


class _Incremental:
    """Shared part: merge a micro-batch with the state, judge what is due, keep the rest."""

    def __init__(self, folder: str, output: str, delay_us: int, window_us: int) -> None:
        self.state = _State(folder)
        self.output = output
        self.delay_us = delay_us
        self.window_us = window_us
        self.next_batch = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.state.judged_until(spark, batch_id - 1)
        carried = self.state.load(spark, batch_id - 1, "events", batch)
        append_table(batch.filter(F.col("us") <= before), f"{self.state.folder}/late", "us", batch_id)
        rows = staged(carried.unionByName(batch.filter(F.col("us") > before)), "rows")
        newest = rows.agg(F.max("us")).first()[0]
        self.next_batch = batch_id + 1
        until = before if newest is None else max(before, newest - self.delay_us)
        results = self.judge(rows.filter(F.col("us") <= until), before, until, batch_id)
        append_table(results, self.output, "us", batch_id)
        self.state.save(rows.filter(F.col("us") >= until - self.window_us), batch_id, "events")
        self.state.save(
            spark.range(1).select(F.lit(until).cast("long").alias("us")), batch_id, "judged"
        )
        for name in ("events", "fired", "judged", "profile", "sample", "model"):
            self.state.forget(spark, batch_id - 2, name)

    def finish(self, like: DataFrame, batch_id: int) -> None:
        """Judge the rows that still wait for the event-time bound, as at the end of a replay.

        ``like`` has the columns of a batch; ``batch_id`` is the one after the last.
        """
        delay, self.delay_us = self.delay_us, 0
        try:
            self(like.limit(0), batch_id)
        finally:
            self.delay_us = delay

    def late_rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows that came after their time was judged."""
        return read_appended(spark, f"{self.state.folder}/late", schema)

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        raise NotImplementedError

    def thin(
        self,
        fresh: DataFrame,
        before: int,
        until: int,
        batch_id: int,
        keep_us: int,
        suppress: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """New firings, given the earlier ones; keeps the firings later batches depend on.

        An earlier firing is the first row of its key, so suppression keeps it and
        lets it silence the new rows.
        """
        spark = fresh.sparkSession
        earlier = self.state.load(spark, batch_id - 1, "fired", fresh)
        fired = staged(suppress(earlier.unionByName(fresh)), "fired")
        self.state.save(fired.filter(F.col("us") > until - keep_us), batch_id, "fired")
        return fired


class IncidentDetector(_Incremental):
    """``foreachBatch`` handler for incidents (candidates, cooldown, escalation)."""

    def __init__(
        self, folder: str, output: str, limits: DetectionLimits, delay_us: int, severity_aware: bool = False
    ) -> None:
        super().__init__(folder, output, delay_us, limits.window_sec * SECOND_US)
        self.limits, self.severity_aware = limits, severity_aware

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        fresh = incident_candidates(handled(due), self.limits).filter(F.col("us") > before)
        keep = max(self.limits.cooldown_sec, self.limits.repeat_window_sec) * SECOND_US
        fired = self.thin(
            fresh, before, until, batch_id, keep, lambda rows: fired_incidents(rows, self.limits, self.severity_aware)
        )
        return escalate_repeat_offenders(fired, self.limits).filter(F.col("us") > before)


class CorrelationDetector(_Incremental):
    """``foreachBatch`` handler for correlation alerts."""

    def __init__(
        self, folder: str, output: str, rules: Sequence[RuleSpec], delay_us: int,
        chunk_us: int = 3_600_000_000,
    ) -> None:
        super().__init__(folder, output, delay_us, max(r.window_sec for r in rules) * SECOND_US)
        self.rules, self.chunk_us = tuple(rules), chunk_us

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        fresh = correlate(due, self.rules, self.chunk_us).filter(F.col("us") > before)
        keep = max(r.cooldown_sec for r in self.rules) * SECOND_US
        fired = self.thin(
            fresh, before, until, batch_id, keep, lambda rows: correlation_alerts(rows, self.rules)
        )
        return fired.filter(F.col("us") > before)


class LoginDetector(_Incremental):
    """``foreachBatch`` handler for login anomalies, each judged by the profile before it.

    The profile is a table of counts per address, user and hour (``operators.baseline.login_state``), one version a
    batch: a batch merges the hours that are over into it, and judges the hour under way together with the rows it had.
    """

    def __init__(self, folder: str, output: str, limits: BaselineLimits, delay_us: int) -> None:
        super().__init__(folder, output, delay_us, HOUR_US)
        self.limits = limits

    def _profile(self, spark: SparkSession, batch: int) -> DataFrame:
        empty = spark.createDataFrame([], "src_ip string, user string, __chunk long, n long, first_us long, last_us long")
        return self.state.load(spark, batch, "profile", empty)

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        known = self._profile(due.sparkSession, batch_id - 1)
        rows = due.filter(F.col("us") >= before // HOUR_US * HOUR_US)
        over = rows.filter(F.col("us") < until // HOUR_US * HOUR_US)
        self.state.save(login_state(over, self.limits, known), batch_id, "profile")
        return login_anomalies(rows, self.limits, known).filter(F.col("us") > before)

    def profiles(self, like: DataFrame) -> DataFrame:
        """The profiles after the last batch; ``like`` has the columns of a batch."""
        spark, last = like.sparkSession, self.next_batch - 1
        until = self.state.judged_until(spark, last)
        rows = self.state.load(spark, last, "events", like)
        now = rows.filter((F.col("us") >= until // HOUR_US * HOUR_US) & (F.col("us") <= until))
        return profiles_of_state(login_state(now, self.limits, self._profile(spark, last)))


class ForestDetector(_Incremental):
    """``foreachBatch`` handler that scores windows of addresses by an isolation forest it trains as it goes.

    The sample (``operators.iforest.sample_state``) is merged batch by batch and keeps the newest ``buffer_sec``. A forest
    is grown from it once ``min_samples`` rows were seen, and anew when ``retrain_sec`` of event time went by since; each
    is a version of its own, with the score at the contamination quantile of its sample as its cut. A batch is
    scored by the version before it, so rows before the first training are not judged. Alerts of an address keep
    the cooldown.
    """

    def __init__(self, folder: str, output: str, limits: ForestLimits, delay_us: int, chunk_us: int = HOUR_US) -> None:
        checked(limits)
        super().__init__(folder, output, delay_us, limits.window_sec * SECOND_US)
        self.limits, self.chunk_us = limits, chunk_us
        self.bucket_us = max(1, limits.buffer_sec * SECOND_US // 16)

    def model(self, spark: SparkSession, batch: int) -> tuple[int, int, int, float] | None:
        """(version, trained at, rows seen, cut) after a batch; version 0 has no forest."""
        return None if batch < 0 else tuple(spark.read.parquet(self.state._at(batch, "model")).first())

    def forest(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.state.folder}/forest/version={version}")

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        spark, limits = due.sparkSession, self.limits
        rows = staged(ip_window_features(due, limits.window_sec, chunk_us=self.chunk_us).filter(F.col("us") > before), "windows")
        version, trained, seen, cut = self.model(spark, batch_id - 1) or (0, _START, 0, 0.0)
        known = self.state.load(spark, batch_id - 1, "sample", sample_state(rows.limit(0), limits, bucket_us=self.bucket_us))
        oldest = (until - limits.buffer_sec * SECOND_US) // self.bucket_us
        merged = sample_state(rows, limits, bucket_us=self.bucket_us, known=known).filter(F.col("bucket") >= oldest)
        sample = self.state.save(merged, batch_id, "sample")
        strange = rows.withColumn("score", F.lit(0.0)).limit(0)
        if version:
            strange = score(rows, self.forest(spark, version), limits=limits).filter(F.col("score") < cut)
        keep = limits.cooldown_sec * SECOND_US
        tied = strange.withColumn("version", F.lit(version)).withColumn("__n", F.lit(0))
        kept = self.thin(tied, before, until, batch_id, keep, lambda r: suppress_within(r, ["src_ip"], keep, tie="__n"))
        seen += rows.count()
        if seen >= limits.min_samples and until - trained >= limits.retrain_sec * SECOND_US:
            version, trained = version + 1, until
            fit_state(sample, limits).write.mode("overwrite").parquet(f"{self.state.folder}/forest/version={version}")
            scored = score(sample, self.forest(spark, version), limits=limits)
            cut = scored.agg(F.percentile_approx("score", F.lit(limits.contamination), F.lit(10_000))).first()[0]
        facts = spark.createDataFrame([(version, trained, seen, cut)], "version int, trained_us long, seen long, cut double")
        self.state.save(facts, batch_id, "model")
        out = kept.filter(F.col("us") > before)
        return out.withColumn("reasons", anomaly_reasons(F.col("score"))).select("src_ip", "us", "score", "version", "reasons")


class BlockDetector(_Incremental):
    """``foreachBatch`` handler for accepted blocks of requests (ip, us, request_id, reason)."""

    def __init__(
        self, folder: str, output: str, limits: BlockLimits, delay_us: int
    ) -> None:
        super().__init__(folder, output, delay_us, 0)
        self.length_us = limits.duration_sec * SECOND_US

    def judge(self, due: DataFrame, before: int, until: int, batch_id: int) -> DataFrame:
        fired = self.thin(
            due.filter(F.col("us") > before),
            before,
            until,
            batch_id,
            self.length_us,
            lambda rows: suppress_within(rows, ["ip"], self.length_us, tie="request_id"),
        )
        return fired.filter(F.col("us") > before).select(
            "ip", "us", (F.col("us") + self.length_us).alias("end_us"), "reason"
        )
