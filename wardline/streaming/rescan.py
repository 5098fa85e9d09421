"""Scans of what lands. Text fields run the batch plan a micro-batch; manifests are scanned anew when their list of tools changes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import rules as R
from ..operators import scoring, textual
from ..sources import files as S

FIELDS = "skill_id string, field_ord int, field_name string, text string, seen_at timestamp"
MANIFESTS = "skill_id string, content string, seen_at timestamp"
#: State of skills needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "skill_id string, change string, seen_at timestamp, tools_hash string, added_tools array<string>, added_permissions array<string>, content string"


def rescan(spark: SparkSession, landing: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files with ``FIELDS`` that land in a folder, to findings; a batch that is replayed overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        found = scoring.enrich(scoring.dedup(textual.findings(df.drop("seen_at"))), R.rule_table(df.sparkSession))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = spark.readStream.schema(FIELDS).parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def hit_rate(spark: SparkSession, landing: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rule hits by event-time window, with a watermark for late fields. Native expressions only, so it runs as one stateful stage."""
    s = spark.readStream.schema(FIELDS).parquet(landing).withWatermark("seen_at", late)
    norm = s.select("seen_at", "text")
    hits = [F.when(textual.pattern_ord(F.lower("text"), r).isNotNull(), F.lit(r)) for r in R.TEXT_PATTERNS]
    return norm.select("seen_at", F.explode(F.array_compact(F.array(*hits))).alias("rule_id")).groupBy(F.window("seen_at", window), "rule_id").agg(F.count(F.lit(1)).alias("n"))


class ToolListWatch(StatefulProcessor):
    """Keeps the last list of tools of each skill, and passes on a manifest only if its list is another.

    Manifests of one skill count in the order of their times (at one time, of their hashes). One that is not newer than what is kept is late or a replay, and
    says nothing. A skill that is not seen for ``forget`` of event time is reported once and its state goes, so state is as large
    as what is alive; if it comes back it counts as new.
    """

    def __init__(self, forget: timedelta) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_at timestamp, tools_hash string, tools array<string>, permissions array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.last.get() if self.last.exists() else None
        at, hash_, tools, permissions = kept or (None, None, [], [])
        began, out = at, []
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: (r.seen_at, r.tools_hash)):
            seen = r.seen_at.to_pydatetime() if hasattr(r.seen_at, "to_pydatetime") else r.seen_at
            if at is not None and (_plain(seen), r.tools_hash) <= (_plain(at), hash_):
                continue
            if r.tools_hash != hash_:
                added = [sorted(set(new) - set(old)) for new, old in ((r.tools, tools), (r.permissions, permissions))]
                out.append((key[0], "new" if hash_ is None else "changed", seen, r.tools_hash, *added, r.content))
            at, hash_, tools, permissions = seen, r.tools_hash, list(r.tools), list(r.permissions)
        if at is not None and at != began:
            self.last.update((at, hash_, tools, permissions))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(int((_plain(at) + self.forget - datetime(1970, 1, 1)).total_seconds() * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, hash_, *_ = self.last.get()
        self.last.clear()
        yield _frame([(key[0], "gone", at, hash_, [], [], None)])

    def close(self) -> None:
        pass


def _plain(at: datetime) -> datetime:
    return at.replace(tzinfo=None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])


def tool_lists(manifests: DataFrame) -> DataFrame:
    """``MANIFESTS`` with what is watched: names of tools, declared permissions, and a hash of all that a tool says of itself."""
    v = F.try_parse_json("content")
    listed = F.coalesce(F.try_variant_get(v, "$.tools", "array<variant>"), F.expr("array()").cast("array<variant>"))
    names = F.transform(listed, lambda t: F.coalesce(F.try_variant_get(t, "$.name", "string"), F.lit("")))
    get = lambda x: F.coalesce(F.try_variant_get(x, "$.permissions", "array<string>"), F.array().cast("array<string>"))
    permissions = F.array_sort(F.array_distinct(F.concat(get(v), F.flatten(F.transform(listed, get)))))
    said = F.sha2(F.to_json(F.struct(F.transform(listed, lambda t: F.to_json(t)).alias("t"), permissions.alias("p"))), 256)
    return manifests.where(S.refusal(F.col("content")).isNull()).select("skill_id", "seen_at", "content", names.alias("tools"), permissions.alias("permissions"), said.alias("tools_hash"))


def tool_changes(manifests: DataFrame, late: str = "1 hour", forget: timedelta = timedelta(days=30)) -> DataFrame:
    """A stream of ``MANIFESTS`` to ``CHANGES``. The session's state store has to be RocksDB's."""
    watched = tool_lists(manifests).withWatermark("seen_at", late)
    return watched.groupBy("skill_id").transformWithStateInPandas(ToolListWatch(forget), CHANGES, "Append", "EventTime")


def changed_findings(changes: DataFrame) -> DataFrame:
    """Findings of the manifests in a batch of ``CHANGES``, by the batch plan; a skill that changed twice in it is scanned twice."""
    at = F.concat(F.lit("/"), F.sha2(F.concat_ws("\n", "skill_id", "tools_hash", F.col("seen_at").cast("string")), 256), F.lit("/mcp.json"))
    told = changes.where("content IS NOT NULL").withColumn("path", at)
    skills = S.manifests(S.describe(told.select("path", "content")))
    found = scoring.dedup(textual.findings(S.text_fields(skills)).unionByName(textual.dynamic_tools(skills)))
    names = told.select(F.col("path").alias("at"), F.col("skill_id").alias("own"), "change", "seen_at")
    return scoring.enrich(found, R.rule_table(changes.sparkSession)).join(names, F.col("skill_id") == F.col("at")).drop("skill_id", "at").withColumnRenamed("own", "skill_id")


def watch(spark: SparkSession, landing: str, out: str, checkpoint: str, once: bool = True, late: str = "1 hour", forget: timedelta = timedelta(days=30)) -> StreamingQuery:
    """Parquet files with ``MANIFESTS`` that land in a folder: what changed goes to ``out``/changes, its findings to ``out``/findings, by batch; a replayed batch overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        same = df.sparkSession.read.schema(CHANGES).parquet(f"{out}/changes/batch={number}")
        changed_findings(same).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    w = tool_changes(spark.readStream.schema(MANIFESTS).parquet(landing), late, forget).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
