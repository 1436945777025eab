"""Published texts as a stream: kept drafts meet the texts that come out, once each, until they expire."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators import matching

MATCH = "profile string, draft string, text_id string, share double"
LIFE = "profile string, draft string, status string, text_id string, ts timestamp"


def weekly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by ISO week (weeks start on Mondays) and type over a stream; later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "7 days", "4 days"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of cues by speaker with no longer pause than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id", "event_type").agg(F.count("*").alias("cues"))


def run_matching(spark: SparkSession, stream: DataFrame, known: DataFrame, sink: str, checkpoint: str, size: int = matching.SIZE):
    """Each micro-batch of texts meets the drafts that no earlier batch has used; its matches are a partition of the sink."""
    none = spark.createDataFrame([], MATCH)
    none.write.mode("overwrite").parquet(f"{sink}/batch=-1")  # so that the sink can be read before the first match

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(MATCH + ", batch long").parquet(sink).where(F.col("batch") < batch_id)
        used = before.select("profile", F.col("draft").alias("id"))
        drafts = known.join(used, ["profile", "id"], "left_anti").select(known.columns)
        # written again as a whole if a batch is repeated
        matching.matched(drafts, batch, size=size).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Draft(StatefulProcessor):
    """The life of one draft: kept, then claimed by one text, or expired when its time is over."""

    def __init__(self, days: int):
        self.life = days * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("draft", StructType([StructField("kept", LongType()), StructField("text_id", StringType()), StructField("over", BooleanType())]))

    def _said(self, key, status: str, text_id, ts):
        return Row(profile=key[0], draft=key[1], status=status, text_id=text_id, ts=ts)

    def handleInputRows(self, key, rows, timerValues):  # the names are those that Spark calls it by
        # a draft's own rows of one batch: it is kept before it is claimed, and claims come in the order of their texts
        for r in sorted(rows, key=lambda r: (r["what"] != "kept", r["ts"], r["text_id"] or "")):
            ms = int(r["ts"].timestamp() * 1000)
            held = self.state.get() if self.state.exists() else None
            if r["what"] == "kept":
                if held is None:
                    self.state.update((ms, None, False))
                    self.handle.registerTimer(ms + self.life)
                continue
            if held is None:
                status = "unknown"
            elif held[1] is not None:
                status = "taken"
            elif held[2] or ms > held[0] + self.life:
                status = "late"
            else:
                status = "matched"
                self.state.update((held[0], r["text_id"], held[2]))
            yield self._said(key, status, r["text_id"], r["ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[1] is None:
            self.state.update((held[0], None, True))
            yield self._said(key, "expired", None, dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000))

    def close(self) -> None:
        pass


def lives(stream: DataFrame, days: int = matching.EXPIRES_DAYS, late: str = "1 day") -> DataFrame:
    """profile, draft, status, text_id, ts: what becomes of each draft in a stream (profile, draft, what, ts, text_id) of drafts
    kept and claims on them: the first claim in time matches it, further ones find it taken, later ones late; without a
    claim it expires when the watermark has passed its time, by a timer. A draft that was never kept is unknown.

    The state is one short row a draft, so a writer's drafts are dealt to all tasks. The session's state store must be
    the RocksDB one, as for any stream of this kind.
    """
    rows = stream.withWatermark("ts", late)
    return rows.groupBy("profile", "draft").transformWithState(Draft(days), LIFE, "Append", "EventTime")
