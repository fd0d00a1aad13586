"""Sensors with state: transcripts that come again, grow, are refused or fall silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import ids, text
from ..sources.notes import BLOCKS, TRANSCRIPT

#: What becomes of a transcript that arrives; each arrival has exactly one.
BUCKETS = ("added", "grown", "unchanged", "refused", "empty", "unparseable", "active")
#: A session whose lease ran out without an arrival.
LAPSED = "lapsed"

FACTS = ["session_id", "ts", "digest", "utterances", "decoded", "failed", "secret"]
OUTPUT = "session_id string, ts timestamp, bucket string, added long, utterances long"
STATE = "digest string, utterances long"


def transcript_facts(files: DataFrame) -> DataFrame:
    """FACTS of whole transcripts (session_id, text of JSON lines, ts):
    utterances is the number of text blocks of users and assistants that are
    not blank, secret the name of the first pattern that one of them holds."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    good = F.filter(lines, lambda x: F.try_parse_json(x).isNotNull())
    rows = F.filter(F.transform(good, lambda x: F.from_json(x, TRANSCRIPT)), lambda r: F.coalesce(r["message"]["role"], r["type"]).isin("user", "assistant"))
    content = F.transform(rows, lambda r: r["message"]["content"])
    said = F.flatten(F.transform(content, lambda c: F.when(F.startswith(F.trim(c), F.lit("[")), F.transform(F.filter(F.from_json(c, BLOCKS), lambda b: b["type"] == "text"), lambda b: b["text"])).otherwise(F.array(c))))
    said = F.filter(said, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    parts = files.select("session_id", "ts", ids.digest(F.col("text")).alias("digest"), F.size(good).alias("decoded"), (F.size(lines) - F.size(good)).alias("failed"), said.alias("said"))
    secret = F.get(F.filter(F.transform("said", text.first_secret), lambda s: s.isNotNull()), F.lit(0))
    return parts.select("session_id", "ts", "digest", F.size("said").cast("long").alias("utterances"), F.col("decoded").cast("long").alias("decoded"), F.col("failed").cast("long").alias("failed"), secret.alias("secret"))


class TranscriptSensor(StatefulProcessor):
    """Per session: the digest last seen and the utterances taken. A refused
    transcript keeps what was taken before; every arrival renews the lease, a
    timer of event time."""

    def __init__(self, lease_seconds: int, active: str | None = None):
        self.lease_ms, self.active = lease_seconds * 1000, active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        digest, taken = self.seen.get() if self.seen.exists() else (None, 0)
        arrived = pd.concat(list(rows)).sort_values(["ts", "digest"])
        for r in arrived.itertuples():
            added = 0
            if key[0] == self.active:
                bucket = "active"
            elif r.digest == digest:
                bucket = "unchanged"
            else:
                digest = r.digest
                if isinstance(r.secret, str):
                    bucket = "refused"
                elif r.utterances == 0:
                    bucket = "unparseable" if r.decoded == 0 and r.failed > 0 else "empty"
                else:
                    added = max(0, int(r.utterances) - taken)
                    bucket, taken = ("grown" if taken else "added"), taken + added
            out.append((key[0], r.ts, bucket, added, taken))
        if digest is not None:
            self.seen.update((digest, taken))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(arrived["ts"].max().timestamp() * 1000) + self.lease_ms)
        yield pd.DataFrame(out, columns=["session_id", "ts", "bucket", "added", "utterances"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, LAPSED, 0, self.seen.get()[1])], columns=["session_id", "ts", "bucket", "added", "utterances"])

    def close(self) -> None:
        pass


def sense(facts: DataFrame, lease_seconds: int = 3600, late: str = "10 minutes", active: str | None = None) -> DataFrame:
    """(session_id, ts, bucket, added, utterances) of a stream of FACTS, one
    row an arrival, and one of LAPSED for a session without any for a lease.
    State is one row a session, in RocksDB beside the checkpoint; a batch that
    is run again after a failure starts from the state before it."""
    session = facts.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = facts.select(*FACTS).withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(TranscriptSensor(lease_seconds, active), OUTPUT, "Append", "EventTime")


def accounts(rows: DataFrame) -> DataFrame:
    """One row: the arrivals of each bucket, `lapsed` sessions, utterances
    added, and whether every arrival has a bucket."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in (*BUCKETS, LAPSED)]
    out = rows.agg(F.count_if(F.col("bucket") != LAPSED).alias("arrived"), *counts, F.coalesce(F.sum("added"), F.lit(0)).alias("utterances_added"))
    return out.withColumn("accounted", F.col("arrived") == sum(F.col(b) for b in BUCKETS))


def batch_accounts(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch's account to its own folder; a
    batch that is repeated writes the same again."""

    def sink(batch: DataFrame, number: int) -> None:
        accounts(batch).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
