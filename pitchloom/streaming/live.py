"""Live results as a stream: each micro-batch goes through the contract and into the append-only table of results; matches as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.operators.contracts import Contract, validate
from pitchloom.sources.sinks import exists


def ingest(results: DataFrame, path: str, checkpoint: str, contract: Contract, key: str = "match_id", once: bool = True):
    """Start the query that appends new results to the table at ``path``.

    A batch that breaks the contract fails the query and writes nothing. A key that is stored already is skipped, so a
    batch that is run again after a lost driver adds nothing twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = validate(batch, contract)
        if exists(rows.sparkSession, path):
            rows = rows.join(rows.sparkSession.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
        rows.write.mode("append").parquet(path)

    writer = results.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts by window and kind with a watermark; the same plan over a table or a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


#: What ``follow`` reads: kind is fixture (with kickoff), result (with goals) or override (with a reason).
RECORD = "match_id string, kind string, at timestamp, kickoff timestamp, goals_a int, goals_b int, reason string"
STATE = "kickoff long, goals_a int, goals_b int, reason string, told boolean"
KINDS = ("fixture", "override", "result")


def _follow(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = dict(zip(("kickoff", "goals_a", "goals_b", "reason", "told"), state.get if state.exists else (None, None, None, None, False), strict=True))
    events: list[tuple] = []

    def tell(at, event, a=None, b=None, reason=None):
        events.append((key[0], int(at), event, a, b, reason))

    def waits() -> bool:
        return known["kickoff"] is not None and known["goals_a"] is None and not known["told"]

    def due() -> None:
        if waits() and known["kickoff"] <= state.getCurrentWatermarkMs():
            tell(known["kickoff"], "excused" if known["reason"] else "overdue", reason=known["reason"])
            known["told"] = True

    due()  # before what came after it
    for chunk in chunks if not state.hasTimedOut else ():
        for r in chunk.assign(order=chunk["kind"].map({k: i for i, k in enumerate(KINDS)})).sort_values(["at", "order", "goals_a", "goals_b"], kind="stable").itertuples():
            if r.kind == "fixture" and not pd.isna(r.kickoff):
                known["kickoff"] = int(r.kickoff)
            elif r.kind == "override" and isinstance(r.reason, str) and r.reason.strip():
                known["reason"] = r.reason
                if known["told"] and known["goals_a"] is None:
                    tell(r.at, "excused", reason=r.reason)
            elif r.kind == "result" and not pd.isna(r.goals_a) and not pd.isna(r.goals_b):
                now, before = (int(r.goals_a), int(r.goals_b)), (known["goals_a"], known["goals_b"])
                tell(r.at, "played" if before[0] is None else "copy" if now == before else "corrected", *now)
                known["goals_a"], known["goals_b"] = now
            else:
                tell(r.at, "unusable", reason=str(r.kind))
        if events:
            yield _table(events)
            events.clear()
    due()
    if waits():
        state.setTimeoutTimestamp(known["kickoff"])
    state.update(tuple(known.values()))
    if events:
        yield _table(events)


def _table(events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(events, columns=["match_id", "at", "event", "goals_a", "goals_b", "reason"]).astype({"goals_a": "Int32", "goals_b": "Int32"})


def follow(records: DataFrame, grace: str = "2 days") -> DataFrame:
    """Events (match_id, at, event, goals_a, goals_b, reason) of a stream of RECORD, with the state of each match kept by Spark.

    played: the first result. copy: the same goals again. corrected: other goals, which now stand. overdue: the stream's time is ``grace`` past
    the kickoff and no result came; excused: the same with an override and its reason, which is recorded; an override after overdue excuses then.
    A result may follow either. unusable: a result without goals, an override without a reason, a fixture without a kickoff or another
    kind (named in reason). Records of a match in one batch are taken by time, a chunk of Arrow after the other, after a kickoff that earlier batches made due. Spark drops records that are
    more than ``grace`` behind the stream, so it has to be wide. Records without match_id share one state, those without a time are dropped.
    """
    rows = records.where("at is not null").withWatermark("at", grace)
    rows = rows.select("match_id", "kind", F.unix_millis("at").alias("ms"), F.unix_millis("kickoff").alias("kickoff"), "goals_a", "goals_b", "reason", F.col("at").alias("moment"))
    shape = rows.groupBy("match_id")
    events = shape.applyInPandasWithState(_renamed, "match_id string, at long, event string, goals_a int, goals_b int, reason string", STATE, "append", "EventTimeTimeout")
    return events.withColumn("at", F.timestamp_millis("at"))


def _renamed(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    return _follow(key, (c.drop(columns="moment").rename(columns={"ms": "at"}) for c in chunks), state)


def standing(events: DataFrame) -> DataFrame:
    """match_id, goals_a and goals_b as they stand by a table of events: the latest result of each match."""
    latest = F.max_by(F.struct("goals_a", "goals_b"), F.struct("at", "goals_a", "goals_b")).alias("r")
    return events.where("event in ('played', 'corrected')").groupBy("match_id").agg(latest).select("match_id", "r.*")
