"""Run events as streams: reducers, job states, halting blocks and journals, each with a batch twin.

An event is (seq, scene, type, payload). Streams keep state by scene; batch twins fold the same
events in order of seq, and tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

EVENT = "seq long, scene long, type string, payload string"
#: Events that a replay keeps, and the lines of log that a reducer keeps.
RING, LOG_LINES, REPLAY_LINES = 2000, 4000, 200


def source(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """New event files (JSON lines) of a folder as a stream."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(folder)


def retained(events: DataFrame, size: int = RING) -> DataFrame:
    """The last `size` events of each scene."""
    return events.withColumn("r", F.row_number().over(W.partitionBy("scene").orderBy(F.desc("seq")))).filter(F.col("r") <= size).drop("r")


def replay(events: DataFrame, last_seen: DataFrame, size: int = RING, lines: int = REPLAY_LINES) -> DataFrame:
    """What a client gets that has seen up to `after` (scene, after): the events since, if all are still kept, else a fresh snapshot.

    The snapshot has the last log lines, the latest stage, and the current refusal.
    """
    kept = retained(events, size)
    first = kept.groupBy("scene").agg(F.min("seq").alias("first"))
    how = last_seen.join(first, "scene").withColumn("resume", F.col("after") >= F.col("first") - 1)
    j = kept.join(how, "scene")
    since = j.filter(F.col("resume") & (F.col("seq") > F.col("after"))).select("scene", "seq", "type", "payload")
    fresh = j.filter(~F.col("resume"))
    log = fresh.filter("type = 'log'").withColumn("r", F.row_number().over(W.partitionBy("scene").orderBy(F.desc("seq")))).filter(F.col("r") <= lines)
    one = fresh.filter("type in ('stage', 'refusal')").withColumn("r", F.row_number().over(W.partitionBy("scene", "type").orderBy(F.desc("seq")))).filter("r = 1")
    cols = ["scene", "seq", "type", "payload"]
    return since.unionByName(log.select(*cols)).unionByName(one.select(*cols))


def reduced(events: DataFrame) -> DataFrame:
    """The client's view of each scene: latest stage, open refusal (a later stage clears it), open halt, log lines kept."""
    t = lambda kind: F.max(F.when(F.col("type") == kind, F.col("seq")))
    p = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("payload")), F.when(F.col("type") == kind, F.col("seq")))
    a = events.groupBy("scene").agg(p("stage").alias("stage"), t("stage").alias("ts"), p("refusal").alias("refusal"), t("refusal").alias("tr"), p("stop_look").alias("halt"), t("stop_look").alias("th"), t("ack").alias("ta"), F.count_if(F.col("type") == "log").alias("logs"))
    return a.select(
        "scene",
        "stage",
        F.when(F.coalesce(F.col("tr") > F.col("ts"), F.col("tr").isNotNull()), F.col("refusal")).alias("refusal"),
        F.when(F.coalesce(F.col("th") > F.col("ta"), F.col("th").isNotNull()), F.col("halt")).alias("halt"),
        F.least("logs", F.lit(LOG_LINES)).cast("long").alias("log_lines"),
    )


_STATE = "stage string, ts long, refusal string, tr long, halt string, th long, ta long, logs long"
_VIEW = "scene long, stage string, refusal string, halt string, log_lines long"


def _reduce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stage, ts, refusal, tr, halt, th, ta, logs = state.get if state.exists else (None, -1, None, -1, None, -1, -1, 0)
    for b in batches:
        for e in b.sort_values("seq").itertuples():
            if e.type == "stage" and e.seq > ts:
                stage, ts = e.payload, e.seq
            elif e.type == "refusal" and e.seq > tr:
                refusal, tr = e.payload, e.seq
            elif e.type == "stop_look" and e.seq > th:
                halt, th = e.payload, e.seq
            elif e.type == "ack":
                ta = max(ta, e.seq)
            elif e.type == "log":
                logs += 1
    state.update((stage, ts, refusal, tr, halt, th, ta, logs))
    yield pd.DataFrame([(key[0], stage, refusal if tr > ts else None, halt if th > ta else None, min(logs, LOG_LINES))], columns=["scene", "stage", "refusal", "halt", "log_lines"])


def reduced_stream(events: DataFrame) -> DataFrame:
    """`reduced` over a stream: the new view of every scene that has events in a batch. Events may come late: seq decides."""
    return events.groupBy("scene").applyInPandasWithState(_reduce, _VIEW, _STATE, "update", GroupStateTimeout.NoTimeout)


#: Job states and what each event makes of them; anything else leaves the state.
TRANSITIONS = {("idle", "start"): "running", ("done", "start"): "running", ("failed", "start"): "running", ("cancelled", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("running", "cancel"): "cancelled"}


def _job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, runs = state.get if state.exists else ("idle", 0)
    for b in batches:
        for e in b.sort_values("seq").itertuples():
            to = TRANSITIONS.get((now, e.type), now)
            runs += to == "running" and now != "running"
            now = to
    state.update((now, runs))
    yield pd.DataFrame([(key[0], now, runs)], columns=["scene", "state", "runs"])


def job_states_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("scene").applyInPandasWithState(_job, "scene long, state string, runs long", "state string, runs long", "update", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """The state each scene's job is in after its events, by a fold over them in order.

    Only the events that can move a state are folded, packed by scene.
    """
    moves = events.filter(F.col("type").isin(*sorted({t for _, t in TRANSITIONS})))
    rows = moves.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("seq", "type"))).alias("all"))
    start = F.struct(F.lit("idle").alias("state"), F.lit(0).cast("long").alias("runs"))

    def step(acc, e):
        to = acc.state
        for (was, what), then in TRANSITIONS.items():
            to = F.when((acc.state == was) & (e.type == what), F.lit(then)).otherwise(to)
        return F.struct(to.alias("state"), (acc.runs + F.when((to == "running") & (acc.state != "running"), 1).otherwise(0)).alias("runs"))

    return rows.select("scene", F.aggregate("all", start, step).alias("s")).select("scene", "s.state", "s.runs")


def open_blocks(events: DataFrame) -> DataFrame:
    """Halts (type stop_look, payload = block id) that no later acknowledgment of the same id answers."""
    halts = events.filter("type = 'stop_look'").groupBy("scene", "payload").agg(F.max("seq").alias("opened"))
    acks = events.filter("type = 'ack'").groupBy("scene", "payload").agg(F.max("seq").alias("acked"))
    return halts.join(acks, ["scene", "payload"], "left").filter("acked is null or acked < opened").select("scene", F.col("payload").alias("block"), "opened")


def append_once(batch: DataFrame, batch_id: int, folder: str) -> None:
    """foreachBatch sink: a batch that is tried again replaces its own folder, so no row is written twice."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def windowed_counts(events: DataFrame, column: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window of event time, with a watermark for late ones; works on streams and tables."""
    return events.withWatermark(column, late).groupBy(F.window(column, width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")
