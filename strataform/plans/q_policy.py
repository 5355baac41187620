"""Queries on verification policy, phrases, journals and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.functions import text as X
from strataform.operators import journal as J
from strataform.operators import verification as V
from strataform.plans import bindings as B
from strataform.plans import q_assignment  # noqa: F401  its model tables are used here
from strataform.plans.bindings import with_
from strataform.plans.query import query
from strataform.session import table
from strataform.streaming import events as E

SQL = B.SQL
_FOLD = lambda c: f"list_transform(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END)"
_MATCH = "(len(fa) > 0 AND len(fb) > 0 AND (fa = fb OR fa[-1] = fb[-1] OR list_has_all(fa, fb) OR list_has_all(fb, fa)))"
SQL["folds"] = f"SELECT *, {_FOLD('label')} AS fa, {_FOLD('name')} AS fb FROM answers"
SQL["verdicts"] = f"SELECT * EXCLUDE (fa, fb), CASE WHEN verdict = 'RELABEL' THEN name END AS new_label FROM (SELECT *, CASE WHEN name IS NULL THEN 'UNVERIFIED' WHEN {_MATCH} OR says_match = 'yes' THEN 'CONFIRM' WHEN choice = 'label' THEN 'CONFIRM' WHEN choice = 'name' THEN 'RELABEL' WHEN choice = 'neither' THEN 'REJECT' ELSE 'UNVERIFIED' END AS verdict FROM folds)"
SQL["limited"] = "SELECT * EXCLUDE (verdict, new_label, v2), v2 AS verdict, CASE WHEN v2 LIKE 'RELABEL%' THEN new_label END AS new_label FROM (SELECT *, CASE WHEN verdict = 'RELABEL' AND (new_label LIKE '% ' || label OR label LIKE '% ' || new_label) THEN 'CONFIRM' WHEN verdict = 'RELABEL' AND box_frac > 0.6 AND n_confirm < 2 THEN 'UNVERIFIED' WHEN verdict = 'RELABEL' AND new_label NOT IN ('chair', 'lamp', 'table', 'plant') THEN 'RELABEL_PROPOSED' ELSE verdict END AS v2 FROM verdicts)"
SQL["final"] = "SELECT * EXCLUDE (verdict), CASE WHEN reason IS NOT NULL AND verdict NOT IN ('REJECT', 'UNVERIFIED') THEN 'HELD' ELSE verdict END AS verdict FROM limited"
B.USES |= {"folds": ("answers",), "verdicts": ("folds",), "limited": ("verdicts",), "final": ("limited",)}


def limited(s, d):
    return V.constrained(V.judged(B.answers(s, d)), ["chair", "lamp", "table", "plant"], 0.6, 2)


def final(s, d):
    return V.held(limited(s, d))


@query("F24_names_match", with_(f"SELECT object_idx, coalesce({_MATCH}, false) AS \"same\" FROM folds", "folds"))
def f24(s, d):
    return B.answers(s, d).select("object_idx", X.names_match(F.col("label"), F.col("name")).alias("same"))


@query("E01_verdicts", with_("SELECT object_idx, verdict, new_label FROM verdicts", "verdicts"))
def e01(s, d):
    return V.judged(B.answers(s, d)).select("object_idx", "verdict", "new_label")


@query("E02_relabel_constraints", with_("SELECT object_idx, verdict, new_label FROM limited", "limited"))
def e02(s, d):
    return limited(s, d).select("object_idx", "verdict", "new_label")


@query("E03_hold_policy", with_("SELECT object_idx, verdict FROM final", "final"))
def e03(s, d):
    return final(s, d).select("object_idx", "verdict")


_APPLIED = "SELECT object_idx, row_number() OVER (ORDER BY object_idx) - 1 AS new_idx, verdict, CASE WHEN verdict = 'RELABEL' THEN new_label WHEN verdict = 'CONFIRM' THEN label END AS verified_label, CASE WHEN verdict = 'RELABEL_PROPOSED' THEN new_label END AS proposed_label FROM final WHERE verdict <> 'REJECT'"


@query("E04_applied_verdicts", with_(_APPLIED, "final"))
def e04(s, d):
    return V.applied(final(s, d))


@query("J17_renumbering", with_(f"SELECT t.track_id, new_idx FROM (SELECT DISTINCT track_id FROM track) t JOIN ({_APPLIED}) a ON a.object_idx = t.track_id", "final", "track"))
def j17(s, d):
    t = B.track(s, d).select("track_id").distinct()
    return t.join(V.applied(final(s, d)), F.col("track_id") == F.col("object_idx")).select("track_id", "new_idx")


@query("A32_verdict_totals", with_("SELECT " + ", ".join(f"count(*) FILTER (WHERE verdict = '{k}') AS {k.lower()}" for k in ("CONFIRM", "RELABEL", "RELABEL_PROPOSED", "REJECT", "UNVERIFIED", "HELD")) + ", count(*) AS n FROM final", "final"))
def a32(s, d):
    return V.totals(final(s, d))


@query("J15_verdict_carry", with_("SELECT a.object_idx, CASE WHEN a.object_idx % 10 = 0 THEN NULL ELSE coalesce(p.verdict, 'NOT_JUDGED') END AS verdict FROM answers a LEFT JOIN (SELECT * FROM final WHERE object_idx % 3 = 0) p ON a.object_idx = p.object_idx", "final"))
def j15(s, d):
    old = final(s, d).filter("object_idx % 3 = 0")
    return V.carried(B.answers(s, d).select("object_idx"), old, F.col("object_idx") % 10 == 0)


SQL["override"] = "SELECT event_id AS seq, user_id % 40 AS instance_id, CASE WHEN event_type <> 'error' THEN event_type || ' ' || (event_id % 3) END AS operator_label FROM events"


def override(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("instance_id"), F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 3).cast("string"))).alias("operator_label"))


_LATEST = "SELECT instance_id, arg_max(operator_label, seq) FILTER (WHERE operator_label IS NOT NULL) AS l, max(seq) AS m, max(seq) FILTER (WHERE operator_label IS NOT NULL) AS lm FROM override GROUP BY 1"


@query("J16_operator_labels", with_("SELECT i.instance_id, CASE WHEN operator_label IS NOT NULL THEN operator_label END AS operator_label FROM (SELECT DISTINCT instance_id FROM instance) i LEFT JOIN (SELECT instance_id, operator_label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY seq DESC) AS r FROM override) WHERE r = 1) o ON o.instance_id = i.instance_id", "instance", "override"))
def j16(s, d):
    return V.carried_labels(B.instance(s, d).select("instance_id").distinct(), override(s, d))


@query("E06_latest_marks", with_("SELECT instance_id, operator_label FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY seq DESC) AS r FROM override) WHERE r = 1 AND operator_label IS NOT NULL", "override"))
def e06(s, d):
    return J.latest(override(s, d), "instance_id", "operator_label", "seq")


@query("E07_instance_listing", with_("SELECT a.object_idx, coalesce(o.operator_label, CASE WHEN verdict = 'RELABEL' THEN new_label END, label) AS shown FROM final a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY seq DESC) AS r FROM override) WHERE r = 1) o ON o.instance_id = a.object_idx", "final", "override"))
def e07(s, d):
    o = J.latest(override(s, d), "instance_id", "operator_label", "seq").select(F.col("instance_id").alias("object_idx"), F.col("operator_label").alias("operator"))
    j = final(s, d).join(o, "object_idx", "left").select("object_idx", "operator", F.lit(None).cast("string").alias("proposed"), F.when(F.col("verdict") == "RELABEL", F.col("new_label")).alias("verified"), F.col("label").alias("detected"))
    return j.select("object_idx", X.display_label().alias("shown"))


@query("P24_display_label", with_("SELECT object_idx, coalesce(CASE WHEN object_idx % 5 = 0 THEN 'own' END, '(' || CASE WHEN verdict = 'RELABEL_PROPOSED' THEN new_label END || ')', CASE WHEN verdict = 'RELABEL' THEN new_label END, label) AS shown FROM limited", "limited"))
def p24(s, d):
    r = limited(s, d).select("object_idx", F.when(F.col("object_idx") % 5 == 0, "own").alias("operator"), F.when(F.col("verdict") == "RELABEL_PROPOSED", F.col("new_label")).alias("proposed"), F.when(F.col("verdict") == "RELABEL", F.col("new_label")).alias("verified"), F.col("label").alias("detected"))
    return r.select("object_idx", X.display_label("proposed").alias("shown"))


@query("X11_verdict_words", with_("SELECT object_idx, CASE verdict WHEN 'CONFIRM' THEN 'confirmed' WHEN 'RELABEL' THEN 'relabelled' WHEN 'REJECT' THEN 'rejected' WHEN 'HELD' THEN 'held' ELSE 'doubtful' END AS word FROM final", "final"))
def x11(s, d):
    return final(s, d).select("object_idx", V.mark_word(F.col("verdict")).alias("word"))


@query("M07_resume_checkpoint", with_("SELECT object_idx, verdict FROM final", "final"))
def m07(s, d):
    f = final(s, d).select("object_idx", "verdict")
    old = f.filter("object_idx % 2 = 0").withColumn("seq", F.col("object_idx"))
    torn = old.withColumn("verdict", F.lit("TORN")).withColumn("seq", F.col("seq") - 1)
    return V.resumed(torn.unionByName(old), f)


@query("G09_default_rows", with_("SELECT a.object_idx, coalesce(f.verdict, 'NOT_JUDGED') AS verdict FROM answers a LEFT JOIN (SELECT * FROM final WHERE object_idx % 4 = 0) f ON f.object_idx = a.object_idx", "final"))
def g09(s, d):
    return V.carried(B.answers(s, d).select("object_idx"), final(s, d).filter("object_idx % 4 = 0"), F.lit(False))


SQL["lines"] = "SELECT conv_id, turn, text FROM conversations"


@query("X01_phrases", with_("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS phrase FROM lines", "lines"))
def x01(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.phrase(F.col("text")).alias("phrase"))


@query("X02_folded_labels", with_(f"SELECT object_idx, array_to_string({_FOLD('label')}, ' ') AS folded FROM answers", "answers"))
def x02(s, d):
    return B.answers(s, d).select("object_idx", X.folded(F.col("label")).alias("folded"))


@query("X03_json_repair", with_("""+ a AS (SELECT object_idx, '<think>no</think>```json ' || '{"label": "' || label || '", "n": ' || n_confirm || '}' || ' ``` done' AS reply FROM answers) SELECT object_idx, json_extract_string(regexp_extract(reply, '(\\{.*\\})', 1), '$.label') AS label FROM a""", "answers"))
def x03(s, d):
    reply = F.concat(F.lit('<think>no</think>```json {"label": "'), F.col("label"), F.lit('", "n": '), F.col("n_confirm").cast("string"), F.lit("} ``` done"))
    return B.answers(s, d).select("object_idx", F.get_json_object(X.json_body(reply), "$.label").alias("label"))


@query("X04_salvaged_strings", with_("SELECT object_idx, label || ',' || label AS terms FROM answers", "answers"))
def x04(s, d):
    reply = F.concat(F.lit('{"terms": ["'), F.col("label"), F.lit('", "'), F.col("label"), F.lit('", "brok'))
    return B.answers(s, d).select("object_idx", F.array_join(X.complete_strings(reply, "terms"), ",").alias("terms"))


@query("X05_field_from_sentence", with_("SELECT object_idx, CASE WHEN object_idx % 2 = 0 THEN label ELSE name END AS proposed FROM answers", "answers"))
def x05(s, d):
    a = B.answers(s, d).withColumn("field", F.when(F.col("object_idx") % 2 == 0, F.col("label"))).withColumn("note", F.concat(F.lit("proposed: "), F.col("name"), F.lit(".")))
    return a.select("object_idx", F.coalesce("field", X.sentence_field(F.col("note"), r"proposed: ([^.]*)\.")).alias("proposed"))


@query("X06_content_hash", "SELECT conv_id, turn, sha256(text) AS sha FROM conversations")
def x06(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha"))


@query("X07_file_names", with_("SELECT object_idx, replace(label, ' ', '_') || '_' || CASE WHEN length(object_idx::VARCHAR) >= 4 THEN substr(object_idx::VARCHAR, 1, 4) ELSE lpad(object_idx::VARCHAR, 4, '0') END AS name FROM answers", "answers"))
def x07(s, d):
    return B.answers(s, d).select("object_idx", X.file_stem(F.col("label"), F.col("object_idx")).alias("name"))


@query("X08_progress", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 50) / 50.0::DOUBLE END AS share FROM events")
def x08(s, d):
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.concat(F.lit("view "), (e % 50).cast("string"), F.lit("/50 done"))).otherwise("idle")
    return table(s, d, "events").select("event_id", X.progress(line).alias("share"))


@query("X10_judged_stat", with_("SELECT frame_idx, reason, CASE reason WHEN 'coverage' THEN coverage WHEN 'median_depth' THEN median_depth WHEN 'rgb_std' THEN rgb_std WHEN 'near_alpha' THEN near_alpha ELSE sharpness END AS value FROM (SELECT *, CASE WHEN NOT coverage >= 0.2 THEN 'coverage' WHEN NOT median_depth >= 1.5 THEN 'median_depth' WHEN NOT rgb_std >= 0.03 THEN 'rgb_std' WHEN NOT near_alpha <= 0.4 THEN 'near_alpha' WHEN NOT sharpness >= 0.1 THEN 'sharpness' END AS reason FROM frame) WHERE reason IS NOT NULL", "frame"))
def x10(s, d):
    from strataform.operators.projection import first_failure
    from strataform.plans.q_assignment import checks

    r = B.frame(s, d).withColumn("reason", first_failure(checks())).filter("reason is not null")
    value = F.coalesce(*(F.when(F.col("reason") == k, F.col(k)) for k in ("coverage", "median_depth", "rgb_std", "near_alpha", "sharpness")))
    return r.select("frame_idx", "reason", value.alias("value"))


SQL["proposal"] = "SELECT DISTINCT event_id % 40 AS view, CASE event_id % 7 WHEN 0 THEN ' Chair ' WHEN 1 THEN 'chairs' WHEN 2 THEN 'floor  lamp' WHEN 3 THEN 'PLANT' WHEN 4 THEN 'desk' WHEN 5 THEN 'glass' ELSE 'windows' END AS term FROM events"


@query("A31_vocabulary_union", with_("+ e AS (SELECT DISTINCT view, lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term FROM proposal), m AS (SELECT DISTINCT view, coalesce(b.term, e.term) AS term FROM e LEFT JOIN (SELECT DISTINCT term FROM e) b ON e.term = b.term || 's') SELECT term, count(*) AS n_views FROM m GROUP BY 1", "proposal"))
def a31(s, d):
    t = F.element_at(F.array(*map(F.lit, (" Chair ", "chairs", "floor  lamp", "PLANT", "desk", "glass", "windows"))), (F.col("event_id") % 7 + 1).cast("int"))
    return X.vocabulary(table(s, d, "events").select((F.col("event_id") % 40).alias("view"), t.alias("term")))


@query("J24_absent_distractors", "SELECT t.term FROM (VALUES ('desk', 0), ('sofa', 1), ('plant', 2), ('stove', 3)) t(term, pos) WHERE term NOT IN ('chair', 'floor lamp', 'plant', 'desk', 'glass', 'windows')")
def j24(s, d):
    d_ = s.createDataFrame([("desk", 0), ("sofa", 1), ("plant", 2), ("stove", 3)], "term string, pos int")
    return d_.join(a31(s, d), "term", "left_anti").select("term")


@query("P25_next_view_label", "SELECT 'view ' || (max(c_custkey) + 1) AS label FROM customer")
def p25(s, d):
    names = table(s, d, "customer").select(F.when(F.col("c_custkey") % 1 == 0, F.concat(F.lit("view "), F.col("c_custkey").cast("string"))).alias("label")).unionByName(s.createDataFrame([("view x",), ("other",)], "label string"))
    return X.next_label(names, "label")


_STAND = """+ l AS (SELECT scene, gate, max(seq) FILTER (WHERE action = 'approve') AS a, max(seq) FILTER (WHERE action = 'demote') AS m FROM gate_event GROUP BY 1, 2),
  st AS (SELECT scene, gate, a AS approved_at FROM l x WHERE a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l y WHERE y.scene = x.scene AND ((y.gate < x.gate AND y.a > x.a) OR (y.gate <= x.gate AND y.m > x.a))))"""


@query("M08_standing_approvals", with_(f"{_STAND} SELECT * FROM st", "gate_event"))
def m08(s, d):
    return J.standing(B.gate_event(s, d))


@query("G10_next_gate", with_(f"{_STAND} SELECT s.scene, coalesce((SELECT min(g) FROM range(1, 6) r(g) WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.scene = s.scene AND st.gate = g)), 6) AS next_gate FROM (SELECT DISTINCT scene FROM gate_event) s", "gate_event"))
def g10(s, d):
    return J.next_gate(B.gate_event(s, d), 5)


@query("F28_gates_before", with_(f"{_STAND} SELECT s.scene, (SELECT count(*) FROM st WHERE st.scene = s.scene AND st.gate < 3) = 2 AS allowed FROM (SELECT DISTINCT scene FROM gate_event) s", "gate_event"))
def f28(s, d):
    return J.may_start(B.gate_event(s, d), 3)


@query("G01_gate_inputs", with_("SELECT scene, gate, sha256(scene::VARCHAR || '|' || coalesce(CASE WHEN gate > 2 THEN action END, 'absent')) AS inputs FROM gate_event", "gate_event"))
def g01(s, d):
    e = B.gate_event(s, d).withColumn("extra", F.when(F.col("gate") > 2, F.col("action")))
    return J.gate_inputs(e, ["scene", "extra"])


SQL["recorded"] = "SELECT DISTINCT scene, gate, 'f' || (seq % 6) AS name, sha256((seq % 6)::VARCHAR) AS sha FROM gate_event"
B.USES["recorded"] = ("gate_event",)


@query("G08_stale_inputs", with_("SELECT r.scene, gate, r.name, CASE WHEN l.sha IS NULL THEN 'gone' ELSE 'changed' END AS why FROM recorded r LEFT JOIN (SELECT DISTINCT scene, name, CASE WHEN name = 'f2' THEN 'x' ELSE sha END AS sha FROM recorded WHERE name <> 'f4') l ON l.scene = r.scene AND l.name = r.name WHERE l.sha IS NULL OR l.sha <> r.sha", "recorded"))
def g08(s, d):
    r = B.gate_event(s, d).select("scene", "gate", F.concat(F.lit("f"), (F.col("seq") % 6).cast("string")).alias("name"), F.sha2((F.col("seq") % 6).cast("string"), 256).alias("sha")).distinct()
    live = r.filter("name <> 'f4'").select("scene", "name", F.when(F.col("name") == "f2", "x").otherwise(F.col("sha")).alias("sha")).distinct()
    return J.stale(r, live)


@query("U04_same_vocabulary", "SELECT true AS same")
def u04(s, d):
    t = lambda xs: s.createDataFrame([(x,) for x in xs], "term string")
    return J.same_vocabulary(t(["b", "a", "c"]), t(["c", "b", "a", "a"]))


@query("U05_union_of_supports", with_("SELECT class_id, count(DISTINCT gid) AS n FROM support GROUP BY 1", "support"))
def u05(s, d):
    return B.support(s, d).groupBy("class_id").agg(F.count_distinct("gid").alias("n"))


@query("U06_missing_frames", with_("SELECT frame_idx FROM frame WHERE frame_idx % 4 = 0", "frame"))
def u06(s, d):
    f = B.frame(s, d).select("frame_idx")
    return J.missing_frames(f, f.filter("frame_idx % 4 <> 0"))


@query("F20_vocabulary_valid", "SELECT 'ghost' AS term")
def f20(s, d):
    r = s.createDataFrame([(["view", "click"], ["click", "ghost"])], "prompts array<string>, negatives array<string>")
    return r.select(F.explode(F.array_except("negatives", "prompts")).alias("term"))


@query("G24_draft_validity", with_("SELECT DISTINCT scene, CASE WHEN scene % 3 = 0 THEN 'draft' ELSE 'saved' END AS terms FROM gate_event", "gate_event"))
def g24(s, d):
    p = B.gate_event(s, d).select("scene").distinct().select("scene", F.sha2(F.col("scene").cast("string"), 256).alias("sha"), F.lit("saved").alias("terms"))
    side = p.select("scene", F.when(F.col("scene") % 3 == 0, F.col("sha")).otherwise("old").alias("base_sha"), F.lit("draft").alias("terms"))
    return J.draft(side, p)


SQL["ev"] = "SELECT event_id AS seq, user_id % 12 AS scene, CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'stage' WHEN 'error' THEN 'refusal' WHEN 'signup' THEN 'stop_look' ELSE 'ack' END AS type, 'b' || (event_id % 4) AS payload FROM events"


def ev(s, d):
    kind = F.element_at(F.create_map(*map(F.lit, ("view", "log", "click", "stage", "error", "refusal", "signup", "stop_look", "purchase", "ack"))), F.col("event_type"))
    return table(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 12).alias("scene"), kind.alias("type"), F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("payload"))


@query("M01_retained_events", with_("SELECT scene, seq FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY seq DESC) AS r FROM ev) WHERE r <= 300", "ev"))
def m01(s, d):
    return E.retained(ev(s, d), 300).select("scene", "seq")


@query("M02_replay", with_("""+ k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY seq DESC) AS r FROM ev) WHERE r <= 300), f AS (SELECT scene, min(seq) AS first FROM k GROUP BY 1), h AS (SELECT scene, first, CASE WHEN scene % 2 = 0 THEN first + 100 ELSE 0 END AS after FROM f),
  j AS (SELECT k.scene, seq, type, payload, after, after >= first - 1 AS resume FROM k JOIN h ON h.scene = k.scene)
  SELECT scene, seq, type FROM j WHERE resume AND seq > after UNION ALL SELECT scene, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY scene, type ORDER BY seq DESC) AS q FROM j WHERE NOT resume) WHERE (type = 'log' AND q <= 20) OR (type IN ('stage', 'refusal') AND q = 1)""", "ev"))
def m02(s, d):
    e = ev(s, d)
    seen = E.retained(e, 300).groupBy("scene").agg(F.min("seq").alias("first")).select("scene", F.when(F.col("scene") % 2 == 0, F.col("first") + 100).otherwise(0).alias("after"))
    return E.replay(e, seen, 300, 20).select("scene", "seq", "type")


@query("L11_log_tail", with_("SELECT scene, seq FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY seq DESC) AS r FROM ev WHERE type = 'log') WHERE r <= 200", "ev"))
def l11(s, d):
    return E.retained(ev(s, d).filter("type = 'log'"), 200).select("scene", "seq")


_LAST = lambda k: f"arg_max(payload, seq) FILTER (WHERE type = '{k}')"
_SEQ = lambda k: f"coalesce(max(seq) FILTER (WHERE type = '{k}'), -1)"


@query("M04_client_view", with_(f"SELECT scene, {_LAST('stage')} AS stage, CASE WHEN {_SEQ('refusal')} > {_SEQ('stage')} THEN {_LAST('refusal')} END AS refusal, CASE WHEN {_SEQ('stop_look')} > {_SEQ('ack')} THEN {_LAST('stop_look')} END AS halt, least(count(*) FILTER (WHERE type = 'log'), 4000) AS log_lines FROM ev GROUP BY 1", "ev"))
def m04(s, d):
    return E.reduced(ev(s, d))


def _streamed(s, frame, transform, schema_cols):
    """Runs a stream over the rows in three files and returns the last row of every scene."""
    import uuid

    from strataform.session import shared_dir

    base = f"{shared_dir(s)}/strataform/stream-{uuid.uuid4().hex}"
    for k in range(3):
        frame.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(f"{base}/in")
    out = f"{base}/out"
    q = transform(E.source(s, f"{base}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(lambda b, i: E.append_once(b.withColumn("at", F.lit(i)), i, out)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = s.read.parquet(out)
    return rows.groupBy("scene").agg(*(F.max_by(c, "at").alias(c) for c in schema_cols))


@query("M04_client_view_stream", with_(f"SELECT scene, {_LAST('stage')} AS stage, CASE WHEN {_SEQ('refusal')} > {_SEQ('stage')} THEN {_LAST('refusal')} END AS refusal, CASE WHEN {_SEQ('stop_look')} > {_SEQ('ack')} THEN {_LAST('stop_look')} END AS halt, least(count(*) FILTER (WHERE type = 'log'), 4000) AS log_lines FROM ev GROUP BY 1", "ev"))
def m04b(s, d):
    return _streamed(s, ev(s, d), E.reduced_stream, ["stage", "refusal", "halt", "log_lines"])


def jobs(s, d):
    kind = F.element_at(F.create_map(*map(F.lit, ("view", "start", "click", "finish", "error", "fail", "signup", "cancel", "purchase", "log"))), F.col("event_type"))
    return table(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 12).alias("scene"), kind.alias("type"), F.lit("").alias("payload"))


_JOB = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' END"
_NEXT = "CASE WHEN state <> 'running' AND type = 'start' THEN 'running' WHEN state = 'running' AND type = 'finish' THEN 'done' WHEN state = 'running' AND type = 'fail' THEN 'failed' WHEN state = 'running' AND type = 'cancel' THEN 'cancelled' ELSE state END"


@query("M05_job_states", f"""WITH RECURSIVE m AS MATERIALIZED (SELECT user_id % 12 AS scene, {_JOB} AS type, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'error', 'signup')),
  r AS (SELECT DISTINCT scene, 0::BIGINT AS k, 'idle' AS state, 0::BIGINT AS runs FROM m
    UNION ALL SELECT r.scene, r.k + 1, {_NEXT}, runs + CASE WHEN state <> 'running' AND type = 'start' THEN 1 ELSE 0 END FROM r JOIN m ON m.scene = r.scene AND m.k = r.k + 1)
  SELECT scene, arg_max(state, k) AS state, max(runs) AS runs FROM r GROUP BY 1""")
def m05(s, d):
    return E.job_states(jobs(s, d))


@query("M06_open_blocks", with_("SELECT h.scene, h.payload AS block, opened FROM (SELECT scene, payload, max(seq) AS opened FROM ev WHERE type = 'stop_look' GROUP BY 1, 2) h LEFT JOIN (SELECT scene, payload, max(seq) AS acked FROM ev WHERE type = 'ack' GROUP BY 1, 2) a ON a.scene = h.scene AND a.payload = h.payload WHERE acked IS NULL OR acked < opened", "ev"))
def m06(s, d):
    return E.open_blocks(ev(s, d))


@query("M03_windowed_delivery", "SELECT date_trunc('day', ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def m03(s, d):
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    return E.windowed_counts(e, "ts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("F25_render_health", with_("SELECT provenance, count(*) >= 4 AND (avg(coverage) IS NULL OR avg(coverage) >= 0.3) AS healthy FROM frame GROUP BY 1", "frame"))
def f25(s, d):
    return B.frame(s, d).groupBy("provenance").agg(((F.count("*") >= 4) & (F.avg("coverage").isNull() | (F.avg("coverage") >= 0.3))).alias("healthy"))


@query("F26_label_visibility", with_("SELECT gid FROM gaussian WHERE opacity >= (CASE WHEN gid % 2 = 0 THEN 0.6 ELSE 0.4 END) AND sqrt(x * x + z * z) < 8", "gaussian"))
def f26(s, d):
    return B.gaussian(s, d).filter((F.col("opacity") >= F.when(F.col("gid") % 2 == 0, 0.6).otherwise(0.4)) & (F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")) < 8)).select("gid")


@query("F30_plausibility", with_("SELECT frame_idx, CASE WHEN fx IS NULL THEN NULL WHEN coverage >= 0.3 THEN true ELSE false END AS fits FROM frame", "frame"))
def f30(s, d):
    return B.frame(s, d).select("frame_idx", F.when(F.col("fx").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("coverage") >= 0.3).alias("fits"))


@query("F29_exemplar_frames", with_("SELECT r.scene, r.name FROM (SELECT DISTINCT scene, name, sha FROM recorded) r WHERE NOT EXISTS (SELECT 1 FROM recorded l WHERE l.name <> 'f4' AND l.scene = r.scene AND l.name = r.name AND l.sha = r.sha)", "recorded"))
def f29(s, d):
    r = B.gate_event(s, d).select("scene", F.concat(F.lit("f"), (F.col("seq") % 6).cast("string")).alias("name"), F.sha2((F.col("seq") % 6).cast("string"), 256).alias("sha")).distinct()
    return r.join(r.filter("name <> 'f4'"), ["scene", "name", "sha"], "left_anti").select("scene", "name")


@query("L08_nearest_labels", with_("SELECT instance_id FROM (SELECT instance_id, pow(min(x), 2) + pow(min(z), 2) AS d FROM instance GROUP BY 1) ORDER BY d, instance_id LIMIT 10", "instance"))
def l08(s, d):
    i = B.instance(s, d).groupBy("instance_id").agg((F.pow(F.min("x"), 2) + F.pow(F.min("z"), 2)).alias("d"))
    return i.orderBy("d", "instance_id").limit(10).select("instance_id")


@query("L04_even_picks", with_("SELECT frame_idx FROM (SELECT *, row_number() OVER (ORDER BY frame_idx) - 1 AS r FROM frame) WHERE r IN (SELECT CAST(floor(i * 24 / 5.0 + 0.5) AS BIGINT) FROM range(0, 6) t(i))", "frame"))
def l04(s, d):
    from pyspark.sql.window import Window as W

    places = [int(i * 24 / 5.0 + 0.5) for i in range(6)]
    return B.frame(s, d).withColumn("r", F.row_number().over(W.orderBy("frame_idx")) - 1).filter(F.col("r").isin(*places)).select("frame_idx")


@query("L05_frame_cap", with_("SELECT frame_idx FROM frame WHERE frame_idx % 11 = 0 UNION SELECT frame_idx FROM (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS r FROM frame WHERE frame_idx % 11 <> 0) WHERE r IN (SELECT CAST(floor(i * 21 / 6.0 + 0.5) AS BIGINT) FROM range(0, 7) t(i))", "frame"))
def l05(s, d):
    from pyspark.sql.window import Window as W

    f = B.frame(s, d).select("frame_idx")
    rest = f.filter("frame_idx % 11 <> 0").withColumn("r", F.row_number().over(W.orderBy("frame_idx")) - 1)
    places = [int(i * 21 / 6.0 + 0.5) for i in range(7)]
    return f.filter("frame_idx % 11 = 0").unionByName(rest.filter(F.col("r").isin(*places)).select("frame_idx")).distinct()


@query("A40_probe_cost", with_("SELECT count(DISTINCT concept) AS prompts, count(DISTINCT frame_idx) AS frames, 300.0::DOUBLE / (count(DISTINCT concept) * count(DISTINCT frame_idx)) AS rate FROM detection HAVING count(DISTINCT concept) >= 5", "detection"))
def a40(s, d):
    n = B.detection(s, d).agg(F.count_distinct("concept").alias("prompts"), F.count_distinct("frame_idx").alias("frames")).filter("prompts >= 5")
    return n.select("prompts", "frames", (F.lit(300.0) / (F.col("prompts") * F.col("frames"))).alias("rate"))


@query("I20_settings_proposal", f"SELECT 'focus' AS setting, {__import__('strataform.operators.points', fromlist=['x']).footprint_share(B.BOXES, (10.0, 10.0))!r}::DOUBLE < 0.25 AS proposed")
def i20(s, d):
    from strataform.operators.points import footprint_share

    return s.createDataFrame([("focus", footprint_share(B.BOXES, (10.0, 10.0)) < 0.25)], "setting string, proposed boolean")


@query("S20_library_rows", with_("SELECT s.scene, coalesce(n, 0) AS events, latest FROM (SELECT DISTINCT scene FROM gate_event) s LEFT JOIN (SELECT scene, count(*) AS n, max(seq) AS latest FROM gate_event WHERE action = 'approve' GROUP BY 1) e ON e.scene = s.scene", "gate_event"))
def s20(s, d):
    g = B.gate_event(s, d)
    n = g.filter("action = 'approve'").groupBy("scene").agg(F.count("*").alias("n"), F.max("seq").alias("latest"))
    return g.select("scene").distinct().join(n, "scene", "left").select("scene", F.coalesce("n", F.lit(0)).alias("events"), "latest")
