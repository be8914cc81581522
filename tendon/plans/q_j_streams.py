"""Streams over the driver tables, and the last batch operators."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import labels as N
from ..functions.columns import argmax, r6
from ..functions.decoder import greedy_decoder
from ..operators import events as E
from ..operators import onset, steps
from ..operators import quality as Q
from ..operators import readiness as G
from ..operators import reports as R
from ..operators import windows as W
from ..operators.ordered import block, exact_quantiles, micros
from ..runtime import scratch
from ..streaming import stateful as Z
from ..streaming.estimator import SCHEMA, estimates, estimator
from .q_b_ordered import BLK
from .q_f_folds import HOUR, NAME_SQL, NAMES, fold_sql
from .q_g_signal import CH, long_trials
from .registry import ORACLES, query
from .views import samples, table, trials


def stream(spark, d, name):
    """A derived table as a file stream: written once to the shared folder, read as a stream."""
    path = scratch(spark, name)
    d.write.parquet(path)
    return spark.readStream.schema(d.schema).parquet(path)


def live(spark, d, name, summarise):
    """Running aggregate over a stream; its latest snapshot."""
    path = scratch(spark, name)
    Z.snapshots(stream(spark, d, f"{name}-in"), path, summarise)
    s = spark.read.parquet(path)
    return s.where(F.col("batch") == s.agg(F.max("batch")).scalar()).drop("batch")


def clock(d):
    return d.withColumn("at", F.timestamp_micros(micros("ts")))


@query("t01_hop_stream", sql="""
WITH e AS (SELECT event_type, value, epoch_us(ts) us FROM events), w AS (SELECT *, unnest(range(us//21600000000-3, us//21600000000+1)) h FROM e)
SELECT event_type, h*21600000000 AS start_us, count(*) AS rows, round(sum(value),4) AS total FROM w WHERE us>=h*21600000000 AND us<h*21600000000+86400000000 GROUP BY 1,2""")
def t01(spark, root):
    e = clock(table(spark, root, "events"))
    d = Z.hop_windows(e, "at", ["event_type"], "24 hours", "6 hours", [F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")])
    return d.select("event_type", F.unix_micros(F.col("w.start")).alias("start_us"), "rows", "total")


@query("t02_tumble", sql="""
SELECT event_type, (epoch_us(ts)//3600000000)*3600000000 AS start_us, count(*) AS rows, round(max(value),4) AS top FROM events GROUP BY 1,2""")
def t02(spark, root):
    d = Z.tumble(clock(table(spark, root, "events")), "at", ["event_type"], "1 hour", [F.count(F.lit(1)).alias("rows"), F.round(F.max("value"), 4).alias("top")])
    return d.select("event_type", F.unix_micros(F.col("w.start")).alias("start_us"), "rows", "top")


@query("t03_gap_sessions", sql="""
WITH g AS (SELECT user_id, epoch_us(ts) us, CASE WHEN epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us) s FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS rows FROM s GROUP BY user_id, s""")
def t03(spark, root):
    e = clock(table(spark, root, "events"))
    d = Z.gap_sessions(e, "at", ["user_id"], "4 hours", [F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros("at")).alias("last_us")])
    return d.select("user_id", F.unix_micros(F.col("w.start")).alias("start_us"), "last_us", "rows")


@query("t01_hop_stream_live", sql=ORACLES["t01_hop_stream"])
def t01s(spark, root):
    e = clock(table(spark, root, "events")).select("at", "event_type", "value")
    d = live(spark, e, "hop", lambda s: Z.hop_windows(s, "at", ["event_type"], "24 hours", "6 hours", [
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")], late="1 hour"))
    return d.select("event_type", F.unix_micros(F.col("w.start")).alias("start_us"), "rows", "total")


@query("t03_gap_sessions_live", sql=ORACLES["t03_gap_sessions"])
def t03s(spark, root):
    e = clock(table(spark, root, "events")).select("at", "user_id")
    d = live(spark, e, "gap", lambda s: Z.gap_sessions(s, "at", ["user_id"], "4 hours", [
        F.count(F.lit(1)).alias("rows"), F.max(F.unix_micros("at")).alias("last_us")], late="1 hour"))
    return d.select("user_id", F.unix_micros(F.col("w.start")).alias("start_us"), "last_us", "rows")


@query("t04_drop_late", sql="""
WITH e AS (SELECT user_id, event_id id, epoch_us(ts)//1000 - CASE WHEN event_id%13=0 THEN 7200000*3 ELSE 0 END t FROM events)
SELECT user_id, t, id FROM (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM e) WHERE m IS NULL OR t>m""")
def t04(spark, root):
    e = table(spark, root, "events").select("user_id", F.col("event_id").alias("id"), (F.floor(micros("ts") / 1000) - F.when(F.col("event_id") % 13 == 0, 7_200_000 * 3).otherwise(0)).alias("t"))
    r = Z.Replay(spark, e, "late", "id", keys=["user_id"])  # arrival order is the id
    return Z.to_table(Z.accepted(r.stream, ["user_id"]), "t04", r)


def tiny_model(emg, imu):
    """A supplied model: direction from the strongest IMU axis, gesture from the strongest channel."""
    d = int(np.abs(imu).mean(axis=0).argmax()) + (0 if imu.mean() > 0 else 3)
    return d % 7, 0.9, int(np.sqrt((emg ** 2).mean(axis=0)).argmax()) % 4, 0.9


def device_rows(spark, root):
    d = long_trials(spark, root)
    return d.select("trial", (F.col("n") * 5).alias("t"), "blk", *CH)


RUN = estimator(tiny_model, CH, CH[:3], emg_scale=50.0)


@query("t05_state_estimates")
def t05(spark, root):
    return estimates(device_rows(spark, root), ["trial"], "blk", tiny_model, CH, CH[:3], emg_scale=50.0)


@query("t05_state_estimates_stream")
def t05s(spark, root):
    r = Z.Replay(spark, device_rows(spark, root).drop("blk"), "devices", "t", keys=["trial"])
    return Z.to_table(Z.stateful(r.stream, ["trial"], ["t"], RUN, None, SCHEMA), "t05", r)


def named_replay(spark, root):
    d = table(spark, root, "events").select(F.col("user_id").alias("trial_id"), N.lookup(NAMES, F.col("event_type")).alias("name"), micros("ts").alias("t"))  # as `samples`, without its index
    return Z.Replay(spark, d, "named", "t", "micros", keys=["trial_id"])


@query("t07_debounce_stream")
def t07s(spark, root):
    r = named_replay(spark, root)
    return Z.to_table(Z.debounced(r.stream, ["trial_id"], 6 * HOUR), "debounce", r)


@query("t11_press_release_stream")
def t11s(spark, root):
    r = named_replay(spark, root)
    return Z.to_table(Z.press_release(r.stream, ["trial_id"], 3 * HOUR), "press", r)


ORACLES["t07_debounce_stream"] = ORACLES["w07_debounce"]
ORACLES["t11_press_release_stream"] = ORACLES["t11_press_release"]


@query("t06_phases_stream", sql=ORACLES["t06_phases"])
def t06s(spark, root):
    from .q_f_folds import label_frames
    r = Z.Replay(spark, label_frames(spark, root).drop("blk"), "labels", "n", keys=["trial_id"])
    return Z.to_table(Z.phases(r.stream, ["trial_id"]), "phases", r)


@query("t08_gesture_events_stream", sql=ORACLES["t08_gesture_events"])
def t08s(spark, root):
    from .q_f_folds import control_frames
    r = Z.Replay(spark, control_frames(spark, root).drop("slot"), "frames", "t", keys=["user_id"])
    return Z.to_table(Z.gestures(r.stream, ["user_id"], 14_400_000), "gestures", r)


@query("t09_timeout_stream")
def t09s(spark, root):
    from .q_f_folds import control_frames
    r = Z.Replay(spark, control_frames(spark, root).drop("slot"), "timeout", "t", keys=["user_id"])
    return Z.to_table(Z.gestures_with_timeout(r.stream, ["user_id"], 28_800_000), "timeouts", r)


@query("t10_threshold_events_stream", sql=ORACLES["t10_threshold_events"])
def t10s(spark, root):
    k, n = F.col("k"), F.col("n")
    d = samples(spark, root).select("trial_id", "n", (k / 100.0).alias("index_press"), ((k * 7) % 100 / 100.0).alias("index_release"), ((k * 13 + n) % 100 / 100.0).alias("thumb_up"))
    r = Z.Replay(spark, d, "probs", "n", keys=["trial_id"])
    return Z.to_table(Z.threshold_events(r.stream, ["trial_id"], ("index_press", "index_release", "thumb_up"), (0.55, 0.55, 0.55), 3), "t10", r)


@query("t14_quality_alerts", views="samples win", sql="""WITH w2 AS (SELECT trial_id, j, max(t_ms) t, bool_or(abs(c0)>=60) clip FROM win GROUP BY 1,2), """ + fold_sql(
    "SELECT trial_id, t FROM w2 WHERE clip", "trial_id", "t", ["t"], {"kt": "CAST(NULL AS BIGINT)"}, {"kt": "CASE WHEN a.kt IS NULL OR x.t-a.kt>=60 THEN x.t ELSE a.kt END"},
    "CASE WHEN a.kt IS NULL OR x.t-a.kt>=60 THEN [{'t': x.t}] ELSE [] END", "STRUCT(t BIGINT)")[5:])
def t14(spark, root):
    w = W.window_agg(samples(spark, root).select("trial_id", "n", "t_ms", "c0"), ["trial_id"], [F.max("t_ms").alias("t"), Q.rolling_reasons(("c0",), 60.0).alias("reasons")], size=8, hop=4)
    bad = w.where("reasons LIKE '%clipping%'").select("trial_id", "t", F.lit("alert").alias("name"), F.floor(F.col("t") / 1_000_000).alias("slot"))
    return E.debounce(bad, ["trial_id"], "slot", 60, ()).select("trial_id", "t")


CAL_SQL = """WITH f AS (SELECT trial_id, median(v)/16 s FROM (SELECT trial_id, unnest([abs(c0),abs(c1)]) v FROM samples WHERE n<20) GROUP BY 1)
SELECT trial_id, n, round(c0/s,6) AS c0, round(c1/s,6) AS c1 FROM samples JOIN f USING (trial_id) WHERE n>=20"""


@query("t15_calibrate_run", views="samples", sql=CAL_SQL)
def t15(spark, root):
    from ..operators.joins import small
    s = samples(spark, root).select("trial_id", "n", "c0", "c1")
    long = s.where("n < 20").select("trial_id", F.explode(F.array(F.abs("c0"), F.abs("c1"))).alias("v"))  # bounded rows per device
    fit = long.groupBy("trial_id").agg((F.percentile("v", 0.5) / 16).alias("s"))
    return s.where("n >= 20").join(small(fit), "trial_id").select("trial_id", "n", *[r6(F.col(c) / F.col("s"), c) for c in ("c0", "c1")])


@query("t15_calibrate_run_stream", views="samples", sql=CAL_SQL)
def t15s(spark, root):
    d = samples(spark, root).select("trial_id", "n", "c0", "c1")
    r = Z.Replay(spark, d, "cal", "n", keys=["trial_id"])
    return Z.to_table(Z.calibrate_run(r.stream, ["trial_id"], 20, ("c0", "c1")), "t15", r).select("trial_id", "n", r6("c0", "c0"), r6("c1", "c1"))


@query("t18_health_stream", sql="""
SELECT user_id%4 AS run, count(*) AS states, round(avg((event_id%11=0)::INT),6) AS direction_unknown, round(avg((event_id%7=0)::INT),6) AS gesture_unknown FROM events GROUP BY 1""")
def t18(spark, root):
    e = table(spark, root, "events").select((F.col("user_id") % 4).alias("run"), F.when(F.col("event_id") % 11 == 0, -1).otherwise(1).alias("d"),
                                            F.when(F.col("event_id") % 7 == 0, -1).otherwise(1).alias("g"), "event_id")
    d = live(spark, e, "health", lambda s: R.health(s, "run", "event_id", "d", "g", N.FLAGS[:2]))
    return d.select("run", "states", r6("direction_unknown", "direction_unknown"), r6("gesture_unknown", "gesture_unknown"))


@query("t20_audit_split", sql="""
SELECT 'audit' AS sink, count(*) AS rows FROM events UNION ALL SELECT 'accepted', count(*) FROM events WHERE event_id%9<>0""")
def t20(spark, root):
    path = scratch(spark, "split")
    Z.audit_split(stream(spark, table(spark, root, "events").select("event_id", "value"), "split-in"), path, F.col("event_id") % 9 != 0)
    one = lambda s: spark.read.parquet(f"{path}/{s}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(s).alias("sink"), "rows")
    return one("audit").unionByName(one("accepted"))


@query("s10_batched_append", views="samples", sql="SELECT session_no, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM samples GROUP BY 1")
def s10(spark, root):
    path = scratch(spark, "raw")
    d = samples(spark, root).select("session_no", "event_id", "n", "c0")
    Z.batch_sink(stream(spark, d, "raw-in"), "append", lambda b, i: Z.append_session(b, "emg", path, i))
    return spark.read.parquet(f"{path}/emg").groupBy(F.col("session_no").cast("bigint").alias("session_no")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("d04_stateful_decoder", sql=ORACLES["o03_greedy_collapse"])
def d04(spark, root):
    e = table(spark, root, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("seq"), "vec_id", argmax(F.slice("embedding", 1, 10)).alias("label"))
    d = greedy_decoder(9)(e.asTable().partitionBy("seq").orderBy("vec_id"))
    return d.select("seq", F.array_join(F.transform("labels", lambda l: F.chr(l + 97)), "").alias("text"))


@query("a57_cue_onset")
def a57(spark, root):
    d = long_trials(spark, root)
    env = onset.energy_envelope(d, ["trial"], "n", ("c0", "c1"), 40.0)
    cues = d.where("n % 25 = 20").select("trial", F.col("n").alias("cue_id"), F.col("n").alias("cue"), F.when(F.col("n") % 2 == 0, "index_press").otherwise("index_release").alias("name"))
    return onset.cue_onsets(env, cues, ["trial"], "n", "cue_id", "cue", "name", 40.0, steps.RELEASES).select("trial", "cue_id", "onset", r6("confidence", "confidence"), "method")


GATE_FACTS = """t AS (SELECT o_orderkey trial_id, o_custkey%4+1 session_no, o_orderpriority || CASE WHEN o_orderkey%3=0 THEN '_open_hand' ELSE '' END AS label, o_orderstatus<>'P' AS valid, (o_orderkey%3-1)*200 AS off, CASE WHEN o_orderkey%900=7 THEN 'aborted' ELSE 'completed' END cs, CASE WHEN o_orderkey%2=0 THEN 'noise' ELSE '' END dr, o_orderkey%12 blk FROM orders),
c AS (SELECT l_orderkey trial_id, min(CASE WHEN l_linenumber%2=1 THEN l_linenumber END) a, min(CASE WHEN l_linenumber%2=0 THEN l_linenumber END) h, bool_or(l_linenumber=7) rel FROM lineitem GROUP BY 1),
j AS (SELECT t.*, a, h, coalesce(rel,false) rel, abs((h-a)*100-off) ce, abs((h-a)*4.0-off) se FROM t LEFT JOIN c USING (trial_id)),
f AS (SELECT session_no, count(*) FILTER (WHERE valid AND (a IS NULL OR h IS NULL)) mc, max(CASE WHEN valid THEN ce END) mce, max(CASE WHEN valid THEN se END) mse, count(*) FILTER (WHERE valid AND label LIKE '%_open_hand' AND NOT rel) mr, count(*) FILTER (WHERE valid AND cs<>'completed') ic, count(*) FILTER (WHERE NOT valid AND dr='') ue, max(blk) bl, count(DISTINCT label) lb FROM j GROUP BY 1),
e AS (SELECT user_id%4+1 session_no, count(*) FILTER (WHERE event_type='click') br, count(*) FILTER (WHERE event_type='view') fa, count(*) FILTER (WHERE event_type='error') al, sum(CASE WHEN event_id%50=0 THEN 2 ELSE 0 END)::DOUBLE/(count(*)+sum(CASE WHEN event_id%50=0 THEN 2 ELSE 0 END)) lr, sum((event_id%777=0)::INT)::DOUBLE/(count(*)+sum(CASE WHEN event_id%50=0 THEN 2 ELSE 0 END)) du FROM events GROUP BY 1)"""


@query("a52_session_gate", sql=f"""
WITH {GATE_FACTS}, r AS (SELECT f.session_no, al, [CASE WHEN session_no=2 THEN 'schema_version' END, CASE WHEN session_no=4 THEN 'model_frozen' END, CASE WHEN lb<>8 THEN 'combinations' END, CASE WHEN ic>0 THEN 'completed' END, CASE WHEN mc>0 THEN 'cues_present' END, CASE WHEN coalesce(mce,0)>80 THEN 'cue_clock' END, CASE WHEN coalesce(mse,0)>80 THEN 'cue_samples' END,
 CASE WHEN mr>0 THEN 'open_release' END, CASE WHEN lr>0.02 THEN 'lost_packets' END, CASE WHEN du>0.01 THEN 'duplicate_packets' END, CASE WHEN ue>0 THEN 'discards_explained' END, CASE WHEN br<greatest(0,bl-1) THEN 'breaks' END, CASE WHEN fa<greatest(0,bl-1) THEN 'fatigue_reports' END, CASE WHEN session_no=3 THEN 'calibration' END] p FROM f JOIN e USING (session_no))
SELECT session_no, 'failed' AS status, array_to_string(list_sort(list_filter(p, lambda x: x IS NOT NULL)), ',') AS problems, al AS alerts FROM r""")
def a52(spark, root):
    o = table(spark, root, "orders")
    t = o.select(F.col("o_orderkey").alias("trial_id"), (F.col("o_custkey") % 4 + 1).alias("session_no"), F.lit("formal").alias("trial_kind"),
                 F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "_open_hand").otherwise("")).alias("label"), (F.col("o_orderstatus") != "P").alias("valid"),
                 ((F.col("o_orderkey") % 3 - 1) * 200).alias("offset_ms"), F.when(F.col("o_orderkey") % 900 == 7, "aborted").otherwise("completed").alias("completion_status"),
                 F.when(F.col("o_orderkey") % 2 == 0, "noise").otherwise("").alias("discard_reason"), (F.col("o_orderkey") % 12).alias("block_index"),
                 F.lit(1).alias("stable_start"), F.lit(5).alias("stable_end"))
    ln = F.col("l_linenumber")
    cu = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("trial_id"), ln, (ln * 100_000_000).cast("bigint").alias("emitted_ns"), ln.alias("sample_index"))
    names = F.when(ln % 2 == 1, "arm:x").otherwise("hand:y")
    c = cu.withColumn("name", names).unionByName(cu.where("l_linenumber = 7").withColumn("name", F.lit("hand:release"))).drop("l_linenumber")
    e = table(spark, root, "events").withColumn("session_no", F.col("user_id") % 4 + 1)
    kind = F.when(F.col("event_type") == "click", "BLOCK_BREAK_START").when(F.col("event_type") == "view", "FATIGUE_REPORT").when(F.col("event_type") == "error", "QUALITY_ALERT")
    audit = e.select("session_no", F.when(F.col("event_id") % 50 == 0, 2).otherwise(0).alias("lost"), (F.col("event_id") % 777 == 0).alias("duplicate"), F.lit(False).alias("late"))
    blocks = e.where("session_no <> 3").select("session_no", F.lit("rest").alias("label"), F.lit(True).alias("valid"))
    name = F.concat(F.lit("S0"), "session_no")
    const = {"protocol_name": "p", "protocol_version": "p", "protocol_sha256": "x", "emg_nominal_rate_hz": 250, "imu_nominal_rate_hz": 112, "measured_emg_rate_hz": 249.9,
             "measured_imu_rate_hz": 0.0, "num_emg_channels": 8, "model_frozen": False, "quality_report_json": '{"passed": true}', **{m: "ok" for m in G.REQUIRED_META}}
    meta = e.select("session_no").distinct().withColumns({"schema_version": F.when(F.col("session_no") == 2, "2.0").otherwise("3.0"), "session_name": name,
                                                          "dataset_split": N.split_of("session_no"), **{k: F.lit(v) for k, v in const.items()}})
    # balance and trial counts are not part of this query's stand-in protocol
    rows, _ = G.session_gate(meta, t, c, blocks, e.select("session_no", kind.alias("event_type")), audit, "session_no", 0, ("rest",), "p", 8)
    al = e.groupBy("session_no").agg(F.count_if(F.col("event_type") == "error").alias("alerts"))
    return Q.gate(rows.where("rule NOT IN ('offset_balance')"), ["session_no"]).join(al, "session_no").select("session_no", "status", "problems", "alerts")
