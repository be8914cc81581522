"""Scans, sinks and import checks; files are derived from the driver tables in the shared folder."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import r6
from ..operators.ordered import block, micros
from ..runtime import scratch
from ..sources import npz
from ..sources import tables as S
from .q_b_ordered import BLK
from .registry import query
from .views import cues, pred, samples, table, trials


def trial_rows(spark, root):
    c = [F.col(f"c{i}") for i in range(4)]
    return samples(spark, root).select(
        F.concat(F.lit("S0"), "session_no").alias("session_id"), F.col("trial_id").cast("string").alias("trial_id"), "n",
        F.col("t_ms").cast("double").alias("timestamp_ms"), F.array(*c, *c).alias("emg"), F.array(*c[:3]).alias("accel"), F.array(*c[1:4]).alias("gyro"),
        (F.col("k") % 8 - 1).cast("int").alias("direction"), (F.col("k") % 5 - 1).cast("int").alias("gesture"))


@query("s01_sample_scan", views="samples", sql="""
SELECT CAST(trial_id AS VARCHAR) AS trial_id, count(*) AS rows, count(*) FILTER (WHERE k%8<>0 AND k%5<>0) AS stable, count(*)::DOUBLE AS quality, 0::BIGINT AS missing, 8::INT AS channels FROM samples GROUP BY 1""")
def s01(spark, root):
    path = scratch(spark, "samples")
    trial_rows(spark, root).write.parquet(path)
    d = S.read_samples(spark, path)
    return d.groupBy("trial_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("stable_mask").alias("stable"), F.sum("window_quality").alias("quality"),
                                     F.count_if("missing_mask").alias("missing"), F.max(F.size("channel_quality")).alias("channels"))


@query("s02_trial_archives", views="samples", sql="""
SELECT CAST(trial_id AS VARCHAR) AS trial_id, count(*) AS rows, round(sum(c0),6) AS total, max(t_ms)::DOUBLE AS last_ms FROM samples GROUP BY 1""")
def s02(spark, root):
    path = scratch(spark, "npz")

    def save(pdf):  # one archive per trial, as the reader expects
        from pyarrow.fs import FileSystem
        pdf = pdf.sort_values("n")
        store, base = FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:///{path.removeprefix('file:').lstrip('/')}")
        folder = f"{base}/{pdf['session_id'].iloc[0]}"
        store.create_dir(folder, recursive=True)
        made = io.BytesIO()
        np.savez(made, **{c: np.stack(pdf[c].to_numpy()) for c in ("emg", "accel", "gyro")},
                 timestamp_ms=pdf["timestamp_ms"].to_numpy(), direction=pdf["direction"].to_numpy(), gesture=pdf["gesture"].to_numpy(),
                 session_id=np.array(pdf["session_id"].iloc[0]), trial_id=np.array(pdf["trial_id"].iloc[0]))
        with store.open_output_stream(f"{folder}/{pdf['trial_id'].iloc[0]}.npz") as f:
            f.write(made.getvalue())
        return pd.DataFrame({"rows": [len(pdf)]})

    trial_rows(spark, root).groupBy("session_id", "trial_id").applyInPandas(save, "rows bigint").agg(F.sum("rows")).collect()
    d = npz.read_trials(spark, path)
    return d.groupBy("trial_id").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum(F.get("emg", F.lit(0))), "total"), F.max("timestamp_ms").alias("last_ms"))


CORPUS = "SELECT 'c' || o_custkey AS dataset, (o_orderkey%1000)::DOUBLE AS a, (o_orderkey%1000+50)::DOUBLE AS b, CASE o_custkey%4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM orders"


@query("s03_corpus_split", sql=f"""
WITH c AS ({CORPUS}) SELECT split, dataset, CASE WHEN split='test' THEN 1 ELSE count(*) END AS parts, min(a) AS first_start, CASE WHEN split='test' THEN max(b) ELSE arg_min(b, (a,b)) END AS first_end FROM c GROUP BY 1,2""")
def s03(spark, root):
    path = scratch(spark, "corpus")
    o = table(spark, root, "orders")
    c = F.col("o_custkey") % 4
    o.select(F.concat(F.lit("c"), "o_custkey").alias("dataset"), (F.col("o_orderkey") % 1000).cast("double").alias("start"),
             (F.col("o_orderkey") % 1000 + 50).cast("double").alias("end"), F.when(c == 0, "test").when(c == 1, "val").otherwise("train").alias("split")) \
        .write.option("header", True).csv(path)
    d = S.read_split(spark, path, pool_test=True)
    return d.select("split", "dataset", F.size("partitions").cast("bigint").alias("parts"), F.get("partitions", F.lit(0))["start"].alias("first_start"),
                    F.get("partitions", F.lit(0))["end"].alias("first_end"))


@query("s04_calibration_scan", views="samples", sql="""
SELECT 'S' || trial_id AS session_id, CASE WHEN trial_id%3=0 THEN 1 ELSE 2 END AS version, CASE WHEN trial_id%3=0 THEN 'per_channel' ELSE 'global' END AS mode, round(avg(c0),6) AS center FROM samples GROUP BY trial_id""")
def s04(spark, root):
    path = scratch(spark, "calibration")
    s = samples(spark, root).groupBy("trial_id").agg(F.avg("c0").alias("m"))
    old = F.col("trial_id") % 3 == 0
    s.select(F.concat(F.lit("S"), "trial_id").alias("session_id"), F.array("m").alias("emg_center"), F.when(~old, 2).alias("calibration_version"),
             F.when(~old, "global").alias("emg_scale_mode")).write.option("ignoreNullFields", True).json(path)
    d = S.calibration_defaults(spark.read.schema(schemas.CALIBRATION).json(path))  # one object per line
    return d.select("session_id", F.col("calibration_version").alias("version"), F.col("emg_scale_mode").alias("mode"), r6(F.get("emg_center", F.lit(0)), "center"))


@query("s05_state_log", views="pred", sql="""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY t)-1 AS state_sequence, t AS timestamp_ms, round(q,6) AS q_direction FROM (
 SELECT 'a' AS run_id, vec_id*40 t, q FROM pred WHERE vec_id%2=0 UNION ALL SELECT 'b', vec_id*40, q FROM pred WHERE vec_id%2=1)""")
def s05(spark, root):
    path = scratch(spark, "states")
    p = pred(spark, root).select((F.col("vec_id") * 40).alias("timestamp_ms"), F.col("q").alias("q_direction"), "vec_id")
    for i, run in enumerate(("a", "b")):
        S.append_states(p.where(F.col("vec_id") % 2 == i), path, run, F.floor(F.col("timestamp_ms") / 4_000_000))
    return spark.read.schema(schemas.STATE_LOG).parquet(path).select("run_id", "state_sequence", "timestamp_ms", r6("q_direction", "q_direction"))


def packed(spark, root):
    c = [F.col(f"c{i}") for i in range(4)]
    basic = F.array(F.col("t_ms").cast("double"), *c, *c, *c[:3], *c[1:4])
    full = F.concat(basic, F.array(*[F.lit(x) for x in (0.5, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 1.0)]), F.array_repeat(F.lit(0.75), 8))
    args = F.when(F.col("k") % 10 == 0, F.array(F.lit(1.0))).when(F.col("k") % 2 == 0, full).otherwise(basic)
    return samples(spark, root).select("trial_id", args.alias("args"))


@query("s06_raw_stream", views="samples", sql="""
SELECT trial_id, t_ms AS timestamp_ms, round(c1,6) AS emg1, round(c3,6) AS gyro2, CASE WHEN k%2=0 THEN 0.5 ELSE 1.0 END::DOUBLE AS sample_quality, k%2=0 AS missing, k%2<>0 AS imu_valid, k%2=0 AS out_of_order_packet, CASE WHEN k%2=0 THEN 0.75 ELSE 1.0 END::DOUBLE AS q7, false AS rejected FROM samples WHERE k%10<>0
UNION ALL SELECT trial_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM samples WHERE k%10=0""")
def s06(spark, root):
    good, bad = S.read_raw_stream(packed(spark, root))
    g = good.select("trial_id", "timestamp_ms", r6(F.get("emg", F.lit(1)), "emg1"), r6(F.get("gyro", F.lit(2)), "gyro2"), "sample_quality", "missing", "imu_valid",
                    "out_of_order_packet", F.get("channel_quality", F.lit(7)).alias("q7"), F.lit(False).alias("rejected"))
    return g.unionByName(bad.select("trial_id", F.lit(True).alias("rejected")), allowMissingColumns=True)


@query("s07_trial_sink", views="samples", sql="SELECT 'S0' || session_no AS session_id, CAST(trial_id AS VARCHAR) AS trial_id, count(*) AS rows, true AS refused FROM samples GROUP BY 1,2")
def s07(spark, root):
    path = scratch(spark, "trials")
    d = trial_rows(spark, root)
    S.write_trials(d, path)
    refused = False
    try:
        S.write_trials(d, path)
    except Exception:  # the output exists
        refused = True
    return spark.read.parquet(path).groupBy("session_id", "trial_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


@query("s08_import_manifest", sql="""
WITH t AS (SELECT o_custkey%10 participant, o_orderkey%4+1 session, o_custkey trial_id, o_orderstatus<>'P' valid, o_orderkey%50 st, 8-o_orderkey%3 ch FROM orders),
p AS (SELECT participant, session, trial_id, count(*) c, bool_and(valid) v, sum(st) st, min(ch) ch FROM t GROUP BY 1,2,3)
SELECT participant, session, count(*) FILTER (WHERE v) AS trials, count(*) FILTER (WHERE NOT v) AS excluded, CAST(sum(st) AS BIGINT) AS stable_samples, min(ch) AS valid_channels, count(*) FILTER (WHERE c>1) AS duplicates FROM p GROUP BY 1,2""")
def s08(spark, root):
    o = table(spark, root, "orders")
    t = o.select((F.col("o_custkey") % 10).alias("participant"), (F.col("o_orderkey") % 4 + 1).alias("session"), F.col("o_custkey").alias("trial_id"),
                 (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_orderkey") % 50).alias("stable_samples"), (8 - F.col("o_orderkey") % 3).alias("valid_channels"))
    return S.import_manifest(t)


def session_root(spark, root):
    """Session tables derived from the driver tables, partitioned by participant and session."""
    path = scratch(spark, "session")
    part = lambda d: d.write.partitionBy("participant_id", "session_id").parquet
    pid = F.concat(F.lit("P"), F.col("session_no") % 2).alias("participant_id")
    sid = F.concat(F.lit("S0"), "session_no").alias("session_id")
    s = samples(spark, root)
    made = {
        "emg_samples": s.select(F.col("n").alias("sample_index"), (F.col("n") % 256).cast("smallint").alias("packet_seq"), (micros("ts") * 1000).alias("pc_received_ns"),
                                (F.col("n") * 4_000_000).alias("sample_time_ns"), F.array(*[F.col(f"c{i}").cast("int") for i in range(4)]).alias("raw"), pid, sid),
        "imu_samples": s.select((F.col("n") * 4_000_000).alias("sample_time_ns"), F.col("n").alias("emg_sample_index"),
                                                   F.array(F.col("c0").cast("float")).alias("accel"), F.array(F.col("c3").cast("float")).alias("gyro"), pid, sid),
        "events": s.select("event_id", F.col("n").alias("sample_index"), "trial_id", "event_type", pid, sid),
        "packet_audit": s.select(F.lit(1).cast("smallint").alias("packet_type"), F.when(F.col("k") == 0, 1).otherwise(0).alias("lost_before"), F.lit(False).alias("duplicate"), pid, sid),
        "trials": trials(spark, root).select("trial_id", "label", "valid", pid, sid),
        "cue_events": cues(spark, root).select("name", "trial_id", (F.col("trial_id") % 4 + 1).alias("session_no")).select("name", "trial_id", pid, sid),
        "calibration_blocks": s.where("k = 1").select(F.col("event_type").alias("label"), F.col("n").alias("start_sample"), F.lit(True).alias("valid"), pid, sid),
        "meta": s.groupBy("session_no").agg(F.lit("3.0").alias("schema_version"), F.lit(250).alias("sampling_rate")).select("schema_version", "sampling_rate", pid, sid),
    }
    for name, d in made.items():
        part(d)(f"{path}/{name}")
    return path


@query("s09_session_tables", views="samples trials cues", sql="""
SELECT 'emg_samples' AS "table", count(*) AS rows, count(DISTINCT session_no) AS sessions FROM samples UNION ALL SELECT 'imu_samples', count(*), count(DISTINCT session_no) FROM samples
UNION ALL SELECT 'events', count(*), count(DISTINCT session_no) FROM samples UNION ALL SELECT 'packet_audit', count(*), count(DISTINCT session_no) FROM samples
UNION ALL SELECT 'trials', count(*), count(DISTINCT session_no) FROM trials UNION ALL SELECT 'cue_events', count(*), count(DISTINCT trial_id%4) FROM cues
UNION ALL SELECT 'calibration_blocks', count(*), count(DISTINCT session_no) FROM samples WHERE k=1 UNION ALL SELECT 'meta', count(DISTINCT session_no), count(DISTINCT session_no) FROM samples""")
def s09(spark, root):
    tabs = S.register_session_tables(spark, session_root(spark, root))
    out = None
    for name, d in tabs.items():
        one = d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session_id").alias("sessions")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("table", "rows", "sessions")


@query("s11_time_slice", views="samples", sql="SELECT trial_id, n, t_ms FROM samples WHERE t_ms>=100 AND t_ms<250")
def s11(spark, root):
    return S.slice_rows(samples(spark, root), "t_ms", 100, 250).select("trial_id", "n", "t_ms")


@query("s11_trial_slice", views="samples", sql="""
WITH b AS (SELECT trial_id, max(t_ms)+5 hi FROM samples GROUP BY 1), p AS (SELECT s.trial_id, event_id, greatest(t_ms-12,0) a, least(t_ms+30, hi) b FROM samples s JOIN b USING (trial_id) WHERE event_type='signup')
SELECT p.trial_id, p.event_id, count(*) AS rows, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM p JOIN samples s ON s.trial_id=p.trial_id AND t_ms>=a AND t_ms<b GROUP BY 1,2""")
def s11b(spark, root):
    from ..operators.joins import small
    s = samples(spark, root).select("trial_id", "event_id", "event_type", "t_ms")
    hi = s.groupBy("trial_id").agg((F.max("t_ms") + 5).alias("hi"))
    tr = s.where("event_type = 'signup'").join(small(hi), "trial_id").select("trial_id", "event_id", F.col("t_ms").alias("a"), (F.col("t_ms") + 18).alias("b"), F.lit(0).alias("lo"), "hi")
    d = S.trial_slices(s.select("trial_id", "t_ms"), tr, ["trial_id"], "t_ms", "a", "b", 12, "lo", "hi", 256)
    return d.groupBy("trial_id", "event_id").agg(F.count(F.lit(1)).alias("rows"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


@query("s12_fingerprint", sql="""
SELECT sha256(string_agg(g || chr(0) || d, '' ORDER BY g)) AS fingerprint FROM (
SELECT substr(sha256(p), 1, 3) g, sha256(string_agg(p || chr(0) || h, '' ORDER BY p)) d FROM (SELECT CAST(doc_id AS VARCHAR) p, sha256(text) h FROM documents) GROUP BY 1)""")
def s12(spark, root):
    return S.fingerprint(table(spark, root, "documents"), "doc_id", "text")


@query("s13_corpus_upsert", sql="""
WITH o AS (SELECT o_orderkey AS dataset, o_custkey AS participant, o_orderkey%4 AS session, 'old' AS state, CAST(NULL AS VARCHAR) AS extra FROM orders WHERE o_orderkey%3<>0), n AS (SELECT o_orderkey, o_custkey, o_orderkey%4, 'new', o_orderpriority FROM orders WHERE o_orderkey%5=0)
SELECT * FROM o WHERE dataset NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""")
def s13(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("dataset"), F.col("o_custkey").alias("participant"), (F.col("o_orderkey") % 4).alias("session"), "o_orderpriority")
    old = o.where("dataset % 3 <> 0").drop("o_orderpriority").withColumn("state", F.lit("old"))
    new = o.where("dataset % 5 = 0").withColumnRenamed("o_orderpriority", "extra").withColumn("state", F.lit("new"))
    return S.upsert_corpus(old, new).select("dataset", "participant", "session", "state", "extra")


@query("s14_source_keys", sql="""
WITH f AS (SELECT page_id, page_id%9 s, page_id%10 d, page_id%5 p FROM pages), n AS (SELECT s, d, p, count(*) c FROM f GROUP BY 1,2,3),
g AS (SELECT a.s, b.d, c.p FROM range(1,8) a(s), range(1,9) b(d), range(1,5) c(p))
SELECT page_id, CAST(f.s AS INT) AS subject, CAST(f.d AS INT) AS day, CAST(f.p AS INT) AS posture, CASE WHEN NOT (f.s BETWEEN 1 AND 7 AND f.d BETWEEN 1 AND 8 AND f.p BETWEEN 1 AND 4) THEN 'out_of_range' WHEN c>1 THEN 'duplicate' ELSE 'ok' END AS status FROM f JOIN n USING (s,d,p)
UNION ALL SELECT NULL, CAST(s AS INT), CAST(d AS INT), CAST(p AS INT), 'missing' FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.s=g.s AND f.d=g.d AND f.p=g.p)""")
def s14(spark, root):
    p = table(spark, root, "pages").select("page_id", F.concat(F.lit("user_"), F.col("page_id") % 9, F.lit("_day_"), F.col("page_id") % 10, F.lit("_posture_"), F.col("page_id") % 5,
                                                               F.lit("_"), "url").alias("path"))
    files, missing = S.parse_source_keys(p, "path")
    return files.select("page_id", "subject", "day", "posture", "status").unionByName(
        missing.select(F.lit(None).cast("bigint").alias("page_id"), "subject", "day", "posture", F.lit("missing").alias("status")))


@query("s15_frame_decode", sql="""
SELECT event_id, CASE WHEN event_id%7=0 THEN 'BAD' WHEN event_id%2=0 THEN 'EMG' ELSE 'IMU' END AS kind, CASE WHEN event_id%7<>0 THEN CAST(event_id%256 AS INT) END AS seq,
 CASE WHEN event_id%7<>0 AND event_id%2=0 THEN (event_id*7919)%16777216 - CASE WHEN (event_id*7919)%16777216>=8388608 THEN 16777216 ELSE 0 END END AS emg3,
 CASE WHEN event_id%7<>0 AND event_id%2=1 THEN round(((event_id*31)%65536 - CASE WHEN (event_id*31)%65536>=32768 THEN 65536 ELSE 0 END)*0.0012::DOUBLE,6) END AS gyro1 FROM events""")
def s15(spark, root):
    e = F.col("event_id")
    h = lambda v, n: F.lpad(F.hex(v), n, "0")
    emg = F.concat(F.repeat(F.lit("000001"), 3), h((e * 7919) % 16_777_216, 6), F.repeat(F.lit("FFFFFF"), 4))
    imu = F.concat(F.lit("00000001"), h((e * 31) % 65_536, 4), F.repeat(F.lit("0000"), 9))
    sync = F.when(e % 7 == 0, "D2D2D1").otherwise("D2D2D2")
    frame = F.unhex(F.concat(sync, F.when(e % 2 == 0, "AA").otherwise("BB"), h(e % 256, 2), F.when(e % 2 == 0, emg).otherwise(imu)))
    d = S.decode_frames(table(spark, root, "events").select("event_id", frame.alias("frame")))
    return d.select("event_id", "kind", "seq", F.get("emg", F.lit(3)).alias("emg3"), F.round(F.get("gyro", F.lit(1)), 6).alias("gyro1"))


@query("s16_legacy_rates", views="samples", sql="""
SELECT trial_id, round(regr_slope(n, n/(249.0+trial_id%40)+ (k%3)*1e-5),4) AS rate_hz, regr_slope(n, n/(249.0+trial_id%40)+(k%3)*1e-5) BETWEEN 230 AND 270 AS usable FROM samples GROUP BY 1""")
def s16(spark, root):
    s = samples(spark, root).select("trial_id", "n", (F.col("n") / (249.0 + F.col("trial_id") % 40) + (F.col("k") % 3) * 1e-5).alias("sec"))
    d = S.legacy_rates(s, "trial_id", "n", "sec")
    return d.select("trial_id", F.round("rate_hz", 4).alias("rate_hz"), "usable")


@query("s16_legacy_import")
def s16b(spark, root):
    s = samples(spark, root)
    imu = s.select("trial_id", "n", F.col("c3").alias("v"))
    tr = s.where("n % 20 = 0").select("trial_id", F.col("event_id").alias("tid"), F.col("n").alias("rest_start"), (F.col("n") + 6).alias("prompt_start"), (F.col("n") + 20).alias("prompt_end"))
    d = S.import_legacy(s.select(F.col("trial_id").alias("sid"), "n", "c0"), imu.withColumnRenamed("trial_id", "sid"),
                        tr.withColumnRenamed("trial_id", "sid").withColumnRenamed("tid", "trial_id"), "sid", "c0")
    return d.select("sid", "trial_id", "segment", "i", r6("emg", "emg"), F.round("aligned", 6).alias("imu"), "valid")
