"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import labels as N
from ..functions import text as X
from ..functions.columns import r6
from ..operators import transforms as T
from ..operators import windows as W
from ..operators.joins import small
from ..operators.linking import cue_columns
from ..operators.ordered import micros, running, scan
from .q_b_ordered import BLK, day
from .registry import query
from .views import cues, pred, samples, table, trials


def pick(names, i):
    return F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))


@query("p01_split", sql="""
WITH s AS (SELECT o_orderkey, 'P1-S0' || (o_orderkey%6) AS sid, CASE o_orderkey%10 WHEN 0 THEN 'val' WHEN 1 THEN 'Test ' ELSE 'auto' END ex FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(ex))='val' THEN 'validation' WHEN lower(trim(ex)) IN ('train','test') THEN lower(trim(ex))
 WHEN sid LIKE '%1' OR sid LIKE '%2' THEN 'train' WHEN sid LIKE '%3' THEN 'validation' WHEN sid LIKE '%4' THEN 'test' END AS split FROM s""")
def p01(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.concat(F.lit("P1-S0"), F.col("o_orderkey") % 6).alias("sid"),
                                            F.when(F.col("o_orderkey") % 10 == 0, "val").when(F.col("o_orderkey") % 10 == 1, "Test ").otherwise("auto").alias("ex"))
    return o.select("o_orderkey", T.assign_split("sid", "ex").alias("split"))


ARM8, HAND5 = (*N.ARM_WORDS, "spin"), (*N.HAND_WORDS, "claw")
SQL_LIST = lambda names: "[" + ",".join(f"'{n}'" for n in names) + "]"


@query("p02_label_split", sql=f"""
WITH s AS (SELECT o_orderkey, o_orderkey%8 a, o_orderkey%5 h FROM orders)
SELECT o_orderkey, {SQL_LIST(ARM8)}[a+1] || '_' || {SQL_LIST(HAND5)}[h+1] AS label, CASE WHEN a<7 AND h<4 THEN CAST(a AS INT) END AS direction, CASE WHEN a<7 AND h<4 THEN CAST(h AS INT) END AS gesture FROM s""")
def p02(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.concat(
        pick(ARM8, F.col("o_orderkey") % 8), F.lit("_"), pick(HAND5, F.col("o_orderkey") % 5)).alias("label"))
    d, g = N.split_label("label")
    return o.select("o_orderkey", "label", d.alias("direction"), g.alias("gesture"))


WORDS = (" Relax", "REST", "no movement", "hand close ", "close", "fist", "Hand Open", "open", "pinch", "pinch grip", "wave", "point")


@query("p03_canonical_label", sql=f"""
WITH s AS (SELECT doc_id, {SQL_LIST(WORDS)}[(doc_id + n_chars)%12+1] AS w FROM documents)
SELECT doc_id, CASE WHEN i<=3 THEN 'neutral' WHEN i<=6 THEN 'fist' WHEN i<=8 THEN 'open' ELSE 'pinch' END AS canonical, CAST(NULL AS VARCHAR) AS unmapped
FROM (SELECT doc_id, (doc_id+n_chars)%12+1 i FROM documents) WHERE i<=10 UNION ALL SELECT DISTINCT NULL::BIGINT, NULL, w FROM s WHERE w IN ('wave','point')""")
def p03(spark, root):
    d = table(spark, root, "documents").select("doc_id", pick(WORDS, (F.col("doc_id") + F.col("n_chars")) % 12).alias("w"))
    good, bad = N.canonical(d, "w", N.GESTURE_ALIASES)
    return good.select("doc_id", "canonical", F.lit(None).cast("string").alias("unmapped")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("canonical"), F.col("w").alias("unmapped")))


@query("p04_sample_rules", views="samples", sql="""
WITH d AS (SELECT *, CASE WHEN k=7 THEN 'nan'::DOUBLE ELSE c0 END v, k/90.0 q, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY trial_id ORDER BY n))/1e9 st FROM samples),
f AS (SELECT trial_id, count(*) r, count(*) FILTER (WHERE isnan(v)) nf, count(*) FILTER (WHERE st<=0) bk, count(*) FILTER (WHERE q>1) bq, median(st) md FROM d GROUP BY 1)
SELECT trial_id, 'too_short' AS rule, r AS rows FROM f WHERE r<70 UNION ALL SELECT trial_id, 'not_finite', nf FROM f WHERE nf>0 UNION ALL SELECT trial_id,'time_not_increasing', bk FROM f WHERE bk>0
UNION ALL SELECT trial_id,'quality_range', bq FROM f WHERE bq>0 UNION ALL SELECT trial_id,'rate',1 FROM f WHERE abs(1000.0/md-50)>2.5""")
def p04(spark, root):
    s = samples(spark, root).select("trial_id", "n", "blk", F.when(F.col("k") == 7, F.lit(float("nan"))).otherwise(F.col("c0")).alias("v"),
                                    (F.col("k") / 90.0).alias("q"), (micros("ts") / F.lit(1e9)).alias("t"))
    return T.sample_rules(s, "trial_id", "n", "t", ["v"], "q", BLK, rate=50.0, minimum=70)


@query("p05_label_normalise", views="samples", sql="""
SELECT trial_id, n, CASE WHEN trial_id%9-1 BETWEEN -1 AND 6 THEN CAST(trial_id%9-1 AS INT) END AS direction FROM samples""")
def p05(spark, root):
    # one scalar label per trial, repeated for its samples; codes outside the enum are NULL
    code = F.col("trial_id") % 9 - 1
    return samples(spark, root).select("trial_id", "n", F.when(code.between(-1, len(N.DIRECTIONS) - 1), code.cast("int")).alias("direction"))


@query("p06_window_eligibility", views="samples win", sql="""
WITH v AS (SELECT trial_id, j, k%7-1 lab, count(*) c FROM win WHERE k%7-1>=0 GROUP BY 1,2,3), m AS (SELECT trial_id, j, lab FROM (SELECT *, row_number() OVER (PARTITION BY trial_id,j ORDER BY c DESC, lab) r FROM v) WHERE r=1),
a AS (SELECT trial_id, j, avg((k>=5)::INT) st, avg(1-(k%10)/30.0) q, avg((k<3)::INT) ms, bool_and(k<>99) tv, avg((k<>3)::INT) iv FROM win GROUP BY 1,2)
SELECT a.trial_id, a.j, a.trial_id%11<>0 AS gate, CAST(lab AS INT) AS label FROM a JOIN m USING (trial_id,j) WHERE st>=0.9 AND q>=0.8 AND ms<=0.1 AND tv AND iv>=0.9""")
def p06(spark, root):
    s = samples(spark, root).select(
        "trial_id", "n", (F.col("k") >= 5).alias("stable"), (1 - (F.col("k") % 10) / 30.0).alias("quality"),
        (F.col("k") < 3).alias("missing"), (F.col("k") != 99).alias("time_ok"), (F.col("k") != 3).alias("imu_ok"), (F.col("k") % 7 - 1).alias("label"))
    w = W.window_agg(s, ["trial_id"], [W.label_mode("label").alias("label"), *W.eligible("stable", "quality", "missing", "time_ok", "imu_ok")], size=8, hop=4)
    return w.where("ok_stable AND ok_quality AND ok_missing AND ok_time AND ok_imu AND label >= 0").select("trial_id", "j", (F.col("trial_id") % 11 != 0).alias("gate"), "label")


# (source, rate, commercial use allowed, channel policy)
SOURCES = [(0, 500.0, True, "adapter"), (1, 200.0, False, "circular_8"), (2, 200.0, True, "circular_8"), (3, 200.0, True, "split"),
           (4, 100.0, True, "circular_8"), (5, 2000.0, False, "reference")]


@query("p07_source_policy", sql="""
WITH s AS (SELECT vec_id, vec_id%6 src, embedding e FROM embeddings)
SELECT vec_id, 0 AS domain, round(list_sum(e[1:8]),4) AS total FROM s WHERE src IN (2,3) UNION ALL SELECT vec_id, 1, round(list_sum(e[9:16]),4) FROM s WHERE src=3""".replace(
    "list_sum(e[1:8])", "list_sum(list_transform(e[1:8], lambda x: x::DOUBLE))").replace("list_sum(e[9:16])", "list_sum(list_transform(e[9:16], lambda x: x::DOUBLE))"))
def p07(spark, root):
    reg = spark.createDataFrame(SOURCES, "src bigint, rate_hz double, commercial_allowed boolean, policy string")
    e = table(spark, root, "embeddings").select("vec_id", (F.col("vec_id") % 6).alias("src"), F.slice(C.as_doubles("embedding"), 1, 16).alias("x"))
    rows, _ = T.apply_source_policy(e, reg, "src", "x", commercial=True)
    return rows.select("vec_id", "domain", F.round(C.total(F.col("x")), 4).alias("total"))


SWIPES = ("thumb_tap", "thumb_swipe_up", "thumb_swipe_left", "thumb_swipe_right", "index_press", "other")


@query("p08_anatomical_name", sql=f"""
WITH s AS (SELECT event_id, {SQL_LIST(SWIPES)}[event_id%6+1] nm, CASE WHEN user_id%3=0 THEN 'left' ELSE 'right' END h FROM events)
SELECT event_id, CASE nm WHEN 'thumb_tap' THEN 'thumb_click' WHEN 'thumb_swipe_up' THEN 'thumb_up' WHEN 'thumb_swipe_left' THEN CASE h WHEN 'left' THEN 'thumb_out' ELSE 'thumb_in' END
 WHEN 'thumb_swipe_right' THEN CASE h WHEN 'left' THEN 'thumb_in' ELSE 'thumb_out' END ELSE nm END AS name FROM s""")
def p08(spark, root):
    e = table(spark, root, "events").select("event_id", pick(SWIPES, F.col("event_id") % 6).alias("nm"),
                                            F.when(F.col("user_id") % 3 == 0, "left").otherwise("right").alias("h"))
    return e.select("event_id", N.anatomical_name("nm", "h").alias("name"))


@query("p09_quality_flags", views="samples win", sql="""
SELECT trial_id, j, 8 + CASE WHEN bool_and(k<>99) THEN 1 ELSE 0 END + CASE WHEN avg(c0)>0 THEN 2 ELSE 0 END + CASE WHEN avg(c3)>0 THEN 4 ELSE 0 END
 + CASE WHEN bool_or(k=3) THEN 16 ELSE 0 END + CASE WHEN min(k)<2 THEN 512 ELSE 0 END AS flags,
 bool_and(k<>99) AND avg(c0)>0 AND avg(c3)>0 AS valid FROM win GROUP BY 1,2""")
def p09(spark, root):
    w = W.window_agg(samples(spark, root).select("trial_id", "n", "k", "c0", "c3"), ["trial_id"], [N.quality_flags({
        "calibrated": F.lit(True), "timestamp_valid": F.bool_and(F.col("k") != 99), "emg_valid": W.ordered_mean("c0") > 0,
        "imu_valid": W.ordered_mean("c3") > 0, "interpolated_imu": F.bool_or(F.col("k") == 3), "bad_channels": F.min("k") < 2}).alias("flags")], size=8, hop=4)
    return w.select("trial_id", "j", "flags", N.flags_valid("flags").alias("valid"))


STATE_SQL = """st AS (SELECT vec_id*40 t_ms, CASE WHEN pred<0 THEN -1 ELSE pred%7 END d, CASE WHEN pred<0 THEN -1 ELSE truth%4 END g, vec_id%7-1 ap, vec_id%6 hp, q*2-0.2 act, 1.1-q mo, vec_id%3-1 cs,
 CASE WHEN vec_id%3=0 THEN NULL ELSE q*1.5 END sc, q FROM pred)"""


def states(spark, root):
    p = pred(spark, root)
    q = F.col("q")
    return p.select("vec_id", (F.col("vec_id") * 40).alias("t_ms"), F.when(F.col("pred") < 0, -1).otherwise(F.col("pred") % 7).alias("direction"),
                    F.when(F.col("pred") < 0, -1).otherwise(F.col("truth") % 4).alias("gesture"), (F.col("vec_id") % 7 - 1).alias("arm_phase"),
                    (F.col("vec_id") % 6).alias("hand_phase"), (q * 2 - 0.2).alias("activation"), (1.1 - q).alias("motion"),
                    (F.col("vec_id") % 3 - 1).alias("consistency"), F.when(F.col("vec_id") % 3 != 0, q * 1.5).alias("score"), q.alias("q_direction"),
                    (q / 2).alias("q_gesture"), q.alias("q_arm"), q.alias("q_hand"), q.alias("emg_quality"), (1 - q).alias("imu_quality"),
                    (F.col("vec_id") % 16384).alias("flags"))


@query("p10_state_record", views="pred", sql=f"""
WITH {STATE_SQL} SELECT t_ms AS timestamp_ms, CASE WHEN d<0 THEN 'unknown' ELSE {SQL_LIST(N.DIRECTIONS)}[d+1] END AS direction, CASE WHEN g<0 THEN 'unknown' ELSE {SQL_LIST(N.GESTURES)}[g+1] END AS gesture,
 CASE WHEN ap<0 THEN 'unknown' ELSE {SQL_LIST(N.PHASES)}[ap+1] END AS arm_phase, {SQL_LIST(N.PHASES)}[hp+1] AS hand_phase, round(least(greatest(act,0),1),6) AS activation, round(least(greatest(mo,0),1),6) AS motion,
 CASE WHEN cs<0 THEN 'unknown' WHEN cs=0 THEN 'normal' ELSE 'atypical' END AS consistency, round(CASE WHEN sc IS NULL THEN -1.0 ELSE least(greatest(sc,0),1) END,6) AS consistency_score,
 round(q,6) AS q_direction, round(q/2,6) AS q_gesture, round(q,6) AS q_arm, round(q,6) AS q_hand, round(q,6) AS emg_quality, round(1-q,6) AS imu_quality, (t_ms//40)%16384 AS flags FROM st""")
def p10(spark, root):
    d = T.project_state(states(spark, root))
    return d.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("p11_legacy_record", views="pred", sql=f"""
WITH {STATE_SQL} SELECT t_ms AS timestamp_ms, greatest(0,d) AS gesture_id, round(q,6) AS q_direction, round(least(greatest(mo,0),1),6) AS motion, round(least(greatest(act,0),1),6) AS activation FROM st""")
def p11(spark, root):
    d = T.project_legacy(states(spark, root))
    return d.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("p12_emg_calibration", views="samples", sql="""
WITH c AS (SELECT session_no, avg(c0) m0, avg(c1) m1, avg(c2) m2, avg(c3) m3, max(abs(c0)) s0, max(abs(c1)) s1, max(abs(c2)) s2, max(abs(c3)) s3 FROM samples GROUP BY 1),
x AS (SELECT s.trial_id, s.n, session_no, [(c0-m0)/s0,(c1-m1)/s1,(c2-m2)/s2,(c3-m3)/s3] a, [(c0-m0)/s0,(c1-m1)/s0,(c2-m2)/s0,(c3-m3)/s0] g FROM samples s JOIN c USING (session_no)),
y AS (SELECT *, CASE WHEN session_no=2 THEN g ELSE a END v FROM x)
SELECT trial_id, n, round(v[(0-session_no+8)%4+1],6) AS x0, round(v[(1-session_no+8)%4+1],6) AS x1, round(v[(2-session_no+8)%4+1],6) AS x2, round(v[(3-session_no+8)%4+1],6) AS x3 FROM y""")
def p12(spark, root):
    s = samples(spark, root)
    ch = ("c0", "c1", "c2", "c3")
    cal = s.groupBy("session_no").agg(F.array(*[F.avg(c) for c in ch]).alias("center"), F.array(*[F.max(F.abs(F.col(c))) for c in ch]).alias("scale"))
    cal = cal.withColumn("mode", F.when(F.col("session_no") == 2, "global").otherwise("per_channel"))
    d = s.join(small(cal), "session_no")
    v = T.calibrate_emg(F.array(*ch), "center", "scale", F.col("session_no").cast("int"), "mode", F.get("scale", F.lit(0)))
    return d.select("trial_id", "n", v.alias("v")).select("trial_id", "n", *[r6(F.get("v", F.lit(i)), f"x{i}") for i in range(4)])


@query("p13_imu_calibration", views="samples", sql="""
WITH g AS (SELECT session_no, avg(c0) g0, avg(c1) g1, avg(c2) g2 FROM samples GROUP BY 1)
SELECT trial_id, n, round((0.8*(c0-g0)-0.6*(c1-g1))/2.5,6) AS x0, round((0.6*(c0-g0)+0.8*(c1-g1))/2.5,6) AS x1, round((c2-g2)/2.5,6) AS x2 FROM samples JOIN g USING (session_no)""")
def p13(spark, root):
    s = samples(spark, root)
    cal = s.groupBy("session_no").agg(F.array(F.avg("c0"), F.avg("c1"), F.avg("c2")).alias("gravity"))
    cal = cal.withColumn("rot", F.array(*[F.array(*[F.lit(x) for x in r]) for r in ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0))]))
    d = s.join(small(cal), "session_no").select("trial_id", "n", T.rotate(F.array("c0", "c1", "c2"), "gravity", "rot", F.lit(2.5)).alias("v"))
    return d.select("trial_id", "n", *[r6(F.get("v", F.lit(i)), f"x{i}") for i in range(3)])


@query("p14_sanitise", views="samples", sql="""
SELECT trial_id, n, CASE WHEN k%10=3 THEN 0.0 ELSE round(c0,6) END AS e0, CASE WHEN k%10=4 THEN 0.0 ELSE round(c3,6) END AS i0, k%10 IN (3,4) AS missing, k%10<>4 AS imu_valid, CASE WHEN k%10=3 THEN 0.0 ELSE 1.0 END::DOUBLE AS q0 FROM samples""")
def p14(spark, root):
    s = samples(spark, root)
    bad = s.select("trial_id", "n", F.array(F.when(F.col("k") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("c0")), F.col("c1")).alias("emg"),
                   F.array(F.when(F.col("k") % 10 == 4, F.lit(float("inf"))).otherwise(F.col("c3"))).alias("imu"), F.array(F.lit(1.0), F.lit(1.0)).alias("q"))
    d = T.sanitise(bad, "emg", "imu", "q")
    return d.select("trial_id", "n", r6(F.get("safe_emg", F.lit(0)), "e0"), r6(F.get("safe_imu", F.lit(0)), "i0"), "missing", "imu_valid",
                    F.get("channel_quality", F.lit(0)).alias("q0"))


@query("p15_reinhard", views="samples", sql="SELECT trial_id, n, round(64*c0/(32+abs(c0)),6) AS y FROM samples")
def p15(spark, root):
    return samples(spark, root).select("trial_id", "n", r6(C.reinhard("c0"), "y"))


@query("p16_augment")
def p16(spark, root):
    x = C.as_doubles("embedding")
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode(F.array(*[F.slice(x, 8 * i + 1, 8) for i in range(8)])).alias("part", "x"))
    e = e.select((F.col("vec_id") * 8 + F.col("part")).alias("vec_id"), "x")  # eight windows of eight channels to a row
    return T.augment(e, "vec_id", "x", seed=7).select("vec_id", *[F.get("augmented", F.lit(i)).alias(f"a{i}") for i in range(8)])


@query("p17_channel_quality", sql="""
WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: greatest(x::DOUBLE,0)) sat, list_transform(embedding[9:16], lambda x: abs(x::DOUBLE)*4) z, list_transform(embedding[17:24], lambda x: abs(x::DOUBLE)*2) m FROM embeddings)
SELECT vec_id, vec_id%10<>0 AND vec_id%4<>0 AS gate, CASE WHEN vec_id%10=0 THEN 0.0::DOUBLE ELSE CAST((SELECT sum((sat[i]<=0 AND z[i]<=0.98 AND m[i]<=0.35)::INT) FROM range(1,9) r(i)) AS DOUBLE) END AS good FROM s""")
def p17(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", C.as_doubles("embedding").alias("e"))
    pos = lambda a, b, f: F.transform(F.slice("e", a, b), f)
    rep = F.to_json(F.struct((F.col("vec_id") % 4 != 0).alias("passed"), pos(1, 8, lambda x: F.greatest(x, F.lit(0.0))).alias("saturation_ratio"),
                             pos(9, 8, lambda x: F.abs(x) * 4).alias("zero_ratio"), pos(17, 8, lambda x: F.abs(x) * 2).alias("mains_50hz_ratio")))
    d = e.select("vec_id", F.when(F.col("vec_id") % 10 == 0, "").otherwise(rep).alias("rep"))
    gate, q = T.channel_quality("rep")
    return d.select("vec_id", gate.alias("gate"), C.total(q).alias("good"))


@query("p18_interval_padding", views="samples", sql="SELECT trial_id, n, t_ms-50 AS a, t_ms+250 AS b FROM samples")
def p18(spark, root):
    return samples(spark, root).select("trial_id", "n", (F.col("t_ms") - 50).alias("a"), (F.col("t_ms") + 250).alias("b"))


@query("p19_sample_time", views="samples", sql="""
SELECT trial_id, n, min(epoch_us(ts)*1000) OVER (PARTITION BY trial_id) + CAST(round_even(n*1e9/224.7,0) AS BIGINT) AS t_ns FROM samples""")
def p19(spark, root):
    s = samples(spark, root).withColumn("ns", micros("ts") * 1000)
    # the first received time travels along the chunks; no window over a whole session
    s = scan(s, ["trial_id"], ["n"], {"origin": running("min", "ns")}, BLK)
    return s.select("trial_id", "n", (F.col("origin") + F.rint(F.col("n") * 1e9 / 224.7).cast("bigint")).alias("t_ns"))


@query("p20_effort", views="samples", sql="""
SELECT trial_id, n, floor(least(greatest((c0+40)/((CAST(k AS DOUBLE)+10+40)/CAST(0.85 AS DOUBLE)),0),1)*1000000+0.5)/1000000 AS effort FROM samples""")
def p20(spark, root):
    e = T.effort("c0", F.lit(-40.0), F.col("k") + 10.0)
    return samples(spark, root).select("trial_id", "n", (F.floor(e * 1_000_000 + 0.5) / 1_000_000).alias("effort"))


@query("p21_clean_frames", sql="""
SELECT event_id, CASE WHEN least(greatest(value/300,0),1)<0.55 THEN 0 ELSE event_id%11 END AS gesture_id, round(least(greatest(value/300,0),1),6) AS confidence FROM events WHERE event_id%11<=8""")
def p21(spark, root):
    e = table(spark, root, "events").select("event_id", (F.col("event_id") % 11).alias("gesture_id"), (F.col("value") / 300).alias("confidence"))
    return T.clean_frames(e, "gesture_id", "confidence").select("event_id", "gesture_id", r6("confidence", "confidence"))


@query("p22_cue_labels", views="trials cues", sql="""
WITH c AS (SELECT trial_id, min(date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE))) FILTER (WHERE name LIKE 'arm:%') ac, min(date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE))) FILTER (WHERE name LIKE 'hand:%') hc FROM cues GROUP BY 1),
t AS (SELECT trial_id, date_diff('day', DATE '1970-01-01', CAST(start_ts AS DATE)) a, CAST(label[1:1] AS INT) dg, ac, hc FROM trials LEFT JOIN c USING (trial_id)),
s AS (SELECT *, a+o t, a+10 lo, a+80 hi, CASE WHEN dg=4 THEN 0 ELSE dg END dl, dg%4 gl FROM t, range(0,101,5) r(o)),
y AS (SELECT *, t>=lo AND t<hi pr, dl=0 st, gl=0 rs FROM s),
z AS (SELECT *, coalesce(pr AND NOT st AND t>=ac+12 AND t<least(hi,ac+62),false) aa, coalesce(pr AND NOT st AND t>=ac AND t<ac+12,false) ao, coalesce(pr AND NOT rs AND t>=hc+15,false) hh, coalesce(pr AND NOT rs AND t>=hc AND t<hc+15,false) ho FROM y),
r AS (SELECT trial_id, t, pr, CASE WHEN t<lo OR (pr AND st) THEN 0 WHEN aa THEN dl ELSE -1 END d, CASE WHEN t<lo OR (pr AND rs) THEN 0 WHEN hh THEN gl ELSE -1 END g,
 CASE WHEN t<lo THEN 0 WHEN t>=hi THEN 4 WHEN pr AND st THEN 3 WHEN ao THEN 1 WHEN aa THEN 2 ELSE 5 END ap, CASE WHEN t<lo THEN 0 WHEN t>=hi THEN 4 WHEN pr AND rs THEN 3 WHEN ho THEN 1 WHEN hh THEN 3 ELSE 5 END hp FROM z)
SELECT trial_id, t, d AS direction, g AS gesture, ap AS arm_phase, hp AS hand_phase, pr AND d<>-1 AND g<>-1 AS stable FROM r""")
def p22(spark, root):
    c = cues(spark, root).withColumn("d", day("cue_ts"))
    first = lambda k: F.min(F.when(F.col("name").startswith(k), F.col("d")))
    c = c.groupBy("trial_id").agg(first("arm:").alias("arm_cue"), first("hand:").alias("hand_cue"))
    digit = F.substring("label", 1, 1).cast("int")
    t = trials(spark, root).select("trial_id", day("start_ts").alias("a"), F.when(digit == 4, 0).otherwise(digit).alias("direction_label"),
                                   (digit % 4).alias("gesture_label")).join(c, "trial_id", "left")
    s = t.select("*", F.explode(F.sequence(F.col("a"), F.col("a") + 100, F.lit(5))).alias("t"), (F.col("a") + 10).alias("prompt_from"), (F.col("a") + 80).alias("prompt_to"))
    return T.cue_labels(s, 12, 50, 15).select("trial_id", "t", "direction", "gesture", "arm_phase", "hand_phase", "stable")


@query("p23_vocabulary_filter", sql=f"""
WITH s AS (SELECT event_id, {SQL_LIST((*N.EVENT_GESTURES, 'rest', 'noise'))}[event_id%11+1] nm, value FROM events)
SELECT event_id, CAST(event_id%11 AS INT) AS class FROM s WHERE event_id%11<9 AND value>=1 AND value<200""")
def p23(spark, root):
    names = (*N.EVENT_GESTURES, "rest", "noise")
    e = table(spark, root, "events").where("value >= 1 AND value < 200").select("event_id", pick(names, F.col("event_id") % 11).alias("nm"))
    return e.withColumn("class", N.code_of(N.EVENT_GESTURES, "nm")).where("class IS NOT NULL").select("event_id", "class")


# ---- scalar functions ----
def q_lit(s):
    return "'" + s.replace("'", "''") + "'"


def _cleaned():
    x = "text"
    for a, b in (("".join(X.FOLDED), "".join(X.FOLDED.values())),):
        x = f"translate({x}, {q_lit(a)}, {q_lit(b)})"
    keep = "".join("\\" + c if c in "[]\\^-" else c for c in X.VOCABULARY)
    return f"regexp_replace({x}, {q_lit('[^' + keep + ']')}, '', 'g')"


@query("x01_clean_text", sql=f"SELECT doc_id, {_cleaned()} AS clean FROM documents")
def x01(spark, root):
    return table(spark, root, "documents").select("doc_id", X.clean_text("text").alias("clean"))


@query("x02_text_labels", sql=f"""
WITH c AS (SELECT doc_id, {_cleaned()} AS clean FROM documents), u AS (SELECT doc_id, unnest(string_split(clean,'')) ch FROM c)
SELECT c.doc_id, coalesce(any_value(s.n),0) AS n, coalesce(any_value(s.t),0) AS total, true AS same FROM c LEFT JOIN
 (SELECT doc_id, count(*) n, CAST(sum(instr({q_lit(''.join(X.VOCABULARY))}, ch)-1) AS BIGINT) t FROM u WHERE ch<>'' GROUP BY 1) s USING (doc_id) GROUP BY 1""")
def x02(spark, root):
    d = table(spark, root, "documents").select("doc_id", X.clean_text("text").alias("clean"))
    d = d.withColumn("ids", X.encode_text("clean"))
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                    (X.decode_text("ids") == F.col("clean")).alias("same"))


@query("x04_sigmoid", views="samples", sql="SELECT trial_id, n, round(1/(1+exp(-c0/25)),6) AS y FROM samples")
def x04(spark, root):
    return samples(spark, root).select("trial_id", "n", r6(C.sigmoid(F.col("c0") / 25), "y"))


@query("x05_clamp", views="samples", sql="SELECT trial_id, n, round(least(greatest(c0/40,0),1),6) AS y FROM samples")
def x05(spark, root):
    return samples(spark, root).select("trial_id", "n", r6(C.clamp01(F.col("c0") / 40), "y"))


@query("x06_roll", sql="""
SELECT vec_id, round(embedding[(0-vec_id%8+64)%64+1]::DOUBLE,6) AS r0, round(embedding[(5-vec_id%8+64)%64+1]::DOUBLE,6) AS r5 FROM embeddings""")
def x06(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", C.roll(C.as_doubles("embedding"), (F.col("vec_id") % 8).cast("int")).alias("r"))
    return e.select("vec_id", r6(F.get("r", F.lit(0)), "r0"), r6(F.get("r", F.lit(5)), "r5"))


@query("x07_cosine", sql="""
WITH u AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE a, unnest(embedding[33:64])::DOUBLE b FROM embeddings), m AS (SELECT *, a-avg(a) OVER (PARTITION BY vec_id) x, b-avg(b) OVER (PARTITION BY vec_id) y FROM u)
SELECT vec_id, round(sum(x*y)/(sqrt(sum(x*x))*sqrt(sum(y*y))),6) AS cos, round(sqrt(sum(a*a)),6) AS norm, round(sum(a*b),6) AS dot FROM m GROUP BY 1""")
def x07(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return e.select("vec_id", r6(C.cosine("a", "b"), "cos"), r6(C.norm("a"), "norm"), r6(C.dot("a", "b"), "dot"))


@query("x08_circular_diagonals", sql="""
WITH s AS (SELECT vec_id, embedding e, unnest(range(0,32)) p FROM embeddings) SELECT vec_id, p AS pos, round(e[(p%8)*8+((p%8)+p//8)%8+1]::DOUBLE,6) AS v FROM s""")
def x08(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode(C.circular_diagonals("embedding")).alias("pos", "v"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("v", "v"))


@query("x09_rint", views="samples", sql="SELECT trial_id, n, CAST(round_even(k/2.0,0) AS BIGINT) AS r FROM samples")
def x09(spark, root):
    return samples(spark, root).select("trial_id", "n", F.rint(F.col("k") / 2).cast("bigint").alias("r"))


@query("x10_session_date", sql="""
SELECT o_custkey, count(DISTINCT left(CAST(o_orderdate AS VARCHAR),10)) AS dates, count(DISTINCT left(CAST(o_orderdate AS VARCHAR),10))>=2 AS enough, min(left(CAST(o_orderdate AS VARCHAR),10)) AS first_date FROM orders GROUP BY 1""")
def x10(spark, root):
    d = table(spark, root, "orders").select("o_custkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("d"))
    n = F.countDistinct("d")
    return d.groupBy("o_custkey").agg(n.alias("dates"), (n >= 2).alias("enough"), F.min("d").alias("first_date"))


@query("x11_json_field", sql="""
SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k, json_extract_string(props,'$.none') AS missing, event_id%9=0 AS problem FROM events""")
def x11(spark, root):
    e = table(spark, root, "events").select("event_id", F.col("props"), F.when(F.col("event_id") % 9 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("raw"))
    return e.select("event_id", C.json_field("props", "$.k").cast("int").alias("k"), C.json_field("props", "$.none").alias("missing"),
                    F.from_json("raw", "k int").getField("k").isNull().alias("problem"))


@query("x12_map_lookup", sql="""
SELECT event_id, CASE event_type WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.5 WHEN 'error' THEN 0.7 END::DOUBLE AS threshold FROM events""")
def x12(spark, root):
    return table(spark, root, "events").select("event_id", N.lookup({"view": 0.3, "click": 0.5, "error": 0.7}, F.col("event_type")).alias("threshold"))


@query("x13_bit_tests", sql="""
SELECT event_id, (event_id & 4)<>0 AS has_2, CAST(bit_count(event_id) AS INT) AS bits, (event_id & 7)=7 AS valid FROM events""")
def x13(spark, root):
    return table(spark, root, "events").select("event_id", C.has_flag("event_id", 2).alias("has_2"), F.bit_count("event_id").alias("bits"),
                                               N.flags_valid("event_id").alias("valid"))


@query("x14_sha256", sql="SELECT doc_id, sha256(text) AS digest FROM documents")
def x14(spark, root):
    return table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("x15_regex_keys", sql=r"""
SELECT page_id, CAST(nullif(regexp_extract(url,'/([0-9]+)',1),'') AS INT) AS number, regexp_extract(url,'^https?://([^/]+)',1) AS host, regexp_matches(regexp_extract(url,'^https?://([^/]+)',1),'^[A-Za-z0-9_.-]+$') AS safe FROM pages""")
def x15(spark, root):
    p = table(spark, root, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    num = F.regexp_extract("url", r"/([0-9]+)", 1)
    return p.select("page_id", F.when(num != "", num.cast("int")).alias("number"), host.alias("host"), host.rlike(r"^[A-Za-z0-9_.-]+$").alias("safe"))


@query("x16_log_grid_db", sql="""
WITH s AS (SELECT vec_id, unnest(range(0,5)) i FROM embeddings) SELECT vec_id, i AS pos, round(0.25*power(16.0,i/4.0),6) AS t, round(10*log10(0.25*power(16.0,i/4.0)*(vec_id+1)),6) AS db FROM s""")
def x16(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode(C.log_grid(0.25, 4.0, 5)).alias("pos", "t"))
    return e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("t", "t"), r6(C.decibel(F.col("t") * (F.col("vec_id") + 1)), "db"))


@query("x17_int24", sql="SELECT event_id, (event_id*7919)%16777216 - CASE WHEN (event_id*7919)%16777216>=8388608 THEN 16777216 ELSE 0 END AS v FROM events")
def x17(spark, root):
    raw = F.unhex(F.lpad(F.hex((F.col("event_id") * 7919) % 16_777_216), 6, "0"))
    return table(spark, root, "events").select("event_id", C.int24(raw).alias("v"))


@query("x18_profile_scores", views="samples", sql="""
WITH p AS (SELECT trial_id, n, least(greatest(abs(c0)/100,0),1) m, k/100.0 e, k*20 h FROM samples)
SELECT trial_id, n, round(0.55*m+0.45*e,6) AS energy, round(0.7*m+0.3*e,6) AS density, round(least(h/1400.0,1),6) AS legato,
 CAST(round_even(m*15,0) AS BIGINT)*256 + CAST(round_even(e*15,0) AS BIGINT)*16 + least(15, CAST(round_even(h/100.0,0) AS BIGINT)) AS signature FROM p""")
def x18(spark, root):
    from ..functions.music import profile_scores
    s = samples(spark, root).select("trial_id", "n", C.clamp01(F.abs(F.col("c0")) / 100).alias("motion"), (F.col("k") / 100.0).alias("muscle"), (F.col("k") * 20).alias("hold_ms"))
    return s.select("trial_id", "n", *profile_scores("motion", "muscle", "hold_ms"))
