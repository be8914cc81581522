"""Features, quality, calibration and reports."""

from pyspark.sql import functions as F

from ..functions import labels as N
from ..functions import signal as G
from ..functions.columns import clamp01, r6
from ..operators import calibration as K
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import windows as W
from ..operators.joins import small
from ..operators.ordered import block, exact_quantiles, micros, number_rows, time_slot
from .q_b_ordered import BLK, day
from .registry import VIEWS, query
from .views import cues, long_samples, pred, samples, table, trials

CH = ("c0", "c1", "c2", "c3")
LONG = "lg AS (SELECT trial_id, session_no, event_type, k, n, unnest([0,1,2,3]) ch, unnest([c0,c1,c2,c3]) x FROM samples)"
WLONG = "wl AS (SELECT trial_id, j, n, unnest([0,1,2,3]) ch, unnest([c0,c1,c2,c3]) x FROM win)"


def windowed(spark, root, aggs):
    s = samples(spark, root).select("trial_id", "n", "k", *CH)
    return W.window_agg(s, ["trial_id"], aggs, size=8, hop=4)


@query("a01_emg_features", views="samples win", sql=f"""
WITH {WLONG}, o AS (SELECT *, lag(x) OVER w p, lag(x,2) OVER w p2 FROM wl WINDOW w AS (PARTITION BY trial_id,j,ch ORDER BY n)),
t AS (SELECT *, greatest(0.1*median(abs(x)) OVER (PARTITION BY trial_id,j,ch), 1e-6) th FROM o),
f AS (SELECT trial_id, j, ch, sqrt(avg(x*x)) rms, avg(abs(x)) mav, sum(abs(x-p))/7 wlen, sum((p*x<0 AND abs(x-p)>=th)::INT)/7.0 zc,
 sum(((p-p2)*(x-p)<0 AND abs((x-p)-(p-p2))>=th)::INT)/6.0 ssc FROM t GROUP BY 1,2,3)
SELECT trial_id, j, CAST(ch AS INT) AS ch, round(rms,6) AS rms, round(mav,6) AS mav, round(wlen,6) AS wl, round(zc,6) AS zc, round(ssc,6) AS ssc,
 round(rms*rms/greatest(sum(rms*rms) OVER (PARTITION BY trial_id,j),1e-12),6) AS energy_share FROM f""")
def a01(spark, root):
    s = samples(spark, root).select("trial_id", "n", *CH)
    # one ordered array per window, then arrays per channel; the shuffle carries each sample once per window
    w = W.window_agg(s, ["trial_id"], [F.array_sort(F.collect_list(F.struct("n", *CH))).alias("rows")], size=8, hop=4)
    one = w.select("trial_id", "j", F.posexplode(F.array(*[F.col("rows")[c] for c in CH])).alias("ch", "x"))
    f = one.select("trial_id", "j", "ch", *G.emg_array_features("x"))
    e = F.col("rms") * F.col("rms")
    from pyspark.sql import Window
    every = F.sum(e).over(Window.partitionBy("trial_id", "j"))  # one row per channel
    return f.select("trial_id", "j", "ch", *[r6(c, c) for c in ("rms", "mav", "wl", "zc", "ssc")], r6(e / F.greatest(every, F.lit(1e-12)), "energy_share"))


@query("a02_imu_features", views="samples win", sql=f"""
WITH {WLONG} SELECT trial_id, j, CAST(ch AS VARCHAR) AS axis, round(avg(x),6) AS mean, round(stddev_pop(x),5) AS std, round(sqrt(avg(x*x)),6) AS rms, round(max(abs(x)),6) AS peak, round(regr_slope(x,n::DOUBLE),6) AS slope FROM wl GROUP BY 1,2,3
UNION ALL SELECT trial_id, j, 'norm', round(avg(v),6), round(stddev_pop(v),5), round(sqrt(avg(v*v)),6), round(max(v),6), NULL FROM (SELECT *, sqrt(c0*c0+c1*c1+c2*c2) v FROM win) GROUP BY 1,2""")
def a02(spark, root):
    s = samples(spark, root).select("trial_id", "n", *CH, F.sqrt(sum(F.col(c) * F.col(c) for c in CH[:3])).alias("norm"))
    axes = {**{str(i): c for i, c in enumerate(CH)}, "norm": "norm"}
    aggs = [f.alias(f"{n}_{a}") for a, c in axes.items() for n, f in (
        ("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("rms", G.rms(c)), ("peak", F.max(F.abs(F.col(c)))),
        ("slope", F.regr_slope(c, F.col("n").cast("double"))))]
    w = W.window_agg(s, ["trial_id"], aggs, size=8, hop=4)
    parts = F.array(*[F.struct(F.lit(a).alias("axis"), r6(f"mean_{a}", "mean"), (F.round(f"std_{a}", 5) + 0.0).alias("std"), r6(f"rms_{a}", "rms"), r6(f"peak_{a}", "peak"),
                               (F.lit(None).cast("double") if a == "norm" else r6(f"slope_{a}")).alias("slope")) for a in axes])
    return w.select("trial_id", "j", F.explode(parts).alias("r")).select("trial_id", "j", "r.*")


@query("a03_activation", views="samples win", sql=f"""
WITH {WLONG}, f AS (SELECT trial_id, j, ch, sqrt(avg(x*x))/150 r FROM wl GROUP BY 1,2,3) SELECT trial_id, j, round(least(greatest(median(r),0),1),6) AS activation FROM f GROUP BY 1,2""")
def a03(spark, root):
    w = windowed(spark, root, [G.rms(c).alias(c) for c in CH])
    return w.select("trial_id", "j", r6(G.activation([F.col(c) / 150 for c in CH]), "activation"))


@query("a04_motion", views="samples win", sql="""
SELECT trial_id, j, round(least(greatest(0.55*sqrt(avg((c0*c0+c1*c1)/40000))+0.45*sqrt(avg((c2*c2+c3*c3)/40000)),0),1),6) AS motion FROM win GROUP BY 1,2""")
def a04(spark, root):
    p = lambda a, b: F.avg((F.col(a) * F.col(a) + F.col(b) * F.col(b)) / 40_000)
    return windowed(spark, root, [G.motion(p("c0", "c1"), p("c2", "c3")).alias("m")]).select("trial_id", "j", r6("m", "motion"))


@query("a05_signal_quality", views="samples win", sql="""
WITH x AS (SELECT trial_id, j, CASE WHEN k=7 THEN NULL ELSE c0 END a, c1 b, CASE WHEN k=9 THEN NULL ELSE c3 END i FROM win)
SELECT trial_id, j, round(least(greatest((avg((a IS NOT NULL)::INT)*(stddev_pop(coalesce(a,0))>1e-10)::INT + (stddev_pop(b)>1e-10)::INT)/2.0*(8/10.0),0),1),6) AS emg_score,
 round(least(greatest(avg((i IS NOT NULL)::INT)*(count(i)=8)::INT*(8/10.0),0),1),6) AS imu_score FROM x GROUP BY 1,2""")
def a05(spark, root):
    s = samples(spark, root)
    nan = lambda v, c: F.when(F.col("k") == v, F.lit(float("nan"))).otherwise(F.col(c))
    s = s.select("trial_id", "n", nan(7, "c0").alias("a"), F.col("c1").alias("b"), nan(9, "c3").alias("i"))
    from ..operators.transforms import finite
    fin = lambda c: F.avg(finite(F.col(c)).cast("double"))
    dyn = lambda c: (F.stddev_pop(F.when(finite(F.col(c)), F.col(c)).otherwise(0.0)) > 1e-10).cast("double")
    w = W.window_agg(s, ["trial_id"], [((fin("a") * dyn("a") + fin("b") * dyn("b")) / 2).alias("e"),
                                       (fin("i") * F.bool_and(finite(F.col("i"))).cast("double")).alias("i")], size=8, hop=4)
    return w.select("trial_id", "j", r6(clamp01(F.col("e") * 0.8), "emg_score"), r6(clamp01(F.col("i") * 0.8), "imu_score"))


@query("a06_label_mode", views="samples win", sql="""
WITH v AS (SELECT trial_id, j, k%7-1 lab, count(*) c FROM win WHERE k%7-1>=0 GROUP BY 1,2,3), m AS (SELECT *, row_number() OVER (PARTITION BY trial_id,j ORDER BY c DESC, lab) r FROM v)
SELECT w.trial_id, w.j, coalesce(CAST(m.lab AS INT),-1) AS label FROM (SELECT DISTINCT trial_id, j FROM win) w LEFT JOIN m ON m.trial_id=w.trial_id AND m.j=w.j AND r=1""")
def a06(spark, root):
    s = samples(spark, root).select("trial_id", "n", (F.col("k") % 7 - 1).alias("label"))
    return W.window_agg(s, ["trial_id"], [W.label_mode("label").alias("label")], size=8, hop=4)


SPLIT = "CASE WHEN session_no<=2 THEN 'train' WHEN session_no=3 THEN 'validation' ELSE 'test' END"


@query("a15_dataset_report", views="trials", sql=f"""
SELECT {SPLIT} AS split, session_no, label, count(*) AS trials, count(*) FILTER (WHERE valid) AS valid_trials, round(avg((trial_id%8)/8.0),6) AS mean_quality, CAST(min(trial_id%9) AS BIGINT) AS min_channels
FROM trials GROUP BY GROUPING SETS (({SPLIT}),(session_no,label),(label),({SPLIT},label),(session_no))""")
def a15(spark, root):
    t = trials(spark, root).withColumns({"split": N.split_of("session_no"), "quality": (F.col("trial_id") % 8) / 8.0})
    return R.dataset_report(t, [["split"], ["session_no", "label"], ["label"], ["split", "label"], ["session_no"]], [
        F.count(F.lit(1)).alias("trials"), F.count_if("valid").alias("valid_trials"), r6(F.avg("quality"), "mean_quality"),
        F.min(F.col("trial_id") % 9).alias("min_channels")])


@query("a16_offset_coverage", views="trials cues", sql="""
WITH c AS (SELECT trial_id, min(CASE WHEN name LIKE 'arm:%' THEN date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE)) END) a, min(CASE WHEN name LIKE 'hand:%' THEN date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE)) END) h FROM cues GROUP BY 1),
o AS (SELECT session_no, label, h-a off FROM trials JOIN c USING (trial_id) WHERE valid)
SELECT session_no, label, concat_ws(',', CASE WHEN NOT coalesce(bool_or(abs(off+600)<=1),false) THEN '-600' END, CASE WHEN NOT coalesce(bool_or(abs(off)<=1),false) THEN '0' END, CASE WHEN NOT coalesce(bool_or(abs(off-600)<=1),false) THEN '600' END) AS missing_targets FROM o GROUP BY 1,2""")
def a16(spark, root):
    c = cues(spark, root).withColumn("d", day("cue_ts"))
    f = lambda k: F.min(F.when(F.col("name").startswith(k), F.col("d")))
    c = c.groupBy("trial_id").agg((f("hand:") - f("arm:")).alias("off"))
    t = trials(spark, root).where("valid").join(c, "trial_id")
    return R.offset_coverage(t, ["session_no", "label"], "off", (-600.0, 0.0, 600.0), 1.0)


@query("a17_benchmark_stats", sql="""
WITH e AS (SELECT user_id%5 AS subject, user_id%3 AS session, event_type AS posture, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) k FROM events)
SELECT subject, session, posture, count(*) AS rows, count(*) FILTER (WHERE k>=20) AS eligible, count(*) FILTER (WHERE k>=50) AS stable, round(count(*) FILTER (WHERE k>=50)/200.0,6)::DOUBLE AS stable_seconds, round(avg((k%5=0)::INT),6) AS unmapped_share FROM e GROUP BY ROLLUP(subject, session, posture)""")
def a17(spark, root):
    e = table(spark, root, "events").select((F.col("user_id") % 5).alias("subject"), (F.col("user_id") % 3).alias("session"), F.col("event_type").alias("posture"),
                                            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    d = R.benchmark_stats(e, ["subject", "session", "posture"], F.col("k") >= 20, F.col("k") >= 50, F.col("k") % 5 == 0, 200.0)
    return d.withColumns({"stable_seconds": r6("stable_seconds"), "unmapped_share": r6("unmapped_share")})


@query("a18_repetition_check", sql="""
WITH g AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t), c AS (SELECT user_id, event_type, count(*) c FROM events GROUP BY 1,2)
SELECT g.user_id, g.event_type, coalesce(c,0) AS repetitions FROM g LEFT JOIN c USING (user_id, event_type) WHERE coalesce(c,0) NOT BETWEEN 9 AND 16""")
def a18(spark, root):
    e = table(spark, root, "events").select("user_id", "event_type")
    kinds = e.agg(F.collect_set("event_type").alias("k")).scalar()  # the event vocabulary
    grid = e.select("user_id").distinct().select("user_id", F.explode(kinds).alias("event_type"))
    return R.repetition_check(e, grid, ["user_id", "event_type"])


@query("a19_channel_stats", views="samples", sql=f"""
WITH {LONG} SELECT session_no, CAST(ch AS INT) AS ch, round(sqrt(avg(x*x)),6) AS rms, round(max(x)-min(x),6) AS ptp, bool_or(abs(x)>=400) AS saturated, CASE WHEN bool_or(abs(x)>=400) OR max(x)=min(x) THEN 'WARNING' ELSE 'GOOD' END AS status FROM lg GROUP BY 1,2""")
def a19(spark, root):
    d = Q.channel_stats(long_samples(spark, root), ["session_no", "ch"], "x", 400.0)
    return d.withColumns({"rms": r6("rms"), "ptp": r6("ptp")})


@query("a20_rest_report", views="samples", sql=f"""
WITH {LONG}, m AS (SELECT *, median(x) OVER (PARTITION BY session_no, ch) md FROM lg),
p AS (SELECT session_no, ch, median(abs(x-md)) mad, quantile_cont(abs(x-md),0.95) p95, avg((abs(x)>=420)::INT) sat, avg((x=0)::INT) z, max(x)-min(x) pt FROM m GROUP BY 1,2),
t AS (SELECT session_no, max(sat) sat, max(z) z, min(pt) pt, max(mad) mad, max(p95) p95 FROM p GROUP BY 1),
a AS (SELECT session_no, greatest(abs(corr(c0,c1)),abs(corr(c1,c2)),abs(corr(c2,c3))) adj FROM samples GROUP BY 1)
SELECT session_no, round(sat,6) AS sat, round(z,6) AS zero, round(mad,6) AS mad, round(p95,6) AS p95, round(adj,6) AS adjacent,
 concat_ws(',', CASE WHEN sat>0 THEN 'clipping' END, CASE WHEN z>0.98 OR pt=0 THEN 'flatline' END, CASE WHEN adj>0.995 THEN 'adjacent_channel_correlation' END) AS reasons,
 CASE WHEN sat>0 OR z>0.98 OR pt=0 OR adj>0.995 THEN 'BAD' ELSE 'GOOD' END AS grade FROM t JOIN a USING (session_no)""")
def a20(spark, root):
    d = Q.rest_report(samples(spark, root), ["session_no"], CH, 420.0)
    return d.select("session_no", *[r6(c, c) for c in ("sat", "zero", "mad", "p95", "adjacent")], "reasons", "grade")


@query("a21_band_power", sql="""
WITH s AS (SELECT user_id%4 AS session, value x, row_number() OVER (PARTITION BY user_id%4 ORDER BY ts, event_id)-1 n FROM events), b AS (SELECT session, n//200 blk, n%200 i, x FROM s),
f AS (SELECT session, blk FROM b GROUP BY 1,2 HAVING count(*)=200), c AS (SELECT b.*, x-avg(x) OVER (PARTITION BY session, blk) y FROM b JOIN f USING (session, blk)),
k AS (SELECT session, blk, q.q, sum(y*cos(2*pi()*q.q*i/200.0)) re, sum(y*sin(2*pi()*q.q*i/200.0)) im FROM c, range(0,101) q(q) GROUP BY 1,2,3), p AS (SELECT session, blk, q, re*re+im*im pw FROM k)
SELECT session, blk AS block, round(sum(pw) FILTER (WHERE q BETWEEN 45 AND 55)/greatest(sum(pw),1e-12),6) AS mains_ratio,
 round(10*log10((avg(pw) FILTER (WHERE q BETWEEN 49 AND 51)+1e-12)/(avg(pw) FILTER (WHERE q BETWEEN 44 AND 47 OR q BETWEEN 53 AND 56)+1e-12)),5) AS line_db FROM p GROUP BY 1,2""")
def a21(spark, root):
    e = table(spark, root, "events").select((F.col("user_id") % 4).alias("session"), "ts", "event_id", F.col("value").alias("x"), time_slot("ts", 86_400).alias("slot"))
    e = number_rows(e, ["session"], ["ts", "event_id"], "n", [["slot"]])
    e = e.select("session", F.floor(F.col("n") / 200).alias("block"), (F.col("n") % 200).alias("i"), "x")
    d = Q.band_power(e, ["session", "block"], "i", "x", 200, 200.0)
    return d.select("session", "block", r6("mains_ratio", "mains_ratio"), F.round("line_db", 5).alias("line_db"))


@query("a22_rolling_reasons", views="samples win", sql="""
WITH a AS (SELECT trial_id, j, bool_or(abs(c0)>=200 OR abs(c1)>=200) clip, max(c0)=min(c0) OR max(c1)=min(c1) OR avg((c0=0)::INT)>0.98 OR avg((c1=0)::INT)>0.98 flat FROM win GROUP BY 1,2)
SELECT trial_id, j, concat_ws(',', CASE WHEN clip THEN 'clipping' END, CASE WHEN flat THEN 'flatline_or_disconnected_channel' END) AS reasons FROM a""")
def a22(spark, root):
    return windowed(spark, root, [Q.rolling_reasons(("c0", "c1"), 200.0).alias("reasons")])


@query("a23_packet_quality", sql="""
WITH a AS (SELECT user_id%4+1 AS session_no, CASE WHEN event_id%50=0 THEN 2 ELSE 0 END lost, event_id%77=0 dup, event_id%201=0 late FROM events),
r AS (SELECT session_no, sum(lost)::DOUBLE/(count(*)+sum(lost)) l, sum(dup::INT)::DOUBLE/(count(*)+sum(lost)) d, sum(late::INT)::DOUBLE/(count(*)+sum(lost)) t FROM a GROUP BY 1)
SELECT session_no, round(l,6) AS lost_ratio, round(d,6) AS duplicate_ratio, round(t,6) AS late_ratio, concat_ws(',', CASE WHEN l>0.02 THEN 'lost' END, CASE WHEN d>0.01 THEN 'duplicate' END, CASE WHEN t>0.01 THEN 'late' END) AS problems FROM r""")
def a23(spark, root):
    a = table(spark, root, "events").select((F.col("user_id") % 4 + 1).alias("session_no"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(0).alias("lost"),
                                            (F.col("event_id") % 77 == 0).alias("duplicate"), (F.col("event_id") % 201 == 0).alias("late"))
    d = Q.packet_quality(a, ["session_no"])
    return d.select("session_no", *[r6(c, c) for c in ("lost_ratio", "duplicate_ratio", "late_ratio")], "problems")


@query("a24_session_summary", views="samples trials", sql="""
WITH s AS (SELECT session_no, count(*) rows, round((max(epoch_us(ts))-min(epoch_us(ts)))/1e6,3) dur, count(*) FILTER (WHERE event_type='error') losses FROM samples GROUP BY 1), t AS (SELECT session_no, count(*) trials, count(*) FILTER (WHERE valid) v FROM trials GROUP BY 1)
SELECT s.session_no, rows, dur AS duration_s, losses, trials, v AS valid_trials, trials-v AS bad_trials FROM s JOIN t USING (session_no)""")
def a24(spark, root):
    us = micros("ts")
    s = table(spark, root, "events").groupBy((F.col("user_id") % 4 + 1).alias("session_no")).agg(
        F.count(F.lit(1)).alias("rows"), F.round((F.max(us) - F.min(us)) / 1e6, 3).alias("duration_s"), F.count_if(F.col("event_type") == "error").alias("losses"))
    t = trials(spark, root).groupBy("session_no").agg(F.count(F.lit(1)).alias("trials"), F.count_if("valid").alias("valid_trials"))
    return s.join(t, "session_no").withColumn("bad_trials", F.col("trials") - F.col("valid_trials"))


@query("a25_rate_audit", views="samples", sql="""
WITH d AS (SELECT trial_id, n, epoch_us(ts) us, abs(c0) a, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY trial_id ORDER BY n))/1000.0 ms FROM samples), q AS (SELECT trial_id, median(ms) m, quantile_cont(ms,0.95) p FROM d GROUP BY 1)
SELECT trial_id, round(regr_slope(n, (us-1700000000000000)/1e6),9) AS rate_hz, count(*) FILTER (WHERE ms<=0) AS not_positive, round(any_value(m)/1000,3) AS step_p50_s, round(any_value(p)/1000,3) AS step_p95_s, round(quantile_cont(a,0.99),6) AS amp_p99, count(*) FILTER (WHERE ms>2.5*m) AS gaps FROM d JOIN q USING (trial_id) GROUP BY 1""")
def a25(spark, root):
    s = samples(spark, root).withColumn("us", micros("ts") - 1_700_000_000_000_000)
    d = Q.rate_audit(s, "trial_id", "n", "us", "c0", BLK)
    return d.select("trial_id", F.round("rate_hz", 9).alias("rate_hz"), "not_positive", F.round(F.col("step_p50") / 1000, 3).alias("step_p50_s"),
                    F.round(F.col("step_p95") / 1000, 3).alias("step_p95_s"), r6("amp_p99", "amp_p99"), "gaps")


@query("a26_offset_balance", views="trials cues", sql="""
WITH t AS (SELECT label, valid, (trial_id%3-1)*200 o FROM trials) SELECT label, count(*) FILTER (WHERE valid AND o=-200) AS n0, count(*) FILTER (WHERE valid AND o=0) AS n1, count(*) FILTER (WHERE valid AND o=200) AS n2,
 least(count(*) FILTER (WHERE valid AND o=-200),count(*) FILTER (WHERE valid AND o=0),count(*) FILTER (WHERE valid AND o=200))>0 AND greatest(count(*) FILTER (WHERE valid AND o=-200),count(*) FILTER (WHERE valid AND o=0),count(*) FILTER (WHERE valid AND o=200))-least(count(*) FILTER (WHERE valid AND o=-200),count(*) FILTER (WHERE valid AND o=0),count(*) FILTER (WHERE valid AND o=200))<=1 AS balanced FROM t GROUP BY 1""")
def a26(spark, root):
    t = trials(spark, root).withColumn("o", (F.col("trial_id") % 3 - 1) * 200)
    return R.offset_balance(t, "label", "o", (-200, 0, 200))


@query("a26_cue_error", views="trials cues", sql="""
WITH c AS (SELECT trial_id, min(CASE WHEN name LIKE 'arm:%' THEN date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE)) END) a, min(CASE WHEN name LIKE 'hand:%' THEN date_diff('day', DATE '1970-01-01', CAST(cue_ts AS DATE)) END) h FROM cues GROUP BY 1),
e AS (SELECT session_no, abs(h-a-(trial_id%3-1)*200) e FROM trials JOIN c USING (trial_id) WHERE valid AND h IS NOT NULL AND a IS NOT NULL)
SELECT session_no, max(e) AS max_error, count(*) FILTER (WHERE e>80) AS outside FROM e GROUP BY 1""")
def a26b(spark, root):
    c = cues(spark, root).withColumn("d", day("cue_ts"))
    f = lambda k: F.min(F.when(F.col("name").startswith(k), F.col("d")))
    c = c.groupBy("trial_id").agg((f("hand:") - f("arm:")).alias("off")).where("off IS NOT NULL")
    t = trials(spark, root).where("valid").join(c, "trial_id").withColumn("e", F.abs(F.col("off") - (F.col("trial_id") % 3 - 1) * 200))
    return t.groupBy("session_no").agg(F.max("e").alias("max_error"), F.count_if(F.col("e") > 80).alias("outside"))


@query("a27_event_counts", sql="""
SELECT user_id, count(*) FILTER (WHERE event_type='signup') AS n_signup, count(*) FILTER (WHERE event_type='error') AS n_error, count(*) FILTER (WHERE event_type='signup')>=14 AND count(*) FILTER (WHERE event_type='error')>=12 AS enough FROM events GROUP BY 1""")
def a27(spark, root):
    return R.event_counts(table(spark, root, "events"), ["user_id"], "event_type", {"signup": 14, "error": 12})


@query("a34_calibration_fit", views="samples", sql=f"""
WITH {LONG}, c AS (SELECT session_no, ch, median(x) c FROM lg WHERE event_type='view' GROUP BY 1,2), d AS (SELECT lg.*, c.c, abs(x-c.c) d FROM lg JOIN c USING (session_no, ch)),
g AS (SELECT session_no, greatest(quantile_cont(d,0.95) FILTER (WHERE event_type<>'view'), 3*quantile_cont(d,0.95) FILTER (WHERE event_type='view'), 1e-6) gs FROM d GROUP BY 1)
SELECT session_no, CAST(ch AS INT) AS ch, round(any_value(c),6) AS center, round(greatest(quantile_cont(d,0.95) FILTER (WHERE event_type<>'view'), 3*quantile_cont(d,0.95) FILTER (WHERE event_type='view'), 1e-6),6) AS scale, round(any_value(gs),6) AS global_scale FROM d JOIN g USING (session_no) GROUP BY 1,2""")
def a34(spark, root):
    d = K.fit_scales(long_samples(spark, root), "session_no", "ch", "x", F.col("event_type") == "view")
    return d.select("session_no", "ch", r6("center", "center"), r6("scale", "scale"), r6("global_scale", "global_scale"))


@query("a34_motion_fit", views="samples", sql="""
WITH m AS (SELECT session_no, median(c0) m0, median(c1) m1, median(c2) m2 FROM samples WHERE event_type='view' GROUP BY 1)
SELECT session_no, round(any_value(m0),6) AS g0, round(any_value(m1),6) AS g1, round(any_value(m2),6) AS g2, round(greatest(quantile_cont(sqrt((c0-m0)*(c0-m0)+(c1-m1)*(c1-m1)+(c2-m2)*(c2-m2)),0.95),1e-6),6) AS motion_scale FROM samples JOIN m USING (session_no) WHERE event_type<>'view' GROUP BY 1""")
def a34b(spark, root):
    s = samples(spark, root)
    med = exact_quantiles(long_samples(spark, root, CH[:3]).where("event_type = 'view'"), ["session_no", "ch"], "x", {"m": 0.5})
    wide = med.groupBy("session_no").agg(*[F.max(F.when(F.col("ch") == i, F.col("m"))).alias(f"g{i}") for i in range(3)])
    d = s.where("event_type <> 'view'").join(small(wide), "session_no").withColumn("r", F.sqrt(sum(
        (F.col(f"c{i}") - F.col(f"g{i}")) * (F.col(f"c{i}") - F.col(f"g{i}")) for i in range(3))))
    q = exact_quantiles(d, ["session_no"], "r", {"p": 0.95}).join(wide, "session_no")
    return q.select("session_no", *[r6(f"g{i}", f"g{i}") for i in range(3)], r6(F.greatest("p", F.lit(1e-6)), "motion_scale"))


@query("a35_shift_match", views="samples", sql=f"""
WITH {LONG}, p AS (SELECT session_no s, event_type g, ch, sqrt(avg(x*x)) v FROM lg GROUP BY 1,2,3), r AS (SELECT event_type g, (ch+1)%4 ch, sqrt(avg(x*x)) v FROM lg GROUP BY 1,2),
pu AS (SELECT s,g,ch, v/sqrt(sum(v*v) OVER (PARTITION BY s,g)) v FROM p), ru AS (SELECT g,ch, v/sqrt(sum(v*v) OVER (PARTITION BY g)) v FROM r),
e AS (SELECT s, h.h, g, avg((pu.v-ru.v)*(pu.v-ru.v)) e FROM pu JOIN range(0,4) h(h) ON true JOIN ru USING (g) WHERE ru.ch=(pu.ch+h.h)%4 GROUP BY 1,2,3),
m AS (SELECT s, h, avg(e) e FROM e GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(e,12), h) r FROM m),
z AS (SELECT s, max(CASE WHEN r=1 THEN h END) c, max(CASE WHEN r=1 THEN e END) b, max(CASE WHEN r=2 THEN e END) d FROM k WHERE r<=2 GROUP BY 1)
SELECT s AS session_no, CAST(c AS INT) AS candidate, round(greatest(0,(d-b)/greatest(d,1e-12)),6) AS margin, CAST(CASE WHEN (d-b)/greatest(d,1e-12)>=0.1 THEN c ELSE 0 END AS INT) AS shift FROM z""")
def a35(spark, root):
    s = samples(spark, root)
    prof = F.array(*[G.rms(c) for c in CH]).alias("profile")
    p = s.groupBy("session_no", "event_type").agg(prof)
    from ..functions.columns import roll
    ref = s.groupBy("event_type").agg(prof).withColumn("profile", roll("profile", 1))
    return K.shift_match(p, ref, "session_no", "event_type", "profile", 4).select("session_no", "candidate", r6("margin", "margin"), "shift")


@query("a36_body_rotation")
def a36(spark, root):
    s = samples(spark, root).groupBy("session_no", (F.col("k") % 6 + 1).alias("direction")).agg(
        F.avg("c0").alias("x"), F.avg("c1").alias("y"), F.avg("c3").alias("z"))
    d = K.fit_rotation(s, "session_no", "direction")
    return d.select("session_no", *[F.col("rotation")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], "residual")


CONS = """cs AS (SELECT session_no, event_type, c0/100 a, k/100.0 m, c1/300 l FROM samples),
md AS (SELECT session_no, event_type, count(*) r, median(a) m0, median(m) m1, median(l) m2, covar_samp(a,a)+1e-3 s00, covar_samp(a,m) s01, covar_samp(a,l) s02, covar_samp(m,m)+1e-3 s11, covar_samp(m,l) s12, covar_samp(l,l)+1e-3 s22 FROM cs GROUP BY 1,2 HAVING count(*)>=12)"""


def cons_rows(spark, root):
    return samples(spark, root).select("session_no", "event_type", "event_id", (F.col("c0") / 100).alias("a"), (F.col("k") / 100.0).alias("m"), (F.col("c1") / 300).alias("l"))


@query("a37_consistency_fit", views="samples", sql=f"""
WITH {CONS} SELECT session_no, event_type, r AS rows, {', '.join(f'round({c},6) AS {c}' for c in ('m0','m1','m2','s00','s01','s02','s11','s12','s22'))} FROM md""")
def a37(spark, root):
    d = K.fit_consistency(cons_rows(spark, root), ["session_no", "event_type"], "a", "m", "l")
    return d.select("session_no", "event_type", "rows", *[r6(c, c) for c in ("m0", "m1", "m2", "s00", "s01", "s02", "s11", "s12", "s22")])


@query("a38_consistency_score", views="samples", sql=f"""
WITH {CONS}, x AS (SELECT event_id, s.c0/100-m0 x, s.k/100.0-m1 y, s.c1/300-m2 z, md.* FROM samples s LEFT JOIN md ON md.session_no=s.session_no AND md.event_type=s.event_type AND s.event_type<>'error'),
d AS (SELECT event_id, greatest((x*x*(s11*s22-s12*s12)+y*y*(s00*s22-s02*s02)+z*z*(s00*s11-s01*s01)+2*(x*y*(s02*s12-s01*s22)+x*z*(s01*s12-s02*s11)+y*z*(s01*s02-s00*s12)))/(s00*(s11*s22-s12*s12)+s01*(s02*s12-s01*s22)+s02*(s01*s12-s02*s11)),0) d2 FROM x)
SELECT event_id, round(1-exp(-0.5*d2),6) AS score, CASE WHEN d2 IS NULL THEN 'unknown' WHEN 1-exp(-0.5*d2)>=0.8 THEN 'atypical' ELSE 'normal' END AS consistency FROM d""")
def a38(spark, root):
    rows = cons_rows(spark, root)
    model = K.fit_consistency(rows.where("event_type <> 'error'"), ["session_no", "event_type"], "a", "m", "l")
    d = K.score_consistency(rows, model, ["session_no", "event_type"], "a", "m", "l")
    return d.select("event_id", F.round("score", 6).alias("score"), "consistency")


@query("a46_velocity_error", views="samples", sql="""
WITH d AS (SELECT session_no, c0/100 - (c1-lag(c1) OVER (PARTITION BY trial_id ORDER BY n))/50 e FROM samples) SELECT session_no, round(degrees(avg(abs(e)))*50,4) AS mae_deg_s FROM d WHERE e IS NOT NULL GROUP BY 1""")
def a46(spark, root):
    from ..operators.sequences import difference
    d = difference(samples(spark, root), ["trial_id"], ["n"], "c1", "v", BLK).where("v IS NOT NULL")
    return d.groupBy("session_no").agg(F.round(F.degrees(F.avg(F.abs(F.col("c0") / 100 - F.col("v") / 50))) * 50, 4).alias("mae_deg_s"))


@query("a48_effort_fit", views="samples win", sql=f"""
WITH {WLONG}, m AS (SELECT *, median(x) OVER (PARTITION BY trial_id,j,ch) md FROM wl), r AS (SELECT trial_id, j, ch, sqrt(avg((x-md)*(x-md))) r FROM m GROUP BY 1,2,3), l AS (SELECT trial_id, j, quantile_cont(r,0.75) l FROM r GROUP BY 1,2),
f AS (SELECT trial_id%4+1 s, median(l) FILTER (WHERE j%3=0) b, quantile_cont(l,0.65) FILTER (WHERE j%3<>0) a FROM l GROUP BY 1)
SELECT s AS session_no, round(b,6) AS baseline, round(a,6) AS active, a-b>=greatest(1.0,b*0.25) AS usable FROM f""")
def a48(spark, root):
    w = windowed(spark, root, [F.collect_list(c).alias(f"x_{c}") for c in CH])
    lv = w.select((F.col("trial_id") % 4 + 1).alias("session_no"), K.effort_level([f"x_{c}" for c in CH]).alias("level"),
                  F.when(F.col("j") % 3 == 0, "rest").otherwise("active").alias("phase"))
    return K.fit_effort(lv, "session_no", "level", "phase").select("session_no", r6("baseline", "baseline"), r6("active", "active"), "usable")


@query("a49_amplitude_scale", views="samples", sql=f"WITH {LONG} SELECT session_no, round(median(abs(x))/16,6) AS scale FROM lg GROUP BY 1")
def a49(spark, root):
    return K.fit_scale(long_samples(spark, root), ["session_no"], "x").select("session_no", r6("scale", "scale"))


@query("a50_corpus_manifest", sql="""
WITH c AS (SELECT CASE WHEN o_custkey%4+1<=2 THEN 'train' WHEN o_custkey%4+1=3 THEN 'val' ELSE 'test' END sp, o_orderkey%50 p, CASE WHEN o_orderstatus='P' THEN 'not_ready' WHEN o_orderkey%50=0 THEN 'no_prompts' ELSE '' END r FROM orders)
SELECT CASE WHEN r='' THEN sp ELSE 'skipped:' || r END AS part, count(*) AS sessions, CAST(sum(p) AS BIGINT) AS prompts FROM c GROUP BY 1""")
def a50(spark, root):
    o = table(spark, root, "orders")
    s = F.col("o_custkey") % 4 + 1
    c = o.select(F.when(s <= 2, "train").when(s == 3, "val").otherwise("test").alias("split"), (F.col("o_orderkey") % 50).alias("prompts"),
                 F.when(F.col("o_orderstatus") == "P", "not_ready").when(F.col("o_orderkey") % 50 == 0, "no_prompts").otherwise("").alias("reason"))
    return R.corpus_manifest(c, "split", "prompts", "reason")


@query("a51_export_readiness", views="samples", sql="""
WITH f AS (SELECT trial_id, count(*) FILTER (WHERE event_type='click') pr, count(*) FILTER (WHERE event_type='view') rl, count(*) FILTER (WHERE event_type='error') un, count(*) r, median(k) q FROM samples GROUP BY 1),
r AS (SELECT trial_id, unnest(['channels','known_names','not_empty','paired','rate','samples']) AS rule, unnest([true, un<=12, pr+rl>0, pr=rl, q BETWEEN 45 AND 55, r>=60]) AS passed FROM f)
SELECT trial_id, rule, passed FROM r""")
def a51(spark, root):
    s = samples(spark, root)
    cnt = lambda v: F.count_if(F.col("event_type") == v)
    f = s.groupBy("trial_id").agg(cnt("click").alias("press"), cnt("view").alias("release"), cnt("error").alias("unknown"), F.count(F.lit(1)).alias("rows"))
    f = f.join(exact_quantiles(s.withColumn("kd", F.col("k").cast("double")), ["trial_id"], "kd", {"med": 0.5}), "trial_id")
    return Q.rule_rows(f, ["trial_id"], {
        "channels": F.lit(True), "known_names": F.col("unknown") <= 12, "not_empty": F.col("press") + F.col("release") > 0,
        "paired": F.col("press") == F.col("release"), "rate": F.col("med").between(45, 55), "samples": F.col("rows") >= 60})


@query("a53_alignment_qc", sql="""
WITH e AS (SELECT l_orderkey t, l_discount>0.01 ok, concat_ws(',', CASE WHEN l_discount<=0.01 THEN 'low_confidence' END, CASE WHEN l_tax>0.07 THEN 'search_boundary_hit' END) r FROM lineitem), p AS (SELECT t, bool_and(ok) ok FROM e GROUP BY 1)
SELECT 'trials_included' AS what, count(*) FILTER (WHERE ok) AS n FROM p UNION ALL SELECT 'trials', count(*) FROM p UNION ALL SELECT u, count(*) FROM (SELECT unnest(string_split(r,',')) u FROM e WHERE r<>'') GROUP BY 1""")
def a53(spark, root):
    li = table(spark, root, "lineitem")
    e = li.select(F.col("l_orderkey").alias("t"), (F.col("l_discount") > 0.01).alias("ok"), F.concat_ws(
        ",", F.when(F.col("l_discount") <= 0.01, "low_confidence"), F.when(F.col("l_tax") > 0.07, "search_boundary_hit")).alias("r"))
    return R.qc_summary(e, "t", "ok", "r")


@query("a54_runtime_health", views="pred", sql=f"""
SELECT session_no AS run, count(*) AS states, round(avg((pred=-1)::INT),6) AS direction_unknown, round(avg((truth%4=3)::INT),6) AS gesture_unknown,
 {', '.join(f"count(*) FILTER (WHERE (vec_id & {1 << i})<>0) AS flag_{n}" for i, n in enumerate(N.FLAGS))} FROM pred GROUP BY 1""")
def a54(spark, root):
    p = pred(spark, root).withColumn("g", F.when(F.col("truth") % 4 == 3, -1).otherwise(F.col("truth") % 4))
    d = R.health(p, "session_no", "vec_id", "pred", "g", N.FLAGS).withColumnRenamed("session_no", "run")
    return d.withColumns({"direction_unknown": r6("direction_unknown"), "gesture_unknown": r6("gesture_unknown")})
