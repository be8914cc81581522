"""Flagship slice and prediction metrics."""

from pyspark.sql import functions as F

from ..functions.columns import argmax, margin, r6, softmax
from ..functions.signal import emg_array_features
from ..operators import metrics as M
from ..operators import windows as W
from ..operators.ordered import exact_quantiles, micros, running, scan
from .registry import query
from .views import pred, samples, table

WT = lambda: (F.col("vec_id") % 3 + 1).cast("double")
HEAD2 = """two AS (SELECT *, (1 + vec_id%3)::DOUBLE AS w, truth%4 AS truth2,
 CASE WHEN pred<0 THEN -1 ELSE (pred + CASE WHEN vec_id%5=0 THEN 1 ELSE 0 END)%4 END AS pred2 FROM pred)"""


def two_heads(spark, root):
    p = pred(spark, root)
    bump = F.when(F.col("vec_id") % 5 == 0, F.lit(1)).otherwise(F.lit(0))
    return p.withColumns({"w": WT(), "truth2": F.col("truth") % 4,
                          "pred2": F.when(F.col("pred") < 0, F.lit(-1)).otherwise((F.col("pred") + bump) % 4)})


def logits(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 10).alias("z"), "embedding")
    q = F.least(F.greatest(F.array_max("z").cast("double"), F.lit(0.0)), F.lit(1.0))
    return e.withColumns({"raw": argmax("z").cast("int"), "q": q, "w": WT()})


LOGITS = """lg AS (SELECT vec_id, label, embedding, embedding[1:10] AS z,
 CAST(list_position(embedding[1:10], list_max(embedding[1:10]))-1 AS INT) AS raw,
 greatest(0.0,least(1.0,CAST(list_max(embedding[1:10]) AS DOUBLE))) AS q, (1 + vec_id%3)::DOUBLE AS w FROM embeddings)"""


@query("window_features", views="samples win", sql="""
WITH o AS (SELECT trial_id, j, session_no, c0, k, n, abs(c0) a0, lag(c0) OVER (PARTITION BY trial_id, j ORDER BY n) p0 FROM win),
f AS (SELECT trial_id, j, min(session_no) session_no, sqrt(avg(c0*c0)) rms, avg(a0) mav, sum(abs(c0-p0))/7 wl,
        avg(CASE WHEN k>=5 THEN 1.0 ELSE 0.0 END) st, avg(CASE WHEN k<3 THEN 1.0 ELSE 0.0 END) ms FROM o GROUP BY 1,2),
v AS (SELECT trial_id, j, k%7-1 AS lab, count(*) c FROM o WHERE k%7-1>=0 GROUP BY 1,2,3),
m AS (SELECT trial_id, j, lab FROM (SELECT *, row_number() OVER (PARTITION BY trial_id,j ORDER BY c DESC, lab) r FROM v) WHERE r=1),
e AS (SELECT f.*, m.lab FROM f JOIN m USING (trial_id, j) WHERE st>=0.9 AND ms<=0.1),
w AS (SELECT e.*, (SELECT count(*) FROM e)::DOUBLE / ((SELECT count(DISTINCT session_no) FROM e)
        * (count(DISTINCT trial_id) OVER (PARTITION BY session_no)) * count(*) OVER (PARTITION BY session_no, trial_id)) wt FROM e)
SELECT lab AS label, count(*) AS windows, round(sum(wt),6) AS weight, round(sum(wt*rms)/sum(wt),6) AS mean_rms,
 round(sum(wt*mav)/sum(wt),6) AS mean_mav, round(sum(wt*wl)/sum(wt),6) AS mean_wl FROM w GROUP BY 1""")
def window_features(spark, root):
    s = samples(spark, root).select("trial_id", "session_no", "n", "c0", (F.col("k") >= 5).alias("stable"),
                                    (F.col("k") < 3).alias("missing"), (F.col("k") % 7 - 1).alias("label"))
    win = W.window_agg(s, ["trial_id", "session_no"],
                       [W.ordered_values("c0").alias("x"), W.label_mode("label").alias("label"), *W.eligible()], size=8, hop=4)
    win = win.where("ok_stable AND ok_missing AND label >= 0").select(
        "trial_id", "session_no", "label", *emg_array_features("x", ("rms", "mav", "wl")))
    win = W.window_weights(win)
    avg = lambda c: r6(F.sum(F.col("weight") * F.col(c)) / F.sum("weight"), f"mean_{c}")
    return win.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), r6(F.sum("weight")).alias("weight"),
                                    avg("rms"), avg("mav"), avg("wl"))


@query("a07_macro_f1", views="pred", sql=f"""
WITH {HEAD2}, c AS (SELECT DISTINCT truth AS l FROM two), x AS (SELECT l, (SELECT coalesce(sum(w),0) FROM two WHERE truth=l AND pred=l) tp,
 (SELECT coalesce(sum(w),0) FROM two WHERE truth<>l AND pred=l) fp, (SELECT coalesce(sum(w),0) FROM two WHERE truth=l AND pred<>l) fn FROM c)
SELECT round(avg(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END),6) AS macro_f1 FROM x""")
def a07(spark, root):
    return M.macro_f1(pred(spark, root), weight=WT()).select(r6("macro_f1", "macro_f1"))


@query("a08_confusion", views="pred", sql="SELECT truth, pred, count(*) AS n FROM pred GROUP BY 1,2")
def a08(spark, root):
    return M.confusion(pred(spark, root)).select("truth", "pred", "n")


@query("a09_ece", views="pred", sql=f"""
WITH {HEAD2}, b AS (SELECT least(floor(q*10),9) b, sum(w) sw, sum(w*(truth=pred)::INT)/sum(w) acc, sum(w*q)/sum(w) cf FROM two GROUP BY 1)
SELECT round(sum(sw*abs(acc-cf))/sum(sw),6) AS ece FROM b""")
def a09(spark, root):
    return M.ece(pred(spark, root), weight=WT()).select(r6("ece", "ece"))


@query("a10_class_coverage", views="pred", sql=f"""
WITH {HEAD2} SELECT truth AS label, round(sum(w*(pred>=0)::INT)/sum(w),6) AS coverage FROM two GROUP BY 1""")
def a10(spark, root):
    return M.class_coverage(pred(spark, root), WT()).select("label", r6("coverage", "coverage"))


@query("a11_joint_accuracy", views="pred", sql=f"""
WITH {HEAD2} SELECT round(sum(w*(truth=pred AND truth2=pred2)::INT)/sum(w),6) AS joint_accuracy,
 round(sum(w*(pred>=0)::INT)/sum(w),6) AS coverage_1, round(sum(w*(pred2>=0)::INT)/sum(w),6) AS coverage_2 FROM two""")
def a11(spark, root):
    return M.joint_accuracy(two_heads(spark, root), F.col("w")).select(*[r6(c, c) for c in ("joint_accuracy", "coverage_1", "coverage_2")])


@query("a12_latency_percentiles", views="samples", sql="""
WITH g AS (SELECT session_no, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY trial_id ORDER BY n))/1000.0 AS gap FROM samples)
SELECT session_no, round(quantile_cont(gap,0.5),4) AS p50_ms, round(quantile_cont(gap,0.95),4) AS p95_ms FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def a12(spark, root):
    s = samples(spark, root).withColumn("us", micros("ts"))
    s = scan(s, ["trial_id"], ["n"], {"prev": running("lag", "us")}, [["blk"]])
    s = s.withColumn("gap", (F.col("us") - F.col("prev")) / 1000.0)
    return exact_quantiles(s, ["session_no"], "gap", {"p50_ms": 0.5, "p95_ms": 0.95}).select(
        "session_no", F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms"))


@query("a14_window_weights", views="pred", sql="""
WITH w AS (SELECT vec_id, (SELECT count(*) FROM pred)::DOUBLE/((SELECT count(DISTINCT session_no) FROM pred)
 * count(DISTINCT trial_id) OVER (PARTITION BY session_no) * count(*) OVER (PARTITION BY session_no, trial_id)) AS x FROM pred)
SELECT vec_id, round(x,6) AS weight FROM w""")
def a14(spark, root):
    return W.window_weights(pred(spark, root)).select("vec_id", r6("weight", "weight"))


@query("w09_risk_coverage", views="pred", sql=f"""
WITH {HEAD2}, e AS (SELECT *, sum(w) OVER o cw, sum(w*(pred<>truth)::INT) OVER o cb FROM two WHERE pred>=0
 WINDOW o AS (ORDER BY q DESC, vec_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT DISTINCT least(p, (SELECT sum(w) FROM two WHERE pred>=0)/(SELECT sum(w) FROM two)) AS target FROM (VALUES (1.0::DOUBLE),(0.9),(0.8),(0.7),(0.6),(0.5)) v(p)),
h AS (SELECT target, e.*, row_number() OVER (PARTITION BY target ORDER BY q DESC, vec_id) r FROM t JOIN e ON cw >= target*(SELECT sum(w) FROM two))
SELECT round(target,6) AS target, round(q,6) AS threshold, round(cw/(SELECT sum(w) FROM two),6) AS coverage, round(cb/cw,6) AS risk FROM h WHERE r=1""")
def w09(spark, root):
    return M.risk_coverage(pred(spark, root), "vec_id", WT()).select(*[r6(c, c) for c in ("target", "threshold", "coverage", "risk")])


@query("a28_guard_fit", sql=f"""
WITH {LOGITS}, l AS (SELECT label, w, unnest(range(0,64)) f, unnest(embedding)::DOUBLE x FROM lg),
cx AS (SELECT label, f, x, sum(w) OVER (PARTITION BY label,f ORDER BY x) cw, sum(w) OVER (PARTITION BY label,f) tw FROM l),
c AS (SELECT label, f, min(x) center FROM cx WHERE cw>=0.5*tw GROUP BY 1,2),
d AS (SELECT l.*, center, abs(x-center) d FROM l JOIN c USING (label,f)),
dx AS (SELECT label, f, d, sum(w) OVER (PARTITION BY label,f ORDER BY d) cw, sum(w) OVER (PARTITION BY label,f) tw FROM d),
m AS (SELECT label, f, min(d) mad FROM dx WHERE cw>=0.5*tw GROUP BY 1,2)
SELECT label, f, round(max(center),6) AS center, round(greatest(max(mad)*1.4826, sqrt(sum(w*d*d)/sum(w))*0.1, 1e-6),6) AS scale
FROM d JOIN m USING (label,f) GROUP BY 1,2""")
def a28(spark, root):
    return M.fit_guard(logits(spark, root), "vec_id", "label", "embedding", F.col("w")).select(
        "label", F.col("f").cast("bigint").alias("f"), r6("center", "center"), r6("scale", "scale"))


@query("a29_drift_score", sql=f"""
WITH {LOGITS}, l AS (SELECT label, vec_id, w, unnest(range(0,64)) f, unnest(embedding)::DOUBLE x FROM lg WHERE label < 9),
cx AS (SELECT label, f, x, sum(w) OVER (PARTITION BY label,f ORDER BY x) cw, sum(w) OVER (PARTITION BY label,f) tw FROM l),
c AS (SELECT label, f, min(x) center FROM cx WHERE cw>=0.5*tw GROUP BY 1,2),
d AS (SELECT l.*, center, abs(x-center) d FROM l JOIN c USING (label,f)),
dx AS (SELECT label, f, d, sum(w) OVER (PARTITION BY label,f ORDER BY d) cw, sum(w) OVER (PARTITION BY label,f) tw FROM d),
m AS (SELECT label, f, min(d) mad FROM dx WHERE cw>=0.5*tw GROUP BY 1,2),
g AS (SELECT label, f, max(center) center, greatest(max(mad)*1.4826, sqrt(sum(w*d*d)/sum(w))*0.1, 1e-6) scale FROM d JOIN m USING (label,f) GROUP BY 1,2),
z AS (SELECT vec_id, raw, unnest(range(0,64)) f, unnest(embedding)::DOUBLE x FROM lg)
SELECT vec_id, round(CASE WHEN count(g.label)=0 THEN 1.0 ELSE 1-exp(-median(abs(x-center)/scale)/4) END,6) AS drift
FROM z LEFT JOIN g ON g.label=z.raw AND g.f=z.f GROUP BY 1""")
def a29(spark, root):
    lg = logits(spark, root)
    guard = M.fit_guard(lg.where("label < 9"), "vec_id", "label", "embedding", F.col("w"))
    return M.drift_score(lg.select("vec_id", "raw", "embedding"), guard, "raw", "embedding").select("vec_id", r6("drift", "drift"))


@query("a30_temperature_fit", sql=f"""
WITH {LOGITS}, g AS (SELECT i, 0.25*power(16.0, i/80.0) AS t FROM range(0,81) r(i)),
p AS (SELECT i, t, w, exp(z[label+1]::DOUBLE/t - list_max(z)::DOUBLE/t)/list_sum(list_transform(z, lambda v: exp(v::DOUBLE/t - list_max(z)::DOUBLE/t))) AS p FROM lg, g),
n AS (SELECT i, t, round(sum(-w*ln(least(greatest(p,1e-9),1.0)))/sum(w),12) nll FROM p GROUP BY 1,2)
SELECT round(t,6) AS temperature, round(nll,6) AS nll FROM n ORDER BY n.nll, i LIMIT 1""")
def a30(spark, root):
    return M.fit_temperature(logits(spark, root), "z", "label", F.col("w")).select(r6("temperature", "temperature"), r6("nll", "nll"))


@query("a31_threshold_search", sql=f"""
WITH {LOGITS}, s AS (SELECT *, 0.3+0.7*q AS q3 FROM lg), g AS (SELECT i, 0.01::DOUBLE*i AS t FROM range(0,96) r(i)),
a AS (SELECT i, t, label, raw, w, (0.3::DOUBLE+0.7::DOUBLE*q)>=t AS acc FROM lg, g),
c AS (SELECT i, label, sum(w) actual, sum(w*acc::INT) kept, sum(w*(acc AND raw=label)::INT) tp FROM a GROUP BY 1,2),
pc AS (SELECT i, raw AS label, sum(w*acc::INT) claimed FROM a GROUP BY 1,2),
b AS (SELECT i, avg(CASE WHEN actual+coalesce(claimed,0)=0 THEN 0 ELSE 2*tp/(actual+coalesce(claimed,0)) END) f1, sum(kept)/sum(actual) cov,
 min(kept/actual) least, 1-sum(tp)/nullif(sum(kept),0) risk FROM c LEFT JOIN pc USING (i,label) GROUP BY 1)
SELECT coalesce(max(x.threshold),0.0) AS threshold, coalesce(max(x.f1),-1.0) AS f1 FROM (
 SELECT round(0.01*i,6)::DOUBLE AS threshold, round(f1,6) AS f1 FROM b WHERE cov>=0.9 AND least>=0.75 ORDER BY round(b.f1,12) DESC, round(risk,12), i DESC LIMIT 1) x""")
def a31(spark, root):
    lg = logits(spark, root).withColumn("q", F.lit(0.3) + F.lit(0.7) * F.col("q"))
    return M.fit_threshold(lg, F.col("w"), truth="label").select(r6("threshold", "threshold"), r6("f1", "f1"))


@query("a32_drift_threshold", sql=f"""
WITH {LOGITS}, s AS (SELECT 1.0::DOUBLE-q AS s, label, raw, w FROM lg), c AS (SELECT DISTINCT s AS t FROM s UNION SELECT 1.0::DOUBLE),
a AS (SELECT t, label, sum(w) tw, sum(w*(s<=t)::INT) aw, sum(w*(s<=t AND raw<>label)::INT) bw FROM s, c GROUP BY 1,2),
b AS (SELECT t, sum(aw)/sum(tw) cov, min(aw/tw) least, sum(bw)/nullif(sum(aw),0) risk FROM a GROUP BY 1)
SELECT round(t,6) AS threshold, round(risk,6) AS risk, round(cov,6) AS coverage FROM b WHERE cov>=0.9 AND least>=0.75 ORDER BY round(b.risk,12), round(b.cov,12) DESC, t LIMIT 1""")
def a32(spark, root):
    lg = logits(spark, root).withColumn("s", F.lit(1.0) - F.col("q"))
    return M.fit_drift(lg, "s", F.col("w"), truth="label").select(*[r6(c, c) for c in ("threshold", "risk", "coverage")])


@query("a33_class_weights", views="pred", sql=f"""
WITH {HEAD2}, c AS (SELECT truth AS label, sum(w) c FROM two GROUP BY 1), r AS (SELECT label, (SELECT sum(c) FROM c)/greatest(c,1) r FROM c)
SELECT label, round(r/(SELECT avg(r) FROM r),6) AS class_weight FROM r""")
def a33(spark, root):
    return M.class_weights(pred(spark, root), "truth", WT()).select("label", r6("class_weight", "class_weight"))


@query("w25_top2_margin", sql=f"""
WITH {LOGITS} SELECT vec_id, round(list_sort(z,'DESC')[1]::DOUBLE - list_sort(z,'DESC')[2]::DOUBLE,6) AS margin FROM lg""")
def w25(spark, root):
    return logits(spark, root).select("vec_id", r6(margin(F.transform("z", lambda x: x.cast("double"))), "margin"))


@query("x03_softmax", sql=f"""
WITH {LOGITS}, e AS (SELECT vec_id, list_transform(z, lambda v: exp((v::DOUBLE-list_max(z)::DOUBLE)/0.5)) e FROM lg),
u AS (SELECT vec_id, unnest(range(0,10)) AS pos, unnest(e)/list_sum(e) AS p FROM e) SELECT vec_id, pos, round(p,6) AS p FROM u""")
def x03(spark, root):
    return logits(spark, root).select("vec_id", F.posexplode(softmax("z", 0.5)).alias("pos", "p")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), r6("p", "p"))


@query("f11_evaluation", views="pred", sql=f"""
WITH {HEAD2},
f1 AS (SELECT avg(f) f FROM (SELECT l, 2*sum(w*(truth=l AND pred=l)::INT)/(sum(w*(truth=l)::INT)+sum(w*(pred=l)::INT)) f FROM two, (SELECT DISTINCT truth l FROM two) GROUP BY 1)),
f2 AS (SELECT avg(f) f FROM (SELECT l, 2*sum(w*(truth2=l AND pred2=l)::INT)/(sum(w*(truth2=l)::INT)+sum(w*(pred2=l)::INT)) f FROM two, (SELECT DISTINCT truth2 l FROM two) GROUP BY 1)),
e1 AS (SELECT sum(d)/sum(sw) e FROM (SELECT abs(sum(w*(truth=pred)::INT)-sum(w*q)) d, sum(w) sw FROM two GROUP BY least(floor(q*10),9))),
e2 AS (SELECT sum(d)/sum(sw) e FROM (SELECT abs(sum(w*(truth2=pred2)::INT)-sum(w*q)) d, sum(w) sw FROM two GROUP BY least(floor(q*10),9)))
SELECT round((SELECT f FROM f1),6) AS f1_1, round((SELECT f FROM f2),6) AS f1_2, round(sum(w*(truth=pred AND truth2=pred2)::INT)/sum(w),6) AS joint_accuracy,
 round(sum(w*(pred>=0)::INT)/sum(w),6) AS coverage_1, round(sum(w*(pred2>=0)::INT)/sum(w),6) AS coverage_2,
 round((SELECT e FROM e1),6) AS ece_1, round((SELECT e FROM e2),6) AS ece_2, CAST(NULL AS DOUBLE) AS p95_latency_ms, false AS meets_target FROM two""")
def f11(spark, root):
    from ..operators.evaluation import evaluation_row
    return evaluation_row(two_heads(spark, root), F.col("w"))


@query("d03_mergeable_metric", views="pred", sql="""
SELECT round(100.0*sum(CASE WHEN pred<>truth THEN 1 ELSE 0 END)/count(*),6) AS error_rate FROM pred""")
def d03(spark, root):
    return pred(spark, root).agg(M.error_rate((F.col("pred") != F.col("truth")).cast("bigint"), F.lit(1), "x")).select(r6("x", "error_rate"))
