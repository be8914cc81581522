"""Templates, event alignment, error rates and models."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.columns import r6, total
from ..operators import events as E
from ..operators import heads as H
from ..operators import matching as X
from ..operators import models as D
from ..operators import signal_jobs as J
from ..operators import templates as T
from ..operators.metrics import error_rate, fit_guard
from ..operators.ordered import micros
from .q_a_metrics import logits
from .q_f_folds import NAMES, class_frames
from .q_g_signal import CH, long_trials
from .registry import query
from .views import samples, table


def feature_frames(spark, root):
    return table(spark, root, "embeddings").select((F.col("vec_id") % 4).alias("session"), F.floor(F.col("vec_id") / 4).alias("frame"),
                                                   "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query("a39_global_template", sql="""
WITH u AS (SELECT vec_id%4 p, label g, unnest(range(0,64)) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT p, g, i, avg(x) m FROM u GROUP BY 1,2,3)
SELECT g AS label, i AS pos, round(avg(m),6) AS value, count(*) AS participants FROM m GROUP BY 1,2 HAVING count(*)>=2""")
def a39(spark, root):
    e = table(spark, root, "embeddings").select(
        (F.col("vec_id") % 4).alias("p"), "label", F.posexplode("embedding").alias("pos", "v"))
    d = T.global_template(e.select("p", "label", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("double").alias("v")), "p", "label", "pos", "v")
    return d.select("label", "pos", r6("value", "value"), "participants")


@query("a40_event_average", sql="""
WITH f AS (SELECT vec_id%4 s, vec_id//4 fr, label, embedding FROM embeddings), r AS (SELECT s, min(fr) lo, max(fr) hi FROM f GROUP BY 1),
e AS (SELECT f.s, label c, fr FROM f JOIN r USING (s) WHERE fr-2>=lo AND fr+2<=hi), n AS (SELECT s, c FROM e GROUP BY 1,2 HAVING count(*)>=3),
x AS (SELECT e.s, e.c, o.o, unnest(range(0,64)) i, unnest(g.embedding)::DOUBLE v FROM e JOIN n USING (s,c), range(-2,3) o(o), f g WHERE g.s=e.s AND g.fr=e.fr+o.o)
SELECT s AS session, c AS class, CAST(o AS INT) AS o, i AS pos, round(avg(v),6) AS value FROM x GROUP BY 1,2,3,4""")
def a40a(spark, root):
    f = feature_frames(spark, root)
    ev = f.select("session", F.col("label").alias("class"), F.col("frame").alias("center"))
    d = T.event_average(f, ev, "session", (-2, 2))
    return d.select("session", "class", "o", F.posexplode("tpl").alias("pos", "v")).select("session", "class", "o", F.col("pos").cast("bigint").alias("pos"), r6("v", "value"))


@query("a40_response_templates")
def a40b(spark, root):
    f = feature_frames(spark, root)
    ev = f.select("session", F.col("label").alias("class"), F.col("frame").alias("center"))
    d = T.fit_templates(f, ev, "session", (-2, 2))
    return d.select("session", "class", "o", r6(total(F.col("tpl")), "total"))


@query("w22_recenter", sql="""
WITH f AS (SELECT vec_id%4 s, label g, (vec_id//4)%21-10 o, embedding FROM embeddings), u AS (SELECT s, g, o, unnest(range(0,64)) i, unnest(embedding)::DOUBLE x FROM f), st AS (SELECT s, g, o, i, avg(x) x FROM u GROUP BY 1,2,3,4), rf AS (SELECT g, o, i, avg(x) y FROM u GROUP BY 1,2,3),
j AS (SELECT st.s, st.g, h.h, st.o, st.i, x, y FROM st, range(-5,6) h(h), rf WHERE rf.g=st.g AND rf.o=st.o-h.h AND rf.i=st.i), c AS (SELECT *, x-avg(x) OVER w xc, y-avg(y) OVER w yc FROM j WINDOW w AS (PARTITION BY s,g,h,i)),
k AS (SELECT s, g, h, sum(xc*yc)/(sqrt(sum(xc*xc))*sqrt(sum(yc*yc))) sc FROM c GROUP BY 1,2,3 HAVING count(DISTINCT o)>=3),
b AS (SELECT *, row_number() OVER (PARTITION BY s,g ORDER BY round(sc,12) DESC, h) r FROM k)
SELECT t.s AS session, t.g AS label, CAST(coalesce(b.h,0) AS INT) AS shift, round(b.sc,6) AS score FROM (SELECT DISTINCT s, g FROM st) t LEFT JOIN b ON b.s=t.s AND b.g=t.g AND r=1""")
def w22(spark, root):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    f = feature_frames(spark, root).select("session", "label", (F.col("frame") % 21 - 10).cast("int").alias("o"), "x")
    mean = lambda keys: f.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("x"))
    d = T.recenter(mean(["session", "label", "o"]), mean(["label", "o"]), ["session"], "label")
    return d.select("session", "label", "shift", F.round("score", 6).alias("score"))


def cue_events(spark, root):
    f = feature_frames(spark, root)
    return f, f.select("session", F.col("frame").alias("event_id"), F.col("label").alias("class"), F.col("frame").alias("cue"))


@query("f06_event_placement")
def f06(spark, root):
    f, ev = cue_events(spark, root)
    tpl = T.centre_templates(T.fit_templates(f, ev.withColumn("center", F.col("cue") + 2), "session", (-1, 1)), ["session", "class"])
    sc = T.score_own_session(ev, f, tpl, "session", 3, (1, 5))
    return T.place_events(sc, ev, "session", (1, 5), 1)


@query("f08_session_alignment")
def f08(spark, root):
    f, ev = cue_events(spark, root)
    d = T.align_sessions(f, ev, "session", offsets=(-1, 1), delays=(1, 5), first_delay=2, gap=1)
    return d.select("session", "event_id", "class", "delay", r6("best", "score"), r6("confidence", "confidence"), "boundary", "reasons", "converged")


def named_events(spark, root):
    from ..functions.labels import lookup
    s = samples(spark, root).select("trial_id", "n", (F.col("k") % 2).alias("side"), (micros("ts") / F.lit(1e6) / 36_000.0).alias("t"), "event_type", "k")
    name = lookup(NAMES, F.col("event_type"))
    # every sample is a label; predictions are delayed copies, some renamed or missing
    g = s.select("trial_id", name.alias("name"), "t")
    p = s.where("k % 6 <> 0").select("trial_id", F.when(F.col("k") % 10 == 1, "thumb_up").otherwise(name).alias("name"), (F.col("t") + F.col("k") / 1000.0).alias("t"))
    return p, g


@query("f07_event_alignment")
def f07(spark, root):
    p, g = named_events(spark, root)
    return X.confusion(p, g, "trial_id").groupBy("truth", "pred").agg(F.sum("n").alias("n"))


@query("a43_cler")
def a43(spark, root):
    p, g = named_events(spark, root)
    return X.cler(X.confusion(p, g, "trial_id").groupBy("truth", "pred").agg(F.sum("n").alias("n"))).select(r6("cler", "cler"))


@query("a43_cler_of_confusion", views="pred", sql="""
WITH c AS (SELECT CAST(truth AS VARCHAR) t, CASE WHEN pred>=0 THEN CAST(pred AS VARCHAR) END p, count(*) n FROM pred GROUP BY 1,2),
e AS (SELECT t, 1-sum(CASE WHEN t=p THEN n ELSE 0 END)/sum(n) e FROM c WHERE p IN (SELECT t FROM c) GROUP BY 1) SELECT round(avg(e),6) AS cler FROM e""")
def a43c(spark, root):
    return X.cler(pred_conf(spark, root)).select(r6("cler", "cler"))


@query("a44_mean_fnr", views="pred", sql="""
WITH c AS (SELECT truth t, sum((truth=pred)::INT) c, count(*) n FROM pred GROUP BY 1) SELECT round(avg(1-c/n::DOUBLE),6) AS mean_fnr FROM c""")
def a44(spark, root):
    return X.mean_fnr(pred_conf(spark, root)).select(r6("mean_fnr", "mean_fnr"))


def pred_conf(spark, root):
    from .views import pred
    p = pred(spark, root).select(F.col("truth").cast("string").alias("truth"), F.when(F.col("pred") >= 0, F.col("pred").cast("string")).alias("pred"))
    return p.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


SWEEP_FREE = "list_sort(list_filter(list_transform(range(1, len(x.tr)+1), lambda i: {'d': abs(x.t-x.tr[i]), 'i': i}), lambda s: s.d<=2 AND NOT list_contains(a.used, s.i)))[1]"


@query("a42_threshold_sweep", views="samples", sql="""
WITH pr AS (SELECT trial_id, n, unnest(['index_press','index_release','thumb_up']) cls, unnest([k/100.0, ((k*7)%100)/100.0, ((k*13+n)%100)/100.0]) p FROM samples),
w AS (SELECT *, lag(p) OVER (PARTITION BY trial_id, cls ORDER BY n) q FROM pr), th AS (SELECT unnest([0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9]::DOUBLE[]) t),
pd AS (SELECT trial_id, cls, t AS th, n FROM w, th WHERE t<=p AND (q IS NULL OR t>q)), go AS (SELECT trial_id, CASE WHEN k%2=0 THEN 'index_press' ELSE 'thumb_up' END cls, n FROM samples WHERE k%9=0),
tr AS (SELECT trial_id, cls, list(n ORDER BY n) tr FROM go GROUP BY 1,2),
li AS (SELECT p.trial_id, p.cls, p.th, list({'t': p.n, 'tr': coalesce(tr.tr, CAST([] AS BIGINT[])), 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])} ORDER BY p.n) l
 FROM pd p LEFT JOIN tr ON tr.trial_id=p.trial_id AND tr.cls=p.cls GROUP BY 1,2,3),
fo AS (SELECT cls, th, list_reduce(l, lambda a, x: {'t': x.t, 'tr': x.tr, 'used': CASE WHEN FREE IS NULL THEN a.used ELSE list_append(a.used, FREE.i) END,
  'out': list_append(a.out, x.tr[FREE.i])}, {'t': NULL, 'tr': NULL, 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])}) r FROM li),
m AS (SELECT cls, th, count(q) tp, count(*)-count(q) fp FROM (SELECT cls, th, unnest(r.out) q FROM fo) x GROUP BY 1,2),
n AS (SELECT cls, th.t AS th, c FROM (SELECT cls, count(*) c FROM go GROUP BY 1) g, th),
f AS (SELECT coalesce(m.cls,n.cls) cls, coalesce(m.th,n.th) th, coalesce(tp,0) tp, coalesce(fp,0) fp, coalesce(c,0)-coalesce(tp,0) fn FROM m FULL JOIN n ON m.cls=n.cls AND m.th=n.th),
v AS (SELECT *, round(2*tp/greatest(1e-12, 2*tp+fp+fn)::DOUBLE, 12) f1 FROM f)
SELECT cls, round(th,6) AS threshold, round(f1,6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, th) r FROM v) x WHERE r=1""".replace("FREE", f"({SWEEP_FREE})"))
def a42(spark, root):
    fr = class_frames(spark, root).select("trial_id", "cls", "n", "p")
    truth = samples(spark, root).where("k % 9 = 0").select("trial_id", F.when(F.col("k") % 2 == 0, "index_press").otherwise("thumb_up").alias("cls"), F.col("n").alias("t"))
    c = X.sweep(fr, truth, "trial_id", "cls", "n", "p", [round(0.10 + 0.05 * i, 2) for i in range(17)], 2)
    return X.best_thresholds(c, "cls").select("cls", r6("threshold", "threshold"), r6("f1", "f1"))


def turns(spark, root):
    # one sign per character outside printable ASCII, as the SQL engine counts bytes
    c = table(spark, root, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return c.join(nxt, ["conv_id", "turn"])


@query("a45_char_error_rate", sql="""
WITH c AS (SELECT conv_id, turn, regexp_replace(text,'[^ -~]','?','g') AS text FROM conversations)
SELECT a.conv_id, round(100.0*sum(levenshtein(a.text, b.text))/sum(length(b.text)),6) AS cer FROM c a JOIN c b ON b.conv_id=a.conv_id AND b.turn=a.turn+1 GROUP BY 1""")
def a45(spark, root):
    return turns(spark, root).groupBy("conv_id").agg(error_rate(F.levenshtein("text", "target"), F.length("target"), "x")).select("conv_id", r6("x", "cer"))


@query("a45_edit_split")
def a45b(spark, root):
    d = turns(spark, root).withColumn("e", X.edit_split("text", "target"))
    n = F.length("target")
    return d.agg(*[r6(error_rate(F.col(f"e.{c}"), n, "x"), name) for c, name in (("insertions", "ier"), ("deletions", "der"), ("replacements", "ser"))])


@query("a47_proxy_accuracy", views="samples", sql="""
WITH pr AS (SELECT trial_id, n, unnest([0,1,2]) o, unnest([k/100.0, ((k*7)%100)/100.0, ((k*13+n)%100)/100.0]) p FROM samples), e AS (SELECT trial_id, event_id, n, k%3 truth FROM samples WHERE event_type='signup'),
h AS (SELECT e.event_id, truth, o, row_number() OVER (PARTITION BY e.event_id ORDER BY p DESC, pr.n, o) r FROM e JOIN pr ON pr.trial_id=e.trial_id AND pr.n>=e.n-2 AND pr.n<e.n+6),
a AS (SELECT truth, avg((truth=o)::INT) a, count(*) c FROM h WHERE r=1 GROUP BY 1) SELECT round(avg(a),6) AS accuracy, CAST(sum(c) AS BIGINT) AS onsets FROM a""")
def a47(spark, root):
    on = samples(spark, root).where("event_type = 'signup'").select("trial_id", "event_id", F.col("n").alias("at"), (F.col("k") % 3).alias("truth"))
    d = X.proxy_accuracy(class_frames(spark, root), on, ["trial_id"], "n", 2, 6, "event_id")
    return d.select(r6("accuracy", "accuracy"), "onsets")


@query("a55_two_heads")
def a55(spark, root):
    e = logits(spark, root).select("vec_id", "label", (F.col("label") % 4).alias("hand"), F.slice("embedding", 1, 32).alias("imu"), F.slice("embedding", 33, 32).alias("emg"), "w")
    out = None
    for head, feat, lab in (("direction", "imu", "label"), ("gesture", "emg", "hand")):
        # the split of P1: sessions 1 and 2 train, session 4 tests
        m = D.fit_head(e.where("vec_id % 4 < 2"), feat, lab, F.col("w"))
        d = D.head_logits(e.where("vec_id % 4 = 3"), m, feat, "z").withColumn("guess", F.array_position("z", F.array_max("z")) - 1)
        a = d.groupBy(F.col(lab).alias("label")).agg(r6(F.avg((F.col("guess") == F.col(lab)).cast("double")), "accuracy")).withColumn("head", F.lit(head))
        out = a if out is None else out.unionByName(a)
    return out


@query("a55_kernel_heads")
def a55k(spark, root):
    """The kernel machine and the linear discriminants of both heads, trained on sessions 1 and 2, on session 4."""
    e = table(spark, root, "embeddings").select("vec_id", "label", (F.col("label") % 4).alias("hand"), F.slice("embedding", 1, 32).alias("imu"), F.slice("embedding", 33, 32).alias("emg"))
    out = None
    for head, feat, lab in (("direction", "imu", "label"), ("gesture", "emg", "hand")):
        train, test = e.where("vec_id % 4 < 2"), e.where("vec_id % 4 = 3")
        for kind, m in (("kernel", H.fit_kernel_head(train, feat, lab, lift=H.Fourier(128, 0.05))), ("discriminant", H.fit_discriminant(train, feat, lab))):
            d = m.logits(test, feat, "z").withColumn("guess", F.array_position("z", F.array_max("z")) - 1)
            a = d.groupBy(F.col(lab).alias("label")).agg(r6(F.avg((F.col("guess") == F.col(lab)).cast("double")), "accuracy")).withColumns({"head": F.lit(head), "kind": F.lit(kind)})
            out = a if out is None else out.unionByName(a)
    return out


@query("a55_discriminant_moments", sql="""
WITH e AS (SELECT vec_id, label, unnest(range(1,17)) i, unnest(embedding[1:16])::DOUBLE x FROM embeddings), m AS (SELECT label, i, avg(x) m, count(*) n FROM e GROUP BY 1,2),
c AS (SELECT e.vec_id, e.i, x-m AS y FROM e JOIN m ON m.label=e.label AND m.i=e.i), f AS (SELECT count(*)-count(DISTINCT label) f FROM embeddings)
SELECT 'mean' AS part, CAST(label AS INT) AS a, CAST(i-1 AS INT) AS b, round(m,6) AS value FROM m
UNION ALL SELECT 'covariance', CAST(p.i-1 AS INT), CAST(q.i-1 AS INT), round(sum(p.y*q.y)/any_value(f),6) FROM c p JOIN c q ON p.vec_id=q.vec_id, f GROUP BY p.i, q.i""")
def a55m(spark, root):
    e = table(spark, root, "embeddings").select("label", F.slice("embedding", 1, 16).alias("x"))
    means, cov = H.moments(e, "x", "label")
    own = means.select(F.lit("mean").alias("part"), F.col("label").cast("int").alias("a"), F.posexplode("mean").alias("b", "value"))
    return own.select("part", "a", "b", r6("value", "value")).unionByName(cov.select(F.lit("covariance").alias("part"), F.col("i").alias("a"), F.col("j").alias("b"), r6("value", "value")))


@query("a56_session_bias")
def a56(spark, root):
    e = logits(spark, root).select((F.col("vec_id") % 4).alias("session"), "z", "label")
    d = D.fit_bias(e, "session", "z", "label", 10)
    return d.select("session", F.posexplode("bias").alias("class", "b")).select("session", "class", r6("b", "bias"))


@query("f09_scoring")
def f09(spark, root):
    lg = logits(spark, root).select("vec_id", (F.col("vec_id") % 4).alias("session_no"), "label", "z", "embedding", "w")
    guard = fit_guard(lg, "vec_id", "label", "embedding", F.col("w"))
    d = D.score(lg, "z", "embedding", guard, temperature=0.1, threshold=0.2, drift_limit=0.9)
    return d.select("vec_id", "pred", "raw", r6("q", "q"), r6("margin", "margin"), r6("drift", "drift"), "confidence_rejected", "drift_rejected")


def rms_model(pos, x):
    """A supplied model: squashed trailing energy per channel, every 4th sample after 8 samples of context."""
    e = np.cumsum(np.vstack([np.zeros((1, x.shape[1])), x * x]), axis=0)
    at = np.flatnonzero((np.arange(len(x)) >= 8) & (pos % 4 == 0))
    p = 1 / (1 + np.exp(-(np.sqrt(np.maximum(e[at + 1] - e[at - 7], 0) / 8) - 45) / 10))
    return pd.DataFrame({"n": pos[at], **{f"p{i}": p[:, i] for i in range(x.shape[1])}})


def replay_frames(spark, root, rows):
    d = J.overlap_map(long_trials(spark, root), ["trial"], "n", CH, rows, 8, 0, rms_model, "n bigint, p0 double, p1 double, p2 double, p3 double")
    ps = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(i).alias("o"), F.round(f"p{i}", 9).alias("p")) for i, c in enumerate(("index_press", "index_release", "thumb_up", "thumb_in"))])
    return d.select("trial", "n", F.explode(ps).alias("f")).select("trial", "n", "f.*")


@query("f10_replay")
def f10(spark, root):
    fr = replay_frames(spark, root, 16_000).withColumn("slot", F.floor(F.col("n") / 65_536))
    return E.threshold_events(fr, ["trial"], "n", "cls", "p", F.lit(0.5), 12, levels=[["slot"]], order_of=F.col("o"))


@query("d01_model_callable", sql="""
SELECT vec_id, CAST(list_position(e, list_max(e))-1 AS INT) AS guess, round(list_max(e)::DOUBLE,6) AS q FROM (SELECT vec_id, embedding[1:10] AS e FROM embeddings) x""")
def d01(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", "embedding")

    def fn(pdf):
        z = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "guess": z[:, :10].argmax(axis=1), "q": z[:, :10].max(axis=1)})
    return D.apply_model(e, fn, "vec_id bigint, guess int, q double").select("vec_id", "guess", r6("q", "q"))


@query("d02_row_transform", views="samples", sql="SELECT trial_id, n, round(c0*2,6) AS y FROM samples WHERE k>=50")
def d02(spark, root):
    user = lambda df: df.where("k >= 50").select("trial_id", "n", r6(F.col("c0") * 2, "y"))
    return samples(spark, root).transform(user)
