"""Signal transforms."""

from pyspark.sql import functions as F

from ..functions.columns import r6, total
from ..functions.filters import resample_taps
from ..operators import signal_jobs as J
from ..operators.linking import snippets
from ..operators.ordered import block, number_rows, time_slot
from .registry import query
from .views import samples, table

CH = ("c0", "c1", "c2", "c3")
TAPS, HALF = resample_taps(4, 5)


def long_trials(spark, root):
    """Four long trials (sessions) instead of many short ones."""
    e = table(spark, root, "events").select((F.col("user_id") % 4).alias("trial"), "ts", "event_id", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
                                            time_slot("ts", 86_400).alias("slot"))
    e = number_rows(e, ["trial"], ["ts", "event_id"], "n", [["slot"]])
    v = F.col("value") - 50.0
    return e.select("trial", "n", block("n", 1024).alias("blk"), v.alias("c0"), (v * (F.col("k") % 7 - 3) / 3.0).alias("c1"),
                    (v * (F.col("k") % 5 - 2) / 2.0).alias("c2"), (F.col("k").cast("double") - 50.0).alias("c3"))


@query("f01_bandpass")
def f01(spark, root):
    d = J.causal_filter(long_trials(spark, root), ["trial"], "n", "blk", CH, 200.0, use_notch=True)
    return d.select("trial", "n", *[r6(c, c) for c in CH])


@query("f02_zero_phase")
def f02(spark, root):
    return J.zero_phase(long_trials(spark, root), ["trial"], "n", CH, 250.0, rows=4096).select("trial", "n", *[r6(c, c) for c in CH])


@query("f03_resample", views="samples", sql=f"""
WITH t AS (SELECT [{','.join(repr(float(x)) for x in TAPS)}]::DOUBLE[] h), m AS (SELECT trial_id, count(*) c FROM samples GROUP BY 1), o AS (SELECT trial_id, unnest(range(0, CAST(ceil(c*4/5.0) AS BIGINT))) i FROM m)
SELECT o.trial_id, o.i, round(sum(s.c0*h[o.i*5-s.n*4+{HALF}+1]),6) AS y FROM t, o JOIN samples s ON s.trial_id=o.trial_id AND abs(o.i*5-s.n*4)<={HALF} GROUP BY 1,2""")
def f03(spark, root):
    return J.resample(samples(spark, root), ["trial_id"], "n", "c0", 250.0, 200.0).select("trial_id", "i", r6("y", "y"))


@query("f04_spectral_features")
def f04(spark, root):
    d = J.spectral_features(long_trials(spark, root), ["trial"], "n", CH, frames_per_block=512)
    return d.select("trial", "frame", "last_n", F.size("features").alias("width"), r6(total(F.col("features")), "total"))


@query("f05_fixed_lag")
def f05(spark, root):
    d = J.fixed_lag(long_trials(spark, root), ["trial"], "n", ("c0", "c1"), 250.0, 16.0, buffer=100, window=50, lag=10, hop=50)
    return d.select("trial", "j", "last_n", F.size("c0").alias("rows"), r6(total(F.transform("c0", F.abs)), "level"))


@query("f13_review_envelope")
def f13(spark, root):
    s = samples(spark, root)
    ev = s.where("event_type = 'signup'").select("trial_id", "event_id", F.col("n").alias("at"))
    sn = snippets(s.select("trial_id", "n", *CH), ev, ["trial_id"], "n", "at", 12, 20, 64)
    return J.review_envelope(sn, ["trial_id", "event_id"], "offset", CH, 200.0).select("trial_id", "event_id", "offset", r6("activity", "activity"))


@query("f14_examples", views="samples", sql="""
WITH p AS (SELECT trial_id, event_id, n-3 a, n+2+4 b FROM samples WHERE event_type='signup'), g AS (SELECT trial_id, event_id, a, b, unnest(range(a,b)) i FROM p)
SELECT g.trial_id, g.event_id, any_value(b-a) AS length, round(sum(coalesce(c0,0)*(i-a+1)),6) AS weighted, count(*) FILTER (WHERE c0 IS NULL OR c0=0) AS zeros FROM g LEFT JOIN samples s ON s.trial_id=g.trial_id AND s.n=i GROUP BY 1,2""")
def f14(spark, root):
    s = samples(spark, root)
    p = s.where("event_type = 'signup'").select("trial_id", "event_id", F.col("n").alias("a"), (F.col("n") + 2).alias("b"))
    d = J.examples(s, p, ["trial_id"], "n", "c0", "a", "b", 3, 4, "event_id", 64)
    return d.select("trial_id", "event_id", "length", r6(total(F.transform("x", lambda v, i: v * (i + 1))), "weighted"),
                    F.size(F.filter("x", lambda v: v == 0)).cast("bigint").alias("zeros"))
