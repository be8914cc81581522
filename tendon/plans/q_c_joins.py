"""Join operators."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.labels import split_of
from ..operators import joins as J
from ..operators import linking as L
from ..operators.ordered import micros
from .q_b_ordered import BLK, day
from .registry import query
from .views import cues, pred, samples, table, trials

HOUR = 3_600_000_000


@query("j01_calibration_join", views="pred", sql="""
WITH c AS (SELECT session_no, max(q) AS scale FROM pred WHERE session_no<4 GROUP BY 1)
SELECT p.session_no, count(*) AS rows, round(max(c.scale),6) AS scale, count(c.session_no)=0 AS missing FROM pred p LEFT JOIN c USING (session_no) GROUP BY 1""")
def j01(spark, root):
    p = pred(spark, root)
    cal = p.where("session_no < 4").groupBy("session_no").agg(F.max("q").alias("scale"))
    rows, missing = L.join_calibration(p, cal, "session_no")
    good = rows.groupBy("session_no").agg(F.count(F.lit(1)).alias("rows"), r6(F.max("scale"), "scale"), F.lit(False).alias("missing"))
    bad = p.join(J.small(missing), "session_no").groupBy("session_no").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("scale"), F.lit(True).alias("missing"))
    return good.unionByName(bad)


@query("j02_trial_cues", views="trials cues", sql="""
SELECT t.trial_id, t.label, max_by(CASE WHEN c.name LIKE 'arm:%' THEN c.name END, CASE WHEN c.name LIKE 'arm:%' THEN (cue_no,cue_ts,c.name) END) AS arm_last,
 max_by(CASE WHEN c.name LIKE 'hand:%' THEN c.name END, CASE WHEN c.name LIKE 'hand:%' THEN (cue_no,cue_ts,c.name) END) AS hand_last,
 min_by(CASE WHEN c.name LIKE 'arm:%' THEN c.name END, CASE WHEN c.name LIKE 'arm:%' THEN (cue_no,cue_ts,c.name) END) AS arm_first,
 min_by(CASE WHEN c.name LIKE 'hand:%' THEN c.name END, CASE WHEN c.name LIKE 'hand:%' THEN (cue_no,cue_ts,c.name) END) AS hand_first
FROM trials t JOIN cues c USING (trial_id) GROUP BY 1,2""")
def j02(spark, root):
    c = L.cue_columns(cues(spark, root))
    return trials(spark, root).select("trial_id", "label").join(c, "trial_id").select(
        "trial_id", "label", *[F.col(f"{x}.name").alias(x) for x in ("arm_last", "hand_last", "arm_first", "hand_first")])


@query("j03_missing_cues", views="trials cues", sql="""
SELECT trial_id, 'arm' AS missing FROM trials t WHERE valid AND NOT EXISTS (SELECT 1 FROM cues c WHERE c.trial_id=t.trial_id AND c.name LIKE 'arm:%')
UNION ALL SELECT trial_id, 'hand' FROM trials t WHERE valid AND NOT EXISTS (SELECT 1 FROM cues c WHERE c.trial_id=t.trial_id AND c.name LIKE 'hand:%')""")
def j03(spark, root):
    return L.missing_cues(trials(spark, root), cues(spark, root))


@query("j04_interval_join", views="samples", sql="""
SELECT s.trial_id, p.event_id AS span_id, s.n FROM samples s JOIN samples p ON p.trial_id=s.trial_id AND p.event_type='signup' AND s.t_ms>=p.t_ms AND s.t_ms<p.t_ms+17""")
def j04(spark, root):
    s = samples(spark, root)
    spans = s.where("event_type = 'signup'").select("trial_id", F.col("event_id").alias("span_id"), F.col("t_ms").alias("a"),
                                                    (F.col("t_ms") + 17).alias("b"))
    return J.interval_join(s.select("trial_id", "t_ms", "n"), spans, ["trial_id"], "t_ms", "a", "b", 100).select("trial_id", "span_id", "n")


@query("j05_audit_mask", sql="""
WITH e AS (SELECT user_id%4+1 AS session_no, event_id, event_id*4.0 AS recv, event_id*4.0+1 AS t, CASE WHEN event_id%50=0 THEN 2 ELSE 0 END lost, event_id%77=0 dup, event_id%91=0 late FROM events)
SELECT DISTINCT s.session_no, s.event_id FROM e s JOIN e a ON a.session_no=s.session_no AND (a.lost>0 OR a.dup OR a.late)
 AND s.t>=a.recv-greatest(a.lost,1)*4-2 AND s.t<=a.recv+2""")
def j05(spark, root):
    e = table(spark, root, "events").select((F.col("user_id") % 4 + 1).alias("session_no"), "event_id", (F.col("event_id") * 4.0).alias("recv"))
    s = e.select("session_no", "event_id", (F.col("recv") + 1).alias("t"))
    audit = e.select("session_no", "recv", F.when(F.col("event_id") % 50 == 0, 2).otherwise(0).alias("lost"),
                     (F.col("event_id") % 77 == 0).alias("duplicate"), (F.col("event_id") % 91 == 0).alias("late"))
    return L.audit_mask(s, audit, ["session_no"], "t", 4.0).select("session_no", "event_id")


def two_streams(spark, root, a, b):
    s = samples(spark, root).select("trial_id", "event_id", "event_type", "c0", micros("ts").alias("us"))
    return (s.where(F.col("event_type") == a).select("trial_id", "event_id", "us"),
            s.where(F.col("event_type") == b).select("trial_id", "us", "c0"), F.floor(F.col("us") / (24 * HOUR)))


@query("j06_asof_linear", views="samples", sql="""
WITH f AS (SELECT trial_id, event_id, epoch_us(ts) us FROM samples WHERE event_type='click'), s AS (SELECT trial_id, epoch_us(ts) us, c0 FROM samples WHERE event_type='view'),
p AS (SELECT f.*, s.us pt, s.c0 pv FROM f ASOF LEFT JOIN s ON f.trial_id=s.trial_id AND f.us>=s.us),
n AS (SELECT p.*, s.us nt, s.c0 nv FROM p ASOF LEFT JOIN s ON p.trial_id=s.trial_id AND p.us<s.us),
g AS (SELECT *, least(us-pt, nt-us) gap FROM n)
SELECT trial_id, event_id, round(CASE WHEN pt=us THEN pv WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv ELSE pv+(nv-pv)*((us-pt)::DOUBLE/(nt-pt)) END,6) AS aligned,
 coalesce(pt IS NOT NULL AND (pt=us OR nt IS NOT NULL) AND gap<=21600000000,false) AS valid, gap>250 AS interpolated FROM g""")
def j06(spark, root):
    f, s, slot = two_streams(spark, root, "click", "view")
    return J.align_linear(f, s, ["trial_id"], "us", "c0", slot, 6 * HOUR, 250).select(
        "trial_id", "event_id", F.round("aligned", 6).alias("aligned"), "valid", "interpolated")


@query("j07_nearest_frame", views="samples", sql="""
WITH f AS (SELECT trial_id, event_id, epoch_us(ts) us FROM samples WHERE event_type='purchase'), s AS (SELECT trial_id, epoch_us(ts) us, c0 FROM samples WHERE event_type='click')
SELECT trial_id, event_id, near_us, round(near_c0,6) AS near_c0 FROM (SELECT f.trial_id, f.event_id, s.us AS near_us, s.c0 AS near_c0,
 row_number() OVER (PARTITION BY f.trial_id, f.event_id ORDER BY abs(f.us-s.us), s.us) r FROM f JOIN s USING (trial_id)) WHERE r=1""")
def j07(spark, root):
    f, s, slot = two_streams(spark, root, "purchase", "click")
    return J.nearest(f, s, ["trial_id"], "us", "c0", slot).where("near_t IS NOT NULL").select(
        "trial_id", "event_id", F.col("near_t").cast("bigint").alias("near_us"), F.round("near_v", 6).alias("near_c0"))


@query("j08_pulse_targets", views="samples", sql="""
SELECT f.trial_id, f.n*20 AS t, max((e.event_type='signup')::INT) AS is_signup, max((e.event_type='purchase')::INT) AS is_purchase FROM
 (SELECT f.*, e.event_type et FROM samples f LEFT JOIN samples e ON e.trial_id=f.trial_id AND e.event_type IN ('signup','purchase') AND f.n*20>=e.n*20+80 AND f.n*20<e.n*20+120) f,
 LATERAL (SELECT coalesce(f.et,'') AS event_type) e GROUP BY 1,2""")
def j08(spark, root):
    s = samples(spark, root).withColumn("t", F.col("n") * 20)
    ev = s.where("event_type IN ('signup','purchase')").select("trial_id", F.col("t").alias("at"), F.col("event_type").alias("class"))
    return L.active_frames(s.select("trial_id", "t"), L.pulse_spans(ev, "at", 80, 120), ["trial_id"], "t", "from_t", "to_t",
                           ("signup", "purchase"), 1000)


@query("j09_label_targets", views="samples", sql="""
SELECT f.trial_id, f.n*20 AS t, max((e.event_type='signup')::INT) AS is_signup, max((e.event_type='purchase')::INT) AS is_purchase FROM
 (SELECT f.*, e.event_type et FROM samples f LEFT JOIN samples e ON e.trial_id=f.trial_id AND e.event_type IN ('signup','purchase')
   AND abs(f.n*20-(e.n*20+CASE WHEN e.event_type='signup' THEN 100 ELSE 0 END))<=20) f,
 LATERAL (SELECT coalesce(f.et,'') AS event_type) e GROUP BY 1,2""")
def j09(spark, root):
    s = samples(spark, root).withColumn("t", F.col("n") * 20)
    ev = s.where("event_type IN ('signup','purchase')").select(
        "trial_id", F.col("t").alias("at"), F.col("event_type").alias("class"),
        F.when(F.col("event_type") == "signup", "cue").otherwise("onset").alias("ref"))
    return L.active_frames(s.select("trial_id", "t"), L.shifted_spans(ev, "at", "ref"), ["trial_id"], "t", "from_t", "to_t",
                           ("signup", "purchase"), 1000, closed=True)


@query("j11_first_stable", views="samples", sql="""
WITH o AS (SELECT trial_id, event_id, epoch_us(ts) us, k%3 target FROM samples WHERE event_type='purchase'), s AS (SELECT trial_id, epoch_us(ts) us, k%3 label FROM samples WHERE event_type='click')
SELECT o.trial_id, o.event_id, min(s.us-o.us) AS latency FROM o LEFT JOIN s ON s.trial_id=o.trial_id AND s.us>=o.us AND s.us<=o.us+86400000000 AND label=target GROUP BY 1,2""")
def j11(spark, root):
    s = samples(spark, root).select("trial_id", "event_id", "event_type", (F.col("k") % 3).alias("label"), micros("ts").alias("us"))
    onsets = s.where("event_type = 'purchase'").select("trial_id", "event_id", F.col("us").alias("onset"), F.col("label").alias("target"))
    return L.first_stable(s.where("event_type = 'click'"), onsets, ["trial_id"], "us", "onset", "label", "target", 24 * HOUR, "event_id")


@query("j12_next_release", views="samples", sql="""
WITH x AS (SELECT *, epoch_us(ts) us, first_value(CASE WHEN event_type='purchase' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) r FROM samples)
SELECT trial_id, n, r AS release_us, coalesce(r-us>=43200000000,false) AS held FROM x WHERE event_type='signup'""")
def j12(spark, root):
    s = samples(spark, root).withColumn("us", micros("ts"))
    return L.next_release(s, ["trial_id"], ["n"], "us", F.col("event_type") == "signup", F.col("event_type") == "purchase",
                          12 * HOUR, BLK).select("trial_id", "n", F.col("release_t").alias("release_us"), "held")


@query("j13_press_mask", views="samples", sql="""
WITH p AS (SELECT a.trial_id, a.n, coalesce((SELECT min(r.n)+2 FROM samples r WHERE r.trial_id=a.trial_id AND r.event_type='purchase' AND r.n>a.n), 1000000000) u FROM samples a WHERE a.event_type='signup')
SELECT s.trial_id, s.n, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.trial_id=s.trial_id AND s.n>=p.n AND s.n<p.u) THEN 1 ELSE 0 END AS mask FROM samples s""")
def j13(spark, root):
    return L.press_mask(samples(spark, root), ["trial_id"], "n", F.col("event_type") == "signup", F.col("event_type") == "purchase", 2, BLK) \
        .select("trial_id", "n", "mask")


@query("j14_count_gap", views="trials", sql="""
WITH p AS (SELECT label, 100000::BIGINT AS expected FROM (SELECT DISTINCT label FROM trials) UNION ALL SELECT '9-EXTRA', 3),
h AS (SELECT label, count(*) h FROM trials WHERE valid GROUP BY 1)
SELECT p.label, expected, coalesce(h,0) AS have, greatest(expected-coalesce(h,0),0) AS shortfall FROM p LEFT JOIN h USING (label)""")
def j14(spark, root):
    t = trials(spark, root)
    extra = spark.createDataFrame([("9-EXTRA", 3)], "label string, expected bigint")
    protocol = t.select("label").distinct().withColumn("expected", F.lit(100_000).cast("bigint")).unionByName(extra)
    return L.count_gap(t, protocol)


@query("j15_leakage", views="pred", sql="""
WITH s AS (SELECT *, CASE WHEN vec_id%97<70 THEN 'train' ELSE 'validation' END split FROM pred)
SELECT 'group_in_several_splits' AS rule, CAST(trial_id AS VARCHAR) AS subject, string_agg(DISTINCT split, ',' ORDER BY split) AS detail FROM s GROUP BY trial_id HAVING count(DISTINCT split)>1
UNION ALL SELECT 'empty_split', v, '' FROM (VALUES ('train'),('validation'),('test')) x(v) WHERE v NOT IN (SELECT split FROM s)""")
def j15(spark, root):
    p = pred(spark, root).withColumn("split", F.when(F.col("vec_id") % 97 < 70, "train").otherwise("validation"))
    return L.leakage(p, "trial_id", "split")


REVIEW_SQL = """rv AS (SELECT l_orderkey trial_id, l_linenumber event_no, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'manually_adjusted' ELSE 'rejected' END status, l_suppkey*10 idx, row_number() OVER () rid FROM lineitem)"""


def reviews(spark, root):
    li = table(spark, root, "lineitem")
    status = (F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "N", "manually_adjusted").otherwise("rejected"))
    return li.select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("event_no"), status.alias("status"),
                     (F.col("l_suppkey") * 10).alias("index"))


@query("j16_reviewed_prompts", sql=f"""
WITH {REVIEW_SQL}, k AS (SELECT *, bool_and(status<>'rejected') OVER (PARTITION BY trial_id) ok FROM rv)
SELECT k.trial_id, k.event_no, l.l_returnflag AS name, k.idx AS reviewed_index FROM k JOIN lineitem l ON l.l_orderkey=k.trial_id AND l.l_linenumber=k.event_no WHERE ok""")
def j16(spark, root):
    ev = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("event_no"),
                                               F.col("l_returnflag").alias("name"))
    return L.reviewed_prompts(ev, reviews(spark, root), ("accepted", "manually_adjusted")).select(
        "trial_id", "event_no", "name", F.col("index").alias("reviewed_index"))


@query("j17_review_update", sql=f"""
WITH {REVIEW_SQL}, c AS (SELECT o_orderkey trial_id, 1 event_no, 'rejected' status, 999999::BIGINT idx, 2 no FROM orders WHERE o_orderkey%5=0
 UNION ALL SELECT o_orderkey, 1, 'accepted', -5, 3 FROM orders WHERE o_orderkey%10=0 UNION ALL SELECT o_orderkey, NULL, 'rejected', NULL, 1 FROM orders WHERE o_orderkey%7=0),
x AS (SELECT rv.*, c.status cs, c.idx ci, c.no, c.event_no ce FROM rv LEFT JOIN c ON c.trial_id=rv.trial_id AND (c.event_no IS NULL OR c.event_no=rv.event_no))
SELECT trial_id, event_no, coalesce(max_by(cs,no), any_value(status)) AS status, least(greatest(coalesce(max_by(ci,no) FILTER (WHERE ce IS NOT NULL), any_value(idx)),0),99999) AS "index" FROM x GROUP BY trial_id, event_no, rid""")
def j17(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("trial_id"))
    make = lambda m, ev, st, ix, no: o.where(F.col("trial_id") % m == 0).select(
        "trial_id", F.lit(ev).cast("int").alias("event_no"), F.lit(st).alias("status"), F.lit(ix).cast("bigint").alias("index"),
        F.lit(no).alias("change_no"))
    changes = make(5, 1, "rejected", 999_999, 2).unionByName(make(10, 1, "accepted", -5, 3)).unionByName(make(7, None, "rejected", None, 1))
    return L.apply_reviews(reviews(spark, root), changes, 100_000)


@query("j18_prerequisites", sql="""
WITH h AS (SELECT DISTINCT o_custkey p, o_orderkey%4+1 s FROM orders), r AS (SELECT * FROM (VALUES (3,2),(4,1),(4,2),(4,3)) v(s,need))
SELECT h.p AS participant, CAST(h.s AS INT) AS session, string_agg(CAST(need AS VARCHAR), ',' ORDER BY need) AS missing FROM h JOIN r ON r.s=h.s
 WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.p=h.p AND x.s=r.need) GROUP BY 1,2""")
def j18(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("participant"), (F.col("o_orderkey") % 4 + 1).alias("s"))
    return L.prerequisites(o, "participant", "s")


@query("j19_inventory_diff", sql="""
WITH l AS (SELECT doc_id p, sha256(text) h FROM documents), r AS (SELECT doc_id p, sha256(text || CASE WHEN doc_id%7=0 THEN 'x' ELSE '' END) h FROM documents WHERE doc_id%5<>0
 UNION ALL SELECT doc_id+100000000, sha256(text) FROM documents WHERE doc_id%11=0)
SELECT coalesce(l.p,r.p) AS path, CASE WHEN r.p IS NULL THEN 'new' WHEN l.p IS NULL THEN 'missing' WHEN l.h=r.h THEN 'same' ELSE 'changed' END AS state FROM l FULL JOIN r ON l.p=r.p""")
def j19(spark, root):
    d = table(spark, root, "documents").select(F.col("doc_id").alias("path"), "text")
    sha = lambda c: F.sha2(c, 256).alias("digest")
    tail = F.when(F.col("path") % 7 == 0, "x").otherwise("")
    remote = d.where("path % 5 <> 0").select("path", sha(F.concat("text", tail))).unionByName(
        d.where("path % 11 = 0").select((F.col("path") + 100_000_000).alias("path"), sha(F.col("text"))))
    return L.inventory_diff(d.select("path", sha(F.col("text"))), remote)


@query("j21_template_scores", sql="""
WITH f AS (SELECT vec_id%4 s, vec_id//4 fr, label, embedding FROM embeddings), l AS (SELECT s, fr, unnest(range(0,64)) i, unnest(embedding)::DOUBLE x FROM f),
tr AS (SELECT i, x, fr%3-1 o FROM l), tm AS (SELECT o, i, avg(x) v FROM tr GROUP BY 1,2), tc AS (SELECT o, i, v-avg(v) OVER (PARTITION BY i) v FROM tm),
e AS (SELECT s, fr cue FROM f WHERE label=3), c AS (SELECT e.*, d.d FROM e, range(1,6) d(d)),
x AS (SELECT c.s, c.cue, c.d, t.o, t.i, t.v, l.x FROM c JOIN tc t ON true JOIN l ON l.s=c.s AND l.fr=c.cue+c.d+t.o AND l.i=t.i),
y AS (SELECT *, x-avg(x) OVER (PARTITION BY s,cue,d,i) xc FROM x),
z AS (SELECT s, cue, d, count(*) c, sum(v*xc)/(sqrt(sum(v*v))*sqrt(sum(xc*xc))) sc FROM y GROUP BY 1,2,3)
SELECT s AS session, cue, CAST(d AS INT) AS delay, round(sc,6) AS score FROM z WHERE c=192""")
def j21(spark, root):
    f = table(spark, root, "embeddings").select((F.col("vec_id") % 4).alias("session"), F.floor(F.col("vec_id") / 4).alias("frame"),
                                                "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    long = f.select((F.col("frame") % 3 - 1).cast("int").alias("o"), F.posexplode("x").alias("i", "v"))
    tm = long.groupBy("o", "i").agg(F.avg("v").alias("v"))  # offsets x features rows
    mean = tm.groupBy("i").agg(F.avg("v").alias("m"))
    tpl = tm.join(F.broadcast(mean), "i").groupBy("o").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", (F.col("v") - F.col("m")).alias("v")))), lambda s: s["v"]).alias("tpl"), F.max(F.lit(3)).alias("class"))  # not a literal, so the class stays a key of the join
    ev = f.where("label = 3").select("session", F.col("frame").alias("event_id"), F.col("label").alias("class"), F.col("frame").alias("cue"))
    return L.score_candidates(ev, f, tpl, "session", 3, (1, 5)).select("session", F.col("event_id").alias("cue"), "delay", r6("score", "score"))


@query("j22_event_snippets", views="samples", sql="""
SELECT e.trial_id, e.event_id, s.n-e.n AS "offset", round(s.c0,6) AS c0 FROM samples e JOIN samples s ON s.trial_id=e.trial_id AND s.n BETWEEN e.n-2 AND e.n+3 WHERE e.event_type='signup'""")
def j22(spark, root):
    s = samples(spark, root)
    ev = s.where("event_type = 'signup'").select("trial_id", "event_id", F.col("n").alias("at"))
    return L.snippets(s.select("trial_id", "n", "c0"), ev, ["trial_id"], "n", "at", 2, 3, 64).select(
        "trial_id", "event_id", "offset", r6("c0", "c0"))


@query("j23_invalidate_trials", views="trials", sql="""
WITH t AS (SELECT trial_id, valid, date_diff('day', DATE '1970-01-01', CAST(start_ts AS DATE)) a FROM trials),
l AS (SELECT l_orderkey trial_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) d, CASE WHEN l_tax>0.06 THEN 'quality_alert' ELSE 'packet_gap' END why FROM lineitem WHERE l_tax>0.06 OR l_quantity>45),
h AS (SELECT t.trial_id, min_by(why, (d, why)) why FROM t JOIN l ON l.trial_id=t.trial_id AND d>=a AND d<=a+60 GROUP BY 1)
SELECT t.trial_id, valid AND why IS NULL AS valid, CASE WHEN valid THEN why END AS reason FROM t LEFT JOIN h USING (trial_id)""")
def j23(spark, root):
    t = trials(spark, root).select("trial_id", F.col("trial_id").alias("dev"), "valid", day("start_ts").alias("a"))
    t = t.withColumn("b", F.col("a") + 60)
    why = F.when(F.col("l_tax") > 0.06, "quality_alert").otherwise("packet_gap")
    al = table(spark, root, "lineitem").where("l_tax > 0.06 OR l_quantity > 45").select(
        F.col("l_orderkey").alias("dev"), day("l_shipdate").alias("d"), why.alias("why_text"))
    return L.invalidate(t, al, ["dev"], "a", "b", "d", "why_text", 64).select("trial_id", "valid", "reason")
