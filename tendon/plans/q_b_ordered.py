"""Ordered operators."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import sequences as S
from ..operators import windows as W
from ..operators.ordered import exact_quantiles, index, micros, running, scan
from .registry import query
from .views import cues, packets, pred, samples, table, trials

BLK = [["blk"]]
DAY = 86_400_000_000


def day(c):
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")


@query("w01_hop_windows", views="samples", sql="""
WITH c AS (SELECT trial_id, unnest(range(0,(count(*)-10)//4+1)) j FROM samples GROUP BY 1 HAVING count(*)>=10)
SELECT c.trial_id, c.j, min(n) AS first_n, max(n) AS last_n, max(t_ms) AS t_ms, round(avg(c0),6) AS mean_c0
FROM c JOIN samples s ON s.trial_id=c.trial_id AND s.n BETWEEN c.j*4 AND c.j*4+9 GROUP BY 1,2""")
def w01(spark, root):
    return W.window_agg(samples(spark, root), ["trial_id"], [
        F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.max("t_ms").alias("t_ms"), r6(F.avg("c0"), "mean_c0")], size=10, hop=4)


@query("w02_partition_windows", views="samples", sql="""
WITH p AS (SELECT trial_id, least((epoch_us(ts)//86400000000 - 19723)//10, 2) AS part, n, c0 FROM samples),
m AS (SELECT *, row_number() OVER (PARTITION BY trial_id, part ORDER BY n)-1 AS i, count(*) OVER (PARTITION BY trial_id, part) c FROM p),
a AS (SELECT trial_id, part, 0::BIGINT AS j, c0 FROM m WHERE part=2 AND c>=8
 UNION ALL SELECT m.trial_id, m.part, g.j, m.c0 FROM m JOIN range(0,100000) g(j) ON m.part<2 AND c>=8 AND i>=g.j*4 AND i<g.j*4+8 AND g.j<=(c-8)//4)
SELECT trial_id, part, j, count(*) AS rows, round(sum(c0),6) AS total FROM a GROUP BY 1,2,3""")
def w02(spark, root):
    s = samples(spark, root).withColumn("part", F.least(F.floor((F.floor(micros("ts") / DAY) - 19723) / 10), F.lit(2)))
    s = scan(s, ["trial_id", "part"], ["n"], {"i": index()}, BLK)
    train = W.window_agg(s.where("part < 2"), ["trial_id", "part"],
                         [F.count(F.lit(1)).alias("rows"), r6(F.sum("c0"), "total")], n="i", size=8, hop=4)
    test = (s.where("part = 2").groupBy("trial_id", "part").agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("c0"), "total"))
            .where("rows >= 8").withColumn("j", F.lit(0).cast("bigint")))
    return train.unionByName(test)


@query("w03_time_check", views="samples", sql="""
WITH d AS (SELECT trial_id, (epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY trial_id ORDER BY event_id))/1000.0 AS step FROM samples)
SELECT trial_id, count(*) FILTER (WHERE step<=0) AS bad_steps, round(1000.0/median(step),9) AS rate_hz FROM d WHERE step IS NOT NULL GROUP BY 1""")
def w03(spark, root):
    s = samples(spark, root).withColumn("us", micros("ts"))
    s = S.difference(s, ["trial_id"], ["n"], "us", "step", BLK).where("step IS NOT NULL").withColumn("step", F.col("step") / 1000.0)
    med = exact_quantiles(s, ["trial_id"], "step", {"med": 0.5})
    bad = s.groupBy("trial_id").agg(F.count_if(F.col("step") <= 0).alias("bad_steps"))
    return bad.join(med, "trial_id").select("trial_id", "bad_steps", F.round(1000.0 / F.col("med"), 9).alias("rate_hz"))


@query("w04_runs", views="samples", sql="""
WITH f AS (SELECT *, CASE WHEN event_type=lag(event_type) OVER (PARTITION BY trial_id ORDER BY n) THEN 0 ELSE 1 END f FROM samples),
r AS (SELECT *, sum(f) OVER (PARTITION BY trial_id ORDER BY n) run FROM f)
SELECT trial_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(n) AS first_pos, max(n) AS last_pos, count(*) AS rows FROM r GROUP BY 1,2""")
def w04(spark, root):
    return S.run_table(samples(spark, root), ["trial_id"], ["n"], "event_type", "n", BLK)


@query("w05_rising_edges", views="samples", sql="""
SELECT trial_id, n FROM (SELECT *, lag(c0) OVER (PARTITION BY trial_id ORDER BY n) p FROM samples) WHERE c0>=10 AND (p IS NULL OR p<10)""")
def w05(spark, root):
    return S.rising_edges(samples(spark, root), ["trial_id"], ["n"], "c0", 10.0, BLK).select("trial_id", "n")


@query("w06_arbitration", views="samples", sql="""
SELECT trial_id, frame, event_type, k FROM (SELECT trial_id, n//3 AS frame, event_type, k,
 row_number() OVER (PARTITION BY trial_id, n//3 ORDER BY k DESC, event_type, n) r FROM samples) WHERE r=1""")
def w06(spark, root):
    s = samples(spark, root).select("trial_id", F.floor(F.col("n") / 3).alias("frame"), "event_type", "k")
    return S.arbitrate(s, ["trial_id", "frame"], "k", "event_type").select("trial_id", "frame", "event_type", "k")


@query("w08_envelope", views="samples", sql="""
SELECT trial_id, n, max(n*10+k) OVER (PARTITION BY trial_id ORDER BY n) AS start_env,
 min(n*10+k+20) OVER (PARTITION BY trial_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS end_env FROM samples""")
def w08(spark, root):
    s = samples(spark, root).withColumns({"a": F.col("n") * 10 + F.col("k"), "b": F.col("n") * 10 + F.col("k") + 20})
    return S.envelope(s, ["trial_id"], ["n"], "a", "b", BLK).select("trial_id", "n", "start_env", "end_env")


@query("w10_smooth", views="samples", sql="""
WITH m AS (SELECT trial_id, max(n) mx FROM samples GROUP BY 1),
t AS (SELECT s.trial_id, s.n, greatest(0, least(mx, s.n+o.o)) src FROM samples s JOIN m USING (trial_id), range(-2,4) o(o))
SELECT t.trial_id, t.n, round(sum(c0)/6,6) AS smooth FROM t JOIN samples s ON s.trial_id=t.trial_id AND s.n=t.src
 JOIN (SELECT 0 z) ON true WHERE true GROUP BY 1,2""".replace("range(-2,4)", "range(-3,3)"))
def w10(spark, root):
    return S.smooth(samples(spark, root).select("trial_id", "n", "c0"), ["trial_id"], "n", "c0", 6, rows=64).select(
        "trial_id", "n", r6("smooth", "smooth"))


@query("w11_first_sustained", views="samples", sql="""
WITH x AS (SELECT trial_id, n, (c0>-30 AND lead(c0,1) OVER w>-30 AND lead(c0,2) OVER w>-30) ok FROM samples WINDOW w AS (PARTITION BY trial_id ORDER BY n))
SELECT trial_id, min(n) AS first_pos FROM x WHERE ok GROUP BY 1""")
def w11(spark, root):
    return S.first_sustained(samples(spark, root), ["trial_id"], ["n"], F.col("c0") > -30, 3, "n", BLK)


@query("w12_stage_pairs", views="samples", sql="""
WITH x AS (SELECT *, last_value(CASE WHEN event_type='signup' THEN n END IGNORE NULLS) OVER w s, last_value(CASE WHEN event_type='purchase' THEN n END IGNORE NULLS) OVER w e
 FROM samples WINDOW w AS (PARTITION BY trial_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trial_id, s AS start_n, n AS end_n FROM x WHERE event_type='purchase' AND s IS NOT NULL AND (e IS NULL OR s>e)""")
def w12(spark, root):
    return S.pair_stages(samples(spark, root), ["trial_id"], ["n"], F.col("event_type") == "signup",
                         F.col("event_type") == "purchase", F.col("n"), BLK).select(
        "trial_id", F.col("start").alias("start_n"), F.col("n").alias("end_n"))


SPANS = """sp AS (SELECT l_partkey, l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS a,
 date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS b FROM lineitem)"""


@query("w13_overlap_groups", sql=f"""
WITH {SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY l_partkey ORDER BY a, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) mx FROM sp),
g AS (SELECT *, sum(CASE WHEN mx IS NULL OR a>mx THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY a, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) grp FROM m)
SELECT l_partkey, CAST(grp AS BIGINT) AS grp, min(a) AS first_day, max(b) AS last_day, count(*) AS rows FROM g GROUP BY 1,2""")
def w13(spark, root):
    d = table(spark, root, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", day("l_shipdate").alias("a"),
                                              "l_quantity").withColumns({
        "b": F.col("a") + F.col("l_quantity").cast("bigint"), "slot": F.floor(F.col("a") / 400)})
    g = S.overlap_groups(d, ["l_partkey"], ["a", "l_orderkey", "l_linenumber"], "a", "b", [["slot"]])
    return g.groupBy("l_partkey", "grp").agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count(F.lit(1)).alias("rows"))


@query("w15_difference", views="samples", sql="""
SELECT trial_id, n, round(c0-lag(c0) OVER (PARTITION BY trial_id ORDER BY n),6) AS diff FROM samples""")
def w15(spark, root):
    return S.difference(samples(spark, root), ["trial_id"], ["n"], "c0", "d", BLK).select("trial_id", "n", F.round("d", 6).alias("diff"))


@query("w16_label_resample", views="samples", sql="""
WITH m AS (SELECT trial_id, count(*) c FROM samples GROUP BY 1), t AS (SELECT trial_id, c, unnest(range(0, CAST(ceil(c/1.25) AS BIGINT))) i FROM m)
SELECT t.trial_id, t.i, s.event_type AS label FROM t JOIN samples s ON s.trial_id=t.trial_id AND s.n=least(c-1, CAST(round_even(i*1.25,0) AS BIGINT))""")
def w16(spark, root):
    return S.resample_index(samples(spark, root), ["trial_id"], "n", 250.0, 200.0, BLK).select(
        "trial_id", "i", F.col("event_type").alias("label"))


@query("w17_onset_lag", views="samples", sql="""
WITH x AS (SELECT trial_id, n, last_value(CASE WHEN event_type='click' THEN epoch_us(ts) END IGNORE NULLS) OVER w a,
 last_value(CASE WHEN event_type='view' THEN epoch_us(ts) END IGNORE NULLS) OVER w h FROM samples WINDOW w AS (PARTITION BY trial_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT trial_id, n, CASE WHEN abs(h-a)<=43200000000 THEN h-a END AS lag_us FROM x""")
def w17(spark, root):
    s = samples(spark, root).withColumn("us", micros("ts"))
    return S.onset_lag(s, ["trial_id"], ["n"], "us", F.col("event_type") == "click", F.col("event_type") == "view",
                       43_200_000_000, BLK).select("trial_id", "n", F.col("lag").alias("lag_us"))


@query("w18_drop_flag", views="samples", sql="""
SELECT trial_id, n, coalesce(epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY trial_id ORDER BY n) > 2.5*14400000000, false) AS dropped FROM samples""")
def w18(spark, root):
    s = S.difference(samples(spark, root).withColumn("us", micros("ts")), ["trial_id"], ["n"], "us", "gap", BLK)
    return s.select("trial_id", "n", F.coalesce(F.col("gap") > 2.5 * 14_400_000_000, F.lit(False)).alias("dropped"))


@query("w20_sample_index", views="packets", sql="""
SELECT session_no, event_id, row_number() OVER (PARTITION BY session_no ORDER BY event_id)-1 AS sample_index FROM packets""")
def w20(spark, root):
    p = packets(spark, root).withColumn("slot", F.floor(F.col("event_id") / 65_536))
    return S.numbered(p, ["session_no"], ["event_id"], "sample_index", [["slot"]]).select("session_no", "event_id", "sample_index")


@query("w21_peak_quality", sql="""
WITH s AS (SELECT vec_id, unnest(range(0,64)) i, unnest(embedding)::DOUBLE v FROM embeddings),
c AS (SELECT vec_id, list_position(embedding, list_max(embedding))-1 ch, list_max(embedding)::DOUBLE b FROM embeddings),
x AS (SELECT c.vec_id, any_value(ch) ch, any_value(b) b, coalesce(max(v) FILTER (WHERE abs(i-ch)>=3),-1.0) s2 FROM c JOIN s USING (vec_id) GROUP BY 1),
y AS (SELECT *, 0.7*least(greatest((b-0.05)/0.45,0),1)+0.3*least(greatest((b-s2)/0.12,0),1) cf, ch IN (0,63) bd FROM x)
SELECT vec_id, CAST(ch AS BIGINT) AS chosen, round(b,6) AS best, round(s2,6) AS second, round(cf,6) AS confidence, bd AS boundary,
 concat_ws(',', CASE WHEN bd THEN 'search_boundary_hit' END, CASE WHEN cf<0.2 THEN 'low_confidence' END,
  CASE WHEN b<0.25 THEN 'low_template_correlation' END, CASE WHEN b-s2<0.05 THEN 'ambiguous_template_peak' END) AS reasons FROM y""")
def w21(spark, root):
    d = S.peak_quality(table(spark, root, "embeddings").select("vec_id", "embedding"), "embedding")
    return d.select("vec_id", F.col("chosen").cast("bigint").alias("chosen"), r6("best", "best"), r6("second", "second"),
                    r6("confidence", "confidence"), "boundary", "reasons")


@query("w23_trial_acceptance", views="trials", sql="""
WITH e AS (SELECT l_orderkey trial_id, l_linenumber no, l_discount>0.01 ok FROM lineitem), a AS (SELECT *, bool_and(ok) OVER (PARTITION BY trial_id) al FROM e)
SELECT a.trial_id, no, coalesce(t.valid,false) AND al AS included, CASE WHEN NOT ok THEN 'low_quality' WHEN NOT al THEN 'paired_event_failed'
 WHEN NOT coalesce(t.valid,false) THEN 'invalid_trial' ELSE '' END AS reason FROM a LEFT JOIN trials t USING (trial_id)""")
def w23(spark, root):
    e = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("no"),
                                              (F.col("l_discount") > 0.01).alias("ok"))
    return S.propagate(e, trials(spark, root)).select("trial_id", "no", "included", "reason")


@query("w24_trial_bounds", sql="""
WITH t AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) a,
 date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CAST(floor(o_totalprice/5000) AS BIGINT) b FROM orders)
SELECT o_orderkey, NOT (0<=a AND a<b) AS bad_bounds, coalesce(a < max(b) OVER (PARTITION BY o_custkey ORDER BY a,o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM t""")
def w24(spark, root):
    t = table(spark, root, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("a"), "o_totalprice")
    t = t.withColumns({"b": F.col("a") + F.floor(F.col("o_totalprice") / 5000), "slot": F.floor(F.col("a") / 400)})
    return S.trial_bounds(t, ["o_custkey"], ["a", "o_orderkey"], "a", "b", [["slot"]]).select(
        "o_orderkey", (~((F.col("a") >= 0) & (F.col("a") < F.col("b")))).alias("bad_bounds"), "overlaps")


@query("w27_segments", views="packets", sql="""
WITH g AS (SELECT session_no, event_id, event_id//4 AS idx FROM packets), x AS (SELECT *, CASE WHEN idx-lag(idx) OVER (PARTITION BY session_no ORDER BY event_id)<>1 THEN 1 ELSE 0 END f FROM g),
s AS (SELECT *, sum(f) OVER (PARTITION BY session_no ORDER BY event_id) seg FROM x)
SELECT session_no, CAST(seg AS BIGINT) AS segment, min(event_id) AS first_id, count(*) AS rows FROM s GROUP BY 1,2""")
def w27(spark, root):
    p = packets(spark, root).withColumns({"idx": F.floor(F.col("event_id") / 4), "slot": F.floor(F.col("event_id") / 65_536)})
    g = S.segments(p, ["session_no"], ["event_id"], "idx", [["slot"]])
    return g.groupBy("session_no", "segment").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))


@query("u01_union_recordings", sql="""
SELECT event_type AS kind, count(*) AS rows FROM (SELECT event_type FROM events WHERE event_id%2=0 UNION ALL SELECT event_type FROM events WHERE event_id%2=1) GROUP BY 1""")
def u01(spark, root):
    e = table(spark, root, "events")
    a, b = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select(*reversed(e.columns))
    return a.unionByName(b).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("u02_missing_combinations", views="trials", sql="""
WITH g AS (SELECT a.split, l.label, m.mon FROM (VALUES ('train'),('validation'),('test')) a(split), (SELECT DISTINCT label FROM trials) l, range(1,13) m(mon)),
p AS (SELECT DISTINCT CASE WHEN session_no<=2 THEN 'train' WHEN session_no=3 THEN 'validation' ELSE 'test' END split, label, month(start_ts) mon FROM trials WHERE valid AND day(start_ts)=1)
SELECT split, label, mon FROM g EXCEPT SELECT split, label, mon FROM p""")
def u02(spark, root):
    from ..functions.labels import split_of
    t = trials(spark, root)
    splits = F.explode(F.array(*[F.lit(s) for s in ("train", "validation", "test")])).alias("split")
    grid = t.select("label").distinct().select("label", splits).select("label", "split", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))).alias("mon"))
    seen = t.where("valid AND day(start_ts) = 1").select(
        split_of("session_no").alias("split"), "label", F.month("start_ts").cast("bigint").alias("mon")).distinct()
    return grid.join(seen, ["split", "label", "mon"], "left_anti").select("split", "label", "mon")


@query("u03_unknown_labels", views="trials", sql="SELECT DISTINCT label FROM trials WHERE label NOT IN ('1-URGENT','2-HIGH')")
def u03(spark, root):
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "label string")
    return trials(spark, root).select("label").distinct().join(F.broadcast(allowed), "label", "left_anti")


@query("u04_common_keys", views="samples", sql="""
SELECT trial_id FROM samples WHERE event_type='signup' INTERSECT SELECT trial_id FROM samples WHERE c0>100""")
def u04(spark, root):
    e = table(spark, root, "events").select(F.col("user_id").alias("trial_id"), "event_type", "value")
    return e.where("event_type = 'signup'").select("trial_id").intersect(e.where("value > 150").select("trial_id"))


@query("u05_first_distinct", views="samples", sql="""
SELECT trial_id, k, n, event_id FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, k ORDER BY n) r FROM samples) WHERE r=1""")
def u05(spark, root):
    s = samples(spark, root).select("trial_id", "k", "n", "event_id")
    return S.first_distinct(s, ["trial_id", "k"], ["n"]).select("trial_id", "k", "n", "event_id")


@query("o01_best_by_key", views="pred", sql="""
SELECT session_no, vec_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY q DESC, truth, vec_id) r FROM pred) WHERE r=1""")
def o01(spark, root):
    return pred(spark, root).groupBy("session_no").agg(
        F.min_by("vec_id", F.struct((-F.col("q")).alias("a"), "truth", "vec_id")).alias("best"))


@query("o02_corpus_sort", sql="""
SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey)-1 AS position, o_orderkey AS dataset FROM orders""")
def o02(spark, root):
    o = table(spark, root, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("dataset"))
    o = o.withColumn("slot", F.floor(F.col("o_custkey") / 64)).withColumn("fine", F.year("o_orderdate"))
    return scan(o, [], ["o_custkey", "o_orderdate", "dataset"], {"position": index()},
                [["slot"], ["slot", "o_custkey", "fine"]]).select("position", "dataset")


@query("o03_greedy_collapse", sql="""
WITH a AS (SELECT vec_id//16 AS seq, vec_id, list_position(embedding[1:10], list_max(embedding[1:10]))-1 l FROM embeddings),
k AS (SELECT *, lag(l) OVER (PARTITION BY seq ORDER BY vec_id) p FROM a)
SELECT seq, string_agg(chr(CAST(97+l AS INT)), '' ORDER BY vec_id) AS text FROM k WHERE l<>9 AND (p IS NULL OR p<>l) GROUP BY 1""")
def o03(spark, root):
    from ..functions.columns import argmax
    from ..functions.text import greedy_collapse
    e = table(spark, root, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("seq"), "vec_id",
                                                argmax(F.slice("embedding", 1, 10)).alias("l"))
    d = scan(e, ["seq"], ["vec_id"], {"p": running("lag", "l")})
    return greedy_collapse(d, ["seq"], "vec_id", "l", "p", blank=9, text=lambda l: F.chr(l + 97))


@query("o05_sorted_unique", views="samples", sql="""
SELECT trial_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM samples WHERE c0>0 GROUP BY 1""")
def o05(spark, root):
    s = table(spark, root, "events").where("value > 50").select(F.col("user_id").alias("trial_id"), "event_type")
    return s.groupBy("trial_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
