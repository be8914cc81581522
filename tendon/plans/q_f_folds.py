"""Order-dependent operators; the SQL side folds an ordered list."""

from pyspark.sql import functions as F

from ..functions.columns import clamp01, r6
from ..operators import events as E
from ..operators import steps
from ..operators.folds import blended, by_row, chunked_fold
from ..operators.ordered import block, micros, number_rows
from .registry import query
from .views import packets, samples, table

HOUR = 3_600_000_000


def fold_sql(rows, key, order, cols, state, step, emit, out, final="o.*"):
    """SQL fold: `a` is the accumulator, `x` the row; `emit` is a list of structs of type `out`."""
    elem = ", ".join([f"'{c}': {c}" for c in cols] + [f"'{s}': {v}" for s, v in state.items()] + [f"'out': CAST([] AS {out}[])"])
    nxt = ", ".join([f"'{c}': x.{c}" for c in cols] + [f"'{s}': {v}" for s, v in step.items()] + [f"'out': list_concat(a.out, {emit})"])
    first = ", ".join([f"'{c}': NULL" for c in cols] + [f"'{s}': {v}" for s, v in state.items()] + [f"'out': CAST([] AS {out}[])"])
    return f"""WITH src AS ({rows}), li AS (SELECT {key}, list({{{elem}}} ORDER BY {order}) l FROM src GROUP BY ALL),
fo AS (SELECT {key}, list_reduce(l, lambda a, x: {{{nxt}}}, {{{first}}}) r FROM li), un AS (SELECT {key}, unnest(r.out) o FROM fo) SELECT {key}, {final} FROM un"""


NAMES = {"view": "index_press", "click": "index_release", "purchase": "middle_press", "signup": "middle_release", "error": "thumb_up"}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + " END"


def named(spark, root):
    from ..functions.labels import lookup
    return samples(spark, root).select("trial_id", "blk", "n", "k", lookup(NAMES, F.col("event_type")).alias("name"), micros("ts").alias("t"))


KEEP = "(a.kt IS NULL OR x.t-a.kt>=21600000000 OR (x.name IN ('index_release','middle_release') AND x.name<>a.kn))"


@query("w07_debounce", views="samples", sql=fold_sql(
    f"SELECT trial_id, n, epoch_us(ts) t, {NAME_SQL} AS name FROM samples", "trial_id", "t, name", ["t", "name"],
    {"kn": "CAST(NULL AS VARCHAR)", "kt": "CAST(NULL AS BIGINT)"}, {"kn": f"CASE WHEN {KEEP} THEN x.name ELSE a.kn END", "kt": f"CASE WHEN {KEEP} THEN x.t ELSE a.kt END"},
    f"CASE WHEN {KEEP} THEN [{{'t': x.t, 'name': x.name}}] ELSE [] END", "STRUCT(t BIGINT, name VARCHAR)"))
def w07(spark, root):
    return E.debounce(named(spark, root), ["trial_id"], "blk", 6 * HOUR)


@query("w14_prompt_merge", sql=fold_sql(
    "SELECT conv_id, turn n, length(text) len, text FROM conversations", "conv_id", "n", ["n", "len", "text"],
    {"f": "CAST(0 AS BIGINT)", "c": "CAST(0 AS BIGINT)"},
    {"f": "CASE WHEN a.c=0 THEN x.n ELSE a.f END", "c": "CASE WHEN a.c+x.len>=400 THEN 0 ELSE a.c+x.len END"},
    "[{'first': CASE WHEN a.c=0 THEN x.n ELSE a.f END, 'len': x.len, 'text': x.text, 'n': x.n}]", "STRUCT(\"first\" BIGINT, len BIGINT, text VARCHAR, n BIGINT)",
    "o.first AS first, CAST(sum(o.len) AS BIGINT) AS len, md5(string_agg(o.text, '' ORDER BY o.n)) AS digest FROM un GROUP BY ALL --").replace("FROM un GROUP BY ALL -- FROM un", "FROM un GROUP BY ALL"))
def w14(spark, root):
    c = table(spark, root, "conversations").select("conv_id", F.col("turn").alias("n"), F.length("text").cast("bigint").alias("len"), "text",
                                                   F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), block("turn", 4096).alias("blk"))
    return E.merge_prompts(c, ["conv_id"], "blk", 400).select("conv_id", "first", "len", F.md5("text").alias("digest"))


D = "((x.seq-a.s+512)%256)"


@query("w19_sequence_audit", views="packets", sql=fold_sql(
    "SELECT session_no, event_id//4 AS g, event_id t, (packet_seq//4*4 + event_id%4)%256 AS seq FROM packets", "session_no", "t", ["t", "seq"],
    {"s": "CAST(NULL AS BIGINT)"}, {"s": f"CASE WHEN a.s IS NULL OR {D} BETWEEN 1 AND 128 THEN x.seq ELSE a.s END"},
    f"[{{'t': x.t, 'lost': CASE WHEN a.s IS NOT NULL AND {D} BETWEEN 1 AND 128 THEN {D}-1 ELSE 0 END, 'dup': coalesce({D}=0,false), 'late': coalesce({D}>128,false)}}]",
    "STRUCT(t BIGINT, lost BIGINT, dup BOOLEAN, late BOOLEAN)", "o.t AS t, CAST(o.lost AS INT) AS lost_before, o.dup AS duplicate, o.late AS late"))
def w19(spark, root):
    p = packets(spark, root).select("session_no", F.col("event_id").alias("t"), block("event_id").alias("blk"),
                                    ((F.floor(F.col("packet_seq") / 4) * 4 + F.col("event_id") % 4) % 256).alias("seq"))
    return E.sequence_audit(p, ["session_no"], "blk")


@query("u06_accepted_packets", views="packets", sql="""
SELECT session_no, sum(keep) AS accepted, count(*)-sum(keep) AS dropped FROM (SELECT o.session_no, CASE WHEN dup OR late THEN 0 ELSE 1 END keep FROM (
""" + fold_sql("SELECT session_no, event_id t, packet_seq seq FROM packets", "session_no", "t", ["t", "seq"],
               {"s": "CAST(NULL AS BIGINT)"}, {"s": f"CASE WHEN a.s IS NULL OR {D} BETWEEN 1 AND 128 THEN x.seq ELSE a.s END"},
               f"[{{'dup': coalesce({D}=0,false), 'late': coalesce({D}>128,false)}}]", "STRUCT(dup BOOLEAN, late BOOLEAN)") + ") o) GROUP BY 1")
def u06(spark, root):
    p = packets(spark, root).select("session_no", F.col("event_id").alias("t"), F.col("packet_seq").alias("seq"), block("event_id").alias("blk"))
    bad = F.col("duplicate") | F.col("late")
    return E.sequence_audit(p, ["session_no"], "blk").groupBy("session_no").agg(
        F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("dropped"))


@query("w26_ema", views="samples", sql=fold_sql(
    "SELECT trial_id, n, c0 AS x FROM samples", "trial_id", "n", ["n", "x"], {"y": "CAST(NULL AS DOUBLE)"},
    {"y": "CASE WHEN a.y IS NULL THEN x.x ELSE 0.72::DOUBLE*a.y+0.28::DOUBLE*x.x END"},
    "[{'n': x.n, 'y': CASE WHEN a.y IS NULL THEN x.x ELSE 0.72::DOUBLE*a.y+0.28::DOUBLE*x.x END}]", "STRUCT(n BIGINT, y DOUBLE)", "o.n AS n, round(o.y,6) AS y"))
def w26(spark, root):
    s = samples(spark, root).select("trial_id", "blk", "n", F.col("c0").alias("x"))
    return blended(s, ["trial_id"], "n", "blk", ["x"], 0.28).select("trial_id", "n", r6("x_mean", "y"))


FREE = """list_sort(list_filter(list_transform(range(1, len(x.tr)+1), lambda i: {'d': abs(x.t-x.tr[i]), 'i': i}), lambda s: s.d<=3600000000*4 AND NOT list_contains(a.used, s.i)))[1]"""


@query("j10_greedy_match", views="samples", sql="""
WITH tr AS (SELECT trial_id, list(epoch_us(ts) ORDER BY ts) tr FROM samples WHERE event_type='click' GROUP BY 1),
li AS (SELECT p.trial_id, list({'t': epoch_us(p.ts), 'tr': coalesce(tr.tr, CAST([] AS BIGINT[])), 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS STRUCT(p BIGINT, q BIGINT)[])} ORDER BY p.ts) l FROM samples p LEFT JOIN tr USING (trial_id) WHERE event_type='view' GROUP BY 1),
fo AS (SELECT trial_id, list_reduce(l, lambda a, x: {'t': x.t, 'tr': x.tr, 'used': CASE WHEN FREE IS NULL THEN a.used ELSE list_append(a.used, FREE.i) END,
  'out': list_append(a.out, {'p': x.t, 'q': x.tr[FREE.i]})}, {'t': NULL, 'tr': NULL, 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS STRUCT(p BIGINT, q BIGINT)[])}) r FROM li)
SELECT trial_id, o.p AS pred_t, o.q AS truth_t FROM (SELECT trial_id, unnest(r.out) o FROM fo)""".replace("FREE", f"({FREE})"))
def j10(spark, root):
    s = samples(spark, root).select("trial_id", "event_type", micros("ts").alias("us"))
    return E.match_events(s.where("event_type = 'view'"), s.where("event_type = 'click'"), ["trial_id"], "us", 4 * HOUR, F.floor(F.col("t") / (360 * HOUR)))


@query("a41_event_metrics", views="samples", sql="""
WITH s AS (SELECT trial_id, k%3 AS cls, event_type, epoch_us(ts) us FROM samples),
tr AS (SELECT trial_id, cls, list(us ORDER BY us) tr FROM s WHERE event_type='click' GROUP BY 1,2),
li AS (SELECT p.trial_id, p.cls, list({'t': p.us, 'tr': coalesce(tr.tr, CAST([] AS BIGINT[])), 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])} ORDER BY p.us) l
 FROM s p LEFT JOIN tr ON tr.trial_id=p.trial_id AND tr.cls=p.cls WHERE event_type='view' GROUP BY 1,2),
fo AS (SELECT cls, list_reduce(l, lambda a, x: {'t': x.t, 'tr': x.tr, 'used': CASE WHEN FREE IS NULL THEN a.used ELSE list_append(a.used, FREE.i) END,
  'out': list_append(a.out, x.tr[FREE.i])}, {'t': NULL, 'tr': NULL, 'used': CAST([] AS BIGINT[]), 'out': CAST([] AS BIGINT[])}) r FROM li),
m AS (SELECT cls, count(q) tp, count(*)-count(q) fp FROM (SELECT cls, unnest(r.out) q FROM fo) x GROUP BY 1),
n AS (SELECT cls, count(*) truths FROM s WHERE event_type='click' GROUP BY 1),
c AS (SELECT coalesce(m.cls, n.cls) cls, CAST(coalesce(tp,0) AS BIGINT) tp, CAST(coalesce(fp,0) AS BIGINT) fp, CAST(coalesce(truths,0)-coalesce(tp,0) AS BIGINT) fn FROM m FULL JOIN n ON m.cls=n.cls),
a AS (SELECT cls, tp, fp, fn FROM c UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c),
v AS (SELECT *, tp/greatest(1,tp+fp)::DOUBLE p, tp/greatest(1,tp+fn)::DOUBLE r, fn/greatest(1,tp+fn)::DOUBLE nr FROM a), f AS (SELECT *, 2*p*r/greatest(1e-12,p+r) f1 FROM v)
SELECT cls, tp, fp, fn, round(p,6) AS precision, round(r,6) AS recall, round(nr,6) AS fnr, round(f1,6) AS f1,
 CASE WHEN cls IS NULL THEN round((SELECT avg(f1) FROM f WHERE cls IS NOT NULL),6) END AS macro_f1,
 CASE WHEN cls IS NULL THEN round(fp/((SELECT max(us)-min(us) FROM s)/60e6),6) END AS fp_per_minute FROM f""".replace("FREE", f"({FREE})".replace("*4 AND", "*12 AND")))
def a41(spark, root):
    s = samples(spark, root).select("trial_id", (F.col("k") % 3).alias("cls"), "event_type", micros("ts").alias("us"))
    p, t = s.where("event_type = 'view'"), s.where("event_type = 'click'")
    m = E.match_events(p, t, ["trial_id", "cls"], "us", 12 * HOUR, F.floor(F.col("t") / (360 * HOUR)))
    counts = E.match_counts(m, p, t, ["trial_id", "cls"])
    minutes = s.agg(((F.max("us") - F.min("us")) / 60e6).alias("minutes"))
    d = E.event_metrics(counts, "cls", minutes)
    return d.select("cls", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "fnr", "f1", "macro_f1", "fp_per_minute")])


PH = {"st": "CAST(0 AS BIGINT)", "ca": "CAST(0 AS BIGINT)", "se": "CAST(0 AS BIGINT)", "sf": "CAST(0 AS BIGINT)"}
SEEN = "(CASE WHEN x.label=a.ca THEN a.se+1 ELSE 1 END)"
PHASE_STEP = {
    "st": f"CASE WHEN x.label=-1 OR x.label=a.st THEN a.st WHEN {SEEN}>=2 THEN x.label ELSE a.st END",
    "ca": "x.label", "se": f"CASE WHEN x.label=-1 OR x.label=a.st OR {SEEN}>=2 THEN 0 ELSE {SEEN} END",
    "sf": f"CASE WHEN x.label=-1 THEN 0 WHEN x.label=a.st THEN least(a.sf+1,3) WHEN {SEEN}>=2 THEN 0 ELSE a.sf END"}
PHASE_OUT = f"""{{'n': x.n, 'stable': CASE WHEN x.label=-1 THEN -1 WHEN x.label=a.st THEN a.st WHEN {SEEN}>=2 THEN x.label ELSE a.st END,
 'phase': CASE WHEN x.label=-1 THEN -1 WHEN x.label=a.st THEN (CASE WHEN x.label=0 THEN 0 WHEN a.sf+1>=3 THEN 3 ELSE 2 END)
  WHEN {SEEN}>=2 THEN (CASE WHEN x.label=0 THEN 0 ELSE 2 END) WHEN a.st=0 THEN 1 WHEN x.label=0 THEN 4 ELSE 5 END}}"""
LABELS = "SELECT trial_id, n, CASE WHEN k<5 THEN -1 ELSE (n//3 + (k%10=0)::INT)%4 END AS label FROM samples"


def label_frames(spark, root):
    lab = F.when(F.col("k") < 5, -1).otherwise((F.floor(F.col("n") / 3) + (F.col("k") % 10 == 0).cast("int")) % 4)
    return samples(spark, root).select("trial_id", "blk", "n", lab.cast("int").alias("label"))


@query("t06_phases", views="samples", sql=fold_sql(LABELS, "trial_id", "n", ["n", "label"], PH, PHASE_STEP, f"[{PHASE_OUT}]",
                                                   "STRUCT(n BIGINT, stable BIGINT, phase BIGINT)", "o.n AS n, CAST(o.stable AS INT) AS stable, CAST(o.phase AS INT) AS phase"))
def t06(spark, root):
    return E.phases(label_frames(spark, root), ["trial_id"], "blk")


OPEN = "(a.st=3 AND x.label=0)"
OPEN_STEP = {c: f"CASE WHEN {OPEN} THEN (CASE WHEN a.q+1<4 THEN {keep} ELSE 0 END) ELSE {PHASE_STEP[c]} END"
             for c, keep in (("st", "a.st"), ("ca", "a.ca"), ("se", "a.se"), ("sf", "least(a.sf+1,3)"))}
OPEN_STEP["q"] = f"CASE WHEN {OPEN} THEN (CASE WHEN a.q+1<4 THEN a.q+1 ELSE 0 END) WHEN x.label<>0 THEN 0 ELSE a.q END"
OPEN_LABELS = "SELECT trial_id, n, CASE WHEN k<5 THEN -1 WHEN k%3=0 THEN 3 ELSE CASE WHEN n%10<7 THEN 0 ELSE 3 END END AS label FROM samples"


@query("t07_open_phases", views="samples", sql=fold_sql(
    OPEN_LABELS, "trial_id", "n", ["n", "label"], {**PH, "q": "CAST(0 AS BIGINT)"}, OPEN_STEP,
    f"[CASE WHEN {OPEN} THEN {{'n': x.n, 'stable': CASE WHEN a.q+1<4 THEN 3 ELSE 0 END, 'phase': CASE WHEN a.q+1<4 THEN 3 ELSE 4 END}} ELSE {PHASE_OUT} END]",
    "STRUCT(n BIGINT, stable BIGINT, phase BIGINT)", "o.n AS n, CAST(o.stable AS INT) AS stable, CAST(o.phase AS INT) AS phase"))
def t07(spark, root):
    k, n = F.col("k"), F.col("n")
    lab = F.when(k < 5, -1).when(k % 3 == 0, 3).otherwise(F.when(n % 10 < 7, 0).otherwise(3))
    s = samples(spark, root).select("trial_id", "blk", "n", lab.alias("label"))
    return E.phases(s, ["trial_id"], "blk", open_label=3, release_after=4)


CS = "(CASE WHEN x.g<>a.ca THEN x.t ELSE a.cs END)"
FRAMES = "SELECT user_id, event_id AS id, epoch_us(ts)//1000 AS t, CASE WHEN value/300<0.1 THEN 0 ELSE (CAST(regexp_extract(props,'([0-9]+)',1) AS INT)//34) END AS g FROM events"


@query("t08_gesture_events", sql=fold_sql(
    FRAMES, "user_id", "t, id", ["t", "g"], {s: "CAST(0 AS BIGINT)" for s in ("st", "ss", "ca", "cs")},
    {"st": f"CASE WHEN x.g<>a.st AND x.t-{CS}>=14400000 THEN x.g ELSE a.st END", "ss": f"CASE WHEN x.g<>a.st AND x.t-{CS}>=14400000 THEN x.t ELSE a.ss END", "ca": "x.g", "cs": CS},
    f"CASE WHEN x.g=a.st THEN [{{'t': x.t, 'kind': 'hold', 'gesture': a.st, 'held': greatest(0,x.t-a.ss)}}] WHEN x.t-{CS}<14400000 THEN [] ELSE [{{'t': x.t, 'kind': 'exit', 'gesture': a.st, 'held': greatest(0,x.t-a.ss)}}, {{'t': x.t, 'kind': 'enter', 'gesture': x.g, 'held': 0}}] END",
    "STRUCT(t BIGINT, kind VARCHAR, gesture BIGINT, held BIGINT)", "o.t AS t, o.kind AS kind, CAST(o.gesture AS INT) AS gesture, o.held AS held"))
def t08(spark, root):
    return E.gesture_events(control_frames(spark, root), ["user_id"], "slot", stable_ms=14_400_000)


def control_frames(spark, root):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    g = F.when(F.col("value") / 300 < 0.1, 0).otherwise(F.floor(k / 34))
    return table(spark, root, "events").select("user_id", F.col("event_id").alias("id"), F.floor(micros("ts") / 1000).alias("t"), g.cast("int").alias("gesture"),
                                               F.floor(micros("ts") / (360 * HOUR)).alias("slot"))


@query("t09_input_timeout", sql=f"""
WITH f AS ({FRAMES}), n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, id) nx FROM f) SELECT user_id, t+28800000 AS forced_t, g AS was FROM n WHERE (nx IS NULL OR nx-t>=28800000) AND g<>0""")
def t09(spark, root):
    return E.timeouts(control_frames(spark, root), ["user_id"], ["t", "id"], "t", "gesture", 28_800_000, [["slot"]])


WIN = """pr AS (SELECT trial_id, n, unnest(['index_press','index_release','thumb_up']) cls, unnest([0,1,2]) o, unnest([k/100.0, ((k*7)%100)/100.0, ((k*13+n)%100)/100.0]) p FROM samples),
ed AS (SELECT * FROM (SELECT *, lag(p) OVER (PARTITION BY trial_id, cls ORDER BY n) q FROM pr) WHERE p>=0.55 AND (q IS NULL OR q<0.55)),
wn AS (SELECT trial_id, n AS t, cls AS name FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, n ORDER BY p DESC, o) r FROM ed) WHERE r=1)"""


def class_frames(spark, root):
    k, n = F.col("k"), F.col("n")
    ps = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(o).alias("o"), (p / 100.0).alias("p")) for o, (c, p) in enumerate(
        (("index_press", k), ("index_release", (k * 7) % 100), ("thumb_up", (k * 13 + n) % 100)))])
    return samples(spark, root).select("trial_id", "blk", "n", F.explode(ps).alias("f")).select("trial_id", "blk", "n", "f.*")


KEEP3 = "(a.kt IS NULL OR x.t-a.kt>=3 OR (x.name IN ('index_release','middle_release') AND x.name<>a.kn))"


@query("t10_threshold_events", views="samples", sql=f"""WITH {WIN}, """ + fold_sql(
    "SELECT * FROM wn", "trial_id", "t, name", ["t", "name"], {"kn": "CAST(NULL AS VARCHAR)", "kt": "CAST(NULL AS BIGINT)"},
    {"kn": f"CASE WHEN {KEEP3} THEN x.name ELSE a.kn END", "kt": f"CASE WHEN {KEEP3} THEN x.t ELSE a.kt END"},
    f"CASE WHEN {KEEP3} THEN [{{'t': x.t, 'name': x.name}}] ELSE [] END", "STRUCT(t BIGINT, name VARCHAR)")[5:])
def t10(spark, root):
    return E.threshold_events(class_frames(spark, root), ["trial_id"], "n", "cls", "p", F.lit(0.55), 3, levels=[["blk"]], order_of=F.col("o"))


REL = "(CASE a.pn WHEN 'index_press' THEN 'index_release' ELSE 'middle_release' END)"


@query("t11_press_release", views="samples", sql=fold_sql(
    f"SELECT trial_id, epoch_us(ts) t, {NAME_SQL} AS name FROM samples", "trial_id", "t, name", ["t", "name"],
    {"pn": "CAST(NULL AS VARCHAR)", "pt": "CAST(NULL AS BIGINT)"},
    {"pn": "CASE WHEN x.name IN ('index_press','middle_press') THEN x.name END", "pt": "CASE WHEN x.name IN ('index_press','middle_press') THEN x.t END"},
    f"""CASE WHEN a.pn IS NOT NULL AND x.name={REL} THEN [{{'t': x.t, 'name': x.name, 'syn': false, 'held': x.t-a.pt, 'ok': x.t-a.pt>=10800000000}}]
 ELSE list_concat(CASE WHEN a.pn IS NOT NULL THEN [{{'t': x.t, 'name': {REL}, 'syn': true, 'held': x.t-a.pt, 'ok': false}}] ELSE [] END,
  CASE WHEN x.name IN ('index_release','middle_release') THEN [] ELSE [{{'t': x.t, 'name': x.name, 'syn': false, 'held': CAST(NULL AS BIGINT), 'ok': CAST(NULL AS BOOLEAN)}}] END) END""",
    "STRUCT(t BIGINT, name VARCHAR, syn BOOLEAN, held BIGINT, ok BOOLEAN)", "o.t AS t, o.name AS name, o.syn AS synthetic, o.held AS held, o.ok AS hold_ok"))
def t11(spark, root):
    return E.press_release(named(spark, root), ["trial_id"], "blk", 3 * HOUR)


@query("t12_activity")
def t12(spark, root):
    s = samples(spark, root).select("trial_id", "blk", "n", "t_ms", (F.col("c0") * F.col("c0")).alias("e"))
    return E.activity(s, ["trial_id"], "n", "t_ms", "e", "blk", baseline_rows=20, window=3, onset_rows=2, quiet_rows=2, refractory_rows=2, onset_sigma=1.5, offset_sigma=1.0)


@query("t13_ordered_labels", views="samples", sql=fold_sql(
    "SELECT trial_id, n, event_type='error' AS u FROM samples", "trial_id", "n", ["n", "u"], {"c": "CAST(0 AS BIGINT)"},
    {"c": "CASE WHEN x.u THEN greatest(a.c-1,0) ELSE a.c+1 END"}, "[{'n': x.n, 'label': CASE WHEN NOT x.u THEN a.c%4 END}]", "STRUCT(n BIGINT, label BIGINT)"))
def t13(spark, root):
    return E.ordered_labels(samples(spark, root), ["trial_id"], ["n"], F.col("event_type") == "error", levels=[["blk"]]).select("trial_id", "n", "label")


@query("t16_effort_smoothing", views="samples", sql=fold_sql(
    "SELECT trial_id, n, least(greatest((c0+40)/200.0::DOUBLE,0),1)::DOUBLE AS v FROM samples", "trial_id", "n", ["n", "v"], {"y": "CAST(0 AS DOUBLE)"},
    {"y": "a.y+(CASE WHEN x.v>=a.y THEN 0.34 ELSE 0.10 END)::DOUBLE*(x.v-a.y)"}, "[{'n': x.n, 'y': a.y+(CASE WHEN x.v>=a.y THEN 0.34 ELSE 0.10 END)::DOUBLE*(x.v-a.y)}]",
    "STRUCT(n BIGINT, y DOUBLE)", "o.n AS n, round(o.y,6) AS y"))
def t16(spark, root):
    s = samples(spark, root).select("trial_id", "blk", "n", clamp01((F.col("c0") + 40) / 200.0).alias("x"))
    return chunked_fold(s, ["trial_id"], ["n"], "blk", by_row(steps.asymmetric(0.34, 0.10), ("n", "y")), 0.0, "n bigint, y double").select("trial_id", "n", r6("y", "y"))


KIND = "CASE k%4 WHEN 0 THEN 'enter' WHEN 1 THEN 'hold' WHEN 2 THEN 'exit' ELSE 'effort' END"
PW = "(CASE WHEN NOT a.seen THEN 1.0 WHEN x.kind='enter' THEN 0.34 WHEN x.kind='hold' THEN 0.06 WHEN x.kind='exit' THEN 0.30 ELSE 0.10 END)::DOUBLE"
PM = f"((1-{PW})*a.m+{PW}*(CASE WHEN x.kind IN ('enter','hold') THEN x.mo ELSE a.m END))"
PE = f"((1-{PW})*a.e+{PW}*(CASE WHEN x.kind='exit' THEN a.e ELSE x.mu END))"
PHD = f"CAST(round_even((1-{PW})*a.h+{PW}*(CASE WHEN x.kind IN ('exit','hold') THEN x.hd ELSE a.h END),0) AS BIGINT)"


@query("t17_control_profiles", views="samples", sql=fold_sql(
    f"SELECT trial_id, n, {KIND} AS kind, least(abs(c0)/100,1)::DOUBLE mo, (k/100.0)::DOUBLE mu, CAST(k*20 AS BIGINT) hd FROM samples", "trial_id", "n", ["n", "kind", "mo", "mu", "hd"],
    {"m": "CAST(0.5 AS DOUBLE)", "e": "CAST(0.5 AS DOUBLE)", "h": "CAST(450 AS BIGINT)", "seen": "false"}, {"m": PM, "e": PE, "h": PHD, "seen": "true"},
    f"[{{'n': x.n, 'm': {PM}, 'e': {PE}, 'h': {PHD}}}]", "STRUCT(n BIGINT, m DOUBLE, e DOUBLE, h BIGINT)", "o.n AS n, round(o.m,6) AS motion, round(o.e,6) AS muscle, o.h AS hold_ms"))
def t17(spark, root):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "enter").when(k % 4 == 1, "hold").when(k % 4 == 2, "exit").otherwise("effort")
    s = samples(spark, root).select("trial_id", "blk", "n", kind.alias("kind"), F.least(F.abs(F.col("c0")) / 100, F.lit(1.0)).alias("motion"),
                                    (k / 100.0).alias("muscle"), (k * 20).alias("held"))
    return E.profiles(s, ["trial_id"], "blk").select("trial_id", "n", r6("motion", "motion"), r6("muscle", "muscle"), "hold_ms")


@query("f12_motion_track")
def f12(spark, root):
    s = samples(spark, root).select("trial_id", "blk", "n", *[(F.col(a) / 100).alias(b) for a, b in (
        ("c0", "x"), ("c1", "y"), ("c2", "z"), ("c3", "gx"), ("c2", "gy"), ("c1", "gz"))])
    return E.motion_track(s, ["trial_id"], "n", "blk").select("trial_id", "n", r6("motion", "motion"))
