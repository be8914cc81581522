"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from ..runtime import ship
from .chat import format_chats, loss_text, parse
from .common import table
from .exact_dedup import exact_dedup
from .language_id import fit, held_out, predict
from .license_scan import scan
from .license_texts import NOTICES
from .line_dedup import dedup_lines
from .mixing import mix
from .neighbours import nearest
from .packing import pack
from .pii import BASE, KINDS, LEAST, NEAR, PATTERNS, POINTS, WORD_POINTS, WORDS, find_spans
from .prefix_trie import prefix_trie
from .repair import digests, repair
from .ropes import AUDIT, LAST, SYMBOLS, symbol
from .simhash import near_dedup
from .token_rollup import count_documents
from .turns import in_order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark, root):
            ship(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def notices(spark):
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(NOTICES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(template, license, text)")


@query("op1_license_scan", r"""
WITH notices AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(NOTICES)) + r""") v(template, license, text)),
tw AS (SELECT template, license, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM notices),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM tw) x),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw) x),
occ AS (SELECT doc_id, ts.template, i, ds.s, n FROM ds JOIN ts ON ds.s = ts.s JOIN tn ON tn.template = ts.template),
best AS (SELECT a.doc_id, a.template, a.i, a.n, count(DISTINCT b.s) AS m FROM occ a JOIN occ b
         ON a.doc_id = b.doc_id AND a.template = b.template AND b.i >= a.i AND b.i < a.i + ceil((5 * a.n) / CAST(4 AS DOUBLE)) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY m DESC, i) AS r FROM best WHERE 5 * m >= 4 * n)
SELECT doc_id, top.template, license, m / CAST(n AS DOUBLE) AS containment, i - 1 AS start_word FROM top JOIN notices ON notices.template = top.template WHERE r = 1""")
def op1(spark, root):
    return scan(table(spark, root, "documents"), notices(spark))


#: Weights of the mixture: domains are dealt to the sources by their numbers.
DOMAINS = ("web", "books", "code", "forums")
MIXTURE = [("domain", "web", 4), ("domain", "books", 3), ("domain", "code", 2), ("domain", "forums", 1),
           ("lang", "en", 5), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 1)]
EPOCHS = 2


def domain_of():
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("int")
    return F.coalesce(F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), number % 4 + 1), F.lit("other"))


def mixture(spark):
    rows = ", ".join(f"('{level}', '{name}', {weight}L)" for level, name, weight in MIXTURE)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(level, name, weight)")


def _shared(name: str, source: str, above: str, level: str) -> str:
    """SQL of one level of the budgets."""
    key = ", ".join(above.split()) or "1"
    before = f"OVER (PARTITION BY {key} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM ({source}) x WHERE weight > 0),
{name}_b AS (SELECT *, sum(weight) OVER (PARTITION BY {key}) AS w, coalesce(sum(weight) {before}, 0) AS wb, coalesce(sum(cap) {before}, 0) AS cb FROM {name}_r),
{name}_f AS (SELECT *, CAST(cap AS HUGEINT) * (w - wb) <= CAST(weight AS HUGEINT) * (budget - cb) AS filled FROM {name}_b),
{name}_s AS (SELECT *, coalesce(sum(CASE WHEN filled THEN weight END) OVER (PARTITION BY {key}), 0) AS fw,
                    coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {key}), 0) AS fc FROM {name}_f),
{name} AS (SELECT * REPLACE (CAST(CASE WHEN filled THEN cap ELSE (CAST(weight AS HUGEINT) * (budget - fc)) // (w - fw) END AS BIGINT) AS budget) FROM {name}_s)"""


MIX_SQL = r"""
WITH rows_ AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
                      coalesce(list_extract(['web', 'books', 'code', 'forums'], TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1), 'other') AS domain FROM documents),
weights AS (SELECT * FROM (VALUES """ + ", ".join(str(w) for w in MIXTURE) + r""") v(level, name, weight)),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 2 AS BIGINT) AS cap FROM rows_ GROUP BY ALL),
live AS (SELECT * FROM leaves l WHERE NOT EXISTS (SELECT 1 FROM weights v WHERE v.weight = 0 AND (v.level, v.name) IN (('domain', l.domain), ('lang', l.lang), ('source', l.source)))),
langs AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM live GROUP BY ALL),
domains AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM live GROUP BY ALL),""" + _shared(
    "d", "SELECT n.domain, cap, coalesce(weight, 1) AS weight, (SELECT CAST(sum(tokens) AS BIGINT) FROM leaves) AS budget FROM domains n "
         "LEFT JOIN weights v ON v.level = 'domain' AND v.name = n.domain", "", "domain") + "," + _shared(
    "l", "SELECT n.domain, n.lang, n.cap, coalesce(v.weight, 1) AS weight, d.budget FROM langs n JOIN d ON d.domain = n.domain "
         "LEFT JOIN weights v ON v.level = 'lang' AND v.name = n.lang", "domain", "lang") + "," + _shared(
    "s", "SELECT n.domain, n.lang, n.source, n.cap, n.tokens, 1 AS weight, l.budget FROM live n JOIN l ON l.domain = n.domain AND l.lang = n.lang", "domain lang", "source") + r""",
keyed AS (SELECT r.*, CASE WHEN s.tokens > 0 THEN budget // s.tokens ELSE 0 END AS whole, CASE WHEN s.tokens > 0 THEN budget % s.tokens ELSE 0 END AS rest
          FROM rows_ r JOIN s ON r.domain = s.domain AND r.lang = s.lang AND r.source = s.source),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || whole || ':' || doc_id), tokens ROWS UNBOUNDED PRECEDING) AS until FROM keyed),
times AS (SELECT *, whole + CAST(rest > 0 AND until <= rest AS INT) AS n FROM placed)
SELECT doc_id, lang, source, CAST(unnest(range(0, n)) AS INT) AS epoch, tokens FROM times WHERE n > 0"""


@query("op2_mix_sources", MIX_SQL)
def op2(spark, root):
    mixed = mix(table(spark, root, "documents"), mixture(spark), domain_of(), epochs=EPOCHS)
    return mixed.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "epoch", "tokens")


@query("op3_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT k.*, coalesce(k.doc_id > s.first, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id""")
def op3(spark, root):
    done = dedup_lines(table(spark, root, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_pack_windows")
def op4(spark, root):
    return pack(table(spark, root, "documents"))


@query("op5_simhash_groups")
def op5(spark, root):
    return near_dedup(table(spark, root, "documents"))


@query("op9_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) d
WINDOW w AS (PARTITION BY t)""")
def op9(spark, root):
    return exact_dedup(table(spark, root, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: A conversation that holds the template's own control strings.
HARD = "\\### Assistant: </turn> ok"


@query("op6_chat_format", r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
  SELECT *, contains(role, '### ') OR contains(text, '### ') OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, ': ') AS hard,
         replace(replace(replace(replace(role || chr(0) || text, '\', '\\'), '#', '\#'), ': ', ':\ '), '</turn>', '<\/turn>') AS esc FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN hard THEN length(esc) - 1 + 15 ELSE length(role) + length(text) + 14 END) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id""")
def op6(spark, root):
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    done = format_chats(rows.unionByName(own))
    turns = done.withColumn("t", parse(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    digest = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
                        F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op7_nearest_vectors")
def op7(spark, root):
    rows = table(spark, root, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


@query("op8_language_id")
def op8(spark, root):
    docs = table(spark, root, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op10_token_rollup")
def op10(spark, root):
    return count_documents(table(spark, root, "documents"))


#: SQL of the crc32 of a string's ASCII characters, in place of {}.
CRC32 = ("xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, byte: "
         "list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda reg, bit: xor(reg >> 1, (reg & 1) * 3988292384))))")


def _proposed(kind: str) -> str:
    """SQL of the matches of one kind, with the gaps before them."""
    p = PATTERNS[kind]
    return (f"SELECT doc_id, t, {KINDS.index(kind)} AS k, '{kind}' AS kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap "
            f"FROM (SELECT *, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM docs) x")


def _digits(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[0-9]'), lambda d: CAST(d AS INT))"


LUHN = f"list_sum(list_transform(list_reverse({_digits('hit')}), lambda d, j: CASE WHEN j % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0"
MOD97 = ("list_reduce(list_concat([0], list_transform(string_split(replace(hit, ' ', '')[5:] || hit[1:4], ''), lambda ch: CAST(CASE WHEN ch <= '9' THEN ascii(ch) - 48 ELSE ascii(ch) - 55 END AS INT))), "
         "lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1")
PII_SQL = "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nproposed AS (" + " UNION ALL ".join(map(_proposed, KINDS)) + f"""),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM proposed),
checked AS (SELECT *, e - length(hit) AS s FROM placed WHERE CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) < 4 AND CAST('0' || right(p, 3) AS INT) < 256))
  WHEN 'card' THEN len({_digits('hit')}) BETWEEN 12 AND 19 AND {LUHN}
  WHEN 'phone' THEN len({_digits('hit')}) BETWEEN 9 AND 15
  WHEN 'iban' THEN {MOD97}
  WHEN 'ssn' THEN left(hit, 3) NOT IN ('000', '666') AND hit[1] <> '9' AND hit[5:6] <> '00' AND hit[8:] <> '0000'
  ELSE true END),
near AS (SELECT *, translate(substring(t, CAST(greatest(0, s - {NEAR}) + 1 AS BIGINT), CAST(least(s, {NEAR}) AS BIGINT)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM checked),
scored AS (SELECT *, least(100, CASE kind {" ".join(f"WHEN '{k}' THEN {POINTS[k]} + CASE WHEN regexp_matches(w, '{WORDS[k]}') THEN {WORD_POINTS} ELSE 0 END" for k in KINDS)} END) AS p FROM near),
kept AS (SELECT * FROM scored a WHERE k < {BASE} OR (p >= {LEAST} AND NOT EXISTS (SELECT 1 FROM scored b WHERE b.doc_id = a.doc_id AND b.k < {BASE} AND b.s < a.e AND a.s < b.e)))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kind}" for i, kind in enumerate(KINDS[:BASE]))},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {BASE}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY s, k), '') AS points
FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op13_personal_data", PII_SQL)
def op13(spark, root):
    found = find_spans(table(spark, root, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["points"].cast("string")), ",").alias("points"))


def damage(rows):
    """Rows of `conversations` damaged by the crc32 of `conv_id:turn`, modulo 20: 0 drops, 1 empties, 2 removes sentence ends, 3 repeats, 4 makes it the user's. Nulls are one space."""
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    dealt = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return dealt.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


STEPS = ", ".join(f"('{sign}', {i}, {j}, {cost}, '{str(edits).translate(AUDIT)}')" for sign in SYMBOLS for i, row in symbol(sign).items() for j, (cost, edits) in row.items())
ENDS = ", ".join(f"({i}, {cost}, '{edits.translate(AUDIT)}')" for i, (cost, edits) in LAST.items())
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (SELECT *, """ + CRC32.format("k") + r""" % 20 AS d FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS time FROM coded WHERE d <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
numbered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM ranked),
faults AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS prev, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered),
signs AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(l) ELSE l END AS sign FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS l FROM faults) x),
steps AS (SELECT * FROM (VALUES """ + STEPS + r""") v(sign, i, j, more, edits)), ends AS (SELECT * FROM (VALUES """ + ENDS + r""") v(i, more, edits)),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM signs
  UNION ALL
  SELECT w.conv_id, w.n + 1, s.j, min({'cost': CAST(w.best.cost + s.more AS BIGINT), 'audit': w.best.audit || s.edits})
  FROM walk w JOIN signs r ON r.conv_id = w.conv_id AND r.n = w.n + 1 JOIN steps s ON s.sign = r.sign AND s.i = w.state GROUP BY w.conv_id, w.n, s.j),
told AS (SELECT conv_id, max(n) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM signs GROUP BY conv_id),
done AS (SELECT w.conv_id, min({'cost': CAST(w.best.cost + e.more AS BIGINT), 'audit': w.best.audit || e.edits}) AS best FROM walk w JOIN told t ON t.conv_id = w.conv_id AND t.n = w.n JOIN ends e ON e.i = w.state GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS p, unnest(string_split(best.audit, '')) AS c FROM done WHERE best.audit <> ''),
placed AS (SELECT *, sum(CASE WHEN c <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN c <> 'D' THEN 1 ELSE 0 END) OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
with_rows AS (SELECT p.*, s.role, s.text, max(CASE WHEN o = 1 AND c = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys FROM placed p LEFT JOIN signs s ON s.conv_id = p.conv_id AND s.n = p.n),
texts AS (SELECT conv_id, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
          FROM with_rows WHERE c <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(d.best.cost, 0) AS cost, coalesce(d.best.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id = c.conv_id LEFT JOIN done d ON d.conv_id = c.conv_id LEFT JOIN texts x ON x.conv_id = c.conv_id"""


@query("op11_structure_repair", REPAIR_SQL)
def op11(spark, root):
    rows = table(spark, root, "conversations")
    done = repair(damage(rows))
    every = rows.select("conv_id").distinct()
    told = every.join(done.summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    told = told.join(digests(done.turns), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


TRIE_SQL = r"""
WITH rows_ AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, """ + CRC32.format("CAST(conv_id AS VARCHAR)") + r""" % 4 AS h FROM (SELECT DISTINCT conv_id FROM rows_) x),
rebuilt AS (SELECT i.conv_id, r.n, role, text FROM ids i JOIN ranked r ON r.conv_id = i.base AND r.n <= i.h UNION ALL SELECT i.conv_id, r.n, role, text FROM ids i JOIN ranked r ON r.conv_id = i.conv_id AND r.n > i.h),
turns AS (SELECT conv_id, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth FROM rebuilt),
paths AS (SELECT conv_id, depth, words, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM turns UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
lengths AS (SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id),
nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last) AS ends
          FROM paths JOIN lengths USING (conv_id) GROUP BY p, depth),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.p[:n.depth] = n.p) AS n_children
           FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[:n.depth - 1]),
above AS (SELECT p[:d] AS top, d, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM linked) x)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, l.n_children, count(*) FILTER (WHERE a.n_children = 0) AS n_leaves, CAST(sum(a.saved) AS BIGINT) AS saved_tokens,
       sha256(coalesce(any_value(l.ends), '')) AS ends_sha256
FROM linked l JOIN above a ON a.d = l.depth AND a.top = l.p GROUP BY l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children"""


def rebuilt(rows):
    """(conv, turn, role, text): the first h turns of conversation c - c % 20, then the own turns of c after its first h; h is the crc32 of the number c, modulo 4."""
    turns = number_rows(in_order(rows.where("conv_id IS NOT NULL"), "conv_id", "turn", "role", "text", ""), ["conv"], ["row"], "turn_no", [["part"]])
    h = (F.crc32(F.col("conv").cast("string")) % 4).alias("h")
    own = turns.select("conv", "turn_no", "role", "text").where(F.col("turn_no") >= h)
    heads = turns.where("conv % 20 = 0 AND turn_no < 3").select(F.col("conv").alias("base"), "turn_no", "role", "text")
    lent = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv")).distinct().select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), h).join(heads, "base").where("turn_no < h")
    return own.union(lent.select("conv", "turn_no", "role", "text"))


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, root):
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    ids = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv")).distinct()
    return prefix_trie(rebuilt(rows), "conv", "turn_no", convs=ids)
