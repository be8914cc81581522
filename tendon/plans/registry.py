"""Named queries: a Spark function and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "samples": """samples AS (
SELECT user_id AS trial_id, user_id % 4 + 1 AS session_no, event_id, ts, event_type, k, n, n*5 AS t_ms,
       value-50.0 AS c0, (value-50.0)*((k%7)-3)/3.0 AS c1, (value-50.0)*((k%5)-2)/2.0 AS c2, CAST(k AS DOUBLE)-50.0 AS c3
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k,
             row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id)-1 AS n FROM events) s)""",
    "pred": """pred AS (
SELECT vec_id, vec_id%4+1 AS session_no, CAST(floor(vec_id/8) AS BIGINT) AS trial_id, label AS truth,
       CASE WHEN q<0.15 THEN -1 ELSE pred END AS pred, q
FROM (SELECT *, list_position(e,list_max(e))-1 AS pred, greatest(0.0,least(1.0,CAST(list_max(e) AS DOUBLE))) AS q
      FROM (SELECT vec_id,label,embedding[1:10] AS e FROM embeddings) a) b)""",
    "packets": """packets AS (
SELECT user_id % 4 + 1 AS session_no, CASE WHEN event_type='view' THEN 2 ELSE 1 END AS packet_type, event_id,
       CAST((event_id + CASE WHEN event_id%41=0 THEN -1 ELSE 0 END)%256 AS INT) AS packet_seq
FROM events WHERE event_id%37<>0)""",
    "trials": """trials AS (
SELECT o_orderkey AS trial_id, o_custkey%4+1 AS session_no, o_orderpriority AS label,
       o_orderstatus<>'P' AS valid, o_orderdate AS start_ts FROM orders)""",
    "cues": """cues AS (
SELECT l_orderkey AS trial_id, CASE WHEN l_linenumber%2=1 THEN 'arm:' ELSE 'hand:' END || l_returnflag AS name,
       l_shipdate AS cue_ts, l_linenumber AS cue_no FROM lineitem)""",
    # window ids of each sample: size 8, hop 4, full windows only
    "win": """win AS (
SELECT s.*, w.j, m.cnt FROM samples s
JOIN (SELECT trial_id, count(*) AS cnt FROM samples GROUP BY trial_id) m USING (trial_id)
JOIN (SELECT trial_id, unnest(range(0, (count(*)-8)//4+1)) AS j FROM samples GROUP BY trial_id HAVING count(*)>=8) w
  ON w.trial_id=s.trial_id AND s.n>=w.j*4 AND s.n<w.j*4+8)""",
}
NEEDS = {"win": ["samples"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Put the named fixture views before `body` (which may begin with more CTEs)."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in NEEDS.get(n, []) + [n] if x not in wanted]
    ctes = ",\n".join(VIEWS[n] for n in wanted)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{head}{ctes},\n{body[5:]}" if ctes else head + body[5:]
    return f"{head}{ctes}\n{body}" if ctes else body


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark, root):
            ship(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql, recursive)
        return fn

    return add
