"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, counted, text_of, without

LEVELS = ("domain", "lang", "source")
OUT = ("epoch", "tokens")
#: First hex digits of the order key that name a slice of a leaf.
DIGITS = 3


def word_count(name: str = "text") -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.regexp_count(text_of(name), F.lit(f"{NOT_SPACE}+")).cast("long")


def share_out(children: DataFrame, by: str, name: str) -> DataFrame:
    """Give every child its part of its parent's `budget`: column `part`.

    children: columns of the parent (`by`), `name`, weight, cap (what it can take), budget (of the parent). Parts follow the
    weights; what a child cannot take goes to its siblings by weight, until the budget or all caps are used up. Sorted by cap
    per weight, the children that fill up come first; the others share the rest, rounded down.
    """
    cols = children.columns
    w = f"OVER (PARTITION BY {by} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = (children.where("weight > 0").selectExpr("*", "CAST(cap AS DOUBLE) / weight AS ratio")
              .selectExpr("*", f"sum(weight) OVER (PARTITION BY {by}) AS all_weight", f"coalesce(sum(weight) {w}, 0) AS weight_before", f"coalesce(sum(cap) {w}, 0) AS cap_before")
              .selectExpr("*", "CAST(cap AS DECIMAL(38,0)) * (all_weight - weight_before) <= CAST(weight AS DECIMAL(38,0)) * (budget - cap_before) AS filled")
              .selectExpr("*", f"coalesce(sum(CASE WHEN filled THEN weight END) OVER (PARTITION BY {by}), 0) AS filled_weight",
                          f"coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {by}), 0) AS filled_cap"))
    part = "CASE WHEN filled THEN cap ELSE CAST((CAST(weight AS DECIMAL(38,0)) * (budget - filled_cap)) div (all_weight - filled_weight) AS BIGINT) END AS part"
    return ranked.selectExpr(*cols, part)


def budgets(leaves: DataFrame, weights: DataFrame, total: int, epochs: int) -> DataFrame:
    """Budget of every leaf.

    leaves: domain, lang, source, tokens. weights: level ('domain', 'lang' or 'source'), name, weight (long); a name that is not
    listed weighs 1, one of weight 0 gets nothing, and what lies below it counts for no node above. A leaf takes its tokens `epochs` times at most, a node what its leaves take. The
    total is shared among domains, a domain's budget among its languages, a language's among its sources, so
    a shortage goes to siblings first and reaches the level above only when all of them are full.
    """
    tree = leaves.selectExpr(*LEVELS, "tokens", f"tokens * {epochs} AS cap")
    for level in LEVELS:
        tree = tree.join(weights.where((F.col("level") == level) & (F.col("weight") == 0)).select(F.col("name").alias(level)), level, "left_anti")
    tree = counted(tree.select(*LEVELS, "tokens", "cap"))
    out = None
    for depth, level in enumerate(LEVELS):
        above, path = list(LEVELS[:depth]), list(LEVELS[:depth + 1])
        own = weights.where(F.col("level") == level).select(F.col("name").alias(level), F.col("weight"))
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).join(own, level, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        nodes = nodes.join(out, above).selectExpr(*path, "tokens", "cap", "weight", "budget") if above else nodes.selectExpr(*path, "tokens", "cap", "weight", f"{total}L AS budget")
        shared = share_out(nodes, ", ".join(above) or "'all'", level)
        out = shared.selectExpr(*path, "part AS budget") if depth < 2 else shared.selectExpr(*path, "tokens", "part AS budget")
    return out


def order_key(seed: int, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, total: Column | None = None, epochs: int = 2, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The selected rows of `docs`, one per epoch, with columns epoch (from 0) and tokens.

    domain is a column expression of the domain; languages and sources are the columns lang and source; a null one is the name ''. total is an
    expression over the sum `tokens` of all rows (default: as many tokens as there are); tokens counts one row (default: words).

    A leaf with budget b and t tokens gives b div t whole epochs, then of one more epoch the longest prefix of its rows whose
    tokens fit the rest. Each epoch has its own order, the MD5 of seed, epoch and id. Prefix sums are made of slices: the
    first digits of the key name a slice, sums per slice find the one in which the rest runs out, and only that slice's
    rows are put in order; all other rows pass without a shuffle, so a leaf with a third of all rows is no single task.

    Very long texts are counted whole; one that does not fit what is left of a prefix ends it. Null or empty texts have no tokens and are taken when their place in the order lies inside the prefix. Rows that repeat
    an id are counted each for itself. An empty table gives no rows. Input columns called like a result give way to it.
    """
    names = without(docs, *OUT)
    rows = docs.select(*names, domain.cast("string").alias("__domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), (tokens if tokens is not None else word_count(text_col)).cast("long").alias("__tokens"))
    rows = rows.withColumn("__domain", F.coalesce("__domain", F.lit("")))
    leaves = counted(rows.groupBy("__domain", "__lang", "__source").agg(F.sum("__tokens").alias("tokens")).toDF(*LEVELS, "tokens"))
    have = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    wanted = int(have.select((total if total is not None else F.col("tokens")).cast("long")).first()[0])
    plan = counted(budgets(leaves, weights, wanted, epochs).selectExpr(
        "domain AS __domain", "lang AS __lang", "source AS __source", "CASE WHEN tokens > 0 THEN CAST(budget div tokens AS INT) ELSE 0 END AS __whole",
        "CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS __rest"))
    leaf = ["__domain", "__lang", "__source"]
    keyed = rows.join(plan, leaf).withColumn("__key", order_key(seed, F.col("__whole"), id_col)).withColumn("__slice", F.substring("__key", 1, DIGITS))
    sums = keyed.where("__rest > 0").groupBy(*leaf, "__rest", "__slice").agg(F.sum("__tokens").alias("s"))
    ended = sums.selectExpr("*", f"sum(s) OVER (PARTITION BY {', '.join(leaf)} ORDER BY __slice) AS until").where("until > __rest")
    edge = counted(ended.groupBy(*leaf).agg(F.min(F.struct("__slice", (F.col("until") - F.col("s")).alias("before"))).alias("e"))
                   .selectExpr(*leaf, "e.__slice AS __edge", "e.before AS __before"))
    told = keyed.join(edge, leaf, "left")
    within = told.where("__slice = __edge AND __rest > 0").selectExpr(
        "*", f"__before + sum(__tokens) OVER (PARTITION BY {', '.join(leaf)} ORDER BY __key, __tokens ROWS UNBOUNDED PRECEDING) <= __rest AS __in")
    clear = told.where("NOT (__slice <=> __edge AND __rest > 0)").selectExpr("*", "__rest > 0 AND coalesce(__slice < __edge, true) AS __in")
    return (within.unionByName(clear).withColumn("__times", F.col("__whole") + F.col("__in").cast("int")).where("__times > 0")
            .select(*names, F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"), F.col("__tokens").alias("tokens")))
