"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, text_of

#: Words of a shingle, and the share of a template's shingles that must be found together.
WORDS, SHARE = 5, 0.8
#: Chance with which a band of a window that holds enough of a piece agrees with the piece's.
CERTAIN = 0.999
#: Against rounding, where a product is a whole number.
TINY = 1e-9
#: Shingles of the shortest and longest pieces that a class of windows looks for; templates are cut into pieces of at most the last.
CLASSES = ((1, 1), (2, 3), (4, 6))


def bands(low: int, high: int, share: float = SHARE, certain: float = CERTAIN) -> int:
    """Bands of one row that a class needs: a window of 2 x high shingles (1 for single ones) that holds `share` of a
    piece of n shingles has at least the similarity hits / (window + n - hits) with it."""
    window = window_size(high)
    hits = {n: math.ceil(share * n - TINY) for n in range(low, high + 1)}
    least = min(h / (window + n - h) for n, h in hits.items())
    return 1 if least >= 1 else math.ceil(math.log(1 - certain) / math.log(1 - least))


def window_size(high: int) -> int:
    return 1 if high == 1 else 2 * high


def words(text: Column) -> Column:
    """Letters and digits in runs, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(own: Column) -> Column:
    """A hash for every run of WORDS words of the array `own`; none if there are fewer."""
    return F.transform(F.sequence(F.lit(0), F.size(own) - WORDS), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(WORDS)]))


def _let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is made once per row: a filter on a plain column would be moved down with a copy of its whole expression, which inside a
    lambda is made again for every element."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _shingled(df: DataFrame, text: Column) -> DataFrame:
    """`df` with __shingles, where the text has any."""
    held = _let(df, "__words", words(text)).where(F.size("__words") >= WORDS)
    return _let(held, "__shingles", shingle_hashes(F.col("__words"))).drop("__words")


def _mixed(x: Column, band: int) -> Column:
    """The order of shingles in one band."""
    return F.xxhash64(x, F.lit(band))


def _keys(shingles: Column, n: int) -> Column:
    """The least shingle of each of the first n bands."""
    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.struct(_mixed(x, band).alias("m"), x.alias("x"))))["x"]
    return F.array(*[least(b) for b in range(n)])


def _pieces(templates: DataFrame) -> DataFrame:
    """Pieces of the templates' shingles: a template with enough of its shingles in a text has a piece with enough of its own there."""
    longest = CLASSES[-1][1]
    size = F.ceil(F.size("__set") / F.ceil(F.size("__set") / longest)).cast("int")
    starts = F.sequence(F.lit(1), F.size("__set"), size)
    return (templates.select("template", F.explode(F.transform(starts, lambda s: F.slice("__set", s, size))).alias("piece"))
            .withColumn("n", F.size("piece")))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, license, containment, start_word): templates found in each text, each at its best place.

    templates: template (number), license, text. Words are runs of letters and digits, lower-cased; a template of T different shingles
    of WORDS words is in a text when some stretch of T / SHARE shingles holds at least SHARE of them. containment is the largest such share,
    start_word the first word of the first stretch that has it (stretches begin at a shingle of the template).

    Retrieval: templates are cut into pieces of at most six shingles, and windows of twice a piece's length, overlapping so far
    that any piece lies whole in one, are compared with the pieces of their class by MinHash bands of one row; `bands` gives the number
    that finds a window holding enough of a piece with probability CERTAIN. A band can only agree in the very shingle that is the piece's
    least there, so texts without any of these few shingles have no band to compare and are passed over before windows are made.
    Verification: exact containment over the whole text, for the templates retrieved.

    Templates are a list of notices, broadcast only if they are few. Texts do not meet one another, so no
    key is shared by many rows; nothing is shuffled but the rows that matched. Very long texts are scanned whole. Null, empty and short texts match nothing, nor do templates of fewer than WORDS words.
    Rows that repeat an id or text are scanned each for itself; an empty table gives no rows. Other columns are not looked at.
    """
    known = _shingled(templates, text_of()).withColumn("__set", F.array_distinct("__shingles"))
    known = counted(known.select(F.col("template"), "license", "__set"))
    pieces = _pieces(known)
    index = None
    for c, (low, high) in enumerate(CLASSES):
        own = pieces.where(F.col("n").between(low, high)).select(F.lit(c).alias("class"), "template", F.posexplode(_keys(F.col("piece"), bands(low, high))).alias("band", "key"))
        index = own if index is None else index.union(own)
    index = counted(index.distinct())
    telling = F.lit(sorted(r[0] for r in index.select("key").distinct().collect()) or [0])  # at most the shingles of the templates

    text = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    held = (_shingled(text, F.col("__text")).select("__id", "__row", "__shingles")
            .where(F.arrays_overlap("__shingles", telling)))

    def windows(c: int) -> Column:
        low, high = CLASSES[c]
        size = window_size(high)
        step = size - high + 1
        starts = F.sequence(F.lit(1), F.size("__shingles"), F.lit(step))
        near = F.filter(F.transform(starts, lambda s: F.slice("__shingles", s, size)), lambda w: F.arrays_overlap(w, telling))
        found = F.flatten(F.transform(near, lambda w: F.transform(_keys(w, bands(low, high)), lambda k, b: F.struct(F.lit(c).alias("class"), b.alias("band"), k.alias("key")))))
        return found

    found = F.array_distinct(F.concat(*[windows(c) for c in range(len(CLASSES))]))
    met = (held.select("__id", "__row", "__shingles", F.explode_outer(found).alias("f")).select("__id", "__row", "__shingles", "f.*")
           .join(index, ["class", "band", "key"]).select("__id", "__row", "__shingles", "template").dropDuplicates(["__id", "__row", "template"]))
    place = F.transform(F.filter(F.sequence(F.lit(1), F.size("__shingles")), lambda i: F.array_contains("__set", F.get("__shingles", i - 1))), lambda i: F.struct(
        F.size(F.array_intersect(F.slice("__shingles", i, F.ceil(F.size("__set") / SHARE - TINY).cast("int")), F.col("__set"))).alias("n"), (-i).alias("at")))
    return (_let(met.join(known, "template"), "__best", F.array_max(place)).where(F.col("__best.n") >= SHARE * F.size("__set") - TINY)
            .select(F.col("__id").alias(id_col), "template", "license", (F.col("__best.n") / F.size("__set")).alias("containment"), (-F.col("__best.at") - 1).cast("long").alias("start_word")))
