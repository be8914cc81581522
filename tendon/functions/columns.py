"""Small column expressions used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c, name: str | None = None) -> Column:
    out = F.round(col(c).cast("double"), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def clamp01(c) -> Column:
    return F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def reinhard(c, full: float = 64.0, midpoint: float = 32.0) -> Column:
    return F.lit(full) * col(c) / (F.lit(midpoint) + F.abs(col(c)))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def as_doubles(arr) -> Column:
    return F.transform(col(arr), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def mean(a) -> Column:
    return total(as_doubles(a)) / F.size(col(a))


def centred(a) -> Column:
    return let(mean(a), lambda m: F.transform(col(a), lambda x: x.cast("double") - m))


def cosine(a, b, centre: bool = True) -> Column:
    """Cosine of two arrays after removing their means; -1 where one has no length."""
    x, y = (centred(a), centred(b)) if centre else (col(a), col(b))
    size = norm(x) * norm(y)
    return F.when(size > 1e-12, dot(x, y) / size).otherwise(F.lit(-1.0))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(arr, temperature=1.0) -> Column:
    t = F.greatest(temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-4))
    return let(F.transform(as_doubles(arr), lambda v: v / t), lambda z: let(
        F.array_max(z), lambda top: let(F.transform(z, lambda v: F.exp(v - top)), lambda e: let(
            total(e), lambda s: F.transform(e, lambda v: v / s)))))


def two_class(z) -> Column:
    """One logit as the two-class pair."""
    return F.array(-col(z), col(z))


def roll(arr, shift) -> Column:
    """Element i moves to (i + shift) mod n."""
    a = col(arr)
    n = F.size(a)
    s = F.pmod(shift if isinstance(shift, Column) else F.lit(int(shift)), n)
    return F.when(s == 0, a).otherwise(F.concat(F.slice(a, n - s + 1, s), F.slice(a, 1, n - s)))


def margin(arr) -> Column:
    """Best minus second best; the best alone if there is one."""
    s = F.sort_array(col(arr), asc=False)
    return F.when(F.size(s) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(F.get(s, F.lit(0)))


def argmax(arr) -> Column:
    return F.array_position(col(arr), F.array_max(col(arr))) - 1


def circular_diagonals(matrix, size: int = 8, count: int = 4) -> Column:
    """Diagonals 0..count-1 of a row-major size x size array, wrapping round."""
    m = col(matrix)

    def diagonal(o):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                           lambda i: F.get(m, (i * size + F.pmod(i + o, F.lit(size))).cast("int")))
    return F.flatten(F.array(*[diagonal(o) for o in range(count)]))


def log_grid(low: float, high: float, n: int) -> Column:
    """n values with equal ratios from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.lit(low) * F.pow(F.lit(high / low), i / F.lit(float(n - 1))))


def decibel(ratio) -> Column:
    return F.lit(10.0) * F.log10(col(ratio))


def int24(raw) -> Column:
    """Signed big-endian 24-bit integer from three bytes."""
    v = F.conv(F.hex(col(raw)), 16, 10).cast("bigint")
    return F.when(v >= (1 << 23), v - (1 << 24)).otherwise(v)


def has_flag(flags, bit: int) -> Column:
    return col(flags).bitwiseAND(F.lit(1 << bit)) != 0


def json_field(c, path: str) -> Column:
    return F.get_json_object(col(c), path)
