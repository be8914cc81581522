"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = (2, 3, 4)
#: Filters of each width.
FILTERS = 16
#: Bytes of one window at prediction; the last window of a text is filled up with zeros.
WINDOW = 256
#: Labelled documents per language, at most about so many, on which the network is fitted.
PER_LANGUAGE = 1500
#: Characters of one training passage.
PASSAGE = 256
NONE = "und"
OUT = ("lang_pred", "score")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    labels: list[str]
    filters: list[np.ndarray]  # per width: [width, 256, FILTERS]
    bias: np.ndarray           # [len(WIDTHS) * FILTERS]
    out: np.ndarray            # [len(WIDTHS) * FILTERS, labels]
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, ...]:
        """The filters as tables over byte pairs: two bytes; the first two of three, and the third; the first two of four, and the last two."""
        two, three, four = self.filters
        pair = lambda w, j: (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1)
        return pair(two, 0), pair(three, 0), three[2].copy(), pair(four, 0), pair(four, 2)

    def features(self, x: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """Largest response of every filter over each window of bytes x [n, length]; a filter needs all its bytes inside.

        Places come first, so that the maximum runs over whole rows of memory.
        """
        two, three, third, four, last = tables
        x = np.ascontiguousarray(x.T)
        ids = (x[:-1].astype(np.int32) << 8) + x[1:]
        best = [two.take(ids, 0).max(0)]
        a = three.take(ids[:-1], 0)
        a += third.take(x[2:], 0)
        best.append(a.max(0))
        a = four.take(ids[:-2], 0)
        a += last.take(ids[2:], 0)
        best.append(a.max(0))
        return np.maximum(np.concatenate(best, 1) + self.bias, 0)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of `size` bytes, the last one filled up with zeros."""
    flat = np.zeros(-(-max(1, len(data)) // size) * size, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)
    return flat.reshape(-1, size)


def train(texts: list[bytes], labels: list[str], length: int = 96, epochs: int = 16, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Fit by Adam on random crops of 12 to `length` bytes. The gradient of a maximum goes to the place where it was taken."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(k, np.float32), rng.normal(0, 0.1, (k, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    for p in params[:len(WIDTHS)]:
        p[:, 0] = 0
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            x = np.zeros((len(rows), length), np.uint8)
            for i, r in enumerate(rows):
                n = int(rng.integers(12, length + 1))
                start = int(rng.integers(0, max(1, len(texts[r]) - n + 1)))
                part = np.frombuffer(texts[r][start:start + n], np.uint8)
                x[i, :len(part)] = part
            net = Network(names, params[:3], params[3], params[4], params[5])
            taken, raw = [], []
            for w, f in zip(WIDTHS, net.filters, strict=True):
                r = sum(f[j][x[:, j:length - w + 1 + j]] for j in range(w))
                taken.append(r.argmax(1))
                raw.append(r.max(1))
            raw = np.concatenate(raw, 1) + net.bias
            h = np.maximum(raw, 0)
            dz = net.probabilities(h)
            dz[np.arange(len(rows)), y[rows]] -= 1
            dz /= len(rows)
            dh = (dz @ net.out.T) * (raw > 0)
            grads = []
            for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = np.zeros_like(f)
                part = dh[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(x, taken[i] + j, 1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                g[:, 0] = 0  # the filling has no say
                grads.append(g)
            grads += [dh.sum(0), h.T @ dz, dz.sum(0)]
            step += 1
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Network(names, params[:3], params[3], params[4], params[5])


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that a network may learn from: three of four, by the CRC of the id, with text and language."""
    return docs.where(~held_out(id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on one passage of each of about `per_language` documents a language (fewer, if there are not so many).

    Documents are drawn by a hash of id and text, rows that are equal in both as one, and the passage starts at a hashed place of the whole text, so the sample is
    the same however the table is split. Of each language the first `per_language` by that hash are kept, in Spark, so at most
    languages x per_language passages of PASSAGE characters reach the driver, whatever ids and repeats the table has. None if nothing is labelled.
    """
    one = F.xxhash64(F.lit(17), F.col(id_col), F.col("text"))
    rows = learning_rows(docs, id_col).withColumn("__one", one)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("__one")).collect()}  # a row per language
    if not counts:
        return None
    draw = F.pmod("__one", F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.5 * per_language / max(1, n)))]), F.col("lang"))
    start = F.pmod(F.xxhash64(F.lit(23), F.col(id_col), F.col("text")), F.greatest(F.length("text") - PASSAGE, F.lit(1))) + 1
    drawn = rows.where(draw < share).select("lang", "__one", F.col("text").substr(start.cast("int"), F.lit(PASSAGE)).alias("t"))
    drawn = drawn.groupBy("lang", "__one").agg(F.min("t").alias("t"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("__one", F.lit(1 << 30)), "__one"))
    sample = drawn.withColumn("place", first).where(F.col("place") <= per_language).select("lang", "place", "t").toPandas().sort_values(["lang", "place"], kind="stable")
    sample = sample[sample["t"].str.contains(_LETTER)]
    if not len(sample):
        return None
    return train([t.encode() for t in sample["t"]], sample["lang"].tolist())


def predict(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred and score.

    The whole text is cut into windows of WINDOW bytes; the windows' softmax outputs are averaged by their bytes, and the
    likeliest language and its share are the result. A text that is null or has no letter is `und` with score 0, as is every text
    where nothing could be learned. Windows of many texts are scored together, 64 at a time, so a very long text needs little memory.
    Input columns called like a result give way to it.
    """
    names = [c for c in docs.columns if c.lower() not in OUT]
    at = len(names)
    shown = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias("__t"))
    chunk = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, scores = [NONE] * len(texts), np.zeros(len(texts))
            sums = np.zeros((len(texts), len(net.labels) if net else 0))
            total = np.zeros(len(texts))
            queue, owner, size = [], [], 0

            def flush():
                x, who = np.concatenate(queue), np.concatenate(owner)
                for lo in range(0, len(x), chunk):
                    part, mine = x[lo:lo + chunk], who[lo:lo + chunk]
                    weight = (part != 0).sum(1).astype(np.float64)
                    np.add.at(sums, mine, net.probabilities(net.features(part, tables)) * weight[:, None])
                    np.add.at(total, mine, weight)

            for i, t in enumerate(texts if net else []):
                if not t or not _LETTER.search(t):
                    continue
                w = windows(t.encode())
                queue.append(w)
                owner.append(np.full(len(w), i))
                size += len(w)
                if size >= 16 * chunk:
                    flush()
                    queue, owner, size = [], [], 0
            if queue:
                flush()
            for i in np.flatnonzero(total):
                p = sums[i] / total[i]
                best = int(p.argmax())
                langs[i], scores[i] = net.labels[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(langs), pa.array(scores)], names=[*b.schema.names[:at], *OUT])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:at]]
    return shown.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
