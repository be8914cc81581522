"""Trial archives (one .npz file per trial) as a table, from any file system that Spark reads."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import schemas

COLUMNS = "session_id string, trial_id string, n bigint, timestamp_ms double, emg array<double>, accel array<double>, gyro array<double>, direction int, gesture int"


def parse(path: str, content: bytes) -> pa.RecordBatch:
    """The samples of one archive; a missing field or a wrong shape is an error that names the file."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        missing = sorted(set(schemas.REQUIRED) - set(z.files))
        if missing:
            raise ValueError(f"{path} lacks fields: {', '.join(missing)}")
        t = z["timestamp_ms"].astype(float).reshape(-1)
        rows = len(t)
        if z["emg"].shape != (rows, 8) or z["accel"].shape != (rows, 3) or z["gyro"].shape != (rows, 3):
            raise ValueError(f"{path} has invalid sensor shapes")
        label = {c: np.broadcast_to(z[c].reshape(-1), rows).astype(np.int32) for c in ("direction", "gesture")}
        session, trial = (pa.array([str(z[c].reshape(-1)[0])] * rows, pa.string()) for c in ("session_id", "trial_id"))
        signals = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.astype(float).reshape(-1))) for x in (z[c] for c in ("emg", "accel", "gyro"))]
        columns = [session, trial, pa.array(np.arange(rows)), pa.array(t), *signals, *(pa.array(label[c]) for c in ("direction", "gesture"))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """All archives below `root`, found and read by Spark, many files to a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                yield parse(path.as_py(), content.as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(root)
    return files.select("path", "content").mapInArrow(run, COLUMNS)
