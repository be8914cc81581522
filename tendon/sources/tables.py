"""Readers, writers and checks of session tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import int24
from ..operators.joins import interval_join
from ..operators.ordered import index, scan


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Trial samples with declared types; absent optional columns get their defaults, absent required ones are an error."""
    have = set(spark.read.parquet(path).columns)
    missing = sorted(set(schemas.REQUIRED) - have)
    if missing:
        raise ValueError(f"{path} lacks fields: {', '.join(missing)}")
    d = spark.read.schema(schemas.ddl(schemas.TRIAL_SAMPLES)).parquet(path)
    known = (F.col("direction") != -1) & (F.col("gesture") != -1)
    fill = {"stable_mask": known, "window_quality": F.lit(1.0), "missing_mask": F.lit(False), "timestamp_valid": F.lit(True), "imu_valid": F.lit(True),
            "interpolated_imu": F.lit(False), "channel_quality": F.array_repeat(F.lit(1.0), 8), "quality_gate_pass": F.lit(True)}
    return d.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def read_split(spark: SparkSession, path: str, pool_test=False) -> DataFrame:
    """Partitions per (split, dataset) as sorted [start, end] lists; the test split may be pooled to one range."""
    return split_table(spark.read.schema(schemas.CORPUS_SPLIT).option("header", True).csv(path), pool_test)


def split_table(rows: DataFrame, pool_test=False) -> DataFrame:
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))  # partitions of one recording
    if pool_test:
        spans = F.when(F.col("split") == "test", F.array(F.struct(F.min("start").alias("start"), F.max("end").alias("end")))).otherwise(spans)
    return rows.groupBy("split", "dataset").agg(spans.alias("partitions"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """JSON calibrations; one without a version is version 1 with per-channel scaling."""
    d = spark.read.schema(schemas.CALIBRATION).option("multiLine", True).json(path)
    return calibration_defaults(d)


def calibration_defaults(d: DataFrame) -> DataFrame:
    v = F.coalesce("calibration_version", F.lit(1))
    return d.withColumns({"calibration_version": v, "emg_scale_mode": F.coalesce("emg_scale_mode", F.when(v == 1, "per_channel").otherwise("global"))})


def append_states(states: DataFrame, path: str, run_id: str, chunk: Column, order=("timestamp_ms",)) -> None:
    """Append rows with a run id and a sequence per run; refuse a log with another header."""
    spark = states.sparkSession
    want = schemas.ddl(schemas.STATE_LOG)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        have = spark.read.parquet(path).columns
        if have != want.fieldNames():
            raise ValueError("the state log has a different header")
    d = scan(states.withColumns({"run_id": F.lit(run_id), "__chunk": chunk}), ["run_id"], list(order), {"state_sequence": index()}, [["__chunk"]])
    for f in want:
        d = d.withColumn(f.name, (F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType))
    d.select(want.fieldNames()).write.mode("append").parquet(path)


def read_raw_stream(d: DataFrame, args="args") -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows) from positional records of 15 or 31 values."""
    a = F.col(args)
    size = F.size(a)
    at = lambda i, default: F.when(size == 31, F.get(a, F.lit(i))).otherwise(F.lit(default))
    flag = lambda i, default: F.when(size == 31, F.get(a, F.lit(i)) != 0).otherwise(F.lit(default))
    keep = [c for c in d.columns if c != args]
    good = d.where(size.isin(15, 31)).select(
        *keep, F.get(a, F.lit(0)).cast("bigint").alias("timestamp_ms"), F.slice(a, 2, 8).alias("emg"), F.slice(a, 10, 3).alias("accel"),
        F.slice(a, 13, 3).alias("gyro"), at(15, 1.0).alias("sample_quality"), flag(16, False).alias("missing"), flag(17, True).alias("timestamp_valid"),
        flag(18, True).alias("imu_valid"), flag(19, False).alias("interpolated_imu"), flag(20, True).alias("quality_gate_pass"),
        flag(21, False).alias("duplicate_packet"), flag(22, False).alias("out_of_order_packet"),
        F.when(size == 31, F.slice(a, 24, 8)).otherwise(F.array_repeat(F.lit(1.0), 8)).alias("channel_quality"))
    return good, d.where(~size.isin(15, 31) | size.isNull())


def write_trials(d: DataFrame, path: str, session="session_id") -> None:
    """Trials by session; an existing output is an error, and the committer publishes all or nothing."""
    d.repartition(session, F.pmod(F.xxhash64("trial_id"), F.lit(64))).write.mode("errorifexists").partitionBy(session).parquet(path)


def import_manifest(trials: DataFrame, keys=("participant", "session")) -> DataFrame:
    """Per source: trials, invalid ones left out, stable samples, fewest valid channels; `duplicates` counts repeated trial ids."""
    per = trials.groupBy(*keys, "trial_id").agg(F.count(F.lit(1)).alias("__c"), F.bool_and("valid").alias("valid"), F.sum("stable_samples").alias("stable_samples"),
                                                F.min("valid_channels").alias("valid_channels"))
    return per.groupBy(*keys).agg(F.count_if("valid").alias("trials"), F.count_if(~F.col("valid")).alias("excluded"), F.sum("stable_samples").alias("stable_samples"),
                                  F.min("valid_channels").alias("valid_channels"), F.count_if(F.col("__c") > 1).alias("duplicates"))


def register_session_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The eight session tables, partitioned by (participant_id, session_id), as typed temporary views."""
    out = {}
    for name, text in schemas.SESSION_TABLES.items():
        d = spark.read.schema(schemas.ddl(text + ", participant_id string, session_id string")).parquet(f"{root}/{name}")
        d.createOrReplaceTempView(name)
        out[name] = d
    return out


def slice_rows(d: DataFrame, t: str, start, end) -> DataFrame:
    """Rows in [start, end); the range reaches the Parquet filter."""
    return d.where((F.col(t) >= start) & (F.col(t) < end))


def trial_slices(samples: DataFrame, trials: DataFrame, keys, t: str, start: str, end: str, pad, lo: str, hi: str, width) -> DataFrame:
    """Samples of each trial with `pad` on both sides, clipped to the recording bounds lo and hi."""
    spans = trials.withColumns({"__a": F.greatest(F.col(start) - pad, F.col(lo)), "__b": F.least(F.col(end) + pad, F.col(hi))})
    return interval_join(samples, spans, keys, t, "__a", "__b", width)


def fingerprint(files: DataFrame, path: str, content: str, digits: int = 3) -> DataFrame:
    """Two-level fingerprint of a set of files. Contents are hashed where they lie.

    A file gives the line (path, NUL, content SHA-256). Lines go to groups by the first `digits` hex digits of the path's SHA-256; a group's digest is the
    SHA-256 of its lines in path order, and the fingerprint that of (group, NUL, digest) in group order. So no task holds more than 16^-digits of the lines.
    """
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")

    def digest(name: str, value: str):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, value))), lambda s: F.concat(s[name], nul, s[value])), ""), 256)

    line = files.select(F.col(path).cast("string").alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    groups = line.groupBy(F.substring(F.sha2("p", 256), 1, digits).alias("g")).agg(digest("p", "h").alias("d"))
    return groups.agg(digest("g", "d").alias("fingerprint"))


def file_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return fingerprint(d.withColumn("rel", F.substring_index("path", root.rstrip("/") + "/", -1)), "rel", "content")


def upsert_corpus(old: DataFrame, new: DataFrame, key="dataset", order=("participant", "session", "dataset")) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; missing columns stay empty; stable order."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).orderBy(*order)


def publish_version(d: DataFrame, root: str, version: int) -> str:
    """Write a new version path; readers switch by path, so a half-written table is never seen."""
    path = f"{root}/v={version:08d}"
    d.write.mode("errorifexists").parquet(path)
    return path


# fixed values: file name pattern and key ranges
SOURCE_PATTERN = r"user_(\d+)_day_(\d+)_posture_(\d+)"
SUBJECTS, DAYS, POSTURES = 7, 8, 4


def parse_source_keys(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(files with keys and a status, expected keys without a file)."""
    part = lambda i: F.when(F.regexp_extract(path, SOURCE_PATTERN, i) != "", F.regexp_extract(path, SOURCE_PATTERN, i).cast("int"))
    d = files.withColumns({"subject": part(1), "day": part(2), "posture": part(3)})
    inside = F.col("subject").between(1, SUBJECTS) & F.col("day").between(1, DAYS) & F.col("posture").between(1, POSTURES)
    n = d.groupBy("subject", "day", "posture").agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(n, ["subject", "day", "posture"], "left")
    d = d.withColumn("status", F.when(F.col("subject").isNull(), "no_key").when(~inside, "out_of_range").when(F.col("__n") > 1, "duplicate").otherwise("ok")).drop("__n")
    spark = files.sparkSession
    grid = (spark.range(1, SUBJECTS + 1).select(F.col("id").cast("int").alias("subject"), F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("day"))
            .select("subject", "day", F.explode(F.sequence(F.lit(1), F.lit(POSTURES))).alias("posture")))
    return d, grid.join(d.where("status IN ('ok', 'duplicate')").select("subject", "day", "posture").distinct(), ["subject", "day", "posture"], "left_anti")


# fixed values: frame layout and scales
FRAME_BYTES, SYNC, EMG_KIND, IMU_KIND, GYRO_STEP, ACCEL_STEP = 29, "D2D2D2", "AA", "BB", 0.0012, 0.0005978


def decode_frames(d: DataFrame, frame="frame") -> DataFrame:
    """Typed packets from framed bytes: kind, sequence, eight 24-bit counts or six scaled 16-bit values; others are bad."""
    raw = F.col(frame)
    cut = lambda i, n: F.substring(raw, i + 1, n)
    ok = (F.length(raw) == FRAME_BYTES) & (F.hex(cut(0, 3)) == SYNC)
    kind = F.when(ok & (F.hex(cut(3, 1)) == EMG_KIND), "EMG").when(ok & (F.hex(cut(3, 1)) == IMU_KIND), "IMU").otherwise("BAD")
    int16 = lambda b: F.conv(F.hex(b), 16, 10).cast("bigint")
    signed = lambda v: F.when(v >= 32_768, v - 65_536).otherwise(v)
    seq = F.when(kind != "BAD", F.conv(F.hex(cut(4, 1)), 16, 10).cast("int"))
    emg = F.when(kind == "EMG", F.array(*[int24(cut(5 + 3 * i, 3)) for i in range(8)]))
    imu = [signed(int16(cut(7 + 2 * i, 2))) for i in range(6)]
    return d.withColumns({"kind": kind, "seq": seq, "emg": emg, "gyro": F.when(kind == "IMU", F.array(*[v * GYRO_STEP for v in imu[:3]])),
                          "accel": F.when(kind == "IMU", F.array(*[v * ACCEL_STEP for v in imu[3:]]))})


def legacy_rates(samples: DataFrame, session: str, n: str, received_s: str, low=230.0, high=270.0) -> DataFrame:
    """Rate per session from the slope of the sample index on the receiving clock, and whether it is usable."""
    d = samples.groupBy(session).agg(F.regr_slope(F.col(n).cast("double"), F.col(received_s)).alias("rate_hz"))
    return d.withColumn("usable", F.col("rate_hz").between(low, high))


def import_legacy(samples: DataFrame, imu: DataFrame, trials: DataFrame, session: str, value: str, n="n", rate=250.0, target=200.0) -> DataFrame:
    """Rest and prompt segments of each trial, resampled, with the IMU value aligned on the sample index.

    samples (session, n, value); imu (session, n, v); trials (session, trial_id, rest_start, prompt_start, prompt_end).
    """
    from ..operators.joins import align_linear
    from ..operators.ordered import number_rows
    from ..operators.signal_jobs import resample
    aligned = align_linear(samples.select(session, n, value), imu.select(session, n, "v"), [session], n, "v", F.floor(F.col(n) / 65_536), rate * 0.03, 0.0)
    spans = trials.select(session, "trial_id", F.explode(F.array(
        F.struct(F.lit("rest").alias("segment"), F.col("rest_start").alias("a"), F.col("prompt_start").alias("b")),
        F.struct(F.lit("prompt").alias("segment"), F.col("prompt_start").alias("a"), F.col("prompt_end").alias("b")))).alias("s")).select(session, "trial_id", "s.*")
    cut = interval_join(aligned.select(session, n, value, "aligned", "valid"), spans, [session], n, "a", "b", width=1024).drop("a", "b")
    keys = [session, "trial_id", "segment"]
    cut = number_rows(cut, keys, [n], "i")  # a segment is bounded
    emg = resample(cut, keys, "i", value, rate, target, "emg")
    at = F.rint(F.col("i") * (rate / target)).cast("bigint")
    return emg.withColumn("src", at).join(cut.select(*keys, F.col("i").alias("src"), "aligned", "valid"), [*keys, "src"], "left").drop("src")
