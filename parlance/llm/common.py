"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; long texts make the default of 10,000 rows too heavy.
ARROW_ROWS = 512
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what one Arrow batch holds, for every Python operator of this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(mod)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def pieces(bounds: np.ndarray, most: int = 1 << 20):
    """Row ranges (a, b) whose texts hold at most `most` bytes together, or one longer row."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out[:n]


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hashes of spans that don't overlap and stand in order, for some `block` bytes at a time, so that a long text needs no more memory than a short one."""
    out, a = [], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, side="right")))
        out.append(_span_hashes(raw[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span that is equal for equal bytes.

    A span's bytes are scrambled, weighted by powers of an odd number and summed by one running
    sum; the weight of the span's start is then divided out, so it takes a few passes over the
    bytes whatever the lengths.
    """
    n = len(raw)
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = (_powers(size, _BASE), _powers(size, _INVERSE))
    up, down = _POWERS[size]
    table_ = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(table_[raw] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans_where(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row bounds, and each row's first run (n + 1)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = bounds[bounds < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = bounds[(bounds > 0) & (bounds <= n)] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shared_folder(spark: SparkSession) -> None:
    """Where checkpoint() writes: the session's spark.checkpoint.dir. Only on one machine, as in tests, may it be unset: there a folder in the warehouse does."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the taken ones equals in any case of its letters."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def eq(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def release(spark: SparkSession) -> None:
    """Lets the driver's cleaner delete shuffle and checkpoint files of rounds that are over: it works only when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, by their key's hash. What tasks send to be ordered is about as many rows in all, not in each."""
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, (1.2 * most + 200) / n) * (1 << 30)))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def sample_labels(labels: DataFrame, label: str, most: dict[int, int], key: str = "doc_id") -> DataFrame:
    """key, label of at most most[y] distinct keys of each label y, picked by hash."""
    rows = labels.select(key, F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull()).distinct()
    parts = [bounded_sample(rows.where(F.col("label") == y), key, n) for y, n in most.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def labelled_texts(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text, label of the documents of `known` (key, label; few rows, as sample_labels gives). A key that repeats counts once, with the least of its texts."""
    both = docs.select(key, text).join(F.broadcast(known), key)  # as many rows as the sample's bound
    return both.groupBy(key, "label").agg(F.min(text).alias("text")).select("text", "label")
