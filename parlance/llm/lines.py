"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line-ID sequences.

A document is the sequence of its non-blank lines, each with the rank of its ID (two hashes) among the lines that
occur more than once. At depth 2L a block's rank is that of its pair of ranks at depth L, so ranks are in the order
of the line-ID sequences: the suffix array over all documents, sorted to that depth. It is sorted by ranges, and a
rank is the number of the range and the place in it, which no single task has to count. All places with one
rank are an interval of the suffix array whose longest common prefix is at least the block. Intervals with one
place leave at once, and with them every longer block at that place.

A run counts if it holds at least `min_words` words and occurs before: in an earlier document
(order: key, nulls first, then a hash of the text) or further up in the same one. It is enough to
look at the runs that just reach `min_words`, from each line on and back from each line: their
union is the union of the maximal repeated runs. A run of L lines, 2^k < L <= 2^(k+1), is ranked by
the pair of its first and last 2^k lines. Words are runs of characters that are no white space, so the depths
end at min_words lines, however long texts are; only lines of other white space than blanks, which count as
lines without words, can make a run longer, and depths go on until none is left.
Every line of a run that occurs before is deleted; blank lines and first copies stay.

Null and empty texts stay as they are. A document all of whose lines went is left with the empty
text; `dedup(..., drop_emptied=True)` drops it instead. Rows that repeat both key and text are
one document: each gets the same result. Counts that travel are per class and place, so that a line
that is in every document is one row per document, never a list. A text is split by the JVM and its lines travel as
rows, so a very long one is bounded by the size of a row only. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, release, shared_folder, small_batches, table

MIN_WORDS = 25
#: Characters with Unicode's property White_Space that can stand in a line, other than the blank; first those of one byte.
_SPACES = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _words(line: Column) -> Column:
    """Runs of characters that are no white space. Most lines part them by single blanks and are not taken apart: their blanks are counted."""
    bare = F.trim(line)
    odd = functools.reduce(Column.__or__, (F.contains(bare, F.lit(x)) for x in ("  ", *_SPACES[:4]))) | ((F.octet_length(bare) != F.length(bare)) & bare.rlike(f"[{_SPACES}]"))
    apart = F.size(F.array_remove(F.split(F.translate(bare, _SPACES, " " * len(_SPACES)), " "), ""))
    return F.when(odd, apart).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame, key: str, text: str, count: bool = True) -> DataFrame:
    """One row for each non-blank line: key, h (hash of the text), i (number among non-blank lines), two hashes, words (0 without count)."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.trim(x)) > 0)
    facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (_words(x) if count else F.lit(0)).alias("w")))
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.posexplode(facts).alias("i", "f"))
    return rows.select("d", "h", "i", "f.a", "f.b", "f.w")


def _place() -> Column:
    return F.struct("d", "h", "i")


def _ranked(blocks: DataFrame, by: list[str], places: DataFrame | None = None) -> DataFrame:
    """Adds `rank`, the place of the block's interval in the order of `by`, and `later` (the interval has an earlier place); drops intervals with one place.

    The intervals are written before the join: with no aggregate between shuffle and join, Spark can split
    the partition of a line that a large share of all documents holds. `places` are the blocks without what ranks don't need.
    """
    intervals = (blocks if places is None else places).groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first != last").drop("last").checkpoint()
    ranks = intervals.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()).checkpoint()
    return blocks.join(ranks, by).withColumn("later", F.col("first") != _place()).drop("first")


def _runs(numbers: np.ndarray, words: np.ndarray, least: int) -> set[tuple[int, int]]:
    """(first place in the arrays, lines) of the runs that just reach `least` words within neighbouring lines."""
    out: set[tuple[int, int]] = set()
    cuts = np.r_[0, np.flatnonzero(np.diff(numbers) != 1) + 1, len(numbers)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        total = np.r_[0, np.cumsum(words[a:b])]
        if total[-1] < least:
            continue
        ends = np.searchsorted(total, total[:-1] + least)
        out.update((int(a + s), int(e - s)) for s, e in enumerate(ends) if e <= b - a)
        starts = np.searchsorted(total, total[1:] - least, side="right") - 1
        out.update((int(a + s), e + 1 - int(s)) for e, s in enumerate(starts) if total[e + 1] >= least)
    return out


def _step(depth: int, least: int):
    """From the blocks of `depth` lines of each document to the pairs of ranks of blocks of up to 2 * depth lines.

    in: d, h, blocks: array of (i, rank, later, w, wants, reach). out: pairs to be ranked, and runs of one line, which are ranked already.
    """

    def run(batches):
        for batch in batches:
            rows = batch.column(2)
            starts = np.asarray(rows.offsets) - rows.offsets[0].as_py()
            flat = rows.flatten()
            number = np.asarray(flat.field("i"))
            words = np.asarray(flat.field("w"))
            reach_in = np.asarray(flat.field("reach"))
            wants_in = flat.field("wants").to_pylist() if depth > 1 else None
            rank, is_later = flat.field("rank"), flat.field("later")
            left, right, doc, size, wants, reach, is_run, at = [], [], [], [], [], [], [], []
            for k in range(len(rows)):
                a, b = starts[k], starts[k + 1]
                order = a + np.argsort(number[a:b])
                own = number[order]
                if depth == 1:
                    wanted: dict[int, set[int]] = {}
                    ends = np.zeros(len(own), np.int64)
                    for s, n in _runs(own, words[order], least):
                        wanted.setdefault(s, set()).add(n)
                        ends[s] = max(ends[s], own[s] + n)
                    ends = np.maximum.accumulate(ends)
                else:
                    wanted = {s: set(wants_in[o]) for s, o in enumerate(order) if wants_in[o]}
                    ends = reach_in[order]
                place = {int(i): s for s, i in enumerate(own)}
                for s, i in enumerate(own.tolist()):
                    here = wanted.get(s, ())
                    later = sorted(n for n in here if n > 2 * depth)
                    sizes = {n for n in here if n <= 2 * depth}
                    if depth == 1 and 1 in sizes:
                        sizes.discard(1)
                        left.append(order[s]), right.append(order[s]), doc.append(k), size.append(1), wants.append([]), reach.append(0), is_run.append(True), at.append(i)
                    if i + 2 * depth <= ends[s]:
                        sizes.add(2 * depth)
                    for n in sorted(sizes):
                        other = place.get(i + n - depth)
                        if other is not None:
                            left.append(order[s]), right.append(order[other]), doc.append(k), size.append(n), wants.append(later if n == 2 * depth else [])
                            reach.append(int(ends[s]) if n == 2 * depth and i + n <= ends[s] else 0), is_run.append(n in here), at.append(i)
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(size, pa.int32()), rank.take(pa.array(left, pa.int64())), rank.take(pa.array(right, pa.int64())), is_later.take(pa.array(left, pa.int64())), pa.array(wants, pa.list_(pa.int32())), pa.array(reach, pa.int32()), pa.array(is_run, pa.bool_())],
                ["d", "h", "i", "size", "left", "right", "later", "wants", "reach", "is_run"],
            )

    return run


def ranked_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> Iterator[DataFrame]:
    """The rounds of prefix doubling. Each gives d (the key), h (hash of the text), i (non-blank line), size (lines), rank, later and is_run (just reaches min_words) of the blocks that occur more than once."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    shared_folder(spark)
    kind = docs.schema[key].dataType.simpleString()
    given = ["d", "h", "i", "size", "rank", "later", "is_run"]
    lines = _ranked(_lines(docs, key, text), ["a", "b"], _lines(docs, key, text, count=False))
    state = lines.select("d", "h", "i", "rank", "later", "w", F.array().cast("array<int>").alias("wants"), F.lit(0).alias("reach")).checkpoint()
    depth = 1
    while True:
        whole = state.groupBy("d", "h").agg(F.collect_set(F.struct("i", "rank", "later", "w", "wants", "reach")).alias("blocks"))
        pairs = whole.mapInArrow(_step(depth, min_words), f"d {kind}, h long, i int, size int, left long, right long, later boolean, wants array<int>, reach int, is_run boolean")
        if depth == 1:
            pairs = pairs.checkpoint()
            yield pairs.where("size = 1").withColumnRenamed("left", "rank").select(*given)
        ranked = _ranked(pairs.where("size > 1").drop("later"), ["size", "left", "right"]).checkpoint()
        yield ranked.select(*given)
        depth *= 2
        state = ranked.where((F.col("size") == depth) & (F.col("reach") > 0)).select("d", "h", "i", "rank", "later", F.lit(0).alias("w"), "wants", "reach")
        release(spark)
        if state.isEmpty():
            return


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """d (the key), h (hash of the text), i (non-blank line), size: every later copy of a run that just reaches min_words words."""
    rounds = [blocks.where("is_run AND later").select("d", "h", "i", "size") for blocks in ranked_blocks(docs, key, text, min_words)]
    return functools.reduce(DataFrame.unionAll, rounds)


def _without(text: str, runs: list) -> tuple[str, int]:
    """The text without the non-blank lines in the runs, and how many went."""
    gone = {i + k for i, size in runs for k in range(size)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(" "):
            n += 1
            if n - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept), len(gone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, drop_emptied: bool = False, counts: bool = True) -> DataFrame:
    """docs with later copies of repeated runs deleted from the text; counts: adds n_lines (non-blank, before) and n_deleted (with a _ after the name where docs have such a column)."""
    small_batches(docs.sparkSession)
    names = docs.columns
    hash_, runs_key, runs_hash, found = free_names(names, "hash", "run_key", "run_hash", "runs")
    runs = repeated_runs(docs, key, text, min_words).groupBy("d", "h").agg(F.collect_set(F.struct("i", "size")).alias("r")).toDF(runs_key, runs_hash, found)
    held = docs.withColumn(hash_, F.xxhash64(F.col(f"`{text}`")))
    joined = held.join(runs, F.col(f"`{key}`").eqNullSafe(F.col(runs_key)) & (F.col(hash_) == F.col(runs_hash)), "left").select(*[F.col(f"`{c}`") for c in names], found)
    place = names.index(text)

    def run(batches):
        for batch in batches:
            texts, runs_ = batch.column(place), batch.column(len(names))
            new = texts.to_pylist()
            lines, gone = [], []
            for k, found in enumerate(runs_.to_pylist()):
                body = new[k]
                lines.append(sum(1 for x in body.split("\n") if x.strip(" ")) if body else 0)
                gone.append(0)
                if found:
                    new[k], gone[k] = _without(body, [(r["i"], r["size"]) for r in found])
                    if gone[k] == lines[k]:
                        new[k] = ""
            columns = [pa.array(new, texts.type) if c == place else batch.column(c) for c in range(len(names))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*(f"c{c}" for c in range(len(names))), "n_lines", "n_deleted"])
            if drop_emptied:
                out = out.filter(pa.array([not g or g < n for g, n in zip(gone, lines, strict=True)]))
            yield out if counts else out.select(list(range(len(names))))

    from pyspark.sql.types import LongType, StructField, StructType

    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    extra = [StructField(n, LongType()) for n in ("n_lines", "n_deleted")] if counts else []
    return joined.mapInArrow(run, StructType(fields + extra)).toDF(*names, *free_names(names, *(f.name for f in extra)))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
