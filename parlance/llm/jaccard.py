"""Exact set-similarity join on word shingles with set-relation skipping.

A document's set holds its distinct shingles of five words (`[^\\x20\\x09-\\x0D]+` of the text with A-Z
lower-cased; a shorter text is one shingle). Two documents link when the Jaccard similarity of
their sets reaches 75 %. The result is each document's component under these links and, where it is
asked for (`links`), the number of documents that it links with.

How it stays exact and linear:

1. Documents of equal sets are one class: set relation "same", one answer for all of them.
2. Prefix pass. Shingles are ordered by hash; sets that link share at least k(n) of their first
   n - ceil(.75 n) + k(n) shingles. Tasks send each such shingle once per flush (a part of a task),
   never once per document, and learn how many of each document's are shared. Classes with too few
   shared shingles link with nothing and leave.
3. Of the classes that stay, shingles are counted in full and each set is put in the order rarest
   first. What no other set holds needs no index entry: only shared shingles are kept.
4. Index lists hold (class, size, position) for the first n - ceil(.75 n) + 1 positions. Lists of equal
   members (told by two 64-bit sums) are kept once. In each list all members are compared with one set,
   its pivot: the one whose shared shingles begin earliest, which is the least altered of a group of copies.
   Members that end up in one component are done.
5. Lists with members of several components stay open. Their members stand in blocks of about BLOCK_ROWS,
   of alike sizes and positions; a block tells its range of sizes, the overlap that its positions leave
   possible and whether it is of one component. Some members (FIRST_PIVOTS of a list by hash, in the next
   round GROWTH times as many, and so on until all have had their turn) are compared with the members of those blocks that are
   not skipped by these.
6. Answers are derived from those of the pivot: with |A & P| and |B & P| known, |A & B| is at least
   |A & P| + |B & P| - |P| and at most min(|A & P|, |B & P|) + min(|A - P|, |B - P|). Pairs whose least is enough are
   links, and pairs whose most is too little are none, without a look at the sets. Only those between are
   compared shingle by shingle, each once.
   With `links` components leave nothing out: all members of all lists are compared, but for pairs that the bounds decide.

Defined cases: null and empty texts, and texts without words, have 0 shingles and their own
component. Rows that repeat key and text are one document. A null key is never the smallest id of a
component that has others; alone, its component is null. Keys are integers or strings (the smallest by bytes). Very long texts are read in pieces of bounded memory, and
their sets travel as one value each. An empty table gives an empty result. Columns of docs other than key
and text are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, free_names, lower_ascii, mix, pieces, release, shared_folder, small_batches, span_hashes, spans_where, table, text_buffers

WORDS = 5
#: The threshold as a fraction: links from 75 / 100 on.
UP, DOWN = 75, 100
#: Shingles and documents that a task holds before it sends them.
FLUSH, FLUSH_DOCS = 1_000_000, 60_000
NONE = np.uint16(0xFFFF)
#: Representatives up to which the list of them is broadcast (16 bytes each); beyond, documents are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Members of an open list that are compared with all its others in the first such round, about, and by how much more in each next.
FIRST_PIVOTS, GROWTH = 16, 64
#: Members of a block of an open list, about.
BLOCK_ROWS = 256
#: Links up to which one task joins them to components; beyond, tasks pass labels along links.
ONE_TASK_LINKS = 500_000
#: Sets that a verification task compares with one set, about, before it is split.
SALT_ROWS = 2000


def least_overlap(n):
    """Shingles that a set of n must share with any set that it links with."""
    return -(-UP * n // DOWN)


def wanted(n):
    return np.maximum(1, n // 10)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    raw = lower_ascii(raw)
    starts, ends, first = spans_where((raw != 32) & ((raw < 9) | (raw > 13)), bounds)
    h = span_hashes(raw, starts, ends)
    full = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        full = np.zeros(n, np.uint64)
        for k in range(WORDS):
            full = full * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        else:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.array([(int(whole) * 31 + int(x)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
            out.append(np.array([whole], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, equal for equal sets."""
    a = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0
    b = int(mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64)) if len(s) else 0
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def _marks(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit mark of shingles. Two that share both count as one; that adds work, but loses nothing."""
    return (shingles % np.uint64(buckets)).astype(np.int64), (shingles >> np.uint64(32)).astype(np.uint32)


def _name(s: np.ndarray) -> str:
    """The name of a set's class, as _class_name() gives it."""
    a, b = signature(s)
    return f"{a & MASK:016X}{b & MASK:016X}{len(s):X}"


def _class_name() -> Column:
    return F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0"), F.hex("n"))


def _groups(*keys: np.ndarray):
    """(start, end) of the runs of equal keys."""
    n = len(keys[0])
    if n:
        change = np.zeros(n - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def _by_bucket(shingles: np.ndarray, extra: np.ndarray, buckets: int):
    """(bucket, marks, extra) of each bucket with shingles."""
    own, marks = _marks(shingles, buckets)
    order = np.argsort(own, kind="stable")
    own, marks, extra = own[order], marks[order], extra[order]
    for a, b in _groups(own):
        yield int(own[a]), marks[a:b].tobytes(), extra[a:b].tobytes()


def _flushes(batches, column: int):
    """Lists of (row values without the text, set) that hold about FLUSH shingles."""
    held, size = [], 0
    for batch in batches:
        raw, bounds = text_buffers(batch.column(column))
        keys = [batch.column(k).to_pylist() for k in range(batch.num_columns) if k != column]
        for a, b in pieces(bounds):
            for i, s in enumerate(shingle_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), a):
                held.append((*(k[i] for k in keys), s))
                size += len(s)
            if size >= FLUSH or len(held) >= FLUSH_DOCS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema):
    for k in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096], strict=True), schema, strict=True)], schema=schema)


_KIND = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KIND[k]) for n, k in (x.split() for x in text.split(","))])


def _key(docs: DataFrame, key: str) -> tuple[Column, str]:
    """The key and its type: a string as it is, all else as a long."""
    kind = "string" if docs.schema[key].dataType.simpleString() == "string" else "bigint"
    return F.col(f"`{key}`").cast(kind), kind


def _scan(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Facts of every document (bucket -1) and, by bucket, the shingles of their prefixes."""
    kind = _key(docs, key)[1]
    names = f"flush bigint,bucket int,ordinal int,d {kind},h bigint,n bigint,s1 bigint,s2 bigint,known int,need int,marks binary,ordinals binary"
    schema = _schema(names)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for number, held in enumerate(_flushes(batches, 2)):
            flush = base + number
            prefixes, facts = [], []
            for k, (_, _, s) in enumerate(held):
                n = len(s)
                prefixes.append(s[: n - least_overlap(n) + int(wanted(n))] if n else s)
            sizes = [len(p) for p in prefixes]
            all_, owner = np.concatenate(prefixes), np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            order = np.argsort(all_)
            all_, owner = all_[order], owner[order]
            start = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]]) if len(all_) else np.zeros(0, np.int64)
            times = np.diff(np.r_[start, len(all_)])
            twice = np.repeat(times > 1, times)
            known = np.bincount(owner[twice], minlength=len(held))
            for k, (d, h, s) in enumerate(held):
                need = int(wanted(least_overlap(len(s)))) if len(s) else 0
                facts.append((flush, -1, k, d, h, len(s), *signature(s), int(known[k]), need, None, None))
            yield from _batch(facts, schema)
            mark = np.where(times > 1, NONE, owner[start]) if len(start) else owner[start]
            sent = [(flush, b, None, None, None, None, None, None, None, None, x, y) for b, x, y in _by_bucket(all_[start], mark, buckets)]
            if sent:
                yield from _batch(sent, schema)

    return docs.select(_key(docs, key)[0].alias("d"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, names.replace(",", ", "))


def _gather(batches, wide: str):
    """All marks of a task's buckets with their bucket, what goes with them and the flush of each, in order."""
    keys, extra, flush = [], [], []
    for batch in batches:
        for f, bucket, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            keys.append(np.frombuffer(x, np.uint32).astype(np.int64) | bucket << 32)
            extra.append(np.frombuffer(y, wide))
            flush.append(np.full(len(keys[-1]), f, np.int64))
    if not keys:
        return None
    s, e, f = map(np.concatenate, (keys, extra, flush))
    order = np.argsort(s)
    s, e, f = s[order], e[order], f[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s, e, f, start, np.diff(np.r_[start, len(s)])


def _shared(sent: DataFrame) -> DataFrame:
    """flush, ordinal, more: how many of a document's prefix shingles some other flush holds.

    A task of buckets answers each flush in one row; these rows meet by flush.
    """
    schema = _schema("flush bigint,ordinals binary,counts binary")

    def run(batches):
        got = _gather(batches, "<u2")
        if not got:
            return
        _, ordinal, flush, _, times = got
        hit = np.repeat(times > 1, times) & (ordinal != NONE)
        order = np.lexsort((ordinal[hit], flush[hit]))
        f, o = flush[hit][order], ordinal[hit][order]
        rows = []
        for a, b in _groups(f):
            ordinals, counts = np.unique(o[a:b], return_counts=True)
            rows.append((int(f[a]), ordinals.tobytes(), counts.astype(np.uint32).tobytes()))
        yield from _batch(rows, schema)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ordinals = np.frombuffer(x, np.uint16)
                have = totals.get(f, np.zeros(0, np.int64))
                if len(ordinals) and ordinals[-1] >= len(have):
                    have = np.r_[have, np.zeros(int(ordinals[-1]) + 1 - len(have), np.int64)]
                have[ordinals] += np.frombuffer(y, np.uint32)
                totals[f] = have
        for f, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["flush", "ordinal", "more"])

    told = sent.select("flush", "bucket", "marks", "ordinals").repartition("bucket").mapInArrow(run, "flush bigint, ordinals binary, counts binary")
    return told.repartition("flush").mapInArrow(add, "flush bigint, ordinal int, more bigint")


def _stored(kept: DataFrame) -> DataFrame:
    """flush, class, n, shingles of the classes that stay; the rows of a flush stand together."""
    names = "flush bigint,class string,n bigint,shingles binary"
    schema = _schema(names)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for number, held in enumerate(_flushes(batches, 0)):
            yield from _batch([(base + number, _name(s), len(s), s.tobytes()) for (s,) in held], schema)

    return kept.select("t").mapInArrow(run, names.replace(",", ", "))


def _frequencies(stored: DataFrame, buckets: int) -> DataFrame:
    """flush, keys, counts: for each flush, those of its shingles that two or more classes hold, with the number of classes.

    A task of buckets answers each flush in one row. Counts end at 65,535: beyond, the order is that of the shingles.
    """
    names, answers = "flush bigint,bucket int,marks binary,counts binary", "flush bigint,keys binary,counts binary"
    schema, answer = _schema(names), _schema(answers)

    def send(batches):
        now, sets = None, []

        def parts():
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            # up to 255 are told of one flush: the order of frequent shingles may differ from that of their counts, but is the same for all
            return _batch([(now, b, x, y) for b, x, y in _by_bucket(values, np.minimum(counts, 255).astype(np.uint8), buckets)], schema)

        for batch in batches:
            for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f != now and sets:
                    yield from parts()
                    sets = []
                now = f
                sets.append(np.frombuffer(data, np.uint64))
        if sets:
            yield from parts()

    def run(batches):
        got = _gather(batches, "u1")
        if not got:
            return
        key, count, flush, start, times = got
        total = np.repeat(np.add.reduceat(count.astype(np.int64), start), times)
        hit = total > 1
        order = np.lexsort((key[hit], flush[hit]))
        f, key, total = flush[hit][order], key[hit][order], np.minimum(total[hit][order], 0xFFFF).astype(np.uint16)
        yield from _batch([(int(f[a]), key[a:b].tobytes(), total[a:b].tobytes()) for a, b in _groups(f)], answer)

    sent = stored.select("flush", "shingles").mapInArrow(send, names.replace(",", ", "))
    return sent.repartition("bucket").mapInArrow(run, answers.replace(",", ", "))


def _ordered(stored: DataFrame, frequencies: DataFrame, buckets: int) -> DataFrame:
    """class, n, alone, shared: the shared shingles of each set, rarest first; `alone` others come before them.

    Sets with fewer shared shingles than a link needs are left out.
    """
    schema = _schema("class string,n bigint,alone bigint,shared binary")

    def sets(flush):
        values, counts = (np.concatenate(x) for x in zip(*flush["counts"], strict=True)) if flush["counts"] else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        out = []
        for name, data in flush["sets"]:
            s = np.frombuffer(data, np.uint64)
            bucket, mark = _marks(s, buckets)
            key = bucket << 32 | mark.astype(np.int64)
            at = np.minimum(np.searchsorted(values, key), max(0, len(values) - 1))
            there = values[at] == key if len(values) else np.zeros(len(s), bool)
            mine, often = s[there], counts[at[there]] if len(values) else np.zeros(0, np.uint16)
            if len(mine) and len(mine) >= least_overlap(len(s)):
                out.append((name, len(s), len(s) - len(mine), mine[np.lexsort((mine, often))].tobytes()))
        return out

    def run(batches):
        now, flush = None, {"sets": [], "counts": []}
        for batch in batches:
            for f, name, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != now and now is not None:
                    yield from _batch(sets(flush), schema)
                    flush = {"sets": [], "counts": []}
                now = f
                if name is None:
                    flush["counts"].append((np.frombuffer(x, np.int64), np.frombuffer(y, np.uint16)))
                else:
                    flush["sets"].append((name, x))
        yield from _batch(sets(flush), schema)

    own = stored.select("flush", "class", F.col("shingles").alias("data"), F.lit(None).cast("binary").alias("counts"))
    said = frequencies.select("flush", F.lit(None).cast("string").alias("class"), F.col("keys").alias("data"), "counts")
    return own.unionByName(said).repartition("flush").sortWithinPartitions("flush").mapInArrow(run, "class string, n bigint, alone bigint, shared binary")


def _postings(sets: DataFrame) -> DataFrame:
    """token, class, n, pos: the shared shingles among the first n - ceil(.75 n) + 1 of each set."""
    schema = _schema("token bigint,class string,n bigint,pos bigint")

    def run(batches):
        for batch in batches:
            for name, n, alone, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = n - least_overlap(n) + 1 - alone
                if prefix > 0:
                    tokens = np.frombuffer(data, np.int64)[:prefix]
                    yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array([name] * len(tokens)), pa.array(np.full(len(tokens), n)), pa.array(alone + np.arange(len(tokens)))], schema=schema)

    return sets.select("class", "n", "alone", "shared").mapInArrow(run, "token bigint, class string, n bigint, pos bigint")


def _needed(a: Column, b: Column) -> Column:
    """The least overlap of linked sets of sizes a and b."""
    return F.ceil((a + b) * UP / (UP + DOWN))


def _possible(x: Column, y: Column) -> Column:
    """Whether sizes and positions in a list leave room for a link."""
    n, m = x["n"], y["n"]
    room = F.least(n - x["pos"], m - y["pos"])
    return (n * DOWN >= m * UP) & (m * DOWN >= n * UP) & (room >= _needed(n, m))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, overlap, linked of distinct pairs (x, y); the sets of y travel once for each pair, that of x once for each task part."""
    schema = _schema("x string,y string,overlap bigint,linked boolean")

    def compare(batches):
        name = held = size = None
        for batch in batches:
            out = []
            for x, y, n, data in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "shared")), strict=True):
                if y is None:  # the set of x stands before those it is compared with
                    name, size, held = x, n, np.sort(np.frombuffer(data, np.uint64))
                elif x == name:
                    t = np.frombuffer(data, np.uint64)
                    at = np.minimum(np.searchsorted(held, t), len(held) - 1)
                    both = int((held[at] == t).sum())
                    out.append((x, y, both, DOWN * both >= UP * (size + n - both)))
            yield from _batch(out, schema)

    parts = pairs.groupBy("x").agg(F.count("*").alias("many")).withColumn("parts", F.ceil(F.col("many") / SALT_ROWS).cast("int"))
    salted = pairs.join(parts, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("salt"))
    left = parts.join(sets.withColumnRenamed("class", "x"), "x").select("x", F.lit(None).cast("string").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "n", "shared")
    right = salted.join(sets.withColumnRenamed("class", "y"), "y").select("x", "y", "salt", "n", "shared")
    sides = left.unionByName(right).repartition("x", "salt").sortWithinPartitions("x", "salt", F.asc_nulls_first("y"))
    return sides.mapInArrow(compare, "x string, y string, overlap bigint, linked boolean")


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """class, comp: the smallest class reachable over links (x, y); names are the classes that have links.

    Few links are joined in one task; many by least labels and pointer jumping.
    """
    if links.count() <= ONE_TASK_LINKS:

        def run(batches):
            parent: dict[str, str] = {}

            def root(x: str) -> str:
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = parent[up]
                    x = up
                return x

            for batch in batches:
                for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x, y = root(x), root(y)
                    parent[max(x, y)] = min(x, y)
            found = [(x, root(x)) for x in list(parent)]
            yield from _batch(found, _schema("class string,comp string"))

        return links.select("x", "y").coalesce(1).mapInArrow(run, "class string, comp string")
    both = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionAll(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).checkpoint()
    labels = names.select("class", F.col("class").alias("comp"))
    while True:
        near = both.join(labels.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "class"), "class", "left").select("class", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        jump = step.select(F.col("class").alias("next"), F.col("next").alias("far"))
        after = step.join(jump, "next", "left").select("class", "comp", F.least("next", F.coalesce("far", "next")).alias("new")).checkpoint()
        labels = after.select("class", F.col("new").alias("comp"))
        release(names.sparkSession)
        if after.where("new != comp").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (class, comp) after more links: only the components that they join are looked at."""
    of = lambda c: labels.select(F.col("class").alias(c), F.col("comp").alias(f"c{c}"))
    across = links.join(of("x"), "x").join(of("y"), "y").where("cx != cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct().checkpoint()
    names = across.select(F.col("x").alias("class")).union(across.select(F.col("y").alias("class"))).distinct()
    new = components(across, names).select(F.col("class").alias("comp"), F.col("comp").alias("new"))
    return labels.join(new, "comp", "left").select("class", F.coalesce("new", "comp").alias("comp")).checkpoint()


def _classes(sets: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """class, comp for every class that may link, and the links found, x < y, each once: those that components need, or with `every` all."""
    spark = sets.sparkSession
    listed = _postings(sets)
    # lists of the same members stand for one: that of their first token, which leaves most room for a link
    members = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    pivot = F.min_by(F.struct("class", "n", "pos"), F.struct(F.col("pos") / F.col("n"), "class")).alias("p")
    counted = listed.groupBy("token").agg(F.count("*").alias("many"), *members, pivot).where("many > 1")
    counted = counted.groupBy("many", "m1", "m2").agg(F.min_by(F.struct("token", "p"), F.struct("p.pos", "token")).alias("l")).select("l.token", "l.p")
    lists = listed.join(counted, "token").where("class != p.class").select("token", "class", "n", "pos", "p").checkpoint()
    pairs = lists.select(F.struct("class", "n", "pos").alias("e"), "p").where(_possible(F.col("p"), F.col("e"))).select(F.col("p.class").alias("x"), F.col("e.class").alias("y")).distinct()
    seen = _verify(pairs, sets).checkpoint()
    links = seen.where("linked").select("x", "y")
    labels = _merged(sets.select("class", F.col("class").alias("comp")), links)
    member = lists.select("token", "class", "n", "pos", F.col("p.class").alias("x"), F.col("p.n").alias("pivot_n"))
    # the overlap with the list's pivot (null: not compared) goes with each member; `turn` is when it is compared with the others
    open_ = member.join(seen.select("x", F.col("y").alias("class"), "overlap"), ["x", "class"], "left").drop("x").withColumn("turn", F.pmod(F.xxhash64("class", F.lit(11)), F.lit(TURNS)))
    compared, pivots = seen.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), FIRST_PIVOTS
    while True:
        told = open_.withColumn("comp", F.col("class")) if every else open_.join(labels, "class")
        several = told.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("many")).where("low != high").select("token", "many", "low")
        told = told.join(several, "token").withColumn("first", F.col("comp") == F.col("low")).drop("low").checkpoint()
        release(spark)
        if told.isEmpty():
            return (_merged(labels, links) if every else labels), links
        now = F.col("many") * F.col("turn") < F.lit(pivots * TURNS)
        both = told.where(now).select("token", "pivot_n", _member("a")).join(_blocks(told), "token").where(_block_possible("a"))
        both = both.select("a", "pivot_n", F.explode(F.filter("members", lambda b: _open(F.col("a"), b))).alias("b"))
        pairs = both.select(F.least("a.class", "b.class").alias("x"), F.greatest("a.class", "b.class").alias("y"), (_least() >= _needed(F.col("a.n"), F.col("b.n"))).alias("sure"))
        pairs = pairs.groupBy("x", "y").agg(F.bool_or("sure").alias("sure")).join(compared, ["x", "y"], "left_anti").checkpoint()
        open_ = told.where(~now).drop("comp", "many", "first")
        pivots *= GROWTH
        if not pairs.isEmpty():
            compared = compared.unionAll(pairs.select("x", "y"))
            checked = _verify(pairs.where(~F.col("sure")), sets).where("linked").select("x", "y")
            new = pairs.where("sure").select("x", "y").unionAll(checked)
            new = new.checkpoint() if every else new
            links = links.unionAll(new)
            labels = labels if every else _merged(labels, new)


TURNS = 1 << 31


def _member(name: str) -> Column:
    return F.struct("class", "n", "pos", "comp", "overlap", "turn").alias(name)


def _blocks(open_: DataFrame) -> DataFrame:
    """The members of each open list in blocks of alike sizes and positions, with what decides whether a block is skipped.

    Members of the component with the least name stand in blocks of their own (`first`): as a name is its component's least class, that is
    mostly the largest one, and its members skip its blocks.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DOWN / UP)))
    place = F.floor(8 * F.col("pos") / F.col("n"))
    part = F.pmod(F.xxhash64("class", F.lit(12)), F.ceil(F.col("many") / BLOCK_ROWS))  # however long a list is
    return open_.groupBy("token", "first", size.alias("size"), place.alias("place"), part.alias("part")).agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("pos")).alias("room"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.collect_list(_member("m")).alias("members")
    )


def _block_possible(a: str) -> Column:
    """Whether some member of a block may link with a and is of another component."""
    n = F.col(f"{a}.n")
    fits = (n * DOWN >= F.col("least_n") * UP) & (F.col("most_n") * DOWN >= n * UP) & (F.least(n - F.col(f"{a}.pos"), F.col("room")) >= _needed(n, F.greatest(F.col("least_n"), F.ceil(n * UP / DOWN))))
    return fits & ((F.col("low") != F.col(f"{a}.comp")) | (F.col("high") != F.col(f"{a}.comp")))


def _open(a: Column, b: Column) -> Column:
    """Whether a is to be compared with b, a member of a block: b's turn is not over, so that each pair comes up once, and no bound rules a link out."""
    after = (a["turn"] < b["turn"]) | ((a["turn"] == b["turn"]) & (a["class"] < b["class"]))
    return after & (a["comp"] != b["comp"]) & _possible(a, b) & (_most(a, b) >= _needed(a["n"], b["n"]))


def _most(a: Column, b: Column) -> Column:
    """What a and b share at most: what both share with their list's pivot, and what either has outside it. Unknown: all of the smaller."""
    return F.coalesce(F.least(a["overlap"], b["overlap"]) + F.least(a["n"] - a["overlap"], b["n"] - b["overlap"]), F.least(a["n"], b["n"]))


def _least() -> Column:
    """What a and b share at least: the parts of the pivot that they hold can't lie apart. F.least leaves out nulls, the sum does not."""
    return F.coalesce(F.col("a.overlap") + F.col("b.overlap") - F.col("pivot_n"), F.lit(0))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """d (key), h (hash of the text), n, s1, s2 (signature of the set), component, copies (documents of an equal set) for every row.

    component is the smallest key reachable; see the module's text for nulls. links: adds n_links, the
    number of other rows whose sets link with the row's, those of equal sets included.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared_folder(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = _scan(docs, key, text, buckets).checkpoint()
    release(spark)
    facts = scan.where("bucket = -1").select("flush", "ordinal", "d", "h", "n", "s1", "s2", "known", "need")
    more = _shared(scan.where("bucket >= 0"))
    judged = facts.join(more, ["flush", "ordinal"], "left").withColumn("may", (F.col("n") > 0) & (F.col("known") + F.coalesce("more", F.lit(0)) >= F.col("need")))
    classes = judged.where("n > 0").groupBy("n", "s1", "s2").agg(F.count("*").alias("copies"), F.min("d").alias("least"), F.min(F.struct("d", "h")).alias("rep"), F.bool_or("may").alias("may")).checkpoint()
    release(spark)
    rep = classes.where("may").select(F.col("rep.d").alias("rep_d"), F.col("rep.h").alias("rep_h"))
    held = docs.select(_key(docs, key)[0].alias("d"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if rep.count() <= BROADCAST_ROWS:
        rep = F.broadcast(rep)
    kept = held.join(rep, F.col("d").eqNullSafe(F.col("rep_d")) & (F.col("h") == F.col("rep_h")), "left_semi").dropDuplicates(["d", "h"])
    stored = _stored(kept).checkpoint()
    sets = _ordered(stored, _frequencies(stored, buckets), buckets).checkpoint()
    release(spark)
    labels, linked_classes = _classes(sets, links)
    named = classes.select("n", "s1", "s2", "copies", "least", _class_name().alias("class"))
    linked = named.join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    smallest = linked.groupBy("comp").agg(F.min("least").alias("component"))
    answer = linked.join(smallest, "comp")
    if links:
        both = linked_classes.unionAll(linked_classes.select("y", "x"))
        others = both.join(named.select(F.col("class").alias("y"), "copies"), "y").groupBy(F.col("x").alias("class")).agg(F.sum("copies").alias("others"))
        answer = answer.join(others, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    extra = ["n_links"] if links else []
    answer = answer.select("n", "s1", "s2", "copies", "component", "comp", *extra)
    found = facts.join(answer, ["n", "s1", "s2"], "left")
    return found.select("d", "h", "n", "s1", "s2", "copies", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("d")).alias("component"), "comp", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in extra))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: of its least key (nulls last), then least hash of the text."""
    found = join(docs, key, text)
    group = F.coalesce("comp", F.concat(F.coalesce(F.col("d").cast("string"), F.lit("null")), F.lit("/"), F.col("h").cast("string")))
    rank = F.struct(F.col("d").isNull().alias("no"), "d", "h")
    stay = found.groupBy(group.alias("g")).agg(F.min(rank).alias("k")).select(F.col("k.d").alias("stay_d"), F.col("k.h").alias("stay_h"))
    names = docs.columns
    own, sum_, stay_d, stay_h = free_names(names, "key", "hash", "stay_d", "stay_h")
    held = docs.withColumns({own: _key(docs, key)[0], sum_: F.xxhash64(f"`{text}`")})
    both = held.join(stay.toDF(stay_d, stay_h), F.col(own).eqNullSafe(F.col(stay_d)) & (F.col(sum_) == F.col(stay_h)), "left_semi")
    return both.dropDuplicates([own, sum_]).select(*[F.col(f"`{c}`") for c in names])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"))
    return found.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("n_equal_sets"))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_jaccard's columns, which its SQL fixes, and n_links, the number of other documents that each links with."""
    found = join(table(spark, sf_dir, "documents"), links=True)
    return found.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("n_equal_sets"), "n_links")
