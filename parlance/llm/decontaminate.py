"""Benchmark decontamination with suffix arrays over the training words.

Documents are indexed in shards: the words of a few megabytes of text, with a separator after each
document, get a suffix array by prefix doubling in numpy. Every suffix of a benchmark item that
begins a window (10 words; a shorter item is one window) is binary-searched in each shard, which
gives its occurrences; windows that follow each other in a document and in an item join into the
longest verbatim matches. Suffixes are ordered to a depth of 16 words, beyond which no search looks.

Benchmark texts reach the tasks in a block of at most BLOCK_WORDS words (or one longer item): a bounded broadcast.
A shard's suffix array is built once for it, and nothing is shuffled. A larger benchmark takes a pass for each
block; the driver holds one block at a time, and the documents with their hits so far are written in between.

Null and empty texts have no words and are clean. A null item_id counts as the id `null`; items
without words are in nothing. Rows repeat their result. Each row is judged by itself; very long texts
are shards of their own. Empty tables give an empty result, or nothing but clean documents. Columns of docs
keep their names; the columns added get a _ after theirs where docs have such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, lower_ascii, pieces, shared_folder, small_batches, span_hashes, spans_where, table, text_buffers

WINDOW = 10
BLOCK_WORDS = 500_000
DEPTH = 16
#: Matches (place in a document, offset in an item) that are held at once when runs are measured; longer lists go in parts.
HELD = 1_000_000


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lower-cased texts, and each row's first word (n + 1)."""
    raw = lower_ascii(raw)
    starts, ends, first = spans_where((raw >= 97) & (raw <= 122) | (raw >= 48) & (raw <= 57) | (raw >= 128), bounds)
    return span_hashes(raw, starts, ends), first


def suffix_array(h: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` words, each place's word number, the words by number).

    Words are ordered by hash. Doubling goes on only with suffixes that still tie with another.
    """
    n = len(h)
    order = np.argsort(h)
    ordered = h[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    vocabulary = ordered[new]
    start = np.flatnonzero(new)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    rank = np.zeros(n + depth, np.int64)  # place of the first suffix that ties, + 1; 0 after the end
    rank[:n] = start[number] + 1
    step = 1
    while step < depth and n:
        sizes = np.diff(np.r_[start, n])
        tied = np.repeat(sizes > 1, sizes)
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        members = order[slots]
        key = rank[members] << 32 | rank[members + step]
        sort = np.argsort(key)
        members, key = members[sort], key[sort]
        order[slots] = members
        change = np.r_[True, key[1:] != key[:-1]]
        lead = slots[change]
        rank[members] = lead[np.cumsum(change) - 1] + 1
        start = np.union1d(start, lead) if len(lead) < len(start) // 4 else np.unique(np.r_[start, lead])
        step *= 2
    return order, number, vocabulary


class Block:
    """Benchmark items with their windows: unique word sequences, and the texts and offsets of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        items = sorted(set(items))
        raw, bounds = text_buffers(pa.array([t for _, t in items], pa.string()))
        h, first = words(raw, bounds)
        self.names = [n for n, _ in items]
        size = np.minimum(np.diff(first), window)
        many = np.where(size > 0, np.diff(first) - size + 1, 0)
        text = np.repeat(np.arange(len(items)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.zeros((len(text), window + 1), np.uint64)  # the window's words and, last, their number
        rows[:, window] = size[text]
        for j in range(window):
            own = np.flatnonzero(j < size[text])
            rows[own, j] = h[first[text[own]] + k[own] + j]
        _, lead, which = np.unique(rows.view(np.dtype((np.void, 8 * (window + 1)))).ravel(), return_index=True, return_inverse=True)
        self.words, self.size = rows[lead, :window], rows[lead, window].astype(np.int64)
        order = np.argsort(which, kind="stable")
        self.uses = np.stack([which[order], text[order], k[order]], 1).astype(np.int64)
        self.first_use = np.searchsorted(self.uses[:, 0], np.arange(len(lead) + 1))
        self.size_of = np.minimum(np.diff(first), window)  # of each text

    def search(self, order: np.ndarray, number: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the shard and window of every occurrence, by binary search for each window's bounds."""
        n, width = len(order), self.words.shape[1]
        none = np.zeros(0, np.int64)
        if not n or not len(self.size):
            return none, none
        here = np.arange(len(self.size))
        for j in range(width):  # windows all of whose words are in the shard
            at = np.minimum(np.searchsorted(vocabulary, self.words[here, j]), len(vocabulary) - 1)
            here = here[(vocabulary[at] == self.words[here, j]) | (j >= self.size[here])]
            if not len(here):
                return none, none
        want, size = np.searchsorted(vocabulary, self.words[here]), self.size[here]
        padded = np.r_[number, np.full(width, -1)]

        def bound(past: bool) -> np.ndarray:
            low, high = np.zeros(len(here), np.int64), np.full(len(here), n, np.int64)
            while (open_ := low < high).any():
                middle = (low + high) >> 1
                suffix = order[np.minimum(middle, n - 1)]
                state = np.zeros(len(here), np.int8)  # of the suffix against the window
                for k in range(width):
                    word = padded[suffix + k]
                    undecided = (state == 0) & (k < size)
                    state[undecided & (word < want[:, k])] = -1
                    state[undecided & (word > want[:, k])] = 1
                right = (state < 0) | (past & (state == 0))
                low = np.where(open_ & right, middle + 1, low)
                high = np.where(open_ & ~right, middle, high)
            return low

        low, high = bound(False), bound(True)
        counts = high - low
        window = np.repeat(here, counts)
        slots = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return order[slots], window


def longest(block: Block, local: np.ndarray, window: np.ndarray) -> tuple[int, int, str, int]:
    """The longest of the runs of windows, each one word further in a document and in an item; places are in order.

    Equal lengths go by item, diagonal and start. Matches are looked at HELD at a time, whole places together;
    runs that reach a part's last place go on in the next.
    """
    times = block.first_use[window + 1] - block.first_use[window]
    total = np.r_[0, np.cumsum(times)]
    lead = np.flatnonzero(np.r_[True, local[1:] != local[:-1]])
    best, low, last = None, 0, -2
    open_, open_size, open_start = (np.zeros(0, np.int64) for _ in range(3))
    while low < len(local):
        cut = int(np.searchsorted(lead, np.searchsorted(total, total[low] + HELD, side="right") - 1, side="right")) - 1
        high = int(lead[cut]) if lead[cut] > low else int(np.r_[lead, len(local)][np.searchsorted(lead, low) + 1])
        if total[-1] - total[low] <= HELD:
            high = len(local)
        many = times[low:high]
        uses = block.uses[np.repeat(block.first_use[window[low:high]] - total[low:high] + total[low], many) + np.arange(many.sum())]
        place = np.repeat(local[low:high], many)
        run = uses[:, 1] << 40 | (place - uses[:, 2] + (1 << 39))  # text and diagonal
        order = np.lexsort((place, run))
        run, place = run[order], place[order]
        begin = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)])
        size, run, start, end = np.diff(np.r_[begin, len(place)]), run[begin], place[begin], place[np.r_[begin[1:], len(place)] - 1]
        if len(open_):
            at = np.minimum(np.searchsorted(open_, run), len(open_) - 1)
            on = (open_[at] == run) & (start == last + 1)
            size = size + np.where(on, open_size[at], 0)
            start = np.where(on, open_start[at], start)
        text = run >> 40
        words_ = size - 1 + block.size_of[text]
        for k in np.flatnonzero(words_ == words_.max()).tolist():
            diagonal = int(run[k] & (1 << 40) - 1) - (1 << 39)
            mine = (-int(words_[k]), block.names[int(text[k])], diagonal, int(start[k]))
            best = mine if best is None else min(best, mine)
        last, low = int(local[high - 1]), high
        goes = end == last
        open_, open_size, open_start = run[goes], size[goes], start[goes]
    return -best[0], best[3], best[1], best[3] - best[2]


def find(block: Block, raw: np.ndarray, bounds: np.ndarray) -> dict[int, dict]:
    """By row with an occurrence: hit word ranges (joined, not touching), items and the longest match.

    The longest match is (words, first word in the document, item, first word in the item).
    """
    h, first = words(raw, bounds)
    n = len(first) - 1
    apart = np.uint64(0)  # a separator after each row; no word's hash is looked up as 0
    spread = np.full(len(h) + n, apart, np.uint64)
    row = np.repeat(np.arange(n), np.diff(first))
    spread[np.arange(len(h)) + row] = h
    order, number, vocabulary = suffix_array(spread)
    at, window = block.search(order, number, vocabulary)
    out: dict[int, dict] = {}
    if not len(at):
        return out
    begin = first[:-1] + np.arange(n)
    rows = np.searchsorted(begin, at, side="right") - 1
    size = block.size[window]
    sort = np.lexsort((at, rows))
    at, window, rows, size = at[sort], window[sort], rows[sort], size[sort]
    cuts = np.r_[np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), len(rows)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r = int(rows[a])
        local, ends, w = at[a:b] - begin[r], at[a:b] - begin[r] + size[a:b], window[a:b]
        reach = np.maximum.accumulate(ends)
        new = np.flatnonzero(np.r_[True, local[1:] > reach[:-1]])
        out[r] = {
            "ranges": list(zip(local[new].tolist(), np.r_[reach[new[1:] - 1], reach[-1]].tolist(), strict=True)),
            "items": sorted({block.names[i] for x in np.unique(w).tolist() for i in np.unique(block.uses[block.first_use[x] : block.first_use[x + 1], 1]).tolist()}),
            "longest": longest(block, local, w),
        }
    return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", words_each: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark's items, streamed to the driver and held a block at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
    held: list[tuple[str, str]] = []
    size = 0
    for name, body in rows.toLocalIterator():
        n = int(words(*text_buffers(pa.array([body])))[1][-1])
        if held and size + n > words_each:
            yield Block(held)
            held, size = [], 0
        held.append((name, body))
        size += n
    if held:
        yield Block(held)


_STATE = "ranges array<array<bigint>>, items array<string>, longest struct<words:bigint,start:bigint,item:string,item_start:bigint>, n_words bigint"
_KINDS = [pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]), pa.int64()]
_PUT = ["hit_ranges_", "hit_items_", "hit_longest_", "hit_words_"]


def _join(a: dict | None, b: dict | None) -> dict | None:
    """Hits of two blocks in one document."""
    if not a or not b:
        return a or b
    ranges: list[list[int]] = []
    for start, end in sorted([*map(tuple, a["ranges"]), *b["ranges"]]):
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([start, end])
    return {"ranges": ranges, "items": sorted({*a["items"], *b["items"]}), "longest": min(a["longest"], b["longest"], key=lambda x: (-x[0], x[2], x[1] - x[3], x[1]))}


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, clean_only: bool = False, item: str = "item_id", item_text: str = "text", words_each: int = BLOCK_WORDS) -> DataFrame:
    """`carry` columns of every row with hit_ranges_, hit_items_, hit_longest_ and hit_words_ (all words of the text).

    clean_only: only rows without hits, and only their carried columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = docs.columns if carry is None else carry
    found = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(f"`{text}`").alias("text"))
    passes = blocks(benchmark, item, item_text, words_each)
    found = _pass(found, next(passes, Block([])), len(carry), clean_only)
    for block in passes:
        shared_folder(spark)
        found = _pass(found.checkpoint(), block, len(carry), clean_only)
    return found.drop("text").toDF(*carry, *([] if clean_only else free_names(carry, *_PUT)))


def _pass(docs: DataFrame, block: Block, carried: int, clean_only: bool) -> DataFrame:
    """Searches a block in `carried` columns, the text and, after an earlier pass, what that found."""
    again = len(docs.columns) > carried + 1

    def run(batches):
        for batch in batches:
            raw, bounds = text_buffers(batch.column(carried))
            for a, b in pieces(bounds):
                part, at = raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                found = find(block, part, at)
                kept = batch.slice(a, b - a)
                if clean_only:
                    yield kept.filter(pa.array([i not in found for i in range(b - a)]))
                    continue
                counts = np.diff(words(part, at)[1])
                states = [found.get(i) for i in range(b - a)]
                if again:
                    old = zip(*(kept.column(carried + 1 + k).to_pylist() for k in range(3)), strict=True)
                    states = [_join({"ranges": r, "items": i, "longest": tuple(m.values())} if r else None, s) for (r, i, m), s in zip(old, states, strict=True)]
                longest = [s and dict(zip(("words", "start", "item", "item_start"), s["longest"], strict=True)) for s in states]
                values = ([s["ranges"] if s else [] for s in states], [s["items"] if s else [] for s in states], longest, counts.tolist())
                yield pa.RecordBatch.from_arrays([*kept.columns[: carried + 1], *(pa.array([list(map(list, x)) for x in v] if k == 0 else v, kind) for k, (v, kind) in enumerate(zip(values, _KINDS, strict=True)))], [*kept.schema.names[: carried + 1], *_PUT])

    from pyspark.sql.types import StructType

    base = StructType(docs.schema.fields[: carried + 1])
    schema = base if clean_only else StructType([*base.fields, *(f for f in _parsed().fields)])
    return docs.mapInArrow(run, schema)


def _parsed():
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(_STATE)
    for field, name in zip(kind.fields, _PUT, strict=True):
        field.name = name
    kind.names = list(_PUT)
    return kind


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and the longest match (0 words, -1 and the empty text for none) for every row."""
    found = hits(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")), benchmark, carry=["k"])
    n_hit = F.aggregate("hit_ranges_", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select(
        F.col("k").alias(key),
        F.col("hit_words_").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit_items_").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items_"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("hit_longest_.words", F.lit(0)).alias("longest_words"),
        F.coalesce("hit_longest_.start", F.lit(-1)).alias("longest_start"),
        F.coalesce("hit_longest_.item", F.lit("")).alias("longest_item"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
