"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest
fitting rule wins (of equally long ones the first in text order). Where no rule fits, trees decide:
they are trained on labelled URLs (in the query: a bounded sample of those that rules judge) from
length, depth, digit ratio, entropy, parameter counts and statistics of the host's suffix.
Features are worked out for whole batches at once. Suffix statistics are counted over all labelled URLs,
by hash in SUFFIXES buckets, so that they take the same room however many suffixes there are.

Null URLs and those without `://` have an empty host and path, fit no rule and are judged by the
trees (null as an empty string). With no training rows, or one label only, that label's share is the score.
Very long URLs count like others; repeated rows repeat their result, and an empty table gives an empty one.
Only the key and the URL are read, whatever other columns there are.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lower_ascii, pieces, small_batches, span_hashes, spans_where, table, text_buffers

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Most labelled URLs that train the trees.
SAMPLE_URLS = 20_000
SUFFIXES = 1 << 16
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "longest_token", "has_fragment", "is_https", "suffix_rate", "suffix_count")


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides (null if none) and its verdict."""
    name, verdict = F, F
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host_ == site) | host_.endswith("." + site)) & path_.startswith(slash + rest)
        name, verdict = name.when(fits, F.lit(text)), verdict.when(fits, F.lit(said))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def lexical(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All features but the statistics of the suffix, a row for each URL, and the bucket of the suffix. Lengths are in bytes."""
    raw, bounds = text_buffers(urls)
    parts = [_lexical(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in pieces(bounds)]
    return (np.concatenate([x for x, _ in parts]), np.concatenate([s for _, s in parts])) if parts else (np.zeros((0, len(FEATURES) - 2)), np.zeros(0, np.int64))


def _lexical(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, n = bounds[:-1], bounds[1:], len(bounds) - 1
    is_ = lambda letters: np.isin(raw, np.frombuffer(letters, np.uint8))

    def first(marks: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The first of the marked places from `low` on within each row, or the row's end."""
        at = np.r_[np.flatnonzero(marks), len(raw)]
        return np.minimum(at[np.searchsorted(at, low).clip(max=len(at) - 1)], end)

    def count(marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(marks)]
        return total[np.maximum(low, high)] - total[low]

    scheme = np.zeros(len(raw), bool)
    if len(raw) > 2:
        scheme[:-2] = (raw[:-2] == 58) & (raw[1:-1] == 47) & (raw[2:] == 47)
    site = first(scheme, start)
    site = np.where(site + 3 <= end, site + 3, end)
    way = first(is_(b"/?#"), site)
    way_end = first(is_(b"?#"), way)
    query = np.where((way_end < end) & (np.r_[raw, 0][way_end] == 63), way_end + 1, end)
    query_end = first(is_(b"#"), query)
    begins = raw != 38  # of a parameter: what follows an & or the ?
    begins[1:] &= is_(b"&?")[:-1]
    size = end - start
    row = np.repeat(np.arange(n), size)
    seen = np.bincount(row * 256 + raw, minlength=256 * n).reshape(n, 256)
    entropy = np.log2(np.maximum(size, 1)) - (seen * np.log2(np.maximum(seen, 1))).sum(1) / np.maximum(size, 1)
    token, token_end, own = spans_where((raw >= 48) & (raw <= 57) | (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122) | (raw >= 128), bounds)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(n), np.diff(own)), token_end - token)
    https = np.ones(n, bool)
    for k, c in enumerate(b"https"):
        https &= np.r_[raw, np.zeros(5, np.uint8)][start + k] == c
    everything = [
        size, way - site, way_end - way, count(raw == 47, way, way_end), count(raw == 46, site, way) + 1, count((raw >= 48) & (raw <= 57), start, end) / np.maximum(size, 1),
        entropy, np.where(query < query_end, count(begins, np.minimum(query, len(raw)), query_end), 0), count(raw == 45, start, end), longest, first(raw == 35, start) < end, https & (size >= 5),
    ]
    dots = np.flatnonzero(raw == 46)
    before = np.searchsorted(dots, way)
    two = before - np.searchsorted(dots, site) >= 2
    suffix = np.where(two, np.r_[dots, 0, 0][np.maximum(before - 2, 0)] + 1, site)
    bucket = np.zeros(n, np.int64)
    some = np.flatnonzero(suffix < way)
    bucket[some] = (span_hashes(lower_ascii(raw), suffix[some], way[some]) >> np.uint64(48)).astype(np.int64)
    return np.stack([np.asarray(x, float) for x in everything], 1).reshape(n, len(FEATURES) - 2), bucket


class BoostedTrees:
    """Logistic boosting of small regression trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.prior = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        share = (y.sum() + 1e-3) / (len(y) + 2e-3)
        self.prior = math.log(share / (1 - share))
        if not 0 < y.sum() < len(y):
            return self
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, raw = self._binned(x), np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += self.rate * self._walk(tree, b)
        return self

    def _tree(self, b: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> list[tuple]:
        """Nodes (feature, bin, left, right, value); feature -1 marks a leaf."""
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            total, mass = gradient[rows].sum(), weight[rows].sum() + 1.0
            nodes.append((-1, 0, 0, 0, total / mass))
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]) if depth and len(rows) >= 2 * self.least else ():
                size = len(self.cuts[j]) + 1
                g, w, n = (np.cumsum(np.bincount(b[rows, j], v, size))[:-1] for v in (gradient[rows], weight[rows], None))
                gain = g**2 / (w + 1) + (total - g) ** 2 / (mass - w) - total**2 / mass
                gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                left = b[rows, best[1]] <= best[2]
                nodes[at] = (best[1], best[2], grow(rows[left], depth - 1), grow(rows[~left], depth - 1), 0.0)
            return at

        grow(np.arange(len(b)), self.depth)
        return nodes

    def _walk(self, tree: list[tuple], b: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = map(np.array, zip(*tree, strict=True))
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            down = feature[at] >= 0
            go = np.where(b[np.arange(len(b)), np.maximum(feature[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(down, go, at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        if self.trees and len(x):
            b = self._binned(x)
            raw += self.rate * sum(self._walk(t, b) for t in self.trees)
        return 1 / (1 + np.exp(-raw))


class UrlModel:
    """Trees and the suffix statistics they use. Labels: 1 block, 0 allow."""

    def fit(self, urls: list[str], labels: list[int]) -> "UrlModel":
        x, bucket = lexical(pa.array(urls, pa.string()))
        y = np.array(labels, np.int64)
        return self.learn(x, bucket, y, np.bincount(bucket, minlength=SUFFIXES), np.bincount(bucket, y, SUFFIXES))

    def learn(self, x: np.ndarray, bucket: np.ndarray, labels: np.ndarray, seen: np.ndarray, bad: np.ndarray) -> "UrlModel":
        """seen, bad: labelled URLs of each suffix bucket and those to block among them; the rows to learn from are some of these."""
        self.seen, self.bad = seen.astype(float), bad.astype(float)
        self.share = (self.bad.sum() + 1) / (self.seen.sum() + 2)
        self.trees = BoostedTrees().fit(self._features(x, bucket, labels), labels.astype(float))
        return self

    def _features(self, x: np.ndarray, bucket: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        n, bad = self.seen[bucket], self.bad[bucket]
        if own is not None:  # a row's own label is no evidence about itself
            n, bad = n - 1, bad - own
        return np.c_[x, (bad + 5 * self.share) / (n + 5), np.log1p(n)]

    def score(self, urls) -> np.ndarray:
        return self.trees.score(self._features(*lexical(pa.array(urls, pa.string(), from_pandas=True))))


def fit(pages: DataFrame, url: str = "url", rules=RULES, sample: int = SAMPLE_URLS) -> UrlModel:
    """From the URLs that a rule judges: suffix statistics of all of them, trees from at most `sample`, picked by hash. The driver gets numbers only."""
    small_batches(pages.sparkSession, 4096)
    known = pages.select(F.col(f"`{url}`").alias("u"), rule(host(F.col(f"`{url}`")), path(F.col(f"`{url}`")), rules)[1].alias("v")).where("v is not null")

    def measure(batches):
        for batch in batches:
            x, bucket = lexical(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64())), pa.array(bucket)], ["label", "h", "x", "bucket"])

    rows = known.select("u", (F.col("v") == "block").cast("int").alias("label"), F.xxhash64("u").alias("h")).mapInArrow(measure, "label int, h bigint, x array<double>, bucket bigint")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).collect()  # at most SUFFIXES rows
    seen, bad = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts:
        seen[r.bucket], bad[r.bucket] = r.n, r.bad
    some = bounded_sample(rows, "h", sample).collect()
    x = np.array([r.x for r in some]).reshape(-1, len(FEATURES) - 2)
    return UrlModel().learn(x, np.array([r.bucket for r in some], np.int64), np.array([r.label for r in some], np.int64), seen, bad)


def judge(pages: DataFrame, model: UrlModel, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and block_score (the trees' probability of block) for every row."""
    import pandas as pd

    small_batches(pages.sparkSession, 4096)

    @F.pandas_udf("double")
    def block_score(urls: pd.Series) -> pd.Series:
        return pd.Series(model.score(urls))

    parts = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("u")).withColumns({"host": host(F.col("u")), "path": path(F.col("u"))})
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": name, "said": verdict, "block_score": block_score(F.col("u"))})
    trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", trees).alias("verdict"), "block_score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit(pages))
