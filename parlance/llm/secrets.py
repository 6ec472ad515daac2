"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as DataFrame expressions. Three base kinds are found by pattern (leftmost, not
overlapping within a kind). The method adds spans of kind `markov`: runs of LEAST_RUN or more
characters of the secret alphabet, without what base spans cover, which a first-order character model of
random strings explains better than one of ordinary identifiers, by `margin` nats or more. Short runs
seldom reach the margin; what of a run lies outside a base span is scored by itself.

Both models are learned from labelled strings (`labelled_strings` draws them from a sample
of documents: what the base patterns find counts as random, long words as ordinary). Null and
empty texts have no spans. Each row is scanned on its own, so repeated rows repeat their result. Very long
texts, runs and lists of matches take time in proportion to their length. An empty table gives an empty
result. Only the key and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As these kinds take whole runs, asking for the least length in the pattern drops the same matches as asking later.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
LEAST_RUN = 12
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{LEAST_RUN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
WIDE = len(ALPHABET) + 1
#: Covered characters are written as private ones, SHIFT code points higher, so that each pattern can still see what it needs.
SHIFT = 0x10F000
#: Matches that are joined at once into a list of spans.
PART = 500
#: About this many documents give the labelled strings; only counts of character pairs leave the tasks.
SAMPLE_DOCS = 4000
MARGIN = 8.0
BACK_OFF = 20.0


EMPTY = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once. An expression that stands in a lambda is else worked out at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def private(letters: str) -> str:
    return "".join(chr(SHIFT + ord(c)) for c in letters)


_LETTERS = "".join(map(chr, range(33, 127)))


def _wide(pattern: str) -> str:
    """ACCESS and HEX over plain and covered characters alike."""
    both = lambda a, b: f"{a}-{b}\\x{{{SHIFT + ord(a):X}}}-\\x{{{SHIFT + ord(b):X}}}"
    if pattern == HEX:
        return f"[{both('0', '9')}{both('a', 'f')}]{{24,}}"
    return "".join(f"[{c}\\x{{{SHIFT + ord(c):X}}}]" for c in "AKIA") + f"[{both('A', 'Z')}{both('0', '9')}]{{16,}}"


def located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """struct<spans, rest> of a pattern's matches: array<struct<start, kind, end>> in code points, and the text with the matches covered.

    The lengths of the matches and of what lies between them, added up, give the places. Spans are joined PART at
    a time, so that a text of very many matches is no slower a match. keep says of a match whether it counts.
    """

    def one(between: Column, found: Column):
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(between, i))
            end = start + F.char_length(F.get(found, i))
            own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            if keep is not None:
                own = F.when(keep(F.get(found, i)), own).otherwise(F.array().cast(EMPTY))
            return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

        def part(acc: Column, k: Column) -> Column:
            end = F.least(k + PART, F.size(found)) - 1
            inner = F.aggregate(F.sequence(k, end), F.struct(acc["at"].alias("at"), F.array().cast(EMPTY).alias("spans")), add)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], x["spans"]).alias("spans")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(PART)), start, part, lambda acc: acc["spans"])

    def covered(between: Column, found: Column) -> Column:
        hide = lambda m: F.translate(m, _LETTERS, private(_LETTERS))
        shown = hide if keep is None else lambda m: F.when(keep(m), hide(m)).otherwise(m)
        return F.array_join(F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(shown(m), F.lit("")))), "")

    none = F.struct(F.array().cast(EMPTY).alias("spans"), text.alias("rest"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = lambda m: let(F.split(text, pattern, -1), lambda b: F.struct(one(b, m).alias("spans"), covered(b, m).alias("rest")))
    return let(found, lambda m: F.when(F.size(m) > 0, both(m)).otherwise(none))


def _long_enough(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 1)) >= LEAST_VALUE


@dataclass(frozen=True)
class CharacterModels:
    """Log-likelihood ratio of each pair of characters (random against ordinary), by first * WIDE + second."""

    ratio: tuple[float, ...]
    margin: float = MARGIN

    def score(self, text: Column) -> Column:
        """Nats by which the model of random strings explains a string better."""
        weights = F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratio)), ",").cast("array<double>")

        def total(codes: Column) -> Column:
            pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(weights, a * WIDE + b + 1))
            return F.when(F.size(codes) > 1, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))

        return let(_codes(text), total)


#: The class of each character up to `~`, 1 to WIDE - 1 for those of the alphabet; 0 is the class of all others.
_PLACES = [ALPHABET.find(chr(c)) + 1 for c in range(128)]


def _codes(text: Column) -> Column:
    """The classes of a string's characters."""
    table_ = F.split(F.lit(",".join(map(str, _PLACES))), ",").cast("array<int>")
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.get(table_, F.ascii(c)), F.lit(0)))


def pair_counts(strings: DataFrame) -> DataFrame:
    """label, pair, n of a table (value, label); characters outside the alphabet share one class."""
    told = strings.where(F.char_length("value") > 1).select("label", _codes(F.col("value")).alias("c"))
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * WIDE + b)
    return told.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def fit(strings: DataFrame, margin: float = MARGIN) -> CharacterModels:
    """Both models from labelled strings (value, label: 1 random, 0 ordinary).

    A pair's probability after its first character leans on that of its second character alone, with the
    weight of BACK_OFF observations.

    Only 2 * WIDE ** 2 counts reach the driver. Without strings every ratio is 0 and nothing is added.
    """
    import math

    counts = [[0.0] * (WIDE * WIDE) for _ in range(2)]
    for label, pair, n in pair_counts(strings).collect():
        counts[int(label)][pair] += n
    logs = []
    for own in counts:
        total = sum(own)
        single = [(sum(own[b::WIDE]) + 1) / (total + WIDE) for b in range(WIDE)]
        rows = [own[a * WIDE : (a + 1) * WIDE] for a in range(WIDE)]
        logs.append([math.log((n + BACK_OFF * single[b]) / (sum(row) + BACK_OFF)) for row in rows for b, n in enumerate(row)])
    ratio = [r - o for o, r in zip(*logs, strict=True)]
    return CharacterModels(tuple(ratio), margin)


def labelled_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """value, label from about `sample` documents picked by the hash of their key and text; rows that repeat are all picked or none."""
    share = min(1.0, sample / max(1, docs.count()))
    whole = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    some = whole.where(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 20)) < int(share * (1 << 20))).select("t")
    values = lambda pattern, group: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    random = F.concat(F.filter(values(ASSIGN, 1), lambda v: F.char_length(v) >= LEAST_VALUE), values(ACCESS, 0), values(HEX, 0))
    ordinary = values(r"(?<![A-Za-z0-9+/=_-])([A-Za-z_]{8,})(?![A-Za-z0-9+/=_-])", 1)
    return some.select(F.explode(random).alias("value"), F.lit(1).alias("label")).unionAll(some.select(F.explode(ordinary).alias("value"), F.lit(0).alias("label")))


def scan(docs: DataFrame, models: CharacterModels, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans and n_markov for every row.

    The kinds are found one after the other, each in the text in which those before are covered; as covered
    characters keep their identity for the patterns that can share them, all kinds find what they find in the plain text.
    """
    found = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    for name, pattern, keep in (("assign", ASSIGN, _long_enough), ("access", _wide(ACCESS), None), ("hex", _wide(HEX), None)):
        found = found.withColumn("x", located(F.col("t"), pattern, KINDS.index(name), keep)).select("key", *[c for c in found.columns if c in KINDS], F.col("x.spans").alias(name), F.col("x.rest").alias("t"))
    maybe = F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))
    random = lambda places: let(maybe, lambda m: F.filter(F.zip_with(places, m, lambda s, v: F.when(models.score(v) >= models.margin, s)), lambda s: s.isNotNull()))
    added = found.withColumn("maybe", located(F.col("t"), CANDIDATE, 3)["spans"]).withColumn("markov", random(F.col("maybe"))).withColumn("base", F.concat("assign", "access", "hex"))
    kinds = F.array(*map(F.lit, KINDS))
    named = lambda found: F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return added.select(
        F.col("key").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.concat("base", "markov")).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(labelled_strings(docs)))
