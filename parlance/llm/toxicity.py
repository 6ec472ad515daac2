"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer (a byte trie run over all words side by side) maps words to symbols: insults and
threats with weights, and fixed lists of targets, copulas, negations and verbs of reported speech. Five
transducers read the symbols of a clause and mark each insult or threat: negated, reported, after a target, after
a copula (these four are composed into one machine, which reads forwards) and before a target (which
reads backwards). The marks of both name the path that accepts it:

- directed: an insult with a target before or after it ("you are such an idiot", "idiots, all of you")
- predicate: an insult said of something that is no target ("this plan is stupid")
- bare: an insult without either
- threat: a threat with its target after it ("kill you"); without one ("kill time") nothing accepts it

A path's weight scales the word's; negated and reported paths count a fraction only (FACTORS). A clause scores the
sum of what is accepted in it, and 0 if nothing is. Sums by path, the number of scoring clauses and of words make
a document's features, and logistic regression turns them into a score from 0 to 1.

Weights of stems (all learned ones count as insults) and of paths and the regression are learned from a bounded,
stratified sample of labelled documents. Null and empty texts have no clauses and get the score of a text without
words. Repeated rows get equal scores; a key with several texts trains with the least of them. Very long texts are
read whole, in pieces. Without labelled rows of both kinds only the fixed lists count. An empty table gives an empty
result. Only the key and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_texts, pieces, sample_labels, small_batches, spans_where, table, text_buffers

SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA = range(7)
#: Word lists of the grammar, for the four languages.
WORDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown dumb fool imbecile arschloch dummkopf abschaum connard idiote imbécile ordure basura estúpido imbécil",
    THREAT: "kill hurt destroy beat punch stab shoot burn töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours u he she they them him her his their du dich dir dein ihr sie er tu toi vous votre il elle ils eux usted ustedes te tú tus ellos ella él",
    NEGATION: "not no never neither nor isn aren wasn don doesn nicht kein keine nie niemals pas jamais aucun aucune nunca jamás tampoco",
    REPORT: "said says say wrote writes claimed claims called quoted reported sagte schrieb behauptete nannte dit disait écrit affirme dijo escribió afirmó llamó",
    COPULA: "is are am was were be been being such ist sind bist seid war warst est suis sommes êtes sont était eres soy somos son era",
}
FIXED_WEIGHT = 4.0
#: Labelled rows that train the model, at most, of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
#: Stems kept, at most; letters in a stem.
STEMS, SHORTEST, LONGEST = 1500, 3, 9
#: Log rate ratio, number and share of the toxic sample documents that a stem needs: rarer ones are mostly chance, or copies of one text.
LEAST_RATIO, LEAST_DOCS, LEAST_SHARE = 3.0, 5, 0.02
#: A stem gives way to one a letter longer that has this share of its toxic occurrences, up to a whole word.
LONGER = 0.9
#: Words that a negation, a target, a copula and (backwards) a target reach.
SCOPE_NEGATION, SCOPE_TARGET, SCOPE_COPULA, SCOPE_AIM = 4, 6, 3, 3
#: What is left of a path that is negated or reported.
FACTORS = {"negated": 0.1, "reported": 0.2}
#: Weights of the paths before any are learned, and as how many documents these count.
PATHS = {"directed": 1.5, "predicate": 1.2, "bare": 0.6, "threat": 1.5}
PRIOR_DOCS = 20
NEGATED, REPORTED, TARGETED, PREDICATE, AIMED = 1, 2, 4, 8, 16


class Transducer:
    """Deterministic: arcs (state, symbol) -> (state, marks); marks are put on the insult or threat that is read."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def compose(self, other: Transducer) -> Transducer:
        """Reads with both at once and puts the marks of both. Only reachable pairs of states are made."""
        start, arcs = (self.start, other.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in SYMBOLS:
                (to_a, x), (to_b, y) = self.arcs[a, symbol], other.arcs[b, symbol]
                arcs[state, symbol] = ((to_a, to_b), x | y)
                if (to_a, to_b) not in seen:
                    seen.add((to_a, to_b))
                    todo.append((to_a, to_b))
        return Transducer(arcs, start)

    def run(self, symbols) -> list[int]:
        state, out = self.start, []
        for symbol in symbols:
            state, marks = self.arcs[state, symbol]
            out.append(marks)
        return out


def _scope(trigger: int, width: int, mark: int, ends: bool = False) -> Transducer:
    """Marks insults and threats within `width` words after the trigger; ends: only the first of them."""
    arcs = {}
    for state in range(width + 1):
        for symbol in SYMBOLS:
            hit = symbol in (INSULT, THREAT)
            to = width if symbol == trigger else 0 if ends and hit else max(0, state - 1)
            arcs[state, symbol] = (to, mark if state and hit else 0)
    return Transducer(arcs)


def negation() -> Transducer:
    return _scope(NEGATION, SCOPE_NEGATION, NEGATED, ends=True)


def reported() -> Transducer:
    """From a verb of reported speech to the end of the clause."""
    return Transducer({(s, x): (int(s or x == REPORT), REPORTED if s and x in (INSULT, THREAT) else 0) for s in (0, 1) for x in SYMBOLS})


def target() -> Transducer:
    return _scope(TARGET, SCOPE_TARGET, TARGETED)


def predicate() -> Transducer:
    return _scope(COPULA, SCOPE_COPULA, PREDICATE)


def aim() -> Transducer:
    """Reads backwards."""
    return _scope(TARGET, SCOPE_AIM, AIMED)


def accept(symbol: int, marks: int) -> tuple[str, float] | None:
    """The path that accepts an insult or threat with these marks, and what is left of its weight; None if no path does."""
    if symbol == THREAT:
        path = "threat" if marks & AIMED else None
    elif symbol == INSULT:
        path = "directed" if marks & (TARGETED | AIMED) else "predicate" if marks & PREDICATE else "bare"
    else:
        path = None
    if path is None:
        return None
    return path, (FACTORS["negated"] if marks & NEGATED else 1.0) * (FACTORS["reported"] if marks & REPORTED else 1.0)


class Grammar:
    """The composed machine for what stands before an insult or threat, and the one for what follows."""

    def __init__(self):
        self.forward = negation().compose(reported()).compose(target()).compose(predicate())
        self.backward = aim()

    def clause(self, symbols: list[int], weights: list[float]) -> tuple[list[float], bool]:
        """What each path (in the order of PATHS) accepts in a clause, and whether any of it is neither negated nor reported."""
        out, plain = dict.fromkeys(PATHS, 0.0), False
        after = self.backward.run(symbols[::-1])[::-1]
        for symbol, weight, x, y in zip(symbols, weights, self.forward.run(symbols), after, strict=True):
            if symbol in (INSULT, THREAT) and (found := accept(symbol, x | y)):
                out[found[0]] += weight * found[1]
                plain |= found[1] == 1.0
        return list(out.values()), plain


class Lexicon:
    """The lexical transducer: whole words and stems to (symbol, weight); the longest fitting stem counts, a whole word before any."""

    def __init__(self, stems: dict[str, float]):
        rows: list[list[int]] = [[0] * 256]
        self.symbols, self.weights = [OTHER], [0.0]
        by_stem, by_word = {}, {}

        def add(text: str, symbol: int, weight: float, at: dict) -> None:
            state = 0
            for byte in text.encode():
                if not rows[state][byte]:
                    rows.append([0] * 256)
                    rows[state][byte] = len(rows) - 1
                state = rows[state][byte]
            at[state] = len(self.symbols)
            self.symbols.append(symbol)
            self.weights.append(weight)

        for symbol, words in WORDS.items():
            for word in words.split():
                known = max((w for s, w in stems.items() if word.startswith(s)), default=0.0)
                add(word, symbol, max(FIXED_WEIGHT, known) if symbol in (INSULT, THREAT) else 0.0, by_word)
        for stem, weight in stems.items():
            add(stem, INSULT, weight, by_stem)
        self.arcs = np.array(rows, np.int32).ravel()
        self.stem_at, self.word_at = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        self.stem_at[list(by_stem)], self.word_at[list(by_word)] = list(by_stem.values()), list(by_word.values())
        self.symbols, self.weights = np.array(self.symbols), np.array(self.weights)

    def read(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word, 0 for none."""
        out = np.zeros(len(starts), np.int32)
        live, state, step = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
        at = starts.copy()
        while len(live):
            state = self.arcs[state * 256 + raw[at]].astype(np.int64)
            going = state > 0
            live, state, at = live[going], state[going], at[going] + 1
            found = self.stem_at[state]
            out[live] = np.where(found > 0, found, out[live])
            last = at == ends[live]
            found = self.word_at[state[last]]
            out[live[last]] = np.where(found > 0, found, out[live[last]])
            live, state, at = live[~last], state[~last], at[~last]
            step += 1
        return out


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters) of lower-case texts as starts, ends and clause numbers; and each row's first word."""
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    mark = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81))) if len(raw) > 2 else np.zeros(0, np.int64)
    for k in range(3):  # general punctuation
        letter[mark + k] = False
    starts, ends, first = spans_where(letter, bounds)
    stop = np.isin(raw, np.frombuffer(b".!?;\n|", np.uint8))
    stop[bounds[(bounds > 0) & (bounds < len(raw))]] = True
    clause = np.cumsum(stop)[starts] if len(raw) else np.zeros(0, np.int64)
    return starts, ends, clause, first


def measure(lexicon: Lexicon, grammar: Grammar, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row: the sum that each path accepts, words, and clauses with something that is neither negated nor reported."""
    starts, ends, clause, first = words_of(raw, bounds)
    found = lexicon.read(raw, starts, ends)
    symbol, weight = lexicon.symbols[found], lexicon.weights[found]
    row = np.searchsorted(first[1:], np.arange(len(starts)), side="right")
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    out = np.zeros((len(bounds) - 1, len(PATHS) + 2))
    out[:, len(PATHS)] = np.diff(first)
    if len(hits):
        places = np.stack([row[hits], clause[hits]], 1)
        new = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(1)])
        for h in hits[new]:
            a = int(np.searchsorted(clause, clause[h]))
            b = int(np.searchsorted(clause, clause[h], side="right"))
            a, b = max(a, int(first[row[h]])), min(b, int(first[row[h] + 1]))
            sums, plain = grammar.clause(symbol[a:b].tolist(), weight[a:b].tolist())
            out[row[h], : len(PATHS)] += sums
            out[row[h], -1] += plain
    return out


@dataclass
class ToxicityModel:
    stems: dict[str, float] = field(default_factory=dict)
    paths: dict[str, float] = field(default_factory=lambda: dict(PATHS))
    coefficients: tuple[float, ...] = (2.0, 0.5, 0.0, 0.0, -3.0)

    def __post_init__(self):
        self.lexicon, self.grammar = Lexicon(self.stems), Grammar()

    def measure(self, column) -> np.ndarray:
        raw, bounds = text_buffers(pc.utf8_lower(column))
        return np.concatenate([measure(self.lexicon, self.grammar, raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in pieces(bounds)] or [np.zeros((0, len(PATHS) + 2))])

    def features(self, measured: np.ndarray) -> np.ndarray:
        """Log sum of clause scores, score per 100 words, log words, log clauses."""
        total = measured[:, : len(PATHS)] @ np.array([self.paths[p] for p in PATHS])
        words, many = measured[:, -2], measured[:, -1]
        return np.stack([np.log1p(total), np.minimum(100 * total / (words + 20), 50) / 10, np.log1p(words) / 5, np.log1p(many)], 1)

    def score(self, measured: np.ndarray) -> np.ndarray:
        c = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(self.features(measured) @ c[:-1] + c[-1], -30, 30)))


def _path_weights(measured: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """From how much oftener toxic documents have a path than clean ones, leaning on PATHS as on PRIOR_DOCS documents."""
    toxic, clean = measured[labels == 1], measured[labels == 0]
    out = {}
    for k, (path, prior) in enumerate(PATHS.items()):
        a, b = (toxic[:, k] > 0).sum(), (clean[:, k] > 0).sum()
        ratio = math.log((a + 0.5) / (len(toxic) + 1)) - math.log((b + 0.5) / (len(clean) + 1))
        out[path] = float((PRIOR_DOCS * prior + (a + b) * min(max(ratio / 3, 0.2), 2.0)) / (PRIOR_DOCS + a + b))
    return out


def _stem_counts(batches):
    """stem, toxic and clean documents and words of labelled texts."""
    for batch in batches:
        docs, tokens = (Counter(), Counter()), (Counter(), Counter())
        raw, bounds = text_buffers(pc.utf8_lower(batch.column(0)))
        labels = batch.column(1).to_pylist()
        for i, label in enumerate(labels):
            part = raw[bounds[i] : bounds[i + 1]]
            starts, ends, _, _ = words_of(part, np.array([0, len(part)]))
            data = part.tobytes()
            words = Counter(data[a:b].decode("utf-8", "ignore") for a, b in zip(starts, ends, strict=True))
            own = Counter()
            for word, n in words.items():
                for k in range(min(SHORTEST, len(word)), min(LONGEST, len(word)) + 1):
                    own[word[:k]] += n
            docs[label].update(own.keys())
            tokens[label].update(own)
            tokens[label][""] += sum(words.values())
            docs[label][""] += 1
        stems = list(tokens[0].keys() | tokens[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(stems), *(pa.array([c[s] for s in stems], pa.int64()) for c in (docs[1], docs[0], tokens[1], tokens[0]))], ["stem", "toxic_docs", "clean_docs", "toxic_words", "clean_words"])


def _choose(rows, toxic_words: int, clean_words: int, toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Stems and weights; a longer stem stays only if it says clearly more than the stem it begins with."""
    weight = {r.stem: math.log((r.toxic_words + 0.5) / (toxic_words + 1)) - math.log((r.clean_words + 0.5) / (clean_words + 1)) for r in rows}  # of occurrences
    weight = {r.stem: min(weight[r.stem], math.log((r.toxic_docs + 0.5) / (toxic_docs + 1)) - math.log((r.clean_docs + 0.5) / (clean_docs + 1))) for r in rows}  # and of documents
    longer: dict[str, tuple[int, str]] = {}
    for r in rows:
        longer[r.stem[:-1]] = max(longer.get(r.stem[:-1], (0, "")), (r.toxic_words, r.stem))
    times = {r.stem: r.toxic_words for r in rows}

    def full(stem: str) -> str:
        while (next_ := longer.get(stem, (0, ""))) and next_[0] >= LONGER * times[stem]:
            stem = next_[1]
        return stem

    chosen: dict[str, float] = {}
    often = {r.stem for r in rows if r.toxic_docs >= LEAST_SHARE * toxic_docs}
    for stem in sorted({full(s) for s in often if weight[s] >= LEAST_RATIO}, key=lambda s: (len(s), s)):
        known = max((chosen[stem[:k]] for k in range(len(stem)) if stem[:k] in chosen), default=-1.0)
        if weight[stem] > known + 0.7:
            chosen[stem] = min(weight[stem], 7.0)
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:STEMS])


def fit(labelled: DataFrame, text: str = "text", label: str = "label") -> ToxicityModel:
    """From a table of few labelled texts (label 1 toxic). The driver gets counts of frequent stems and five numbers a row."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(text, F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    counts = rows.mapInArrow(_stem_counts, "stem string, toxic_docs long, clean_docs long, toxic_words long, clean_words long")
    counts = counts.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic_docs", "clean_docs", "toxic_words", "clean_words"))).where((F.col("stem") == "") | ((F.col("toxic_docs") >= LEAST_DOCS) & (F.col("toxic_words") > F.col("clean_words") / 2)))
    best = counts.orderBy(F.col("stem") != "", F.desc(F.col("toxic_docs") / (F.col("clean_docs") + 1)), "stem").limit(20_000).collect()
    whole = next((r for r in best if r.stem == ""), None)
    if not whole or not whole.toxic_words or not whole.clean_words:
        return ToxicityModel()  # the fixed lists alone
    model = ToxicityModel(_choose([r for r in best if r.stem], whole.toxic_words, whole.clean_words, whole.toxic_docs, whole.clean_docs))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(model.measure(batch.column(0))), pa.list_(pa.float64()))], ["label", "x"])

    seen = rows.mapInArrow(run, "label int, x array<double>").collect()
    measured, labels = np.array([r.x for r in seen]), np.array([r.label for r in seen])
    model.paths = _path_weights(measured, labels)
    model.coefficients = _logistic(model.features(measured), labels.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> tuple[float, ...]:
    """Newton's method; rows of both labels weigh alike in sum, but for a prior of one in five."""
    x = np.c_[x, np.ones(len(x))]
    w = np.where(y == 1, 0.3 / max(y.mean(), 1e-9), 0.7 / max(1 - y.mean(), 1e-9))
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(x) * 0.01 * np.eye(len(c))
        c += np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * len(x) * 0.01 * c)
    return tuple(c.tolist())


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score, the probability of being toxic, for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(model.measure(batch.column(1))))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = sample_labels(table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0), "toxic", {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN})
    found = score(docs, fit(labelled_texts(docs, known)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
