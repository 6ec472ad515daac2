"""Jaccard join, line dedup, decontamination, packing, PII, media and the pipeline against brute force."""

import hashlib
import itertools
import random
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, jaccard, lines, media, packing, pii, quality, toxicity
from parlance.llm.common import text_buffers
from parlance.llm.oracles import DECONTAMINATE, JACCARD
from parlance.llm.queries import ORACLES, QUERIES
from tests.compare import connect, of_spark, of_sql


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Jaccard join


def components(rows):
    """(key, shingles, component) of each row; None is never the smallest key of a component with others."""
    return [r[:3] for r in grouped(rows)]


def grouped(rows):
    """As components(), and what tells a row's group from all others."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least.get(root(i)) if sets[i] else k, ("set", root(i)) if sets[i] else (k, t)) for i, (k, t) in enumerate(rows)]


def near_copies(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 60]))] for _ in range(9)]
    common = "this very common passage of words is in nearly all of the documents here".split()
    rows = []
    for k in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((k, " ".join(b + (common if rng.random() < 0.5 else []))))
    return rows + [(n + k, " ".join(common + [f"x{k}"] * rng.randrange(1, 9))) for k in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, odd_rows, monkeypatch, seed):
    if seed == 2:  # more flushes, rounds and parts than such a small table has
        monkeypatch.setattr(jaccard, "FLUSH", 500)
        monkeypatch.setattr(jaccard, "FIRST_PIVOTS", 2)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(jaccard, "ONE_TASK_LINKS", 0)
    rows = near_copies(seed) + odd_rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(4)
    assert Counter(map(tuple, jaccard.join(df).select("d", "n", "component").collect())) == Counter(components(rows))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r[3] for r in grouped(rows)})


def test_jaccard_of_string_keys(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [("b-2", base), ("b-10", f"{base} x"), ("c", "another text"), ("c", "another text"), (None, base), ("", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter((r.d, r.component) for r in jaccard.join(df).select("d", "component").collect())
    assert got == {("b-2", "b-10"): 1, ("b-10", "b-10"): 1, (None, "b-10"): 1, ("c", "c"): 2, ("", ""): 1}
    assert sorted(map(tuple, jaccard.one_of_each(df).collect()), key=str) == sorted([("b-10", f"{base} x"), ("c", "another text"), ("", None)], key=str)


def test_jaccard_equals_sql(spark, sf_dir):
    assert of_spark(QUERIES["op3_jaccard"](spark, sf_dir)) == of_sql(connect(sf_dir), JACCARD)


def linked(rows):
    """(key, shingles, links to other rows) of each row."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    return [(k, len(s), sum(near(s, o) for j, o in enumerate(sets) if j != i)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("pivots", [16, 2])
def test_jaccard_links_equal_brute_force(spark, odd_rows, monkeypatch, pivots):
    monkeypatch.setattr(jaccard, "FIRST_PIVOTS", pivots)
    # one group of near copies of one text: a common neighbour joins most pairs before they are compared
    text = [f"v{i}" for i in range(60)]
    group = [(1000 + k, " ".join([*text[:k], f"new{k % 20}", *text[k + 1 :]])) for k in range(40)]
    rows = near_copies(3) + group + odd_rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit(1)).repartition(4)
    got = jaccard.join(df, links=True)
    assert Counter(map(tuple, got.select("d", "n", "n_links").collect())) == Counter(linked(rows))
    assert Counter(map(tuple, got.select("d", "n", "component").collect())) == Counter(components(rows))


def test_jaccard_links_query(spark, small_dir, texts):
    got = QUERIES["op3_jaccard_links"](spark, small_dir)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "n_links").collect())) == Counter(linked(texts))


# line dedup


def without_copies(rows, least):
    """{(key, text): (text, lines, deleted)} by comparing every line's run with all earlier ones."""
    order = sorted({r: None for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    parts = [[x for x in (t or "").split("\n") if x.strip(" ")] for _, _, t in order]
    starts = [(a, i) for a, d in enumerate(parts) for i in range(len(d))]
    gone = {}
    for n, (a, i) in enumerate(starts):
        best = 0
        for b, j in starts[:n]:
            k = 0
            while i + k < len(parts[a]) and j + k < len(parts[b]) and parts[a][i + k] == parts[b][j + k]:
                k += 1
            best = max(best, k)
        if sum(len(x.strip(" ").split(" ")) for x in parts[a][i : i + best]) >= least:
            gone.setdefault(a, set()).update(range(i, i + best))
    out = {}
    for a, (k, _, t) in enumerate(order):
        kept, n = [], 0
        for line in (t or "").split("\n"):
            n += bool(line.strip(" "))
            if not (line.strip(" ") and n - 1 in gone.get(a, ())):
                kept.append(line)
        d = len(gone.get(a, ()))
        out[k, t] = (t if not d else "" if d == n else "\n".join(kept), n, d)
    return out


@pytest.mark.parametrize("least", [3, 12])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    words = ["a", "bb c", "d e f", "g", "h i j k l", "m n", "", "  "]
    rows = [(rng.choice([k, k, k, None, 3]), "\n".join(rng.choice(words) for _ in range(rng.randrange(25)))) for k in range(30)]
    rows += [(5, None), (6, ""), (7, rows[0][1]), rows[1], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "runs": F.lit(2)})
    hashes = {(r.doc_id, r.text): r.x for r in df.select("doc_id", "text", F.xxhash64("text").alias("x")).collect()}
    want = without_copies([(k, hashes[k, t], t) for k, t in rows], least)
    got = lines.dedup(df.repartition(3), min_words=least)
    assert got.columns == [*df.columns, "n_lines", "n_deleted"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in got.collect()) == Counter((k, *want[k, t]) for k, t in rows)
    left = lines.dedup(df, min_words=least, drop_emptied=True, counts=False)
    assert left.count() == sum(not (d and d == n) for _, n, d in (want[k, t] for k, t in rows))


def test_ranks_are_a_suffix_array(spark):
    rng = random.Random(5)
    rows = [(k, "\n".join(rng.choice("ab" if k % 3 else "abc") for _ in range(rng.randrange(30)))) for k in range(25)] + [(100, "a\n" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {x: tuple(spark.range(1).select(F.xxhash64(F.lit(x)), F.xxhash64(F.lit(7), F.lit(x))).first()) for x in "abc"}
    parts = {k: [ids[x] for x in t.split("\n") if x] for k, t in rows}
    places = [(k, i) for k in sorted(parts) for i in range(len(parts[k]))]
    sizes = set()
    for blocks in lines.ranked_blocks(df, min_words=9):
        got = [(r.size, r.rank, (r.d, r.i), r.later) for r in blocks.collect()]
        for size in {g[0] for g in got}:
            of = lambda place: tuple(parts[place[0]][place[1] : place[1] + size])
            mine = sorted((rank, of(place)) for s, rank, place, _ in got if s == size)
            assert [x for _, x in mine] == sorted(x for _, x in mine)  # in the order of the line IDs
            assert len({x for _, x in mine}) == len({r for r, _ in mine}) == len(set(mine))  # one rank, one interval
            sizes.add(size)
    assert sizes == {2, 4, 8, 9}
    first = {}
    for place in places:
        first.setdefault(of(place), place)
    runs = {place: later for size, _, place, later in got if size == 9}  # the last round's blocks are the runs that reach nine words
    assert runs == {x: first[of(x)] != x for x in places if len(of(x)) == 9 and sum(of(x) == of(y) for y in places) > 1}


@pytest.mark.parametrize("blank", ["\t", "\u00a0", "\u3000", "  ", " \t "])
def test_line_dedup_counts_words(spark, blank):
    said = lambda name, *sizes: "\n".join(blank.join(f"{name}{k}x{i}" for i in range(n)) for k, n in enumerate(sizes))
    gap = "\n" + "\t\n" * 40  # lines without words do not count
    bodies = {1: said("a", 20, 20, 20), 2: said("b", 12, 13), 3: said("c", 12, 12), 4: said("d", 12) + gap + said("e", 13), 5: said("f", 12) + gap + said("g", 12)}
    rows = [(10 * k + copy, f"own {k} {copy}\n{t}") for k, t in bodies.items() for copy in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted) for r in lines.dedup(df).collect()}
    gone = {11: 3, 21: 2, 41: 42}
    assert got == {k: (t.split("\n")[0] if k in gone else t, gone.get(k, 0)) for k, t in rows}


def test_words_of_lines(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice(" ab\u00e9" + lines._SPACES if k % 2 else "  ab\u00e9") for _ in range(rng.randrange(1, 20))) for k in range(600)] + ["a", " a ", "\t", "a\u0085b", "a\u200bb", "\U0001f600 \U0001f600"]
    rows = [x for x in rows if x.strip(" ")]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", lines._words(F.col("x")).alias("n")).collect()
    assert [(r.x, r.n) for r in got] == [(x, len(re.findall(f"[^ {lines._SPACES}]+", x))) for x in rows]


def test_line_dedup_query(spark, small_dir, texts):
    hashes = {(r.doc_id, r.text): r.x for r in spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("x")).collect()}
    want = without_copies([(k, hashes[k, t], t) for k, t in texts], lines.MIN_WORDS)
    got = QUERIES["op8_lines"](spark, small_dir).collect()
    assert Counter(map(tuple, got)) == Counter((k, *want[k, t]) for k, t in texts)


# decontamination


def hits(rows, bench, width=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = {}
    for name, t in bench:
        w = words(t)
        z = min(width, len(w))
        for a in range(len(w) - z + 1 if z else 0):
            windows.setdefault(tuple(w[a : a + z]), set()).add("null" if name is None else str(name))
    out = []
    for k, t in rows:
        w, hit, items = words(t), set(), set()
        for z in {len(x) for x in windows}:
            for a in range(len(w) - z + 1):
                if (own := windows.get(tuple(w[a : a + z]))) is not None:
                    hit.update(range(a, a + z))
                    items |= own
        out.append((k, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [200_000, 60])
def test_decontamination_equals_brute_force(spark, small_dir, texts, block):
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    want = Counter(hits(texts, [tuple(r) for r in bench.select("item_id", "text").collect()]))
    if block == 200_000:
        found = QUERIES["op9_decontaminate"](spark, small_dir)
        assert Counter(tuple(r)[:6] for r in found.collect()) == want
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    found = decontaminate.hits(docs, bench, carry=["doc_id"], words_each=block).collect()
    got = Counter((r.doc_id, r.hit_words_, sum(b - a for a, b in r.hit_ranges_), len(r.hit_items_)) for r in found)
    assert got == Counter(x[:4] for x in want.elements())
    clean = decontaminate.hits(docs, bench, clean_only=True, words_each=block)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not x[5] for x in want.elements())


def test_decontamination_equals_sql(spark, sf_dir):
    assert of_spark(QUERIES["op9_decontaminate"](spark, sf_dir)) == of_sql(connect(sf_dir), DECONTAMINATE)


def test_suffix_array():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 200):
        h = rng.integers(0, 4, n).astype(np.uint64)
        order, number, vocabulary = decontaminate.suffix_array(h, 16)
        assert sorted(order.tolist()) == list(range(n))
        assert (vocabulary[number] == h).all()
        ranked = [number[i : i + 16].tolist() for i in order]
        assert ranked == sorted(ranked)


def test_longest_match(spark):
    text = "zero one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, f"x y {text} z")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.digest(docs, bench).collect()}
    assert (rows[1].longest_words, rows[1].longest_start, rows[1].longest_item, rows[1].n_hit) == (13, 1, "5", 13)
    assert (rows[2].longest_words, rows[2].longest_start, rows[2].longest_item) == (0, -1, "")


@pytest.mark.parametrize("held", [1_000_000, 7])
def test_longest_match_of_repetitive_texts(monkeypatch, held):
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = random.Random(held)
    said = lambda n: " ".join(rng.choice(["a", "a", "a", "b"]) for _ in range(n))
    items = [("1", "a " * 60), ("2", said(70)), ("2", said(40)), ("3", "b a"), ("4", said(9)), ("5", "a " * 45 + "c"), ("6", "")]
    block = decontaminate.Block(items)
    texts = ["a " * 60, "", *(said(n) for n in (1, 8, 30, 60, 90)), "c " + "a " * 45 + "c", "x " * 20 + items[1][1] + " y"]
    found = decontaminate.find(block, *text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        runs = []
        for name, x in items:
            d, w = t.split(), x.split()
            z = min(10, len(w))
            for p, k in itertools.product(range(len(d)), range(len(w))):
                if p and k and d[p - 1] == w[k - 1]:
                    continue
                n = 0
                while p + n < len(d) and k + n < len(w) and d[p + n] == w[k + n]:
                    n += 1
                if n >= z:
                    runs.append((-n, name, p - k, p))
        got = found[i]["longest"] if i in found else None
        assert got == ((-min(runs)[0], min(runs)[3], min(runs)[1], min(runs)[3] - min(runs)[2]) if runs else None)
    assert found[0]["longest"] == (60, 0, "1", 0)


def test_longest_match_is_the_same_in_blocks(spark):
    one, two = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x y z {two} " + "w " * 85 + one), (2, f"{one} . {two}"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, one), (9, two)], "item_id long, text string").coalesce(1)
    whole, apart = ({r.doc_id: r.hit_longest_ for r in decontaminate.hits(docs, bench, carry=["doc_id"], words_each=n).collect()} for n in (200_000, 12))
    assert apart == whole
    assert (apart[1].words, apart[1].start, apart[1].item, apart[1].item_start) == (12, 100, "7", 0)


# packing


def test_packing(spark, small_dir, texts):
    found = QUERIES["op7_packing"](spark, small_dir).collect()
    size = {}
    for k, t in texts:
        raw, bounds = text_buffers(pa.array([t], pa.string()))
        n = len(re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x00-\x20]", raw.tobytes()))
        assert packing.count_tokens(raw, bounds).tolist() == [n]
        size[k] = size.get(k, 0) + n
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == size
    bins = {}
    for r in found:
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_capacity))
    for parts in bins.values():
        at = 0
        for offset, n, capacity in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity == min(c for c in packing.CAPACITIES if c >= at)


def test_long_and_repeated_documents(spark):
    df = spark.createDataFrame([(1, "a " * 20_000), (1, "a " * 20_000), (2, "b")], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df).collect()
    assert Counter((r.doc_id, r.piece, r.piece_start, r.n_tokens) for r in rows) == Counter({(1, 0, 0, 8192): 2, (1, 1, 8192, 8192): 2, (1, 2, 16384, 3616): 2, (2, 0, 0, 1): 1})


def packed_naively(lengths, sizes):
    """Best fit over all open bins, each looked at for each length; the least net cost over all sizes opens one."""
    left, bins, out = list(lengths), [], {}
    costs = {c: packing.cost(c, sizes) for c in sizes}
    unit = costs[max(sizes)] / max(sizes)
    for turn, i in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        n = lengths[i]
        left.remove(n)
        fits = [b for b in bins if b["room"] >= n]
        if fits:
            b = min(fits, key=lambda b: (b["room"], -b["turn"]))
        else:
            net = {c: costs[c] - unit * min(c - n, sum(x for x in left if x <= c - n)) for c in sizes if c >= n}
            size = min(net, key=lambda c: (round(net[c], 6), c))
            b = {"room": size, "used": 0, "number": len(bins)}
            bins.append(b)
        out[i] = (b["number"], b["used"])
        b["used"] += n
        b["room"] -= n
        b["turn"] = turn
    final = [min(c for c in sizes if c >= b["used"]) for b in bins]
    return [(*out[i], final[out[i][0]]) for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = (8, 16, 32, 64) if seed % 2 else packing.CAPACITIES
    lengths = rng.integers(1, max(sizes) + 1, 150) if seed < 3 else np.minimum(rng.geometric(6 / max(sizes), 150), max(sizes))
    got = packing.pack(lengths, sizes)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == packed_naively(lengths.tolist(), sizes)


def test_packing_is_tight():
    lengths = np.random.default_rng(2).integers(1, 3000, 4000)
    bins, _, capacity = packing.pack(lengths)
    caps = dict(zip(bins.tolist(), capacity.tolist(), strict=True))
    assert lengths.sum() / sum(caps.values()) > 0.995
    many = np.random.default_rng(3).integers(1, 3000, 60_000)
    room = lambda x: sum(dict(zip(*(v.tolist() for v in packing.pack(x)[::2]), strict=True)).values())
    apart = sum(room(many[a : a + 4000]) for a in range(0, len(many), 4000))
    assert apart <= 1.01 * room(many)  # what windows lose
    assert packing.pack(np.zeros(0, np.int64))[0].tolist() == []
    assert packing.pack(np.array([8192, 1]))[2].tolist() == [8192, 512]


# PII


def test_surrogates_are_one_to_one():
    key = b"k"
    for shape in (3, 4):
        codes = [f"{i:0{shape}d}" for i in range(10**shape)]
        new = [pii.permute_text(key, "x", c) for c in codes]
        assert sorted(new) == codes and all(a != b for a, b in zip(codes, new, strict=True))
    for group, names in pii.GIVEN.items():
        new = [pii.surrogate(key, "name", n) for n in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True)), group


def test_surrogates_keep_format():
    s = lambda kind, text: pii.surrogate(b"k", kind, text)
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", s("phone", "+1 (017) 555-7713"))
    assert re.sub(r"\D", "", s("phone", "+1 (017) 555-7713")) == re.sub(r"\D", "", s("phone", "1 017 555 7713"))
    assert pii.luhn(re.sub(r"\D", "", s("card", "4111 1111 1111 1111"))) and not pii.luhn(s("card", "4111111111111112"))
    iban = s("iban", "DE89370400440532013000")
    assert iban[:2] == "DE" and pii._iban_check("DE", iban[4:]) == iban[2:4]
    assert re.fullmatch(r"[A-Z][a-z]+\.\d\d@[a-z]{4}\d\.[a-z]+\.com", s("email", "Bob.17@mail7.example.com"))
    assert s("email", "BOB@x.org").lower() == s("email", "bob@x.org")
    assert s("ip", "192.168.1.9").startswith("192.168.")
    assert re.fullmatch("[А-Я][а-я]{4}ва", s("name", "Петрова")) is None and re.fullmatch("[А-Я][а-я]{6}", s("name", "Петрова"))
    assert s("name", "Петрова")[-1] == "а"


def test_pii_in_texts(spark):
    text = "Dr. Anna Quill (anna.q@corp.example.com, +1 (017) 555-7713, 10.1.2.3) paid by 4111 1111 1111 1111. Quill is Anna; 2024-01-02, 3.14, v1.2.3, 12345678"
    rows = [(1, text), (2, None), (3, ""), (4, f"{text}\n{text}"), (4, f"{text}\n{text}"), (None, "call 017-555-7713 now"), (6, "no entity here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = pii.pseudonymize(df).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.n_phone, one.n_ip, one.n_card, one.n_name, one.n_collisions) == (1, 1, 1, 1, 4, 0)
    for secret in ("anna.q@", "555-7713", "10.1.2.3", "4111 1111", "Quill", "Anna"):
        assert secret not in one.text
    for kept in ("Dr. ", "2024-01-02, 3.14, v1.2.3, 12345678", "@"):
        assert kept in one.text
    last = re.search(r"Dr\. (\w+) (\w+)", one.text)
    assert f"{last[2]} is {last[1]}" in one.text  # later mentions stay the same person
    four = [r for r in got if r.doc_id == 4]
    assert four[0].text == four[1].text == f"{one.text}\n{one.text}" and four[0].n_distinct == one.n_distinct
    assert {r.doc_id: r.text for r in got if r.doc_id in (2, 3, 6)} == {2: None, 3: "", 6: "no entity here"}
    told = pii.entities(df)
    assert pii.collisions(told).count() == 0 and told.where("entity = surrogate").count() == 0


PHONES = {
    "en": ["+44 20 7946 0958", "+44 7911 123456", "020 7946 0958", "07911 123456", "5551234567", "555-0271", "555 0271", "(555) 123-4567", "+1 555 1234567", "+15551234567"],
    "de": ["+49 30 1234567", "030 12345678", "+49 170 1234567", "0170 1234567", "030/1234567", "+49 (0)30 1234567", "0049 30 1234567", "030 1234567-12", "03012345678"],
    "fr": ["+33 6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78", "0612345678", "+33 (0)6 12 34 56 78", "+33\u00a06\u00a012\u00a034\u00a056\u00a078"],
    "es": ["+34 612345678", "+34 612 34 56 78", "612345678", "612 34 56 78", "91 123 45 67"],
}


@pytest.mark.parametrize("lang", PHONES)
def test_phone_formats(lang):
    for number in PHONES[lang]:
        for before, after in (("call ", " now"), ("", ""), ("(", "), 2024-01-02"), ("tel: ", ".")):
            text = before + number + after
            if before == "(" == number[0]:
                continue
            assert pii.find(text) == [(len(before), len(before) + len(number), "phone")], text
            new = pii.replace(text)[0]
            assert new != text and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
    both = " ".join(PHONES[lang][:1] * 2)
    assert [both[a:b] for a, b, _ in pii.find(both)] == PHONES[lang][:1] * 2


@pytest.mark.parametrize("text", ["05.12.2024", "05/12/2024 at 10:30", "2024-01-02", "1998-2004", "1999 2000", "12345678", "1700000000", "123.4567", "3.14159265", "v1.2.3", "1,234,567", "1 234 567", "0.123456789", "id a0301234567", "1234567"])
def test_other_numbers_are_no_phones(text):
    assert [x for x in pii.find(f"on {text} it") if x[2] == "phone"] == []


def test_phone_beside_other_entities():
    text = "030 12345678 10.1.2.3 4111 1111 1111 1111"
    assert [(text[a:b], k) for a, b, k in pii.find(text)] == [("030 12345678", "phone"), ("10.1.2.3", "ip"), ("4111 1111 1111 1111", "card")]


def test_pii_query(spark, small_dir, texts):
    rows = QUERIES["op5_pii"](spark, small_dir).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for k, t in texts:
        want[k, pii.replace(t)[0] if t else t, ",".join(f"{n}:{a}:{b}" for a, b, n in pii.find(t or ""))] += 1
    assert Counter((r.doc_id, r.text, r.spans) for r in rows) == want


# media


def test_media_equals_brute_force(spark, small_dir, texts):
    rows = QUERIES["op10_media"](spark, small_dir).collect()
    want = Counter()
    for k, t in texts:
        p = (t or "").encode()
        q = p.ljust(max(192, -(-len(p) // 192) * 192), b" ")
        want[k, len(p), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    same = {}
    for r in rows:
        same.setdefault(r.payload_sha256, set()).add(tuple(r)[2:])
    assert all(len(x) == 1 for x in same.values())


def test_stored_form_is_a_jpeg():
    rng = random.Random(3)
    texts = ["", "x" * 192, "ÿ" * 500, "".join(chr(rng.randrange(1, 3000)) for _ in range(3000)), "a" * (192 * (media.MOST_ROWS + 3))]
    stored = media.encode(*text_buffers(pa.array(texts)))
    for text, data, images in zip(texts, stored, media.decode(stored), strict=True):
        first = media.parse(data)
        assert data[:3] == b"\xff\xd8\xff" and data[-2:] == b"\xff\xd9"
        assert (first["width"], first["height"]) == (1536, 8 * images[0].shape[0])
        payload = b"".join(x.tobytes() for x in images)
        assert payload.rstrip(b" ") == text.encode().rstrip(b" ")
        if len(data) < 10_000:
            assert media.decode_any(data, first).tobytes() == payload
    assert len(media.decode(stored)[4]) == 2
    with pytest.raises(ValueError):
        media.parse(b"not an image")


def test_memory_of_long_media():
    size = 10_000_000
    args = text_buffers(pa.array(["", "xyz w" * (size // 5), "short"]))
    tracemalloc.start()
    stored = media.encode(*args)
    coding = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    images = media.decode(stored)
    decoding = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(coding, decoding) < 50_000_000 + 5 * size
    payload = b"".join(x.tobytes() for x in images[1])
    assert payload.rstrip(b" ") == ("xyz w" * (size // 5)).encode() and len(images[1]) == -(-size // (192 * media.MOST_ROWS))
    assert [len(x) for x in (images[0], images[2])] == [1, 1]


def test_other_baseline_images():
    """An image with three components, two by two luminance blocks, AC coefficients and no restart intervals."""
    counts, order, code = media.canonical(dict(enumerate(media.DC_LENGTHS)))
    ac_counts, ac_order, ac = media.canonical({0: 2, 0x01: 2, 0xF0: 2})
    bits, past = "", [0, 0, 0]

    def block(part, value, tail):
        nonlocal bits
        d = value - past[part]
        past[part] = value
        size = abs(d).bit_length()
        c, n = code[size]
        bits += f"{c:0{n}b}" + (f"{(d if d > 0 else d - 1) & ((1 << size) - 1):0{size}b}" if size else "")
        for s in tail:
            c, n = ac[s & 0xFF]
            bits += f"{c:0{n}b}" + ("1" if s == 1 else "")

    values = [[10, -20, 30, -40], [50, 60, 70, 80]]
    for unit in values:
        for v in unit:
            block(0, v, [0x01, 0xF0, 0])
        block(1, 5, [0]), block(2, -5, [0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = b"\xff\xd8" + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, b"\x08\x00\x10\x00\x20\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, bytes([0x00, *counts, *order])) + seg(0xC4, bytes([0x10, *ac_counts, *ac_order])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    pixels = media.decode([data])[0][0]
    assert pixels.tolist() == [[138, 108, 178, 188], [158, 88, 198, 208]]


# all of them


def test_own_names_may_clash(spark):
    """Columns of docs named like those that the operators use inside come back as they were."""
    text = "\n".join(f"line number {k} of a passage that stands in two documents at least" for k in range(6))
    inside = ["key", "hash", "key_", "hash_", "KEY", "run_key", "run_hash", "runs", "runs_", "run_key_", "text_hash_", "hit_text_", "hit_ranges_", "hit_items_", "c0", "c1", "d", "h", "k", "g", "comp", "class", "stay d", "stay h", "stay_d", "n_lines", "n_deleted", "score", "label"]
    inside = [c for c in inside if c != "KEY"]
    df = spark.createDataFrame([(1, text), (2, "own words first\n" + text), (3, text), (4, None), (5, "")], "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in inside})
    bench = spark.createDataFrame([(1, "line number 3 of a passage that stands in two documents at least")], "item_id long, text string")
    flat = quality._flat(0.9)
    for name, out in {
        "jaccard": jaccard.one_of_each(df), "lines": lines.dedup(df, drop_emptied=True, counts=False), "counted": lines.dedup(df), "clean": decontaminate.hits(df, bench, clean_only=True),
        "hits": decontaminate.hits(df, bench), "kept": quality.score(df, flat, keep=True),
    }.items():
        assert out.columns[: len(df.columns)] == df.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert tuple(r)[2 : len(df.columns)] == tuple(f"{c}:{r[0]}" for c in inside), name
    assert lines.dedup(df).columns[-2:] == ["n_lines_", "n_deleted_"]
    assert decontaminate.hits(df, bench).columns[-4:] == ["hit_ranges__", "hit_items__", "hit_longest_", "hit_words_"]
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).select("doc_id").collect()) == [1, 4, 5]


def test_very_long_texts(spark):
    rng = random.Random(6)
    body = [f"w{rng.randrange(5000)}" for _ in range(250_000)]
    item = " ".join(f"item{k}" for k in range(15))
    long = "\n".join(" ".join(body[k : k + 50]) for k in range(0, len(body), 50))
    rows = [(1, long), (2, f"{long}\n{item} call +49 30 1234567"), (3, "short"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sizes = {k: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for k, t in rows if len(w := t.split()) > 4}
    got = {r.d: (r.n, r.component) for r in jaccard.join(df).collect()}
    assert got == {1: (sizes[1], 1), 2: (sizes[2], 1), 3: (1, 3), 4: (sizes[4], 1)}
    hits_ = {r.doc_id: (r.n_words, r.n_hit, r.longest_start) for r in decontaminate.digest(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits_ == {1: (250_000, 0, -1), 2: (250_019, 15, 250_000), 3: (1, 0, -1), 4: (250_000, 0, -1)}
    left = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in lines.dedup(df).collect()}
    assert left == {1: (long, 5000, 0), 2: (f"{item} call +49 30 1234567", 5001, 5000), 3: ("short", 1, 0), 4: ("", 5000, 5000)}
    private = {r.doc_id: (r.n_phone, r.text[: len(long)] == long) for r in pii.pseudonymize(df).collect()}
    assert private == {1: (0, True), 2: (1, True), 3: (0, False), 4: (0, True)}
    packed = Counter()
    for r in packing.pack_documents(df).collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == {1: 250_000, 2: 250_020, 3: 1, 4: 250_000}
    scored = {r.doc_id: r.score for r in quality.score(df, quality._flat(0.25)).collect()}
    assert all(abs(x - 0.25) < 1e-5 for x in scored.values())
    toxic = {r.doc_id: r.score for r in toxicity.score(df.withColumn("text", F.concat("text", F.lit(". you idiot!"))), toxicity.ToxicityModel()).collect()}
    assert toxic[3] > toxic[1] == toxic[4]


@pytest.mark.parametrize("name", ["op3_jaccard", "op5_pii", "op7_packing", "op8_lines", "op9_decontaminate", "op10_media"])
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


# what SQL can say of operators that it can't express as a whole


@pytest.mark.parametrize("name", ["secret_counts", "url_rules", "media_payloads"])
def test_parts_equal_sql(spark, sf_dir, name):
    assert of_spark(QUERIES[name](spark, sf_dir)) == of_sql(connect(sf_dir), ORACLES[name])


# pipeline


def test_pipeline_of_empty_tables(spark, empty_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, empty_dir)
        assert found.count() == 0, name
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_stages(spark, small_dir, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    counts, before = [docs.count()], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, small_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        counts.append(after.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            own = {(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()}
            if name == "jaccard_join":
                rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
                assert own <= set(rows) and len(own) == after.count() == len({r[3] for r in grouped(rows)})
            if name == "decontamination":
                rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
                bench = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
                assert own == {row for row, h in zip(rows, hits(rows, bench), strict=True) if not h[5]}
        before = after
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4]
    whole = corpus_pipeline.run(spark, small_dir)
    assert whole.columns == ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"]
    assert whole.select("doc_id").distinct().count() <= counts[4]
