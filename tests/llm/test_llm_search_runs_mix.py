"""Ranked search, periodic runs and source mixing against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import mixing, periodic, queries, ranking

SCHEMA = "doc_id long, text string, source string, item long, part int, score long, uid long, rank int, runs string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs_of(spark, rows, parts=4):
    full = [(i, t, s, 1, 2, 3, 4, 5, "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    own = [(i, Counter(terms_of(t))) for i, t, _ in docs]
    lengths = [sum(c.values()) for _, c in own]
    n_docs, n_terms = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (i, c), n in zip(own, lengths):
            if not n:
                continue
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, shard_bytes, item_bytes", [(1, 1 << 20, 1 << 20), (2, 300, 40), (3, 2000, 200)])
def test_search_matches_brute_force(spark, seed, shard_bytes, item_bytes):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "été", "naïve", "東京", "don't", "x_y", "A1", "common"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: rng.choice([" ", "\n", "--"]).join(rng.choices(vocab, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60)), None) for i in range(150)]
    docs += [(200 + i, t, None) for i, t in enumerate([None, "", "  ", "!?", "common " * 500, "common"])]
    docs += [(300, "same text here", None), (300, "same text here", None), (None, "same text here", None), (7, docs[7][1], None)]
    items = [(i, text(rng.randrange(1, 15))) for i in range(12)]
    items += [(50, None), (51, "nowhere known"), (52, "common common"), (53, "same text"), (None, "w1 w2"), (53, "same text")]
    got = ranking.search(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")),
                         5, item_bytes=item_bytes, shard_bytes=shard_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(docs_of(spark, []), items).collect() == []
    assert ranking.search(docs_of(spark, [(1, "a", None)]), items.where("false")).collect() == []


def test_lists_are_not_read_to_their_ends():
    """The bar and the least impacts end the reading; what is left has final scores."""
    rng = np.random.default_rng(4)
    n, k = 5000, 10
    least = rng.integers(100, 5000, n)
    lists, whole, reads = [], np.zeros(n, np.int64), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(len(range(*at.indices(len(self)))))
            return np.asarray(self)[at] if isinstance(at, slice) else super().__getitem__(at)
    for size, factor in ((4000, 1), (3000, 2), (60, 50)):
        docs = rng.permutation(n)[:size] if size > 60 else np.argsort(-least)[:size]
        impacts = least[docs] * rng.integers(1, 4, size)
        order = np.argsort(-impacts, kind="stable")
        whole[docs] += impacts * factor
        lists.append((docs[order], impacts[order].view(Counted), factor))
    alive, scores = ranking.read_lists(lists, least, k, 1)
    bar = np.sort(whole)[-k]
    assert set(np.flatnonzero(whole >= bar)) <= set(alive.tolist())
    assert (scores == whole[alive]).all()
    assert sum(reads) < 5000  # of 7,060


def brute_runs(words, least=6, exponent=4):
    out = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted((s, p, n) for (s, n), p in out.items())


def random_words(rng):
    words = []
    for _ in range(rng.randrange(0, 9)):
        unit = [f"t{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
        words += unit * rng.choice([1, 1, 1, 4, 5, 9, 30]) + unit[:rng.randrange(0, len(unit) + 1)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [random_words(rng) for _ in range(120)] + [["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], ["x"] * 3000, []]
    texts = [rng.choice([" ", "\n\t ", "  "]).join(w) for w in words]
    docs = docs_of(spark, [*((i, t, "s") for i, t in enumerate(texts)), (900, None, None), (None, "b b b b b b b", None)])
    got = {r.doc_id: r for r in periodic.periodic_runs(docs.drop("runs"), slice_bytes=3000).collect()}
    assert len(got) == len(texts) + 2 and got[900].runs == [] and got[900].collapsed == "" and got[None].collapsed == "b"
    for i, w in enumerate(words):
        runs = brute_runs(w)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == runs
        gone = {j for s, p, n in runs for j in range(s + p, s + n)}
        assert got[i].collapsed == " ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[i].source == "s"


def test_extension_matches_direct_comparison():
    rng = np.random.default_rng(3)
    for _ in range(30):
        texts = [rng.integers(0, rng.choice([1, 2, 4, 50]), rng.integers(2, 200)) for _ in range(4)]
        fences, symbols = [], []
        for t in texts:
            fences.append(len(symbols))
            symbols += [-1 - len(fences), *t.tolist()]
        fences.append(len(symbols))
        symbols = np.array([*symbols, -99])
        levels = periodic.grammar(symbols, np.array(fences))
        a, b = [], []
        for f, t in zip(fences, texts):
            a += rng.integers(0, len(t) - 1, 40).tolist()
            b += [int(rng.integers(x + 1, len(t))) for x in a[-40:]]
            a[-40:], b[-40:] = [x + f + 1 for x in a[-40:]], [x + f + 1 for x in b[-40:]]
        for way in (1, -1):
            want = []
            for x, y in zip(a, b):
                n = 0
                while symbols[x + way * n] == symbols[y + way * n]:
                    n += 1
                want.append(n)
            assert periodic.extension(levels, np.array(a), np.array(b), way).tolist() == want


def test_runs_of_an_empty_table(spark):
    got = periodic.periodic_runs(docs_of(spark, []).drop("runs"))
    assert got.collect() == [] and "text" not in got.columns and "collapsed" in got.columns


def brute_targets(sizes, weights, budget, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = float(most * sizes[s])
        free -= above
        left = budget - sum(most * sizes[s] for s in names if s not in free)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_gives_each_source_its_target(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "hot", "empty", "\U0001F642"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 200])), rng.choice(names[:-2])) for i in range(300)]
    rows += [(1000 + i, "x y z", "hot") for i in range(300)] + [(2000, None, "empty"), (2001, " ", "empty"), (2002, "one", "\U0001F642")]
    rows += [(5, "twice", "a"), (5, "twice", "a"), (None, "no id", "a"), (None, "no id", "a"), (None, "other", None)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes, (5, 2, 1), sum(sizes.values()))
    docs = docs_of(spark, rows, 5)
    mix, all_rows = mixing.fair_mix(docs, (5, 2, 1))
    mix, all_rows = mix.collect(), all_rows.collect()
    assert len(all_rows) == len(rows)
    own, taken, by_source = {r.uid: r for r in all_rows}, Counter(), Counter()
    for r in all_rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
    for r in mix:
        taken[r.uid] += r.words
        by_source[r.source] += r.words
    assert all(0 < n <= 3 * own[u]["size"] for u, n in taken.items())
    assert all(by_source[s] == math.floor(t) for s, t in targets.items())
    mix.sort(key=lambda r: r.position)
    assert [r.finish for r in mix] == sorted(r.finish for r in mix) and max(r.finish for r in mix) <= 1
    at = 0
    for r in mix:
        assert r.position == at
        at += r.words
    # at any point of the mix each source has had its share, to one document
    so_far, longest = Counter(), max(r["size"] for r in all_rows)
    for r in mix:
        so_far[r.source] += r.words
        assert all(abs(so_far[s] - r.finish * t) <= longest + 1 for s, t in targets.items())
    again = mixing.taken_words(docs.repartition(2), (5, 2, 1)).collect()
    first = mixing.taken_words(docs, (5, 2, 1)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in first)


def test_mix_of_small_and_empty_tables(spark):
    assert mixing.taken_words(docs_of(spark, []), (5, 2, 1)).collect() == []
    got = mixing.taken_words(docs_of(spark, [(1, None, None), (2, "", "a")]), (5, 2, 1)).collect()
    assert {(r.doc_id, r.target, r.taken) for r in got} == {(1, 0.0, 0), (2, 0.0, 0)}
    mix, _ = mixing.fair_mix(docs_of(spark, [(i, "a b c d", "s" if i < 5 else "t") for i in range(10)]), (1, 1), budget=10)
    assert sum(r.words for r in mix.collect()) == 10


def test_planted_periods_follow_the_contract(spark):
    import zlib
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50)), "s") for i in range(200)]
    got = {r.doc_id: r.text for r in queries.planted_periods(docs_of(spark, rows)).collect()}
    planted = 0
    for i, text, _ in rows:
        h, w = zlib.crc32(str(i).encode()), text.split()
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        assert got[i].split() == w
    assert planted > 5
