"""Joins, sharding, URL rules and vectors against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import graph, jaccard, sharding, urls, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, sid string, chunk int, n long"


def least_of(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(300, 301), (301, 300), (302, 302)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    got = {r.node.id: r.root.id for r in graph.components(df.select(node("a").alias("a"), node("b").alias("b"))).collect()}
    want = least_of({x for e in edges for x in e}, edges)
    want.pop(302)
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    assert groups(got) == groups(want)
    assert graph.components(df.where("false").select(F.col("a"), F.col("b"))).count() == 0


def shingles(text, width=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return set() if not w else {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def near_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    base = [[word() for _ in range(rng.randrange(1, 90))] for _ in range(n // 6)]
    passage = [word() for _ in range(25)]
    out = [None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d e f", "É é", "é é"]
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(w))
            w[i:i + rng.randrange(0, 2)] = [word()] * rng.randrange(0, 3)
        if rng.random() < 0.3:
            w += passage
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,pct", [(1, 80), (2, 80), (3, 60)])
def test_jaccard_components_match_brute_force(spark, seed, pct):
    texts = near_texts(seed, 220)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b])]
    want = least_of(sets, links)
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4), 5, pct, chunk_bytes=1500).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_blocks_hold_every_link_and_skip_the_rest(spark):
    """Every linked pair shares a block; sets too unlike in size for their position share none."""
    rng = random.Random(5)
    universe = sorted(rng.sample(range(1 << 40), 400))
    sets = [sorted(rng.sample(universe, rng.randrange(3, 60))) for _ in range(60)]
    for base in sets[:40]:  # near copies of other sizes
        for _ in range(2):
            own = set(base) - set(rng.sample(base, rng.randrange(0, max(1, len(base) // 8))))
            sets.append(sorted(own | set(rng.sample(universe, rng.randrange(0, max(1, len(base) // 8 + 1))))))
    df = Counter(x for s in sets for x in s)
    rows, plain = [], Counter()
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (min(df[x], 255), x))
        single = sum(df[x] == 1 for x in order)
        k = len(s) - -(-80 * len(s) // 100) + 1
        alone = min(single, k)
        rows.append((i.to_bytes(4, "big"), len(s), [alone, *order[alone:k]]))
        plain.update(order[alone:k])
    got = jaccard.index_blocks(spark.createDataFrame(rows, "sid binary, n long, prefix array<long>"), 80).collect()
    blocks = {}
    for r in got:
        blocks.setdefault((r.item, r.block), set()).add(int.from_bytes(r.sid, "big"))
        assert r.leader is not None
    assert all(len(b) > 1 for b in blocks.values())
    together = {(x, y) for b in blocks.values() for x in b for y in b if x < y}
    links = 0
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            a, b = set(sets[x]), set(sets[y])
            if 100 * len(a & b) >= 80 * len(a | b):
                links += 1
                assert (x, y) in together
    assert links > 40
    assert not any(min(len(sets[x]), len(sets[y])) * 1.5625 < max(len(sets[x]), len(sets[y])) for x, y in together)
    # entries read with and without blocks
    assert len(got) < sum(n for n in plain.values() if n > 1)


def test_jaccard_large_group_and_repeated_rows(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(60)] = f"u{i}"
        rows.append((i + 5, " ".join(w), "x", 1, 2))
    rows += rows[:3] + [(None, rows[0][1], "x", 1, 2), (900, "else", "x", 1, 2)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), chunk_bytes=4000).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_of(sets, links)
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else want[5]) for r in got)
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_have_equal_bytes_and_gapless_slots(spark, seed):
    rng = random.Random(seed)
    same = "copy " * 20
    texts = [None, "", "é🙂"] + [same if rng.random() < 0.35 else "x" * int(rng.paretovariate(1.2) * 40) + str(rng.random())
                                 for _ in range(3000)]
    rows = [(None if i == 5 else i // (2 if seed == 2 else 1), t, "x", 1, 2) for i, t in enumerate(texts)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS).repartition(5), 24).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    target, top = sum(load.values()) / 24, max(size(t) for t in texts)
    assert all(abs(load[s] - target) <= top + 0.06 * target for s in range(24))
    # equal texts share a shard unless they hold more than a twentieth of one
    by_text = {}
    for r in got:
        by_text.setdefault((r["size"], r.text_crc32), []).append(r.shard)
    assert all(len(set(v)) == 1 for (n, _), v in by_text.items() if n * len(v) <= 0.05 * target)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS), 24).count() == 0


def test_shards_are_cuts_of_the_sorted_rows(spark):
    """Against a plain sort: shards and slots follow it, and each cut lies at its share of the bytes."""
    rng = random.Random(14)
    texts = [rng.choice([None, "", "é" * rng.randrange(1, 40), "x" * rng.randrange(1, 900)]) for _ in range(1500)]
    texts += [rng.choice(texts[:200]) for _ in range(400)] + ["y" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    shards = 7
    got = {r.doc_id: r for r in sharding.shard_by_bytes(docs, shards).collect()}
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    order = [r.doc_id for r in docs.select("doc_id", key.alias("key")).orderBy("key", "doc_id").collect()]
    size = [len((t or "").encode()) + 8 for t in texts]
    target, below, at = sum(size) / shards, 0, (0, -1)
    groups = Counter()
    for i in order:
        groups[texts[i] or ""] += size[i]
    for i in order:
        here = (got[i].shard, got[i].slot)
        assert got[i]["size"] == size[i] and here in ((at[0], at[1] + 1), (at[0] + 1, 0))
        if here[0] > at[0]:
            assert abs(below - here[0] * target) <= 0.001 * target + max(groups.values())
        below, at = below + size[i], here
    assert at[0] == shards - 1


def test_identical_rows_are_still_split(spark):
    rows = [(1, "the very same row", "x", 1, 2)] * 2400
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DOCS).repartition(4), 24).collect()
    assert set(Counter(r.shard for r in got).values()) <= set(range(98, 103))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_shards_of_many_rows_keep_the_driver_bounded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAVES", 20480, raising=False)
    sent, create = [], type(spark).createDataFrame

    def counted(self, data, *a, **k):
        sent.append(len(data))
        return create(self, data, *a, **k)
    docs = spark.range(60000).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(4)
    monkeypatch.setattr(type(spark), "createDataFrame", counted)
    # with these limits every one of the first 4096 intervals is heavy
    got = sharding.shard_by_bytes(docs, 3, task_share=1 / 8192, least_rows=2).collect()
    assert max(sent) < 21000
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) < 200
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # by the defaults even intervals need no second look: only those of splitters are refined
    sent.clear()
    sharding.shard_by_bytes(docs, 3, least_rows=2).count()
    assert max(sent) < 4096 + 200


def test_url_rules_and_trees(spark):
    rng = random.Random(1)
    found = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "x://a.org", "x://org/", "http://a.com/de/1?x=/fr/",
             "http://b.com?u=http://c.org/es/", "a://É.COM/fr/", "http://notexample.org/en/1", "http://sub.example.org/en/12#a?b", "http://x.org:80/"]
    found += [f"https://h{rng.randrange(9)}.{rng.choice(['example', 'spam-farm'])}.{rng.choice(['com', 'org', 'net'])}/"
              f"{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randrange(999)}{rng.choice(['', '?a=1&b=2', '#t'])}" for _ in range(400)]
    rows = [(i, u, "h", "r") for i, u in enumerate(found)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    got = {r.page_id: r for r in urls.judge_urls(df, RULES).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(found):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    # held out: the labels of a third of the URLs are in neither the rates nor the fit
    hidden = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(3)) == 0
    judged = urls.judge_urls(df, RULES, max_labelled=120, hidden=hidden).join(df.select("page_id", hidden.alias("hidden")), "page_id")
    few = [r for r in judged.collect() if r.rule and r.hidden]
    assert len(few) > 60 and sum(r.predicted == r.verdict for r in few) >= 0.85 * len(few) and {r.predicted for r in few} == {"allow", "block"}
    only = urls.judge_urls(df.where("page_id = 6"), RULES).collect()
    assert only[0].verdict == "allow" and urls.judge_urls(df.where("false"), RULES).count() == 0


def test_url_statistics_cover_rows_beyond_the_fit_sample(spark):
    found = [f"http://h.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    first = df.orderBy(F.xxhash64("url")).first().url
    copies = spark.createDataFrame([(i, first) for i in range(1000, 1100)], "page_id long, url string")
    unruled = spark.createDataFrame([(2000 + i, f"http://h.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(20)], "page_id long, url string")
    # copies of one URL do not fill the sample
    got = {r.page_id: r for r in urls.judge_urls(df.union(copies).union(unruled), RULES, max_labelled=100).collect()}
    assert len(got) == 320 and all(got[2000 + i].verdict == ("block" if i % 2 else "allow") for i in range(20))
    # the rates count every labelled row
    labelled = df.union(copies).selectExpr("'com' as top", "'x' as second", "split(url, '/')[3] as segment",
                                           "if(url like '%/de/%', 1D, 0D) as y", "url").withColumn("fold", urls.fold_of(F.col("url")))
    counts = urls.suffix_counts(labelled)
    rates = {}
    for r in counts.collect():
        n, blocked = rates.get((r.suffix, r.value), (0, 0))
        rates[r.suffix, r.value] = (n + r.n, blocked + r.blocked)
    de = 100 + 100 * ("/de/" in first)
    assert rates == {("top", "com"): (300, de), ("second", "x"): (300, de), ("segment", "de"): (de, de), ("segment", "fr"): (300 - de, 0)}
    # a row's own fold is left out of its rates, its copies with it
    others = labelled.withColumns({c: F.lit(0.0) for c in urls.FEATURES if not c.endswith("_rate")})
    own = {r.url: r for r in urls.with_rates(others, counts, 0.5, True).collect()}
    rows = [(r.url, r.fold, r.y) for r in labelled.collect()]
    for u, f, _ in rows:
        left = [y for _, g, y in rows if g != f]
        assert own[u].top_rate == pytest.approx((sum(left) + 2.5) / (len(left) + 5))


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_near_vectors_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((30, 16))
    near = np.repeat(centre, 8, 0) + rng.standard_normal((240, 16)) * np.repeat(rng.uniform(0.02, 0.3, 30), 8)[:, None]
    all_vectors = np.concatenate([near, rng.standard_normal((200, 16)), near[:20], near[:5] * 3, np.repeat(centre[:1], 50, 0)]).astype("f4")
    rows = [(i * 3, v.tolist(), 1) for i, v in enumerate(all_vectors)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [float("inf")] + [1.0] * 15, 1),
           (5004, [], 1), (5005, [None] + [1.0] * 15, 1), (5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rep int").repartition(4)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, block_rows=block_rows).collect()}
    x = all_vectors.astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    a, b = np.nonzero(np.triu(cos >= 0.95, 1))
    # pairs within rounding of the threshold may go either way
    assert not ((cos > 0.95 - 1e-9) & (cos < 0.95 + 1e-9)).any()
    want = least_of([r[0] for r in rows], [(int(i) * 3, int(j) * 3) for i, j in zip(a, b)])
    links = Counter(np.concatenate([a, b]).tolist())
    assert sum(got[i * 3].n_links for i in range(len(x))) >= 0.999 * 2 * len(a)
    assert all(got[i * 3].n_links <= links[i] for i in range(len(x)))
    assert sum(got[k].component_id == v for k, v in want.items()) >= 0.99 * len(want)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(5000, 5006))
    assert got[5007].component_id == 5006 and got[5007].n_links == 1 and not got[5007].kept
    assert vectors.near_duplicates(df.where("false")).count() == 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_with_null_and_repeated_ids(spark):
    """One row per input row, whatever the ids; null ids come last."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near_a = [1.0, 0.05, 0.0]
    rows = [(1, a), (1, b), (2, near_a), (None, a), (None, c), (None, c), (7, b), (7, b), (None, None), (9, None), (9, None)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, root int").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True),
                           (7, 2, 1, False), (7, 2, 1, False), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)])


def test_block_pairs_are_those_within_the_gap(spark):
    import itertools
    rng = random.Random(6)
    blocks, at = [], -3.0
    for i in range(40):
        high = at + rng.choice([0.0, 0.01, 0.4, 2.0])
        blocks.append((3 if i % 4 else 5, float(i), at, high, rng.choice([1, 1, 3]), i))
        at = high + rng.choice([0.0, 0.3])
    df = spark.createDataFrame(blocks, "dim int, block double, low double, high double, parts int, number long")
    got = {}
    for r in vectors.block_pairs(df, 0.7).collect():
        got.setdefault((r.x, r.y), []).append((r.dim, r.block, r.part, r.side))
    parts = [(d, b, lo, hi, p) for d, b, lo, hi, n, _ in blocks for p in range(n)]
    want = [frozenset([(x[1], x[4]), (y[1], y[4])]) for x, y in itertools.combinations_with_replacement(parts, 2)
            if x[0] == y[0] and max(x[2], y[2]) - min(x[3], y[3]) <= 0.7]
    assert all(sorted(s for *_, s in v) == list(range(len(v))) for v in got.values())
    assert Counter(frozenset((b, p) for _, b, p, _ in v) for v in got.values()) == Counter(want)


def test_calibrated_count_reaches_its_recall():
    import math
    least = vectors.calibrated(24, 0.55, math.sqrt(0.1), 0.9999)
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.standard_normal((200_000, 24)) * math.sqrt(0.1)) <= 0.55).sum(1)
    assert (hits >= least).mean() >= 0.9998 and least > 10
