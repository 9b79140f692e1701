"""The pipeline against a brute-force version of its stages, and the registered queries."""

import random
import re
from itertools import combinations

import public_tokenizers as P

import corpus_pipeline
from test_llm_pairs import least_of, shingles
from test_llm_text import brute_lines, brute_repetition, brute_secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(55)
    base = ["\n".join(line(rng.randrange(8, 30)) for _ in range(rng.randrange(2, 6))) for _ in range(25)]
    out = [None, "", "short text", "spam " * 50, *base]
    out += [base[0], base[1], base[2] + "\n" + line(3)]  # exact copies, and one with a tail
    for i in range(3, 9):  # near copies
        w = base[i].split(" ")
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [line(20) + "\n" + passage + "\n" + line(20) for _ in range(4)]
    out += [line(30) + "\npassword = 'hunter2hunter2'\n" + line(5) + " AKIA" + "ABCD1234EFGH5678" + " " + line(4)]
    return list(enumerate(out, 100))


def brute_pipeline(rows):
    kept = {}
    for i, t in rows:
        n, _, _, _, repeat, longest = brute_repetition(t)
        if n >= 20 and 100 * repeat <= 30 * n and longest <= 40:
            kept[i] = t
    ids = sorted(kept)
    cut = dict(zip(ids, brute_lines([kept[i] for i in ids], 40).values()))
    kept = {i: t for i, t in cut.items() if t == kept[i] or t.strip()}
    sets = {i: shingles(t) for i, t in kept.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = least_of(sets, links)
    out = {}
    for i, t in kept.items():
        if root[i] == i:
            spans = [(int(s), int(e)) for s, e in re.findall(r":(\d+):(\d+)", brute_secrets(t))]
            for s, e in sorted(spans, reverse=True):
                t = t[:s] + "[SECRET]" + t[e:]
            out[i] = t
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in corpus()]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in brute_pipeline(corpus()).items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == want
    for i, n in want.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == n
    # every copy and near copy went, and so did the repeats of the passage
    assert len(want) < 40 and not {100, 101, 102, 103} & set(want)


def test_stages_survive_odd_tables(spark):
    odd = [(None, None, None, None, None), (None, "word " * 30, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
           (2, "a b c " * 20000, "en", "s", 1), (3, " ".join(f"w{i}" for i in range(40)), None, None, 7),
           (3, " ".join(f"w{i}" for i in range(40)), None, None, 7)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, DOCS + ", row string").drop("row") if not rows else spark.createDataFrame(rows, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, None)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
        # the two equal rows of document 3 are one document to the pair stages and both stay
        assert {p.doc_id for p in left} == ({3} if rows else set())


def test_stages_ignore_other_columns(spark):
    names = ["row_id", "row_text", "n", "kept", "spans", "hit", "n_words", "longest_repeat", "run_spans", "root", "row", "least", "first"]
    rows = [(i, t, "en", "s", 1) for i, t in corpus()]
    plain = spark.createDataFrame(rows, DOCS).repartition(2)
    more = plain.selectExpr("*", *(f"'x' as {n}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, None), stage(spark, more, None)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), name


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(3)
    texts = [" ".join(f"t{g}w{rng.randrange(10 ** 6)}" for _ in range(60)) for g in range(6)]
    near = lambda g: texts[g] + f" tail{rng.randrange(10 ** 6)}"
    rows = [(None, near(0)) for _ in range(4)]  # null ids
    rows += [(5, near(1)) for _ in range(4)] + [(5, near(2)) for _ in range(3)]  # equal ids, two groups
    rows += [(6, texts[3])] * 5 + [(None, texts[4])] * 5  # repeated rows
    rows += [(None, near(5)), (9, near(5)), (8, near(5)), (8, near(5))]  # a null id is last
    rows += [(None, None), (None, None), (7, "")]  # no shingles, no copies
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)
    got = corpus_pipeline.stages.ngram_jaccard(spark, docs, None)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = got.collect()
    assert sorted(r.text.split("w")[0] for r in left if r.text) == [f"t{g}" for g in range(6)]
    ids = {r.text[:2]: r.doc_id for r in left if r.text}
    assert ids == {"t0": None, "t1": 5, "t2": 5, "t3": 6, "t4": None, "t5": 8} and sum(not r.text for r in left) == 3
    assert all((r.doc_id, r.text) == rows[int(r.source[1:])] for r in left)


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
