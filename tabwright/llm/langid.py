"""Language identification, word first with backoff to shorter character n-grams.

A word is the letters of a white-space separated token, lower-cased. Training counts words by
language over all training texts; a known word scores its smoothed log frequency in each language.
A word unseen in training scores the mean log frequency of its longest character n-grams that
training words contain, from ``longest`` down to single characters. A document scores the sum over
its words. Tasks keep documents as numbers of a chunk's distinct words; only those distinct words
are shuffled, packed by a hash of the word, and the task of a hash bucket sends the merged counts
back to the chunks. N-gram counts are a table of 64-bit hashes that grows with the corpus; the
n-grams of unseen words alone are joined to it, longest first, and shorter ones only of words that
had no match.

Cases: a null text, or one without a letter, is ``und`` with score 0; if training has no language
every text is ``und``; a text none of whose words or characters was seen takes the language with
the most training words; repeated rows are judged each; other columns are ignored. A
chunk holds one whole text at least, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import (bucket_count, chunk_name, common_first, encode, ids_and_nulls, ids_array, pack_ints, pack_words,
                                  stage_table, text_buffers, text_slices, unpack_ints, unpack_words, word_buckets, words)

CHUNK_BYTES = 16 << 20
TOTALS = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
GRAMS = pa.list_(pa.struct([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(c for c in token if c.isalpha()).lower()


def coded(part: pa.RecordBatch):
    """Codes of the words in place, distinct words, and the documents' offsets."""
    word, offs = words(*text_buffers(part.column("text")))
    raw_codes, raw = encode(word)
    codes, vocab = encode(pa.array([letters(w) for w in raw.to_pylist()], pa.string()))
    codes = codes[raw_codes] if len(raw_codes) else np.zeros(0, np.int64)
    solid = (pc.utf8_length(vocab).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    ends = np.append(0, np.cumsum(solid))
    codes, vocab = common_first(codes[solid], vocab)
    return codes, vocab.cast(pa.binary()).to_pylist(), ends[offs]


def chunk_words(docs: DataFrame, buckets: int, chunk_bytes: int) -> DataFrame:
    """(to_chunk, bucket, places, words, langs, counts) of (doc_id, text, train_lang): the distinct
    words of each chunk and their counts by training language, packed by bucket."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, vocab, offs = coded(part)
            lang, langs = encode(part.column("train_lang"))
            of_word = np.repeat(np.nan_to_num(lang.astype(float), nan=-1).astype(np.int64), np.diff(offs))
            learned = of_word >= 0
            counts = np.bincount(codes[learned] * len(langs) + of_word[learned], minlength=len(vocab) * len(langs)) \
                .reshape(len(vocab), len(langs))
            chunk, names = chunk_name(part), langs.cast(pa.string()).to_pylist()
            rows = [(bucket, pack_ints(np.diff(at, prepend=0)), pack_words([vocab[i] for i in at.tolist()]),
                     names, pack_ints(counts[at].ravel())) for bucket, at in word_buckets(vocab, buckets)]
            for a in range(0, len(rows), 4096):
                some = list(zip(*rows[a:a + 4096]))
                yield pa.record_batch([
                    pa.array([chunk] * len(some[0]), pa.int64()), pa.array(some[0], pa.int64()), pa.array(some[1], pa.binary()),
                    pa.array(some[2], pa.binary()), pa.array(some[3], pa.list_(pa.string())), pa.array(some[4], pa.binary())],
                    names=["to_chunk", "bucket", "places", "words", "langs", "counts"])
    return docs.mapInArrow(run, "to_chunk long, bucket long, places binary, words binary, langs array<string>, counts binary")


def chunk_places(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, payload, vocab): the documents of each chunk as numbers of its words, and the words."""
    def run(batches):
        for part in text_slices(batches, chunk_bytes):
            codes, vocab, offs = coded(part)
            blob = pack_ints(*ids_and_nulls(part), part.column("held_out").to_numpy(zero_copy_only=False), offs, codes)
            yield pa.record_batch([pa.array([chunk_name(part)], pa.int64()), pa.array([blob], pa.binary()),
                                   pa.array([pack_words(vocab)], pa.binary())], names=["chunk", "payload", "vocab"])
    return docs.mapInArrow(run, "chunk long, payload binary, vocab binary")


def word_grams(vocab: list[bytes], longest: int):
    """(n, word, gram) for n from 1 to ``longest``: the hashes of all n-grams of the marked words."""
    text = "".join(f"<{w.decode()}>" for w in vocab)
    lens = np.array([len(w.decode()) + 2 for w in vocab], np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(vocab)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(points))  # characters from here to the word's end
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(longest, len(points)) + 1):
            h[:len(points) - n + 1] = (h[:len(points) - n + 1] + points[n - 1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            ok = left >= n
            yield n, word[ok], h[ok].view(np.int64)


def merged_counts(docs: DataFrame, longest: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """Per bucket: replies to the chunks (to_chunk, places, langs, counts), counts being over all
    training texts, with the places and numbers of their unseen words; and on the bucket's first row
    its word totals, n-gram counts and unseen words."""
    def merge(group):
        langs = sorted({x for row in group.column("langs").to_pylist() for x in row})
        number: dict[bytes, int] = {}
        asked = []
        to = [np.cumsum(unpack_ints(x)[0]) for x in group.column("places").to_pylist()]
        for blob, own, counts in zip(*(group.column(c).to_pylist() for c in ("words", "langs", "counts"))):
            at = np.array([number.setdefault(w, len(number)) for w in unpack_words(blob)], np.int64)
            asked.append((at, [langs.index(x) for x in own], unpack_ints(counts)[0].reshape(len(at), len(own))))
        total = np.zeros((len(number), len(langs)), np.int64)
        for at, own, counts in asked:
            total[at[:, None], own] += counts
        known = np.flatnonzero(total.any(1))
        vocab = list(number)
        grams, totals = [], []
        if len(known):
            totals = [{"lang": x, "n": int(n)} for x, n in zip(langs, total.sum(0))]
            for size, word, gram in word_grams([vocab[i] for i in known], longest):
                for k, x in enumerate(langs):
                    # a word counts once per language, so rare words weigh as much as common ones
                    some, n = np.unique(gram[(total[known, k] > 0)[word]], return_counts=True)
                    grams.append({"lang": x, "size": size, "gram": some.tolist(), "n": n.tolist()})
        open_ = ~total.any(1)
        number_of = np.cumsum(open_) - 1
        unseen = [vocab[i] for i in np.flatnonzero(open_)]
        rest = len(asked) - 1
        return pa.table({
            "bucket": group.column("bucket").combine_chunks(),
            "to_chunk": group.column("to_chunk").combine_chunks(), "places": group.column("places").combine_chunks(),
            "langs": pa.array([langs] * len(asked), pa.list_(pa.string())),
            "counts": pa.array([pack_ints(total[at].ravel()) for at, _, _ in asked], pa.binary()),
            "asks": pa.array([pack_ints(np.diff(p[open_[at]], prepend=0), number_of[at][open_[at]]) if open_[at].any() else None
                              for (at, _, _), p in zip(asked, to)], pa.binary()),
            "unseen": pa.array([pack_words(unseen) if unseen else None] + [None] * rest, pa.binary()),
            "totals": pa.array([totals] + [[]] * rest, TOTALS), "grams": pa.array([grams] + [[]] * rest, GRAMS)})

    return chunk_words(docs, bucket_count(docs, bucket_bytes), chunk_bytes).groupBy("bucket").applyInArrow(
        merge, "bucket long, to_chunk long, places binary, langs array<string>, counts binary, asks binary, unseen binary, "
               "totals array<struct<lang:string,n:long>>, grams array<struct<lang:string,size:int,gram:array<long>,n:array<long>>>")


def unseen_rates(merged: DataFrame, langs: list[str], longest: int, alpha: float) -> DataFrame:
    """(bucket, number, rates) of the unseen words with a known n-gram: the mean log frequency by
    language of the longest ones."""
    each = merged.select(F.explode("grams").alias("g")).select("g.lang", "g.size", F.explode(F.arrays_zip("g.gram", "g.n")).alias("c"))
    grams = stage_table(each.groupBy("size", "c.gram").agg(*(
        F.sum(F.when(F.col("lang") == x, F.col("c.n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs))), "lang-grams")
    sums = {r["size"]: r for r in grams.groupBy("size").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(langs)))).collect()}

    def spread(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("unseen").to_pylist()):
                vocab = unpack_words(blob)
                for a in range(0, len(vocab), 1 << 16):
                    some = vocab[a:a + (1 << 16)]
                    yield pa.record_batch([pa.array([bucket] * len(some), pa.int64()), pa.array(range(a, a + len(some)), pa.int64()),
                                           pa.array(some, pa.binary())], names=["bucket", "number", "word"])

    def cut(size: int):
        def run(batches):
            for batch in batches:
                for n, word, gram in word_grams(batch.column("word").to_pylist(), size):
                    if n == size:
                        at = pa.array(word)
                        yield pa.record_batch([batch.column("bucket").take(at), batch.column("number").take(at), pa.array(gram)],
                                              names=["bucket", "number", "gram"])
        return run
    left = stage_table(merged.where("unseen is not null").select("bucket", "unseen")
                       .mapInArrow(spread, "bucket long, number long, word binary"), "lang-unseen")
    out = None
    for size in sorted(sums, reverse=True):
        rates = [F.avg(F.ln((F.col(f"n{k}") + alpha) / (sums[size][f"n{k}"] + 1.0))) for k in range(len(langs))]
        hit = stage_table(left.mapInArrow(cut(size), "bucket long, number long, gram long")
                          .join(grams.where(F.col("size") == size), "gram").groupBy("bucket", "number")
                          .agg(F.array(*rates).alias("rates")), "lang-backoff")
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit, ["bucket", "number"], "left_anti")
    return out


def answered(merged: DataFrame, rates: DataFrame) -> DataFrame:
    """(to_chunk, places, rates): the rates of each chunk's unseen words."""
    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"to_chunk": pa.array([], pa.int64()), "places": pa.array([], pa.binary()), "rates": pa.array([], pa.binary())})
        number = right.column("number").to_numpy()
        values = right.column("rates").combine_chunks()
        values = values.flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1)
        row = np.full(int(number.max()) + 1, -1)
        row[number] = np.arange(len(number))
        out = []
        for chunk, blob in zip(left.column("to_chunk").to_pylist(), left.column("asks").to_pylist()):
            gaps, asked = unpack_ints(blob)
            at = np.where(asked < len(row), row[np.minimum(asked, len(row) - 1)], -1)
            out.append((chunk, pack_ints(np.diff(np.cumsum(gaps)[at >= 0], prepend=0)), values[at[at >= 0]].tobytes()))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("to_chunk", "places", "rates"), zip(*out),
                                                              (pa.int64(), pa.binary(), pa.binary()))})
    return merged.where("asks is not null").select("bucket", "to_chunk", "asks").groupBy("bucket") \
        .cogroup(rates.groupBy("bucket")).applyInArrow(run, "to_chunk long, places binary, rates binary")


def identify(docs: DataFrame, train_lang: Column, held_out: Column, longest: int = 4, alpha: float = 0.1,
             chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). ``train_lang`` is the label of documents to learn from
    and null for all others; it has no part in a prediction."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       train_lang.cast("string").alias("train_lang"), held_out.alias("held_out"))
    merged = stage_table(merged_counts(docs, longest, chunk_bytes, bucket_bytes), "lang-counts")
    totals = {r.lang: r.n for r in merged.select(F.explode("totals").alias("t")).groupBy("t.lang")
              .agg(F.sum("t.n").alias("n")).collect() if r.n}  # one row per language
    langs = sorted(totals)
    first = max(langs, key=lambda x: (totals[x], x), default="und")
    replies = merged.select("to_chunk", "places", "langs", "counts")
    if langs:
        replies = replies.unionByName(answered(merged, unseen_rates(merged, langs, longest, alpha)), allowMissingColumns=True)
    else:
        replies = replies.withColumn("rates", F.lit(None).cast("binary"))
    sizes = np.array([totals[x] for x in langs], float)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def place(left, right):
        rows = []
        for blob, words_blob in zip(left.column("payload").to_pylist(), left.column("vocab").to_pylist()):
            ids, nulls, held, offs, codes = unpack_ints(blob)
            vocab = unpack_words(words_blob)
            counts = np.full((len(vocab), len(langs)), -1.0)
            backoff = np.zeros((len(vocab), len(langs)))
            for places, own, n, rates in zip(*(right.column(c).to_pylist() for c in ("places", "langs", "counts", "rates"))):
                at = np.cumsum(unpack_ints(places)[0])
                if rates is not None:
                    backoff[at] = np.frombuffer(rates).reshape(len(at), len(langs))
                    continue
                part = np.zeros((len(at), len(langs)))
                for k, x in enumerate(own):
                    if x in totals:
                        part[:, langs.index(x)] = unpack_ints(n)[0].reshape(len(at), len(own))[:, k]
                counts[at] = part
            if len(codes) and langs and (counts[:codes.max() + 1] < 0).any():
                raise RuntimeError("a chunk's words were not all answered: the input changed between two reads")
            by_code = np.log((np.maximum(counts, 0) + alpha) / (sizes + 1))
            unseen = np.flatnonzero(~(counts > 0).any(1))
            by_code[unseen] = backoff[unseen]
            n = len(ids)
            sums = np.zeros((n, len(langs)))
            for i in range(len(langs)):
                ends = np.append(0.0, np.cumsum(by_code[codes, i]))
                sums[:, i] = ends[offs[1:]] - ends[offs[:-1]]
            lettered = np.diff(offs) > 0
            if langs:
                names = np.array(langs, object)[sums.argmax(1)]
                odds = np.exp(sums - sums.max(1, keepdims=True))
                share = odds.max(1) / odds.sum(1)
                names[(sums == sums[:, :1]).all(1)] = first
            else:
                names, share = np.full(n, "und", object), np.zeros(n)
            names[~lettered] = "und"
            share = np.where(lettered, share, 0.0)
            rows.append(pa.record_batch([ids_array(ids, nulls), pa.array(held.astype(bool)), pa.array(names.tolist(), pa.string()),
                                         pa.array(share)], schema=schema))
        return pa.Table.from_batches(rows, schema)

    return chunk_places(docs, chunk_bytes).groupBy("chunk") \
        .cogroup(replies.groupBy("to_chunk")) \
        .applyInArrow(place, "doc_id long, held_out boolean, lang_pred string, score double")
