"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Everything is a DataFrame expression. Spans of a pattern come from the matches and from the pieces
between them: the running sum of piece and match lengths gives each match's place in code points.

The battery looks at every maximal run of `[A-Za-z0-9+/_-]` of at least ``min_length`` characters
that mixes letters and digits, infers its encoding (hexadecimal, base 32, base 36, base 62, base 64)
and asks whether its symbols look drawn evenly and independently from that alphabet: a chi-squared
test of uniformity over alphabet parts, a runs test about the alphabet's middle, and the lag-one
serial correlation, combined by Fisher's method. A run that is not random by these at ``p_battery``
is left alone.

Reported are the others that are no natural text or identifier either. That null hypothesis is
learned from the table: the distinct words of its texts give the chances of letter pairs and the
word length, and a list of common words gives them again for identifiers in a table of other
languages. A run's letter pairs are held against these chances, and its changes between upper case,
lower case and digits against the word length; the words that explain the run best count. A Benjamini-Hochberg step within each encoding and length class holds the share of natural
runs among the reported ones at ``alpha``: no run with a greater p-value is reported, whatever
else is in the table. Its histogram of p-values has a fixed number of cells per class.

The scan itself is a projection: the limits of the classes and the pair chances are constants in
it, so no text, span or row is shuffled.

Cases: a null text counts as empty and has no spans; repeated rows are scanned each; other columns
are ignored. One text is scanned whole in one task, however long.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a class run is maximal, so its minimum length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]

# fixed values: symbols of each encoding in the order of their values
HEXA = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PARTS = 8
P_CELLS = 4000
SPANS = "array<struct<kind:string,s:int,e:int,v:string>>"
# fixed values: common English words and parts of identifiers
COMMON_WORDS = """about after all and are back because been before being between both but can come could data day did
each even every find first for from get give good great had has have her here him his how into its just know large last
like long look made make many may more most much must name new not now number off old one only open other our out over own
part people place point right said same see set should show side small some state such system take than that the their them
then there these they thing think this those three through time total two under until use value very want was water way well
were what when where which while who will with word work world would write year you your account action class client config
count create default error event field file filter format handler http image index item key label level line list load map
message method model node object option order page param path process query report request response result server service
session source start status string table test text token type update user version view""".split()


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, kind: str, min_group: int = 0) -> Column:
    """Array of (kind, start, end, value) of the pattern's matches; with ``min_group`` only those
    whose second group has that many characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if min_group:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    else:
        value = found
    pieces = F.split(text, pattern, -1)
    rows = F.zip_with(F.slice(pieces, 1, F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")),
                      lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m["m"]).alias("len"),
                                                m["v"].alias("v")))
    start = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,s:int,e:int,v:string>>").alias("out")),
        lambda acc, r: F.struct(
            (acc["at"] + r["gap"] + r["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + r["gap"]).alias("s"),
                (acc["at"] + r["gap"] + r["len"]).alias("e"), r["v"].alias("v")))).alias("out")),
        lambda acc: acc["out"])
    empty = F.array().cast("array<struct<kind:string,s:int,e:int,v:string>>")
    out = F.when(text.rlike(pattern), start).otherwise(empty)
    return F.filter(out, lambda x: F.length(x["v"]) >= min_group) if min_group else out


def base_spans(text: Column) -> Column:
    """Spans of the three patterns."""
    return F.concat(spans(text, ASSIGN, "assign", 12), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))


def candidates(text: Column, min_length: int) -> Column:
    """The runs that the battery will test."""
    return F.filter(spans(text, r"[A-Za-z0-9+/_-]{%d,}" % min_length, "random"),
                    lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic form of a fifth-degree fit; relative error under 2 % for |z| < 8."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _between(low: Column, high: Column):
    return lambda i: (i >= low) & (i < high)


def encoding_of(v: Column) -> Column:
    """Name of the smallest alphabet that holds ``v``; null if none does."""
    return (F.when(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$"), "hex")
            .when(v.rlike("^[A-Z2-7]+$"), "base32").when(v.rlike("^[a-z2-7]+$"), "base32-lower")
            .when(v.rlike("^[a-z0-9]+$"), "base36").when(v.rlike("^[A-Z0-9]+$"), "base36-upper")
            .when(v.rlike("[a-z]") & v.rlike("[A-Z]"), F.when(v.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")))


def p_random(v: Column, encoding: Column) -> Column:
    """Chance of symbols as uneven or dependent as those of ``v`` if they were drawn from its alphabet."""
    base32, base36 = encoding.startswith("base32"), encoding.startswith("base36")
    size = F.when(encoding == "hex", 16).when(base32, 32).when(base36, 36).when(encoding == "base62", 62).otherwise(64)
    symbols = F.when(encoding == "hex", F.lit(HEXA)).when(base32, F.lit(BASE32)).when(base36, F.lit(BASE36)) \
        .otherwise(F.lit(BASE62 + "+/"))
    plain = F.when((encoding == "hex") | base36, F.lower(v)).when(base32, F.upper(v)) \
        .when(encoding == "base64", F.translate(v, "-_", "+/")).otherwise(v)
    places = bind(F.struct(plain.alias("v"), symbols.alias("of")), lambda p: F.filter(
        F.transform(F.split(p["v"], ""), lambda c: F.instr(p["of"], c) - 1), lambda i: i >= 0))
    return bind(F.struct(places.alias("x"), size.alias("size")), lambda t: _fisher(t["x"], t["size"]))


def _fisher(x: Column, size: Column) -> Column:
    """Three tests of the places ``x`` in an alphabet of ``size`` symbols, combined."""
    n = F.size(x).cast("double")
    # uniformity: PARTS parts of the alphabet, whose shares differ when its size is no multiple
    chi = F.lit(0.0)
    for part in range(PARTS):
        low, high = F.ceil(size * part / PARTS), F.ceil(size * (part + 1) / PARTS)
        seen = F.size(F.filter(x, _between(low, high)))
        want = n * (high - low) / size
        chi = chi + (seen - want) * (seen - want) / want
    k = PARTS - 1
    p_uniform = bind(chi, lambda c: upper_tail((F.pow(c / k, 1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))))
    # runs about the middle
    side = F.transform(x, lambda i: i * 2 >= size)
    inner = F.sequence(F.lit(1), F.size(x) - 1)

    def runs_test(t: Column) -> Column:
        above, runs = t["above"], t["runs"]
        mid = 1 + 2 * above * (n - above) / n
        var = (mid - 1) * (mid - 2) / (n - 1)
        return F.when(var > 0, (runs - mid) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(8.0))
    changes = bind(side, lambda s: F.struct(
        F.size(F.filter(s, lambda b: b)).cast("double").alias("above"),
        (1.0 + F.size(F.filter(inner, lambda i: F.get(s, i) != F.get(s, i - 1)))).alias("runs")))
    p_runs = bind(bind(changes, runs_test), lambda z: 2 * upper_tail(F.abs(z)))
    # lag-one serial correlation
    mean = F.aggregate(x, F.lit(0.0), lambda s, i: s + i) / n
    dev = bind(mean, lambda m: F.transform(x, lambda i: i - m))

    def serial(d: Column) -> Column:
        square = F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v)
        lagged = F.aggregate(inner, F.lit(0.0), lambda s, i: s + F.get(d, i) * F.get(d, i - 1))
        return F.when(square > 0, (lagged / square + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
    p_serial = bind(bind(dev, serial), lambda z: 2 * upper_tail(F.abs(z)))
    floor = F.lit(1e-15)
    half = -sum(F.ln(F.greatest(p, floor)) for p in (p_uniform, p_runs, p_serial))
    # Fisher: -2 sum(ln p) is chi-squared with six degrees of freedom, whose tail has a closed form
    return bind(half, lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2)))


@dataclass
class Natural:
    """What words look like: ln of 26 times the chance of each letter after each other (26 x 26), its
    mean and deviation over the words' pairs, and the share of places where a word ends."""
    gain: list[float]
    mean: float
    deviation: float
    change: float


def letter_pairs(docs: DataFrame) -> dict[tuple[int, int], int]:
    """Letter pairs of the distinct words of all texts, lower-cased; (-1, n) counts words of n letters.

    Words are `[A-Za-z][a-z]+` of at most 20 letters between characters that are no letter or digit, so
    keys that mix cases or digits are none. At most 26 * 26 + 20 rows reach the driver."""
    word = F.explode(F.array_distinct(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[^A-Za-z0-9+/_-]+"))).alias("w")
    words = docs.select(word).where(F.col("w").rlike("^[A-Za-z][a-z]{1,19}$")).select(F.lower("w").alias("w")).distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.struct(
        (F.ascii(F.substr(F.col("w"), i, F.lit(1))) - 97).alias("a"), (F.ascii(F.substr(F.col("w"), i + 1, F.lit(1))) - 97).alias("b")))
    each = F.explode(F.concat(pairs, F.array(F.struct(F.lit(-1).alias("a"), F.length("w").alias("b"))))).alias("p")
    return {(r.a, r.b): r.n for r in words.select(each).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect()}


def natural(pairs: dict[tuple[int, int], int]) -> Natural:
    """Words with these pairs, and COMMON_WORDS."""
    seen = Counter({k: n for k, n in pairs.items()})
    for w in COMMON_WORDS:
        seen[-1, len(w)] += 1
        seen.update((ord(x) - 97, ord(y) - 97) for x, y in zip(w, w[1:]))
    after = [sum(seen[a, b] for b in range(26)) for a in range(26)]
    gain = [math.log(26 * (seen[a, b] + 0.5) / (after[a] + 13)) for a in range(26) for b in range(26)]
    total = sum(after)
    mean = sum(seen[i // 26, i % 26] * g for i, g in enumerate(gain)) / total
    deviation = math.sqrt(sum(seen[i // 26, i % 26] * (g - mean) ** 2 for i, g in enumerate(gain)) / total)
    words = {b: n for (a, b), n in seen.items() if a == -1}
    return Natural(gain, mean, deviation, sum(words.values()) / sum(b * n for b, n in words.items()))


def p_natural(v: Column, kinds: list[Natural]) -> Column:
    """Chance of letter pairs as rare and of as many changes of case and to or from digits as those of
    ``v`` if it were made of words; of several kinds of words the one that explains it best counts."""
    return F.greatest(F.lit(0.0), *(_p_words(v, words) for words in kinds))


def _p_words(v: Column, words: Natural) -> Column:
    gain = F.array(*map(F.lit, words.gain))
    kind = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
    symbols = F.transform(F.split(v, ""), lambda c: F.struct(kind(c).alias("k"), (F.ascii(F.lower(c)) - 97).alias("i")))

    def count(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            before, here = F.get(x, i - 1), F.get(x, i)
            # pairs inside a word: lower case after a letter, or upper case after upper case
            pair = ((before["k"] <= 1) & (here["k"] == 0)) | ((before["k"] == 1) & (here["k"] == 1))
            change = (before["k"] != here["k"]) & (before["k"] < 3) & (here["k"] < 3) & ~((before["k"] == 1) & (here["k"] == 0))
            return F.struct((acc["sum"] + F.when(pair, F.get(gain, before["i"] * 26 + here["i"])).otherwise(0.0)).alias("sum"),
                            (acc["m"] + pair.cast("int")).alias("m"), (acc["c"] + change.cast("int")).alias("c"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("m"), F.lit(0).alias("c")), step)

    def tail(t: Column) -> Column:
        places = F.length(v) - 1
        z_pairs = F.when(t["m"] > 0, (t["m"] * words.mean - t["sum"]) / (words.deviation * F.sqrt(F.greatest(t["m"], F.lit(1)))))
        z_change = (t["c"] - 0.5 - places * words.change) / F.sqrt(places * words.change * (1 - words.change))
        logs = [-F.ln(F.greatest(upper_tail(F.coalesce(z, F.lit(-8.0))), F.lit(1e-15))) for z in (z_pairs, z_change)]
        return bind(logs[0] + logs[1], lambda h: F.least(F.lit(1.0), F.exp(-h) * (1 + h)))
    return bind(bind(symbols, count), tail)


def _tested(tokens: Column, words: list[Natural], p_battery: float) -> Column:
    """(kind, s, e, v, class, cell) of the tokens that pass the battery: their encoding and length class,
    and the cell of -log10 of p_natural."""
    def test(x: Column) -> Column:
        v = x["v"]
        encoding = bind(encoding_of(v), lambda e: F.when(e.isNotNull() & (p_random(v, e) >= p_battery), e))
        cell = F.least(F.floor(-F.log10(F.greatest(p_natural(v, words), F.lit(1e-40))) * 100), F.lit(P_CELLS)).cast("int")
        return bind(encoding, lambda e: F.when(e.isNotNull(), F.struct(
            *(x[c].alias(c) for c in ("kind", "s", "e", "v")),
            F.concat_ws(" ", e, F.floor(F.log2(F.length(v)) * 2)).alias("class"), cell.alias("cell"))))
    return F.filter(F.transform(tokens, test), lambda x: x.isNotNull())


@dataclass
class Learned:
    """What the scan of a row needs: the kinds of words and the least cell of each class."""
    words: list[Natural]
    limits: dict[str, int]
    min_length: int
    p_battery: float


def learn(docs: DataFrame, min_length: int = 16, alpha: float = 0.001, p_battery: float = 0.001) -> Learned:
    """Two passes over ``docs``: the words, then the p-values of all tokens by class. The step-up within
    a class reads at most P_CELLS counts."""
    words = [natural(letter_pairs(docs)), natural({})]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tested = docs.select(F.explode(_tested(candidates(text, min_length), words, p_battery)).alias("t")).select("t.class", "t.cell")
    cells: dict[str, dict[int, int]] = {}
    for r in tested.groupBy("class", "cell").agg(F.count("*").alias("n")).collect():
        cells.setdefault(r["class"], {})[r["cell"]] = r["n"]
    limits = {}
    for name, own in cells.items():
        rank, total = 0, sum(own.values())
        for cell in sorted(own, reverse=True):
            rank += own[cell]
            if 10 ** (-cell / 100) <= alpha * rank / total:
                limits[name] = cell
    return Learned(words, limits, min_length, p_battery)


def all_spans(text: Column, base: Column, learned: Learned) -> Column:
    """``base`` with the random runs added."""
    if not learned.limits:
        return base
    limits = F.create_map(*(F.lit(x) for item in sorted(learned.limits.items()) for x in item))
    found = F.filter(_tested(candidates(text, learned.min_length), learned.words, learned.p_battery),
                     lambda x: F.coalesce(x["cell"] >= F.try_element_at(limits, x["class"]), F.lit(False)))
    return F.concat(base, F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "s", "e", "v")))))


def scan(docs: DataFrame, min_length: int = 16, alpha: float = 0.001, learned: Learned | None = None) -> DataFrame:
    """(doc_id, row, base, spans): arrays of (kind, s, e, v), ``spans`` with the random runs added.

    ``row`` is xxhash64 of the text; rows that agree in both are each returned."""
    learned = learned or learn(docs, min_length, alpha)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), text.alias("text"))
    return keyed.withColumn("base", base_spans(F.col("text"))) \
        .select("doc_id", "row", "base", all_spans(F.col("text"), F.col("base"), learned).alias("spans"))


def written(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.transform(found, lambda x: F.struct(
        x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["e"].alias("e"),
        x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the spans replaced by ``mark``; overlapping spans become one."""
    cut = F.aggregate(
        F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out")))
    return F.when(F.size(found) > 0, F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))).otherwise(text)
