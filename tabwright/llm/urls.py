"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones: the trees learn from their verdicts (allow 0,
block 1) and decide the rest. Features are lengths, depth, digit ratio, character entropy,
parameter counts, and smoothed block rates of the host's suffixes and of the leading path segment
among all labelled rows. In the fit a URL's rates leave out its own fold (a hash of the URL), so no
label, its copies' included, is read back as a feature. Only the fit is sampled: it takes at most
``max_labelled`` distinct labelled URLs, those of the smallest hashes; every URL is parsed and judged.

Cases: a null url, or one without ``://``, has an empty host and path and no rule; ties and
repeated rows are judged each; labels of one class only give that class to all others, no labels
give ``allow``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("top", "second", "segment")
FOLDS = 5
FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "entropy", "params", "has_fragment",
            "hyphens", "n_last", *(f"{s}_rate" for s in SUFFIXES)]


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and rest (query and fragment) of ``url``."""
    at = F.instr(F.col(url), "://")
    after = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    df = pages.withColumn("__after", after)
    df = df.withColumn("host", F.translate(F.regexp_extract("__after", r"^[^/?#]*", 0), UPPER, LOWER)) \
        .withColumn("__tail", F.regexp_extract("__after", r"(?s)^[^/?#]*(.*)$", 1))
    return df.withColumn("path", F.regexp_extract("__tail", r"^[^?#]*", 0)) \
        .withColumn("rest", F.regexp_extract("__tail", r"(?s)^[^?#]*(.*)$", 1)).drop("__after", "__tail")


def apply_rules(parsed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add rule and rule_verdict: the longest rule (verdict, ``host/path``) that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, tail = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    chars = F.array_sort(F.split(text, ""))
    bits = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda s, c: s - F.size(F.filter(chars, lambda x: x == c)) / n * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(parsed: DataFrame) -> DataFrame:
    """Add the lexical features and the suffixes whose statistics the labelled rows give."""
    url = F.coalesce(F.col("url"), F.lit(""))
    labels = F.split("host", r"\.")
    segment = F.element_at(F.split("path", "/"), -1)
    return parsed.withColumns({
        "n_url": F.length(url), "n_host": F.length("host"), "n_path": F.length("path"),
        "depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "labels": F.size(labels),
        "digits": F.coalesce(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)), F.lit(0.0)),
        "entropy": entropy(F.concat("host", "path")),
        "params": F.when(F.col("rest").startswith("?"), 1 + F.length("rest") - F.length(F.translate("rest", "&", ""))).otherwise(0),
        "has_fragment": F.contains("rest", F.lit("#")).cast("int"),
        "hyphens": F.length(url) - F.length(F.translate(url, "-", "")),
        "n_last": F.length(segment),
        "top": F.element_at(labels, -1), "second": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "segment": F.get(F.split("path", "/"), F.lit(1))}).fillna({"segment": ""})


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, value, fold, n, blocked): labelled rows and blocked ones of each value of SUFFIXES, by the URL's fold."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), F.col(s).alias("value")) for s in SUFFIXES)))
    return labelled.select(each.alias("s"), "fold", "y").groupBy("s.suffix", "s.value", "fold") \
        .agg(F.count("*").alias("n"), F.sum("y").alias("blocked"))


def with_rates(df: DataFrame, counts: DataFrame, overall: float, out_of_fold: bool) -> DataFrame:
    """Add the smoothed block rate of each of SUFFIXES and the feature vector; with ``out_of_fold`` the
    counts of the row's own fold are left out."""
    for s in SUFFIXES:
        own = counts.where(F.col("suffix") == s).select(F.col("value").alias(s), "fold", "n", "blocked")
        total = own.groupBy(s).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        if out_of_fold:
            total = own.select(s, "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked")).join(total, s) \
                .select(s, "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("blocked") - F.col("own_blocked")).alias("blocked"))
        rate = total.select(s, *(["fold"] if out_of_fold else []), ((F.col("blocked") + 5 * overall) / (F.col("n") + 5)).alias(f"{s}_rate"))
        df = df.join(rate, [s, "fold"] if out_of_fold else s, "left").fillna({f"{s}_rate": overall})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], max_labelled: int = 50_000, trees: int = 20,
               depth: int = 4, seed: int = 7, hidden: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, predicted): ``verdict`` is the rule's, else ``predicted``,
    the trees' (each allow or block). URLs that are ``hidden`` teach nothing, neither in the fit nor
    in the rates: what is predicted for them is held out."""
    ruled = apply_rules(parse(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules)
    judged = lexical(ruled).withColumn("fold", fold_of(F.col("url")))
    out = ["page_id", "host", "path", "rule"]
    y = (F.col("rule_verdict") == "block").cast("double").alias("y")
    teaches = F.col("rule_verdict").isNotNull() & ~(F.lit(False) if hidden is None else hidden)
    counts = stage_table(suffix_counts(judged.where(teaches).select(*SUFFIXES, "fold", y)), "url-rates")
    kinds = counts.where(F.col("suffix") == "top").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    if not kinds.n or kinds.blocked in (0, kinds.n):
        only = "block" if kinds.n and kinds.blocked else "allow"
        return judged.select(*out, F.coalesce("rule_verdict", F.lit(only)).alias("verdict"), F.lit(only).alias("predicted"))
    overall = kinds.blocked / kinds.n
    # the rules judge a URL, so its copies have one verdict and teach once
    sample = ruled.where(teaches).select("url", "host", "path", "rest", y).dropDuplicates(["url"]) \
        .orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    sample = stage_table(lexical(sample).withColumn("fold", fold_of(F.col("url"))), "labelled-urls")
    model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed) \
        .fit(with_rates(sample, counts, overall, True).select("features", "y"))
    predicted = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return model.transform(with_rates(judged, counts, overall, False)) \
        .select(*out, F.coalesce("rule_verdict", predicted).alias("verdict"), predicted.alias("predicted"))
