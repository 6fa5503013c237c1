"""Operator 2: URL filter.  Explicit rules decide where one fits; gradient-boosted
trees over lexical features decide the rest.

Native: host, path, rules and features are SQL expressions; the trees are Spark's
own ``GBTClassifier``, trained on about ``TRAIN_BOUND`` labelled URLs, chosen by hash of URL and id; of the
rarer kind of label it has half as many, or all, so that both kinds are there at every size.  Weights bring the
kinds back to the table's shares, but not below one in ``LEAST_SHARE``: the trees could not tell a kind of
less weight, and ``block_probability`` is relative to that share.  A URL is
labelled by the rule that fits it if that is for a whole host (one for a part of a host's paths
says nothing about the host, and URLs that it fits train nothing); where none fits, as "block" if its host has a known bad
word (``BAD_WORDS``) and as presumed "allow" if not.

A presumed label must not decide about its own host, or the trees would learn that every bad
host whose word is not listed is good.  So hosts with presumed labels are dealt by their last
three parts into ``FOLDS``; for each fold there are trees trained without it, and they judge it.
URLs with a known label train all of the trees and are judged by their mean.  What
this doesn't reach: presumed bad hosts of the other folds, such as the same name with another ending, still
count as good there.  Suffix statistics are the smoothed log-odds of "block" per host
suffix among the training URLs; unseen suffixes have the prior's.

Only the bounded suffix tables (a row per suffix of a training URL, so about twice
TRAIN_BOUND rows a fold at most) are broadcast.  Scoring is a map over the rows.

Defined cases: a null URL or one without ``://`` has an empty host and path and is
judged by the trees on those; labels of one kind give that one verdict; a fold
without which one kind of label is missing is judged by trees trained on all; repeated rows and null ids are rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.llm.tables import stored

RULES: list[tuple[str, str]] = [("net/", "block"), ("example.net/en/", "allow"),
                                ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words of a host (between dots and hyphens) that label a URL "block" for training.
BAD_WORDS = ("ads", "adserver", "track", "tracker", "tracking", "adult", "porn", "xxx", "casino", "betting",
             "spam", "malware", "phishing", "pills", "viagra", "payday")
TRAIN_BOUND = 20_000
#: A kind of label weighs in training as TRAIN_BOUND / this rows at least, or as all its own.
LEAST_SHARE = 20
TREES, DEPTH = 12, 4
FOLDS = 2
SMOOTHING = 5.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio",
            "host_digit_ratio", "entropy", "parameters", "has_fragment", "is_https", "suffix_1",
            "suffix_2"]


def _count(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"))
    rest = base.withColumn("rest", F.expr(
        "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"))
    raw = rest.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    tail = F.expr("substr(rest, length(raw) + 1)")
    return raw.select("page_id", "url",
                      F.translate("raw", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
                      F.regexp_extract(tail, "^[^?#]*", 0).alias("path"))


def match_rules(parsed: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` (the longest that fits, or null) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):          # the last one wins
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith(
            "path", F.lit(slash + path))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def lexical(matched: DataFrame) -> DataFrame:
    """The features of the text of a URL, and its host's suffixes."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    digits = F.length(F.regexp_replace(url, "[^0-9]+", ""))
    host_digits = F.length(F.regexp_replace(host, "[^0-9]+", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    entropy = F.expr("""CASE WHEN length(host) = 0 THEN 0D ELSE log2(length(host)) -
        aggregate(array_distinct(split(host, '')), 0D, (a, c) -> a + CASE WHEN c = '' THEN 0D ELSE
          (length(host) - length(replace(host, c, ''))) *
          log2(length(host) - length(replace(host, c, ''))) END) / length(host) END""")
    numbers = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": _count(path, "/"), "labels": _count(host, "."), "hyphens": _count(host, "-"),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "host_digit_ratio": host_digits / F.greatest(F.length(host), F.lit(1)),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "has_fragment": (F.instr(url, "#") > 0).cast("int"),
        "is_https": F.startswith(url, F.lit("https:")).cast("int"),
    }
    return matched.select("*", *[n.cast("double").alias(k) for k, n in numbers.items()],
                          F.substring_index(host, ".", -1).alias("last_1"),
                          F.substring_index(host, ".", -2).alias("last_2"))


def labelled(matched: DataFrame, bad_words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """Adds ``label`` (1 block, 0 allow) and ``fold``: that of a presumed label, else -1."""
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, bad_words)))
    fold = F.pmod(F.xxhash64(F.substring_index("host", ".", -3)), F.lit(FOLDS)).cast("int")
    return matched.withColumn("label", F.when(F.col("rule_verdict") == "block", 1.0)
                              .when(F.col("rule_verdict") == "allow", 0.0).when(bad, 1.0).otherwise(0.0)
                              ).withColumn("fold", F.when(F.col("rule_verdict").isNull() & ~bad, fold).otherwise(-1))


def with_suffixes(rows: DataFrame, stats: DataFrame) -> DataFrame:
    for k in (1, 2):
        own = stats.filter(F.col("labels_used") == k).select(F.col("suffix").alias(f"last_{k}"),
                                                             F.col("log_odds").alias(f"suffix_{k}"))
        rows = rows.join(F.broadcast(own), f"last_{k}", "left").withColumn(      # about TRAIN_BOUND rows
            f"suffix_{k}", F.coalesce(F.col(f"suffix_{k}"), F.lit(0.0)))
    return rows


def train(rows: DataFrame, bound: int = TRAIN_BOUND):
    """(trees and suffix table of each fold, None) or (None, the only verdict) from labelled rows."""
    place = F.xxhash64("url", "page_id")
    kinds = {r["label"]: r for r in rows.groupBy("label").agg(
        F.count("*").alias("n"), F.approx_count_distinct(place).alias("distinct")).collect()}
    if len(kinds) < 2:
        return None, "block" if 1.0 in kinds else "allow"
    n = sum(r["n"] for r in kinds.values())
    share = {k: min(1.0, max(bound / n, bound / 2 / r["distinct"])) for k, r in kinds.items()}
    chosen = F.pmod(place, F.lit(1 << 30)) < F.when(F.col("label") == 1.0, int(share[1.0] * (1 << 30))).otherwise(
        int(share[0.0] * (1 << 30)))
    kept = ["label", "fold", "last_1", "last_2", *FEATURES[:-2]]
    sample = stored(rows.filter(chosen).groupBy("url", "page_id").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in kept]
        ).coalesce(1).sortWithinPartitions("page_id", "url"), "url-sample")
    total = {k: max(r["n"] * min(1.0, bound / n), min(bound / LEAST_SHARE, r["n"])) for k, r in kinds.items()}
    return [fitted(sample, total, f) for f in range(FOLDS)], None


def fitted(sample: DataFrame, total: dict[float, float], fold: int):
    """(vectors, trees, suffix table) from the sample without the fold; ``total``: the kinds' weights."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    def drawn(rows: DataFrame) -> dict[float, int]:
        return {r["label"]: r["copies"] for r in rows.groupBy("label").agg(F.sum("copies").alias("copies")).collect()}
    others = sample.filter(F.col("fold") != fold)
    copies = drawn(others)
    if len(copies) < 2:
        others, copies = sample, drawn(sample)
    weight = {k: total[k] / copies[k] for k in copies}
    sample = others.withColumn("weight", F.col("copies") * F.when(F.col("label") == 1.0, weight[1.0]).otherwise(
        weight[0.0]))
    odds = total[1.0] / total[0.0]
    suffixes = F.explode(F.array(*[F.struct(F.lit(k).alias("labels_used"), F.col(f"last_{k}").alias("suffix"))
                                   for k in (1, 2)])).alias("s")
    block = F.sum(F.col("weight") * F.col("label")) + SMOOTHING * odds / (1 + odds)
    allow = F.sum(F.col("weight") * (1 - F.col("label"))) + SMOOTHING / (1 + odds)
    stats = stored(sample.select("label", "weight", suffixes).groupBy("s.labels_used", "s.suffix").agg(
        (F.log(block / allow) - F.log(F.lit(odds))).alias("log_odds")).coalesce(1), f"url-suffixes-{fold}")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    ready = vectors.transform(with_suffixes(sample, stats)).select("features", "label", "weight")
    model = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7,
                          subsamplingRate=1.0).fit(stored(ready.coalesce(1), f"url-vectors-{fold}"))
    return vectors, model, stats


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id",
          url_col: str = "url", bound: int = TRAIN_BOUND, bad_words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' probability of "block"."""
    from pyspark.ml.functions import vector_to_array
    rows = lexical(labelled(match_rules(parse(pages, id_col, url_col), rules), bad_words))
    by_path = F.coalesce(F.instr("rule", "/") < F.length("rule"), F.lit(False))
    models, only = train(rows.filter(~by_path), bound)
    if only:
        scored = rows.withColumn("block_probability", F.lit(1.0 if only == "block" else 0.0))
    else:
        scored, own = rows, [f"probability_{f}" for f in range(FOLDS)]
        for name, (vectors, model, stats) in zip(own, models, strict=True):
            scored = model.transform(vectors.transform(with_suffixes(scored, stats))).withColumn(
                name, vector_to_array("probability")[1]).drop(
                "features", "rawPrediction", "probability", "prediction", *FEATURES[-2:])
        mean = sum(F.col(c) for c in own) / FOLDS
        scored = scored.withColumn("block_probability", F.when(F.col("fold") < 0, mean).otherwise(
            F.get(F.array(*own), F.col("fold"))))
    says = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("rule_verdict", says).alias("verdict"), "block_probability")
