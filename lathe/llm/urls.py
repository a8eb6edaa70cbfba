"""URL filter: longest-rule verdicts, and boosted trees on lexical features for the other URLs.

DataFrame and SQL functions only. A rule (host, path prefix) fits its host and all subdomains
when the URL's path starts with the rule's prefix; the longest rule wins. URLs that no rule
fits get the verdict of gradient-boosted trees (`pyspark.ml`) trained on labelled URLs: by default those
that a rule decides. The trees see only lexical features: lengths, depth, digit ratio, entropy, parameter
counts, and smoothed block rates of suffixes, domains and path segments counted over all labelled URLs.

Training uses about `train_rows` different labelled URLs at most, picked by hash and weighted by their copies; the
rates count every labelled row, and every value of a labelled URL has one. Rates of training URLs leave out the URL's own
fifth of all URLs (by hash), so no URL's label is in its own features. Rates are joined by value; values in more
than 1 / HOT_SHARE of all rows (fewer than HOT_SHARE of a kind) come as a broadcast of that bound, and their rows are spread
by a salt in the join for the others. A value that no labelled URL has gets the overall rate.

Defined results: a null URL or one without "://" has an empty host and path; no labelled rows, or
one class only, give the majority class (allow when there is none) as the method's verdict; repeated rows get equal
answers; extra columns are kept, and result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

TRAIN_ROWS = 20_000
FOLDS = 5
HOT_SHARE = 256
RESULTS = ("host", "path", "rule", "verdict", "score", "by")


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z folded) and path of a URL; both empty when it has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def parse_rule(rule: str) -> tuple[str, str]:
    """"example.com/en/" -> ("example.com", "/en/"); a bare host has the path "/" or ""."""
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_columns(rules: list[tuple[str, str]], host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fitting rule, null without one. `rules`: (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later whens win, so longest last
        h, p = parse_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    """Feature columns f_* and the statistics keys s_* from u_url, u_host and u_path."""
    url, host, path = F.coalesce(F.col("u_url"), F.lit("")), F.col("u_host"), F.col("u_path")
    n = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    # runs of equal characters in the sorted text are the character counts
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(url, "")), ""), F.lit(r"(?s)((.)\2*)"), 1)
    entropy = F.aggregate(F.transform(runs, lambda r: F.length(r) / F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return df.select(
        "*",
        n.cast("double").alias("f_length"), F.length(host).cast("double").alias("f_host_length"),
        F.length(path).cast("double").alias("f_path_length"), F.size(labels).cast("double").alias("f_labels"),
        F.size(segments).cast("double").alias("f_depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(n, F.lit(1))).alias("f_digits"),
        entropy.alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("f_parameters"),
        F.when(url.startswith("https:"), 1.0).otherwise(0.0).alias("f_https"),
        F.when(url.contains("#"), 1.0).otherwise(0.0).alias("f_fragment"),
        F.when(path.endswith("/"), 1.0).otherwise(0.0).alias("f_slash"),
        F.coalesce(F.element_at(labels, -1), F.lit("")).alias("s_suffix"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("s_domain"),
        F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")).alias("s_segment"),
    )


_KINDS = ("suffix", "domain", "segment")


def _rates(every: DataFrame, overall: float) -> DataFrame:
    """By kind and value: rows that have it, and smoothed block rates without each fold, then over all labelled rows."""
    def rate(blocked: F.Column, n: F.Column) -> F.Column:
        return (blocked + 4 * overall) / (n + 4)

    of_fold = [F.when(F.col("u_fold") == f, F.col("label")) for f in range(FOLDS)]
    counted = (every.select("label", "u_fold", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s_{k}").alias("value")) for k in _KINDS])).alias("x"))
               .groupBy("x.kind", "x.value").agg(F.count("*").alias("seen"), F.count("label").alias("n"), F.sum("label").alias("blocked"),
                                                 *[F.count(x).alias(f"n{f}") for f, x in enumerate(of_fold)], *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"b{f}") for f, x in enumerate(of_fold)])
               .where("n > 0"))
    return counted.select("kind", "value", "seen", F.array(*[rate(F.col("blocked") - F.col(f"b{f}"), F.col("n") - F.col(f"n{f}")) for f in range(FOLDS)],
                                                           rate(F.col("blocked"), F.col("n"))).alias("rates"))


def _with_rates(df: DataFrame, rates: DataFrame, overall: float, total: int, fold: F.Column) -> DataFrame:
    """Features f_suffix, f_domain and f_segment: the rates at place `fold`."""
    hot = F.col("seen") * HOT_SHARE > total
    for k in _KINDS:
        side = rates.where(F.col("kind") == k)
        often = side.where(hot).select(F.col("value").alias(f"s_{k}"), F.col("rates").alias("r_often"))
        other = side.where(~hot).select(F.col("value").alias(f"s_{k}"), F.lit(0).cast("long").alias("u_salt"), F.col("rates").alias("r_other"))
        df = df.join(F.broadcast(often), f"s_{k}", "left")  # fewer than HOT_SHARE rows
        df = df.withColumn("u_salt", F.when(F.col("r_often").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("u_url", F.monotonically_increasing_id()), F.lit(1 << 20))).cast("long"))
        df = df.join(other, [f"s_{k}", "u_salt"], "left")
        df = df.withColumn(f"f_{k}", F.coalesce(F.element_at(F.coalesce("r_often", "r_other"), fold + 1), F.lit(overall))).drop("r_often", "r_other", "u_salt")
    return df


def _training(labelled: DataFrame, train_rows: int, seed: int) -> DataFrame:
    """About `train_rows` different labelled URLs at most, each once per label, with the number of its rows as u_weight."""
    n = labelled.agg(F.count_distinct(F.xxhash64("u_url", "label"))).first()[0]
    share = min(1.0, train_rows / max(n, 1))
    picked = labelled.where(F.pmod(F.xxhash64("u_url", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked.groupBy("u_url", "u_host", "u_path", "u_fold", "label").agg(F.count("*").cast("double").alias("u_weight"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", labels: F.Column | None = None, keep: list[str] | None = None,
               train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """`pages` (or its columns `keep`) with host, path, rule, verdict, score (of "block") and by ("rule" or "model").

    `labels`: an expression over `pages`, 1.0 block, 0.0 allow, null unlabelled; default the rules' verdicts."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in RESULTS]
    raw = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{url}`").cast("string").alias("u_url"),
                       (labels if labels is not None else F.lit(None)).cast("double").alias("label"))
    host, path = host_path(F.col("u_url"))
    ruled = raw.withColumns({"u_host": host, "u_path": path})
    rule, verdict = rule_columns(rules, F.col("u_host"), F.col("u_path"))
    ruled = ruled.withColumns({"u_rule": rule, "u_verdict": verdict})
    if labels is None:
        ruled = ruled.withColumn("label", F.when(F.col("u_verdict").isNotNull(), (F.col("u_verdict") == "block").cast("double")))
    ruled = ruled.withColumn("u_fold", F.pmod(F.xxhash64("u_url", F.lit(seed + 1)), F.lit(FOLDS)).cast("int"))
    every = _lexical(ruled)
    labelled = ruled.where("label is not null")
    total, n, blocked = ruled.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    overall = (blocked or 0.0) / n if n else 0.0
    if n and 0 < blocked < n:
        rates = written(_rates(every, overall), "url-rates")
        features = [f"f_{k}" for k in ("length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "parameters", "https", "fragment", "slash", *_KINDS)]
        assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
        # bounded by train_rows; stored once, since boosting reads it many times
        picked = _with_rates(_lexical(_training(labelled, train_rows, seed)), rates, overall, total, F.col("u_fold"))
        train = written(assemble.transform(picked).select("features", "label", "u_weight").repartition(4), "url-train")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, weightCol="u_weight").fit(train)
        scored = model.transform(assemble.transform(_with_rates(every, rates, overall, total, F.lit(FOLDS))))
        scored = scored.withColumn("u_score", vector_to_array("probability")[1])
    else:
        scored = every.withColumn("u_score", F.lit(overall))
    decided = F.when(F.col("u_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("u_host").alias("host"), F.col("u_path").alias("path"),
                         F.col("u_rule").alias("rule"), F.coalesce("u_verdict", decided).alias("verdict"), F.col("u_score").alias("score"),
                         F.when(F.col("u_verdict").isNull(), "model").otherwise("rule").alias("by"))
