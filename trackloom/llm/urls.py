"""URL filters (operator 10), in DataFrame functions and Spark's own boosted trees only.

A list of rules (host, path prefix, verdict) comes first; a rule fits its host and all subdomains
when the url's path starts with the rule's, and the longest rule wins. Urls that no rule decides
are judged by gradient-boosted trees over lexical features: lengths, depth, digit ratio, character
entropy, parameter counts and suffix statistics. The trees are fitted on labelled urls, in the
registered query those that the rules decide: a bounded sample (`train_urls`, the smallest hashes).
The statistics by suffix and domain count all labelled urls, not only the sample. While the trees
learn, a url sees the statistics of the urls of other folds only (`FOLDS`, by the url's hash), never its own label:
a suffix or domain that is known from one fold alone looks like one never seen, as it does on new urls.

Edge cases: a null url, or one without "://", has an empty host and path and is judged by the trees
like any other; upper case in hosts is lowered for A-Z only; repeated rows stay; without labelled
urls, or with labels of one kind only, the trees' verdict is that kind ("allow" if there is none);
a url with both labels counts as blocked; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Parts of the labelled urls, each of which sees the statistics of the others.
FOLDS = 5
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "suffix_rate", "suffix_log", "domain_rate", "domain_log"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = r"(?s)\A.*?://"
    host = F.regexp_extract(url, rest + r"([^/?#]*)", 1)
    path = F.regexp_extract(url, rest + r"[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. The list is a parameter and bounded."""
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    if not rules:
        return none
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        ).otherwise(none)
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def lexical(urls: DataFrame) -> DataFrame:
    """Features of `url`, `host` and `path` that need nothing but the row itself."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length("u"), F.lit(1)).cast("double")
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    share = lambda c: (F.length("u") - F.length(F.replace(F.col("u"), c, F.lit("")))) / size
    entropy = F.aggregate(F.array_remove(F.array_distinct(F.split("u", "")), ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return urls.withColumn("u", url).select(
        "*",
        F.length("u").cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (F.length(F.regexp_replace("u", "[^0-9]", "")) / size).alias("digit_ratio"),
        F.round(entropy, 9).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        F.length(F.regexp_replace("u", "[^-]", "")).cast("double").alias("hyphens"),
        F.element_at(F.split("host", r"\."), -1).alias("suffix"),
        F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
    ).drop("u")


def statistics(labelled: DataFrame, key: str) -> DataFrame:
    """Blocked urls and all urls by `key` and fold, over all labelled urls."""
    return labelled.groupBy(key, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("urls"))


def with_statistics(urls: DataFrame, tables: list[tuple[str, DataFrame]], out_of_fold: bool = False) -> DataFrame:
    """Smoothed share of blocked urls and log count by each key: of all labelled urls, or of those of other folds than the row's."""
    for key, counts in tables:  # domains grow with the input: Spark chooses the join by size, AQE splits hot keys
        all_ = counts.groupBy(key).agg(F.sum("blocked").alias("blocked"), F.sum("urls").alias("urls"))
        urls = urls.join(all_, key, "left")
        blocked, n = F.coalesce("blocked", F.lit(0.0)), F.coalesce("urls", F.lit(0))
        if out_of_fold:
            own = counts.select(key, "fold", F.col("blocked").alias("own_blocked"), F.col("urls").alias("own_urls"))
            urls = urls.join(own, [key, "fold"], "left")
            blocked, n = blocked - F.coalesce("own_blocked", F.lit(0.0)), n - F.coalesce("own_urls", F.lit(0))
        urls = urls.withColumns({f"{key}_rate": (blocked + 1.0) / (n + 2.0), f"{key}_log": F.log1p(n.cast("double"))}).drop("blocked", "urls", "own_blocked", "own_urls")
    return urls


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, train_urls: int = 20_000, trees: int = 10, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' own score and verdict.

    `labelled` (url, label 1 = block) trains the trees; without it the urls that the rules decide do.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labels = rows.where("hit is not null").select("url", "host", "path", F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0).alias("label"))
    else:
        labels = labelled.where("url is not null and label is not null").select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    labels = labels.groupBy("url").agg(F.max(F.struct("label", "host", "path")).alias("l")).select("url", "l.*")
    labels = written(labels.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS))), "url-labels")
    sample = written(labels.orderBy(F.xxhash64("url"), "url").limit(train_urls), "url-sample")
    kinds = [r[0] for r in sample.select("label").distinct().orderBy("label").collect()]  # 0 and 1 at most
    featured = lexical(rows)
    if len(kinds) == 2:
        tables = [(key, written(statistics(lexical(labels), key), f"url-{key}")) for key in ("suffix", "domain")]
        pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = written(with_statistics(lexical(sample), tables, out_of_fold=True).select("url", "label", *FEATURES).orderBy(F.xxhash64("url"), "url"), "url-train")
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7).fit(pack.transform(train))
        judged = model.transform(pack.transform(with_statistics(featured, tables))).withColumn("blocked", F.col("prediction") == 1.0)
    else:
        judged = featured.withColumn("blocked", F.lit(bool(kinds) and kinds[0] == 1.0))
    by_trees = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_trees).alias("verdict"), by_trees.alias("tree_verdict"))
