"""URL filter: host/path rules first, gradient-boosted trees on lexical
features for the rest.  DataFrame functions and Spark ML only."""
from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundflow.llm.base import numbered, saved

#: (verdict, rule): host and all its subdomains, then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
#: Labelled URLs the trees are fitted on: at most so many, the first by hash.
MAX_TRAIN_URLS = 20_000
#: Hash buckets of a suffix statistic: the table's size does not follow the input.
SUFFIX_BUCKETS = 4096
SMOOTH = 20.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "symbol_ratio", "entropy",
            "n_params", "query_length", "has_fragment", "is_https", "rate_tld", "rate_domain", "rate_section")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or where there is no ``://``."""
    h = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(h, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for say, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):   # the last one set is the longest
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def with_parts(df: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """Adds __host, __path, __rule, __said."""
    u = F.col(url_col).cast("string")
    out = df.withColumns({"__host": url_host(u), "__path": url_path(u)})
    rule, said = match_rule(F.col("__host"), F.col("__path"), rules)
    return out.withColumns({"__rule": rule, "__said": said})


def _ratio(url: Column, keep: str) -> Column:
    n = F.length(url)
    return F.when(n > 0, F.length(F.regexp_replace(url, keep, "")) / n).otherwise(0.0)


def _entropy(url: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.array_sort(F.split(url, ""))
    n = F.length(url)
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def _suffixes() -> dict[str, Column]:
    host, path = F.col("__host"), F.col("__path")
    return {"tld": F.element_at(F.split(host, r"\."), -1), "domain": F.substring_index(host, ".", -2),
            "section": F.element_at(F.split(path, "/"), F.least(F.lit(2), F.size(F.split(path, "/"))))}


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), _suffixes()[name]), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """Adds the lexical features and the suffix buckets (needs with_parts)."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    path = F.col("__path")
    length = lambda c: F.length(c).cast("double")
    return df.withColumns({
        "__url_length": length(u), "__host_length": length(F.col("__host")), "__path_length": length(path),
        "__depth": length(path) - length(F.replace(path, F.lit("/"), F.lit(""))),
        "__host_labels": F.size(F.split(F.col("__host"), r"\.")).cast("double"),
        "__digit_ratio": _ratio(u, "[^0-9]"), "__symbol_ratio": _ratio(u, "[0-9A-Za-z]"), "__entropy": _entropy(u),
        "__n_params": F.when(query == "", 0.0).otherwise(length(query) - length(F.replace(query, F.lit("&"), F.lit(""))) + 1),
        "__query_length": length(query), "__has_fragment": F.contains(u, F.lit("#")).cast("double"),
        "__is_https": F.lower(u).startswith("https://").cast("double"),
        **{f"__b_{k}": _bucket(k) for k in ("tld", "domain", "section")},
    })


class UrlModel:
    """Boosted trees with the suffix statistics they were fitted with."""

    def __init__(self, trees: GBTClassificationModel | None, rates: dict[str, DataFrame], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior

    def score(self, df: DataFrame, url_col: str) -> DataFrame:
        """Adds __blocked (0.0 or 1.0); needs with_parts.  Rows keep their
        partitions: the statistics have at most SUFFIX_BUCKETS rows each."""
        if self.trees is None:
            return df.withColumn("__blocked", F.lit(float(self.prior >= 0.5)))
        out = lexical(df, url_col)
        for k, table in self.rates.items():
            t = table.select(F.col("b").alias(f"__b_{k}"), F.col("rate").alias(f"__rate_{k}"))
            out = out.join(F.broadcast(t), f"__b_{k}", "left").fillna(self.prior, [f"__rate_{k}"])
        vec = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__features")
        return self.trees.transform(vec.transform(out))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", max_urls: int = MAX_TRAIN_URLS,
          trees: int = 12, depth: int = 4) -> UrlModel:
    """Fit on at most ``max_urls`` distinct labelled URLs, the first by hash
    (a fixed choice whatever the partitions).  A suffix's rate leaves out the
    row itself while fitting, so the trees do not read their own label.
    Null labels are left out; a URL labelled both ways counts with its mean
    label; with one class only (or no rows) the verdict is that class (allow)."""
    u = F.col(url_col).cast("string")
    chosen = (labelled.select(u.alias("url"), F.col(label_col).cast("double").alias("y")).dropna()
              .groupBy("url").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
              .orderBy(F.xxhash64("url"), "url").limit(max_urls))
    rows = saved(lexical(with_parts(chosen, "url"), "url").repartition(1).sortWithinPartitions("url"))
    n, y = rows.agg(F.count("y"), F.avg("y")).first()
    if not n or y in (0.0, 1.0):
        return UrlModel(None, {}, y or 0.0)
    rates, out = {}, rows
    for k in ("tld", "domain", "section"):
        t = rows.groupBy(F.col(f"__b_{k}").alias("b")).agg(F.sum("y").alias("s"), F.count("y").alias("c"))
        rates[k] = saved(t.select("b", ((F.col("s") + SMOOTH * y) / (F.col("c") + SMOOTH)).alias("rate")))
        own = t.select(F.col("b").alias(f"__b_{k}"), F.col("s").alias(f"__s_{k}"), F.col("c").alias(f"__c_{k}"))
        out = out.join(F.broadcast(own), f"__b_{k}").withColumn(
            f"__rate_{k}", (F.col(f"__s_{k}") - F.col("y") + SMOOTH * y) / (F.col(f"__c_{k}") - 1 + SMOOTH))
    vec = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__features")
    data = saved(vec.transform(out.sortWithinPartitions("url")).select("__features", "y"))
    gbt = GBTClassifier(featuresCol="__features", labelCol="y", predictionCol="__blocked", maxIter=trees,
                        maxDepth=depth, stepSize=0.3, seed=7)
    return UrlModel(gbt.fit(data), rates, y)


def filter_urls(df: DataFrame, model: UrlModel, url_col: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row: the longest rule that
    fits decides, the trees decide the others.

    Null and empty URLs, and those without ``://``, have empty host and path
    and the trees' verdict; repeated rows are judged one by one; an empty table
    stays empty.  Columns of those four names are replaced, all others are kept
    whatever their names: inside they are numbered."""
    names = df.columns
    keep = [i for i, c in enumerate(names) if c.lower() not in ("host", "path", "rule", "verdict")]
    url = f"c{names.index(url_col)}"
    scored = model.score(with_parts(numbered(df), url, rules), url)
    by_trees = F.when(F.col("__blocked") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*[F.col(f"c{i}").alias(names[i]) for i in keep], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                         F.coalesce("__said", by_trees).alias("verdict"))


def rule_labels(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """The labelled URLs: those a rule decides, with ``blocked`` 0 or 1."""
    return (with_parts(pages.select(F.col(url_col).alias("url")), "url", rules).where(F.col("__said").isNotNull())
            .select("url", (F.col("__said") == "block").cast("int").alias("blocked")))
