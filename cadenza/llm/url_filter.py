"""URL filter: boosted trees on lexical features, below a list of rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import Scratch

#: Bound on the labelled sample, chosen by the hash of the url.
SAMPLE_URLS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
#: Weight of the overall rate in the rate of a suffix.
PRIOR = 20.0
THRESHOLD = 0.5
SUFFIXES = ("suffix1", "suffix2")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a start of the path."""
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def rules(text: str) -> list[Rule]:
    """``block net/, allow example.net/en/`` as rules."""
    found = []
    for part in text.split(","):
        verdict, _, place = part.strip().partition(" ")
        host, slash, path = place.strip().partition("/")
        found.append(Rule(verdict, host, slash + path))
    return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(
        url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1),
                       UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, listed: list[Rule],
               value=str) -> Column:
    """``value`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(listed, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)
                ) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    size = F.length(text).cast("double")
    counts = F.transform(
        F.array_distinct(F.split(text, "", -1)),
        lambda c: (size - F.length(F.replace(text, c, F.lit(""))))
        / F.length(c))
    total = F.aggregate(
        F.filter(counts, lambda n: n > 0), F.lit(0.0),
        lambda acc, n: acc + n * F.log2(n))
    return F.when(size > 0, F.log2(size) - total / size).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features and both host suffixes to (url, host, path).

    A null url has the features of an empty one.
    """
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split("host", r"\.", -1)
    return urls.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": _count(F.col("path"), "/[^/]"),
        "f_labels": _count(F.col("host"), r"\.") + 1,
        "f_digit_ratio": _count(url, "[0-9]") / size,
        "f_host_digits": _count(F.col("host"), "[0-9]"),
        "f_hyphens": _count(F.col("host"), "-"),
        "f_entropy": _entropy(url),
        "f_host_entropy": _entropy(F.col("host")),
        "f_parameters": F.when(query != "", _count(query, "&") + 1)
        .otherwise(0.0),
        "f_fragment": url.contains("#").cast("double"),
        "f_https": url.startswith("https").cast("double"),
        "suffix1": F.element_at(labels, -1),
        "suffix2": F.substring_index("host", ".", -2),
    })


FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth",
            "f_labels", "f_digit_ratio", "f_host_digits", "f_hyphens",
            "f_entropy", "f_host_entropy", "f_parameters", "f_fragment",
            "f_https", "f_suffix1", "f_suffix2")


@dataclass(frozen=True)
class Model:
    """Trees, and the share of blocked urls by suffix.

    ``trees`` is None where the labels hold fewer than two classes; then
    every url gets the probability ``rate``.  ``suffixes`` has a row per
    suffix of the sample, so no more than its bound allows.
    """
    trees: GBTClassificationModel | None
    suffixes: dict[str, DataFrame]
    rate: float


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    host, path = split_url(F.col(url))
    return urls.withColumns({"host": host, "path": path})


def fit(scratch: Scratch, labelled: DataFrame, url: str = "url",
        label: str = "label") -> Model:
    """Train from (url, label), label 1 for urls to block.

    At most SAMPLE_URLS rows, by the hash of the url, take part; rows
    without label or url do not.  Repeated urls may disagree; all count.
    """
    rows = labelled.select(
        F.col(url).alias("url"), F.col(label).cast("double").alias("label")
    ).where("url IS NOT NULL AND label IS NOT NULL")
    sample = scratch.keep(
        lexical(with_parts(rows.orderBy(
            F.xxhash64("url"), "url", "label").limit(SAMPLE_URLS))),
        "labelled-urls")
    rate = float(sample.agg(F.avg("label")).first()[0] or 0.0)
    # one half of the urls gives the rates of suffixes, the other the trees
    half = F.crc32("url") % 2
    suffixes = {s: scratch.keep(sample.where(half == 0).groupBy(s).agg(
        F.count(F.lit(1)).alias(f"n_{s}"), F.sum("label").alias(f"sum_{s}")),
        s) for s in SUFFIXES}
    if sample.where(half == 1).select("label").distinct().count() < 2:
        return Model(None, suffixes, rate)
    # one ordered partition of the bounded sample: the same trees every time
    ready = _assembled(_suffix_rates(
        sample.where(half == 1), suffixes, rate)).select(
        "features", "label").coalesce(1).sortWithinPartitions(
        F.xxhash64(F.to_json(vector_to_array("features"))), "label")
    trees = GBTClassifier(
        labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP,
        seed=SEED).fit(ready)
    return Model(trees, suffixes, rate)


def _suffix_rates(urls: DataFrame, suffixes: dict[str, DataFrame],
                  rate: float) -> DataFrame:
    for s, known in suffixes.items():
        urls = urls.join(F.broadcast(known), s, "left").withColumn(
            f"f_{s}", (F.coalesce(F.col(f"sum_{s}"), F.lit(0.0)) + PRIOR * rate)
            / (F.coalesce(F.col(f"n_{s}"), F.lit(0)) + PRIOR)
        ).drop(f"n_{s}", f"sum_{s}")
    return urls


def _assembled(urls: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES),
                           outputCol="features").transform(urls)


def judge(pages: DataFrame, model: Model, listed: list[Rule],
          page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) for every row.

    The longest fitting rule decides, else the trees: ``block`` if the
    probability exceeds THRESHOLD.  A null url, or one without ``://``, has
    an empty host and path and is judged by its features.  Repeated rows get
    equal verdicts; an empty table stays empty.
    """
    urls = lexical(with_parts(pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"))))
    if model.trees is None:
        scored = urls.withColumn("probability", F.lit(model.rate))
    else:
        scored = model.trees.transform(_assembled(_suffix_rates(
            urls, model.suffixes, model.rate)).drop(
            "probability")).withColumn(
            "probability", vector_to_array("probability")[1])
    host, path = F.col("host"), F.col("path")
    return scored.select(
        "page_id", "host", "path",
        match_rule(host, path, listed).alias("rule"),
        F.coalesce(match_rule(host, path, listed, lambda r: r.verdict),
                   F.when(F.col("probability") > THRESHOLD, "block")
                   .otherwise("allow")).alias("verdict"), "probability")
