import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cadenza.llm import catalog, url_filter as U

RULES = catalog.URL_RULES


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    path, best = rest[:cut], None
    for rule in RULES:
        if (host == rule.host or host.endswith("." + rule.host)) \
                and path.startswith(rule.path) \
                and (best is None or len(str(rule)) > len(str(best))):
            best = rule
    return host, path, best


URLS = [None, "", "no scheme", "http://Example.NET/en/1?x#y",
        "https://a.example.net/EN/", "http://example.com/de/7",
        "http://notexample.com/de/7", "http://x.org/fr/?a=1&b=2",
        "http://x.org", "http://net", "http://net/", "http://a.net/x/y",
        "http://É.NET/en/", "a://b://c/d", "http://h/p\nq?z", "://",
        "http://h?/x", "http://" + "long." * 4000 + "org/fr/" + "z" * 9000]


def labelled(spark, n=400):
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.concat(
            F.lit("http://good.example.edu/article/"), "id")).otherwise(
            F.concat(F.lit("http://x-77-99-11.example.biz/?a=1&b=2&c="),
                     "id")).alias("url"),
        (F.col("id") % 2).cast("double").alias("label"))


def test_parts_rules_and_verdicts(spark, scratch):
    model = U.fit(scratch, labelled(spark))
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])],
                                  "page_id bigint, url string")
    rows = U.judge(pages, model, RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (str(rule) if rule else None)
        want = rule.verdict if rule else (
            "block" if r["probability"] > U.THRESHOLD else "allow")
        assert r["verdict"] == want
    assert U.judge(pages.limit(0), model, RULES).count() == 0


def test_trees_learn_from_labelled_urls(spark, scratch):
    model = U.fit(scratch, labelled(spark))
    pages = labelled(spark, 600).where("url > ''").withColumn(
        "page_id", F.col("label").cast("long"))
    rows = U.judge(pages, model, []).collect()
    assert all((r["probability"] > 0.5) == (r["page_id"] == 1) for r in rows)


def test_too_few_labels(spark, scratch):
    pages = spark.createDataFrame([(1, "http://a/")],
                                  "page_id bigint, url string")
    for rows in ([], [("http://a/", 0.0)], [(None, 1.0), ("http://b", None)]):
        model = U.fit(scratch, spark.createDataFrame(
            rows, "url string, label double"))
        assert model.trees is None
        assert U.judge(pages, model, []).first()["verdict"] == "allow"


def test_entropy_and_counts(spark):
    texts = ["", "aaaa", "abcd", "http://é.x/1?q=2&r=3", "aab"]
    df = U.lexical(U.with_parts(spark.createDataFrame(
        [(t,) for t in texts], "url string")))
    for r in df.collect():
        counts = Counter(r["url"]).values()
        size = sum(counts)
        want = -sum(c / size * math.log2(c / size) for c in counts)
        assert abs(r["f_entropy"] - want) < 1e-9
    row = [r for r in df.collect() if "q=2" in r["url"]][0]
    assert (row["f_parameters"], row["f_depth"], row["suffix1"]) == (2, 1, "x")


def entropy(text):
    size = len(text)
    return -sum(c / size * math.log2(c / size)
                for c in Counter(text).values()) if size else 0.0


def features(url, shares, rate):
    """The features of one url, in the order of FEATURES."""
    host, path, _ = brute(url)
    query = re.match(r"(?s)^[^?#]*\?([^#]*)", url)
    query = query[1] if query else ""
    labels = host.split(".")
    row = [len(url), len(host), len(path), len(re.findall("/[^/]", path)),
           host.count(".") + 1,
           len(re.findall("[0-9]", url)) / max(1, len(url)),
           len(re.findall("[0-9]", host)), host.count("-"), entropy(url),
           entropy(host), query.count("&") + 1 if query else 0, "#" in url,
           url.startswith("https")]
    for name, suffix in (("suffix1", labels[-1]),
                         ("suffix2", ".".join(labels[-2:]))):
        n, blocked = shares[name].get(suffix, (0, 0.0))
        row.append((blocked + U.PRIOR * rate) / (n + U.PRIOR))
    return [float(v) for v in row]


def test_verdicts_are_those_of_the_walked_trees(spark, scratch):
    rng = random.Random(23)
    urls = []
    for i in range(600):
        bad = i % 3 == 0
        host = ".".join(rng.choice("ab9-xyz") * rng.randrange(1, 6)
                        for _ in range(rng.randrange(1, 3)))
        urls.append((f"http{'s' * (i % 2)}://{host}.{rng.choice(('biz', 'org')) if bad else rng.choice(('org', 'edu'))}"
                     f"/{'/'.join(str(rng.randrange(99)) for _ in range(rng.randrange(4)))}"
                     + ("?" + "&".join(f"k{j}={j}" for j in range(
                         rng.randrange(5))) if bad else ""),
                     float(bad if rng.random() < 0.9 else not bad)))
    model = U.fit(scratch, spark.createDataFrame(
        urls, "url string, label double"))
    path = scratch.path("trees")
    model.trees.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    shares = {s: {r[s]: (r[f"n_{s}"], r[f"sum_{s}"]) for r in t.collect()}
              for s, t in model.suffixes.items()}
    pages = [(i, u) for i, (u, _) in enumerate(urls)] + [
        (1000 + i, u) for i, u in enumerate(URLS) if u]
    verdicts = Counter()
    for r in U.judge(spark.createDataFrame(
            pages, "page_id bigint, url string"), model, []).collect():
        row = features(dict(pages)[r["page_id"]], shares, model.rate)
        margin = 0.0
        for weight, (_, nodes) in zip(model.trees.treeWeights,
                                      sorted(trees.items())):
            at = nodes[0]
            while at["leftChild"] >= 0:
                split = at["split"]
                left = row[split["featureIndex"]] <= split[
                    "leftCategoriesOrThreshold"][0]
                at = nodes[at["leftChild"] if left else at["rightChild"]]
            margin += weight * at["prediction"]
        probability = 1 / (1 + math.exp(-2 * margin))
        assert abs(probability - r["probability"]) < 1e-9, r["page_id"]
        assert r["verdict"] == ("block" if probability > U.THRESHOLD
                                else "allow")
        verdicts[r["verdict"]] += 1
    assert len(verdicts) == 2
