"""Quality of documents: a classifier of texts, and hierarchical empirical Bayes over hosts and paths.

A logistic regression on hashed words and a few figures of the surface gives each document its own evidence. The mean
evidence of a host is shrunk towards the mean of all documents, and that of a path towards its host's, each by the
strength that the variances between and within groups call for: sites with few documents stay near their prior, sites
with many speak for themselves. The document's odds are then moved by the odds of its path against the global ones. A
document never speaks for itself: its own evidence is left out of its host and path.

Everything but the fit is grouped sums over all documents; the fit reads a sample of labelled rows of bounded size.

Defined results: NULL and empty texts are scored by their surface figures; NULL hosts and paths are groups of their own;
rows that repeat count each; labels with NULL are not used for the fit; without two classes of labels all documents have
evidence 1/2; an empty table gives an empty result; further columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Tasks of the fit; the sample is small, and each of its rounds gathers one row of coefficients per task.
FIT_TASKS = 4
_SURFACE = ["_length", "_upper", "_marks", "_distinct"]


def features(docs: DataFrame, buckets: int = 1 << 15) -> DataFrame:
    """Adds ``features``: the words of the whole text, hashed, and four figures of its surface.

    The assembler names every bucket in the column's metadata; only their number is kept, or each plan, file and task of
    the fit would carry tens of thousands of names.
    """
    text = F.coalesce("text", F.lit(""))
    letters = F.greatest(F.length(text), F.lit(1))
    words = docs.withColumn("_words", F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    figured = words.withColumns({
        "_length": F.log1p(F.size("_words").cast("double")) / 10,
        "_upper": (letters - F.length(F.regexp_replace(text, "[A-Z]", ""))) / letters,
        "_marks": (letters - F.length(F.regexp_replace(text, r"[#$%&*!|<>{}\[\]=_^~]", ""))) / letters,
        "_distinct": F.size(F.array_distinct("_words")) / F.greatest(F.size("_words"), F.lit(1)),
    })
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="_words", outputCol="_hashed").transform(figured)
    assembled = VectorAssembler(inputCols=["_hashed", *_SURFACE], outputCol="features").transform(hashed)
    sized = F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": buckets + len(_SURFACE)}})
    return assembled.select(*[F.col(f"`{c}`") for c in docs.columns], sized)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7):
    """The classifier of good documents (quality 1, not toxic), or None without two classes.

    ``sample`` bounds the labelled rows, chosen by a seeded hash of their id; their texts are found in one scan.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    chosen = cut(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("label")))
    rows = cut(features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("features", "label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(rows.coalesce(FIT_TASKS))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _key(c: str) -> Column:
    return F.when(F.col(c).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(c).cast("string")))


def strength(groups: DataFrame) -> float:
    """Documents that a group's prior is worth: variance within groups over variance between them.

    ``groups`` has n, total and squares of the evidence, and the prior mean; one row of sums reaches the driver.
    """
    mean = F.col("total") / F.col("n")
    h, n, n2, between, within = groups.agg(
        F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n").cast("double")),
        F.sum(F.col("n") * F.pow(mean - F.col("prior"), 2)), F.sum(F.col("squares") - F.col("total") * mean),
    ).first()
    if not h or h < 2 or n <= h:
        return 10.0
    within = max(within / (n - h), 1e-12)
    tau = (between / (h - 1) - within) / ((n - n2 / n) / (h - 1))
    return min(within / tau, 1e6) if tau > 0 else 1e6


def posteriors(evidence: DataFrame) -> DataFrame:
    """Adds host and path posteriors and the combined posterior to rows (doc_id, host, path, evidence, and ``row`` if there)."""
    rows = evidence.withColumns({"_host": _key("host"), "_path": _key("path")})
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")]
    paths = cut(rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(F.pow("evidence", F.lit(2))).alias("squares")))
    hosts = cut(paths.groupBy("_host").agg(*sums))
    n, total = hosts.agg(F.sum("n"), F.sum("total")).first()
    mean = total / n if n else 0.5
    k_host = strength(hosts.withColumn("prior", F.lit(mean)))
    hosts = hosts.select("_host", F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    joined = paths.join(hosts, "_host").withColumn("prior", (k_host * mean + F.col("host_total")) / (k_host + F.col("host_n")))
    k_path = strength(joined)
    own = F.col("evidence")
    host = (k_host * mean + F.col("host_total") - own) / (k_host + F.col("host_n") - 1)
    path = (k_path * F.col("host_posterior") + F.col("total") - own) / (k_path + F.col("n") - 1)
    return (
        rows.join(joined.drop("prior", "squares"), ["_host", "_path"])
        .withColumn("host_posterior", host)
        .withColumn("path_posterior", path)
        .withColumn("posterior", F.expr("1e0") / (1 + F.exp(-(_logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))))))
        .select(*evidence.columns, "host_posterior", "path_posterior", "posterior")
    )


def score(docs: DataFrame, labels: DataFrame, host: str, path: str, sample: int = SAMPLE, threshold: float = 0.5, key: str = "doc_id", whole: bool = False) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, posterior, keep) of every row of ``docs``.

    The column ``key`` names the rows in the result; labels are always found by ``doc_id``. With ``whole`` each row of
    ``docs`` goes along as the struct ``row``: it is stored beside its evidence and meets only the sums of its site.
    """
    model = fit(docs, labels, sample)
    rows = docs.select(F.col(key).alias("doc_id"), "text", F.col(host).alias("host"), F.col(path).alias("path"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []))
    if model is None:
        rows = rows.withColumn("evidence", F.lit(0.5))
    else:
        rows = model.transform(features(rows)).withColumn("evidence", vector_to_array("probability")[1])
    stored = ["doc_id", "host", "path", "evidence", *(["row"] if whole else [])]
    return posteriors(cut(rows.select(*stored))).withColumn("keep", F.col("posterior") >= threshold)
