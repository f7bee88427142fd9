"""The classifier's features are a vector of known length whose places have no names."""

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import functions as F

from sightline.llm import site_quality


def test_no_names_go_along_with_features(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = site_quality.features(docs)
    field = got.schema["features"]
    assert got.columns == ["doc_id", "text", "features"]
    assert field.metadata == {"ml_attr": {"num_attrs": (1 << 15) + 4}}
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = HashingTF(numFeatures=1 << 15, binary=True, inputCol="w", outputCol="h").transform(docs.withColumn("w", words))
    plain = VectorAssembler(inputCols=["h", "one"], outputCol="f").transform(hashed.withColumn("one", F.log1p(F.size("w").cast("double")) / 10))
    want = {r.doc_id: r.f for r in plain.select("doc_id", "f").collect()}
    for r in got.select("doc_id", "features").collect():
        at = {i: x for i, x in zip(r.features.indices, r.features.values) if i <= 1 << 15} if hasattr(r.features, "indices") else dict(enumerate(r.features[: (1 << 15) + 1]))
        assert at == dict(zip(want[r.doc_id].indices, want[r.doc_id].values)) and len(r.features) == (1 << 15) + 4
