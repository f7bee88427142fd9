"""What Python workers keep from one stage to the next."""

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa

from sightline.llm import packing, shingles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_near_dedup_lets_go_of_the_encoder(spark):
    from sightline.llm import tokens, worker

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = tokens.encoder(PATH)
        for b in batches:
            sketched = list(of(iter([b])))
            assert sum(map(len, sketched)) == len(b)
        kept = len(worker.KEPT)
        yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([int(tokens.encoder(PATH) is before)])], ["kept", "same"])

    of = sketcher(docs)
    assert [tuple(r) for r in docs.mapInArrow(twice, "kept long, same long").collect()] == [(0, 0)]
    ids = sorted(map(tuple, packing.pieces(docs, PATH).collect()))
    assert shingles.sketches(docs.withColumnRenamed("doc_id", "id"), 5).count() == 20
    assert sorted(map(tuple, packing.pieces(docs, PATH).collect())) == ids


def sketcher(docs):
    """The function that ``sketches`` maps over batches."""
    found = []

    class Texts:
        def select(self, *names):
            return self

        def mapInArrow(self, of, schema):
            found.append(of)

    shingles.sketches(Texts(), 5)
    return found[0]
