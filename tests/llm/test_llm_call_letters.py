"""Packing asks the encoder for many texts at once, and it looks each distinct word up once for all of them."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sightline.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_runs_of_words_give_the_ids_of_whole_texts():
    texts = ["one", "two words", "a\nb c", " odd  spaces ", "x " * 40 + "x", "", "Öl und\nWasser, 90.1", "last one here."] * 3
    plain = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for run in (1, 2, 5, 50, 1_000_000):
        enc = tokens.Encoder(PATH, run_words=run)
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == plain


def test_distinct_words_are_looked_up_once(spark, monkeypatch):
    words = [f"word{k % 7}" for k in range(2_000_000)]
    texts = [" ".join(words[a : a + 100_000]) for a in range(0, len(words), 100_000)]
    seen = []
    enc = tokens.Encoder(PATH)
    look = enc._ids_after_space
    monkeypatch.setattr(enc, "_ids_after_space", lambda w: seen.append(len(w)) or look(w))
    monkeypatch.setattr(packing, "encoder", lambda path: enc)
    made = []
    frame = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, of, schema: made.append(of))
    packing.pieces(frame, PATH)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert sum(b.num_rows for b in made[0](iter([batch]))) >= len(texts)
    assert seen == [7]
