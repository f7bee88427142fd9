"""Words are counted as a plain expression finds them."""

import random
import re

from sightline.llm import mixing


def test_word_count(spark):
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "bc", "ü", "😀", "\x00", " ", " ", "\x85", "$", "\\"]
    draw = random.Random(1)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)]
    texts += ["", " ", " \n ", "x" * 300_000, " " * 50_000, "a " * 100_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", mixing.word_count("text").alias("n")).collect()
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows) and len(rows) == len(texts)
