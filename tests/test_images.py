"""Image sources and operators on small PNG files written by the test."""

import struct
import zlib

import numpy as np
import pytest

from sightline.operators import images
from sightline.sources import readers


def write_png(path, rgb):
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


GRADIENT = (np.arange(4 * 3 * 3).reshape(3, 4, 3) * 7 % 256).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    write_png(root / "Acacia" / "a_1.png", GRADIENT)
    write_png(root / "Acacia" / "a_1_aug2_0.png", GRADIENT)
    write_png(root / "Lantana" / "b_1.png", np.full((5, 5, 3), 90, np.uint8))
    (root / "Lantana" / "broken.png").write_bytes(b"not a picture")
    (root / "Lantana" / "notes.txt").write_text("x")
    return str(root)


def test_inventory_and_images(spark, folder):
    inv = {r["path"].rsplit("/", 1)[1]: r["class_name"] for r in readers.read_image_inventory(spark, folder).collect()}
    assert inv == {"a_1.png": "Acacia", "b_1.png": "Lantana", "broken.png": "Lantana"}
    rows = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_images(spark, folder).collect()}
    assert set(rows) == {"a_1.png", "a_1_aug2_0.png", "b_1.png"}
    r = rows["a_1.png"]
    assert (r["height"], r["width"]) == (3, 4)
    assert np.array_equal(np.frombuffer(r["data"], np.uint8).reshape(3, 4, 3)[..., ::-1], GRADIENT)


def test_augmented_names(spark):
    rows = [(f"/p/{c}/{i}.png", c) for c in ("Acacia", "Lantana") for i in range(50 if c == "Acacia" else 3)]
    inventory = spark.createDataFrame(rows, "path string, class_name string")
    out = images.augmented_manifest(inventory, factor=8, cap=300).collect()
    assert len(out) == (37 + 3) * 7 and len({r["out_path"] for r in out}) == len(out)
    assert all("_aug" in r["out_path"] and r["out_path"].endswith(".jpg") for r in out)
    again = images.augmented_manifest(inventory.repartition(3), factor=8, cap=300).collect()
    assert {r["out_path"] for r in again} == {r["out_path"] for r in out}
