"""Operator 8: payloads of several files, and null files."""

import numpy as np
import pytest

from penmark.llm import media


@pytest.mark.parametrize("size", [0, 1, 64, 255, 256, 257, 1000])
def test_long_payloads_are_several_files(size):
    text = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
    files = media.split_files(media.as_files(text, 256))
    assert len(files) == max(1, -(-size // 256))
    back = np.concatenate([(media.decode(f) >> np.uint32(8)).astype(np.uint8).ravel() for f in files])
    assert back[:size].tobytes() == text.tobytes() and not back[size:].any()
    assert back.size == max(64, -(-size // 64) * 64)


def test_shapes_fit_the_format():
    for n in (64, 1 << 20, (1 << 20) + 64, 1 << 27, media.IMAGE_BYTES - 64, media.IMAGE_BYTES):
        height, width = media.image_shape(n)
        assert height * width >= n and max(height, width) <= media.LARGEST_SIDE


def test_several_files_and_null_files_are_read(spark, monkeypatch):
    parts = media.as_files(np.frombuffer(b"abc" * 200, np.uint8), 256)
    df = spark.createDataFrame([(1, 600, parts), (2, 5, None)], "doc_id long, n_bytes long, media binary")
    found = {r["doc_id"]: r for r in media.read_media(df).collect()}
    assert bytes(found[1]["pixels"]) == b"abc" * 200 + bytes(40) and (found[1]["width"], found[1]["height"], found[1]["colours"]) == (64, 10, 4)
    assert [found[2][c] for c in ("media", "width", "height", "colours", "pixels")] == [None] * 5
