"""Frames of photo folders: orientation, scaling, errors, early stops and summaries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from loomscape.sources import ingest as I  # noqa: E741
from loomscape.sources.photos import SourceError, encode_png


def turned(png: bytes, how: int, end: str) -> bytes:
    """The PNG with an orientation in an eXIf chunk behind another entry."""
    tiff = {"<": b"II*\0", ">": b"MM\0*"}[end] + struct.pack(f"{end}IHHHIIHHIHHI", 8, 2, 0x010F, 2, 1, 0, 0x0112, 3, 1, how, 0, 0)
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
    return png[:33] + chunk + png[33:]


def pixels(frame):
    return np.frombuffer(frame.bgra, np.uint8).reshape(frame.height, frame.width, 4)[..., 2::-1]


#: Where the first pixel of the stored rows is seen, and the last one of the first row, for 1 to 8.
CORNERS = [("top left", "top right"), ("top right", "top left"), ("bottom right", "bottom left"), ("bottom left", "bottom right"), ("top left", "bottom left"), ("top right", "bottom right"), ("bottom right", "top right"), ("bottom left", "top left")]


def corner(a, where):
    return tuple(a[0 if "top" in where else -1, 0 if "left" in where else -1].tolist())


def test_eight_orientations(spark, tmp_path):
    stored = np.arange(4 * 6 * 3).reshape(4, 6, 3) / 100
    for how in range(1, 9):
        (tmp_path / f"p{how}.png").write_bytes(turned(encode_png(stored), how, "<>"[how % 2]))
    (tmp_path / "p9.png").write_bytes(turned(encode_png(stored), 42, "<"))
    plain = (np.clip(stored, 0, 1) * 255).astype(np.uint8)
    frames = {r.frame_id: r for r in I.ingest(spark, str(tmp_path)).collect()}
    for k, (first, last) in enumerate(CORNERS):
        seen = pixels(frames[k])
        assert seen.shape == ((4, 6, 3) if k < 4 else (6, 4, 3)) and frames[k].error is None
        assert corner(seen, first) == tuple(plain[0, 0].tolist()) and corner(seen, last) == tuple(plain[0, -1].tolist())
        assert sorted(map(tuple, seen.reshape(-1, 3).tolist())) == sorted(map(tuple, plain.reshape(-1, 3).tolist()))
    assert (pixels(frames[8]) == plain).all()  # an orientation that is none


def test_edges_errors_and_early_stop(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(12):
        (tmp_path / f"img_{k}.png").write_bytes(encode_png(rng.uniform(size=(20, 30 + k, 3))))
    (tmp_path / "img_1.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "img_2.jpg").write_bytes(b"\xff\xd8\xff no decoder")
    (tmp_path / ".img_0.png").write_bytes(b"hidden")
    (tmp_path / "notes.txt").write_text("x")
    frames = I.ingest(spark, str(tmp_path), longest=15)
    rows = {r.path.rpartition("/")[2]: r for r in frames.collect()}
    assert sorted(rows, key=lambda n: rows[n].frame_id)[:5] == ["img_0.png", "img_1.png", "img_2.jpg", "img_2.png", "img_3.png"]
    assert {n for n, r in rows.items() if r.error} == {"img_1.png", "img_2.jpg"}
    assert all(max(r.width, r.height) == 15 and len(r.bgra) == 4 * r.width * r.height for r in rows.values() if not r.error)
    assert tuple(I.summary(frames).first()) == (13, 11, 2, 15, 10)
    some = I.ingest(spark, str(tmp_path), most=4)
    assert [r.path.rpartition("/")[2] for r in some.orderBy("frame_id").collect()] == ["img_0.png", "img_1.png", "img_2.jpg", "img_2.png"]
    assert tuple(I.summary(some).first()) == (4, 2, 2, 30, 20)
    assert tuple(I.summary(I.ingest(spark, str(tmp_path), most=0)).first()) == (0, 0, 0, None, None)


def test_scaling_keeps_the_mean():
    a = np.random.default_rng(1).integers(0, 256, (30, 50, 3)).astype(np.uint8)
    b = I.within(a, 20)
    assert b.shape == (12, 20, 3) and abs(b.mean() - a.mean()) < 1
    assert I.within(a, 50) is a and I.within(np.full((1, 9, 3), 7, np.uint8), 2).tolist() == [[[7, 7, 7]] * 2]


def test_kinds_of_sources(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(encode_png(np.zeros((2, 2, 3))))
    (tmp_path / "film.MOV").write_bytes(b"")
    (tmp_path / "empty").mkdir()
    assert I.detect(spark, str(tmp_path)) == "photos" and I.detect(spark, str(tmp_path / "film.MOV")) == "video"
    for bad, why in (("none", "not found"), ("empty", "no photos"), ("one.png", "not supported")):
        with pytest.raises(SourceError, match=why):
            I.detect(spark, str(tmp_path / bad))
    with pytest.raises(SourceError, match="no video decoder"):
        I.ingest(spark, str(tmp_path / "film.MOV"))
