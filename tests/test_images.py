"""Images as a source and page rasters, against numpy and planted faults."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import features as V
from paperloom.sources import readers as R


def plain(g):
    """The 29 features by their definitions, pixel arrays in hand; fewer for pages under 4 x 4."""
    h, w = g.shape
    ink, (bh, bw) = (g < 128).astype(float), (h // 4, w // 4)
    rows, cols = ink.mean(1), ink.mean(0)
    mean = lambda a: a.mean() if a.size else None
    grid = [ink[i * bh : (i + 1) * bh, j * bw : (j + 1) * bw].mean() if bh and bw else None for i in range(4) for j in range(4)]
    halves = [mean(ink[: h // 2]), mean(ink[h // 2 :]), mean(ink[:, : w // 2]), mean(ink[:, w // 2 :])]
    r, c = np.flatnonzero(rows > 0.01), np.flatnonzero(cols > 0.01)
    margins = [r[0] / h, 1 - r[-1] / h, c[0] / w, 1 - c[-1] / w] if len(r) and len(c) else [0.5] * 4
    p = np.pad(g.astype(float), 1, mode="edge")
    s, d = p[:-2] + 2 * p[1:-1] + p[2:], p[2:] - p[:-2]
    size = np.hypot(s[:, 2:] - s[:, :-2], d[:, :-2] + 2 * d[:, 1:-1] + d[:, 2:])
    return [ink.mean(), *grid, *halves, (rows < 0.01).mean(), (cols < 0.01).mean(), *margins, size.mean(), size.std()]


def same(row, want):
    got = [row[c] for c in V.RASTER]
    assert [v is None for v in got] == [v is None for v in want]
    assert [v for v in got if v is not None] == pytest.approx([v for v in want if v is not None], abs=1e-6)


PAGES = [(1, 1), (1, 7), (3, 9), (4, 4), (9, 3), (16, 16), (37, 53), (200, 110)]


def test_features(spark):
    """Sizes down to one pixel, blank and full pages, and a page with ink that no column shows."""
    rng = np.random.default_rng(7)
    made = [rng.integers(0, 256, p) for p in PAGES] + [np.full((8, 8), 255), np.zeros((8, 8), int), np.full((500, 60), 255)]
    made[-1][3, 5] = 0
    rows = [(i, g.shape[0], g.shape[1], g.tolist()) for i, g in enumerate(made)]
    got = V.raster_features(spark.createDataFrame(rows, "doc_id long, h int, w int, gray array<array<int>>")).collect()
    assert len(got) == len(made)
    for r in got:
        same(r, plain(made[r.doc_id]))


def test_pages(spark):
    """Rows of 80 characters, whatever their width in bytes; no row for empty texts."""
    texts = ["ab c", "", None, "é😀 " * 60, "x" * 80, "x" * 81]
    got = {r.doc_id: r for r in V.pages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {0, 3, 4, 5} and [got[k].h for k in (0, 3, 4, 5)] == [1, 3, 1, 2]
    for k, r in got.items():
        flat = [255 if c in " \t\n\r" else 0 for c in texts[k]]
        assert sum(r.gray, []) == flat + [255] * (80 * r.h - len(flat))


def colour_png(rgb):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, n = rgb.shape
    lines = np.zeros((h, 1 + w * n), np.uint8)
    lines[:, 1:] = rgb.reshape(h, w * n)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def test_folders(spark, tmp_path):
    """Damaged files are counted in their folders, and the others give the features of their pixels."""
    rng, want = np.random.default_rng(3), {}
    for split, category, n in (("train", "a", 6), ("train", "b c", 3), ("val", "a", 2)):
        folder = tmp_path / split / category
        folder.mkdir(parents=True)
        for k in range(n):
            g = rng.integers(0, 256, (11, 13)).astype(np.uint8)
            (folder / f"{k}.png").write_bytes(R.png(g))
            want[split, category.replace(" ", "%20"), f"{k}.png"] = plain(g)
    rgb = rng.integers(0, 256, (9, 8, 3)).astype(np.int64)
    grey = (rgb @ np.array([19595, 38470, 7471]) + 32768) >> 16
    (tmp_path / "val" / "a" / "colour.png").write_bytes(colour_png(rgb.astype(np.uint8)))
    clear = np.concatenate([rgb, np.full((9, 8, 1), 255)], axis=2)
    (tmp_path / "val" / "a" / "alpha.png").write_bytes(colour_png(clear.astype(np.uint8)))
    want["val", "a", "colour.png"] = want["val", "a", "alpha.png"] = plain(grey)
    whole = R.png(rng.integers(0, 256, (64, 64)).astype(np.uint8))
    for name, body in (("cut.png", whole[: len(whole) // 2]), ("head.png", whole[:20]), ("empty.png", b""), ("text.png", b"no image")):
        (tmp_path / "train" / "a" / name).write_bytes(body)

    # Spark's file sources leave out the file of no bytes
    folder = lambda c: c.replace("%20", " ")
    counts = {(r.split, folder(r.category)): (r.n, r.errors) for r in R.scan_labeled_dirs(spark, str(tmp_path)).collect()}
    assert counts == {("train", "a"): (6, 3), ("train", "b c"): (3, 0), ("val", "a"): (4, 0)}
    images = R.scan_images(spark, str(tmp_path))
    assert images.count() == 16 and images.filter("image is null").count() == 3
    found = V.raster_features(V.image_pages(images), "path").withColumn("name", F.substring_index("path", "/", -3)).collect()
    assert len(found) == len(want)
    for r in found:
        split, category, name = r.name.split("/")
        same(r, want[split, category.replace(" ", "%20"), name])


def test_features_are_made_in_tasks(spark):
    """Pixels pass as bytes, not through lambdas of the plan, and give the features of the same pages as arrays; no row for empty texts."""
    texts = ["ab c", "", None, "é😀 \t" * 90, "x" * 81, "\n" * 170 + "y", " " * 320]
    docs = spark.createDataFrame([(k, f"k{k}", t) for k, t in enumerate(texts)], "doc_id long, name string, text string")
    made = V.raster_features(V.packed_pages(docs, "doc_id", "name"), "doc_id", "name")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    got, want = made.orderBy("doc_id").collect(), {r.doc_id: np.array(r.gray) for r in V.pages(docs).collect()}
    assert [(r.doc_id, r.name) for r in got] == [(k, f"k{k}") for k in sorted(want)]
    for r in got:
        same(r, plain(want[r.doc_id]))
