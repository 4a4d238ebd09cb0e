"""Image files as grids, and raster featurizers that need whole images (numpy inside ``mapInPandas``)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.operators.series import numbered
from motionq.sources import stores


IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"


def scan(spark: SparkSession, folder: str, pattern: str = "*.{png,PNG}") -> DataFrame:
    """``(img_id, path, image)`` of the files of a folder that match; ``img_id`` is the place in path order.

    Spark's image source decodes PNG, JPEG, GIF and bitmaps in the JVM; what is no image has no row and no number.
    """
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    order = numbered(found.select(F.col("image.origin").alias("path")), "path", "img_id")
    return found.withColumn("path", F.col("image.origin")).join(order, "path").select("img_id", "path", "image")


def pixels_of(image: dict) -> np.ndarray:
    """``rows x cols x channels`` (blue, green, red) of a decoded image."""
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def decoded(files: DataFrame) -> DataFrame:
    """``(img_id, image)`` of bitmap files ``(img_id, content)``: the same form as of ``scan``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [read_bmp(c) for c in pdf["content"]]
            rows = [{"origin": None, "height": g.shape[0], "width": g.shape[1], "nChannels": g.shape[2], "mode": 8 * (g.shape[2] - 1), "data": g.tobytes()} for g in found]
            yield pd.DataFrame({"img_id": pdf["img_id"], "image": rows})

    return files.select("img_id", "content").mapInPandas(work, f"img_id long, image struct<{', '.join(c.replace(' ', ': ') for c in IMAGE.split(', '))}>")


def write_png(image: np.ndarray) -> bytes:
    """The PNG file of ``rows x cols x 3`` (blue, green, red) or of gray ``rows x cols``."""
    h, w = image.shape[:2]
    rows = (image[..., ::-1] if image.ndim == 3 else image).astype(np.uint8).reshape(h, -1)
    body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes())
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def read_bmp(content: bytes) -> np.ndarray:
    """Uncompressed 8, 24 or 32 bit bitmap as ``rows x cols x channels``, top row first."""
    if content[:2] != b"BM":
        raise ValueError("not a bitmap")
    start, (width, height), bits, packed = struct.unpack_from("<I", content, 10)[0], struct.unpack_from("<ii", content, 18), *struct.unpack_from("<HI", content, 28)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed 8, 24 or 32 bit bitmaps")
    row = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    image = raw.reshape(abs(height), width, bits // 8)
    return image[::-1] if height > 0 else image


def write_bmp(image: np.ndarray) -> bytes:
    """The 24 or 32 bit bitmap of ``rows x cols x channels``."""
    h, w, c = image.shape
    row = (w * c + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * c] = image[::-1].reshape(h, w * c)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * c, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def gray(image: np.ndarray) -> np.ndarray:
    """Whole mean of the first three channels."""
    return image[..., :3].astype(int).sum(2) // 3 if image.ndim == 3 and image.shape[2] >= 3 else image.reshape(image.shape[:2]).astype(int)


def sobel(g: np.ndarray, noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients, magnitude and orientation in [0, 2 pi) of a gray image; seeded Gaussian noise only if asked for."""
    a = np.asarray(g, float)
    if noise:
        a = a + np.random.default_rng(seed).normal(0, noise, a.shape)
    p = np.pad(a, 1, "reflect") if min(a.shape) > 1 else np.pad(a, 1, "edge")
    s = lambda i, j: p[i : i + a.shape[0], j : j + a.shape[1]]
    gx = s(0, 2) + 2 * s(1, 2) + s(2, 2) - s(0, 0) - 2 * s(1, 0) - s(2, 0)
    gy = s(2, 0) + 2 * s(2, 1) + s(2, 2) - s(0, 0) - 2 * s(0, 1) - s(0, 2)
    return gx, gy, np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), 2 * np.pi)


def canny(g: np.ndarray, low: float = 50, high: float = 200) -> np.ndarray:
    """Edge mask: 3 x 3 mean, gradient, non-maximum suppression in four directions, hysteresis."""
    a = np.pad(np.asarray(g, float), 1, "edge")
    mean = sum(a[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)) / 9
    gx, gy, _, _ = sobel(mean)
    m = np.abs(gx) + np.abs(gy)
    angle = np.mod(np.degrees(np.arctan2(gy, gx)), 180)
    way = np.select([(angle < 22.5) | (angle >= 157.5), angle < 67.5, angle < 112.5], [0, 1, 2], 3)
    p = np.pad(m, 1)
    at = lambda i, j: p[1 + i : 1 + i + m.shape[0], 1 + j : 1 + j + m.shape[1]]
    steps = ((0, 1), (1, 1), (1, 0), (1, -1))
    top = np.select([way == k for k in range(4)], [(m > at(i, j)) & (m >= at(-i, -j)) for i, j in steps])
    strong, weak = top & (m > high), top & (m > low)
    while True:
        q = np.pad(strong, 1)
        grown = weak & np.any([q[1 + i : 1 + i + m.shape[0], 1 + j : 1 + j + m.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        if (grown == strong).all():
            return strong
        strong = grown | strong


def hough_segments(edges: np.ndarray, votes: int = 15, least: int = 10, gap: int = 5) -> list[tuple[int, int, int, int]]:
    """Segments ``x1, y1, x2, y2`` on lines (1 pixel, 1 degree) with enough votes, strongest line first.

    Deterministic: each line takes the pixels within half a pixel that no stronger line took, in runs broken by more
    than ``gap`` and at least ``least`` long.
    """
    y, x = np.nonzero(edges)
    out: list = []
    theta = np.deg2rad(np.arange(180))
    free = np.ones(len(x), bool)
    while free.sum() >= votes:
        rho = np.rint(x[free, None] * np.cos(theta) + y[free, None] * np.sin(theta)).astype(int)
        low = rho.min()
        count = np.apply_along_axis(lambda r: np.bincount(r - low, minlength=rho.max() - low + 1), 0, rho)
        r, t = np.unravel_index(count.argmax(), count.shape)
        if count[r, t] < votes:
            break
        on = np.flatnonzero(free)[rho[:, t] == r + low]
        along = -x[on] * np.sin(theta[t]) + y[on] * np.cos(theta[t])
        order = np.argsort(along, kind="stable")
        on, along = on[order], along[order]
        for run in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > gap) + 1):
            if along[run[-1]] - along[run[0]] >= least:
                a, b = on[run[0]], on[run[-1]]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
        free[on] = False
    return out


def edge_pixels(images: DataFrame, kind: str = "canny") -> DataFrame:
    """``(img_id, r, c, m, theta)`` of images ``(img_id, image)``: edge pixels with magnitude and orientation.

    ``kind``: ``canny`` (edges only) or ``sobel`` (all pixels with some gradient).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                g = gray(pixels_of(image))
                _, _, m, theta = sobel(g)
                r, c = np.nonzero(canny(g) if kind == "canny" else m > 0)
                yield pd.DataFrame({"img_id": img, "r": r, "c": c, "m": m[r, c], "theta": theta[r, c]})

    return images.select("img_id", "image").mapInPandas(work, "img_id long, r long, c long, m double, theta double")


def segments(images: DataFrame) -> DataFrame:
    """``(img_id, pos, x1, y1, x2, y2)``: line segments of images."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                found = hough_segments(canny(gray(pixels_of(image))))
                yield pd.DataFrame([(img, i, *s) for i, s in enumerate(found)], columns=["img_id", "pos", "x1", "y1", "x2", "y2"])

    return images.select("img_id", "image").mapInPandas(work, "img_id long, pos int, x1 long, y1 long, x2 long, y2 long")


def black_pixels(images: DataFrame) -> DataFrame:
    """``(img_id, r, c)`` of the pixels whose red is 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                g = pixels_of(image)
                r, c = np.nonzero(g[..., min(2, g.shape[2] - 1)] == 0)
                yield pd.DataFrame({"img_id": img, "r": r, "c": c})

    return images.select("img_id", "image").mapInPandas(work, "img_id long, r long, c long")


def coloured_pixels(images: DataFrame, red: int = 255) -> DataFrame:
    """``(img_id, r, c)`` of the pixels of pure red of the given strength."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                r, c = np.nonzero((pixels_of(image)[..., :3] == (0, 0, red)).all(2))
                yield pd.DataFrame({"img_id": img, "r": r, "c": c})

    return images.select("img_id", "image").mapInPandas(work, "img_id long, r long, c long")


def featurize(images: DataFrame, kind: str) -> DataFrame:
    """``(img_id, feature, patch, hist)`` of images: kind BICE (per patch), HOUGH or ARP."""
    from motionq.operators import histograms as H

    if kind == "ARP":
        bins = H.dense(H.arp_bins(edge_pixels(images), ["img_id"]), ["img_id"], [("ab", 18), ("rb", 30)], "n").withColumn("patch", F.lit(None).cast("int"))
    elif kind == "HOUGH":
        bins = H.dense(H.line_bins(segments(images), 10.0, 6.0, ["img_id"]), ["img_id"], [("tb", 30), ("rb", 120)], "weight").withColumn("patch", F.lit(None).cast("int"))
    elif kind == "BICE":
        bins = H.dense(H.patch_bins(edge_pixels(images), ["img_id"]), ["img_id", "patch"], [("bx", 10), ("by", 10), ("bt", 4)], "n")
    else:
        raise ValueError(f"kind is one of {H.KINDS}")
    return bins.select("img_id", F.lit(kind).alias("feature"), "patch", "hist")


def window_mean(m: np.ndarray, width: int = 5, sigma: float = 3.0, floor: float = 4.0) -> np.ndarray:
    """``m`` over its Gaussian mean in a window, that mean being ``floor`` at least; outside of the image is 0."""
    half = width // 2
    one = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma * sigma))
    one = one / one.sum()
    along = lambda a, axis: np.apply_along_axis(lambda r: np.convolve(r, one)[half : half + len(r)], axis, a)
    return m / np.maximum(along(along(np.asarray(m, float), 0), 1), floor)


def matrices(images: DataFrame, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """``(img_id, kind, rows, cols, data)``: normalised magnitude and orientation of each image as row-major matrices.

    ``noise``: spread of seeded Gaussian noise added to the gray image first (none by default).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                _, _, m, theta = sobel(gray(pixels_of(image)), noise, seed + int(img))
                both = {"magnitude": window_mean(m), "orientation": theta}
                yield pd.DataFrame([(img, kind, *v.shape, v.ravel()) for kind, v in both.items()], columns=["img_id", "kind", "rows", "cols", "data"])

    return images.select("img_id", "image").mapInPandas(work, stores.MATRIX)


def batch(spark: SparkSession, folder: str, kinds: list[str], path: str, view_id: int, pattern: str = "*.{png,PNG}") -> None:
    """Encode a folder: scan, featurize for each kind, append to the store at ``path``."""
    found = scan(spark, folder, pattern)
    for kind in kinds:
        stores.write_features(featurize(found, kind).withColumn("view_id", F.lit(view_id)), path)


def batch_sketch(spark: SparkSession, folder: str, pattern: str = "*.{png,PNG}") -> DataFrame:
    """``(patch, hist)`` of a folder of sketch patches named ``row_col``: each file is one patch, described as a whole.

    Other names, and files of too few edge pixels, have no row.
    """
    from motionq.operators import histograms as H
    from motionq.sources import text

    found = text.patch_names(scan(spark, folder, pattern)).where("patch is not null")
    pixels = edge_pixels(found.select(F.col("patch").cast("long").alias("img_id"), "image")).where("r < 60 and c < 60")
    bins = H.dense(H.patch_bins(pixels, ["img_id"]), ["img_id"], [("bx", 10), ("by", 10), ("bt", 4)], "n")
    return bins.select(F.col("img_id").cast("int").alias("patch"), "hist")


def extract_edges(spark: SparkSession, folder: str, path: str, reach: float = 2.0, rounds: int = 3, pattern: str = "*.{png,PNG}") -> None:
    """The edge images of a folder as a matrix store: response from estimated length, orientation and gradients of edge pixels."""
    from motionq.operators import histograms as H

    found = scan(spark, folder, pattern)
    size = found.agg(F.max("image.height").alias("h"), F.max("image.width").alias("w")).first()
    pixels = edge_pixels(found).withColumns({"r": F.col("r").cast("int"), "c": F.col("c").cast("int")})
    lengths = H.edge_lengths(pixels, ["img_id"], reach, size.h or 1, size.w or 1, rounds)
    gx, gy = F.col("m") * F.cos("theta"), F.col("m") * F.sin("theta")
    cells = pixels.join(lengths, ["img_id", "r", "c"]).select("img_id", F.col("r").alias("x"), F.col("c").alias("y"), H.edge_response(F.col("length"), F.col("theta"), gx, gy).alias("v"))
    stores.write_matrices(stores.from_cells(cells, ["img_id"], size.h or 1, size.w or 1).withColumn("kind", F.lit("edges")), path)
