"""Pixels, segments and gradients into fixed-length histograms, as Column arithmetic and grouped counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionq.functions import batch, vec

HALF_PI = math.pi / 2
#: Range of the distance of a line from the origin, canvas and patch size, radius of the patch grid.
RHO, CANVAS, CELL = (-500.0, 700.0), 480, 60
#: Levels of the multi-resolution line histogram: (distance, degrees, weight).
LEVELS = ((5.0, 5.0, 0.5), (5.0, 15.0, 0.3), (5.0, 30.0, 0.2))
#: Columns that mark the pieces of a feature kind.
KINDS = ("BICE", "HOUGH", "ARP")


def theta_rho(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Normal angle and distance of the line through a segment. Level segments have angle -+pi/2 by the
    sign of their direction; a segment without length has none (null)."""
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    theta = F.when(dy != 0, F.atan(-F.try_divide(dx, dy))).when(dx > 0, -F.lit(HALF_PI)).when(dx < 0, F.lit(HALF_PI))
    return theta, x1 * F.cos(theta) + y1 * F.sin(theta)


def line_bins(lines: DataFrame, rho_step: float, theta_step: float, keys: list[str]) -> DataFrame:
    """``(keys, tb, rb, weight)``: segments ``x1, y1, x2, y2`` counted by angle and distance bins, weighted by whole length.

    Bins are clamped to the ranges; segments without length are left out.
    """
    rho_bins, theta_bins = int((RHO[1] - RHO[0]) / rho_step), int(math.pi / (math.pi / 180 * theta_step) + 1e-9)
    theta, rho = theta_rho(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = lines.select(*keys, theta.alias("t"), rho.alias("r"), F.floor(F.sqrt((dx * dx + dy * dy).cast("double"))).alias("w")).where("t is not null")
    tb = vec.clamp(F.floor((F.col("t") + F.lit(HALF_PI)) / F.lit(math.pi) * F.lit(float(theta_bins))), 0, theta_bins - 1)
    rb = vec.clamp(F.floor((F.col("r") - F.lit(RHO[0])) / F.lit(RHO[1] - RHO[0]) * F.lit(float(rho_bins))), 0, rho_bins - 1)
    return rows.groupBy(*keys, tb.cast("int").alias("tb"), rb.cast("int").alias("rb")).agg(F.sum("w").alias("weight"))


def bins_correlation(db: DataFrame, query: DataFrame, key: str, cells: int) -> DataFrame:
    """``(key, score)``: Pearson correlation of sparse histograms ``(key, tb, rb, weight)`` with one query histogram.

    Absent bins are 0, and there are ``cells`` in all; constant histograms have no score. The query histogram
    has at most ``cells`` rows, so it is broadcast.
    """
    q = query.select("tb", "rb", F.col("weight").cast("double").alias("q"))
    sq, qq = q.agg(F.sum("q")).scalar(), q.agg(F.sum(F.col("q") * F.col("q"))).scalar()
    w = F.col("weight").cast("double")
    sums = db.join(F.broadcast(q), ["tb", "rb"], "left").groupBy(key).agg(
        F.sum(w * F.coalesce("q", F.lit(0.0))).alias("wq"), F.sum(w).alias("sw"), F.sum(w * w).alias("ww")
    )
    n = F.lit(float(cells))
    sums = sums.withColumns({"sq": sq, "qq": qq})
    up = n * F.col("wq") - F.col("sw") * F.col("sq")
    down = F.sqrt((n * F.col("ww") - F.col("sw") * F.col("sw")) * (n * F.col("qq") - F.col("sq") * F.col("sq")))
    return sums.select(key, F.try_divide(up, down).alias("score"))


def multi_resolution(lines: DataFrame, query: DataFrame, key: str, levels=LEVELS) -> DataFrame:
    """``(key, score)``: weighted sum over resolutions of line histogram correlations."""
    out = None
    for rho, theta, weight in levels:
        cells = int((RHO[1] - RHO[0]) / rho) * int(180 / theta)
        part = bins_correlation(line_bins(lines, rho, theta, [key]), line_bins(query, rho, theta, []), key, cells)
        part = part.select(key, (F.col("score") * F.lit(weight)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"))


def arp_bins(pixels: DataFrame, keys: list[str], rows: int = CANVAS, cols: int = CANVAS, n: int = 18, m: int = 30) -> DataFrame:
    """``(keys, ab, rb, n)``: edge pixels ``r, c`` counted by angle around, and distance from, the centre.

    The farthest corner falls into the last ring.
    """
    x, y = F.col("r") - F.lit(rows // 2), F.col("c") - F.lit(cols // 2)
    reach = math.sqrt(rows * rows + cols * cols) / 2
    theta = F.atan2(y.cast("double"), x.cast("double"))
    theta = F.when(theta < 0, theta + F.lit(2 * math.pi)).otherwise(theta)
    ab = F.least(F.floor(theta / F.lit(2 * math.pi) * F.lit(float(n))), F.lit(n - 1)).cast("int")
    rb = F.least(F.floor(F.sqrt((x * x + y * y).cast("double")) / F.lit(reach) * F.lit(float(m))), F.lit(m - 1)).cast("int")
    return pixels.groupBy(*keys, ab.alias("ab"), rb.alias("rb")).agg(F.count("*").alias("n"))


def patch_of(r: Column, c: Column) -> Column:
    """Patch 0..63 on the 8 x 8 grid of cells."""
    return (F.floor(r / F.lit(CELL)) * 8 + F.floor(c / F.lit(CELL))).cast("int")


def patch_bins(pixels: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """``(keys, patch, bx, by, bt, n)``: noise-free patch descriptor, 10 x 10 x 4 bins over turned positions.

    ``pixels`` has ``r, c, theta``. Positions relative to the patch centre are turned by ``theta``; values out of
    range fall into bin 0. Patches of fewer than ``least`` pixels are empty and have no rows.
    """
    p = pixels.withColumn("patch", patch_of(F.col("r"), F.col("c")))
    x, y = F.col("r") % CELL - F.lit(30.0), F.col("c") % CELL - F.lit(30.0)
    u, v = x * F.cos("theta") - y * F.sin("theta"), x * F.sin("theta") + y * F.cos("theta")

    def place(value: Column, low: float, high: float, n: int) -> Column:
        inside = (value >= low) & (value < high)
        return F.when(inside, F.floor((value - F.lit(low)) / F.lit((high - low) / n))).otherwise(0).cast("int")

    cells = p.select(*keys, "patch", place(u, -50.0, 50.0, 10).alias("bx"), place(v, -50.0, 50.0, 10).alias("by"), place(F.col("theta"), 0.0, 6.283, 4).alias("bt"))
    counts = cells.groupBy(*keys, "patch", "bx", "by", "bt").agg(F.count("*").alias("n"))
    enough = counts.groupBy(*keys, "patch").agg(F.sum("n").alias("t")).where(F.col("t") >= least).drop("t")
    return counts.join(enough, [*keys, "patch"])


def orientation_split(pixels: DataFrame, keys: list[str], magnitude: str = "m", theta: str = "theta", bins: int = 8) -> DataFrame:
    """``(keys, bin, m)``: each magnitude shared linearly between the two nearest of ``bins`` directions over [0, pi).

    Angles above pi are turned back by pi; from the last direction on all goes to it. Zero shares are dropped.
    """
    step = math.pi / bins
    t = F.when(F.col(theta) > F.lit(math.pi), F.col(theta) - F.lit(math.pi)).otherwise(F.col(theta))
    k = F.least(F.floor(t / F.lit(step)), F.lit(bins - 1)).cast("int")
    part = F.when(k == bins - 1, F.lit(0.0)).otherwise(t / F.lit(step) - k)
    rows = pixels.select(*keys, k.alias("k"), part.alias("part"), F.col(magnitude).alias("m0"))
    two = F.array(
        F.struct(F.col("k").alias("bin"), ((F.lit(1.0) - F.col("part")) * F.col("m0")).alias("m")),
        F.struct((F.col("k") + 1).alias("bin"), (F.col("part") * F.col("m0")).alias("m")),
    )
    out = rows.select(*keys, F.explode(two).alias("s")).select(*keys, "s.bin", "s.m")
    return out.where((F.col("bin") < bins) & (F.col("m") != 0))


def edge_correlation(db: DataFrame, sketch: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """``(keys, positive, negative)``: products of the same direction, and of directions half of ``bins`` apart, summed.

    ``db(keys, x, y, bin, m)``, ``sketch(x, y, bin, m)``: equi-joins on cell and direction.
    """
    q = sketch.select("x", "y", F.col("bin").alias("qb"), F.col("m").alias("q"))
    both = F.explode(F.array(F.struct(F.col("qb").alias("bin"), F.lit(True).alias("same")), F.struct(((F.col("qb") + bins // 2) % bins).cast("int").alias("bin"), F.lit(False).alias("same"))))
    q = q.withColumn("to", both).select("x", "y", "q", "to.bin", "to.same")
    hit = db.join(q, ["x", "y", "bin"])
    part = F.col("m") * F.col("q")
    return hit.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("same"), part).otherwise(0.0)), 6).alias("positive"), F.round(F.sum(F.when(~F.col("same"), part).otherwise(0.0)), 6).alias("negative")
    )


def gauss_norm(grid: DataFrame, keys: list[str], width: int = 5, sigma: float = 3.0, mode: str = "mean", floor: float = 4.0) -> DataFrame:
    """``(keys, x, y, v)``: each cell over the Gaussian mean of its window, that mean being ``floor`` at least.

    ``mode="centre"`` weighs the cell itself instead of its neighbours (the summed weights of the window inside
    the grid times the cell), as some published encoders do. The window is a bounded set of offsets.
    """
    half = width // 2
    one = [math.exp(-(a * a) / (2 * sigma * sigma)) for a in range(-half, half + 1)]
    one = [w / sum(one) for w in one]
    around = smeared(grid.select(*keys, "x", "y", F.col("v").alias("s"), F.lit(1.0).alias("ws")), keys, one, ["s", "ws"])
    mean = F.col("s") if mode == "mean" else F.col("v") * F.col("ws")
    return grid.join(around, [*keys, "x", "y"]).select(*keys, "x", "y", F.round(F.col("v") / F.greatest(mean, F.lit(floor)), 6).alias("v"))


def smeared(grid: DataFrame, keys: list[str], weights: list[float], values: list[str]) -> DataFrame:
    """``(keys, x, y, values)``: weighted sums over a window, one axis after the other.

    A cell becomes one row for each weight of an axis and is summed before the next axis, not one for each cell of the window.
    """
    half = len(weights) // 2
    for axis in "xy":
        spread = F.explode(F.array(*[F.struct(F.lit(i - half).alias("a"), F.lit(w).alias("w")) for i, w in enumerate(weights)]))
        moved = grid.withColumn("_o", spread).withColumns({axis: F.col(axis) + F.col("_o.a"), **{v: F.col(v) * F.col("_o.w") for v in values}})
        grid = moved.groupBy(*keys, "x", "y").agg(*[F.sum(v).alias(v) for v in values])
    return grid


def pyramid(grid: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """``(keys, level, x, y, v)``: repeated halving by means of 2 x 2 cells; level 0 is the grid itself."""
    level = grid.select(*keys, "x", "y", "v")
    out = level.select(*keys, F.lit(0).alias("level"), "x", "y", F.round("v", 6).alias("v"))
    for i in range(1, levels + 1):
        level = level.groupBy(*keys, F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y")).agg(F.avg("v").alias("v"))
        out = out.unionByName(level.select(*keys, F.lit(i).alias("level"), "x", "y", F.round("v", 6).alias("v")))
    return out


def project_pixels(pixels: DataFrame, keys: list[str], reach: float, rows: int, cols: int) -> DataFrame:
    """``(keys, r, c, side, k, pr, pc)``: the four cells around the point ``reach`` ahead (side 1) and behind (side 2).

    ``k`` numbers the rounding: up/up, up/down, down/up, down/down. Cells are clamped to the canvas.
    """
    out = None
    for side, sign in ((1, 1.0), (2, -1.0)):
        a = F.col("r") + F.lit(sign * reach) * F.cos("theta")
        b = F.col("c") + F.lit(sign * reach) * F.sin("theta")
        hold = lambda v, top: F.greatest(F.least(v, F.lit(top - 1)), F.lit(0)).cast("int")
        four = F.array(*[F.struct(F.lit(k).alias("k"), hold(f(a), rows).alias("pr"), hold(g(b), cols).alias("pc")) for k, (f, g) in enumerate(((F.ceil, F.ceil), (F.ceil, F.floor), (F.floor, F.ceil), (F.floor, F.floor)))])
        part = pixels.select(*keys, "r", "c", F.lit(side).alias("side"), F.explode(four).alias("p")).select(*keys, "r", "c", "side", "p.k", "p.pr", "p.pc")
        out = part if out is None else out.unionByName(part)
    return out


def edge_response(length: Column, theta: Column, gx: Column, gy: Column) -> Column:
    sx, sy = F.cos(theta) * F.cos(theta) * length * gx, F.sin(theta) * F.sin(theta) * length * gy
    return F.sqrt(sx * sx + sy * sy)


def edge_lengths(pixels: DataFrame, keys: list[str], reach: float, rows: int, cols: int, rounds: int = 3) -> DataFrame:
    """``(keys, r, c, length)`` by message passing along the edge direction.

    In each round a pixel hears from its four projected cells on either side, messages weighted by 0.25 and by
    how well directions agree (Gaussian of the difference, spread 2 pi / 5). All pixels are updated at once,
    so the order of pixels has no influence. ``pixels`` has ``r, c, theta, m``.
    """
    links = project_pixels(pixels, keys, reach, rows, cols)
    ahead = pixels.select(*keys, F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("theta").alias("pt"))
    gap = F.col("theta") - F.col("pt")
    links = links.join(pixels.select(*keys, "r", "c", "theta"), [*keys, "r", "c"]).join(ahead, [*keys, "pr", "pc"])
    links = links.select(*keys, "r", "c", "side", "pr", "pc", (F.lit(0.25) * F.exp(-gap * gap / F.lit(2 * math.pi / 5))).alias("w"))
    state = pixels.select(*keys, "r", "c", "m", F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2"))
    for _ in range(rounds):
        heard = state.select(*keys, F.col("r").alias("pr"), F.col("c").alias("pc"), "m1", "m2")
        each = links.join(heard, [*keys, "pr", "pc"]).withColumn("old", F.when(F.col("side") == 1, F.col("m1")).otherwise(F.col("m2")))
        sums = each.groupBy(*keys, "r", "c").agg(
            *[F.sum(F.when(F.col("side") == s, F.col("w"))).alias(f"w{s}") for s in (1, 2)], *[F.sum(F.when(F.col("side") == s, F.col("w") * F.col("old"))).alias(f"o{s}") for s in (1, 2)]
        )
        new = lambda s: (F.col("m") * F.coalesce(f"w{s}", F.lit(0.0)) + F.coalesce(f"o{s}", F.lit(0.0))).alias(f"m{s}")
        state = state.drop("m1", "m2").join(sums, [*keys, "r", "c"], "left").select(*keys, "r", "c", "m", new(1), new(2))
    return state.select(*keys, "r", "c", F.round(F.col("m1") + F.col("m2") + F.col("m"), 6).alias("length"))


def diffuse(grid: DataFrame, keys: list[str], reach: int = 20, sigma: float = 5.0, threshold: float = 0.1) -> DataFrame:
    """``(keys, x, y, v)``: the box around the cells of some value, blank cells filled from those above ``threshold``.

    Each cell above the threshold adds its Gaussian to blank cells within ``reach``; the result is scaled by its
    least and greatest value to 0..1000. The Gaussian goes along one axis after the other.
    """
    box = grid.where("v > 0").groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    strong = grid.where(F.col("v") > threshold).select(*keys, "x", "y", F.col("v").alias("g"))
    gift = smeared(strong, keys, [math.exp(-(a * a) / (2 * sigma * sigma)) for a in range(-reach, reach + 1)], ["g"])
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    cells = grid.select(*keys, "x", "y", "v").join(gift, [*keys, "x", "y"], "full").join(box, keys).where(inside)
    v = F.coalesce("v", F.lit(0.0))
    cells = cells.select(*keys, "x", "y", F.when(v > threshold, v).otherwise(v + F.coalesce("g", F.lit(0.0))).alias("v"))
    ends = cells.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return cells.join(ends, keys).select(*keys, "x", "y", F.round(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * 1000, F.col("hi") - F.col("lo")), F.lit(0.0)), 6).alias("v"))


def dense(bins: DataFrame, keys: list[str], shape: list[tuple[str, int]], value: str) -> DataFrame:
    """``(keys, hist)``: sparse bins as one row-major array of doubles per key (bounded by the shape)."""
    at = None
    for name, n in shape:
        at = F.col(name) if at is None else at * n + F.col(name)
    size = int(np.prod([n for _, n in shape]))
    pairs = bins.select(*keys, F.struct(at.cast("int").alias("at"), F.col(value).cast("double").alias("w")).alias("p"))
    m = pairs.groupBy(*keys).agg(F.collect_list("p").alias("m"))
    return m.select(*keys, batch.filled(F.transform("m", lambda p: p["at"]), F.transform("m", lambda p: p["w"]), size).alias("hist"))
