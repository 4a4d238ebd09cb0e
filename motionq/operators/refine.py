"""Particle swarm refinement: the state is a DataFrame, a step is Column arithmetic and one small aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inertia, pull of the swarm's and the particle's best, and greatest speed (fixed values).
INERTIA, SOCIAL, OWN, TOP = 0.8, 1.9, 1.9, 10.0
#: Most particles: the swarm is a search aid, not data.
PARTICLES = 10_000


def start(spark: SparkSession, particles: int, dim: int, seed: int = 1, low: float = -100.0, high: float = 100.0) -> DataFrame:
    """``(pid, x, v)``: seeded positions in [low, high], at rest."""
    if particles > PARTICLES:
        raise ValueError(f"at most {PARTICLES} particles")
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _uniform(F.col("pid"), F.lit(0), i, F.lit(0), seed) * F.lit(high - low) + F.lit(low))
    return spark.range(particles).select(F.col("id").alias("pid")).select("pid", x.alias("x"), F.array_repeat(F.lit(0.0), dim).alias("v"))


def _uniform(particle: Column, step: Column, dim: Column, draw: Column, seed: int) -> Column:
    """A number in [0, 1) for a particle, step, dimension and draw: two rounds of a multiplicative congruence."""
    mixed = particle.cast("long") * 7919 + step.cast("long") * 104_729 + dim.cast("long") * 1_299_709 + draw.cast("long") * 15_485_863 + seed * 32_452_843
    return (mixed % 2_147_483_647 * 48_271 % 2_147_483_647) / F.lit(2_147_483_647.0)


def refine(swarm: DataFrame, cost: Callable[[Column], Column], steps: int, seed: int = 1) -> tuple[Sequence[float], float, DataFrame]:
    """Best position, its cost, and the final swarm after ``steps`` steps.

    A step: ``x += v``; ``v = 0.8 v + 1.9 r1 (best - x) + 1.9 r2 (own best - x)``, limited to TOP. Draws depend on
    seed, step, particle and dimension only, so runs repeat. Only the best particle of a step comes to the driver;
    lineage is cut every step by the bounded state itself (at most PARTICLES rows).
    """
    spark = swarm.sparkSession
    schema = "pid long, x array<double>, v array<double>, p array<double>, pc double"
    swarm = swarm.select("pid", "x", "v", F.col("x").alias("p"), cost(F.col("x")).alias("pc"))
    swarm = spark.createDataFrame(swarm.toArrow(), schema)
    for step in range(steps + 1):
        top = swarm.orderBy("pc", "pid").select("p", "pc").first()
        if step == steps:
            return list(top.p), float(top.pc), swarm
        g = F.array(*[F.lit(float(q)) for q in top.p])
        x = F.zip_with("x", "v", lambda a, b: a + b)
        moved = swarm.select("pid", x.alias("x"), "v", "p", "pc")

        moved = moved.withColumn("v", F.transform(F.sequence(F.lit(0), F.size("x") - 1), _pull(g, seed, step))).withColumn("c", cost(F.col("x")))
        better = F.col("c") < F.col("pc")
        moved = moved.select("pid", "x", "v", F.when(better, F.col("x")).otherwise(F.col("p")).alias("p"), F.when(better, F.col("c")).otherwise(F.col("pc")).alias("pc"))
        swarm = spark.createDataFrame(moved.toArrow(), schema)
    raise AssertionError


def _pull(best: Column, seed: int, step: int) -> Callable[[Column], Column]:
    """The new speed in a dimension."""

    def speed(i: Column) -> Column:
        at = lambda c: F.get(c, i)
        r1, r2 = (_uniform(F.col("pid"), F.lit(step + 1), i, F.lit(n), seed) for n in (1, 2))
        v = at(F.col("v")) * F.lit(INERTIA) + F.lit(SOCIAL) * r1 * (at(best) - at(F.col("x"))) + F.lit(OWN) * r2 * (at(F.col("p")) - at(F.col("x")))
        return F.greatest(F.least(v, F.lit(TOP)), F.lit(-TOP))

    return speed


def lucas_kanade(db, sketch, levels: int = 3, rounds: int = 10):
    """``(dx, dy)`` that moves grid ``sketch`` onto grid ``db`` (numpy arrays): Gauss-Newton on a pyramid, coarse to fine."""
    import numpy as np

    def half(a):
        a = a[: len(a) // 2 * 2, : a.shape[1] // 2 * 2]
        return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4

    def shifted(a, dx, dy):
        r, c = np.indices(a.shape, float)
        r, c = np.clip(r + dx, 0, a.shape[0] - 1.001), np.clip(c + dy, 0, a.shape[1] - 1.001)
        i, j = r.astype(int), c.astype(int)
        u, w = r - i, c - j
        return (1 - u) * (1 - w) * a[i, j] + u * (1 - w) * a[i + 1, j] + (1 - u) * w * a[i, j + 1] + u * w * a[i + 1, j + 1]

    grids = [(np.asarray(db, float), np.asarray(sketch, float))]
    for _ in range(levels - 1):
        grids.append((half(grids[-1][0]), half(grids[-1][1])))
    d = np.zeros(2)
    for target, source in reversed(grids):
        d = d * 2
        for _ in range(rounds):
            moved = shifted(target, *d)
            gx, gy = np.gradient(moved)
            e = source - moved
            a = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]])
            if abs(np.linalg.det(a)) < 1e-12:
                break
            d = d + np.linalg.solve(a, [(gx * e).sum(), (gy * e).sum()])
    return tuple(float(x) for x in d)


def aligned(db: DataFrame, sketch: DataFrame, keys: list[str], levels: int = 3, rounds: int = 10, most: int = 1_000_000) -> DataFrame:
    """``(keys, dx, dy)``: ``lucas_kanade`` of grid ``sketch(x, y, v)`` on each grid of ``db(keys, x, y, v)``.

    Absent cells are 0. The sketch (at most ``most`` cells, checked) is sent to the tasks; a group is one image.
    """
    import numpy as np
    import pandas as pd

    cells = sketch.limit(most + 1).toPandas()
    if len(cells) > most:
        raise ValueError("the sketch has too many cells")
    shape = (int(cells["x"].max()) + 1, int(cells["y"].max()) + 1) if len(cells) else (1, 1)

    def grid(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(shape)
        pdf = pdf[(pdf["x"] >= 0) & (pdf["x"] < shape[0]) & (pdf["y"] >= 0) & (pdf["y"] < shape[1])]
        out[pdf["x"].to_numpy(int), pdf["y"].to_numpy(int)] = pdf["v"]
        return out

    drawn = grid(cells)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        dx, dy = lucas_kanade(grid(pdf), drawn, levels, rounds)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "dx": [dx], "dy": [dy]})

    kinds = ", ".join(f"{k} {db.schema[k].dataType.simpleString()}" for k in keys)
    return db.select(*keys, "x", "y", "v").groupBy(*keys).applyInPandas(work, f"{kinds}, dx double, dy double")
