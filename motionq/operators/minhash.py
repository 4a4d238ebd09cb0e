"""Min-hash sketches of patches, the inverted file over their triples, and votes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.functions.rotation import let
from motionq.operators import skew

FAMILIES, TRIPLES, PRIME = 3, 10, 2_147_483_647


def hash_functions(seed: int = 17, families: int = FAMILIES, per: int = TRIPLES) -> list[tuple[int, int]]:
    """``(a, b)`` of ``h(bin) = (a * bin + b) mod PRIME``, family by family."""
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME))) for _ in range(families * per)]


def bins_on(hist: Column, threshold: float | None = None, share: float = 0.2) -> Column:
    """Positions of the bins at or above ``threshold``; by default the highest ``share`` of bins (and ties)."""
    if threshold is None:
        top = F.ceil(F.size(hist) * F.lit(share)).cast("int")
        limit = F.try_element_at(F.sort_array(hist, asc=False), F.greatest(top, F.lit(1)))
    else:
        limit = F.lit(float(threshold))
    marked = F.transform(hist, lambda x, i: F.when(x >= limit, i.cast("long")))
    return F.filter(marked, lambda i: i.isNotNull())


def sketch(hist: Column, functions: list[tuple[int, int]], threshold: float | None = None, share: float = 0.2) -> Column:
    """30 minima; all -1 for a patch whose bins are all equal (or that has none)."""
    hist = hist.cast("array<double>")
    on = bins_on(hist, threshold, share)
    fs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in functions])
    least = lambda bins: F.transform(fs, lambda f: F.array_min(F.transform(bins, lambda i: ((f["a"] * i + f["b"]) % PRIME).cast("int"))))
    none = F.array_repeat(F.lit(-1), len(functions))
    varies = F.coalesce(F.array_min(hist) < F.array_max(hist), F.lit(False))
    # the bins are found once, not once a function
    return F.when(varies, let(on, lambda bins: F.when(F.size(bins) > 0, least(bins)).otherwise(none))).otherwise(none)


def triples(sketches: DataFrame, keys: list[str], h: str = "h", per: int = TRIPLES) -> DataFrame:
    """``(keys, t, h1, h2, h3)``: triple ``t`` takes the t-th value of each of the three families.

    Incomplete triples, and those with an empty value (-1 or null), are left out.
    """
    at = lambda f, t: F.get(h, t + F.lit(f * per))
    out = sketches.where(F.col(h).isNotNull()).select(*keys, h, F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("t"))
    out = out.select(*keys, "t", *[at(f, F.col("t")).alias(f"h{f + 1}") for f in range(FAMILIES)])
    return out.where("h1 <> -1 and h2 <> -1 and h3 <> -1")


def inverted_file(sketches: DataFrame, keys: list[str], h: str = "h") -> DataFrame:
    """Posting rows ``(h1, h2, h3, keys)``, each once; partition by h1 when written."""
    return triples(sketches, keys, h).drop("t").distinct()


def around(patch: str = "patch") -> Column:
    """The 3 x 3 neighbourhood of a patch on the 8 x 8 grid, clipped at the borders."""
    r, c = F.floor(F.col(patch) / 8).cast("int"), (F.col(patch) % 8).cast("int")
    cells = F.array(*[F.struct((r + i).alias("r"), (c + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    kept = F.filter(cells, lambda x: (x["r"] >= 0) & (x["r"] < 8) & (x["c"] >= 0) & (x["c"] < 8))
    return F.transform(kept, lambda x: x["r"] * 8 + x["c"])


def _hits(postings: DataFrame, query: DataFrame, at: list[str], key: str) -> DataFrame:
    """The join with the inverted file; frequent triples, which a sample of images shows, are spread."""
    total = postings.select(F.approx_count_distinct(key)).first()[0]
    return skew.join(postings, query, at, [key], skew.hot_keys(postings, at, [key], total))


def votes(postings: DataFrame, query: DataFrame, by: list[str], key: str = "img_id", neighbours: bool = True) -> DataFrame:
    """``(by, key, votes)``: triples of the query patches found in the inverted file, at the same place or next to it.

    ``postings(h1, h2, h3, key, patch)``, ``query(by, patch, h)``. No row for no vote.
    """
    q = triples(query, [*by, "patch"])
    q = q.withColumn("near", F.explode(around())) if neighbours else q.withColumn("near", F.col("patch"))
    hit = _hits(postings.withColumnRenamed("patch", "near"), q, ["h1", "h2", "h3", "near"], key)
    return hit.groupBy(*by, key).agg(F.count("*").alias("votes"))


def vote_then_correlate(postings: DataFrame, db: DataFrame, query: DataFrame, by: list[str], key: str = "img_id") -> DataFrame:
    """``(by, key, score)``: for each image the patch of most votes (ties: smaller), scored by correlation.

    ``db(key, patch, hist)``, ``query(by, patch, h, hist)``. Scores below 1e-5 are dropped.
    """
    q = triples(query, [*by, "patch"])
    hits = _hits(postings, q, ["h1", "h2", "h3", "patch"], key).groupBy(*by, key, "patch").agg(F.count("*").alias("n"))
    first = hits.groupBy(*by, key).agg(F.max_by("patch", F.struct("n", -F.col("patch"))).alias("patch"))
    both = first.join(db, [key, "patch"]).join(query.select(*by, "patch", F.col("hist").alias("q")), [*by, "patch"])
    return both.select(*by, key, F.round(vec.pearson("hist", "q"), 6).alias("score")).where("score >= 1e-5")


def ranked(votes_: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best keys for each query, ties to the larger key."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.desc(key))
    return votes_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
