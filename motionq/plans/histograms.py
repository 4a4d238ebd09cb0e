"""Histogram and image queries. Segments and pixels are drawn from ``lineitem`` keys; an image is ``l_orderkey % 50``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.operators import histograms as H
from motionq.operators import search
from motionq.plans.common import Catalogue, read

query = Catalogue()
_LINES = """s as (select (l_orderkey % 50)::bigint img, (l_partkey % 480)::bigint x1, (l_suppkey % 480)::bigint y1, (l_orderkey % 480)::bigint x2, ((l_linenumber * 67) % 480)::bigint y2 from lineitem),
t as (select *, floor(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::double)) w,
  case when y2 <> y1 then atan(-((x2 - x1)::double / (y2 - y1)::double)) when x2 > x1 then -1.5707963267948966::double when x2 < x1 then 1.5707963267948966::double end theta from s),
l as (select *, x1 * cos(theta) + y1 * sin(theta) rho from t where theta is not null)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    big = lambda e: F.expr(e).cast("long")
    return l.select(big("l_orderkey % 50").alias("img"), big("l_partkey % 480").alias("x1"), big("l_suppkey % 480").alias("y1"), big("l_orderkey % 480").alias("x2"), big("(l_linenumber * 67) % 480").alias("y2"))


def _bins_sql(rho: float, theta: float) -> str:
    n, m = int(1200 / rho), int(180 / theta)
    return f"""greatest(least(floor((theta + 1.5707963267948966::double) / 3.141592653589793::double * {m}.0::double), {m - 1}), 0)::int tb,
greatest(least(floor((rho + 500.0::double) / 1200.0::double * {n}.0::double), {n - 1}), 0)::int rb"""


@query(f"with {_LINES} select img, {_bins_sql(10, 6)}, sum(w)::bigint weight from l group by all")
def line_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.line_bins(segments(spark, sf_dir), 10.0, 6.0, ["img"])


def _level_sql(i: int, rho: float, theta: float, weight: float) -> str:
    cells = int(1200 / rho) * int(180 / theta)
    return f"""select img, {weight}::double * ({cells} * sum(w * coalesce(q, 0)) - sum(w) * any_value(sq)) / sqrt(({cells} * sum(w * w) - sum(w) * sum(w)) * ({cells} * any_value(qq) - any_value(sq) * any_value(sq))) s
from b{i} left join (select tb, rb, w q from b{i} where img = 0) using (tb, rb), (select sum(w) sq, sum(w * w) qq from b{i} where img = 0) group by img"""


@query(
    f"with {_LINES}, "
    + ", ".join(f"b{i} as (select img, {_bins_sql(r, t)}, sum(w)::double w from l group by all)" for i, (r, t, _) in enumerate(H.LEVELS))
    + " select img, round(sum(s), 6) score from ("
    + " union all ".join(_level_sql(i, *level) for i, level in enumerate(H.LEVELS))
    + ") group by img order by score desc, img desc limit 50"
)
def line_multires_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return search.best(H.multi_resolution(s, s.where("img = 0"), "img"), "score", "img", 50)


_PIXELS = "p as (select distinct (l_orderkey % 50)::bigint img, (l_partkey % 480)::bigint r, (l_orderkey % 480)::bigint c, (l_suppkey % 628)::double / 100.0::double theta, l_quantity m from lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    big = lambda e: F.expr(e).cast("long")
    return l.select(big("l_orderkey % 50").alias("img"), big("l_partkey % 480").alias("r"), big("l_orderkey % 480").alias("c"), (big("l_suppkey % 628").cast("double") / F.lit(100.0)).alias("theta"), F.col("l_quantity").alias("m")).distinct()


@query(f"""with {_PIXELS}, e as (select distinct img, r, c from p), t as (select img, atan2((c - 240)::double, (r - 240)::double) a, sqrt(((r - 240) * (r - 240) + (c - 240) * (c - 240))::double) d from e)
select img, least(floor((case when a < 0 then a + {2 * math.pi!r}::double else a end) / {2 * math.pi!r}::double * 18.0::double), 17)::int ab, least(floor(d / {math.sqrt(2 * 480 * 480) / 2!r}::double * 30.0::double), 29)::int rb, count(*) n from t group by all""")
def arp_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.arp_bins(pixels(spark, sf_dir).select("img", "r", "c").distinct(), ["img"])


@query(f"""with {_PIXELS}, u as (select img, ((r // 60) * 8 + c // 60)::int patch, (r % 60 - 30.0::double) x, (c % 60 - 30.0::double) y, theta from p),
v as (select img, patch, x * cos(theta) - y * sin(theta) a, x * sin(theta) + y * cos(theta) b, theta from u),
w as (select img, patch, (case when a >= -50 and a < 50 then floor((a + 50.0::double) / 10.0::double) else 0 end)::int bx, (case when b >= -50 and b < 50 then floor((b + 50.0::double) / 10.0::double) else 0 end)::int "by",
  (case when theta >= 0 and theta < 6.283::double then floor(theta / {6.283 / 4!r}::double) else 0 end)::int bt, count(*) n from v group by all)
select * from w qualify sum(n) over (partition by img, patch) >= 6""")
def bice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.patch_bins(pixels(spark, sf_dir), ["img"])


_SPLIT = f"""t as (select img, r, c, m, case when theta > {math.pi!r}::double then theta - {math.pi!r}::double else theta end t from p),
k as (select *, least(floor(t / {math.pi / 8!r}::double), 7)::int k from t), a as (select *, case when k = 7 then 0.0::double else t / {math.pi / 8!r}::double - k end part from k),
o as (select img, r, c, k bin, (1.0::double - part) * m m from a union all select img, r, c, k + 1 bin, part * m m from a where k < 7)"""


@query(f"with {_PIXELS}, {_SPLIT} select img, r, c, bin, round(sum(m), 6) m, count(*) n from o where m <> 0 group by all")
def orient_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = H.orientation_split(pixels(spark, sf_dir), ["img", "r", "c"])
    return o.groupBy("img", "r", "c", "bin").agg(F.round(F.sum("m"), 6).alias("m"), F.count("*").alias("n"))


@query(f"""with {_PIXELS}, {_SPLIT}, d as (select img, r // 16 x, c // 16 y, bin, sum(m) m from o where m <> 0 group by all), q as (select x, y, bin, m q from d where img = 0),
j as (select img, case when d.bin = q.bin then m * q else 0 end pos, case when d.bin = (q.bin + 4) % 8 then m * q else 0 end neg from d join q on d.x = q.x and d.y = q.y and (d.bin = q.bin or d.bin = (q.bin + 4) % 8))
select img, round(sum(pos), 6) positive, round(sum(neg), 6) negative from j group by img""")
def edge_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed images on a grid of 16 pixels against image 0."""
    o = H.orientation_split(pixels(spark, sf_dir), ["img", "r", "c"])
    d = o.groupBy("img", F.expr("r div 16").alias("x"), F.expr("c div 16").alias("y"), "bin").agg(F.sum("m").alias("m"))
    return H.edge_correlation(d, d.where("img = 0").drop("img"), ["img"])


_GRID = f"{_PIXELS}, g as (select img, r // 16 x, c // 16 y, sum(m) v from p group by all)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("img", F.expr("r div 16").alias("x"), F.expr("c div 16").alias("y")).agg(F.sum("m").alias("v"))


_W = [(a, b, math.exp(-(a * a + b * b) / 18)) for a in range(-2, 3) for b in range(-2, 3)]
_WT = sum(w for *_, w in _W)


@query(f"""with {_GRID}, w as (select * from (values {", ".join(f"({a}, {b}, {w / _WT!r}::double)" for a, b, w in _W)}) t(a, b, w)),
n as (select g.img, g.x, g.y, any_value(g.v) v, sum(w.w * h.v) s from g join w on true join g h on h.img = g.img and h.x = g.x + w.a and h.y = g.y + w.b group by 1, 2, 3)
select img, x, y, round(v / greatest(s, 4.0::double), 6) v from n""")
def gauss_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.gauss_norm(grid(spark, sf_dir), ["img"])


@query(f"""with {_GRID}, a as (select img, x // 2 x, y // 2 y, avg(v) v from g group by all), b as (select img, x // 2 x, y // 2 y, avg(v) v from a group by all), c as (select img, x // 2 x, y // 2 y, avg(v) v from b group by all)
select img, 0 "level", x, y, round(v, 6) v from g union all select img, 1, x, y, round(v, 6) from a union all select img, 2, x, y, round(v, 6) from b union all select img, 3, x, y, round(v, 6) from c""")
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pyramid(grid(spark, sf_dir), ["img"])


@query(f"""with {_PIXELS}, s as (select *, unnest([1, 2]) side from p), z as (select *, r + (case side when 1 then 5.0::double else -5.0::double end) * cos(theta) a, c + (case side when 1 then 5.0::double else -5.0::double end) * sin(theta) b from s),
k as (select *, unnest([0, 1, 2, 3]) k from z)
select img, r, c, side, k, greatest(least(case when k < 2 then ceil(a) else floor(a) end, 479), 0)::int pr, greatest(least(case when k % 2 = 0 then ceil(b) else floor(b) end, 479), 0)::int pc, count(*) n from k group by all""")
def pixel_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = H.project_pixels(pixels(spark, sf_dir), ["img", "m"], 5.0, 480, 480)
    return p.groupBy("img", "r", "c", "side", "k", "pr", "pc").agg(F.count("*").alias("n"))


@query(f"with {_PIXELS} select img, min(r) x0, min(c) y0, max(r) x1, max(c) y1 from p where m > 25 group by img")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where("m > 25").groupBy("img").agg(F.min("r").alias("x0"), F.min("c").alias("y0"), F.max("r").alias("x1"), F.max("c").alias("y1"))


@query(f"""with {_PIXELS} select img, r, c, theta, m, round(sqrt(pow(cos(theta) * cos(theta) * m * (r - 240)::double, 2) + pow(sin(theta) * sin(theta) * m * (c - 240)::double, 2)), 6) response from p""")
def edge_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response with the magnitude as length and the position as gradient."""
    gx, gy = ((F.col(c) - F.lit(240)).cast("double") for c in ("r", "c"))
    return pixels(spark, sf_dir).withColumn("response", F.round(H.edge_response(F.col("m"), F.col("theta"), gx, gy), 6))


@query(f"""with {_GRID}, box as (select img, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from g where v > 0 group by img), o as (select * from range(-20, 21) a(a), range(-20, 21) b(b)),
gift as (select img, x + a x, y + b y, sum(v * exp(-((a * a + b * b)::double) / 50.0::double)) gift from g, o where v > 60 group by 1, 2, 3),
c as (select img, x, y, case when coalesce(v, 0) > 60 then v else coalesce(v, 0) + coalesce(gift, 0) end v from g full join gift using (img, x, y) join box using (img) where x between x0 and x1 and y between y0 and y1)
select img, x, y, round(coalesce((v - min(v) over i) * 1000 / nullif(max(v) over i - min(v) over i, 0), 0), 6) v from c window i as (partition by img)""")
def contour_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.diffuse(grid(spark, sf_dir), ["img"], reach=20, sigma=5.0, threshold=60.0)


def _length_sql(rounds: int) -> str:
    four = " union all ".join(
        f"select img, r, c, theta, {side} side, greatest(least({f}(r + {sign} * cos(theta)), 479), 0)::int pr, greatest(least({g}(c + {sign} * sin(theta)), 479), 0)::int pc from o"
        for side, sign in ((1, "2.0::double"), (2, "-2.0::double")) for f in ("ceil", "floor") for g in ("ceil", "floor")
    )
    out = [_PIXELS, "o as (select img, r::int r, c::int c, min(theta) theta, max(m) m from p group by 1, 2, 3)", f"z as ({four})"]
    out.append(f"l as (select z.img, z.r, z.c, side, pr, pc, 0.25::double * exp(-(z.theta - o.theta) * (z.theta - o.theta) / {2 * math.pi / 5!r}::double) w from z join o on o.img = z.img and o.r = pr and o.c = pc)")
    out.append("s0 as (select img, r, c, m, 0.0::double m1, 0.0::double m2 from o)")
    for i in range(rounds):
        one = lambda s: f"m * coalesce(sum(w) filter (where side = {s}), 0) + coalesce(sum(w * n.m{s}) filter (where side = {s}), 0) m{s}"
        old = f"(select l.*, h.m1, h.m2 from l join s{i} h on h.img = l.img and h.r = pr and h.c = pc)"
        out.append(f"s{i + 1} as (select s.img, s.r, s.c, s.m, {one(1)}, {one(2)} from s{i} s left join {old} n on n.img = s.img and n.r = s.r and n.c = s.c group by 1, 2, 3, 4)")
    return f"with {', '.join(out)} select img, r, c, round(m1 + m2 + m, 6) length from s{rounds}"


@query(_length_sql(3))
def edge_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message passing, three rounds."""
    one = pixels(spark, sf_dir).groupBy("img", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).agg(F.min("theta").alias("theta"), F.max("m").alias("m"))
    return H.edge_lengths(one, ["img"], 2.0, 480, 480)
