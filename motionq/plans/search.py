"""Search queries over ``embeddings`` (64 = 8 x 8 patches) and ``points``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.operators import search
from motionq.plans.common import E_SQL, U_SQL, Catalogue, read, usable_points, vector_of, vectors

query = Catalogue()
LIMBS = {p: round(1 / (p + 1), 4) for p in range(7)}
SKETCH = (0, 3, 6)


@query(f"""with {E_SQL}, q as (select i, v from e where vec_id = 0)
select e.vec_id, round(corr(e.v, q.v), 6) score from e join q using (i) group by e.vec_id order by score desc, vec_id desc limit 10""")
def corr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    return search.correlate(e, vector_of(e, 0), "vec_id", "v", 10)


@query(f"""with {E_SQL}, q as (select i, v from e where vec_id = 0), w as (select * from (values {", ".join(f"({p}, {w})" for p, w in LIMBS.items())}) t(limb, weight)),
c as (select e.vec_id, least((i - 1) // 9, 6) limb, corr(e.v, q.v) c from e join q using (i) group by 1, 2)
select vec_id, round(sum(c * weight::double), 6) score from c join w using (limb) group by vec_id order by score desc, vec_id desc limit 50""")
def limb_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    q = vector_of(e, 0)
    parts = F.array(*[F.struct(F.lit(p).alias("limb"), vec.piece("v", 9 * p, 9 if p < 6 else 10).alias("part")) for p in LIMBS])
    db = e.select("vec_id", F.explode(parts).alias("x")).select("vec_id", "x.limb", "x.part")
    return search.fused(db, {p: q[9 * p : 9 * p + 9 if p < 6 else None] for p in LIMBS}, LIMBS, "vec_id", "limb", "part")


@query(f"""with {E_SQL}, q as (select i, v from e where vec_id = 1 and (i - 1) // 8 in {SKETCH}),
c as (select e.vec_id, (i - 1) // 8 patch, corr(e.v, q.v) c from e join q using (i) group by 1, 2)
select vec_id img_id, round(sum(coalesce(c, 0)), 6) score from c group by vec_id order by score desc, img_id desc limit 50""")
def patch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("img_id"), "v")
    parts = F.array(*[F.struct(F.lit(p).alias("patch"), vec.piece("v", 8 * p, 8).alias("hist")) for p in range(8)])
    db = e.select("img_id", F.explode(parts).alias("x")).select("img_id", "x.patch", "x.hist")
    return search.patch_search(db, db.where(F.col("img_id") == 1).where(F.col("patch").isin(*SKETCH)).drop("img_id"))


def _knn(norm):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = vectors(spark, sf_dir)
        return search.nearest(e, vector_of(e, 0), "vec_id", "v", 50, norm)

    return run


for _name, _norm, _sql in (
    ("knn_l2sq", "l2sq", "sum((e.v - q.v) * (e.v - q.v))"),
    ("knn_l1", "l1", "sum(abs(e.v - q.v))"),
    ("knn_linf", "linf", "max(abs(e.v - q.v))"),
    ("knn_l3", 3.0, "pow(sum(pow(abs(e.v - q.v), 3.0)), 1.0::double / 3.0)"),
):
    _f = _knn(_norm)
    _f.__name__ = _name
    query(f"""with {E_SQL}, q as (select i, v from e where vec_id = 0)
select e.vec_id, round({_sql}, 6) distance from e join q using (i) group by e.vec_id order by distance, vec_id limit 50""")(_f)

_PAIRS = f"""with {E_SQL}, p as (select q.vec_id query, d.vec_id "key", round(sqrt(sum((q.v - d.v) * (q.v - d.v))), 6) distance
  from e q join e d on q.i = d.i and q.vec_id <> d.vec_id where q.vec_id % 20 = 0 group by 1, 2)"""


@query(f"""{_PAIRS}, n as (select query, count(*) "within" from p where distance <= 1.25 group by 1),
r as (select query, row_number() over (partition by query order by distance, "key") rank, "key", distance from p where distance <= 1.25)
select query, rank, "key", distance, "within" from r join n using (query) where rank <= 5""")
def radius_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    e = vectors(spark, sf_dir)
    return search.radius_search(e, e.where("vec_id % 20 = 0"), 1.25, 5, "vec_id", "v")


@query(f"""{_PAIRS} select e.vec_id query, count(p.query) "within" from (select distinct vec_id from e where vec_id % 20 = 0) e left join p on p.query = e.vec_id and distance <= 1.3 group by 1""")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    return search.radius_search(e, e.where("vec_id % 20 = 0"), 1.3, 0, "vec_id", "v").select("query", "within")


@query(f"""{_PAIRS}, r as (select query, "key", row_number() over (partition by query order by distance, "key") rank from p),
l as (select q.vec_id query, d.vec_id "key" from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 20 = 0)
select query, round(count(rank) / count(*), 6) recall, round(avg(rank), 6) mean_rank from l left join (select * from r where rank <= 20) r using (query, "key") group by query""")
def eval_recall_mqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the same label are relevant; the first 20 answers count."""
    e = vectors(spark, sf_dir)
    q = e.where("vec_id % 20 = 0")
    ranked = search.radius_search(e, q, float("inf"), 20, "vec_id", "v")
    return search.recall_by_label(ranked, q, e, "vec_id", "label", 20)


@query(f"""with {E_SQL}, q as (select i, v from e where vec_id = 0), s as (select e.vec_id, round(corr(e.v, q.v), 6) score from e join q using (i) group by e.vec_id),
r as (select *, row_number() over (order by score desc, vec_id desc) - 1 rank from s order by rank limit 50)
select vec_id, score, rank, floor((50 - rank) * 63 / 50::double)::bigint colour from r""")
def rank_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour index of a map of 64 colours by rank among 50."""
    e = vectors(spark, sf_dir)
    top = search.correlate(e, vector_of(e, 0), "vec_id", "v", 50)  # 50 rows: one task ranks them
    ranked = top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), F.desc("vec_id"))) - 1).cast("long"))
    return search.colours(ranked, 64, n=F.lit(50.0))


@query(f"""with {U_SQL}, q as (select coords from u where dimension = 24 order by id limit 1),
b as (select u.id, unnest(u.coords) x, unnest(q.coords) y, generate_subscripts(u.coords, 1) i from u, q where u.dimension = 24),
s as (select id, (i - 1) // 3 bone, sqrt(sum((x - y) * (x - y))) d from b group by 1, 2)
select id, round(sum(d), 6) distance from s group by id order by distance, id limit 50""")
def pose_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of 8 bones with 3 angles: sum over bones of the norm of the difference, to the first pose."""
    from motionq.operators import motion

    u = usable_points(spark, sf_dir).where("dimension = 24")
    q = u.orderBy("id").first()["coords"]
    return search.best(u.select("id", F.round(motion.pose_distance("coords", q), 6).alias("distance")), "distance", "id", 50, largest=False)


@query(f"""with {E_SQL}, l as (select label, i, v from e join (select label, min(vec_id) vec_id from embeddings where vec_id % 20 = 0 group by 1) using (label, vec_id))
select e.vec_id, round(corr(e.v, l.v), 6) score from e join l using (label, i) group by 1 order by score desc, vec_id desc limit 50""")
def candidates_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate update: every record is scored against the query record of its own label."""
    e = vectors(spark, sf_dir)
    heads = e.where("vec_id % 20 = 0").groupBy("label").agg(F.min_by("v", "vec_id").alias("q"))
    scored = e.join(heads, "label").select("vec_id", F.round(vec.pearson("v", "q"), 6).alias("score"))
    return search.best(scored.where("score is not null"), "score", "vec_id", 50)


@query(f"""with {E_SQL}, g as (select vec_id, (i - 1) // 8 x, (i - 1) % 8 y, v from e), q as (select x, y, v from g where vec_id = 0),
o as (select * from range(-2, 3) a(dx), range(-2, 3) b(dy)), m as (select x + dx x, y + dy y, dx, dy, v q from q, o),
s as (select vec_id, dx, dy, round(sum((g.v - m.q) * (g.v - m.q) - m.q * m.q) + (select sum(v * v) from q), 6) score from g join m using (x, y) group by 1, 2, 3)
select vec_id, dx, dy, score from s qualify row_number() over (partition by vec_id order by score, dx, dy) = 1""")
def align_ssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset within two cells that aligns record 0, as an 8 x 8 grid, best with every record."""
    g = vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "v")).select("vec_id", F.expr("i div 8").alias("x"), F.expr("cast(i % 8 as bigint)").alias("y"), "v")
    return search.align(g.where("vec_id = 0").drop("vec_id"), g, "vec_id", 2)


@query("""with s as (select vec_id, label from embeddings) select label, count(*) n, min(vec_id) first_id, max(vec_id) last_id from s where label = 3 group by label""")
def view_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of the database; a view that is not loaded gives no rows."""
    return read(spark, sf_dir, "embeddings").where("label = 3").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))
