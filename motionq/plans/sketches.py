"""Hashing queries: min-hash, inverted file and votes over ``sketches``; LSH over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.operators import lsh, minhash
from motionq.plans.common import E_SQL, U_SQL, Catalogue, read, usable_points, vectors

query = Catalogue()
_FS = minhash.hash_functions()
_F_SQL = "f as (select * from (values " + ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(_FS)) + ") t(n, a, b))"
_PATCH_SQL = f"""{E_SQL}, p as (select vec_id img, ((i - 1) // 16)::int patch, (i - 1) % 16 bin, v from e), r as (select *, row_number() over (partition by img, patch order by v desc) k from p),
l as (select img, patch, v lim from r where k = 4), o as (select img, patch, bin from p join l using (img, patch) where v >= lim), {_F_SQL},
m as (select img, patch, n, min((a::bigint * bin::bigint + b) % {minhash.PRIME})::int h from o, f group by 1, 2, 3)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of four patches with 16 bins and their sketches: ``img, patch, hist, h``."""
    parts = F.array(*[F.struct(F.lit(p).alias("patch"), vec.piece("v", 16 * p, 16).alias("hist")) for p in range(4)])
    p = vectors(spark, sf_dir).select(F.col("vec_id").alias("img"), F.explode(parts).alias("x")).select("img", "x.patch", "x.hist")
    return p.withColumn("h", minhash.sketch(F.col("hist"), _FS))


@query(f"with {_PATCH_SQL} select img, patch, n, h from m")
def minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches(spark, sf_dir).select("img", "patch", F.posexplode("h").alias("n", "h"))


_POSTINGS = """s as (select sketch_id, any_value(img_id) img_id, any_value(patch) patch, any_value(h) h from sketches where h is not null group by 1),
t as (select img_id, patch, h[t + 1] h1, h[t + 11] h2, h[t + 21] h3 from s, range(10) r(t)), i as (select distinct h1, h2, h3, img_id, patch from t where h1 <> -1 and h2 <> -1 and h3 <> -1)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "sketches").select("sketch_id", "img_id", "patch", "h").where("h is not null").dropDuplicates(["sketch_id"])
    return minhash.inverted_file(s, ["img_id", "patch"])


@query(f"with {_POSTINGS} select h1, h2, h3, count(*) postings, count(distinct img_id) images from i group by 1, 2, 3")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy("h1", "h2", "h3").agg(F.count("*").alias("postings"), F.countDistinct("img_id").alias("images"))


@query(f"""with {_POSTINGS}, d as (select sketch_id, patch, h from s where sketch_id % 20 = 0 union all select sketch_id, patch, h from usr_sketches where h is not null),
q as (select sketch_id, patch, h[t + 1] h1, h[t + 11] h2, h[t + 21] h3 from d, range(10) r(t))
select q.sketch_id, i.img_id, count(*) votes from q join i using (h1, h2, h3) where abs(q.patch // 8 - i.patch // 8) <= 1 and abs(q.patch % 8 - i.patch % 8) <= 1 and h1 <> -1 and h2 <> -1 and h3 <> -1 group by 1, 2""")
def vote_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the drawn patches, and every sketch whose id is divisible by 20."""
    s = read(spark, sf_dir, "sketches").where("sketch_id % 20 = 0 and h is not null").select("sketch_id", "patch", "h").dropDuplicates(["sketch_id"])
    q = s.unionByName(read(spark, sf_dir, "usr_sketches").select("sketch_id", "patch", "h"))
    return minhash.votes(postings(spark, sf_dir), q, ["sketch_id"])


@query(f"""with {_PATCH_SQL}, w as (select img, patch, n % 10 t, max(case when n // 10 = 0 then h end) h1, max(case when n // 10 = 1 then h end) h2, max(case when n // 10 = 2 then h end) h3 from m group by 1, 2, 3),
i as (select distinct img, patch, h1, h2, h3 from w), v as (select w.img query, i.img, patch, count(*) n from w join i using (patch, h1, h2, h3) where w.img % 20 = 0 group by 1, 2, 3),
b as (select * from v qualify row_number() over (partition by query, img order by n desc, patch) = 1)
select query, img, score from (select query, b.img, round(corr(x.v, y.v), 6) score from b join p x on x.img = b.query and x.patch = b.patch join p y on y.img = b.img and y.patch = b.patch and x.bin = y.bin group by 1, 2) where score >= 1e-5""")
def vote_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(spark, sf_dir)
    q = p.where("img % 20 = 0").withColumnRenamed("img", "query")
    return minhash.vote_then_correlate(minhash.inverted_file(p, ["img", "patch"]), p, q, ["query"], "img")


@query("select p.range::int patch, n.range::int near from range(64) p, range(64) n where abs(p.range // 8 - n.range // 8) <= 1 and abs(p.range % 8 - n.range % 8) <= 1")
def patch_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("patch")).select("patch", F.explode(minhash.around()).alias("near"))


#: Records of 32 coordinates; k is what ``lsh_plan`` finds for them.
LSH = lsh.Plan(dim=32, radius=6.0, success=0.9, k=4, m=lsh.halves(4, 0.9))
_A, _B = lsh.functions(LSH)
_L_SQL = f"{U_SQL}, l as (select id, unnest(coords) v, generate_subscripts(coords, 1) i from u where dimension = 32)"
_U_SQL = f"""{_L_SQL}, a as (select * from (values {", ".join(f"({u}, {j}, {i + 1}, {float(_A[u, j, i])!r}::double)" for u in range(LSH.m) for j in range(LSH.k // 2) for i in range(LSH.dim))}) t(u, j, i, a)),
b as (select * from (values {", ".join(f"({u}, {j}, {float(_B[u, j])!r}::double)" for u in range(LSH.m) for j in range(LSH.k // 2))}) t(u, j, b)),
g as (select id, u, j, floor((sum(v * a) / {LSH.radius}::double + any_value(b.b)) / 4.0::double)::bigint h from l join a using (i) join b using (u, j) group by 1, 2, 3),
k as (select id, u, list(h order by j) h from g group by 1, 2), t as (select x.id, x.u * 10 + y.u table_id, list_concat(x.h, y.h) bucket from k x join k y on x.id = y.id and x.u < y.u)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_points(spark, sf_dir).where(F.col("dimension") == LSH.dim).select("id", F.col("coords").alias("v"))


@query(f"with {_U_SQL}, c as (select table_id, bucket, count(*) n from t group by 1, 2) select n size, count(*) buckets from c group by n")
def lsh_bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lsh.bucket_table(records(spark, sf_dir), LSH, "id", "v")
    return t.groupBy("table_id", "bucket").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("buckets"))


@query(f"""with {_U_SQL}, c as (select distinct q.id query, d.id "key" from t q join t d using (table_id, bucket) where q.id % 20 = 0 and q.id <> d.id),
d as (select query, "key", round(list_distance(x.coords, y.coords), 6) distance from c join u x on x.id = query join u y on y.id = "key")
select query, "key", distance from d where distance <= {LSH.radius}""")
def lsh_rnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every record whose id is divisible by 20, against all of 32 coordinates."""
    r = records(spark, sf_dir)
    return lsh.near(r, r.where("id % 20 = 0"), LSH, "id", "v")


#: The error function by a published polynomial (fixed values), good to 2e-7.
_P_SQL = """(1 - (((((1.061405429::double * t - 1.453152027::double) * t) + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-x * x / 2)
  - sqrt(2 / pi()) / x * (1 - exp(-x * x / 2)))"""


def _collision_sql(name: str, source: str, x: str) -> str:
    """Table ``name``: ``source`` with ``p``, the chance that one hash agrees, ``x`` being width over distance."""
    return f"{name} as (select *, {_P_SQL} p from (select *, 1 / (1 + 0.3275911::double * x / sqrt(2::double)) t from (select *, {x} x from {source})))"


@query(f"""with k as (select * from (values (2), (4), (8), (10), (16), (20)) k(k)), {_collision_sql("o", "(select 1)", "4.0::double")}, n as (select k, p, 1 - pow(p, k / 2.0) miss from k, o),
m as (select k, min(m.range) m from n, range(2, 500) m where pow(miss, m.range - 1) * (1 + m.range * (1 - miss)) <= 0.1::double + 1e-12::double group by k)
select k, round(p, 5) collision, ceil(ln(0.1::double) / ln(1 - pow(p, k)))::int tables, m::int halves from n join m using (k)""")
def lsh_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and half-keys needed for a success of 0.9, by number of hashes."""
    rows = [(k, round(lsh.collision(lsh.WIDTH, 1), 5), lsh.tables(k, 0.9), lsh.halves(k, 0.9)) for k in (2, 4, 8, 10, 16, 20)]
    return spark.createDataFrame(rows, "k int, collision double, tables int, halves int")


_D_SQL = f"""{U_SQL}, l as (select id, coords from u where dimension = 32), q as (select coords from l order by (id * 7919 + 7) % 104729, id limit 100), w as (select coords from l order by (id * 7919 + 8) % 104729, id limit 1000),
d as (select round(list_distance(q.coords, w.coords), 6) d from q, w), f as (select d from d where d > 0), {_collision_sql("c", "f", "24.0::double / d")}"""


@query(f"""with {_D_SQL}, k as (select 2 * r.range k from range(1, 6) r), {_collision_sql("o", "(select 1)", "4.0::double")}, n as (select k, 1 - pow(p, k / 2.0) miss from k, o),
m as (select k, min(m.range) m from n, range(2, 500) m where pow(miss, m.range - 1) * (1 + m.range * (1 - miss)) <= 0.1::double + 1e-12::double group by k)
select k::int k, m::int m, round(sum(m * (m - 1) / 2 * pow(p, k)) / count(*), 3) hits, round(sum(1 - pow(1 - pow(p, k / 2.0), m - 1) * (1 - pow(p, k / 2.0) + m * pow(p, k / 2.0))) / count(*), 3) reached from c, m group by k, m""")
def lsh_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket hits, and distinct points reached, that are expected of a pair of the sample, by number of hashes."""
    d = lsh.sample_distances(records(spark, sf_dir), "id", "v")
    n = max(len(d), 1)
    rows = []
    for k in range(2, 11, 2) if d else ():
        m = lsh.halves(k, 0.9)
        hits, reached = lsh.expected_collisions(d, k, m, True, LSH.radius)
        rows.append((k, m, round(hits / n, 3), round(reached / n, 3)))
    return spark.createDataFrame(rows, "k int, m int, hits double, reached double")


@query(f"""with {_D_SQL}, n as (select count(*) points from l), s as (select count(*) n from c), k as (select 2 * r.range k from range(1, 21) r), {_collision_sql("o", "(select 1)", "4.0::double")}, h as (select k, 1 - pow(p, k / 2.0) miss from k, o),
m as (select k, min(m.range) m from h, range(2, 500) m where pow(miss, m.range - 1) * (1 + m.range * (1 - miss)) <= 0.1::double + 1e-12::double group by k),
e as (select k, m, sum(m * (m - 1) / 2 * pow(p, k)) hits, sum(1 - pow(1 - pow(p, k / 2.0), m - 1) * (1 - pow(p, k / 2.0) + m * pow(p, k / 2.0))) reached from c, m group by k, m),
t as (select k, m, m * k / 2 * 32 + (hits + reached * 32) * points / s.n cost from e, n, s where k = 2 or m * (m - 1) / 2 * points <= 1e9 / 12)
select k::int k, m::int m, (m * (m - 1) / 2)::int tables, 6.0::double radius, 0.9::double success from t order by cost, k limit 1""")
def lsh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters the planner chooses for records of 32 coordinates, at equal relative costs."""
    r = records(spark, sf_dir)
    p = lsh.plan(LSH.dim, r.count(), lsh.sample_distances(r, "id", "v"), LSH.radius)
    return spark.createDataFrame([(p.k, p.m, p.count, p.radius, p.success)], "k int, m int, tables int, radius double, success double")


@query(f"""with {E_SQL}, d as (select q.vec_id, min(d) d from (select q.vec_id, d.vec_id o, round(sqrt(sum((q.v - d.v) * (q.v - d.v))), 6) d from e q join e d on q.i = d.i and q.vec_id <> d.vec_id where q.vec_id % 20 = 0 group by 1, 2) q group by 1)
select (case when d <= 1.0 then 0 when d <= 1.1 then 1 when d <= 1.2 then 2 else 3 end)::int "class", count(*) n, min(d) least, max(d) greatest from d group by 1""")
def radius_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motionq.operators import search

    e = vectors(spark, sf_dir)
    first = search.radius_search(e, e.where("vec_id % 20 = 0"), float("inf"), 1, "vec_id", "v")
    return lsh.radius_classes(first, [1.0, 1.1, 1.2])
