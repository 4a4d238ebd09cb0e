"""Queries on stores, configs and plain set and scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.operators import reduce, series
from motionq.plans.common import E_SQL, Catalogue, read, vectors
from motionq.sources import stores, text

query = Catalogue()


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) k, coalesce(cast(json_extract_string(props, '$.missing') as bigint), -1) missing,
upper(trim(event_type)) not in ('FALSE', 'F', 'NO', 'N', '0', 'NONE') flag from events""")
def config_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reads, with default, of key-value maps."""
    e = read(spark, sf_dir, "events").withColumn("kv", F.from_json("props", "map<string,string>"))
    flag = ~F.upper(F.trim("event_type")).isin("FALSE", "F", "NO", "N", "0", "NONE")
    return e.select("event_id", F.try_element_at("kv", F.lit("k")).cast("long").alias("k"), F.coalesce(F.try_element_at("kv", F.lit("missing")).cast("long"), F.lit(-1)).alias("missing"), flag.alias("flag"))


@query("""select cam_name "name", round(list_sum(rotations), 4) rotations, cam_distance distance, round(list_sum(cam_target), 4) target, round(list_sum(pan), 4) pan,
round(list_sum(center), 4) center, round(list_sum(up_dir), 4) up_dir, round(list_sum(cam_position), 4) "position", fov from camera""")
def camera_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras written as config text, and read again."""
    c = text.camera(text.config(stores.camera_text(read(spark, sf_dir, "camera"))))
    total = lambda n: F.round(vec.total(n), 4).alias(n)
    return c.select("name", total("rotations"), "distance", total("target"), total("pan"), total("center"), total("up_dir"), total("position"), "fov")


@query("select h.source, sketch_id, patch from (select 'db' source, sketch_id, patch from sketches union all select 'user', sketch_id, patch from usr_sketches) h")
def store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores appended to each other."""
    parts = [read(spark, sf_dir, t).select(F.lit(s).alias("source"), "sketch_id", "patch") for s, t in (("db", "sketches"), ("user", "usr_sketches"))]
    return parts[0].unionByName(parts[1])


@query("select patch from sketches union select patch from usr_sketches")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "sketches").select("patch").union(read(spark, sf_dir, "usr_sketches").select("patch")).distinct()


@query(f"""with {E_SQL} select i::int pos, greatest(least(floor((v + 0.5::double) / 0.1::double), 9), 0)::int bin, round(-0.5::double + (greatest(least(floor((v + 0.5::double) / 0.1::double), 9), 0) + 0.5::double) * 0.1::double, 6) middle, count(*) n from e group by all""")
def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-width bins per position with their middles."""
    e = vectors(spark, sf_dir).select(F.posexplode("v").alias("p", "x")).select((F.col("p") + 1).alias("pos"), vec.bin_index(F.col("x"), -0.5, 0.5, 10).alias("bin"))
    return e.groupBy("pos", "bin").agg(F.count("*").alias("n")).select("pos", "bin", F.round(vec.bin_middle(F.col("bin"), -0.5, 0.5, 10), 6).alias("middle"), "n")


@query(f"""with {E_SQL}, m as (select vec_id, min(v) lo, max(v) hi, avg(v) mean, sqrt(sum(v * v)) norm, arg_max(i, v) - 1 a from e group by 1)
select vec_id, round(lo, 6) lo, round(hi, 6) hi, round(mean, 6) mean, round(norm, 6) norm, a::int argmax from m""")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum, maximum and its place, mean and norm of each vector."""
    e = vectors(spark, sf_dir)
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.select("vec_id", r(F.array_min("v"), "lo"), r(F.array_max("v"), "hi"), r(vec.mean("v"), "mean"), r(vec.norm("v"), "norm"), vec.argmax("v").alias("argmax"))


@query("select id, clip, split_part(clip, '/', -1) \"name\", left(clip, 3) head, regexp_replace(clip, '/[^/]*$', '') folder, try_cast(regexp_extract(clip, '_([0-9]+)$', 1) as int) number from (select distinct id, clip from points where clip is not null)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, folders and numbers out of clip paths."""
    p = read(spark, sf_dir, "points").where("clip is not null").select("id", "clip").distinct()
    number = F.expr("try_cast(regexp_extract(clip, '_([0-9]+)$', 1) as int)")
    return p.select("id", "clip", F.element_at(F.split("clip", "/"), -1).alias("name"), F.left("clip", F.lit(3)).alias("head"), F.regexp_replace("clip", "/[^/]*$", "").alias("folder"), number.alias("number"))


@query("select sketch_id, h is null or len(h) = 0 or list_max(list_transform(h, lambda x: coalesce(x, -1))) = -1 as \"empty\" from (select distinct sketch_id, h from sketches)")
def empty_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinel patches: no value anywhere."""
    s = read(spark, sf_dir, "sketches").select("sketch_id", "h").distinct()
    return s.select("sketch_id", (F.coalesce(F.array_max(F.transform("h", lambda x: F.coalesce(x, F.lit(-1)))), F.lit(-1)) == -1).alias("empty"))


@query("""with n as (select count(*) n from embeddings), o as (select vec_id, label, row_number() over (order by vec_id) - 1 seat from embeddings),
d as (select r.range draw, ((((r.range + 1) * 7919 + 7 * 104729) % 2147483647 * 48271 % 2147483647) * 16807 % 2147483647) % n.n place from range(0, (select n // 10 from n)) r, n)
select draw, vec_id, label from d join o on d.place = o.seat""")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the vectors, drawn with replacement by their places in order."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return series.draw(e, "vec_id", e.count() // 10, 7).select("draw", "vec_id", "label")


@query(f"with {E_SQL} select vec_id, 64 n, round(sum(v * v), 5) norm from e group by vec_id")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on all principal components, which keep their lengths."""
    p = reduce.project(vectors(spark, sf_dir), "vec_id", "v", 64)
    return p.select("vec_id", F.size("pc").alias("n"), F.round(vec.dot("pc", "pc"), 5).alias("norm"))


@query("select i.range::int i, j.range::int j, 0.0::double covariance, true falling from range(6) i, range(6) j where i.range < j.range")
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components that keep 95 % of the variance are uncorrelated and ever less varied."""
    p = reduce.project(vectors(spark, sf_dir), "vec_id", "v", 0.95)
    x = p.select("vec_id", F.posexplode(F.slice("pc", 1, 6)).alias("i", "x"))
    both = x.join(x.select("vec_id", F.col("i").alias("j"), F.col("x").alias("y")), "vec_id").where("i < j").groupBy("i", "j")
    return both.agg((F.round(F.covar_samp("x", "y"), 6) + 0.0).alias("covariance"), (F.var_samp("x") >= F.var_samp("y") - 1e-9).alias("falling"))
