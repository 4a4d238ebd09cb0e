"""The pN_ queries. Each reads whole tables of ``sf_dir`` with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.llm import bbit, bpe, clusters, knn, prefixjoin, quota, splitter, wumanber


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(_read(spark, sf_dir, "points"))


def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the records, varied."""
    points = _read(spark, sf_dir, "points")
    return quota.varied(points, max(1, points.count() // 20))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [prefixjoin.as_sets(_read(spark, sf_dir, t), "sketch_id") for t in ("sketches", "usr_sketches")]
    return prefixjoin.similar_pairs(sets[0].unionByName(sets[1]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(_read(spark, sf_dir, "points")).select("id", "cluster_id")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with size, number of links and its most typical members."""
    return clusters.described(clusters.clusters(_read(spark, sf_dir, "points"), with_degree=True))


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters split so that no member is farther than 12.0 from the medoid of its group: each group with its size."""
    points = _read(spark, sf_dir, "points")
    groups = clusters.split_loose(points, clusters.clusters(points, with_degree=True))
    return groups.groupBy("cluster_id", "medoid").agg(F.count("*").alias("size"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.pairs(knn.nearest(_read(spark, sf_dir, "points")))


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every usable record, however far, with distance."""
    return knn.nearest_all(_read(spark, sf_dir, "points"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(_read(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of each document with the number of matching word runs."""
    return wumanber.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all texts."""
    return splitter.split(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut: those with a second piece."""
    return splitter.split(_read(spark, sf_dir, "documents"), with_text=False).where("piece = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_subset, p3_found, p4_found, p4_clusters, p4_split, p5_found, p5_nearest, p6_ids, p7_found, p7_leaks, p8_found, p8_pieces)}
_USABLE = """u as (select id, any_value(coords) coords from points where coords is not null and len(coords) = dimension and dimension > 0
  and not list_contains(list_transform(coords, lambda x: x is null), true) and list_min(coords) < list_max(coords) group by id),
d as (select a.id a, b.id b, round(list_distance(a.coords, b.coords), 6) d from u a join u b on len(a.coords) = len(b.coords) and a.id < b.id),
n as (select a, b, d from d where d <= 6.0 union all select b, a, d from d where d <= 6.0)"""
#: Everything reached over the links n(a, b) from every id; its least root names the component.
_REACHED = "r(id, root) as (select distinct a, a from n union select n.b, r.root from r join n on n.a = r.id)"

#: Plain all-pairs SQL for what SQL can say; it is for small tables.
SQL: dict[str, str] = {
    "p1_found": f"""with recursive v as (select distinct id, coords from points where coords is not null),
e as (select id, coords, unnest(coords) + 0.0::double x from v), o as (select id, x, row_number() over (partition by id, coords, x) k from e where x is not null),
s as (select id, count(*) n from o group by id having min(x) < max(x)), t as (select o.* from o join s using (id)),
j as (select p.id a, q.id b, count(*) c from t p join t q on p.x = q.x and p.k = q.k and p.id < q.id group by 1, 2),
l as (select a, b from j join s x on x.id = a join s y on y.id = b where c >= 0.8::double * (x.n + y.n - c) - 1e-9::double),
n as (select a, b from l union all select b, a from l), {_REACHED}
select id, min(root) group_id from r group by id""",
    "p3_found": """with h as (select sketch_id id, unnest(h) v from sketches union all select sketch_id, unnest(h) from usr_sketches),
s as (select distinct id, v from h where v is not null and v <> -1 and id is not null), n as (select id, count(*) n from s group by id),
j as (select p.id a, q.id b, count(*) c from s p join s q on p.v = q.v and p.id < q.id group by 1, 2)
select a id_a, b id_b from j join n x on x.id = a join n y on y.id = b where c >= 0.7::double * (x.n + y.n - c) - 1e-9::double""",
    "p4_found": f"""with recursive {_USABLE}, {_REACHED}, c as (select id, min(root) cluster_id from r group by id)
select id, cluster_id from c qualify count(*) over (partition by cluster_id) >= 5""",
    "p4_clusters": f"""with recursive {_USABLE}, {_REACHED}, c as (select id, min(root) cluster_id from r group by id), g as (select a id, count(*) degree from n group by 1),
m as (select cluster_id, c.id, degree from c join g on c.id = g.id qualify count(*) over (partition by cluster_id) >= 5)
select cluster_id, count(*) size, (sum(degree) / 2)::bigint links, list(id order by degree desc, id)[1:3] medoids from m group by cluster_id""",
    "p5_found": f"""with {_USABLE}, r as (select a, b, rank() over (partition by a order by d) k from n)
select distinct least(a, b) id_a, greatest(a, b) id_b from r where k <= 5""",
    "p5_nearest": f"""with {_USABLE}, m as (select a, b, d from d union all select b, a, d from d), r as (select a id, b other, d distance, rank() over (partition by a order by d) k from m)
select id, other, distance from r where k <= 5""",
}
