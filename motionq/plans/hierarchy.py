"""Queries over the hierarchy ``units`` and the frames of ``points``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import batch
from motionq.operators import hierarchy as H
from motionq.operators import search
from motionq.plans.common import U_SQL, Catalogue, read, usable_points

query = Catalogue()
CHOSEN = ("lib/walk", "lib/walk/walk_01", "lib/run/run_12", "lib/sway/sway_02")
_UP = """with recursive up(ancestor, node, depth) as (select unit_path, unit_path, 0 from units
  union all select r.parent_path, u.node, u.depth + 1 from up u join units r on r.unit_path = u.ancestor where r.parent_path is not null)"""
_TOP = f"""c as (select unnest({list(CHOSEN)}) node),
  t as (select unit_path node from units where unit_path in (select node from c) and unit_path not in (select node from up where depth > 0 and ancestor in (select node from c)))"""


@query(f"{_UP} select ancestor, node, depth::int depth from up")
def hier_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.closure(read(spark, sf_dir, "units"), "unit_path", "parent_path")


@query("select unit_path from units where unit_path not in (select parent_path from units where parent_path is not null)")
def hier_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.leaves(read(spark, sf_dir, "units"), "unit_path", "parent_path")


@query(f"{_UP}, {_TOP} select node from t")
def hier_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.selected(read(spark, sf_dir, "units"), CHOSEN, "unit_path", "parent_path")


@query(f"""{_UP}, l as (select * from units where unit_path not in (select parent_path from units where parent_path is not null))
select ancestor node, min(first_frame) first_frame, max(last_frame) last_frame, count(*) leaves from up join l on l.unit_path = up.node group by 1""")
def hier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.roll_up(read(spark, sf_dir, "units"), "unit_path", "parent_path", "first_frame", "last_frame")


@query(f"""{_UP}, {_TOP}, {U_SQL}, s as (select * from units where unit_path in (select node from t)),
q as (select coords from u where dimension = 32 order by id limit 1),
f as (select * from u where dimension = 32 and exists (select 1 from s where u.frame between s.first_frame and s.last_frame)),
b as (select f.id, f.frame, unnest(f.coords) x, unnest(q.coords) y from f, q)
select id, frame, round(corr(x, y), 6) score from b group by id, frame order by score desc, id desc limit 50""")
def hier_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation search within the selected subtrees: filter first, then score, then cut."""
    units, u = read(spark, sf_dir, "units"), usable_points(spark, sf_dir).where("dimension = 32")
    q = u.orderBy("id").first()["coords"]
    top = H.selected(units, CHOSEN, "unit_path", "parent_path", sep="/")
    some = units.join(top, units["unit_path"] == top["node"], "left_semi")
    rows = H.within(u, some, "frame", "first_frame", "last_frame")
    scored = rows.select("id", "frame", F.round(batch.against("coords", q), 6).alias("score"))
    return search.best(scored.where("score is not null"), "score", "id", 50)


@query("""select unit_path path, parent_path parent, split_part(unit_path, '/', -1) "name", (len(string_split(unit_path, '/')) - 1)::int "level" from units""")
def hier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents taken from the paths themselves."""
    return H.parents_of_paths(read(spark, sf_dir, "units").select(F.col("unit_path").alias("path")))


@query("""select unit_path, (row_number() over (order by unit_path) - 1)::int n, split_part(unit_path, '/', -1) "name", (len(string_split(unit_path, '/')) - 1)::int indent,
case when parent_path is not null then split_part(parent_path, '/', -1) end parent from units""")
def hier_indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as indented text, depth first by name, and parsed again. One file: the tree of one database."""
    paths = read(spark, sf_dir, "units").select("unit_path").coalesce(1).sortWithinPartitions("unit_path")
    lines = paths.select(
        "unit_path", F.monotonically_increasing_id().cast("int").alias("n"), F.lit("tree").alias("file"),
        F.concat(F.expr("repeat(' ', size(split(unit_path, '/')) - 1)"), F.substring_index("unit_path", "/", -1)).alias("line"),
    )
    return H.indented(lines).join(lines.select("n", "unit_path"), "n").select("unit_path", "n", "name", F.col("indent").cast("int"), "parent")


@query("""select c.unit_path, c.first_frame - p.first_frame "offset", c.last_frame - c.first_frame + 1 frames from units c join units p on c.parent_path = p.unit_path""")
def parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit looked up against its parent."""
    u = read(spark, sf_dir, "units")
    p = u.select(F.col("unit_path").alias("parent_path"), F.col("first_frame").alias("p"))
    return u.join(p, "parent_path").select("unit_path", (F.col("first_frame") - F.col("p")).alias("offset"), (F.col("last_frame") - F.col("first_frame") + 1).alias("frames"))


@query("""with l as (select * from units where unit_path not in (select parent_path from units where parent_path is not null)), p as (select distinct id, frame from points where frame is not null)
select l.unit_path, count(*) points, min(p.frame) first_frame, max(p.frame) last_frame from p join l on p.frame between l.first_frame and l.last_frame group by 1""")
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of ``points`` by leaf unit, counted by frame first."""
    units = read(spark, sf_dir, "units")
    low = units.join(H.leaves(units, "unit_path", "parent_path"), "unit_path", "left_semi").select("unit_path", "first_frame", "last_frame")
    p = read(spark, sf_dir, "points").where("frame is not null").select("id", "frame").distinct()
    hit = H.containing(p.groupBy("frame").agg(F.count("*").alias("n")), low, "frame", "first_frame", "last_frame")
    return hit.groupBy("unit_path").agg(F.sum("n").alias("points"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("""select unit_path path, parent_path parent, (len(string_split(unit_path, '/')) - 1)::int "level", unit_path not in (select parent_path from units where parent_path is not null) leaf from units""")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree out of the paths of its leaves."""
    units = read(spark, sf_dir, "units")
    return H.folders(H.leaves(units, "unit_path", "parent_path"), "unit_path")
