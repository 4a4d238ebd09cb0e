"""Round trips: tables written in every format that is read, and read back. Files lie in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.operators import grids, lsh, minhash
from motionq.operators import histograms as H
from motionq.plans import histograms
from motionq.plans.common import E_SQL, Catalogue, read, vectors
from motionq.sources import images, stores, text
from motionq.tables import fresh

query = Catalogue()
#: Rows of a table that go into one file here.
ROWS = 500


def _text_files(df: DataFrame, name: F.Column, line: F.Column, order: str, head: str = "", tail: str = "") -> DataFrame:
    """``(name, content)``: the lines of at most ROWS rows each in order, between head and tail."""
    l = df.groupBy(name.alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("l"))
    n = F.size("l").cast("string")
    return l.select("name", F.concat(F.replace(F.lit(head), F.lit("{n}"), n), F.array_join(F.transform("l", lambda s: s["t"]), "\n"), F.lit(tail)).alias("content"))


def _block(column: str = "vec_id") -> F.Column:
    return F.lpad(F.expr(f"{column} div {ROWS}").cast("string"), 8, "0")


# ---------------------------------------------------------------- images


def _bar(view: int, marks: bool) -> np.ndarray:
    """White canvas with a black bar 20 wide over all rows; with ``marks`` ten pixels of pure red beside it."""
    g = np.full((480, 480, 3), 255, np.uint8)
    left = 60 * (view % 7) + 10
    g[:, left : left + 20] = 0
    if marks:
        g[5, left + 20 : left + 30] = (0, 0, 255)
    return g


def _drawn(spark: SparkSession, sf_dir: str, draw, kind: str, encode) -> str:
    """Folder of an image for each view of ``camera``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": [f"v{v:06d}.{kind}" for v in pdf["view_id"]], "content": [encode(draw(int(v))) for v in pdf["view_id"]]})

    folder = fresh(spark)
    stores.write_files(read(spark, sf_dir, "camera").select("view_id").mapInPandas(work, "name string, content binary"), folder)
    return folder


_IMG = "c as (select (row_number() over (order by view_id) - 1)::bigint img_id, view_id, 60 * (view_id % 7) + 10 l from camera)"


@query(f"""with {_IMG} select img_id, 'black' kind, 9600::bigint n, 0::bigint r0, 479::bigint r1, l::bigint c0, (l + 19)::bigint c1 from c
union all select img_id, 'red', 10, 5, 5, l + 20, l + 29 from c""")
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files, numbered in path order, and their black and their red pixels."""
    found = images.scan(spark, _drawn(spark, sf_dir, lambda v: _bar(v, True), "png", images.write_png))
    out = images.black_pixels(found).withColumn("kind", F.lit("black")).unionByName(images.coloured_pixels(found).withColumn("kind", F.lit("red")))
    return out.groupBy("img_id", "kind").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


@query(f"""with {_IMG}, f as (select * from (values ('ARP', 1, 960), ('HOUGH', 1, 958), ('BICE', 8, 960)) t(feature, pieces, total))
select img_id, 3 view_id, feature, pieces::bigint pieces, total::double total from c, f""")
def image_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder encoded into a store for each kind: the bar has two edges of 480 pixels, in 8 patches."""
    folder, path = _drawn(spark, sf_dir, lambda v: _bar(v, False), "png", images.write_png), fresh(spark)
    images.batch(spark, folder, list(H.KINDS), path, 3)
    return stores.read_features(spark, path).groupBy("img_id", "view_id", "feature").agg(F.count("*").alias("pieces"), F.sum(vec.total("hist")).alias("total"))


_G5 = [math.exp(-(i * i) / 18) for i in range(-2, 3)]
_G5 = [w / sum(_G5) for w in _G5]


@query(f"""with {_IMG}, w as (select * from (values {", ".join(f"({i - 2}, {w!r}::double)" for i, w in enumerate(_G5))}) t(k, w)), r as (select r.range r from range(480) r),
f as (select r, sum(w) f from r, w where r + k between 0 and 479 group by 1), m as (select sum(4 / (({_G5[2]!r}::double + {_G5[1]!r}::double) * f)) total from f)
select img_id, round(total, 4) magnitude, 960::bigint turned from c, m""")
def image_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised magnitudes and orientations of images through their store."""
    path = fresh(spark)
    stores.write_matrices(images.matrices(images.scan(spark, _drawn(spark, sf_dir, lambda v: _bar(v, False), "png", images.write_png))), path)
    m = stores.read_matrices(spark, path, "magnitude").select("img_id", F.round(vec.total("data"), 4).alias("magnitude"))
    turned = F.size(F.filter("data", lambda v: v > 3)).cast("long")
    return m.join(stores.read_matrices(spark, path, "orientation").select("img_id", turned.alias("turned")), "img_id")


_SMALL = "(r * 7 + c * 3 + view_id) % 256 b, (r * 5 + c * 11) % 256 g, (r * c + 9 * view_id) % 256 d"


@query(f"""with p as (select view_id, r, c, {_SMALL} from camera, range(9) a(r), range(9) b(c) where r < view_id % 5 + 3 and c < view_id % 7 + 2)
select view_id::bigint img_id, (view_id % 5 + 3)::int height, (view_id % 7 + 2)::int width, sum(b)::bigint blue, sum(g)::bigint green, sum(d)::bigint red, sum((b + g + d) // 3)::bigint gray from p group by view_id""")
def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmap files of odd sizes and their gray means."""

    def draw(v: int) -> np.ndarray:
        r, c = np.indices((v % 5 + 3, v % 7 + 2))
        return (np.stack([r * 7 + c * 3 + v, r * 5 + c * 11, r * c + 9 * v], 2) % 256).astype(np.uint8)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, image in zip(pdf["img_id"], pdf["image"], strict=True):
                g = images.pixels_of(image)
                yield pd.DataFrame([(img, *g.shape[:2], *g.astype(int).sum((0, 1)), images.gray(g).sum())], columns=["img_id", "height", "width", "blue", "green", "red", "gray"])

    files = spark.read.format("binaryFile").load(_drawn(spark, sf_dir, draw, "bmp", images.write_bmp))
    named = files.select(F.regexp_extract("path", r"v(\d+)\.bmp", 1).cast("long").alias("img_id"), "content")
    return images.decoded(named).mapInPandas(work, "img_id long, height int, width int, blue long, green long, red long, gray long")


# ---------------------------------------------------------------- matrices and histogram stores


@query(f"with {histograms._GRID} select img img_id, x::int x, y::int y, round(v, 4) v from g where v <> 0")
def matrix_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge images as matrices in XML."""
    path = fresh(spark)
    m = stores.from_cells(histograms.grid(spark, sf_dir).withColumnRenamed("img", "img_id"), ["img_id"], 30, 30).withColumn("kind", F.lit("edges"))
    stores.write_xml_matrices(m, path, 20)
    return stores.cells_of(stores.read_xml_matrices(spark, path, "edges"), ["img_id"]).where("v <> 0").withColumn("v", F.round("v", 4))


@query(f"""with {histograms._PIXELS}, {histograms._SPLIT}, d as (select img, r // 16 x, c // 16 y, bin, sum(m) m from o where m <> 0 group by all)
select img img_id, x::int x, y::int y, round(m, 4) v from d where bin = 1 and m <> 0""")
def decomposed_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the eight planes of decomposed images, through their store."""
    path, o = fresh(spark), H.orientation_split(histograms.pixels(spark, sf_dir), ["img", "r", "c"])
    cells = o.groupBy(F.col("img").alias("img_id"), F.expr("bin * 30 + r div 16").alias("x"), F.expr("c div 16").alias("y")).agg(F.sum("m").alias("v"))
    stores.write_matrices(stores.from_cells(cells, ["img_id"], 240, 30).withColumn("kind", F.lit("decomposed")), path)
    return stores.cells_of(stores.plane(stores.read_matrices(spark, path, "decomposed"), 1, 30), ["img_id"]).where("v <> 0").withColumn("v", F.round("v", 4))


@query(f"with {E_SQL} select 2 view_id, vec_id img_id, 'BICE' feature, ((i - 1) // 8)::int patch, round(sum(v), 6) total, count(*)::int n from e group by all")
def xml_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms by patch in XML files of 300 images."""
    path = fresh(spark)
    parts = F.array(*[F.struct(F.lit(p).alias("patch"), vec.piece("v", 8 * p, 8).alias("hist")) for p in range(8)])
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("img_id"), F.explode(parts).alias("x")).select("img_id", "x.patch", "x.hist")
    stores.write_xml_features(e, path, "BICE", 300)
    return stores.read_xml_features(spark, path, 2).select("view_id", "img_id", "feature", "patch", F.round(vec.total("hist"), 6).alias("total"), F.size("hist").alias("n"))


@query(f"with {E_SQL} select vec_id img_id, least((i - 1) // 9, 6)::int limb, round(sum(v), 6) total from e where least((i - 1) // 9, 6) <> 5 group by all")
def limb_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by body part, one of which is missing."""
    paths = {limb: fresh(spark) for limb in range(7)}
    e = vectors(spark, sf_dir).withColumnRenamed("vec_id", "img_id").withColumn("patch", F.lit(None).cast("int"))
    for limb, path in paths.items():
        if limb != 5:
            stores.write_xml_features(e.select("img_id", "patch", vec.piece("v", 9 * limb, 9 if limb < 6 else 10).alias("hist")), path, "HOUGH", 1000)
    return stores.read_limbs(spark, paths, 0).select("img_id", "limb", F.round(vec.total("hist"), 6).alias("total"))


# ---------------------------------------------------------------- token text


@query(f"with {histograms._LINES}, n as (select img, x1, y1, x2, y2, count(*) n from s group by all) select img img_id, x1::int x1, y1::int y1, x2::int x2, y2::int y2, n from n")
def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, s = fresh(spark), histograms.segments(spark, sf_dir).withColumnRenamed("img", "img_id")
    stores.write_grouped_text(s.withColumn("pos", F.lit(0)), path, ["x1", "y1", "x2", "y2"], per_file=8)
    return text.line_store(spark, path).groupBy("img_id", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))


@query(f"with {histograms._PIXELS} select distinct img img_id, r::int x, c::int y from p")
def point_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = fresh(spark), histograms.pixels(spark, sf_dir).select(F.col("img").alias("img_id"), F.col("r").alias("x"), F.col("c").alias("y")).distinct()
    stores.write_grouped_text(p.withColumn("pos", F.lit(0)), path, ["x", "y"], 2, per_file=8)
    return text.reindexed(text.point_sets(text.files(spark, path))).select("img_id", "x", "y")


@query(f"""with o as (select vec_id, (row_number() over (order by label, vec_id) - 1)::bigint img_id from embeddings), {E_SQL}, j as (select vec_id, i, floor(v * 1000.0::double)::int v from e where i <= 6)
select img_id, ['root', 'head', 'tip'][(i + 1) // 2] joint, max(v) filter (where i % 2 = 1) x, max(v) filter (where i % 2 = 0) y from j join o using (vec_id) group by img_id, (i + 1) // 2""")
def joint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint images of several folders as one store."""
    path, e = fresh(spark), vectors(spark, sf_dir)
    line = F.array_join(F.transform(F.slice("v", 1, 6), lambda x: F.floor(x * F.lit(1000.0)).cast("string")), " ")
    name = F.concat(F.col("label").cast("string"), F.lit("/"), _block(), F.lit("/capture.data"))
    for label in [r.label for r in e.select("label").distinct().collect()]:  # a folder a label
        rows = _text_files(e.where(F.col("label") == label), name, line, "vec_id", "root head tip\n{n}\n", "\n")
        blocks = rows.withColumn("name", F.replace(F.substring_index("name", "/", -2), F.lit("/"), F.lit("_")))
        stores.write_files(blocks, f"{path}/{label}")
    return text.reindexed(text.joints(text.files(spark, f"{path}/*"))).select("img_id", "joint", "x", "y")


@query(f"with {E_SQL}, o as (select vec_id, (row_number() over (order by vec_id) - 1)::bigint id from embeddings) select id, round(sum(v * i), 6) total, count(*)::int n from e join o using (vec_id) group by id")
def point_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by lines, with a head line and something after each point that is ignored."""
    path, e = fresh(spark), vectors(spark, sf_dir)
    line = F.concat(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), F.lit(" rest"))
    stores.write_files(_text_files(e, F.concat(_block(), F.lit(".txt")), line, "vec_id", "{n} 64\n", "\n\n"), path)
    p = text.reindexed(text.points(text.numbered_lines(spark, path)), "id")
    weighed = F.aggregate(F.transform("coords", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return p.select("id", F.round(weighed, 6).alias("total"), F.size("coords").alias("n"))


_PLAN = lsh.Plan(64, 1.2, 0.9, 4, 5)


@query(
    "select * from (values "
    + ", ".join(f"({i}, '{label}', {value}::double)" for i, (label, value) in enumerate((("R", 1.2), ("Success probability", 0.9), ("Dimension", 64), ("R^2", 1.44), ("Use <u> functions", 1), ("k", 4), ("m [# independent tuples of LSH functions]", 5), ("L", 10), ("W", 4), ("T", 2147483647), ("typeHT", 3))))
    + ") t(pos, label, value)"
)
def parameter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark)
    stores.write_files(spark.createDataFrame([("params.txt", stores.parameter_text(_PLAN))], "name string, content string"), path)
    return text.parameters(text.files(spark, path)).select("pos", "label", "value")


_FS = minhash.hash_functions()


@query(f"""with f as (select * from (values {", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(_FS))}) t(n, a, b))
select (n // 10)::int family, (n % 10)::int i, bin.range::int bin, ((a::bigint * bin.range + b) % {minhash.PRIME})::int "value" from f, range(400) bin""")
def permutation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of 3 x 10 x 400 hash values, a few on each line."""
    flat = [(a * bin_ + b) % minhash.PRIME for a, b in _FS for bin_ in range(400)]
    path, content = fresh(spark), "\n".join(" ".join(map(str, flat[i : i + 37])) for i in range(0, len(flat), 37))
    stores.write_files(spark.createDataFrame([("hash_func.txt", content)], "name string, content string"), path)
    return text.permutations(text.numbered_lines(spark, path)).drop("file")


@query("select img_id, patch, list_sum(h)::bigint total, h[30] last, count(*) n from sketches where img_id is not null and patch is not null and len(h) = 30 and not list_contains(list_transform(h, lambda x: x is null), true) group by all")
def sketch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of hashes, image and patch as text."""
    path, s = fresh(spark), read(spark, sf_dir, "sketches").where("img_id is not null and patch is not null and size(h) = 30 and forall(h, x -> x is not null)")
    stores.write_sketches(s, path)
    back = text.sketch_rows(text.numbered_lines(spark, path))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.groupBy("img_id", "patch", total.alias("total"), F.get("h", F.lit(29)).alias("last")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- motion, skeletons, meshes


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = fresh(spark), vectors(spark, sf_dir)
    at = lambda a, b: F.array_join(F.transform(F.slice("v", a, b - a + 1), lambda x: x.cast("string")), " ")
    line = F.concat(F.col("vec_id").cast("string"), F.lit("\nroot "), at(1, 6), F.lit("\nspine "), at(7, 9), F.lit("\nknee "), at(10, 10))
    name = F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("_"), _block(), F.lit(".amc"))
    stores.write_files(_text_files(e, name, line, "vec_id", "# take\n:FULLY-SPECIFIED\n:DEGREES\n:SAMPLES-PER-SECOND 30\n", "\n"), path)
    return text.amc(text.files(spark, path)).withColumn("clip", F.regexp_extract("file", r"(c\d+)_\d+\.amc$", 1))


@query(f"""with {E_SQL} select 'c' || label clip, vec_id::int frame, case when i <= 6 then 'root' when i <= 9 then 'spine' else 'knee' end bone, 30.0::double fps, round(sum(v), 6) total, count(*)::int n from e where i <= 10 group by all""")
def amc_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion files of three bones."""
    return _motion(spark, sf_dir).select("clip", "frame", "bone", "fps", F.round(vec.total("vals"), 6).alias("total"), F.size("vals").alias("n"))


@query("select 'c' || label clip, 'root' joint, vec_id::int frame, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings")
def clip_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the root out of motion files."""
    m = _motion(spark, sf_dir)
    return text.clips(m.drop("file").withColumnRenamed("clip", "file")).withColumnRenamed("file", "clip")


@query(f"""with {E_SQL}, o as (select vec_id, label, vec_id // {ROWS} blk, (row_number() over (partition by label, vec_id // {ROWS} order by vec_id) - 1)::int frame from embeddings)
select 'h' || o.label || '_' || blk clip, frame, case when i <= 6 then 'hips' else 'chest' end joint, case when i > 6 then 'hips' end parent, 40.0::double fps, round(sum(v), 6) total, count(*)::int n from e join o using (vec_id) where i <= 9 group by all""")
def bvh_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy and motion files of two joints."""
    path, e = fresh(spark), vectors(spark, sf_dir)
    head = """HIERARCHY
ROOT hips
{
  OFFSET 0 0 0
  CHANNELS 6 Xposition Yposition Zposition Zrotation Xrotation Yrotation
  JOINT chest
  {
    OFFSET 0 5.21 0
    CHANNELS 3 Zrotation Xrotation Yrotation
    End Site
    {
      OFFSET 0 1.5 0
    }
  }
}
MOTION
Frames: {n}
Frame Time: 0.025
"""
    name = F.concat(F.lit("h"), F.col("label").cast("string"), F.lit("_"), F.expr(f"vec_id div {ROWS}").cast("string"), F.lit(".bvh"))
    line = F.array_join(F.transform(F.slice("v", 1, 9), lambda x: x.cast("string")), " ")
    stores.write_files(_text_files(e, name, line, "vec_id", head, "\n"), path)
    texts = text.files(spark, path)
    rows = text.bvh_motion(texts).join(text.bvh_joints(texts).select("file", "joint", "parent"), ["file", "joint"])
    return rows.select(F.regexp_extract("file", r"(h\d+_\d+)\.bvh$", 1).alias("clip"), "frame", "joint", "parent", F.round("fps", 6).alias("fps"), F.round(vec.total("vals"), 6).alias("total"), F.size("vals").alias("n"))


def _skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = fresh(spark), read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    bone = F.format_string("  begin\n    id %1$s\n    name b%1$s\n    direction 0 1 %1$s\n    length %1$s.5\n    axis 0 0 %1$s xyz\n    dof rx ry\n    limits (-10 10)\n           (-20 %1$s)\n  end", "k")
    name = F.concat(F.lit("s"), F.col("n_regionkey").cast("string"))
    bones = _text_files(n, name, bone, "n_nationkey", ":version 1.10\n:units\n  length 1\n:bonedata\n", "\n:hierarchy\n  begin\n")
    edges = _text_files(n, name, F.concat(F.lit("    root b"), "k"), "n_nationkey", "", "\n  end\n").withColumnRenamed("content", "more")
    stores.write_files(bones.join(edges, "name").select(F.concat("name", F.lit(".asf")).alias("name"), F.concat("content", "more").alias("content")), path)
    return text.files(spark, path).withColumn("file", F.regexp_extract("file", r"(s\d+)\.asf$", 1))


@query("""select 's' || n_regionkey skeleton, n_nationkey id, 'b' || n_nationkey "name", n_nationkey::double z, n_nationkey + 0.5::double length, 'xyz' axis_order, 2 dof, n_nationkey::double "top" from nation""")
def asf_bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = text.asf_bones(_skeletons(spark, sf_dir))
    return b.select(F.col("file").alias("skeleton"), "id", "name", F.get("direction", F.lit(2)).alias("z"), "length", "axis_order", F.size("dof").alias("dof"), F.get(F.get("limits", F.lit(1)), F.lit(1)).alias("top"))


@query("select 's' || n_regionkey skeleton, 'root' parent, 'b' || n_nationkey child from nation")
def asf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.asf_edges(_skeletons(spark, sf_dir)).withColumnRenamed("file", "skeleton")


@query("""select 'r' || n_regionkey scene, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int pos, n_name "name" from nation""")
def scene_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene files with a plane for each nation."""
    path, n = fresh(spark), read(spark, sf_dir, "nation")
    line = F.concat(F.lit('<Plane name="'), F.replace("n_name", F.lit("&"), F.lit("&amp;")), F.lit('"/>'))
    stores.write_files(_text_files(n, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xml")), line, "n_nationkey", "<Scene>\n", "\n</Scene>\n"), path)
    return text.scene(text.files(spark, path)).select(F.regexp_extract("file", r"(r\d+)\.xml$", 1).alias("scene"), "pos", "name")


_MESH = """v as (select n_regionkey k, row_number() over (partition by n_regionkey order by n_nationkey) place, n_nationkey::double x, (n_nationkey * n_nationkey % 7)::double y, (n_nationkey % 3)::double z from nation),
m as (select k, f.range::int face, c.range::int corner, f.range + c.range vertex, x, y, z from v, range(100) f, range(3) c where place = f.range + c.range + 1 and f.range < (select count(*) from v w where w.k = v.k) - 2)"""


def _meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of triangles: corners n, n + 1 and n + 2 of a region's nations."""
    path, n = fresh(spark), read(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))
    name = F.concat(F.lit("m"), F.col("n_regionkey").cast("string"), F.lit(".obj"))
    v = _text_files(n, name, F.format_string("v %d %d %d", "k", F.expr("k * k % 7"), F.expr("k % 3")), "k", "# strip\n", "\nvt 0 0\n")
    faces = n.groupBy(name.alias("name")).agg(F.count("*").alias("c")).select("name", F.explode(F.expr("sequence(1, cast(c as int) - 2)")).alias("i")).withColumn("t", F.format_string("f %d/1 %d/1 %d/1", "i", F.col("i") + 1, F.col("i") + 2))
    f = faces.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "\n").alias("more"))
    stores.write_files(v.join(f, "name").select("name", F.concat("content", "more").alias("content")), path)
    return text.obj_mesh(text.files(spark, path)).withColumn("file", F.regexp_extract("file", r"m(\d+)\.obj$", 1).cast("int")).withColumnRenamed("file", "k")


@query(f"""with {_MESH} select k, face, corner, vertex::int vertex, x, y, z from m""")
def obj_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meshes(spark, sf_dir)


@query(f"""with {_MESH}, t as (select k, face, max(x) filter (where corner = 0) x0, max(y) filter (where corner = 0) y0, max(z) filter (where corner = 0) z0, max(x) filter (where corner = 1) x1, max(y) filter (where corner = 1) y1, max(z) filter (where corner = 1) z1,
max(x) filter (where corner = 2) x2, max(y) filter (where corner = 2) y2, max(z) filter (where corner = 2) z2 from m group by 1, 2),
n as (select k, face, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) nz from t),
s as (select m.k, vertex::int vertex, sum(nx) x, sum(ny) y, sum(nz) z from m join n on m.k = n.k and m.face = n.face group by 1, 2)
select k, vertex, round(x / nullif(sqrt(x * x + y * y + z * z), 0), 6) nx, round(y / nullif(sqrt(x * x + y * y + z * z), 0), 6) ny, round(z / nullif(sqrt(x * x + y * y + z * z), 0), 6) nz from s""")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.vertex_normals(_meshes(spark, sf_dir), ["k"])


@query("select n_nationkey::int idx, n_nationkey / 32.0::double r, n_regionkey / 8.0::double g, 1.0::double b from nation")
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour for each nation; nations are numbered without gaps."""
    path, n = fresh(spark), read(spark, sf_dir, "nation")
    line = F.concat_ws(" ", (F.col("n_nationkey") / 32.0).cast("string"), (F.col("n_regionkey") / 8.0).cast("string"), F.lit("1"))
    stores.write_files(_text_files(n, F.lit("map.txt"), line, "n_nationkey"), path)
    return text.colormap(text.files(spark, path)).drop("file")
