"""Feature stores: parquet tables by feature, and text and XML exchange formats."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import batch
from motionq.operators.series import running_offsets
from motionq.tables import cleaned, dropped, partitions, table

log = logging.getLogger(__name__)


#: Images in a file of an exchange format.
FILE_IMAGES = 10_000
#: Image matrices: magnitude, orientation, decomposed magnitude (planes below each other) or edges.
MATRIX = "img_id long, kind string, rows int, cols int, data array<double>"
#: Names of the matrices of an image in XML (fixed values of the format).
NAMES = {"magnitude": "image_{}_m_n", "orientation": "image_{}_o", "decomposed": "image_{}_d", "edges": "edgeimage_{}"}


def write_features(features: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ("feature",), key: str = "img_id") -> None:
    """Append to a store, partitioned by ``by``; rows are spread by image, so no task writes a whole feature."""
    features.repartition(*by, F.pmod(F.xxhash64(key), F.lit(partitions(features.sparkSession)))).write.mode(mode).partitionBy(*by).parquet(path)


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each row ``(name, content)``, written by the tasks; a repeated task writes the same again."""

    place = qualified(files.sparkSession, folder)

    def put(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(place)
        system.create_dir(base, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{base}/{r.name}") as out:
                out.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content))

    files.select("name", "content").foreachPartition(put)


def _in_files(df: DataFrame, img: str, per_file: int) -> DataFrame:
    """Adds ``file``, the range of images a row goes to, and ``local``, its number there."""
    return df.withColumns({"file": F.floor(F.col(img) / per_file), "local": F.pmod(F.col(img), F.lit(per_file))})


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more stores as one (columns matched by name, absent ones null)."""
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no store given")
    return out


def _on_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it for."""
    system, p = _on_system(spark, path)
    whole = system.makeQualified(p).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _on_system(spark, path)
    return system.exists(p)


def read_limbs(spark: SparkSession, paths: dict[int, str], view_id: int) -> DataFrame:
    """Histogram stores in XML by body part, with column ``limb``; a part whose store is missing is logged and skipped."""
    out = spark.createDataFrame([], "view_id int, img_id long, feature string, patch int, hist array<double>, limb int")
    for limb, path in paths.items():
        if not exists(spark, path):
            log.warning("no store of limb %d at %s", limb, path)
            continue
        out = out.unionByName(read_xml_features(spark, path, view_id).withColumn("limb", F.lit(limb)))
    return out


def read_xml_features(spark: SparkSession, path: str | list[str], view_id: int) -> DataFrame:
    """Histogram stores in XML: ``filenum``, ``feature_type``, matrices ``r_i`` or, by patch, ``r{i}_c{patch}``, each with
    rows, cols and whitespace separated data: ``(view_id, img_id, feature, patch, hist)``.

    Several files are appended in path order, the images of each numbered after those of the files before.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("x"))
    kind = F.trim(F.regexp_extract("x", r"<feature_type>\s*\"?([A-Za-z]+)\"?\s*</feature_type>", 1))
    count = F.regexp_extract("x", r"<filenum>\s*(\d+)\s*</filenum>", 1).cast("long")
    before = running_offsets(texts.select("file", count.alias("n")), "file", "n")
    found = F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<(r_?\d+(?:_c\d+)?)\b[^>]*>.*?</\1>"), F.lit(0)))
    cells = texts.select("file", kind.alias("feature"), found.alias("m"))
    name = F.regexp_extract("m", r"^<r_?(\d+)(?:_c(\d+))?", 1).cast("long")
    patch = F.regexp_extract("m", r"^<r_?(\d+)(?:_c(\d+))?", 2)
    data = F.split(F.trim(F.regexp_extract("m", r"(?s)<data>(.*?)</data>", 1)), r"\s+")
    return cells.join(before, "file").select(
        F.lit(view_id).alias("view_id"), (name + F.col("offset")).alias("img_id"), "feature", F.when(patch != "", patch.cast("int")).alias("patch"), data.cast("array<double>").alias("hist")
    )


def write_xml_features(features: DataFrame, path: str, feature: str, per_file: int = 500) -> None:
    """The same format: ``features(img_id, patch, hist)`` in files of ``per_file`` images, whose names keep the order.

    A file says how many images it has up to its last one; every file but the last is taken to be full.
    """
    spark, last = features.sparkSession, features.agg(F.max("img_id")).first()[0]
    total = 0 if last is None else last + 1
    rows = _in_files(features, "img_id", per_file)
    local = F.col("local").cast("string")
    name = F.when(F.col("patch").isNull(), F.concat(F.lit("r_"), local)).otherwise(F.concat(F.lit("r"), local, F.lit("_c"), "patch"))
    line = F.concat(F.lit("<"), name, F.lit(' type_id="opencv-matrix"><rows>1</rows><cols>'), F.size("hist"), F.lit("</cols><dt>f</dt><data>"), _numbers("hist"), F.lit("</data></"), name, F.lit(">"))
    body = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("local", F.coalesce("patch", F.lit(-1)).alias("p"), line.alias("line")))).alias("l"))
    every = spark.range(0, -(-total // per_file)).withColumnRenamed("id", "file").join(body, "file", "left")
    n = F.least(F.lit(per_file), F.lit(total) - F.col("file") * per_file).cast("string")
    text = F.concat(F.lit('<?xml version="1.0"?>\n<opencv_storage>\n<filenum>'), n, F.lit(f"</filenum>\n<feature_type>{feature}</feature_type>\n"), F.array_join(F.transform(F.coalesce("l", F.expr("array()").cast(body.schema["l"].dataType)), lambda s: s["line"]), "\n"), F.lit("\n</opencv_storage>\n"))
    write_files(every.select(_file_name("xml"), text.alias("content")), path)


def _file_name(kind: str):
    return F.concat(F.lit("part-"), F.lpad(F.col("file").cast("string"), 10, "0"), F.lit(f".{kind}")).alias("name")


def _numbers(column: str):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), " ")


def write_matrices(matrices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Image matrices ``MATRIX`` as a store partitioned by kind; it replaces what was there."""
    write_features(matrices, path, mode, ("kind",))


def read_matrices(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == kind)


def write_xml_matrices(matrices: DataFrame, path: str, per_file: int = 100) -> None:
    """Image matrices in XML, files of ``per_file`` images; images keep their numbers."""
    name = F.lit(None).cast("string")
    for kind, pattern in NAMES.items():
        name = F.when(F.col("kind") == kind, F.format_string(pattern.replace("{}", "%d"), F.col("img_id"))).otherwise(name)
    line = F.concat(F.lit("<"), name, F.lit(' type_id="opencv-matrix"><rows>'), "rows", F.lit("</rows><cols>"), "cols", F.lit("</cols><dt>d</dt><data>"), _numbers("data"), F.lit("</data></"), name, F.lit(">"))
    body = _in_files(matrices, "img_id", per_file).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("local", "kind", line.alias("line")))).alias("l"))
    text = F.concat(F.lit('<?xml version="1.0"?>\n<opencv_storage>\n'), F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\n</opencv_storage>\n"))
    write_files(body.select(_file_name("xml"), text.alias("content")), path)


def read_xml_matrices(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """The matrices of a kind as ``MATRIX``."""
    front, back = NAMES[kind].split("{}")
    whole = rf"(?s)<({front}\d+{back})\b[^>]*>.*?</\1>"
    m = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(whole), F.lit(0))).alias("m"))
    at = lambda tag: F.trim(F.regexp_extract("m", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return m.select(
        F.regexp_extract("m", rf"^<{front}(\d+)", 1).cast("long").alias("img_id"), F.lit(kind).alias("kind"), at("rows").cast("int").alias("rows"), at("cols").cast("int").alias("cols"), F.split(at("data"), r"\s+").cast("array<double>").alias("data")
    )


def plane(matrices: DataFrame, i: int, height: int = 8) -> DataFrame:
    """Rows ``height * i`` to ``height * (i + 1) - 1`` of each matrix, as a matrix: one direction of a decomposed image."""
    data = F.slice("data", F.lit(height * i) * F.col("cols") + 1, F.lit(height) * F.col("cols"))
    return matrices.where(F.col("rows") >= height * (i + 1)).withColumns({"data": data, "rows": F.lit(height)})


def from_cells(cells: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """``(keys, rows, cols, data)``: sparse cells ``(keys, x, y, v)`` as row-major matrices, absent cells 0."""
    pair = F.struct((F.col("x") * cols + F.col("y")).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
    m = cells.where((F.col("x") >= 0) & (F.col("x") < rows) & (F.col("y") >= 0) & (F.col("y") < cols)).groupBy(*keys).agg(F.collect_list(pair).alias("m"))
    data = batch.filled(F.transform("m", lambda p: p["at"]), F.transform("m", lambda p: p["v"]), rows * cols)
    return m.select(*keys, F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), data.alias("data"))


def cells_of(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, x, y, v)`` of matrices."""
    flat = matrices.select(*keys, "cols", F.posexplode("data").alias("at", "v"))
    return flat.select(*keys, F.expr("at div cols").cast("int").alias("x"), (F.col("at") % F.col("cols")).cast("int").alias("y"), "v")


def write_grouped_text(rows: DataFrame, path: str, columns: list[str], factor: int = 1, per_file: int = FILE_IMAGES) -> None:
    """Token text: number of images, then for each image ``factor * n`` and its values in ``pos`` order.

    ``columns``: ``x, y`` for point sets (factor 2), ``x1, y1, x2, y2`` for lines. Files of ``per_file`` images, whose names
    keep the order: read them back with ``text.line_store`` or ``text.reindexed``. Images without rows have a 0. The rows of a
    file are sorted by its task and written as they come, so neither a file nor an image has to fit in memory.
    """
    spark = rows.sparkSession
    counts = table(rows.where("img_id >= 0").groupBy("img_id").agg(F.count("*").alias("n")))  # one row an image
    last = counts.agg(F.max("img_id")).first()[0]
    total = 0 if last is None else last + 1
    system, p = _on_system(spark, path)
    system.mkdirs(p)
    item = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    every = spark.range(0, total).withColumnRenamed("id", "img_id").join(counts, "img_id", "left")
    # the line of an image begins with its count, so that row has no pos and sorts first
    heads = every.select("img_id", F.lit(None).cast(rows.schema["pos"].dataType).alias("pos"), F.concat(F.lit("\n"), (F.coalesce("n", F.lit(0)) * factor).cast("string")).alias("t"))
    items = rows.where("img_id >= 0").select("img_id", "pos", F.concat(F.lit(" "), item).alias("t"))
    many = max(1, min(-(-total // per_file), partitions(spark)))
    spread = heads.unionByName(items).repartitionById(many, F.expr(f"cast(img_id div {per_file} % {many} as int)"))
    lines = spread.sortWithinPartitions("img_id", "pos", "t").select(F.expr(f"img_id div {per_file}").alias("file"), "t")
    place = qualified(spark, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(place)
        file, out, named, got = None, None, 0, 0

        def close() -> None:
            if out is not None:
                out.write(b"\n")
                out.close()
                if named != got * factor:
                    raise ValueError(f"file {file} of {place}: the rows are not those that were counted")

        for batch in batches:
            files = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if files[a] != file:
                    close()
                    file, named, got = int(files[a]), 0, 0
                    out = system.open_output_stream(f"{base}/part-{file:010d}.txt")
                    out.write(str(min(per_file, total - file * per_file)).encode())
                t = batch.column(1).slice(a, b - a)
                first = t.filter(pc.starts_with(t, "\n")).to_pylist()
                named, got = named + sum(map(int, first)), got + len(t) - len(first)
                out.write(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t), "")[0].as_buffer())
        close()
        yield from ()

    with cleaned(spark):
        lines.mapInArrow(put, "done boolean").collect()
    dropped(counts)


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Rows of hashes, image and patch."""
    row = F.concat_ws(" ", F.array_join("h", " "), F.col("img_id").cast("string"), F.col("patch").cast("string"))
    sketches.select(row.alias("value")).write.mode("overwrite").text(path)


def camera_text(cameras: DataFrame, name: str = "cam_name") -> DataFrame:
    """``(file, text)``: config text of camera rows; a null fov is left out."""
    parts = [F.array_join(F.col(c).cast("array<string>"), " ") if many else F.col(c).cast("string") for c, many in (
        ("rotations", 1), ("cam_distance", 0), ("cam_target", 1), ("pan", 1), ("center", 1), ("up_dir", 1), ("cam_position", 1), ("fov", 0))]
    return cameras.select(F.col(name).alias("file"), F.concat(F.lit("# camera\nCamera = "), F.concat_ws(" ", *parts), F.lit("\nEndConfigFile\n")).alias("text"))


def config_text(configs: DataFrame, kv: str = "kv") -> DataFrame:
    """``(file, text)`` of maps, keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(kv)), lambda e: F.concat(e["key"], F.lit(" = "), e["value"]))
    return configs.select("file", F.concat(F.array_join(pairs, "\n"), F.lit("\n")).alias("text"))


def parameter_text(plan) -> str:
    """Label and value lines of a hashing plan."""
    pairs = (
        ("R", plan.radius), ("Success probability", plan.success), ("Dimension", plan.dim), ("R^2", plan.radius**2), ("Use <u> functions", 1), ("k", plan.k),
        ("m [# independent tuples of LSH functions]", plan.m), ("L", plan.count), ("W", plan.width), ("T", 2**31 - 1), ("typeHT", 3),
    )
    return "".join(f"{label}\n{value}\n" for label, value in pairs)


def write_parameters(plan, path: str, spark: SparkSession) -> None:
    """The parameters of a hashing plan as one JSON row, to be read by ``read_parameters``."""
    row = (plan.dim, plan.radius, plan.success, plan.k, plan.m, plan.width, plan.seed)
    spark.createDataFrame([row], "dim int, radius double, success double, k int, m int, width double, seed int").coalesce(1).write.mode("overwrite").json(path)


def read_parameters(spark: SparkSession, path: str):
    from motionq.operators.lsh import Plan

    return Plan(**spark.read.schema("dim int, radius double, success double, k int, m int, width double, seed int").json(path).first().asDict())
