"""Readers of the text formats: token files, configs, cameras, motion and skeleton files, parameters, meshes.

All but ``line_store`` go through Spark's file sources (any Hadoop file system, one row a file, in parallel by file) and parse
in ``mapInPandas`` or Columns; that one opens listed files in its tasks, as ``stores.write_files`` does. Malformed files raise with their name; empty files give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionq.operators.series import running_offsets
from motionq.tables import table


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, text)``, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _parsed(texts: DataFrame, parse: Callable[[str], Iterable[tuple]], columns: list[str], types: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                try:
                    rows = list(parse(text or ""))
                    if any(len(r) != len(columns) for r in rows):
                        raise ValueError("values are missing")
                except (ValueError, IndexError) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pd.DataFrame([(file, *r) for r in rows], columns=["file", *columns])

    return texts.mapInPandas(work, f"file string, {types}")


def point_sets(texts: DataFrame) -> DataFrame:
    """``N``, then for each image ``2n`` and n pairs: ``(file, img_id, pos, x, y)``."""

    def parse(text: str):
        t = list(map(int, text.split()))
        at = 1
        for img in range(t[0] if t else 0):
            n, at = t[at] // 2, at + 1
            for pos in range(n):
                yield img, pos, t[at], t[at + 1]
                at += 2

    return _parsed(texts, parse, ["img_id", "pos", "x", "y"], "img_id long, pos int, x int, y int")


def lines(texts: DataFrame) -> DataFrame:
    """``N``, then for each image ``n`` and n times ``x1 y1 x2 y2``: ``(file, img_id, pos, x1, y1, x2, y2)``."""

    def parse(text: str):
        t = list(map(int, text.split()))
        at = 1
        for img in range(t[0] if t else 0):
            n, at = t[at], at + 1
            for pos in range(n):
                yield img, pos, *t[at : at + 4]
                at += 4

    return _parsed(texts, parse, ["img_id", "pos", "x1", "y1", "x2", "y2"], "img_id long, pos int, x1 int, y1 int, x2 int, y2 int")


#: Bytes of a token file that are parsed at once.
BLOCK = 1 << 20


def _tokens(file: str) -> Iterator[np.ndarray]:
    """The whole numbers of a file in order, a block at a time."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_stream(path) as stream:
        rest = b""
        while block := stream.read(BLOCK):
            block = rest + block
            cut = max(block.rfind(b" "), block.rfind(b"\n"), block.rfind(b"\t"), block.rfind(b"\r")) + 1  # a number may go on in the next block
            rest = block[cut:]
            yield np.array(list(map(int, block[:cut].decode().split())), np.int64)
        yield np.array(list(map(int, rest.decode().split())), np.int64)


def _grouped(blocks: Iterable[np.ndarray], width: int, factor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of image, pos and ``width`` values out of ``N``, then for each image ``factor * n`` and n times the values."""
    total: int | None = None
    img, pos, left = -1, 0, 0
    rest = np.empty(0, np.int64)
    for block in blocks:
        t, at, found = np.concatenate([rest, block]), 0, []
        if total is None and len(t):
            total, at = int(t[0]), 1
        while total is not None:
            if left == 0:
                if img + 1 >= total:
                    at = len(t)
                    break
                if at >= len(t):
                    break
                img, pos, left, at = img + 1, 0, max(0, int(t[at]) // factor), at + 1
            elif n := min(left, (len(t) - at) // width):
                found.append((img, pos, at, n))
                pos, left, at = pos + n, left - n, at + n * width
            else:
                break
        rest = t[at:]
        if found:
            imgs, firsts, starts, ns = np.array(found, np.int64).T
            inside = np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
            where = np.repeat(starts, ns) + inside * width
            yield np.repeat(imgs, ns), np.repeat(firsts, ns) + inside, *(t[where + c] for c in range(width))
    if left or img + 1 < (total or 0):
        raise ValueError("values are missing")


def line_store(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The images of ``lines`` files in file order as one store: ``(img_id, pos, x1, y1, x2, y2)``.

    A task opens its files and parses them block by block, so a file and an image may be of any size. Ids of a file follow the
    images that the files before say they have, with lines or without.
    """
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    schema = pa.schema([("img_id", pa.int64()), ("pos", pa.int64()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2"))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                try:
                    n = next((int(t[0]) for t in _tokens(file) if len(t)), 0)
                except (ValueError, OverflowError) as e:
                    raise ValueError(f"{file}: {e}") from e
                yield pa.RecordBatch.from_pydict({"file": [file], "n": [max(0, n)]})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                try:
                    for img, *values in _grouped(_tokens(file), 4, 1):
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([img + offset, *values], schema, strict=True)], schema=schema)
                except (ValueError, OverflowError) as e:
                    raise ValueError(f"{file}: {e}") from e

    first = table(running_offsets(names.mapInArrow(counted, "file string, n long"), "file", "n"))
    if first.count() <= 100_000:
        first = F.broadcast(first)  # Spark's packing of files into tasks by size stays
    return names.join(first, "file").select("file", "offset").mapInArrow(work, "img_id long, pos long, x1 int, y1 int, x2 int, y2 int")


def joints(texts: DataFrame) -> DataFrame:
    """Joint names up to the first token that begins with a digit (the image count), then two integers a joint:
    ``(file, img_id, joint, x, y)``."""

    def parse(text: str):
        t = text.split()
        n = next((i for i, x in enumerate(t) if x[0].isdigit()), len(t))
        names, at = t[:n], n + 1
        for img in range(int(t[n]) if n < len(t) else 0):
            for name in names:
                yield img, name, int(t[at]), int(t[at + 1])
                at += 2

    return _parsed(texts, parse, ["img_id", "joint", "x", "y"], "img_id long, joint string, x int, y int")


def reindexed(rows: DataFrame, img: str = "img_id") -> DataFrame:
    """Images of several files in file order as one store: ids of a file follow those of the files before."""
    count = rows.groupBy("file").agg((F.max(img) + 1).alias("n"))
    return rows.join(running_offsets(count, "file", "n"), "file").withColumn(img, F.col(img) + F.col("offset")).drop("offset")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, n, line)`` of text files by lines, ``n`` counting the lines of a file that aren't blank from 0.

    A file may be of any size: it is read in splits, whose lines are numbered where they lie; only the sizes of splits
    are summed up.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")).where(F.trim("line") != "")
    lines = table(lines)  # written: the numbers must stay
    split = lines.groupBy("at").agg(F.count("*").alias("n"), F.min("_at").alias("_least"))
    inside = Window.partitionBy("at.file").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    first = split.select("at", "_least", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("at", F.shiftright(F.col("_at") - F.col("_least"), 12)).orderBy("_at")) - 1
    parts = lines.join(first, "at").withColumn("_part", F.shiftright(F.col("_at") - F.col("_least"), 12)).withColumn("_in", within)
    sizes = parts.groupBy("at", "_part").agg(F.count("*").alias("n"))
    before = sizes.select("at", "_part", F.coalesce(F.sum("n").over(Window.partitionBy("at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = parts.join(before, ["at", "_part"])
    return out.select("at.file", (F.col("_first") + F.col("_before") + F.col("_in")).alias("n"), "line")


def points(lines: DataFrame) -> DataFrame:
    """One point a line of ``numbered_lines``: ``(file, id, coords)``.

    A first line of two whole numbers that name the count of the other lines and a dimension is no point, and then what
    follows a point on its line is ignored.
    """
    head = lines.where("n = 0").select("file", F.split(F.trim("line"), r"\s+").alias("h"))
    size = lines.groupBy("file").agg(F.count("*").alias("total")).join(head, "file")
    whole = (F.size("h") == 2) & F.forall("h", lambda x: x.rlike(r"^\d+$"))
    given = F.when(whole & (F.try_element_at("h", F.lit(1)).try_cast("long") == F.col("total") - 1), F.try_element_at("h", F.lit(2)).try_cast("int"))
    rows = lines.join(size.select("file", given.alias("dim")), "file").where("dim is null or n > 0")
    tokens = F.split(F.trim("line"), r"\s+")
    tokens = F.when(F.col("dim").isNotNull(), F.slice(tokens, 1, F.col("dim"))).otherwise(tokens)
    return rows.select("file", (F.col("n") - F.when(F.col("dim").isNotNull(), 1).otherwise(0)).alias("id"), tokens.cast("array<double>").alias("coords"))


def parameters(texts: DataFrame) -> DataFrame:
    """Label line, value line, and so on: ``(file, pos, label, value)``."""

    def parse(text: str):
        rows = [r.strip() for r in text.splitlines() if r.strip()]
        for i in range(0, len(rows) - 1, 2):
            yield i // 2, rows[i], float(rows[i + 1])

    return _parsed(texts, parse, ["pos", "label", "value"], "pos int, label string, value double")


def _flat_tokens(lines: DataFrame) -> DataFrame:
    """``(file, at, token)``: the whole numbers of a file in order, whatever lines they are on."""
    words = lines.select("file", "n", F.split(F.trim("line"), r"\s+").alias("t"))
    block = F.expr("n div 4096")
    inside = Window.partitionBy("file", block).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sums = words.groupBy("file", block.alias("_block")).agg(F.sum(F.size("t")).alias("s"))
    before = sums.select("file", "_block", F.coalesce(F.sum("s").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = words.withColumns({"_own": F.coalesce(F.sum(F.size("t")).over(inside), F.lit(0)), "_block": block}).join(before, ["file", "_block"])
    out = own.select("file", (F.col("_own") + F.col("_before")).alias("first"), F.posexplode("t").alias("i", "token"))
    return out.select("file", (F.col("first") + F.col("i")).alias("at"), F.col("token").cast("long").alias("token"))


def permutations(lines: DataFrame, families: int = 3, per: int = 10) -> DataFrame:
    """Tables of hash values out of ``numbered_lines``, ``families`` times ``per`` of equal length: ``(file, family, i, bin, value)``."""
    t = _flat_tokens(lines)
    bins = t.groupBy("file").agg(F.floor(F.count("*") / (families * per)).alias("bins"))
    t = t.join(bins, "file").where(F.col("at") < F.col("bins") * families * per)
    return t.select(
        "file", F.expr(f"at div ({per} * bins)").cast("int").alias("family"), F.expr(f"(at div bins) % {per}").cast("int").alias("i"), (F.col("at") % F.col("bins")).cast("int").alias("bin"), F.col("token").cast("int").alias("value")
    )


def sketch_rows(lines: DataFrame, values: int = 30) -> DataFrame:
    """``N``, then rows of ``values`` hashes, image and patch out of ``numbered_lines``: ``(file, img_id, patch, h)``.

    One row a line, as written; the line of the count may be missing.
    """
    t = lines.select("file", "n", F.split(F.trim("line"), r"\s+").cast("array<long>").alias("t")).where(F.size("t") >= values + 2)
    return t.select("file", F.get("t", F.lit(values)).alias("img_id"), F.get("t", F.lit(values + 1)).cast("int").alias("patch"), F.slice("t", 1, values).cast("array<int>").alias("h"))


def colormap(texts: DataFrame) -> DataFrame:
    """``r g b`` triples to the end: ``(file, idx, r, g, b)``."""

    def parse(text: str):
        t = list(map(float, text.split()))
        for i in range(len(t) // 3):
            yield i, *t[3 * i : 3 * i + 3]

    return _parsed(texts, parse, ["idx", "r", "g", "b"], "idx int, r double, g double, b double")


def parse_config(text: str, delimiter: str = "=", comment: str = "#", sentinel: str = "EndConfigFile") -> dict[str, str]:
    """``key = value`` pairs. A value goes on over lines without a delimiter up to a blank line; comments are cut;
    reading ends at the sentinel; the last of equal keys wins."""
    out: dict[str, str] = {}
    key: str | None = None
    for raw in text.splitlines():
        line = raw.split(comment, 1)[0]
        if sentinel in line:
            break
        if delimiter in line:
            key, value = (s.strip() for s in line.split(delimiter, 1))
            out[key] = value
        elif not line.strip():
            key = None if not raw.strip() else key
        elif key is not None:
            out[key] = f"{out[key]}\n{line.strip()}" if out[key] else line.strip()
    return out


def config(texts: DataFrame) -> DataFrame:
    """``(file, kv)`` with a map of strings."""
    rows = _parsed(texts, lambda text: parse_config(text).items(), ["k", "v"], "k string, v string")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("kv"))


CAMERA = (("rotations", 3), ("distance", 1), ("target", 3), ("pan", 2), ("center", 3), ("up_dir", 3), ("position", 3), ("fov", 1))


def camera(configs: DataFrame, kv: str = "kv", name: str = "file") -> DataFrame:
    """``(name, rotations, distance, target, pan, center, up_dir, position, fov)`` from key ``Camera``.

    A token that is no number before the values is skipped; a missing last value (fov) is taken from key ``fov``.
    """
    tokens = F.filter(F.split(F.trim(F.try_element_at(F.col(kv), F.lit("Camera"))), r"\s+"), lambda t: t.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$"))
    numbers = F.transform(tokens, lambda t: t.cast("double"))
    at, fields = 1, []
    for field, n in CAMERA:
        part = F.slice(F.col("_n"), at, n) if n > 1 else F.try_element_at(F.col("_n"), F.lit(at))
        if field == "fov":
            part = F.coalesce(part, F.try_element_at(F.col(kv), F.lit("fov")).cast("double"))
        fields.append(part.alias(field))
        at += n
    return configs.withColumn("_n", numbers).select(F.col(name).alias("name"), *fields)


def amc(texts: DataFrame) -> DataFrame:
    """Motion: ``#`` and ``:`` lines are header, an integer line opens a frame, then ``bone v1 [v2 ...]``:
    ``(file, fps, frame, bone, vals)``; fps is null where not given."""

    def parse(text: str):
        fps = frame = None
        for line in text.splitlines():
            t = line.split()
            if not t or t[0].startswith("#"):
                continue
            if t[0].startswith(":"):
                fps = float(t[1]) if t[0].upper() == ":SAMPLES-PER-SECOND" else fps
            elif len(t) == 1 and t[0].isdigit():
                frame = int(t[0])
            elif frame is not None:
                yield fps, frame, t[0], [float(x) for x in t[1:]]

    return _parsed(texts, parse, ["fps", "frame", "bone", "vals"], "fps double, frame int, bone string, vals array<double>")


def _sections(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    name = ""
    for line in text.splitlines():
        line = line.split("#", 1)[0]
        if line.strip().startswith(":"):
            head = line.split(None, 1)
            name = head[0][1:].lower()
            out[name] = head[1:]
        elif line.strip():
            out.setdefault(name, []).append(line.strip())
    return out


def asf_bones(texts: DataFrame) -> DataFrame:
    """Skeleton: ``(file, id, name, direction, length, axis, axis_order, dof, limits)``."""

    def parse(text: str):
        for block in re.findall(r"\bbegin\b(.*?)\bend\b", "\n".join(_sections(text).get("bonedata", [])), re.DOTALL):
            b: dict = {"limits": [[float(x) for x in m.split()] for m in re.findall(r"\(([^()]*)\)", block)]}
            for line in block.splitlines():
                t = line.split()
                if t and t[0] in ("id", "name", "direction", "length", "axis", "dof"):
                    b[t[0]] = t[1:]
            axis = b.get("axis", [])
            yield (
                int(b["id"][0]) if "id" in b else None, b["name"][0], [float(x) for x in b.get("direction", [])], float(b["length"][0]) if "length" in b else None,
                [float(x) for x in axis[:3]], axis[3] if len(axis) > 3 else None, b.get("dof", []), b["limits"],
            )

    kinds = "id int, name string, direction array<double>, length double, axis array<double>, axis_order string, dof array<string>, limits array<array<double>>"
    return _parsed(texts, parse, [k.split()[0] for k in re.split(r", (?=[a-z_]+ )", kinds)], kinds)


def asf_edges(texts: DataFrame) -> DataFrame:
    """Skeleton hierarchy: ``(file, parent, child)``."""

    def parse(text: str):
        for line in _sections(text).get("hierarchy", []):
            t = line.split()
            if t and t[0] not in ("begin", "end"):
                for child in t[1:]:
                    yield t[0], child

    return _parsed(texts, parse, ["parent", "child"], "parent string, child string")


def _bvh(text: str) -> tuple[list[tuple], list[list[float]], float | None]:
    """Joints ``(joint, parent, offset, channels)`` in order, rows of values, and frames a second of a hierarchy and motion file."""
    joints: list[tuple] = []
    above: list[str | None] = [None]
    name: str | None = None
    head, _, body = text.partition("MOTION")
    for t in (line.split() for line in head.splitlines()):
        if not t:
            continue
        word = t[0].upper()
        if word in ("ROOT", "JOINT"):
            name = " ".join(t[1:])
        elif word == "END":
            name = None  # an end site has an offset only
        elif word == "{":
            if name is not None:
                joints.append((name, above[-1], [], []))
            above.append(name)
        elif word == "}":
            above.pop()
        elif word in ("OFFSET", "CHANNELS") and above[-1] is not None:
            joints[-1][2 if word == "OFFSET" else 3].extend([float(x) for x in t[1:]] if word == "OFFSET" else t[2:])
    fps, rows = None, []
    for line in body.splitlines():
        t = line.replace(":", ": ").split()
        if t[:2] == ["Frame", "Time:"]:
            fps = 1 / float(t[2]) if float(t[2]) else None
        elif t and t[0] != "Frames:":
            rows.append([float(x) for x in t])
    return joints, rows, fps


def bvh_joints(texts: DataFrame) -> DataFrame:
    """Joints of hierarchy and motion files: ``(file, pos, joint, parent, offset, channels)``; the root's parent is null, end sites are left out."""

    def parse(text: str):
        for pos, (joint, parent, offset, channels) in enumerate(_bvh(text)[0]):
            yield pos, joint, parent, offset, channels

    kinds = "pos int, joint string, parent string, offset array<double>, channels array<string>"
    return _parsed(texts, parse, ["pos", "joint", "parent", "offset", "channels"], kinds)


def bvh_motion(texts: DataFrame) -> DataFrame:
    """Motion of such files: ``(file, fps, frame, joint, vals)``, frames from 0, values in the order of the joint's channels."""

    def parse(text: str):
        joints, rows, fps = _bvh(text)
        for frame, values in enumerate(rows):
            if len(values) != sum(len(j[3]) for j in joints):
                raise ValueError("values do not fit the channels")
            at = 0
            for joint, _, _, channels in joints:
                yield fps, frame, joint, values[at : at + len(channels)]
                at += len(channels)

    return _parsed(texts, parse, ["fps", "frame", "joint", "vals"], "fps double, frame int, joint string, vals array<double>")


def obj_mesh(texts: DataFrame) -> DataFrame:
    """Triangle corners of ``v/vt/vn/f`` meshes: ``(file, face, corner, vertex, x, y, z)``; ``vertex`` numbers the distinct
    (position, texture, normal) triples of a file in order of first use."""

    def parse(text: str):
        v: list = []
        seen: dict = {}
        face = 0
        for line in text.splitlines():
            t = line.split()
            if not t:
                continue
            if t[0] == "v":
                v.append(tuple(map(float, t[1:4])))
            elif t[0] == "f":
                for corner, spec in enumerate(t[1:]):
                    key = tuple(int(x) if x else 0 for x in (spec.split("/") + ["", ""])[:3])
                    at = key[0] - 1 if key[0] > 0 else len(v) + key[0]
                    yield face, corner, seen.setdefault(key, len(seen)), *v[at]
                face += 1

    return _parsed(texts, parse, ["face", "corner", "vertex", "x", "y", "z"], "face int, corner int, vertex int, x double, y double, z double")


def clips(motion: DataFrame, root: str = "root") -> DataFrame:
    """Trajectories ``(file, joint, frame, x, y, z)`` of the root bone of motion rows (its first three values are a position)."""
    at = lambda i: F.get("vals", F.lit(i))
    return motion.where(F.col("bone") == root).select("file", F.col("bone").alias("joint"), "frame", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def scene(texts: DataFrame, root: str = "Scene", child: str = "Plane") -> DataFrame:
    """``(file, pos, name)`` of the children of a scene file, in order; files without any have no rows."""
    n = F.xpath_int("text", F.lit(f"count(/{root}/{child})"))
    names = F.xpath("text", F.lit(f"/{root}/{child}/@name"))
    rows = texts.select("file", n.alias("n"), names.alias("names")).where("n > 0")
    return rows.select("file", "names", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).select("file", "pos", F.get("names", F.col("pos")).alias("name"))


def patch_names(files_: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``patch`` of sketch patch files named ``row_col`` on the 8 x 8 grid; null for other names."""
    r, c = (F.expr(f"try_cast(regexp_extract({path}, '(\\\\d+)_(\\\\d+)\\\\.[^./]*$', {i}) as int)") for i in (1, 2))
    return files_.withColumn("patch", F.when((r < 8) & (c < 8), r * 8 + c))
