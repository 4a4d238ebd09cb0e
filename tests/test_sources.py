import numpy as np
import pytest
from pyspark.sql import functions as F

from motionq.operators import lsh
from motionq.sources import images, stores, text
from motionq.streaming import scores


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content) if isinstance(content, bytes) else p.write_text(content)
    return str(p)


def read(spark, tmp_path, name, content):
    return text.files(spark, write(tmp_path, name, content))


def by_lines(spark, tmp_path, name, content):
    return text.numbered_lines(spark, write(tmp_path, name, content))


def rows(df):
    return [tuple(r) for r in df.drop("file").collect()]


def test_token_formats(spark, tmp_path):
    assert rows(text.point_sets(read(spark, tmp_path, "a", "1 4 3 7 4 8"))) == [(0, 0, 3, 7), (0, 1, 4, 8)]
    assert rows(text.lines(read(spark, tmp_path, "b", "1\n2 0 0 3 4 10 10 10 20"))) == [(0, 0, 0, 0, 3, 4), (0, 1, 10, 10, 10, 20)]
    assert rows(text.joints(read(spark, tmp_path, "c", "root head\n2\n10 20 11 30\n12 22 13 33\n"))) == [(0, "root", 10, 20), (0, "head", 11, 30), (1, "root", 12, 22), (1, "head", 13, 33)]
    assert rows(text.points(by_lines(spark, tmp_path, "d", "1.5 2\n3 -4e1\n")).orderBy("id")) == [(0, [1.5, 2.0]), (1, [3.0, -40.0])]
    assert rows(text.points(by_lines(spark, tmp_path, "d2", "2 1\n5 9\n6 8\n")).orderBy("id")) == [(0, [5.0]), (1, [6.0])]
    assert rows(text.parameters(read(spark, tmp_path, "e", "R\n1000\nk\n4\n"))) == [(0, "R", 1000.0), (1, "k", 4.0)]
    assert rows(text.colormap(read(spark, tmp_path, "f", "0 0.5 1\n1 1 1 0.2"))) == [(0, 0.0, 0.5, 1.0), (1, 1.0, 1.0, 1.0)]
    assert rows(text.permutations(by_lines(spark, tmp_path, "g", "5 6\n\n7 8"), 1, 2).orderBy("family", "i", "bin")) == [(0, 0, 0, 5), (0, 0, 1, 6), (0, 1, 0, 7), (0, 1, 1, 8)]
    assert text.point_sets(read(spark, tmp_path, "h", "")).count() == 0
    with pytest.raises(Exception, match="bad"):
        text.lines(read(spark, tmp_path, "bad", "1 2 0 0")).collect()


def test_reindexed_union(spark, tmp_path):
    for n in "ab":
        write(tmp_path, f"{n}.data", "p\n2\n1 1 2 2\n")
    got = text.reindexed(text.joints(text.files(spark, str(tmp_path)))).select("img_id").collect()
    assert sorted(r[0] for r in got) == [0, 1, 2, 3]


def test_amc_and_asf(spark, tmp_path):
    a = ":FULLY-SPECIFIED\n:SAMPLES-PER-SECOND 30\n1\nroot 0 1 0 0 0 -1.6e-014\nknee 10\n2\nknee 11\n"
    got = rows(text.amc(read(spark, tmp_path, "m.amc", a)))
    assert got[0] == (30.0, 1, "root", [0.0, 1.0, 0.0, 0.0, 0.0, -1.6e-14]) and got[2] == (30.0, 2, "knee", [11.0])
    s = """:version 1.10
:units
  mass 1
:bonedata
  begin
    id 1
    name spine
    direction 0 1 0
    length 2.5
    axis 0 0 90 xyz
    dof rx ry
    limits (-10 10)
           (-20 20)
  end
  begin
    id 2
    name tip
    direction 0 1 0
    length 1
    axis 0 0 0 xyz
  end
:hierarchy
  begin
    root spine
    spine tip
  end
"""
    t = read(spark, tmp_path, "s.asf", s)
    assert rows(text.asf_bones(t))[0] == (1, "spine", [0.0, 1.0, 0.0], 2.5, [0.0, 0.0, 90.0], "xyz", ["rx", "ry"], [[-10.0, 10.0], [-20.0, 20.0]])
    assert rows(text.asf_edges(t)) == [("root", "spine"), ("spine", "tip")]


def test_config_and_camera(spark, tmp_path):
    kv = text.parse_config("# top\na = 1 # one\nb = x\n  y\n\nz\na = 2\nEndConfigFile\nc = 3\n")
    assert kv == {"a": "2", "b": "x\ny"}
    c = "Camera = cam 10 20 0 3 0 0 20 0.5 -1 0 0 0 0 1 0 0 0 3\nfov = 45\n"
    r = text.camera(text.config(read(spark, tmp_path, "c.cfg", c))).first()
    assert r.rotations == [10.0, 20.0, 0.0] and r.pan == [0.5, -1.0] and r.position == [0.0, 0.0, 3.0] and r.fov == 45.0


def test_obj(spark, tmp_path):
    got = rows(text.obj_mesh(read(spark, tmp_path, "m.obj", "v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nf 1/1 2/1 3/1\nf 1/1 3/1 2\n")))
    assert [r[2] for r in got] == [0, 1, 2, 0, 2, 3] and got[1][3:] == (1.0, 0.0, 0.0)


def test_stores_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(0, "ARP", None, [1.0, 2.0]), (1, "ARP", None, [3.0, 4.5])], "img_id long, feature string, patch int, hist array<double>")
    stores.write_features(f, str(tmp_path / "s"))
    stores.write_features(f, str(tmp_path / "s"))
    assert stores.read_features(spark, str(tmp_path / "s")).count() == 4
    stores.write_xml_features(f, str(tmp_path / "x"), "ARP")
    got = stores.read_xml_features(spark, str(tmp_path / "x"), 3)
    assert sorted((r.view_id, r.img_id, r.feature, r.patch, r.hist) for r in got.collect()) == [(3, 0, "ARP", None, [1.0, 2.0]), (3, 1, "ARP", None, [3.0, 4.5])]
    p = spark.createDataFrame([(0, 0, 3, 7), (0, 1, 4, 8), (2, 0, 1, 1)], "img_id long, pos int, x int, y int")
    stores.write_grouped_text(p, str(tmp_path / "p"), ["x", "y"], 2)
    assert sorted(rows(text.point_sets(text.files(spark, str(tmp_path / "p" / "*.txt"))))) == [tuple(r) for r in p.collect()]


def picture():
    g = np.full((480, 480, 3), 255, np.uint8)
    g[100:300, 150:155] = 0
    g[200:205, 100:400] = 0
    return g


def test_bitmaps_and_features(spark, tmp_path):
    g = picture()
    assert (images.read_bmp(images.write_bmp(g)) == g).all()
    folder = tmp_path / "img"
    folder.mkdir()
    for name in ("b.png", "a.PNG"):
        write(folder, name, images.write_png(g))
    write(folder, "d.png", b"no picture")
    write(folder, "c.txt", "no")
    files = images.scan(spark, str(folder))
    assert [r.img_id for r in files.orderBy("path").collect()] == [0, 1]
    assert images.black_pixels(files).where("img_id = 0").count() == int((g[..., 2] == 0).sum())
    segs = images.segments(files.where("img_id = 0")).collect()
    assert any(abs(s.x1 - s.x2) <= 2 and abs(s.y1 - s.y2) > 80 for s in segs)
    for kind, size in (("ARP", 540), ("HOUGH", 3600), ("BICE", 400)):
        f = images.featurize(files, kind).collect()
        assert f and all(len(r.hist) == size for r in f) and {r.img_id for r in f} == {0, 1}
        if kind != "BICE":
            assert f[0].hist == f[1].hist


def test_stream_reset_over_batches_and_index(spark, tmp_path):
    folder = tmp_path / "in"
    for i, r in enumerate([[(1, 1, 2.0, False), (1, 2, 3.0, False)], [(1, 3, 0.0, True), (1, 4, 7.0, False), (2, 1, None, False)]]):
        spark.createDataFrame(r, "k long, t long, v double, reset boolean").coalesce(1).write.mode("append").parquet(str(folder / f"part={i}"))
    s = spark.readStream.schema("k long, t long, v double, reset boolean").option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = scores.accumulate(s, "k", ["t"], "v", "reset").writeStream.format("memory").queryName("acc").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("acc").collect()]
    assert (1, 5.0, 2) in got and (1, 7.0, 1) in got and (2, 0.0, 1) in got
    pts = tmp_path / "pts"
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>").write.parquet(str(pts))
    p = lsh.Plan(dim=2, radius=1.0, success=0.9, k=2, m=3)
    stream = spark.readStream.schema("id long, v array<double>").parquet(str(pts))
    scores.insert_into_index(stream, p, "id", "v", str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    index = spark.read.parquet(str(tmp_path / "index"))
    whole = lsh.bucket_table(spark.read.parquet(str(pts)), p, "id", "v")
    assert sorted(map(str, index.select("table_id", "bucket", "id").collect())) == sorted(map(str, whole.collect()))


def test_small_readers(spark, tmp_path):
    t = read(spark, tmp_path, "s.xml", '<Scene><Plane name="floor"/><Plane/></Scene>')
    assert rows(text.scene(t)) == [(0, "floor"), (1, None)]
    m = text.amc(read(spark, tmp_path, "m.amc", "1\nroot 1 2 3 0 0 0\nknee 4\n"))
    assert rows(text.clips(m)) == [("root", 1, 1.0, 2.0, 3.0)]
    names = spark.createDataFrame([("a/3_4.png",), ("a/9_1.png",), ("x.png",)], "path string")
    assert [r.patch for r in text.patch_names(names).collect()] == [28, None, None]
    p = lsh.Plan(dim=4, radius=2.0, success=0.9, k=4, m=5)
    stores.write_parameters(p, str(tmp_path / "p"), spark)
    assert stores.read_parameters(spark, str(tmp_path / "p")) == p
    labels = rows(text.parameters(read(spark, tmp_path, "params", stores.parameter_text(p))))
    assert len(labels) == 11 and labels[0] == (0, "R", 2.0) and labels[7] == (7, "L", 10.0)
    g = np.zeros((2, 3, 3), np.uint8)
    g[1, 2] = (0, 0, 255)
    df = spark.createDataFrame([(0, bytearray(images.write_bmp(g)))], "img_id long, content binary")
    assert [tuple(r) for r in images.coloured_pixels(images.decoded(df)).collect()] == [(0, 1, 2)]
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    write(tmp_path, "gray.png", images.write_png(gray))
    found = images.scan(spark, str(tmp_path), "gray.png").first().image
    assert (images.pixels_of(found)[..., 0] == gray).all()


def test_sketch_folder_and_limbs(spark, tmp_path):
    g = np.full((60, 60, 3), 255, np.uint8)
    g[10:50, 20:30] = 0
    folder = tmp_path / "patches"
    folder.mkdir()
    for name in ("0_1.png", "7_7.png", "other.png"):
        write(folder, name, images.write_png(g))
    write(folder, "1_1.png", images.write_png(np.full((60, 60, 3), 255, np.uint8)))
    got = {r.patch: r.hist for r in images.batch_sketch(spark, str(folder)).collect()}
    assert set(got) == {1, 63} and got[1] == got[63] and sum(got[1]) > 50
    f = spark.createDataFrame([(0, None, [1.0]), (3, None, [2.0])], "img_id long, patch int, hist array<double>")
    stores.write_xml_features(f, str(tmp_path / "limb0"), "ARP", 2)
    limbs = stores.read_limbs(spark, {0: str(tmp_path / "limb0"), 1: str(tmp_path / "none")}, 5).collect()
    assert sorted((r.limb, r.view_id, r.img_id, r.hist) for r in limbs) == [(0, 5, 0, [1.0]), (0, 5, 3, [2.0])]
    assert stores.read_limbs(spark, {1: str(tmp_path / "none")}, 5).count() == 0


def test_extracted_edges(spark, tmp_path):
    folder = tmp_path / "edges"
    folder.mkdir()
    write(folder, "a.png", images.write_png(picture()[90:330, 90:420]))
    images.extract_edges(spark, str(folder), str(tmp_path / "store"))
    m = stores.read_matrices(spark, str(tmp_path / "store"), "edges").first()
    v = np.reshape(m.data, (m.rows, m.cols))
    assert v.shape == (240, 330) and v[60, 55:70].max() > 0 and v[:5].max() == 0


def test_matrices(spark, tmp_path):
    m = spark.createDataFrame([(0, "edges", 2, 2, [1.0, 0.0, 2.5, 3.0]), (7, "edges", 1, 2, [4.0, 5.0]), (7, "magnitude", 1, 1, [9.0])], stores.MATRIX)
    stores.write_xml_matrices(m, str(tmp_path / "m"), 5)
    assert sorted(map(tuple, stores.read_xml_matrices(spark, str(tmp_path / "m"), "edges").collect())) == sorted(tuple(r) for r in m.where("kind = 'edges'").collect())
    assert stores.read_xml_matrices(spark, str(tmp_path / "m"), "orientation").count() == 0
    top = stores.plane(m, 1, 1).collect()
    assert [(r.img_id, r.rows, r.data) for r in top] == [(0, 1, [2.5, 3.0])]
    assert sorted(map(tuple, stores.cells_of(m.where("img_id = 0"), ["img_id"]).collect())) == [(0, 0, 0, 1.0), (0, 0, 1, 0.0), (0, 1, 0, 2.5), (0, 1, 1, 3.0)]
    w = images.window_mean(np.full((9, 9), 8.0))
    assert w[4, 4] == pytest.approx(1.0) and w[0, 0] > 1.5 and (images.window_mean(np.ones((3, 3))) == 0.25).all()


def test_unproject(spark):
    from motionq.operators import grids

    eye = np.eye(4).tolist()
    r = spark.range(1).select(grids.unproject(F.lit(480.0), F.lit(0.0), F.lit(0.5), eye, 480, 480).alias("p")).first().p
    assert (r.x, r.y, r.z) == (1.0, 1.0, 0.0)


def test_black_and_gray():
    assert images.gray(np.array([[[1, 2, 4]]], np.uint8))[0, 0] == 2
    gx, gy, m, theta = images.sobel(np.tile(np.arange(5.0), (5, 1)))
    assert gx[2, 2] == 8 and gy[2, 2] == 0 and theta[2, 2] == 0
    assert F is not None


def test_queries_again_and_latest_state(spark, tmp_path):
    folder = tmp_path / "strokes"
    schema = "user long, x double, ts timestamp"
    from datetime import datetime

    for i, r in enumerate([[(1, 2.0), (2, 5.0)], [(1, 3.0)], [(3, None)]]):
        spark.createDataFrame([(*x, datetime(2020, 1, 1, 0, i)) for x in r], schema).coalesce(1).write.parquet(str(folder / f"part={i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    seen = []
    answer = lambda d: (seen.append(d.select("user").distinct().count()), d.groupBy("user").agg(F.sum("x").alias("x"), F.count("*").alias("n")))[1]
    scores.requery(stream(), ["user"], answer, str(tmp_path / "out"), str(tmp_path / "ck1")).awaitTermination()
    assert sorted(tuple(r) for r in scores.answers(spark, str(tmp_path / "out"), ["user"]).select("user", "x", "n").collect()) == [(1, 5.0, 2), (2, 5.0, 1), (3, None, 1)]
    assert len(seen) == 3 and max(seen) == 2
    last = scores.drained(scores.running(stream(), ["user"], "x"), "update", "user")
    assert sorted(tuple(r) for r in last.collect()) == [(1, 5.0, 2), (2, 5.0, 1), (3, None, 1)]
    whole = scores.drained(scores.running(stream(), ["user"], "x"), "complete")
    assert sorted(tuple(r) for r in whole.collect()) == [(1, 5.0, 2), (2, 5.0, 1), (3, None, 1)]
    assert scores.drained(stream().where("x > 2"), "append").count() == 2
    shown = scores.replay(spark.read.parquet(str(folder)), ["user"], "ts", "x", 30).orderBy("user", "elapsed").select("user", "elapsed", "wait").collect()
    assert [tuple(r) for r in shown] == [(1, 0.0, 0.0), (1, 60.0, 60.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]


def test_hierarchy_and_motion_files(spark, tmp_path):
    body = "HIERARCHY\nROOT a\n{\n OFFSET 0 0 0\n CHANNELS 1 Xposition\n JOINT b\n {\n  OFFSET 1 2 3\n  CHANNELS 2 Xrotation Yrotation\n  End Site\n  {\n   OFFSET 9 9 9\n  }\n }\n JOINT c\n {\n  OFFSET 0 1 0\n  CHANNELS 0\n }\n}\nMOTION\nFrames: 2\nFrame Time: 0.05\n1 2 3\n4 5 6\n"
    t = read(spark, tmp_path, "m.bvh", body)
    assert rows(text.bvh_joints(t)) == [(0, "a", None, [0.0, 0.0, 0.0], ["Xposition"]), (1, "b", "a", [1.0, 2.0, 3.0], ["Xrotation", "Yrotation"]), (2, "c", "a", [0.0, 1.0, 0.0], [])]
    assert rows(text.bvh_motion(t))[3:] == [(20.0, 1, "a", [4.0]), (20.0, 1, "b", [5.0, 6.0]), (20.0, 1, "c", [])]
    assert text.bvh_motion(read(spark, tmp_path, "e.bvh", "")).count() == 0
    with pytest.raises(Exception, match="channels"):
        text.bvh_motion(read(spark, tmp_path, "bad.bvh", body.replace("4 5 6", "4 5"))).collect()


def test_line_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", 7)  # numbers and images go on from block to block
    lines = [(0, 0, 100, 20, 3, 4), (0, 1, 5, 6, 7, 8), (2, 0, 9, 10, 11, 12), (5, 0, -1, 0, 0, 12345)]
    df = spark.createDataFrame(lines[::-1], "img_id long, pos int, x1 int, y1 int, x2 int, y2 int")
    stores.write_grouped_text(df, str(tmp_path / "two"), ["x1", "y1", "x2", "y2"], per_file=4)
    files = sorted((tmp_path / "two").iterdir())
    assert [f.read_text() for f in files if f.name.startswith("part")] == ["4\n2 100 20 3 4 5 6 7 8\n0\n1 9 10 11 12\n0\n", "2\n0\n1 -1 0 0 12345\n"]
    assert sorted(map(tuple, text.line_store(spark, str(tmp_path / "two")).collect())) == lines
    stores.write_grouped_text(df.where("false"), str(tmp_path / "none"), ["x1", "y1", "x2", "y2"])
    assert text.line_store(spark, str(tmp_path / "none")).count() == 0
    assert text.line_store(spark, write(tmp_path, "empty", "")).count() == 0
    assert text.line_store(spark, write(tmp_path, "a b%", "1 1 1 2 3 4")).count() == 1
    for bad in ("1 2 0 0 1 1 2", "2 0", "1 1 0 0 x 1", "1 1 0 0 1 9999999999"):
        with pytest.raises(Exception, match="odd"):
            text.line_store(spark, write(tmp_path, "odd", bad)).collect()


def test_line_lists_with_images_without_lines(spark, tmp_path):
    """The last image of the first file has no lines: the images behind it keep their numbers."""
    from motionq.plans import files

    keys = [(o, 3 * o, 5, 1) for o in (*range(7), 9, 49, 109) for _ in range(o % 3 + 1)]
    spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in files.line_lists(spark, str(tmp_path)).collect())
    assert got == sorted((o % 50, 3 * o, 5, o, 67, keys.count((o, 3 * o, 5, 1))) for o in {k[0] for k in keys})


def test_line_store_memory(spark, tmp_path, monkeypatch):
    """Of a file, only a block is in memory, also where one image has all lines."""
    import tracemalloc

    monkeypatch.setattr(text, "BLOCK", 1 << 16)
    n = 200_000
    file = write(tmp_path, "big", f"1\n{n} " + " ".join(f"{i % 480} {i % 479} 1000 {i % 7}" for i in range(n)))
    list(text._grouped(text._tokens("file://" + write(tmp_path, "small", "1 1 1 2 3 4")), 4, 1))
    tracemalloc.start()
    rows = sum(len(b[0]) for b in text._grouped(text._tokens("file://" + file), 4, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 10e6
    assert text.line_store(spark, file).selectExpr("count(*)", "sum(x1)", "max(pos)").first()[:] == (n, sum(i % 480 for i in range(n)), n - 1)
