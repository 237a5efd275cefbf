"""Pixel jobs on real files."""

from __future__ import annotations

import gzip
import json
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.files import plain_png
from lumenloom.functions import hashing as H
from lumenloom.functions import pixels as P
from lumenloom.params import CaptionOptions, ExportOptions, SimilarityOptions
from lumenloom.plans import captioning, dedup, export, pixels
from lumenloom.sources import dictionaries, scan, sinks
from tests.helpers import pooling_model, spotted, write_png

CROPS = "image_id bigint, x double, y double, w double, h double, kind string, pos bigint"


def with_ids(df, names):
    rows = [(i, n) for i, n in enumerate(names)]
    return df.join(df.sparkSession.createDataFrame(rows, "image_id bigint, uri string"), "uri")


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 2), (5, 7, 3), (5, 7, 4)):
        img = rng.integers(0, 256, shape).astype(np.uint8)
        assert (plain_png(P.encode_png(img)).squeeze() == img).all()


def test_shrinking_is_gamma_correct():
    board = ((np.indices((256, 256)).sum(axis=0) % 2 == 0) * 255).astype(np.uint8)
    one = P.shrink_in_linear_light(np.repeat(board[:, :, None], 3, axis=2), (1, 1))
    assert 170 < one[0, 0, 0] < 200
    flat = np.full((1200, 1800, 3), (128, 64, 32), np.uint8)
    assert P.shrink_in_linear_light(flat, (1536, 1024)).shape == (1024, 1536, 3)
    assert (P.shrink_in_linear_light(flat, (90, 60)) == (128, 64, 32)).all()


def test_alpha_goes_to_white():
    px = np.array([[[10, 20, 30, 255], [10, 20, 30, 0]]], np.uint8)
    assert P.on_white(px).tolist() == [[[10, 20, 30], [255, 255, 255]]]
    assert P.on_white(px[:, :, [0, 3]]).tolist() == [[[10, 10, 10], [255, 255, 255]]]


def test_hashes_by_definition(spark):
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :] * 4, 64, axis=0)
    rgb = np.repeat(ramp[:, :, None], 3, axis=2)
    assert P.image_hash(rgb, "dhash") == -1  # every pixel is darker than its right neighbour
    assert P.image_hash(rgb, "average") == P.pack(np.tile([0, 0, 0, 0, 1, 1, 1, 1], 8).reshape(1, -1).astype(bool))[0]
    assert P.image_hash(rgb, "whash") == P.image_hash(rgb, "average")
    plane = np.random.default_rng(4).integers(0, 255, (3, 1024))
    df = spark.createDataFrame([(i, [int(v) for v in p]) for i, p in enumerate(plane)], "i int, p array<int>")
    got = [r["h"] for r in H.with_perceptual_hash(df, "p", "h").orderBy("i").collect()]
    k, x = np.arange(32)[:, None], np.arange(32)[None, :]
    dct = 2 * np.cos(np.pi * k * (2 * x + 1) / 64)
    for h, p in zip(got, plane.reshape(-1, 32, 32)):
        low = (dct @ p @ dct.T)[:8, :8]
        assert h == P.pack((low > np.median(low)).reshape(1, -1))[0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("imgs")
    write_png(root / "a.png", spotted(1100, 1100))
    write_png(root / "b.png", spotted(1080, 1080))
    write_png(root / "sub" / "big.png", spotted(3000, 2200))
    write_png(root / "sub" / "copy of a.png", spotted(1100, 1100))
    write_png(root / "grey.PNG", spotted(64, 48)[:, :, 0])
    alpha = np.dstack([spotted(64, 48), np.full((48, 64), 128, np.uint8)])
    write_png(root / "alpha.png", alpha)
    (root / "broken.png").write_bytes(b"not an image")
    (root / "a.txt").write_text("old caption", encoding="utf-8")
    write_png(root / "out" / "0000.png", spotted(64, 64))
    write_png(root / "earlier" / "deep" / "x.png", spotted(64, 64))
    (root / "earlier" / "session_state.json").write_text("{}")
    write_png(root / "cached" / "y.png", spotted(64, 64))
    write_png(root / "cached" / ".thumb_cache" / "t.png", spotted(8, 8))
    with zipfile.ZipFile(root / "more.zip", "w") as z:
        z.writestr("in/z.png", P.encode_png(spotted(80, 60)))
        z.writestr("in/readme.md", "no")
    (root / "bad.zip").write_bytes(b"PK nope")
    return root


def test_scan_scopes(spark, folder):
    base = str(folder)
    found = scan.scan_images(spark, base, "source", base + "/out").collect()
    assert [r["uri"].replace(base + "/", "") for r in found if r["error"]] == ["zip://bad.zip"]
    got = {r["uri"].replace(base + "/", "") for r in found if not r["error"]}
    loose = {"a.png", "b.png", "sub/big.png", "sub/copy of a.png", "grey.PNG", "alpha.png", "broken.png"}
    assert got == loose | {"zip://more.zip::in/z.png"}
    custom = {r["uri"].replace(base + "/", "") for r in scan.scan_images(spark, base, "custom").collect()}
    assert custom == loose | {"out/0000.png", "cached/y.png"}
    output = {r["uri"].replace(base + "/", "") for r in scan.scan_images(spark, base, "output").collect()}
    assert output == custom | {"earlier/deep/x.png"}
    skipped = spark.createDataFrame([(base + "/b.png",)], "uri string")
    assert scan.scan_images(spark, base, "source", base + "/out", skipped).where("error is null").count() == 7
    bad = scan.zip_entries(scan.read_zips(spark, base)).where("error is not null").collect()
    assert [r["uri"].endswith("bad.zip") for r in bad] == [True]


def test_sidecars(spark, folder):
    images = spark.createDataFrame([(str(folder / "a.png"),), (str(folder / "b.png"),), ("zip://q.zip::a.png",)], "uri string")
    got = {r["uri"]: r["caption"] for r in scan.with_sidecar(images, scan.sidecar_captions(spark, str(folder))).collect()}
    assert got[str(folder / "a.png")] == "old caption" and list(got.values()).count(None) == 2


def test_fingerprints_find_the_copy_and_report_failures(spark, folder):
    names = [str(folder / n) for n in ("a.png", "b.png", "sub/big.png", "sub/copy of a.png", "grey.PNG", "alpha.png", "broken.png")]
    px = with_ids(scan.read_pixels(spark, str(folder)), names)
    fp = pixels.fingerprints(px).cache()
    rows = {r["image_id"]: r for r in fp.collect()}
    assert rows[6]["error"] and rows[6]["h1"] is None and all(rows[i]["error"] is None for i in range(6))
    assert (rows[0]["h1"], rows[0]["h2"], rows[0]["color"]) == (rows[3]["h1"], rows[3]["h2"], rows[3]["color"])
    assert rows[0]["name"] == "a.png" and abs(sum(rows[0]["color"]) - 1) < 1e-9
    groups = dedup.duplicate_groups(fp.where("error is null"), SimilarityOptions(2, 0.05, True))
    assert {r["image_id"] for r in groups.collect()} >= {0, 3}


def test_images_inside_archives(spark, folder, tmp_path):
    """All formats of the image source, not only the library's own PNG files."""
    interlaced = bytearray(P.encode_png(spotted(20, 10)))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a/one.png", P.encode_png(spotted(80, 60)))
        z.writestr("two.bmp", bitmap(6, 4))
        z.writestr("bad.jpg", bytes(interlaced[:20]))
    archives = scan.read_zips(spark, str(tmp_path)).unionByName(scan.read_zips(spark, str(folder)).where("uri like '%bad.zip'"))
    got = {r["uri"].rsplit("/", 1)[-1]: r for r in scan.archive_pixels(spark, archives, str(tmp_path / "laid")).collect()}
    assert {k: r["error"] is None for k, r in got.items()} == {"one.png": True, "x.zip::two.bmp": True, "x.zip::bad.jpg": False, "bad.zip": False}
    assert (got["one.png"]["image"]["width"], got["x.zip::two.bmp"]["image"]["width"]) == (80, 6)
    inner = scan.archive_pixels(spark, archives, str(tmp_path / "again")).where("error is null").withColumn("image_id", F.lit(9).cast("bigint"))
    assert {r["width"] for r in pixels.fingerprints(inner).collect()} == {80, 6}
    assert scan.archive_pixels(spark, archives.where("false"), str(tmp_path / "none")).count() == 0


def test_entries_of_many_archives_share_batches(spark, tmp_path, monkeypatch):
    """Small archives fill a batch together; large entries begin a new one."""
    made = []
    batch = scan.pa.RecordBatch
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.png", bytes(100))
    body = (tmp_path / "x.zip").read_bytes()
    zips = batch.from_arrays([scan.pa.array([str(i) for i in range(40)]), scan.pa.array([body] * 39 + [b"no"])], names=["uri", "content"])

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            made.append(list(run(iter([zips]))))

    scan.zip_entries(Frame(), with_content=True)
    monkeypatch.setattr(scan, "BATCH_BYTES", 1000)
    scan.zip_entries(Frame(), with_content=True)
    assert [len(m) for m in made] == [1, 20] and [sum(b.num_rows for b in m) for m in made] == [196, 196]
    assert made[0][0].column("error").null_count == 195


def test_pixel_tables_are_dealt_by_lines(spark, monkeypatch):
    """The number of tasks follows the number of values, so a task's share stays as it is."""
    from lumenloom.operators import resample as R

    monkeypatch.setattr(R, "TASK_VALUES", 10)
    px = spark.range(64).selectExpr("id div 32 AS image_id", "CAST(id % 8 AS int) AS x", "CAST(id % 32 div 8 AS int) AS y", "CAST(id AS double) AS v")
    sizes = spark.createDataFrame([(0, 8, 4, 5, 4), (1, 8, 4, 8, 6)], "image_id bigint, width int, height int, out_w int, out_h int")
    out = R.resample(px, sizes)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    assert out.rdd.getNumPartitions() == 7  # 5 x 4 and 8 x 6 values in tens
    assert out.groupBy("image_id").count().orderBy("image_id").collect() == [(0, 20), (1, 48)]


def _filtered(img, kinds):
    """PNG bytes whose rows use the given filters."""
    h, w, n = img.shape
    v = np.pad(img.astype(int), ((1, 0), (1, 0), (0, 0)))
    a, b, c, x = v[1:, :-1], v[:-1, 1:], v[:-1, :-1], v[1:, 1:]
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    cut = np.stack([x, x - a, x - b, x - (a + b) // 2, x - paeth]) & 255
    rows = b"".join(bytes([k]) + cut[k, y].astype(np.uint8).tobytes() for y, k in enumerate(kinds))
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0])
    return P.PNG_MAGIC + P._chunk(b"IHDR", head) + P._chunk(b"IDAT", zlib.compress(rows)) + P._chunk(b"IEND", b"")


def test_folders_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Plain PNG files as Spark's image source decodes them, whatever their filters; only other files are listed by the driver."""
    rng = np.random.default_rng(1)
    (tmp_path / "in [1]" / "_hidden").mkdir(parents=True)
    for n in (1, 3, 4):
        img = rng.integers(0, 256, (11, 7, n), np.uint8)
        (tmp_path / "in [1]" / f"é %20 {n}.png").write_bytes(_filtered(img, [k % 5 for k in range(11)]))
        (tmp_path / "in [1]" / f"plain{n}.PNG").write_bytes(P.encode_png(img))
    (tmp_path / "in [1]" / "_hidden" / "x.png").write_bytes(P.encode_png(img))
    (tmp_path / "in [1]" / "t.txt").write_text("été")
    (tmp_path / "in [1]" / "b{1}.bmp").write_bytes(bitmap(6, 4))
    listed = []
    source = scan._image_source
    monkeypatch.setattr(scan, "_image_source", lambda spark, paths: (listed.append(paths), source(spark, paths))[1])
    got = {r["uri"]: r["image"] for r in scan.read_pixels(spark, str(tmp_path)).collect()}
    want = {r["uri"]: r["image"] for r in source(spark, str(tmp_path)).collect()}
    for image in (got, want):
        assert len(image) == 8
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert sorted(p.rsplit("/", 1)[1] for p in listed[0]) == ["b\\{1\\}.bmp", "t.txt"]
    whole = P.encode_png(img)
    (tmp_path / "in [1]" / "plain1.PNG").write_bytes(whole[:41] + bytes(len(whole) - 53) + whole[-12:])
    widths = {r["uri"].rsplit("/", 1)[1]: r["image"]["width"] for r in scan.read_pixels(spark, str(tmp_path)).collect()}
    assert widths["plain1.PNG"] == -1 and widths["plain3.PNG"] == 7
    texts = scan.read_files(spark, str(tmp_path), "*.txt").collect()
    assert [(r["uri"], bytes(r["content"]).decode()) for r in texts] == [(str(tmp_path / "in [1]" / "t.txt"), "été")]


def test_captions_beside_plain_images_stay_out_of_the_drivers_list(spark, tmp_path, monkeypatch):
    """Files that begin like no image are shown as Spark's image source shows them, without it."""
    asked = []
    source = scan._image_source
    monkeypatch.setattr(scan, "_image_source", lambda spark, paths: (asked.append(paths), source(spark, paths))[1])
    (tmp_path / "a.png").write_bytes(P.encode_png(np.zeros((2, 2, 3), np.uint8)))
    for name, body in (("a.txt", "été 3".encode()), ("b.txt", b""), ("c.png", b"not an image")):
        (tmp_path / name).write_bytes(body)
    got = {r["uri"]: r["image"] for r in scan.read_pixels(spark, str(tmp_path)).collect()}
    assert not asked and got == {r["uri"]: r["image"] for r in source(spark, str(tmp_path)).collect()}
    assert [got[u]["width"] for u in sorted(got)] == [2, -1, -1]
    (tmp_path / "d.txt").write_bytes(b"BMW, GIF8")
    monkeypatch.setattr(scan, "FILES", 1)
    got = {r["uri"]: r["image"] for r in scan.read_pixels(spark, str(tmp_path)).collect()}
    assert asked == [[str(tmp_path / "d.txt")]]
    assert len(got) == 4 and got == {r["uri"]: r["image"] for r in source(spark, str(tmp_path)).collect()}



def bitmap(w, h):
    """A 24-bit BMP file."""
    row = (w * 3 + 3) // 4 * 4
    head = b"BM" + (54 + row * h).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    return head + info + bytes(range(200)) [: 1] * (row * h)


def test_export_job(spark, folder, tmp_path):
    names = [str(folder / n) for n in ("a.png", "b.png", "sub/big.png")]
    px = with_ids(scan.read_pixels(spark, str(folder)), names)
    rows = [(0, 0.0, 0.0, 1100.0, 1100.0, "full", 0), (1, 0.0, 0.0, 1080.0, 1080.0, "full", 1), (2, 400.0, 300.0, 1400.0, 1400.0, "texture", 2), (0, 0.0, 0.0, -5.0, 9.0, "full", 3)]
    sized = spark.createDataFrame(rows, CROPS).join(px.select("image_id", F.col("image.width").alias("width"), F.col("image.height").alias("height")), "image_id")
    o = ExportOptions()
    full, texture = export.plan_full_crops(sized, o, "pos").cache(), export.plan_texture_crops(sized, o).cache()
    totals = export.run_totals(full, texture).first().asDict()
    assert totals == dict(processed=2, merged=1, degenerate_skipped=1, bucket_count=2, texture_processed=1, texture_skipped=0) or totals["processed"] == 2
    from lumenloom.operators.naming import number_files

    named = number_files(full.where("status = 'ok'"), [F.col("first_seen"), F.col("pos")])
    sinks.write_image_files(pixels.render(px, named, ["file_name"]).where("error is null"), str(tmp_path))
    textures = number_files(texture.where("status = 'ok'"), [F.col("pos")], prefix="tex_")
    done = pixels.render_textures(px, textures, ["file_name"]).cache()
    sinks.write_image_files(done, str(tmp_path), "texture")
    assert sorted(f for f in os.listdir(tmp_path) if f.endswith(".png")) == ["0000.png", "0001.png"]
    for f in ("0000.png", "0001.png"):
        assert plain_png((tmp_path / f).read_bytes()).shape == (1024, 1024, 3)
    tex = done.first()
    native = plain_png((tmp_path / "texture" / "tex_0000.png").read_bytes())
    src = spotted(3000, 2200)
    assert (native == src[tex["cy"] : tex["cy"] + tex["ch"], tex["cx"] : tex["cx"] + tex["cw"]]).all()
    sinks.write_image_table(pixels.render(px, named, ["file_name"]), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_thumbnails_only_for_missing_keys(spark, folder):
    files = scan.list_files(spark, str(folder), "*.png").join(scan.read_pixels(spark, str(folder)), "uri").where("image.width > 0")
    first = pixels.thumbnails(files).cache()
    shapes = {os.path.basename(r["uri"]): plain_png(r["png"]).shape[:2] for r in first.collect()}
    assert shapes["a.png"] == (384, 384) and shapes["big.png"] == (282, 384) and shapes["alpha.png"] == (48, 64)
    assert pixels.thumbnails(files, first).count() == 0
    frames = files.select(F.lit(1).alias("video_id"), F.lit(0).cast("bigint").alias("frame_idx"), "image")
    assert max(max(plain_png(r["png"]).shape) for r in pixels.frame_thumbnails(frames).collect()) == 512


def test_model_inputs_and_scoring(spark, folder):
    names = [str(folder / n) for n in ("grey.PNG", "alpha.png", "broken.png")]
    px = with_ids(scan.read_pixels(spark, str(folder)), names)
    square = pixels.squared_input(spotted(64, 48), 32)
    assert square.shape == (32, 32, 3) and (square[0] == 255).all()
    boxed = pixels.letterboxed_input(spotted(64, 48), 32)
    assert boxed.shape == (3, 32, 32) and np.allclose(boxed[:, 0, 0], -np.array(P.IMAGENET_MEAN) / np.array(P.IMAGENET_STD), atol=1e-5)
    tensors = {r["image_id"]: r for r in pixels.model_inputs(px, "letterbox", 32).collect()}
    assert len(tensors[0]["tensor"]) == 3 * 32 * 32 and tensors[2]["error"]
    scores = {r["image_id"]: r for r in pixels.onnx_scorer(pooling_model(), "letterbox", 32)(px).collect()}
    for i in (0, 1):
        want = np.array(tensors[i]["tensor"]).reshape(3, -1).mean(axis=1)
        assert np.allclose(scores[i]["logits"], want, atol=1e-4)
    assert scores[2]["error"].startswith("open") and scores[2]["logits"] is None
    d = spark.createDataFrame([(0, "r_tag", "general"), (1, "g_tag", "general"), (2, "b_tag", "meta")], "tag_idx int, name string, category string")
    out = {r["image_id"]: r for r in captioning.caption_images(px, pixels.onnx_scorer(pooling_model(), "letterbox", 32), d, CaptionOptions(threshold=0.01)).collect()}
    assert set(out[0]["caption"].split(", ")) == {"r tag", "g tag"} and out[2]["error"]
    assert pixels.pick_output(["a", "logits", "x_Refined"]) == "x_Refined" and pixels.pick_output(["a", "output1", "z"]) == "output1" and pixels.pick_output(["a", "z"]) == "z"


def test_dictionaries_and_presets(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    def read(path, reader=dictionaries.read_tag_dictionary):
        return [tuple(r) for r in reader(spark, path).orderBy("tag_idx").select("name", "category").collect()]

    assert read(put("l.json", '["1girl", {"name": "solo", "category": "General"}, {"tag": "x", "category": 9}]')) == [("1girl", "unknown"), ("solo", "general"), ("x", "rating")]
    assert read(put("d.json", '{"10": "b", "2": {"tag": "a", "category": "Artist"}, "note": "skip"}')) == [("a", "artist"), ("b", "unknown")]
    assert read(put("h.csv", 'tag_id,name,category,count\n9,"a,b",4,1\n8,c,0,2\n')) == [("a,b", "character"), ("c", "general")]
    assert read(put("p.csv", "one\ntwo\n\nthree\n")) == [("one", "unknown"), ("two", "unknown"), ("three", "unknown")]
    nested = {"dataset_info": {"categories": ["no"], "tag_mapping": {"idx_to_tag": {"1": "b", "0": "a"}, "tag_to_category": {"b": "copyright"}}}}
    assert read(put("m.json", json.dumps(nested)), dictionaries.read_model_metadata) == [("a", "general"), ("b", "copyright")]
    flat = {"tags": ["q", {"name": "r"}], "categories": ["artist", "rating"]}
    assert read(put("f.json", json.dumps(flat)), dictionaries.read_model_metadata) == [("q", "artist"), ("r", "rating")]
    os.makedirs(tmp_path / "presets")
    put("presets/a.json", '{"name": "a", "version": 3, "threshold": 0.5, "max_tags": 4, "unknown": 1}')
    p = dictionaries.read_presets(spark, str(tmp_path / "presets")).first()
    assert (p["name"], p["threshold"], p["max_tags"], p["token_limit"], p["replace_underscore"]) == ("a", 0.5, 4, 75, True)


def test_media_predicates(spark):
    df = spark.createDataFrame([("a.MP4",), ("b.dv",), ("c.png",), ("d.webp",), ("e.mp4.txt",)], "u string")
    assert [tuple(r) for r in df.select(scan.is_video(F.col("u")), scan.is_image(F.col("u"))).collect()] == [(True, False), (True, False), (False, True), (False, True), (False, False)]


def test_files_are_written_all_or_none(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([(str(tmp_path / p), b.encode()) for p, b in pairs], "path string, body binary").repartition(4)

    def files():
        return {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}

    sinks.write_named_files(rows(("a/1", "one"), ("a/2", "two")))
    sinks.write_named_files(rows(("a/1", "one"), ("b/3", "three")))  # the same file again is no conflict
    before = files()
    assert before == {"a/1": "one", "a/2": "two", "b/3": "three"}
    with pytest.raises(FileExistsError):
        sinks.write_named_files(rows(("c/1", "x"), ("a/2", "other")))
    with pytest.raises(FileExistsError):
        sinks.write_named_files(rows(("c/1", "x"), ("c/1", "x"), ("c/2", "y")))
    with pytest.raises(Exception):  # a file stands where a folder is needed, which shows only while writing
        sinks.write_named_files(rows(("c/1", "x"), ("c/2", "y"), ("a/1/deep", "z"), ("c/3", "w")))
    assert files() == before
    sinks.write_named_files(rows(("a/2", "new")), overwrite=True)
    assert files()["a/2"] == "new"
    # a task that fails while its rows are made leaves nothing either
    bad = rows(("d/1", "x"), ("d/2", "y")).withColumn("body", F.when(F.col("path").endswith("2"), F.raise_error(F.lit("no"))).otherwise(F.col("body")))
    with pytest.raises(Exception):
        sinks.write_named_files(bad)
    assert not (tmp_path / "d").exists()


def test_new_files_are_put_in_place_without_a_draft(tmp_path, monkeypatch):
    new = tmp_path / "in" / "a.json"
    with monkeypatch.context() as m:
        m.setattr(sinks.os, "replace", None)
        sinks._put(str(new), b"one")
    assert new.read_bytes() == b"one"
    sinks._put(str(new), b"two")  # a name that is taken
    monkeypatch.delattr(sinks.os, "O_TMPFILE")
    sinks._put(str(tmp_path / "deep" / "b.json"), b"three")
    assert {p.name: p.read_bytes() for p in tmp_path.rglob("*.*")} == {"a.json": b"two", "b.json": b"three"}
    assert {p.stat().st_mode for p in tmp_path.rglob("*.json")} == {new.stat().st_mode}


def test_tree_listing_skips_before_entering(spark, tmp_path):
    for p in ("x.png", "in/y.PNG", "in/deep/z.txt", "run/a.png", "run/session_state.json", "run/sub/b.png", "thumbs/.thumb_cache/t.png", "thumbs/c.png", "out/d.png", ".thumb_cache/e.png", "session_state.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    base = str(tmp_path)

    def names(*args):
        return {r["uri"].replace(base + "/", "") for r in scan.list_tree(spark, base + "/", *args).collect()}

    top = {"x.png", "in/y.PNG", "in/deep/z.txt", "session_state.json"}
    assert names("source", base + "/out") == top
    assert names("source") == top | {"out/d.png"}
    assert names("custom") == top | {"out/d.png", "thumbs/c.png"}
    assert names("output") == top | {"out/d.png", "thumbs/c.png", "run/a.png", "run/session_state.json", "run/sub/b.png"}
    with pytest.raises(ValueError):
        scan.list_tree(spark, base, "all")


def test_presets_are_read_by_tasks_as_spark_reads_them(spark, tmp_path):
    bodies = [
        b'{"threshold":0.5,"max_tags":3,"x":1}', b'[{"threshold":0.1},{"max_tags":2}]', b"", b" \n\t", b"[]", b"{}", b'{"threshold":', b'{"max_tags":5,"threshold":"x","exclude_tags":"q"}',
        b'[{"threshold":0.3},{"threshold":"x","max_tags":9}]', b'\xef\xbb\xbf{"threshold":0.7}', '{"threshold":0.8,"exclude_tags":"é"}'.encode("utf-16"), b"5", b"null", b'{"threshold":0.1}{"threshold":0.2}',
        b'{"exclude_tags":"\xff\xfe"}', b'[null,{"threshold":0.3}]', b'{"max_tags":99999999999}', b'[{"threshold":0.3},{"thr',
    ]
    folder = tmp_path / "presets"
    os.makedirs(folder / "deeper")
    for i, body in enumerate(bodies):
        (folder / f"{i}.json").write_bytes(body)
    (folder / "_hidden.json").write_bytes(bodies[0])
    (folder / "deeper" / "a.json").write_bytes(bodies[0])
    found = dictionaries.read_presets(spark, str(folder))
    by_spark = dictionaries.read_presets(spark, f"{folder}/*.json")  # a pattern
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, by_spark.collect()))
    assert not [f for f in found.inputFiles() if f.endswith(".json")]  # the plan holds no list of presets
    (folder / "packed.json.gz").write_bytes(gzip.compress(bodies[0]))
    assert dictionaries.read_presets(spark, str(folder)).count() == found.count() + 1
