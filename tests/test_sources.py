import io
import tarfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenekiln.cli import main, parser
from scenekiln.config import Settings
from scenekiln.functions import contours, pixels
from scenekiln.functions import geometry as g
from scenekiln.functions.hull import hull_by
from scenekiln.operators import cards
from scenekiln.operators import members as m
from scenekiln.plans import pipelines as p
from scenekiln.sources import files, png
from scenekiln.sources import shards as s


def image(seed, h, w, c):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


@pytest.fixture(scope="module")
def deck(tmp_path_factory):
    root = tmp_path_factory.mktemp("deck")
    for i in range(5):
        (root / "textures/sub").mkdir(parents=True, exist_ok=True)
        (root / f"textures/{'sub/' if i % 2 else ''}{i}.png").write_bytes(png.encode_png(image(i, 64, 64, 3)))
    (root / "textures/2b.png").write_bytes(b"no image")
    for name, n in (("Ah", 3), ("7s", 2)):
        for i in range(n):
            (root / f"cards/{name}").mkdir(parents=True, exist_ok=True)
            card = image(10 + i, g.CARD_HEIGHT, g.CARD_WIDTH, 4)
            card[:, :, 3] = 255
            (root / f"cards/{name}/{i}.png").write_bytes(png.encode_png(card))
    (root / "cards/Ah/small.png").write_bytes(png.encode_png(image(0, 10, 10, 4)))
    (root / "cards/loose.png").write_bytes(png.encode_png(image(0, 10, 10, 4)))
    return root


def test_png_and_npy():
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        own = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode_png(png.encode_png(own)) == own).all()
    raw = np.array([[k, *range(40, 52)] for k in (0, 1, 2, 3, 4)], np.uint8)
    by_pixel = png._unfiltered(raw, 3).astype(int)
    assert by_pixel[1, 3] == (40 + 43) % 256 and by_pixel[2, 0] == (by_pixel[1, 0] + 40) % 256 and by_pixel[3, 0] == (40 + by_pixel[2, 0] // 2) % 256
    for bad in (b"", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            png.decode_png(bad)
    with pytest.raises(ValueError):
        png.encode_png(np.zeros((2, 2, 2), np.uint8))
    for kind in (np.int32, np.int64):
        assert png.decode_npy(png.encode_npy(np.array([[1, 2]], kind))).dtype == np.int64


def written(kind, depth, width, height, interlaced, seed):
    """A PNG of random samples, by the format's own words, with filters that change from row to row."""
    rng, n = np.random.default_rng(seed), png._CHANNELS[kind]
    data = b""
    for x, y, dx, dy in png._PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x) // dx) if width > x else 0, -(-(height - y) // dy) if height > y else 0
        for row in range(h if w else 0):
            data += bytes([row % 5]) + rng.integers(0, 256, (w * n * depth + 7) // 8, dtype=np.uint8).tobytes()
    palette = png._chunk(b"PLTE", rng.integers(0, 256, 3 << depth, dtype=np.uint8).tobytes()) if kind == 3 else b""
    head = png.struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, int(interlaced))
    return png._MAGIC + png._chunk(b"IHDR", head) + palette + png._chunk(b"IDAT", png.zlib.compress(data)) + png._chunk(b"IEND", b"")


def test_every_kind_of_png_against_the_jvm(spark):
    """Read as the JVM's own decoder reads it: blue, green, red and alpha of every pixel."""
    jvm, seen = spark.sparkContext._jvm, 0
    for kind, depths in png._DEPTHS.items():
        for depth in depths:
            for interlaced, (width, height) in ((False, (13, 6)), (True, (13, 6)), (True, (1, 1)), (True, (3, 9))):
                data = written(kind, depth, width, height, interlaced, kind * 100 + depth)
                own = png.decode_png(data)
                image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
                raster, model = image.getRaster(), image.getColorModel()
                for y in range(height):
                    for x in range(width):
                        if kind in (0, 4):  # gray is read as it is stored: getRGB would turn it by a gamma
                            want = raster.getSample(x, y, 0) * 255 // ((1 << depth) - 1) if depth < 8 else raster.getSample(x, y, 0) >> (depth - 8)
                            assert own[y, x].tolist() == (want if kind == 0 else [want] * 3 + [raster.getSample(x, y, 1) >> (depth - 8)])
                        elif depth == 16:
                            some = [raster.getSample(x, y, c) >> 8 for c in range(4 if kind == 6 else 3)]
                            assert own[y, x].tolist() == some[2::-1] + some[3:]
                        else:
                            rgb = image.getRGB(x, y) & 0xFFFFFFFF
                            assert own[y, x].tolist() == [rgb & 255, rgb >> 8 & 255, rgb >> 16 & 255, rgb >> 24][: own.shape[2]], (kind, depth, model)
                        seen += 1
    assert seen > 2000
    for broken in (written(0, 8, 5, 5, False, 1)[:-30], written(0, 3, 5, 5, False, 1), written(3, 16, 5, 5, False, 1)):
        with pytest.raises(ValueError):
            png.decode_png(broken)


def test_backgrounds_keep_gaps(spark, deck, tmp_path):
    out = str(tmp_path / "shards")
    assert p.pack_backgrounds(spark, str(deck / "textures"), out, shard_size=2) == 3
    members = s.read_members(spark, out).collect()
    assert sorted(r.key for r in members) == ["00000000", "00000001", "00000003", "00000004", "00000005"]  # 2b.png leaves a gap
    assert {r.shard.rpartition("/")[2] for r in members} == {f"backgrounds-000{i}.tar" for i in range(3)}
    grounds = p.load_backgrounds(spark, out).orderBy("background").collect()
    assert [r.background for r in grounds] == list(range(5))
    got = {png.decode_png(r.payload).tobytes() for r in grounds}
    assert got == {image(i, 64, 64, 3).tobytes() for i in range(5)}
    assert p.pack_backgrounds(spark, str(deck / "textures"), out, shard_size=9) == 1  # stale shards are gone
    assert p.load_backgrounds(spark, out).count() == 5


def test_members_of_odd_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w:gz") as tar:
        for name, data in (("a.cls", b" Ah\n"), ("a.png", b"1"), ("a.png", b"2"), ("dir/b.hull.npy", b"3"), ("nodot", b"4"), ("a.png", b"5"), ("a.cls", b"Kd")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = s.read_members(spark, str(tmp_path))
    assert [(r.key, r.ext) for r in df.orderBy("ord").collect()] == [("a", "cls"), ("a", "png"), ("a", "png"), ("dir/b", "hull.npy"), ("a", "png"), ("a", "cls")]
    runs = m.runs(df, ["shard"], ["ord"])
    assert [(r.run, bytes(r.png or b"")) for r in m.samples(runs, ["png"], ["run"]).orderBy("run").collect()] == [(0, b"2"), (1, b""), (2, b"5")]
    assert [bytes(r.payload) for r in m.first_images(runs, ["shard", "run"]).orderBy("run").collect()] == [b"1", b"5"]
    assert [(r.name, r.key) for r in m.class_index(df).collect()] == [("Kd", "a")]
    assert s.read_members(spark, str(tmp_path), ["cls"], payload=False).filter("payload IS NULL").count() == 2


def test_cards_and_scenes(spark, deck, tmp_path):
    shards, grounds, out = (str(tmp_path / x) for x in ("cards", "grounds", "scenes"))
    assert p.pack_cards(spark, str(deck / "cards"), shards, shard_size=2, extract_hulls=False) == 3
    p.pack_backgrounds(spark, str(deck / "textures"), grounds)
    index = p.load_cards(spark, shards)
    assert {r.name: r["count"] for r in index.groupBy("name").count().collect()} == {"Ah": 3, "7s": 2}
    assert sorted(r.key for r in index.collect()) == [f"{i:08d}" for i in range(5)]
    loaded = m.load_samples(index, s.read_members(spark, shards), ["png", "hull_hl.npy"]).collect()
    assert all(png.decode_png(r.png).shape == (348, 228, 4) and png.decode_npy(r["hull_hl.npy"]).shape == (4, 1, 2) for r in loaded)
    with pytest.raises(KeyError):
        p.random_sample(index, 0, "ZZ")
    assert p.random_sample(index, 0, "7s").first().name == "7s"
    labels = p.generate(spark, grounds, shards, out, count=3, n_cards=3, canvas=256, seed=1)
    assert labels.count() > 0 and labels.filter("box.xmin < 0 OR box.xmax > 256 OR yolo.w <= 0").count() == 0
    files = sorted(f.name for f in (tmp_path / "scenes").iterdir())
    assert files == ["classes.txt", *sorted(f"scene_00000{i}.{e}" for i in range(3) for e in ("png", "txt"))]
    assert (tmp_path / "scenes/classes.txt").read_text() == "7s\nAh\n"
    assert png.decode_png((tmp_path / "scenes/scene_000000.png").read_bytes()).shape == (256, 256, 3)
    lines = "".join((tmp_path / f"scenes/scene_00000{i}.txt").read_text() for i in range(3)).splitlines()
    assert len(lines) == labels.count() and all(len(x.split()) == 5 for x in lines)
    again = p.generate(spark, grounds, shards, str(tmp_path / "again"), count=3, n_cards=3, canvas=256, seed=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, labels.collect()))
    assert (tmp_path / "again/scene_000002.png").read_bytes() == (tmp_path / "scenes/scene_000002.png").read_bytes()
    (tmp_path / "none").mkdir()
    with tarfile.open(tmp_path / "none/e.tar", "w"):
        pass
    for load in (p.load_cards, p.load_backgrounds):
        with pytest.raises(ValueError):
            load(spark, str(tmp_path / "none"))


def frame():
    out = np.full((240, 320, 3), (20, 60, 20), np.uint8)
    out[58:182, 78:242] = 0
    out[60:180, 80:240] = 240
    return out


IMAGE = "image struct<height:int,width:int,nChannels:int,data:binary>"


def imaged(spark, *arrays):
    rows = [(str(i), None if a is None else {"height": a.shape[0], "width": a.shape[1], "nChannels": a.shape[2], "data": bytearray(np.ascontiguousarray(a).tobytes())}) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"path string, {IMAGE}")


def test_extraction(spark):
    turned = np.ascontiguousarray(np.rot90(frame()))
    df = imaged(spark, frame(), np.full((50, 50, 3), 9, np.uint8), None, turned)
    got = {r.path: r for r in p.extract_cards(df, min_focus=10).collect()}
    assert sorted(got) == ["0", "3"]
    for r in got.values():
        card = png.decode_png(r.png)
        assert card.shape == (348, 228, 4) and 0.95 <= r.rectangularity <= 1 and r.focus > 10
        assert (card[100:250, 60:160, :3] > 200).all() and (card[100:250, 60:160, 3] == 255).all() and card[0, 0, 3] == 0
    assert p.extract_cards(df, min_focus=1e9).count() == 0 and p.extract_cards(df.filter("path = '1'"), min_focus=0).count() == 0
    with pytest.raises(Exception, match="BGR"):
        p.extract_cards(imaged(spark, np.zeros((5, 5, 1), np.uint8))).collect()


def test_corner_hulls(spark):
    blank = np.full((348, 228, 3), 255, np.uint8)
    card = blank.copy()
    card[30:70, 10:40] = 0  # a symbol of 30 x 40 in the zone
    small = blank.copy()
    small[45:60, 20:30] = 0  # too small to be a symbol
    aside = blank.copy()
    aside[12:22, 10:20] = 0  # off the zone's centre
    df = cards.with_corner_hull(imaged(spark, blank, card, small, aside), "hl")
    got = {r.path: r.hl for r in df.collect()}
    assert df.columns == ["path", "image", "hl"] and got["0"] is None and got["3"] is None and not got["2"].ok
    hull = np.array([(q.x, q.y) for q in got["1"].hull])
    assert got["1"].ok and 940 <= got["1"].area <= 2120 and hull[:, 0].min() >= 8 and hull[:, 1].max() <= 92
    assert cards.with_corner_hull(imaged(spark, card), "none", [(0, 0), (0, 0), (0, 0), (0, 0)]).first()["none"] is None
    assert not cards.with_corner_hull(imaged(spark, card), "hl", hull_area=(1.0, 2.0)).first().hl.ok


def test_hulls_as_an_aggregate(spark):
    """Of any number of rows, one group in most of them: the corners of all points, whatever the partitions."""
    rng = np.random.default_rng(7)
    rows = [(k, float(x), float(y)) for k, n in (("hot", 30_000), ("b", 5), ("c", 2), (None, 50)) for x, y in (rng.normal(size=(n, 2)) * 100).round(2)]
    rows += [("b", 0.0, 0.0)] * 20 + [("b", None, 1.0), ("b", float("nan"), 1.0), ("d", None, None)] + [("circle", float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 6.28, 500)]
    want = {}
    for key in {r[0] for r in rows} - {"d"}:
        own = sorted({r[1:] for r in rows if r[0] == key and r[1] is not None and r[1] == r[1]})
        chains = []
        for side in (own, own[::-1]):
            chain = []
            for q in side:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(q)
            chains += chain[:-1] if len(own) > 1 else chain
        want[key] = chains
    df = spark.createDataFrame(rows, "zone string, x double, y double")
    for parts in (1, 7):
        got = {r.zone: [(q.x, q.y) for q in r.hull] for r in hull_by(df.repartition(parts), ["zone"], F.col("x"), F.col("y")).collect()}
        assert got == want


def test_pixels():
    sharp = frame()
    blurred = contours.bilateral(pixels.to_gray(sharp), 11, 1000, 17)
    assert pixels.variance_of_laplacian(sharp) > pixels.variance_of_laplacian(blurred)
    with pytest.raises(ValueError):
        pixels.variance_of_laplacian(np.zeros(3))
    over = np.dstack([np.full((4, 4, 3), 200, np.uint8), np.full((4, 4), 51, np.uint8)])
    assert (pixels.alpha_composite(np.full((4, 4, 3), 100, np.uint8), over) == 120).all()
    assert pixels.resize(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2).tolist() == [[2, 4], [10, 12]]  # means, ties to even
    same = pixels.warp_affine(over, np.array([[1.0, 0, 0], [0, 1, 0]]), 4)
    assert (same == over).all()
    card = np.full((348, 228, 4), 255, np.uint8)
    assert pixels.placed_card(card, 10, 0.5, 0, 0, 512).shape == (512, 512, 4)
    with pytest.raises(ValueError):
        pixels.placed_card(card[:10], 0, 1, 0, 0, 512)
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    h = pixels.homography(square, [(1, 1), (9, 1), (9, 9), (1, 9)])
    assert np.allclose(h @ [2, 2, 1] / (h @ [2, 2, 1])[2], [5, 5, 1])


def test_names_config_and_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "n.txt").write_text("Ah\n 7s \n\nAh\n")
    assert {r.name for r in s.read_names(spark, str(tmp_path / "n.txt")).collect()} == {"Ah", "7s"}
    monkeypatch.setenv("SCENEKILN_SEED", "7")
    monkeypatch.setenv("SCENEKILN_UNKNOWN", "x")
    assert Settings.load().seed == 7
    with pytest.raises(ValueError):
        Settings(min_focus=-1)
    with pytest.raises(ValueError):
        Settings(cards_per_scene_max=4)
    assert main(["version"]) == 0 and main(["config-show"]) == 0 and '"seed": 7' in capsys.readouterr().out
    for bad in (["generate", "--backgrounds", "a", "--cards", "b", "--output", "c", "-n", "0"], ["pack-cards", "a", "b", "--shard-size", "0"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_cli_parameters(spark, tmp_path, monkeypatch, capsys):
    """What is given reaches the operators, and what is not keeps its default."""
    seen = []
    monkeypatch.setattr(p, "generate", lambda *a, **k: seen.append((a[1:], k)) or spark.range(3))
    monkeypatch.setattr(p, "pack_cards", lambda *a, **k: seen.append((a[1:], k)) or 2)
    assert main(["generate", "--backgrounds", "b", "--cards", "c", "--output", "o", "--seed", "5", "--rotation", "-5", "5", "--hidden", "0.5"]) == 0
    args, _ = seen.pop()
    assert args == ("b", "c", "o", 10, 2, 720, 5, p.sampling.AugmentRange(rotation_deg=(-5.0, 5.0)), 0.5, "sequence")
    assert main(["pack-cards", "in", "out", "--hull-area", "10", "20", "--min-solidity", "0.4"]) == 0
    assert seen.pop() == (("in", "out", 512), {"extract_hulls": True, "min_area": 30.0, "min_solidity": 0.4, "hull_area": (10.0, 20.0), "tolerance": (0.3, 0.4)})
    assert main(["pack-cards", "in", "out", "--no-hulls"]) == 0 and seen.pop()[1] == {"extract_hulls": False}
    for bad in (["--hidden", "2"], ["--scale", "0.8", "0.5"]):
        with pytest.raises(SystemExit):
            main(["generate", "--backgrounds", "b", "--cards", "c", "--output", "o", *bad])
    capsys.readouterr()


def jpeg_bytes(spark, tmp_path):
    """16 x 16 gray pixels, left half 40, right half 200, as the JVM's own encoder writes them."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(16, 16, 5)
    for y in range(16):
        for x in range(16):
            v = 40 if x < 8 else 200
            image.setRGB(x, y, v << 16 | v << 8 | v)
    path = tmp_path / "x.jpg"
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    return path.read_bytes()


def test_jpeg_members_and_webp(spark, tmp_path):
    data = jpeg_bytes(spark, tmp_path)
    (tmp_path / "g").mkdir()
    rows = [("0.jpg", data), ("1.png", png.encode_png(image(1, 8, 8, 3))), ("2.txt", b"-"), ("3.jpeg", data), ("3.png", png.encode_png(image(2, 8, 8, 3)))]
    with tarfile.open(tmp_path / "g/a.tar", "w") as tar:
        for name, payload in rows:
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
    got = [png.decode_png(r.payload) for r in p.load_backgrounds(spark, str(tmp_path / "g")).orderBy("background").collect()]
    assert [a.shape for a in got] == [(16, 16, 3), (8, 8, 3), (16, 16, 3)] and (got[1] == image(1, 8, 8, 3)).all()
    assert abs(got[0][:, :8].astype(int) - 40).max() < 12 and abs(got[2][:, 8:].astype(int) - 200).max() < 12
    one = p.background_sample(p.background_index(spark, str(tmp_path / "g")), 3, 32).collect()
    assert len(one) == 1 and png.decode_png(one[0].payload).shape == (32, 32, 3)
    for name, payload, said in (("9.webp", b"RIFF", "WebP"), ("9.jpg", b"no image", "does not decode")):
        with tarfile.open(tmp_path / "g/b.tar", "w") as tar:
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
        with pytest.raises(Exception, match=said):
            p.load_backgrounds(spark, str(tmp_path / "g")).collect()


def test_ranks_carry_no_images(spark, deck, tmp_path, monkeypatch):
    ranked, seen = p.ranking.ranked, []

    def watched(df, *args):
        seen.append(dict(df.dtypes))
        return ranked(df, *args)

    monkeypatch.setattr(p.ranking, "ranked", watched)
    p.pack_backgrounds(spark, str(deck / "textures"), str(tmp_path / "b"))
    p.pack_cards(spark, str(deck / "cards"), str(tmp_path / "c"), extract_hulls=False)
    p.load_backgrounds(spark, str(tmp_path / "b"))
    assert len(seen) == 3 and not any("binary" in kind or "struct" in kind for types in seen for kind in types.values())


def test_generation_parameters(spark, deck, tmp_path):
    shards, grounds = str(tmp_path / "cards"), str(tmp_path / "grounds")
    p.pack_cards(spark, str(deck / "cards"), shards, extract_hulls=False)
    p.pack_backgrounds(spark, str(deck / "textures"), grounds)
    still = p.sampling.AugmentRange((0.0, 0.0), (0.5, 0.5), (0.0, 0.0))  # the last card hides all others
    labels = p.generate(spark, grounds, shards, str(tmp_path / "a"), count=4, n_cards=2, canvas=512, aug=still)
    assert {r.z for r in labels.collect()} == {1}
    labels = p.generate(spark, grounds, shards, str(tmp_path / "b"), count=4, n_cards=2, canvas=512, aug=still, hidden=1.0)
    assert {r.z for r in labels.collect()} == {0, 1}
    for into in ("c", "d"):  # hashed draws, twice the same
        labels = p.generate(spark, grounds, shards, str(tmp_path / into), count=4, n_cards=3, canvas=256, draws="hashed")
    assert labels.count() and (tmp_path / "c/scene_000003.png").read_bytes() == (tmp_path / "d/scene_000003.png").read_bytes()
    with pytest.raises(ValueError):
        p.generate(spark, grounds, shards, str(tmp_path / "e"), draws="dice")


def test_session_guards(spark, monkeypatch):
    from scenekiln import session

    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    assert session.united(spark.range(2), spark.range(3)).count() == 5 and spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    assert session.shared_dir(unset("local[2]")) == session.shared_dir(unset("local[2]")) and session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", session.shared_dir(spark))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            session.shared_dir(unset(master))
    assert session.shared_path(spark, "x").startswith("file:///") and session.shared_path(spark, "x") != session.shared_path(spark, "x")
    monkeypatch.setattr(files, "is_local", lambda spark: False)
    with pytest.raises(ValueError):
        files.write_files(spark.sql("SELECT 'a' AS file, 'b' AS name, binary('c') AS payload"), "/tmp/x", [])
