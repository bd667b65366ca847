"""Shards by ranges, commits in two phases, runs in many tasks, pages of a class index, draws by hash, walked folders."""

import gzip
import io
import random
import shutil
import tarfile
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from scenekiln.operators import members as m
from scenekiln.operators import sampling
from scenekiln.plans import pipelines as p
from scenekiln.sources import files, png, tar
from scenekiln.sources import shards as s


def put(archive, name, data, kind=tarfile.REGTYPE):
    info = tarfile.TarInfo(name)
    info.size, info.type = len(data), kind
    archive.addfile(info, io.BytesIO(data))


def shard(path, rows, mode="w", **options):
    with tarfile.open(path, mode, **options) as archive:
        for name, data, *kind in rows:
            put(archive, name, data, *kind)
    return f"file://{path}"


def odd_members(rng, n=60):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as archive:  # a shard in a shard: its headers are no members
        for i in range(5):
            put(archive, f"in{i}.cls", b"no")
    rows = [(f"{i:04d}.{rng.choice(['cls', 'png', 'hull_hl.npy'])}", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000]))) for i in range(n)]
    rows += [("inner.tar", inner.getvalue()), ("d" * 120 + "/x.png", b"long"), ("ünï.cls", b"u"), ("folder.x", b"", tarfile.DIRTYPE), ("nodot", b"1")]
    rng.shuffle(rows)
    return rows


def read(uri, payload=True, **named):
    reader = tar.MembersReader({"path": uri, "payload": str(payload).lower(), **named})
    return [row for part in reader.partitions() for batch in reader.read(part) for row in zip(*(c.to_pylist() for c in batch.columns))]


def test_ranges_give_the_members_of_the_whole(tmp_path, monkeypatch):
    rng = random.Random(1)
    for form in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        rows = odd_members(rng)
        uri = shard(tmp_path / "x.tar", rows, format=form)
        want = [(name.partition(".")[0], name.partition(".")[2], data) for name, data, *kind in rows if not kind and "." in name]
        places = [i for i, (name, _, *kind) in enumerate(rows) if not kind and "." in name]
        for size in (1 << 30, 20_000, 3000, 600):
            monkeypatch.setattr(tar, "RANGE_BYTES", size)
            got = read(uri)
            assert [(r[2], r[3], r[6]) for r in got] == want and [r[1] for r in got] == places
            with tar.Ranged(uri) as file:
                assert all(file.range(r[4], r[5]) == r[6] for r in got)
        assert len(tar.MembersReader({"path": uri}).partitions()) > 5


def test_an_index_reads_headers(tmp_path):
    rng = random.Random(2)
    rows = [row for i in range(60) for row in ((f"{i:08d}.cls", b"Ah"), (f"{i:08d}.png", rng.randbytes(200_000)))]
    uri = shard(tmp_path / "a.tar", rows)
    with tar.Ranged(uri) as file:
        found = list(tar.members(file, uri, tar.Asked(frozenset(["cls"])), True))
        assert len(found) == 60 and {r[6] for r in found} == {b"Ah"}
        assert file.taken < 0.02 * (tmp_path / "a.tar").stat().st_size


def test_filters_are_pushed(spark, tmp_path):
    for name in "ab":
        shard(tmp_path / f"{name}.tar", [(f"{k}.{e}", f"{name}{k}{e}".encode()) for k in range(3) for e in ("cls", "png")])
    reader = tar.PushedReader({"path": f"file://{tmp_path}"})
    other = GreaterThan(("ord",), 1)
    assert list(reader.pushFilters([EqualTo(("ext",), "cls"), other, In(("key",), ("1", "2")), EqualTo(("shard",), f"file://{tmp_path}/b.tar"), EqualTo(("key",), "1")])) == [other]
    assert [(r[2], r[3]) for part in reader.partitions() for b in reader.read(part) for r in zip(*(c.to_pylist() for c in b.columns))] == [("1", "cls")] and len(reader.partitions()) == 1
    for push in ("true", "false"):
        spark.conf.set(s.PUSHED, push)
        df = s.read_members(spark, str(tmp_path)).filter("ext = 'png' AND key IN ('0', '2') AND shard LIKE '%b.tar'")
        assert {bytes(r.payload) for r in df.collect()} == {b"b0png", b"b2png"}
    spark.conf.set(s.PUSHED, "true")


def test_a_shard_larger_than_a_cell(spark, tmp_path):
    """Three gigabytes, most of them a hole: no cell and no worker could hold it."""
    path = tmp_path / "big" / "huge.tar"
    path.parent.mkdir()
    with path.open("wb") as out:
        for name, size, data in (("0.cls", 2, b"Ah"), ("0.png", 3 << 30, None), ("1.cls", 2, b"7s"), ("1.png", 5, b"image")):
            info = tarfile.TarInfo(name)
            info.size = size
            out.write(info.tobuf())
            if data is None:
                out.seek(size, 1)
            else:
                out.write(data + bytes(-size % 512))
        out.write(bytes(1024))
    index = s.member_index(spark, str(path.parent))
    assert [(r.key, r.ext, r["size"]) for r in index.orderBy("ord").collect()] == [("0", "cls", 2), ("0", "png", 3 << 30), ("1", "cls", 2), ("1", "png", 5)]
    assert {(r.name, r.key) for r in p.load_cards(spark, str(path.parent)).collect()} == {("Ah", "0"), ("7s", "1")}
    wanted = index.filter("key = '1'").select("shard", "key").distinct()
    assert [bytes(r.png) for r in s.load_samples(spark, str(path.parent), wanted, ["png"]).collect()] == [b"image"]


def test_samples_by_range_and_from_compressed_shards(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{i}.{e}", rng.randbytes(rng.randrange(3000))) for i in range(40) for e in ("cls", "png", "hull_hl.npy")] + [("7.png", b"last")]
    shard(tmp_path / "a.tar", rows)
    with gzip.open(tmp_path / "b.tar", "wb") as out:
        out.write((tmp_path / "a.tar").read_bytes())
    index = s.member_index(spark, str(tmp_path))
    assert index.filter("offset IS NULL").count() == index.filter("offset IS NOT NULL").count() == len(rows)
    want = {name: data for name, data in rows}
    wanted = index.select("shard", "key").distinct().filter("cast(key AS int) % 3 = 1").withColumn("more", F.lit(1))
    got = s.load_samples(spark, str(tmp_path), wanted, ["png", "hull_hl.npy"]).collect()
    assert len(got) == 26 and all(bytes(r.png) == want[f"{r.key}.png"] and bytes(r["hull_hl.npy"]) == want[f"{r.key}.hull_hl.npy"] and r.more == 1 for r in got)
    with pytest.raises(Exception, match="lacks a member"):
        s.load_samples(spark, str(tmp_path), wanted, ["hull_lr.npy"]).collect()


def packed_rows(spark, n, bad=None):
    rows = [(f"cards-{i // 4:04d}.tar", f"{i}.cls", f"v{i}".encode(), i) for i in range(n)]
    df = spark.createDataFrame(rows, "file string, name string, payload binary, at int")
    return df if bad is None else df.withColumn("payload", F.when(F.col("at") == bad, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))


def contents(spark, folder):
    return sorted((r.shard.rpartition("/")[2], r.key, bytes(r.payload)) for r in s.read_members(spark, str(folder)).collect())


def test_a_failed_job_leaves_the_earlier_set(spark, tmp_path):
    files.write_files(packed_rows(spark, 12), str(tmp_path), ["at"], replaces="cards")
    (tmp_path / "grounds-0009.tar").write_bytes((tmp_path / "cards-0000.tar").read_bytes())
    before = contents(spark, tmp_path)
    with pytest.raises(Exception, match="lost"):
        files.write_files(packed_rows(spark, 30, bad=29), str(tmp_path), ["at"], replaces="cards")
    assert contents(spark, tmp_path) == before and sorted(f.name for f in tmp_path.iterdir()) == ["cards-0000.tar", "cards-0001.tar", "cards-0002.tar", "grounds-0009.tar"]
    files.write_files(packed_rows(spark, 5), str(tmp_path), ["at"], replaces="cards")  # a shorter set leaves no stale shard
    assert sorted(f.name for f in tmp_path.iterdir()) == ["cards-0000.tar", "cards-0001.tar", "grounds-0009.tar"]
    files.write_files(packed_rows(spark, 0), str(tmp_path), ["at"], replaces="cards")
    assert [f.name for f in tmp_path.iterdir()] == ["grounds-0009.tar"]


def staged(folder, n, attempts=1):
    """A writer whose tasks have written; messages of the last attempts."""
    writer = files.FilesWriter({"path": f"file://{folder}", "replaces": "cards"})
    rows = [SimpleNamespace(file=f"cards-{i // 4:04d}.tar", name=f"{i}.cls", payload=b"new") for i in range(n)]
    halves = rows[: n // 8 * 4], rows[n // 8 * 4 :]
    return writer, [[writer.write(iter(half)) for _ in range(attempts)][-1] for half in halves]


def test_commits_are_whole_or_not(spark, tmp_path, monkeypatch):
    files.write_files(packed_rows(spark, 20), str(tmp_path), ["at"], replaces="cards")
    before = contents(spark, tmp_path)
    staged(tmp_path, 16)  # all tasks done, and the driver is lost: the earlier set stands
    assert contents(spark, tmp_path) == before
    writer, messages = staged(tmp_path, 16, attempts=3)  # tasks that ran three times leave one file each
    moved, move = [], files._move

    def lost(fs, a, b):
        if moved:
            raise OSError("lost")
        moved.append(b)
        move(fs, a, b)

    monkeypatch.setattr(files, "_move", lost)
    monkeypatch.setattr(files, "MOVERS", 1)
    with pytest.raises(OSError, match="lost"):
        writer.commit(messages)
    monkeypatch.setattr(files, "_move", move)
    assert len(moved) == 1  # lost among the moves: who reads next finishes them
    assert contents(spark, tmp_path) == [(f"cards-{i // 4:04d}.tar", str(i), b"new") for i in sorted(range(16), key=lambda i: (i // 4, str(i)))]
    assert sum(f.is_file() for f in tmp_path.iterdir()) == 4 and not list(tmp_path.glob("_commit*"))
    fs, base = files.filesystem(str(tmp_path))
    assert files.settle(fs, base) == 0
    writer, messages = staged(tmp_path, 8)
    writer.abort(messages)
    assert not (tmp_path / f"_staged-{writer.job}").exists() and len(contents(spark, tmp_path)) == 16
    with pytest.raises(ValueError):
        writer.write(iter([SimpleNamespace(file="../x", name=None, payload=b"")]))


def plainly(df, partition, order, key):
    w = Window.partitionBy(*partition).orderBy(*order, key)
    new = F.when((F.row_number().over(w) > 1) & ~F.lag(key).over(w).eqNullSafe(F.col(key)), 1).otherwise(0)
    return df.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")


def test_runs_of_one_giant_group(spark):
    rng = random.Random(4)
    for shift, n in ((0, 3000), (1, 40), (2, 0), (3, 1)):
        rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randrange(n * 5), i, rng.choice(["x", "x", "y", None]), float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "shard string, ts int, at int, key string, `run a` double").repartition(1 + shift)
        got = m.runs(df, ["shard"], ["ts", "at"])
        assert got.columns == [*df.columns, "run"]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plainly(df, ["shard"], ["ts", "at"], "key").select(*got.columns[:-2], "`run a`", F.col("run").cast("long")).collect()))
    one = spark.range(40_000).select(F.lit("all").alias("shard"), F.col("id").alias("ord"), (F.col("id") / 7).cast("int").cast("string").alias("key"))
    assert m.runs(one, ["shard"], ["ord"]).agg(F.max("run")).first()[0] == 40_000 // 7
    sizes = one.repartitionByRange(8, "shard", "ord").groupBy(F.spark_partition_id()).count().orderBy("count").collect()  # as runs deals rows
    assert len(sizes) == 8 and sizes[-1]["count"] <= 2 * sizes[len(sizes) // 2]["count"]  # no task over twice the median


def test_pages_of_a_class_index(spark, monkeypatch):
    monkeypatch.setattr(m, "PAGE", 16)
    rng = random.Random(5)
    rows = [(rng.choice(["Ah"] * 6 + ["7s", "10c"]), f"s{rng.randrange(9)}", f"{i:05d}") for i in range(900)] + [(None, "s1", "x")]
    index = spark.createDataFrame(rows, "name string, shard string, key string").repartition(4)
    paged = m.PagedIndex(index)
    order = {n: sorted(r[1:] for r in rows if r[0] == n) for n in ("10c", "7s", "Ah")}
    assert {(r.name, r.class_rank): r.n for r in paged.directory.collect()} == {(n, i): len(order[n]) for i, n in enumerate(order)}
    pages = paged.pages.collect()
    assert max(len(r.entries) for r in pages) == 16 and all([tuple(e) for e in r.entries] == [(i, *order[r.name][i]) for i in range(r.page * 16, min(r.page * 16 + 16, len(order[r.name])))] for r in pages)
    draws = [(i, rng.randrange(4), rng.randrange(1000)) for i in range(300)]
    df = spark.createDataFrame(draws, "draw int, class_rank int, entry long")
    names = list(order)
    want = {(d, names[c], *order[names[c]][e]) for d, c, e in draws if c < 3 and e < len(order[names[c]])}
    assert want and {(r.draw, r.name, r.shard, r.key) for r in paged.drawn(df).collect()} == want
    monkeypatch.setattr(m.PagedIndex, "FEW", 2)
    assert {(r.draw, r.name, r.shard, r.key) for r in paged.drawn(df).collect()} == want
    one = paged.asked(df.limit(1))  # a draw reads the page it asks for: its class's folder, its page's row group
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() <= 1 and "class_rank" in plan.partition("PartitionFilters: [")[2].partition("]")[0] and "page" in plan.partition("PushedFilters: [")[2].partition("]")[0]
    assert m.PagedIndex(index.limit(0)).drawn(df).count() == 0


def test_draws_by_hash(spark):
    rows = [(n, f"s{i % 3}", f"{i:04d}") for n, size in (("a", 1), ("b", 10), ("c", 300)) for i in range(size)]
    index = spark.createDataFrame(rows, "name string, shard string, key string")
    draw = lambda df, *args: sorted(map(tuple, sampling.keyed_sample(df, 9, *args).collect()))
    keys = ["name", "shard", "key"]
    whole, by = draw(index, 25, keys), draw(index, 4, keys, ["name"])
    assert len(whole) == 25 and Counter(r[0] for r in by) == {"a": 1, "b": 4, "c": 4}
    for parts in (1, 3, 7):
        again = index.repartition(parts, F.rand())
        assert draw(again, 25, keys) == whole and draw(again, 4, keys, ["name"]) == by
        assert sampling.random_sample(again, 3).collect() == sampling.random_sample(index, 3).collect()
    with pytest.raises(KeyError):
        sampling.random_sample(index.limit(0), 1)
    # chi-square: classes are drawn evenly whatever their sizes, and so are a class's entries
    seeds = spark.range(20_000).withColumnRenamed("id", "seed")
    hashed = lambda kind, *cols: F.md5(F.concat_ws(":", "seed", F.lit(kind), *cols))
    classes = seeds.withColumn("c", F.array_min(F.array(*[F.struct(hashed("class", F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in "abcde"]))["c"])
    entries = seeds.withColumn("c", F.array_min(F.array(*[F.struct(hashed("sample", F.lit(f"s{i % 3}"), F.lit(f"{i:04d}")).alias("h"), F.lit(i).alias("c")) for i in range(10)]))["c"])
    for df, k, bound in ((classes, 5, 18.5), (entries, 10, 27.9)):  # 0.999 quantiles of 4 and 9 degrees
        counts = [r["count"] for r in df.groupBy("c").count().collect()]
        assert len(counts) == k and sum((n - 20_000 / k) ** 2 / (20_000 / k) for n in counts) < bound
    assert sampling.random_sample(index, 5).first().name == min("abc", key=lambda c: __import__("hashlib").md5(f"5:class:{c}".encode()).hexdigest())


def test_walks_see_all_files(spark, tmp_path):
    image = np.random.default_rng(6).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    good = png.encode_png(image)
    names = {"a.png": good, ".dot.PNG": good, "_under/b.png": good, ".git/c.png": good, "d/e/f/g/h/i.png": good, "bad.png": b"-", ".bad.jpg": b"-", "w.webp": b"RIFF", "none.txt": b"", ".png": good, "_staged-1/x.png": good}
    for name, data in names.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    walked = s.walk_images(spark, str(tmp_path / "root"), decode=True).collect()
    below = lambda r: r.path.partition("/root/")[2]
    assert {below(r) for r in walked if r.image is not None} == {"a.png", ".dot.PNG", "_under/b.png", ".git/c.png", "d/e/f/g/h/i.png"}
    assert {below(r): r.reason for r in walked if r.image is None} == {"bad.png": "it does not decode", ".bad.jpg": "it does not decode", "w.webp": "WebP images are not decoded"}
    assert all(bytes(r.image.data) == image.tobytes() and r.reason is None for r in walked if r.image is not None) and len(walked) == 8
    assert {below(r): r["size"] for r in s.walk_images(spark, str(tmp_path / "root")).collect()} == {below(r): r["size"] for r in walked}
    out = tmp_path / "out"
    assert p.pack_backgrounds(spark, str(tmp_path / "root"), str(out)) == 1
    assert {r.key for r in s.read_members(spark, str(out)).collect()} == {"00000001", "00000002", "00000003", "00000004", "00000006"}  # gaps where files do not decode
    shutil.rmtree(tmp_path / "root" / "d")
    assert s.walk_images(spark, str(tmp_path / "root"), decode=True).count() == 7


def test_small_shards_share_tasks_and_cost_no_more_in_a_large_batch(tmp_path):
    names = [[(f"{i:02d}{k:04d}.cls", b"c%d" % k) for k in range(200)] for i in range(40)]
    uris = [shard(tmp_path / f"x-{i:02d}.tar", rows) for i, rows in enumerate(names)]
    reader = tar.MembersReader({"path": f"file://{tmp_path}", "payload": "false"})
    parts = reader.partitions()
    assert len(parts) < 5 and [uri for part in parts for uri, _, _ in part.pieces] == uris
    rows = [r for part in parts for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["key"], r["ext"]) for r in rows] == [tuple(n.split(".")) for own in names for n, _ in own]

    class Counted(bytes):
        seen = 0

        def __len__(self):
            Counted.seen += 1
            return super().__len__()

    class Opened:
        def __init__(self, uri):
            self.file = tar.filesystem(uri)[0].open_input_file(tar.filesystem(uri)[1])

        def range(self, offset, size):
            return Counted(self.file.read_at(size, offset))

        def close(self):
            self.file.close()

    batch = tar.pa.RecordBatch.from_pylist([{k: r[k] for k in ("shard", "ord", "offset", "size")} for r in rows])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tar, "Ranged", Opened)
        out = list(tar.fetched(iter([batch]), "payload"))
    assert [p.as_py() for b in out for p in b.column("payload")] == [data for own in names for _, data in own]
    assert Counted.seen <= 4 * len(rows)  # lengths were summed up anew for each member of a batch
