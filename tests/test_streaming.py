import io
import tarfile

from scenekiln.streaming.ingest import append_index, stream_class_counts, stream_members


def shard(path, names):
    with tarfile.open(path, "w") as tar:
        for i, name in enumerate(names):
            info = tarfile.TarInfo(f"{i:08d}.cls")
            data = name.encode()
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_index_and_counts_grow(spark, tmp_path):
    folder = tmp_path / "shards"
    folder.mkdir()
    seen = []
    for k, names in enumerate((["Ah", "7s"], ["Ah "])):
        shard(folder / f"cards-{k}.tar", names)
        append_index(stream_members(spark, str(folder), ["cls"]), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
        seen.append(sorted(r.name for r in spark.read.parquet(str(tmp_path / "index")).collect()))
    assert seen == [["7s", "Ah"], ["7s", "Ah", "Ah"]]
    query = stream_class_counts(stream_members(spark, str(folder), ["cls"])).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.name: r.n for r in spark.table("counts").collect()} == {"Ah": 2, "7s": 1}
