from __future__ import annotations

import random

import pytest

from inkweave.streaming import sync

ROW = "path string, size bigint, last_modified bigint, doc_id string"


def test_reconcile_keeps_what_failed(spark):
    old = spark.createDataFrame([("a", 1, 1, "a0"), ("b", 1, 1, "b0"), ("c", 1, 1, "c0")], ROW)
    scan = spark.createDataFrame([("a", 2, 2, "a1"), ("b", 2, 2, "b1"), ("d", 1, 1, "d0"), ("e", 1, 1, "e0")], ROW)
    nxt, gone = sync.reconcile(old, scan, spark.createDataFrame([("a1",), ("d0",)], "id string"))
    assert {(r.path, r.doc_id) for r in nxt.collect()} == {("a", "a1"), ("b", "b0"), ("d", "d0")}
    assert {r.id for r in gone.collect()} == {"a0", "c0"}


def test_similarity_state_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(2)

    def unit():
        v = [rng.gauss(0, 1) for _ in range(3)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    table = {f"d{i}": unit() for i in range(12)}
    state = sync.SimilarityState(spark, str(tmp_path / "s"), 0.5, rebuild_above=5)
    frame = lambda t: spark.createDataFrame(list(t.items()), "id string, vector array<float>")
    done = [state.update(frame(table))]
    for _ in range(2):
        table |= {f"n{len(table) + j}": unit() for j in range(2)}
        done.append(state.update(frame(table)))
    done.append(state.update(frame(table)))
    del table["d3"]
    done.append(state.update(frame(table)))
    assert done == ["rebuilt", "added", "added", "none", "rebuilt"]
    fresh = sync.SimilarityState(spark, str(tmp_path / "f"), 0.5)
    fresh.update(frame(table))
    rows = lambda s: {(r.a, r.b, round(r.sim, 5)) for r in s.pairs().collect()}
    assert rows(state) == rows(fresh) != set()


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 1}\n')

    def run():
        stream = spark.readStream.schema("id string, v int").json(str(src))
        q = sync.save_changed(stream, out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    (src / "2.json").write_text('{"id": "a", "v": 2}\n{"id": "c", "v": 1}\n')
    run()
    assert {(r.id, r.v) for r in sync.current_table(spark, out).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert sync.current_table(spark, str(tmp_path / "none")) is None


def test_lines_wait_for_their_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"stream_id": "s", "at": 1, "chunk": "data: a"}\n{"stream_id": "s", "at": 2, "chunk": "b\\nda"}\n')
    (src / "2.json").write_text('{"stream_id": "s", "at": 3, "chunk": "ta: c\\n"}\n')
    stream = spark.readStream.schema("stream_id string, at int, chunk string").option("maxFilesPerTrigger", 1).json(str(src))
    q = sync.accumulate_lines(stream).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("lines").collect()) == ["data: ab", "data: c"]


def test_similarity_state_survives_its_process(spark, tmp_path):
    frame = lambda t: spark.createDataFrame(list(t.items()), "id string, vector array<float>")
    table = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.0, 1.0]}
    sync.SimilarityState(spark, str(tmp_path / "s"), 0.5).update(frame(table))
    again = sync.SimilarityState(spark, str(tmp_path / "s"), 0.5)
    assert again.vectors().count() == 3 and again.update(frame(table)) == "none"
    assert again.update(frame(table | {"d": [0.6, 0.8]})) == "added"
    # an update that died between its two tables doesn't count
    spark.createDataFrame([], "a string, b string, sim double").write.parquet(str(tmp_path / "s" / "pairs" / "v0000000003"))
    third = sync.SimilarityState(spark, str(tmp_path / "s"), 0.5)
    assert third.version == 2 and third.pairs().count() == again.pairs().count() > 0


def batches(spark, out, *rows, version=None):
    """Runs batches as a stream does, by the function that it is given."""
    class Stream:
        writeStream = None

        def __init__(self):
            self.writeStream = self

        def foreachBatch(self, f):
            self.save = f
            return self

        def option(self, *_):
            return self

    s = sync.save_changed(Stream(), out, "unused", version=version)
    for number, r in rows:
        s.save(spark.createDataFrame(r, "id string, v int"), number)
    return {(r.id, r.v) for r in sync.current_table(spark, out).collect()}


def test_a_batch_run_again_gives_the_same_table(spark, tmp_path):
    out = str(tmp_path / "t")
    first, second = [("a", 1), ("b", 1), (None, 7)], [("a", 2), ("c", 1)]
    assert batches(spark, out, (0, first), (1, second)) == {("a", 2), ("b", 1), ("c", 1)}
    assert batches(spark, out, (1, second)) == {("a", 2), ("b", 1), ("c", 1)}
    assert batches(spark, out, (2, [])) == {("a", 2), ("b", 1), ("c", 1)}


def test_the_latest_version_of_a_batch_stays(spark, tmp_path):
    out = str(tmp_path / "t")
    assert batches(spark, out, (0, [("a", 3), ("a", 1), ("b", None)]), (1, [("a", 2), ("b", 1)]), version="v") == {("a", 3), ("b", 1)}


def test_a_failed_read_loses_nothing(spark, tmp_path):
    out = tmp_path / "t"
    batches(spark, str(out), (0, [("a", 1), ("b", 1)]))
    part = next(out.glob("_lists/v*/part-*.parquet"))
    held = part.read_bytes()
    part.write_bytes(b"torn")
    with pytest.raises(Exception):
        batches(spark, str(out), (1, [("a", 2)]))
    part.write_bytes(held)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert batches(spark, str(out), (1, [("a", 2)])) == {("a", 2), ("b", 1)}


def test_a_folder_is_kept_in_step(spark, tmp_path):
    root, at = tmp_path / "notes", str(tmp_path / "corpus")
    root.mkdir()
    (root / "a.txt").write_text("first text")
    (root / "b.md").write_text("# Title\n\nbody")
    ids = lambda: {r.text for r in sync.read_table(spark, f"{at}/documents").collect()}
    assert sync.sync_folder(spark, str(root), at) == {"added": 2, "changed": 0, "removed": 0, "dropped": 0}
    assert sync.sync_folder(spark, str(root), at) == {"added": 0, "changed": 0, "removed": 0, "dropped": 0}
    (root / "a.txt").write_text("second text, longer")
    (root / "c.pdf").write_bytes(b"%PDF")
    assert sync.sync_folder(spark, str(root), at) == {"added": 1, "changed": 1, "removed": 0, "dropped": 1}
    assert "second text, longer" in ids() and "first text" not in ids()
    (root / "b.md").unlink()
    got = sync.sync_folder(spark, str(root), at)
    # the file that can't be read has no row, so it is tried again
    assert got == {"added": 1, "changed": 0, "removed": 1, "dropped": 1} and ids() == {"second text, longer"}


def test_the_last_line_comes_out_at_the_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"stream_id": "s", "at": 1, "chunk": "a\\nb"}\n')
    (src / "2.json").write_text('{"stream_id": "s", "at": 2, "chunk": null}\n')
    stream = spark.readStream.schema("stream_id string, at int, chunk string").option("maxFilesPerTrigger", 1).json(str(src))
    q = sync.accumulate_lines(stream).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("ended").collect()) == ["a", "b"]
