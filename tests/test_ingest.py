"""The streamed index: changed, repeated, deleted documents and batches that run again."""

from pyspark.sql import functions as F

from folioscope.session import scratch_path
from folioscope.streaming import ingest, live

COLUMNS = "doc_id long, source string, text string, deleted boolean, seq int"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def text(i, mark=""):
    return f"{mark}document {i} " + "word " * (i * 37 % 400)


def expected(spark, rows):
    """The batch result: the chunks of each document's last state."""
    last = {}
    for r in sorted(rows, key=lambda r: r[4]):
        last[r[0]] = r
    live_rows = [r for r in last.values() if r[2] is not None and not r[3]]
    return sorted(map(tuple, ingest.window_rows(frame(spark, live_rows).drop("deleted", "seq")).select("doc_id", "source", "chunk_id", "chunk_text").collect(), ), key=str)


def held(spark, path):
    return sorted(map(tuple, ingest.read_index(spark, path).select("doc_id", "source", "chunk_id", "chunk_text").collect()), key=str)


def test_change_rerun_and_delete_equal_the_batch(spark):
    path = scratch_path(spark, "index")
    first = [(i, "a", text(i), None, 0) for i in range(60)] + [(None, "a", "no id", None, 0), (70, "b", "", None, 0)]
    second = [(3, "a", text(3, "new "), None, 1), (4, "a", text(4), None, 1), (5, "a", None, None, 1), (6, "a", text(6), True, 1), (99, "a", text(99), None, 1),
              (7, "a", text(7, "early "), None, 1), (7, "a", text(7, "late "), None, 2), (8, "moved", text(8), None, 1)]
    assert ingest.apply_documents(frame(spark, first), path, "s", 0, order="seq")
    assert held(spark, path) == expected(spark, first)
    assert ingest.apply_documents(frame(spark, second), path, "s", 1, order="seq")
    want = expected(spark, first + second)
    assert held(spark, path) == want
    assert not any(c[0] == 3 and "new" not in c[3] and c[3].startswith("document") for c in held(spark, path))
    assert not ingest.apply_documents(frame(spark, second), path, "s", 1, order="seq")  # applied already
    assert not ingest.apply_documents(frame(spark, first), path, "s", 0, order="seq")
    assert held(spark, path) == want
    assert held_at(spark, path, 1) == expected(spark, first)  # the older commit is still whole


def held_at(spark, path, commit):
    return sorted(map(tuple, ingest.read_index(spark, path, commit).select("doc_id", "source", "chunk_id", "chunk_text").collect()), key=str)


def test_unchanged_documents_write_nothing(spark):
    path = scratch_path(spark, "index")
    rows = [(i, "a", text(i), None, 0) for i in range(20)]
    ingest.apply_documents(frame(spark, rows), path, "s", 0, order="seq")
    ingest.apply_documents(frame(spark, [(*r[:4], 5) for r in rows]), path, "s", 1, order="seq")
    versions = spark.read.parquet(f"{path}/data").select("version").distinct().collect()
    assert [v[0] for v in versions] == [1]


def test_a_batch_that_died_leaves_nothing_that_is_read(spark, monkeypatch):
    path = scratch_path(spark, "index")
    first, second = [(i, "a", text(i), None, 0) for i in range(10)], [(i, "a", text(i, "x"), None, 1) for i in range(5)]
    ingest.apply_documents(frame(spark, first), path, "s", 0, order="seq")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_write_manifest", fail)
        try:
            ingest.apply_documents(frame(spark, second), path, "s", 1, order="seq")
        except RuntimeError:
            pass
    assert held(spark, path) == expected(spark, first)
    assert ingest.apply_documents(frame(spark, second), path, "s", 1, order="seq")
    assert held(spark, path) == expected(spark, first + second)


def test_stream_goes_on_from_its_checkpoint(spark):
    path, rows = scratch_path(spark, "index"), []
    for step in range(3):
        part = [(i, "a", text(i, f"v{step} "), i % 11 == step, step) for i in range(step * 5, step * 5 + 12)]
        rows += part
        frame(spark, part).repartition(2).write.mode("append").parquet(f"{path}/in")
        stream = live.read_files(spark, f"{path}/in", "*.parquet")
        ingest.ingest(stream, path, order="seq")
        ingest.ingest(stream, path, order="seq")  # nothing new
        assert held(spark, path) == expected(spark, rows)


def test_no_documents_give_no_index(spark):
    path = scratch_path(spark, "index")
    assert ingest.apply_documents(frame(spark, [(1, "a", None, None, 0)]), path, "s", 0, order="seq")
    index = ingest.read_index(spark, path)
    assert index is None or index.agg(F.count("*")).first()[0] == 0


def test_a_stream_reads_a_table_in_one_file_or_in_a_folder(spark):
    folder = scratch_path(spark, "tables")
    frame(spark, [(i, "a", text(i), None, 0) for i in range(40)]).repartition(3).write.parquet(f"{folder}/many.parquet")
    frame(spark, [(90, "other", "x", None, 0)]).write.parquet(f"{folder}/other.parquet")
    one = frame(spark, [(i, "a", text(i), None, 0) for i in range(100, 105)]).toPandas()
    one["deleted"] = one["deleted"].astype("boolean")
    one.to_parquet(f"{folder}/one.parquet")
    for name, n in (("many.parquet", 40), ("one.parquet", 5), ("*n*.parquet", 45)):
        path = scratch_path(spark, "index")
        ingest.ingest(live.read_files(spark, folder, name).select("doc_id", "source", "text"), path)
        assert ingest.read_index(spark, path).select("doc_id").distinct().count() == n
