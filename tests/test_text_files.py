"""Documents written as files: one for each row, whole, and nothing beside them that costs a process of its own."""

from folioscope.sources import corpus


def test_a_file_for_each_row_and_no_more(spark, tmp_path):
    rows = [("a/b c", "first\nsecond"), ("a/b c", "é \U0001f600"), ("a/b c", "first\nsecond"), (None, "nobody's"), ("z", None), ("z", "")]
    root = f"{tmp_path}/corpus"
    corpus.write_text_files(spark.createDataFrame(rows, "group_id string, text string").repartition(3), root)
    files = [f for f in (tmp_path / "corpus").rglob("*") if f.is_file()]
    assert len(files) == len(rows) and all(f.name.startswith("part-") and f.suffix == ".txt" for f in files)  # no checksum files
    found = corpus.read_corpus(spark, root).select("group_id", "content").collect()
    key = lambda r: (r[0] or "", r[1])
    assert sorted([(r.group_id, bytes(r.content).decode()) for r in found], key=key) == sorted([(g, (t or "") + "\n") for g, t in rows], key=key)


def test_no_rows_give_an_empty_folder(spark, tmp_path):
    corpus.write_text_files(spark.createDataFrame([], "group_id string, text string"), f"{tmp_path}/corpus")
    assert not list((tmp_path / "corpus").rglob("part-*"))
