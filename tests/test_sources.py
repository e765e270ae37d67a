from quarry.sources.files import read_text_dir, read_text_files


def test_text_dir_and_exclude(spark, tmp_path):
    for name, body in [("rag.txt", "about rag\nline two"), ("python.txt", "python"), ("storage.txt", "x")]:
        (tmp_path / name).write_text(body)
    d = read_text_dir(spark, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in d.collect()}
    assert got["rag.txt"] == "about rag\nline two" and len(got) == 3
    ex = read_text_dir(spark, str(tmp_path), exclude=[str(tmp_path / "python.txt")])
    assert sorted(r["doc_id"] for r in ex.collect()) == ["rag.txt", "storage.txt"]
    one = read_text_files(spark, [str(tmp_path / "python.txt")])
    assert [r["doc_id"] for r in one.collect()] == ["python.txt"]


def test_exclude_is_by_path_not_substring(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name in ["python.txt", "my_python.txt"]:
        (tmp_path / "data" / name).write_text(name)
    ex = read_text_dir(spark, str(tmp_path / "data"), exclude=["data/python.txt"])
    assert [r["doc_id"] for r in ex.collect()] == ["my_python.txt"]

