import pytest
from pyspark.sql import functions as F

from estatelens.operators import ingest as I


def test_filters_and_audit(spark):
    paths = ["\\\\s\\a\\f.pdf", None, "", "nan", "0", "plain", "\\\\s\\a\\", "a/b.txt", "\\s\\Thumbs.db", "\\s\\~$x.docx", "\\s\\old.BAK", "\\s\\tmp"]
    df = spark.createDataFrame([(p, 0) for p in paths] + [("\\s\\dir", 3)], "full_path string, folder_count int")
    assert sorted(r[0] for r in I.apply_filters(df).select("full_path").collect()) == ["\\\\s\\a\\f.pdf", "a/b.txt"]
    a = I.filter_audit(df).head()
    assert (a["initial"], a["null_paths"], a["folder_rows"], a["system_files"], a["final"]) == (13, 5, 2, 4, 2)
    assert I.filter_audit(df.limit(0)).head()["initial"] == 0


@pytest.mark.parametrize("name, stem, ext", [("report.v2.PDF", "report.v2", "pdf"), (".gitignore", ".gitignore", ""), ("PHOTO.JPG", "PHOTO", "jpg"), ("readme", "readme", ""), (".a.b", ".a", "b"), ("x.", "x", "")])
def test_names(spark, name, stem, ext):
    df = I.decompose_paths(spark.createDataFrame([(f"/root/{name}",)], "full_path string"))
    assert tuple(df.select("filename_stem", "extension").head()) == (stem, ext)


def test_root_is_stripped_only_where_it_matches(spark):
    df = spark.createDataFrame([("\\\\Srv\\Data\\A\\b.txt",), ("\\\\other\\data\\A\\b.txt",), ("\\\\srv\\data",), ("//srv//data/x/y/z.txt",), (None,)], "full_path string")
    got = [tuple(r) for r in I.decompose_paths(df, "\\\\srv\\data").select("relative_path", "segments", "filename_stem", "depth").collect()]
    assert got == [("A\\b.txt", ["A"], "b", 1), ("other\\data\\A\\b.txt", ["other", "data", "A"], "b", 3), ("", [], "", 0), ("x\\y\\z.txt", ["x", "y"], "z", 2), ("", [], "", 0)]


def test_map_validate_audit(spark):
    df = spark.createDataFrame([("/a/b.txt", 5, "z")], "Path string, Size int, Extra string")
    mapped = I.map_columns(df, {"Path": "full_path", "Size": "size", "Owner": "owner"})
    assert mapped.columns == ["full_path", "size"]
    with pytest.raises(ValueError):
        I.validate(mapped, ("full_path", "owner"))
    out = I.add_audit_fields(I.decompose_paths(mapped), "run", "now").head()
    assert len(out["file_id"]) == 16 and out["filename"] == "b.txt" and out["batch_run_id"] == "run"
    tagged = I.tag_source(mapped, "E", "/a").head()
    assert (tagged["source_system"], tagged["root_prefix"]) == ("E", "/a")


def test_normalise(spark):
    df = spark.createDataFrame([("/é/f", "2020-01-02 03:04:05", "  bob "), ("/x/y", "rubbish", "nan"), ("/x/z", None, None)], "full_path string, last_modified string, owner string")
    got = [tuple(r) for r in I.normalise(df).select("full_path", F.col("last_modified").cast("string"), "owner").collect()]
    assert got == [("/é/f", "2020-01-02 03:04:05", "bob"), ("/x/y", None, ""), ("/x/z", None, "")]


def test_levels(spark):
    df = I.level_columns(spark.createDataFrame([(["a", "b"],), ([],)], "segments array<string>"), 3)
    assert [tuple(r)[1:] for r in df.collect()] == [("a", "b", ""), ("", "", "")]
    assert df.select(I.display_path(F.col("segments"))).collect()[0][0] == "a"
