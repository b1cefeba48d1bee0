import csv
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from estatelens.config import default_config
from estatelens.operators.ingest import SourceFormat
from estatelens.plans.pipeline import Estate, run_estates
from estatelens.session import numbered
from estatelens.sources import readers, sinks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def cell(ref, text=None, formula=None):
    body = (f"<f>{formula}</f>" if formula else "") + (f"<v>{text}</v>" if text is not None else "")
    return f'<c r="{ref}" t="str">{body}</c>'


def workbook(path, sheets):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>" + "".join(f'<row r="{n}">{"".join(cells)}</row>' for n, cells in rows.items()) + "</sheetData></worksheet>")


def test_xlsx_largest_sheet_and_links(spark, tmp_path):
    big = {1: [cell("A1", "meta")], 2: [cell("A2", "Path"), cell("B2", "Size")], 3: [cell("A3", None, 'HYPERLINK(&quot;\\\\s\\a\\x.pdf&quot;,&quot;x&quot;)'), cell("B3", "7")], 4: [cell("A4", "\\\\s\\b\\y.pdf"), cell("B4", "8")], 5: [cell("A5", "shown", 'HYPERLINK(&quot;\\\\s\\c&quot;)')]}
    workbook(tmp_path / "t.xlsx", {"small": {1: [cell("A1", "Path")]}, "big": big})
    fmt = SourceFormat({"Path": "full_path"}, header_row=1)
    got = [tuple(r) for r in readers.read_listing(spark, str(tmp_path / "t.xlsx"), "treesize", fmt).select("Path", "Size").collect()]
    assert got == [("\\\\s\\a\\x.pdf", "7"), ("\\\\s\\b\\y.pdf", "8"), ("\\\\s\\c", None)]
    first = readers.read_listing(spark, str(tmp_path / "t.xlsx"), "treesize", SourceFormat({}, sheet_strategy="first"))
    assert first.columns == ["Path"] and first.count() == 0
    workbook(tmp_path / "u.xlsx", {"only": {1: [cell("A1", "Path"), cell("B1", "Other")], 2: [cell("A2", "\\\\s\\d", 'HYPERLINK(&quot;\\\\kept&quot;)'), cell("B2", "o")], 3: []}})
    both = [tuple(r) for r in readers.read_listing(spark, str(tmp_path), "treesize", SourceFormat({})).select("Path", "Other").collect()]
    assert ("\\\\s\\d", "o") in both  # no cell of its own workbook hides its text
    with pytest.raises(ValueError):
        readers.read_listing(spark, str(tmp_path / "u.xlsx"), "treesize", SourceFormat({}, header_row=9))


def test_csv_header_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('made by x\nsecond line\nPath,Size\n"\\\\s\\a,b\\x.pdf",5\n\n\\\\s\\c\\y.pdf,6\n')
    fmt = SourceFormat({"Path": "full_path"}, header_row=2)
    got = [tuple(r) for r in readers.read_listing(spark, str(tmp_path / "a.csv"), "csv", fmt).collect()]
    assert got == [("\\\\s\\a,b\\x.pdf", "5"), ("\\\\s\\c\\y.pdf", "6")]
    with pytest.raises(ValueError):
        readers.read_listing(spark, str(tmp_path / "a.csv"), "pdf")
    with pytest.raises(FileNotFoundError):
        readers.read_listing(spark, str(tmp_path / "none.csv"), "csv")


def test_small_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("/a/b\n/c/d\n")
    assert readers.read_paths(spark, str(tmp_path / "p.txt")).count() == 2
    (tmp_path / "p.csv").write_text("Full Path,x\n/a/b,1\n")
    assert readers.read_paths(spark, str(tmp_path / "p.csv")).head()[0] == "/a/b"
    (tmp_path / "n.txt").write_text("Leeds\nEly\nleeds\n")
    (tmp_path / "n.csv").write_text("id,place18nm\n1, York \n")
    assert {r[0] for r in readers.read_place_names(spark, str(tmp_path / "n.txt"), str(tmp_path / "n.csv")).collect()} == {"leeds", "york"}
    a, b = spark.createDataFrame([("x", 1), (" ", 2)], "`File Path` string, a int"), spark.createDataFrame([("x",), (None,), ("y",)], "`File Path` string")
    assert {r[0] for r in readers.merge_sheets(a, b).collect()} == {"x", "y"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a", "b"], [("v", 0.5)], True), (2, 'q"x', [], None, None)], "n int, s string, l array<string>, raw array<struct<value:string,confidence:double>>, b boolean")
    rows = [tuple(r) for r in sinks.csv_frame(df).orderBy("n").collect()]
    assert rows == [("1", "", "a | b", "v (0.5)", "True"), ("2", 'q"x', "", "", "")]
    sinks.write_csv(df, str(tmp_path / "c"), ("s", "zz"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "n int, s string").count() == 2
    assert all("s" in json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines())
    sinks.write_report(df.select("n", "s"), str(tmp_path / "r"), "n", "s")
    sinks.text_report(df.select("n"), str(tmp_path / "t"), "Title")
    assert "Title" in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert sinks.text_lines(spark.range(9), "T", [F.desc("id")], 2) == ["T", "=", "id", "8", "7", "... and 7 more"]
    assert len(sinks.FULL) == 74 and len(sinks.SLIM) == 36
    assert [r["k"] for r in numbered(spark.range(100), [F.desc("id")], "k").orderBy("id").collect()] == list(range(99, -1, -1))


def test_pipeline_over_estates(spark, tmp_path):
    for e in ("A", "B"):
        with (tmp_path / f"{e}.csv").open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["Path", "Size", "Last Modified", "Owner", "Unused"])
            w.writerows([[f"\\\\srv\\{e}\\Development\\Oak Field\\Plot {i}\\Sales\\invoice {i}.pdf", 100 + i, "2015-01-02 03:04:05", "bob", "u"] for i in range(6)])
            w.writerow(["\\\\srv\\x\\Thumbs.db", 1, "", "", ""])
    estates = [Estate(e, str(tmp_path / f"{e}.csv"), "csv", f"\\\\srv\\{e}") for e in ("A", "B")] + [Estate("C", str(tmp_path / "none.csv"))]
    files, sidecar = run_estates(spark, estates, datetime(2024, 1, 1), default_config())
    rows = files.collect()
    assert len(rows) == 12 and {r["inferred_type"] for r in rows} == {"Invoice"} and {r["entity_scheme"] for r in rows} == {"Oak Field"}
    assert all(r["dup_is_cross_estate"] and r["retention_status"] == "Expired" and len(r["file_id"]) == 16 for r in rows)
    assert len({r["entity_plot_cluster_id"] for r in rows}) >= 1 and sidecar.filter("status = 'chosen'").count() == 2
    with pytest.raises(RuntimeError):
        run_estates(spark, estates[2:], datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        run_estates(spark, [], datetime(2024, 1, 1))
