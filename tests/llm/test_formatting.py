import json
import random
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from estatelens.llm.formatting import FIELDS, FLAT, _canonical_rows, canonical, copies, distinct_records


def test_canonical():
    base = canonical('{"filename_stem":"Ölheizung 1","extension":"PDF","normalized_filename":null,"size":36378}')
    assert base == canonical('{ "size": "36,378", "normalized_filename": "", "extension": ".pdf ", "filename_stem": "\\u00d6L-heizung_1" }')
    assert base == canonical(json.dumps({"filename_stem": unicodedata.normalize("NFD", "ölheizung (1)"), "extension": "pdf", "size": " 36 378 "}))
    assert base != canonical('{"filename_stem":"Olheizung 1","extension":"PDF","size":36378}')
    for bad in (None, "", "  ", '{"a": 1', "[1]", '"x"', "3", '{"a":1} x'):
        assert canonical(bad) is None
    assert canonical("{}") == ["", "", "", ""]


def test_copies_against_brute_force(spark):
    rnd = random.Random(7)
    lines = []
    for i in range(600):
        stem = rnd.choice(["plan a", "Plan-A", "plän a", "nalp a", f"u{i}"])
        o = {"filename_stem": stem, "extension": rnd.choice(["pdf", ".PDF"]), "size": rnd.choice([1, "1", None])}
        keys = list(o)
        rnd.shuffle(keys)
        lines.append((i, rnd.choice([json.dumps({k: o[k] for k in keys}), json.dumps(o, ensure_ascii=False), None, "{", ""]), "clash"))
    df = spark.createDataFrame(lines, "line_id bigint, line string, n_copies string")
    classes = {}
    for i, line, _ in lines:
        if (c := canonical(line)) is not None:
            classes.setdefault(tuple(c), []).append(i)
    assert Counter(map(tuple, copies(df).collect())) == Counter((min(v), len(v)) for v in classes.values() if len(v) > 1)
    assert Counter(map(tuple, distinct_records(df).collect())) == Counter((min(v), len(v)) for v in classes.values())
    assert copies(df.limit(0)).count() == 0


def test_anagrams_share_the_cheap_class_only(spark):
    df = spark.createDataFrame([(1, '{"filename_stem":"abc"}'), (2, '{"filename_stem":"cba"}'), (3, '{"filename_stem":"a b c"}'), (3, '{"filename_stem":"abc"}')], "line_id bigint, line string")
    assert [tuple(r) for r in copies(df).collect()] == [(1, 3)]


ODD = [
    '{"filename_stem":"a","filename_stem":"b"}', '{"filename_stem":true,"size":false}', '{"filename_stem":null,"size":-0}', '{"size":1.50}', '{"size":1e5}', '{"size":007}', '{"size":-}', '{}', ' { } ', "{'size':1}", '{"size":1,}', '{"size":1}}', '{"size":1} ',
    '{"filename_stem":{"b":1,"a":[2,"x"]}}', '{"filename_stem":["x",1]}', '{"filename_stem":"tab\there"}', '{"filename_stem":"esc\\t\\"q\\" \\/ \\\\"}', '{"filename_stem":"bad \\x"}', '{"filename_stem":"\\u00e9"}', '{"filename_stem":"e\\u0301"}', '{"filename_stem":"e\u0301"}', '{"filename_stem":"\u212a \u00df \ufb01"}',
    '{"filename_stem":"a\u2013b \u201cc\u201d"}', '{"filename_stem":"\u0661\u0662"}', '{"filename_stem":"\u00bd x\u00b2"}', '{"FILENAME_STEM":"x","extension":"PDF"}', '{"filename_stem":"x" "size":1}', '{"filename_stem":NaN}', "[1]", '"x"', "null", "", " ", None, '{"filename_stem":"' + "y " * 9000 + '"}', '{"filename_stem":"cut',
    '\ufeff{"size":1}', '\u00a0{"size":1}', '{"a":"b","size":"1 000","extra":123}', '{"filename_stem":"\U0001e4d0 x"}', '{"filename_stem":"\U00032000 x"}',
]


def test_both_ways_of_reading_agree(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "line_id bigint, line string")
    got = {r["__id"]: None if r["__text"] is None else list(r["__text"]) for r in _canonical_rows(df, "line_id", "line", FIELDS).collect()}
    assert got == {i: canonical(line) for i, line in enumerate(ODD)}
    flat = {r["line_id"] for r in df.filter(F.col("line").rlike(FLAT)).collect()}
    assert {0, 1, 2, 7, 8, 16} <= flat and not flat & {3, 4, 5, 6, 9, 10, 11, 13, 18}


def test_many_fields_in_one_line(spark):
    line = "{" + ",".join(f'"k{i}":"v"' for i in range(650)) + ',"size":7}'
    df = spark.createDataFrame([(1, line), (2, '{"size":"7"}'), (3, "[" * 5000)], "line_id bigint, line string")
    assert [tuple(r) for r in copies(df).collect()] == [(1, 2)]
