import pytest

from dimforge.functions import yamlish
from dimforge.operators import rejects
from dimforge.operators.rejects import Field, fields_of

F5 = (Field("id", "whole", True), Field("tenant_id", "whole", True), Field("admin", "boolean"), Field("preferences", "mapping"), Field("deleted_at", "time"))
LINES = {
    "id,tenant_id,admin,preferences,deleted_at": "no", "﻿id,tenant_id,admin,preferences,deleted_at": "no", "# a comment, here": "no", "   ": "no", "": "no", None: "no",
    '1,2,TRUE,"{""a"": 1}",2024-01-01T00:00:00Z': None, "1,2,,,": None, "1,2,0,,\r": None, '"1","2",false,"---\n:a: 1\n",1706746155': None, '1,2,0,"a: ""x,y""",Feb 1': "deleted_at", '1,2,0,,"Feb 1, 2024 5:27:27 AM"': None,
    '1,2,0,"{"a": 1}",': "quoting", '1,2,0,{"a": 1},': "quoting", '1,2,0,"{""a"": 1},': "quoting", '1,2, "1",,': "quoting", '1,2,1",,': "quoting", '1,2,"1"x,,': "quoting", "1,2,0,a\nb,": "quoting", '1,2,0,"{\\"a\\": 1}",': "quoting",
    "1,2,0,": "columns", "1,2,0,,,": "columns", "1\t2\t0\t\t": "columns", "1,2,0,{a: 1, b: 2},": "columns",
    ",2,0,,": "id", "u7,2,0,,": "id", "1.5,2,0,,": "id", "99999999999999999999999,2,0,,": "id", "1,9O9,0,,": "tenant_id", "x,y,maybe,[,nope": "id", "1,2,yes,,": "admin", "1,2,-1,,": "admin",
    "1,2,0,42,": "preferences", '1,2,0,"[1, 2]",': "preferences", '1,2,0,"---\n- a\n- b\n",': "preferences", '1,2,0,"---\n\ta: 1\n",': "preferences", '1,2,0,"{""a"": 1}}",': "preferences", '1,2,0,"{""a"": 1} x",': "preferences",
    "1,2,0,,yesterday": "deleted_at", "1,2,0,,2024-02-30 10:00:00": "deleted_at", "1,2,0,," + "x" * 300_000: "deleted_at", "," * 1000: "columns",
}


def test_reasons(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "n int, raw string").withColumnRenamed("n", "line_id")
    got = {r.line_id: r.reason for r in rejects.parse(df, "raw", F5, keep=["line_id"]).collect()}
    for i, (line, want) in enumerate(LINES.items()):
        if want == "no":
            assert i not in got, line
        else:
            assert got[i] == want, (line, got[i])


def test_load(spark):
    df = spark.createDataFrame([(1, '7,2,TRUE,"b: 2",2024-07-01 12:00:00'), (2, "8,3,,,"), (3, "9,3,0,,2024-07-01 12:00:00"), (4, "bad")], "n int, raw string")
    zone = spark.createDataFrame([(2, "Europe/Berlin")], "t int, z string")
    got = {r.id: r for r in rejects.load(df, "raw", F5, zone=zone, zone_key="tenant_id").collect()}
    assert set(got) == {7, 8, 9}
    assert got[7].admin is True and got[7].preferences == '{"b": 2}' and str(got[7].deleted_at) == "2024-07-01 10:00:00"
    assert got[8].admin is None and got[8].deleted_at is None and got[9].deleted_at is None
    with pytest.raises(Exception, match="unusable record"):
        rejects.load(df, "raw", F5, fail_fast=True).collect()


def test_header_by_place_and_empty(spark):
    df = spark.createDataFrame([(1, "a,b,c,d,e"), (2, "1,2,0,,")], "no int, raw string")
    assert rejects.parse(df, "raw", F5, line_no="no").count() == 1
    assert rejects.parse(df.limit(0), "raw", F5).count() == 0
    with pytest.raises(ValueError):
        rejects.parse(df.withColumnRenamed("no", "id"), "raw", F5, keep=["id"])


@pytest.mark.parametrize("line,want", [('a,"b,c",d', ["a", "b,c", "d"]), ('"a""b"', ['a"b']), ('"a', None), ('a"b', None), ('"a"b', None), ("a\nb", None), ('"a\nb",c', ["a\nb", "c"]), ("", None), (",", ["", ""])])
def test_fields(line, want):
    assert fields_of(line) == want


def test_yaml_subset_agrees():
    for text in ["a: 1", "---\n:a: 1\n:b: x\n", "a:\n  b: 2\n", 'a: "x:y"\nb: [1, 2]', "42", "- a", "a: b: c", "---\n\ta: 1", ""]:
        assert (yamlish._subset(text) is None) == (yamlish.mapping(text) is None), text


def test_whole_numbers():
    assert rejects.whole_number("0" * 24 + "9" * 20) is None  # too large, however it begins
    assert rejects.whole_number("0" * 40 + "7") == "7" and rejects.whole_number("-" + "0" * 30) == "0" and rejects.whole_number("+12") == "12"
    assert rejects.whole_number(str(2**63 - 1)) == str(2**63 - 1) and rejects.whole_number(str(2**63)) is None
    assert rejects.whole_number(str(-(2**63))) == str(-(2**63)) and rejects.whole_number(str(-(2**63) - 1)) is None


def test_long_numbers_load(spark):
    df = spark.createDataFrame([(1, "0" * 24 + "9" * 20 + ",1,,,"), (2, "0" * 40 + "7,1,,,")], "n int, raw string")
    assert [r.id for r in rejects.load(df, "raw", F5).collect()] == [7]


@pytest.mark.parametrize("text", ["a: 1", "---\n:a: [x, y]\n", "{a: 1}", "[1]: 2", "{[1]: 2}", "a: b: c", "- a", "42", "a: 2024-13-45", "a: !!int x", "<<: 1", "a: 1\n---\nb: 2", "1: 2", "a: *b", "", "null", '{"a": 1', "a: &x {b: 1}\nc: *x"])
def test_mapping_told_from_structure(text):
    assert yamlish.is_mapping(text) == (yamlish.mapping(text) is not None)
