import datetime as dt
import json

from tausift.operators.drift import changes_between, consistent_scores, enforce, field_profiles, first_names, ingest_rescued, previous_row, schema_changes
from tausift.sources.exports import kind_of, leading_number, parse_export, same_value

SCHEMA = "file_id long, board string, exported_at timestamp, payload string, extra string, g string"


def files(spark, rows):
    return spark.createDataFrame([(f, b, dt.datetime(2024, 1, day) if day else None, p, "x", "y") for f, b, day, p in rows], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in df.select("file_id", "change_kind", "old_field", "new_field").collect())


def test_parsing():
    e = parse_export('﻿"";" Model ";"jpn, x"\r\n"0";"a;b";"1,5"\r\n\r\n"1";c\r\n')
    assert e.fields == ("Model", "jpn, x")
    assert e.rows == ({"Model": "a;b", "jpn, x": "1,5"}, {"Model": "c"})
    assert parse_export(None).fields == parse_export(" \n").fields == ()
    assert parse_export("a\tb\n1\t2\t3").rows[0]["+1"] == "3"


def test_types_and_values():
    assert kind_of(["1", "2.5", "", "N/A", "nan", "--", "—", None]) == "number"
    assert kind_of(["1", "2.5 ± 0.1"]) == "text" and kind_of(["", None]) is None
    assert kind_of(["1,5"]) == kind_of(["-1"]) == kind_of(["~7"]) == "text"
    assert leading_number("~70.68") == (70.68, 2) and leading_number("96,03") == (96.03, 2) and leading_number("v1.5") is None
    assert same_value("46.975", "46.98 (dev)") and same_value("30.81%", "30.81") and not same_value("46.9", "47.9") and same_value("Spring ", "spring")


def test_rescue_keeps_every_cell():
    e = parse_export("Model,a,b\nm,1,x\nn,y,2\n")
    (fits, rest), (fits2, rest2) = enforce(e, {"Model": "text", "a": "number"})
    assert fits == {"Model": "m", "a": "1"} and json.loads(rest) == {"b": "x"}
    assert fits2 == {"Model": "n"} and json.loads(rest2) == {"a": "y", "b": "2"}


def test_changes():
    old = parse_export("Model,a,b,c,d\nm,1.234,5,7,1\nn,2.345,6,8,2\nk,3,9,9,3\n")
    new = parse_export("model;A2;b;e;d\nn;2.35;6;70;2 pts\nm;1.23;5;1;1 pts\nz;9;1;1;1 pts\n")
    assert sorted(changes_between(old, new)) == [("added", "", "e"), ("removed", "c", ""), ("renamed", "Model", "model"), ("renamed", "a", "A2"), ("retyped", "d", "d")]
    both = parse_export("Model,x\nm,1.2 ± 1\nn,2.3 ± 1\nk,3 ± 1\n")
    assert ("retyped", "a", "x") in changes_between(old, both) and ("renamed", "a", "x") in changes_between(old, both)


def test_report(spark):
    a, b = "Model,x\nm,1\nn,2\n", "Model,y\nm,1\nn,2\n"
    df = files(spark, [(1, "p", 2, b), (2, "p", 1, a), (3, "p", 3, b), (4, "q", 1, a), (5, None, 1, a), (6, "r", 1, a), (7, "r", 2, None), (8, "r", None, a), (9, "s", 1, a), (9, "s", 1, a)])
    got = found(schema_changes(df))
    assert got == [(1, "renamed", "x", "y"), (7, "removed", "Model", ""), (7, "removed", "x", "")]
    assert found(schema_changes(files(spark, []))) == []


def test_previous_row_crosses_days(spark):
    df = files(spark, [(k, "p", day, None) for k, day in ((1, 1), (2, 1), (3, 5), (4, 5), (5, 9))])
    assert sorted(tuple(r) for r in previous_row(df, "board", "exported_at", "file_id").collect()) == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_consistent_table(spark):
    df = files(spark, [(1, "p", 1, "Model,x\nm,1\nn,2\n"), (2, "p", 2, "Model,y\nm,1.0 pts\nn,2.0 pts\n"), (3, "p", 3, "Model,z\nm,1\nn,—\n")])
    got = sorted((r.file_id, r.model, r.field, r.written_field, r.score) for r in consistent_scores(df).collect())
    assert got == [(1, "m", "x", "x", 1.0), (1, "n", "x", "x", 2.0), (2, "m", "x", "y", 1.0), (2, "n", "x", "y", 2.0), (3, "m", "x", "z", 1.0)]
    names = {(r.field, r.first_field) for r in first_names(schema_changes(df), field_profiles(df)).collect()}
    assert names == {("x", "x"), ("y", "x"), ("z", "x")}
    assert consistent_scores(files(spark, [])).count() == 0


def test_no_cell_is_lost(spark):
    df = files(spark, [(1, "p", 1, "Model,x,note\nm,1,m\nn,2,fast\nk,v1,3\n"), (2, "p", 2, "Model,x,note,w\nm,1,m,7\nn,2,slow,8 pts\nk,9,z,\n")])
    got = sorted((r.file_id, r.model, r.field, r.score, r.text, r.rescued) for r in consistent_scores(df).collect())
    assert got == [
        (1, "k", "note", 3.0, None, None), (1, "k", "x", None, "v1", None), (1, "m", "note", None, "m", None), (1, "m", "x", 1.0, None, None), (1, "n", "note", None, "fast", None), (1, "n", "x", 2.0, None, None),
        (2, "k", "note", None, "z", None), (2, "k", "x", 9.0, None, None), (2, "m", "note", None, "m", None), (2, "m", "w", 7.0, None, None), (2, "m", "x", 1.0, None, None), (2, "n", "note", None, "slow", None), (2, "n", "w", 8.0, None, None), (2, "n", "x", 2.0, None, None),
    ]


def test_added_fields_are_promoted(spark):
    df = files(spark, [(1, "p", 1, "Model,b\nm,1\nn,2\n"), (2, "p", 2, "Model,b,c\nm,1,70\nn,2,80\n"), (3, "p", 3, "Model,a,c\nm,1,70 pts\nn,2,80\n")])
    got = sorted((r.file_id, r.model, r.field, r.score, r.rescued) for r in consistent_scores(df).collect())
    assert got == [(1, "m", "b", 1.0, None), (1, "n", "b", 2.0, None), (2, "m", "b", 1.0, None), (2, "m", "c", 70.0, None), (2, "n", "b", 2.0, None), (2, "n", "c", 80.0, None), (3, "m", "b", 1.0, "1"), (3, "m", "c", 70.0, "70 pts"), (3, "n", "b", 2.0, "2"), (3, "n", "c", 80.0, None)]


def test_previous_row_in_a_large_group(spark):
    df = files(spark, [(k, "p", 1 + k // 30, None) for k in range(1, 90)])
    assert sorted(tuple(r) for r in previous_row(df, "board", "exported_at", "file_id", most=10).collect()) == [(k, k - 1) for k in range(2, 90)]


def test_ingest_without_target_rescues_all(spark):
    df = files(spark, [(1, "p", 1, "Model,x\nm,1\n")])
    target = spark.createDataFrame([], "group string, fields map<string,string>")
    r = ingest_rescued(df, target).first()
    assert r.fits == {} and json.loads(r.rescued) == {"Model": "m", "x": "1"} and r.model == "m"
