import json

from lodestrata.operators.nested import flat_tables

FILE = {"id": "x", "filename": "f", "size": 3, "state": None}


def test_all_shapes(spark):
    answers = [
        (1, json.dumps([{"username": "a", "directories": [{"directory": "d", "files": [None, FILE, "s", 4]}]}])),
        (2, '[{"username"'), (3, json.dumps({"directories": {"files": FILE}}) + " rest"), (4, json.dumps({"directories": {"directory": "d", "files": FILE}})),
        (5, json.dumps(json.dumps([{"directories": [None, {"files": [FILE]}]}]))), (6, ""), (7, None), (8, "<html>"), (9, "null"), (10, "[]"),
        (11, "﻿" + json.dumps([{"username": "b", "directories": [{"files": [FILE]}, {"files": None}, {}]}])),
        (12, json.dumps({"users": [{"username": "c", "directories": [{"files": [FILE]}]}]})),
        (13, json.dumps([{"directories": [{"files": [FILE] * 5000}]}])), (13, json.dumps([{"directories": [{"files": [FILE]}]}])),
    ]
    df = spark.createDataFrame([(i, p, "u") for i, p in answers], "snapshot_id long, payload string, username string")
    t = flat_tables(df, ["snapshot_id"], "payload")
    got = [tuple(r) for r in t["files"].select("snapshot_id", "user_no", "directory_no", "file_no").collect()]
    assert sorted(x for x in got if x[0] != 13) == [(1, 0, 0, 1), (4, 0, 0, 0), (5, 0, 1, 0), (11, 0, 0, 0), (12, 0, 0, 0)]
    assert sum(x[0] == 13 for x in got) == 5001
    assert t["directories"].where("snapshot_id = 11").count() == 3 and t["users"].where("snapshot_id = 10").count() == 0
    assert flat_tables(df.limit(0), ["snapshot_id"], "payload")["files"].count() == 0


def test_any_wrapper_and_repeated_keys(spark):
    one = {"username": "a", "directories": [{"directory": "d", "files": [FILE, FILE]}]}
    two = [(i, 0, 0, k) for i in range(9) for k in (0, 1)]
    answers = [
        json.dumps({"data": {"users": [one]}}), json.dumps({"items": [one]}), json.dumps({"results": {"users": [one]}}), json.dumps({"a": {"b": {"c": {"d": [one]}}}}),
        json.dumps({"body": json.dumps({"anything": [one]})}), json.dumps(json.dumps(json.dumps([one]))), json.dumps(one)[:-1] + ', "username": "b"}', json.dumps([{"user": one}]),
        json.dumps({"count": 1, "note": "[not json", "list": [one]}), json.dumps([one]) + "]", json.dumps([one]) + "}", "[" + json.dumps(one) + ",",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "snapshot_id long, payload string")
    tables = flat_tables(df, ["snapshot_id"], "payload")
    assert sorted(tuple(r) for r in tables["files"].select("snapshot_id", "user_no", "directory_no", "file_no").collect()) == two
    assert [r["username"] for r in tables["users"].where("snapshot_id = 6").collect()] == ["b"]


def test_the_answer_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "[]")], "snapshot_id long, payload string")
    for name, t in flat_tables(df, ["snapshot_id"], "payload").items():
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("parseJson") + plan.count("parse_json") <= 5, (name, plan)
