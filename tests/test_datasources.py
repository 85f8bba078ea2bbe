"""Archives, saved pages and the graph sink, against files written here; nested answers row by row."""

import csv
import hashlib
import io
import json
import os
import zipfile

import pytest
from corpusforge.operators import semi as J
from corpusforge.sources import datasources as D
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def known(spark):
    D.register(spark)
    return spark


def archive(folder, name, members):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
        for inner, text in members.items():
            z.writestr(inner, text)


def as_csv(rows):
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return "﻿" + out.getvalue()


@pytest.fixture
def folder(tmp_path):
    rows = [(k % 2, f"review {k}, \"quoted\"\nsecond line" if k else "") for k in range(9000)]
    archive(tmp_path, "a.zip", {"read.me": "x", "inner/a.csv": as_csv([("label", "review"), *rows]), "z.csv": "never,read\n1,2\n"})
    archive(tmp_path, "b.zip", {"b.CSV": as_csv([("review", "label"), ("same", 1), ("same", 1), ("other", 0), ("", "")])})
    archive(tmp_path, "none.zip", {"only.txt": "x"})
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_archives_are_read_a_partition_each(known, folder):
    os.remove(folder / "bad.zip")
    rows = known.read.format("archive_csv").option("path", str(folder)).load()
    assert rows.columns == ["archive", "row", "label", "review"] and rows.rdd.getNumPartitions() == 3
    found = {(r.archive, r.row): (r.label, r.review) for r in rows.collect()}
    assert len(found) == 9004
    assert found["a.zip", 0] == ("0", None) and found["a.zip", 8999] == ("1", 'review 8999, "quoted"\nsecond line')
    assert found["b.zip", 0] == ("1", "same") and found["b.zip", 3] == (None, None)  # columns by name, empty fields null
    named = known.read.format("archive_csv").option("path", str(folder)).schema("archive string, row bigint, review string, absent string").load()
    assert {r.absent for r in named.where("row < 5").collect()} == {None} and named.count() == 9004
    empty = known.read.format("archive_csv").option("path", str(folder / "nowhere")).load()
    assert empty.count() == 0


def test_manifest_of_archives(known, folder):
    whole = known.read.format("archive_files").option("path", str(folder)).load()
    assert {r.archive: r.error is None for r in whole.collect()} == {"a.zip": True, "b.zip": True, "none.zip": False, "bad.zip": False}
    os.remove(folder / "bad.zip")
    got = {r.archive: r for r in D.archive_manifest(known, str(folder), "label").collect()}
    assert [got["none.zip"].ok, got["none.zip"].n_rows, got["none.zip"].error] == [False, None, "no csv or json in zip"]
    a, b = got["a.zip"], got["b.zip"]
    assert (a.ok, a.member, a.n_rows, a.n_columns, a.missing, a.duplicated) == (True, "inner/a.csv", 9000, 2, 1, 0)
    assert json.loads(a.labels) == {"0": 4500, "1": 4500} and json.loads(b.labels) == {"0": 1, "1": 2}
    assert (b.n_rows, b.missing, b.duplicated) == (4, 2, 1)
    for name in ("a.zip", "b.zip"):
        data = (folder / name).read_bytes()
        assert (got[name].md5, got[name].n_bytes) == (hashlib.md5(data).hexdigest(), len(data))


def test_exported_annotations_in_an_archive(known, tmp_path):
    tasks = [{"id": k, "data": {"sample_id": f"s{k}", "text": "t , ] }"}, "annotations": [{"completed_by": 3, "was_cancelled": k == 2, "result": [{"from_name": "sentiment", "value": {"choices": ["pos"]}}]}]} for k in range(300)]
    archive(tmp_path, "export.zip", {"x.json": json.dumps(tasks, indent=1)})
    values = known.read.format("archive_json").option("path", str(tmp_path)).load()
    rows = J.annotations(values.select(F.from_json("value", J.EXPORT).alias("t")).select("t.*"))
    assert sorted(r.task_id for r in rows.collect()) == [k for k in range(300) if k != 2] and rows.first().label == "pos"


def test_elements_of_json_over_block_borders(monkeypatch):
    values = [{"a": [1, {"b": "x,]"}]}, "text, with ] marks", 12345, -1.5e3, None, True, [], {}]
    for block in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(D, "BLOCK", block)
        assert [json.loads(x) for x in D.json_elements(io.StringIO("﻿" + json.dumps(values, indent=2)))] == values
        assert [json.loads(x) for x in D.json_elements(io.StringIO('{"one": [1]}'))] == [{"one": [1]}]
        assert list(D.json_elements(io.StringIO(" [ ] "))) == list(D.json_elements(io.StringIO(""))) == []
        with pytest.raises(ValueError):
            list(D.json_elements(io.StringIO('[{"a": 1}, {"b"')))


def test_saved_pages_stop_at_an_empty_one(known, tmp_path):
    for k, comments in enumerate([[{"commentId": 1}], [{"commentId": 2}, {"commentId": 3}], [], [{"commentId": 4}]]):
        (tmp_path / f"page-{k:04d}.json").write_text(json.dumps({"code": 200, "comments": comments}))
    pages = known.read.format("saved_pages").option("path", str(tmp_path)).load()
    assert pages.count() == 4 and pages.rdd.getNumPartitions() == 4
    assert sorted(r.page for r in D.until_empty(pages).collect()) == [0, 1]
    assert D.until_empty(pages.where("page < 2")).count() == 2
    (tmp_path / "page-0000.json").write_text("broken")
    assert D.until_empty(pages).count() == 0


def listed(path, kind):
    manifest = json.loads((path / f"{kind}.manifest.json").read_text())
    rows = [json.loads(line) for f in manifest["files"] for line in (path / f).read_text().splitlines()]
    assert len(rows) == manifest["rows"]
    return manifest["files"], rows


def test_graph_batches_commit_and_abort(known, tmp_path):
    edges = known.range(2600).selectExpr("'NEXT' AS type", "id AS src", "id + 1 AS dst").repartition(2)
    write = lambda df, mode, kind: df.write.format("graph_batches").option("path", str(tmp_path)).option("kind", kind).mode(mode).save()
    write(edges, "append", "edges")
    files, rows = listed(tmp_path, "edges")
    assert sorted(r["src"] for r in rows) == list(range(2600)) and len(files) == 4  # 1300 a task: 1000 and 300
    write(known.range(10).selectExpr("id", "'Day' AS label").coalesce(1), "append", "nodes")
    assert len(listed(tmp_path, "nodes")[1]) == 10
    before = sorted(os.listdir(tmp_path))
    # A failing task leaves nothing behind, in the list or beside it.
    failing = known.range(5000).coalesce(1).selectExpr("'X' AS type", "id AS src", "IF(id = 4999, raise_error('lost'), id) AS dst")
    with pytest.raises(Exception, match="lost"):
        write(failing, "append", "edges")
    assert sorted(os.listdir(tmp_path)) == before and listed(tmp_path, "edges")[0] == files
    with pytest.raises(Exception, match="lost"):  # the other task is stopped, wherever it is
        write(known.range(5000).repartition(3).selectExpr("'X' AS type", "id AS src", "IF(id = 4999, raise_error('lost'), id) AS dst"), "append", "edges")
    assert listed(tmp_path, "edges")[0] == files
    write(edges.limit(5), "append", "edges")
    assert len(listed(tmp_path, "edges")[1]) == 2605
    write(edges.limit(7), "overwrite", "edges")
    now, rows = listed(tmp_path, "edges")
    assert len(rows) == 7 and {f for f in os.listdir(tmp_path) if f.startswith("edges-")} >= set(now)


def test_answers_of_every_form(spark):
    forms = [
        ('["a", {"b": 1}, 3]', ["a", '{"b":1}', "3"]), ('{"results": ["x", "y", "z"]}', ["x", "y", "z"]), ('{"output": [1, 2, 3], "data": ["d", "e", "f"]}', ["d", "e", "f"]),
        ('```json\n{"segments": ["x/y", "z", ""]}\n```', ["x/y", "z", ""]), ('{"zz": 1, "second": ["s", "t", "u"], "first": ["a", "b", "c"]}', ["s", "t", "u"]),
        ('{"results": "no list", "other": [null, true, 1.5]}', ["null", "true", "1.5"]), ('["too", "few"]', None), ('{"a": 1}', None), ("words", None), ("", None), (None, None), ("7", None),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(forms)], "id long, answer string")
    got = {r.id: r for r in J.answers(df, "answer", F.lit(3)).collect()}
    for k, (answer, want) in enumerate(forms):
        assert (got[k].ok, got[k]["items"]) == (want is not None, want), answer
    assert got[6].n_items == 2 and got[8].n_items is None
    parts = {(r.key, r.kind): r.n_items for r in J.payload_parts(spark.createDataFrame([('{"entities": [1, 2], "rules": [], "model": "m", "n": 2}',)], "p string"), "p").collect()}
    assert parts == {("entities", "ARRAY"): 2, ("rules", "ARRAY"): 0, ("model", "STRING"): 1, ("n", "BIGINT"): 1}
