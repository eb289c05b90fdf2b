import json
import subprocess

import pytest
from pyspark.sql import functions as F

from ravelin.sources import index_dump, project, swift

OCCURRENCE = "usr string, name string, kind int, properties long, roles long, file string, line int, col int, relations array<struct<usr:string,kind:int,roles:long>>"


def test_index_dump(spark):
    rows = [
        ("s:A", "A", 7, (1 << 19) | (1 << 18), 2, "A.swift", 1, 1, [("s:P", 8, 1 << 10), ("s:B", 7, 1 << 10)]),
        ("s:f", "f", 16, 1 << 18, 2, "A.swift", 3, 5, [("s:A", 7, 1 << 9), ("s:g", 16, (1 << 11) | (1 << 13)), ("", 7, 1 << 9)]),
        ("s:x", "x", 99, 0, 4, "A.swift", 4, 1, [("s:E", 9, 1 << 14)]),
    ]
    dump = spark.createDataFrame(rows, OCCURRENCE)
    assert {(r.id, r.kind, r.access_level) for r in index_dump.definitions(dump).collect()} == {("s:A", "class", "Public"), ("s:f", "function", "FilePrivate")}
    edges = {(r.source, r.target, r.kind) for r in index_dump.relations(dump).collect()}
    assert edges == {("s:A", "s:P", "conformsTo"), ("s:A", "s:B", "inheritsFrom"), ("s:f", "s:A", "contains"), ("s:f", "s:g", "overrides"), ("s:g", "s:f", "calls"), ("s:E", "s:x", "extendsType")}
    levels = dump.select(index_dump.access_level(F.col("properties"), parity=True).alias("a")).collect()
    assert [r.a for r in levels] == ["Public", "Public", "Internal"]
    units = spark.createDataFrame([("u", "A.swift", False, ["r1", "r1"]), ("v", "A.m", False, ["r2"]), ("w", "B.swift", True, ["r3"])], "name string, main_file string, is_system boolean, records array<string>")
    assert [r.record for r in index_dump.records(units).collect()] == ["r1"]


def test_project(tmp_path):
    with pytest.raises(FileNotFoundError):
        project.project_type(tmp_path)
    (tmp_path / "Package.swift").write_text("")
    assert project.project_type(tmp_path) == "spm"
    (tmp_path / "project.yml").write_text("")
    assert project.project_type(tmp_path) == "xcodegen"
    at = tmp_path / "conf" / "config.json"
    assert project.Config.load(at) == project.Config()
    project.Config(include=["Sources/**"]).save(at)
    project.Config().save(at)
    assert project.Config.load(at).include == ["Sources/**"]
    at.write_text("not json")
    assert project.Config.load(at) == project.Config()
    json.dumps(project.Config().__dict__)


def test_changed_files(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "A.swift").write_text("1")
    (tmp_path / "b.txt").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "A.swift").write_text("2")
    (tmp_path / "b.txt").write_text("2")
    assert project.changed(tmp_path) == ["A.swift"]
    assert project.changed(tmp_path, "staged") == []


def test_reading_files(spark, tmp_path):
    for p, x in (("Sources/A.swift", "struct A {}\n"), ("Pods/B.swift", "x"), ("Sources/note.md", "x")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(x)
    got = swift.read(spark, str(tmp_path)).collect()
    assert [r.path.split("/")[-1] for r in got] == ["A.swift"] and got[0].text == "struct A {}\n"
    one = swift.snippet(swift.read(spark, str(tmp_path)), got[0].path, 1).first()
    assert one.snippet == "struct A {}"


def test_index_store_of_a_project(tmp_path):
    root, home = tmp_path / "App", tmp_path / "home"
    root.mkdir()
    (root / "project.yml").write_text("")
    assert project.index_store(root, home) is None
    old = home / "Library/Developer/Xcode/DerivedData/App-abc/Index/DataStore"
    old.mkdir(parents=True)
    assert project.index_store(root, home) == old
    new = old.parent.parent / "Index.noindex/DataStore"
    new.mkdir(parents=True)
    assert project.index_store(root, home) == new
    (root / "project.yml").unlink()
    (root / "Package.swift").write_text("")
    assert project.index_store(root, home) is None
    (root / ".build/index/store").mkdir(parents=True)
    assert project.index_store(root, home) == root / ".build/index/store"


def test_sources_of_a_project(spark, tmp_path):
    for path in ("Sources/A.swift", "Sources/B.swift", "Pods/C.swift", "Sources/notes.md"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("let x = 1")
    names = lambda config: {r.path.split("/")[-1] for r in project.sources(spark, tmp_path, config).collect()}
    assert names(None) == {"A.swift", "B.swift"}
    assert names(project.Config(exclude=[])) == {"A.swift", "B.swift", "C.swift"}
    assert names(project.Config(include=["**/A.swift"])) == {"A.swift"}
