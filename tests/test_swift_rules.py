import json

import pytest
from pyspark.sql import functions as F

from ravelin.operators import rules, sinks, store
from ravelin.sources import swift

SERVICE = '''import Foundation

protocol UserService {
    func fetchUser() -> String
}

final class NetworkUserService: UserService, Sendable {
    private let url = "http://example.com/{not a brace}"
    func fetchUser() -> String {
        fetchItems()
        self.update()
        api.process(1) // ignored(2)
        return "x"
    }
    func update() { helper() }
}

extension String {
    func shout() -> String { uppercased() }
}
'''
DELEGATE = '''class Screen: UIViewController {
    var delegate: ScreenDelegate?
    weak var dataSource: ScreenDataSource?
    func save() {
        UserDefaults.standard.set(token, forKey: "auth")
        let local = "http://localhost:80"
        Task {
            self.reload()
        }
        for item in items {
            await MainActor.run { show(item) }
            list.append(item)
        }
        let x = try? decoder.decode(A.self, from: data)
    }
}
'''
TESTS = '''import XCTest
class ThingTests: XCTestCase {
    static var shared = 1
    func testNothing() {
        sleep(1)
    }
}
'''


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("Sources/Service.swift", SERVICE), ("Sources/Screen.swift", DELEGATE), ("App/Tests/ThingTests.swift", TESTS), ("Empty.swift", ""), ("Null.swift", None)]
    return spark.createDataFrame(rows, "path string, text string")


def test_declarations(sources):
    got = {(r.file.split("/")[-1], r.name): r for r in swift.declarations(sources).collect()}
    service = got["Service.swift", "NetworkUserService"]
    assert (service.kind, service.line, service.end_line, service.inherits) == ("class", 7, 16, ["UserService", "Sendable"])
    fetch = [r for r in swift.declarations(sources).where("name = 'fetchUser'").collect()]
    assert {(r.line, r.end_line) for r in fetch} == {(4, 4), (9, 14)}
    assert got["Service.swift", "update"].container == service.id
    assert got["Service.swift", "String"].kind == "extension"
    assert got["Service.swift", "url"].access_level == "Private"
    assert got["Screen.swift", "save"].end_line == 15


def test_graph(sources):
    nodes, edges = swift.graph(sources)
    e = {(r.source.split("::")[2], r.target, r.kind) for r in edges.collect()}
    for name in ("fetchItems", "update", "process"):
        assert ("fetchUser", f"name::{name}", "calls") in e
    assert ("NetworkUserService", "synthetic::UserService", "conformsTo") in e
    assert ("String", "synthetic::String", "extendsType") in e
    assert not any("ignored" in t for _, t, _ in e)
    resolved = store.resolve_names(edges, nodes).where("kind = 'calls'").collect()
    assert {(r.source.split("::")[2], r.target.split("::")[2]) for r in resolved} >= {("fetchUser", "update")}
    assert not any(r.target.startswith("name::") for r in resolved)


def found(issues, rule):
    return [r for r in issues if r.rule == rule]


def test_rules(sources):
    issues = rules.findings(sources).collect()
    assert len(found(issues, "MEM-002")) == 1 and found(issues, "MEM-002")[0].symbol == "delegate"
    assert [r.line for r in found(issues, "SEC-002")] == [5]
    assert [r.file for r in found(issues, "SEC-004")] == ["Sources/Service.swift"]
    for rule in ("CONC-001", "CONC-002", "CONC-004", "PERF-004", "PERF-005", "COD-002", "TST-001", "TST-002", "TST-003", "TST-005"):
        assert len(found(issues, rule)) >= 1, rule
    assert not found(issues, "CONC-005") or all(r.symbol == "Screen" for r in found(issues, "CONC-005"))
    assert {r.category for r in issues} <= set(rules.CATEGORIES)


def test_every_rule_is_there():
    ids = [r.id for r in rules.RULES]
    assert len(set(ids)) == 73
    per = {c: len({r.id for r in rules.RULES if r.category == c}) for c in rules.CATEGORIES}
    assert per == {"concurrency": 7, "memory": 6, "security": 6, "swift-performance": 6, "swiftui-performance": 6, "swiftui-architecture": 5, "networking": 6, "codable": 5, "energy": 8, "storage": 4, "accessibility": 4, "testing": 5, "modernization": 5}


def test_audit_options_and_sinks(sources, tmp_path):
    issues = rules.audit(sources, "security,memory", "medium", fixes=True)
    rows = issues.collect()
    assert {r.category for r in rows} <= {"security", "memory"} and all(r.severity != "low" for r in rows)
    with pytest.raises(ValueError):
        rules.chosen_rules("security,bogus")
    assert len(rules.chosen_rules("bogus", strict=False)) == len(rules.RULES)
    cut = rules.audit(sources, max_issues=5)
    assert cut.count() <= 5
    c = rules.by_severity(issues).first()
    assert c.total == len(rows)
    assert sinks.text_header(issues).startswith(f"{len(rows)} issues")
    assert sinks.text_lines(issues).count() == len(rows)
    whole = json.loads(sinks.sarif(issues))
    assert whole["version"] == "2.1.0" and len(whole["runs"][0]["results"]) == issues.count()
    assert len(json.loads(sinks.sarif(issues, most=1))["runs"][0]["results"]) == 1
    sinks.write_sarif_results(issues, str(tmp_path / "sarif"))
    written = [json.loads(r.value) for r in issues.sparkSession.read.text(str(tmp_path / "sarif")).collect()]
    assert sorted(map(str, written)) == sorted(map(str, whole["runs"][0]["results"]))


def test_line_split(spark):
    got = spark.createDataFrame([("a\r\nb\n",), ("",), ("x\n\n",)], "text string").select(swift.split_lines(F.col("text")).alias("l")).collect()
    assert [r.l for r in got] == [["a", "b"], [""], ["x", ""]]
