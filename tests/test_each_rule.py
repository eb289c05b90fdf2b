"""Each of the rules on a text that it finds fault with and on one that it does not."""

import pytest
from pyspark.sql import functions as F

from ravelin.operators import rules
from ravelin.sources import swift

CASES = {
    "CONC-001": ("class A: ObservableObject {\n    var x = 1\n}", "@MainActor\nfinal class A: ObservableObject {\n    var x = 1\n}"),
    "CONC-002": ("func f() {\n    Task {\n        self.go()\n    }\n}", "func f() {\n    Task { [weak self] in\n        self?.go()\n    }\n}"),
    "CONC-003": ("func f() {\n    Task.detached {\n        self.go()\n    }\n}", "func f() {\n    Task.detached {\n        go()\n    }\n}"),
    "CONC-004": ("func f() {\n    for x in xs {\n        await MainActor.run { show(x) }\n    }\n}", "func f() {\n    for x in xs {\n        show(x)\n    }\n}"),
    "CONC-005": ("class A {\n    var n = 0\n    func f() {\n        Task {\n            go()\n        }\n    }\n}", "class A {\n    let n = 0\n    func f() {\n        var local = 1\n        Task {\n            go()\n        }\n    }\n}"),
    "CONC-006": ("class A {\n    var job: Task<Void, Never>?\n}", "class A {\n    var job: Task<Void, Never>?\n    func stop() {\n        job.cancel()\n    }\n}"),
    "CONC-007": ("actor A {\n    nonisolated func f() {\n        self.go()\n    }\n}", "actor A {\n    nonisolated func f() {\n        go()\n    }\n}"),
    "MEM-001": ("func f() {\n    completion = {\n        self.go()\n    }\n}", "func f() {\n    completion = { [weak self] in\n        self?.go()\n    }\n}"),
    "MEM-002": ("class A {\n    var delegate: D?\n}", "class A {\n    weak var delegate: D?\n}"),
    "MEM-003": ("let t = Timer.scheduledTimer(withTimeInterval: 9)", "let t = Timer.scheduledTimer(withTimeInterval: 9)\nt.invalidate()"),
    "MEM-004": ("NotificationCenter.default.addObserver(x)", "NotificationCenter.default.addObserver(x)\nNotificationCenter.default.removeObserver(x)"),
    "MEM-005": ("func f() {\n    model.observe(\\.x) { go() }\n}", "func f() {\n    let token = model.observe(\\.x) { go() }\n}"),
    "MEM-006": ("func f() {\n    manager.requestImage(for: a)\n}", "func f() {\n    manager.requestImage(for: a)\n    manager.cancelImageRequest(i)\n}"),
    "SEC-001": ('let apiKey = "abcdefgh12345"', '// apiKey = "abcdefgh12345"'),
    "SEC-002": ('UserDefaults.standard.set(x, forKey: "token")', 'UserDefaults.standard.set(x, forKey: "theme")'),
    "SEC-003": ("print(password)", "print(title)"),
    "SEC-004": ('let u = "http://example.com"', 'let u = "http://localhost:80"'),
    "SEC-005": ("func f() {\n    let s = String(format: pattern, x)\n}", 'func f() {\n    let s = String(format: "%d", x)\n}'),
    "SEC-006": ("class A: URLSessionDelegate {\n    func urlSession(didReceive c: C) {\n        done(.useCredential)\n    }\n}", "class A: URLSessionDelegate {\n    func urlSession(didReceive c: C) {\n        check(SecTrust)\n        done(.useCredential)\n    }\n}"),
    "PERF-001": ("struct A {\n    let a: Int\n    let b: Int\n    let c: Int\n    let d: Int\n}", "struct A {\n    let a: Int\n    func f() {\n        let b = 1\n        let c = 1\n        let d = 1\n        let e = 1\n    }\n}"),
    "PERF-002": ("run { [weak self] in\n    guard let self else { return }\n}", "run { [weak self] in\n    self?.go()\n}"),
    "PERF-003": ("let xs: [any P] = []", "let xs: [P] = []"),
    "PERF-004": ("func f() {\n    for x in xs {\n        out.append(x)\n    }\n}", "func f() {\n    out.reserveCapacity(9)\n    for x in xs {\n        out.append(x)\n    }\n}"),
    "PERF-005": ("func f() {\n    for x in xs {\n        await store.put(x)\n    }\n}", "func f() {\n    for x in xs {\n        store.put(x)\n    }\n}"),
    "PERF-006": ("struct A {\n    var a: [Int]\n    var b: Int\n    var c: Int\n}", "struct A {\n    var a: Int\n    var b: Int\n    var c: Int\n}"),
    "SUI-001": ("struct V: View {\n    var body: some View {\n" + "        Text(a)\n" * 61 + "    }\n}", "struct V: View {\n    var body: some View {\n        Text(a)\n    }\n}"),
    "SUI-002": ("func f() {\n    x.onAppear { let d = JSONDecoder() }\n}", "func f() {\n    x.onAppear { go() }\n}"),
    "SUI-003": ("struct A {\n    var a: Int\n    var b: Int\n    var c: Int\n}", "struct A: Equatable {\n    var a: Int\n    var b: Int\n    var c: Int\n}"),
    "SUI-004": ("struct V {\n    @StateObject\n    var m = Model()\n}", "struct V {\n    @State\n    var m = Model()\n}"),
    "SUI-005": ("VStack {\n    ForEach(xs) { row($0) }\n}", "LazyVStack {\n    ForEach(xs) { row($0) }\n}"),
    "SUI-006": ("struct V {\n    var body: some View {\n        Text(DateFormatter().string(d))\n    }\n}", "struct V {\n    var body: some View {\n        Text(s)\n    }\n}"),
    "ARCH-001": ("struct V {\n    var body: some View {\n        load(URLSession.shared)\n    }\n}", "struct V {\n    var body: some View {\n        Text(s)\n    }\n}"),
    "ARCH-002": ("struct V {\n    var body: some View {\n" + "        Text(a)\n" * 101 + "    }\n}", "struct V {\n    var body: some View {\n" + "        Text(a)\n" * 61 + "    }\n}"),
    "ARCH-003": ("struct V {\n    @EnvironmentObject\n    var m: Model\n}", "struct V {\n    @Environment\n    var m: Model\n}"),
    "ARCH-004": ("struct V: View {\n" + "".join(f"    @State var s{i} = 0\n" for i in range(6)) + "}", "struct V: View {\n    @State var s = 0\n}"),
    "ARCH-005": ("class A {\n    @Published var x = 0\n}", "class A: ObservableObject {\n    @Published var x = 0\n}"),
    "NET-001": ("func f() {\n    SCNetworkReachabilityCreateWithName(a, b)\n}", "func f() {\n    NWPathMonitor()\n}"),
    "NET-002": ("func f() {\n    let d = try? URLSession.shared.data(from: u)\n}", "func f() {\n    let d = try URLSession.shared.data(from: u)\n}"),
    "NET-003": ('let u = "ftp://10.1.2.3/x"', 'let u = "ftp://127.0.0.1/x"'),
    "NET-004": ("func f() {\n    if isConnected {\n        fetch()\n    }\n}", "func f() {\n    if isConnected {\n        show()\n    }\n}"),
    "NET-005": ("func f() {\n    let c = URLSession(configuration: URLSessionConfiguration.default)\n}", "func f() {\n    let c = make(URLSessionConfiguration.default, timeoutInterval: 5)\n}"),
    "NET-006": ("func f() {\n    URLSession.shared.uploadTask(with: r)\n}", "func f() {\n    URLSession.shared.dataTask(with: r)\n}"),
    "COD-001": ("func f() {\n    let d = try JSONSerialization.data(withJSONObject: o)\n}", "func f() {\n    let d = try JSONEncoder().encode(o)\n}"),
    "COD-002": ("func f() {\n    let x = try? decoder.decode(A.self, from: d)\n}", "func f() {\n    let x = try decoder.decode(A.self, from: d)\n}"),
    "COD-003": ("struct A {\n    var at: Date\n}\nfunc f() {\n    let d = JSONDecoder()\n}", "struct A {\n    var at: Date\n}\nfunc f() {\n    let d = JSONDecoder()\n    d.dateDecodingStrategy = x\n}"),
    "COD-004": ("struct A {\n    enum CodingKeys {\n" + "".join(f"        case k{i}\n" for i in range(11)) + "    }\n}", "struct A {\n    enum CodingKeys {\n        case k\n    }\n}"),
    "COD-005": ("struct A {\n    init(from decoder: Decoder) {\n" + "".join(f"        k{i} = try c.decode(I.self)\n" for i in range(4)) + "    }\n}", "struct A {\n    init(from decoder: Decoder) {\n" + "".join(f"        k{i} = try c.decodeIfPresent(I.self)\n" for i in range(4)) + "    }\n}"),
    "NRG-001": ("func f() {\n    Timer.scheduledTimer(withTimeInterval: 0.1)\n}", "func f() {\n    Timer.scheduledTimer(withTimeInterval: 60)\n}"),
    "NRG-002": ("func f() {\n    Timer.scheduledTimer(withTimeInterval: 60) { refresh() }\n}", "func f() {\n    Timer.scheduledTimer(withTimeInterval: 60) { tick() }\n}"),
    "NRG-003": ("func f() {\n    m.startUpdatingLocation()\n}", "func f() {\n    m.desiredAccuracy = a\n    m.startUpdatingLocation()\n}"),
    "NRG-004": ("func f() {\n    let l = CADisplayLink(target: x)\n}", "func f() {\n    let l = CADisplayLink(target: x)\n    l.invalidate()\n}"),
    "NRG-005": ("func f() {\n    app.beginBackgroundTask(withName: n)\n}", "func f() {\n    app.beginBackgroundTask(withName: n, expirationHandler: h)\n}"),
    "NRG-006": ("func f() {\n    let c = URLSession(configuration: URLSessionConfiguration.default)\n}", "func f() {\n    let c = URLSession(configuration: URLSessionConfiguration.default)\n    c.waitsForConnectivity = true\n}"),
    "NRG-007": ("func f() {\n    q.asyncAfter(deadline: .now() + 0.1) { go() }\n}", "func f() {\n    q.asyncAfter(deadline: .now() + 60) { go() }\n}"),
    "NRG-008": ("func f() {\n    let m = CLLocationManager()\n}", "func f() {\n    let m = CLLocationManager()\n    m.desiredAccuracy = a\n}"),
    "STR-001": ("func f() {\n    let cache = url(for: .documentDirectory)\n}", "func f() {\n    let notes = url(for: .documentDirectory)\n}"),
    "STR-002": ("func f() {\n    data.write(to: url(for: .applicationSupportDirectory))\n}", "func f() {\n    data.write(to: url(for: .applicationSupportDirectory))\n    v.isExcludedFromBackup = true\n}"),
    "STR-003": ("func f() {\n    token.write(to: u)\n}", "func f() {\n    token.write(to: u, options: .completeFileProtection)\n}"),
    "STR-004": ("func f() {\n    UserDefaults.standard.set(imageData, forKey: k)\n}", "func f() {\n    UserDefaults.standard.set(flag, forKey: k)\n}"),
    "A11Y-001": ("func f() {\n    Image(name)\n}", "func f() {\n    Image(name)\n        .accessibilityLabel(t)\n}"),
    "A11Y-002": ("func f() {\n    x.font(.system(size: 12))\n}", "func f() {\n    x.font(.custom(n, size: 12, relativeTo: .body))\n}"),
    "A11Y-003": ("func f() {\n    x.foregroundColor(ok ? .green : .red)\n}", "func f() {\n    x.foregroundColor(ok ? a : b)\n}"),
    "A11Y-004": ("func f() {\n    Button(t) { go() }\n        .frame(width: 90, height: 20)\n}", "func f() {\n    Button(t) { go() }\n        .frame(width: 90, height: 44)\n}"),
    "TST-001": ("func testA() {\n    sleep(1)\n    XCTAssert(x)\n}", "func testA() {\n    XCTAssert(x)\n}"),
    "TST-002": ("func testA() {\n    go()\n}", "@Test\nfunc a() {\n    #expect(x)\n}"),
    "TST-003": ("class A: XCTestCase {\n    static var shared = 1\n}", "class A: XCTestCase {\n    static let shared = 1\n}"),
    "TST-004": ("func testA() {\n" + "    XCTAssert(x!)\n" * 6 + "}", 'func testA() {\n' + '    load(Bundle.main.url(n)!)\n' * 6 + "    XCTAssert(x!)\n}"),
    "TST-005": ("import XCTest\nfunc testA() {\n    XCTAssert(x)\n}", "import Testing\nfunc testA() {\n    XCTAssert(x)\n}"),
    "MOD-001": ("class A: ObservableObject {\n}", "class A {\n}"),
    "MOD-002": ("struct V {\n    @StateObject\n    var m = Model()\n}", "struct V {\n    @State\n    var m = Model()\n}"),
    "MOD-003": ("struct V {\n    @ObservedObject\n    var m: Model\n}", "struct V {\n    @Bindable\n    var m: Model\n}"),
    "MOD-004": ("func f() {\n    x.onChange(of: v, perform: g)\n}", "func f() {\n    x.onChange(of: v) { g() }\n}"),
    "MOD-005": ("NavigationView {\n    go()\n}", "NavigationStack {\n    go()\n}"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{'UnitTests' if r.startswith('TST') else 'Sources'}/{r}.{kind}.swift", text) for r, both in CASES.items() for kind, text in zip(("bad", "good"), both)]
    issues = rules.findings(spark.createDataFrame(rows, "path string, text string")).collect()
    return {(i.rule, i.file.split("/")[1]) for i in issues}, issues


def test_every_rule_has_cases():
    assert set(CASES) == {r.id for r in rules.RULES}


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule(found, rule):
    assert (rule, f"{rule}.bad.swift") in found[0]
    assert (rule, f"{rule}.good.swift") not in found[0]


def test_the_first_word_of_the_list_is_named(found, spark):
    assert {i.message for i in found[1] if i.rule == "SEC-002"} == {"sensitive data (`token`) in plain user defaults"}
    both = spark.createDataFrame([("a.swift", 'UserDefaults.standard.set(password, forKey: "token")')], "path string, text string")
    assert [i.message for i in rules.audit(both, "security").where("rule = 'SEC-002'").collect()] == ["sensitive data (`token`) in plain user defaults"]


def test_attributes_of_the_lines_before(spark):
    text = "@MainActor\n@available(iOS 17, *)\n// note\n\nfinal class A {\n    @Published\n    private var x = 1\n    var y = 2\n}\nclass B {\n}"
    got = swift.declarations(spark.createDataFrame([("a.swift", text)], "path string, text string")).select("name", "attributes").where(F.col("name").isin("A", "x", "y", "B")).collect()
    assert {r.name: r.attributes for r in got} == {"A": ["@MainActor", "@available(iOS 17, *)"], "x": ["@Published"], "y": [], "B": []}
