"""The lexer and the tree of brackets, against a scanner with a stack; nested calls against a search of all functions."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import rules, store
from ravelin.sources import swift, syntax

rng = random.Random(5)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("a // b\nc", "a     \nc"),
        ("a /* b /* c */ d */ e", "a                   e"),
        ("a /* b\n /* c\n */ d(\n */ e", "a     \n     \n      \n    e"),
        ("a /* open", "a        "),
        ('f("x { y")', 'f("     ")'),
        ('"a\\"b{" {', '"     " {'),
        ('"a \\(f("b") + g(1)) c" d', '"   (f(" ") + g(1))  " d'),
        ('x = """\n { "q" \\(n({ 1 }))\n """ + y', 'x = """\n        (n({ 1 }))\n """ + y'),
        ('#"a \\#(b(1)) c"# d', None),
        ('##"a "# b"## { c', None),
        ('#"""\n { \\n "\n"""# }', '#"""\n       \n"""# }'),
        ('"open {\nnext {', '"      \nnext {'),
        ('"" "" {', '"" "" {'),
        ("", ""),
    ],
)
def test_code_without_text(text, code):
    got = syntax.without_text(text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    if code is not None:
        assert got == code


def test_raw_strings():
    assert syntax.without_text('#"a \\(b) "c" "# d').split() == ['#"', '"#', "d"]
    assert syntax.without_text('#"a \\#(b(1)) c"# d').replace(" ", "") == '#"(b(1))"#d'
    assert syntax.without_text('##"a "# b"## { c').split() == ['##"', '"##', "{", "c"]


def pieces_of(code):
    import re

    return [p for p in re.split(r"([{}()\[\]\n])", "{" + code + "}") if p]


def tree(code):
    """(i, end, parent's i, head) of each bracket that opens, by a stack."""
    out, stack, heads = {}, [], [""]
    for i, p in enumerate(pieces_of(code)):
        if p in "{([":
            out[i] = [None, stack[-1] if stack else None, heads[-1]]
            stack.append(i)
            heads.append("")
        elif p in "})]":
            out[stack.pop()][0] = i
            heads.pop()
        elif p.strip():
            heads[-1] = p.strip()
    return out


def code(depth=0):
    parts = []
    for _ in range(rng.randrange(1, 4)):
        parts.append(rng.choice(["List ", "VStack ", "f", "x = 1\n", "\n", "if a "]))
        if depth < 5 and rng.random() < 0.7:
            a, b = rng.choice(["{}", "()", "[]"])
            parts.append(a + code(depth + 1) + b)
    return "".join(parts)


def test_tree_equals_a_stack(spark):
    texts = [(f"f{i}", code()) for i in range(30)]
    rows = syntax.with_parent(syntax.brackets(spark.createDataFrame(texts, "path string, text string"))).where("opens").collect()
    got = {}
    for r in rows:  # numbers count pieces that are not empty in both
        got.setdefault(r.file, []).append((r.i, r.end, r.parent.i if r.parent else None, r.piece))
    for path, text in texts:
        want = tree(text)
        mine = sorted(got[path])
        place = {i: n for n, (i, *_) in enumerate(mine)}
        theirs = sorted((i, *v) for i, v in want.items())
        order = {i: n for n, (i, *_) in enumerate(theirs)}
        assert [place.get(p) for _, _, p, _ in mine] == [order.get(p) for _, _, p, _ in theirs]
        assert all(e is not None for _, e, _, _ in mine) and len(mine) == len(theirs)


def test_nearest_view_and_words_of_a_block(spark):
    text = "\n".join([
        "func f() {", "    out.reserveCapacity(3)", "    if a {", "        for x in xs {", "            out.append(x)", "        }", "    }", "    for y in ys {", "    }", "}",
        "List {", "    VStack(spacing: 3) {", "        g {", "            ForEach(xs) {", "            }", "        }", "    }", "    ForEach(ys) {", "    }", "}", "ForEach(zs) {", "}",
    ])
    name = F.regexp_extract("head", r"\b(List|VStack)$", 1)
    got = {r.pos + 1: r for r in syntax.contexts(spark.createDataFrame([("a", text), ("b", None)], "path string, text string"), ("reserveCapacity",), ("append",), F.when((F.col("piece") == "{") & (name != ""), name)).where("file = 'a'").collect()}
    assert got[8].before == ["reserveCapacity"] and got[4].before == [] and got[21].before == ["reserveCapacity"]  # by block, not by lines
    assert got[5].within == ["append"] and got[4].within == ["append"] and got[8].within == ["append"] and got[12].within == []
    assert (got[14].container, got[18].container, got[21].container) == ("VStack", "List", None)
    assert (got[12].head, got[13].head) == ("VStack", "g")


FAR = "\n".join(f"    step({i})" for i in range(60))


CASES = [
    ("PERF-004", f"func f() {{\n    out.reserveCapacity(9)\n{FAR}\n    for x in xs {{\n        out.append(x)\n    }}\n}}", []),
    ("PERF-004", "func g() {\n    out.reserveCapacity(9)\n}\nfunc f() {\n    for x in xs {\n        out.append(x)\n    }\n}", [5]),
    ("SUI-005", f"LazyVStack {{\n{FAR}\n    ForEach(xs) {{ row($0) }}\n}}", []),
    ("SUI-005", "List {\n    a\n}\nVStack {\n    ForEach(xs) { row($0) }\n}", [5]),
    ("SUI-005", "VStack {\n    List {\n        ForEach(xs) { row($0) }\n    }\n}", []),
    ("A11Y-001", f"VStack {{\n    Image(a)\n{FAR}\n    x.accessibilityLabel(b)\n}}", []),
    ("A11Y-001", "VStack {\n    Image(a)\n}\nText(b).accessibilityLabel(c)", [2]),
    ("A11Y-001", "VStack {\n    Image(a)\n        .accessibilityLabel(b)\n    Image(c).resizable()\n}", [4]),
    ("A11Y-004", f"VStack {{\n    Button(a)\n{FAR}\n    x.frame(height: 20)\n}}", [1, 63]),
    ("A11Y-004", "func f() {\n    Button(a)\n}\nfunc g() {\n    x.frame(height: 20)\n}", []),
    ("MEM-001", "let completion = 1\nrun {\n    self.go()\n}", []),
    ("MEM-001", "load(handler:\n    {\n        self.go()\n    })", [2]),
    ("NET-001", "let s: CFSocket = a\nlet t = 1", [1]),
    ("STR-001", 'func f() {\n    let d = at(.documentDirectory)\n    put(d, "cache")\n}', [1]),
    ("STR-001", 'while a {\n    put(.documentDirectory, "temp")\n}', [1, 2]),
    ("NET-003", 'let s = """\nftp://10.1.2.3/x\n"""\nlet t = """\n10.1.2.3\n"""', [1]),
    ("MEM-001", "class A {\n    func f() {\n        completion = 1\n        self.go()\n    }\n}", []),
    ("PERF-005", "func f() {\n    for x in xs {\n        await a.b()\n        await c.d()\n    }\n}", [2]),
]
BAD = "class A: ObservableObject {\n    var delegate: D?\n    func f() {\n        for x in xs {\n            out.append(await x.y)\n        }\n        let c = try? decoder.decode(A.self)\n        NavigationView { }\n    }\n}"
HIDDEN = {"comment": f"/*\n{BAD}\n/* nested */\n{BAD}\n*/\nlet x = 1", "string": f'let s = """\n{BAD}\n"""', "slashes": "\n".join("// " + x for x in BAD.split("\n")), "code": BAD}


@pytest.fixture(scope="module")
def issues(spark):
    """What all rules find in all texts."""
    texts = [(f"case{i}.swift", text) for i, (_, text, _) in enumerate(CASES)] + [(f"{name}.swift", text) for name, text in HIDDEN.items()]
    return rules.findings(spark.createDataFrame(texts, "path string, text string")).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules_see_the_tree(issues, i):
    rule, _, lines = CASES[i]
    assert sorted({r.line for r in issues if r.rule == rule and r.file == f"case{i}.swift"}) == lines


def test_no_findings_in_comments(issues):
    of_lines = {r.id for r in rules.RULES if r.kinds == rules.LINE}
    count = {name: sum(r.file == f"{name}.swift" and r.rule not in of_lines for r in issues) for name in HIDDEN}
    assert count.pop("code") >= 6 and set(count.values()) == {0}


def test_awaits_are_counted(issues):
    assert ["2 await" in r.message for r in issues if r.rule == "PERF-005" and r.file == f"case{len(CASES) - 1}.swift"] == [True]


def test_declarations_in_comments_and_strings(spark):
    text = '/* class A {\n} */\nclass B {\n    let s = """\n    func g() {\n    """\n    func h() { "\\(call(1))" }\n}\n'
    sources = spark.createDataFrame([("a.swift", text)], "path string, text string")
    assert sorted((r.name, r.line, r.end_line) for r in swift.declarations(sources).collect()) == [("B", 3, 8), ("h", 7, 7), ("s", 4, 4)]
    assert [r.name for r in swift.calls(sources).collect() if r.name != "h"] == ["call"]


def test_callers_equal_a_search(spark):
    calls, functions = [], []
    for file in ("a", "b"):
        functions += [(file, f"{file}{i}", (s := rng.randrange(1, 60)), s + rng.choice([0, 1, 5, 30])) for i in range(40)]
        calls += [(file, rng.randrange(1, 95), rng.choice("xyz")) for _ in range(120)]
    calls += [("c", 3, "x")]
    got = store.enclosing(spark.createDataFrame(calls, "file string, line int, name string"), spark.createDataFrame(functions, "file string, id string, line int, end_line int"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()

    def caller(file, line):
        around = [(s, i) for f, i, s, e in functions if f == file and s <= line <= e]
        return min(around)[1] if around else f"ts::{file}::__top_level__::0"

    assert sorted((r.file, r.line, r.name, r.caller) for r in got.collect()) == sorted({(f, n, x, caller(f, n)) for f, n, x in calls})


def test_callers_of_a_large_file(spark):
    n = 100_000
    functions = spark.range(n).select(F.lit("a").alias("file"), F.concat(F.lit("f"), "id").alias("id"), (3 * F.col("id")).cast("int").alias("line"), (3 * F.col("id") + 1).cast("int").alias("end_line"))
    calls = spark.range(n).select(F.lit("a").alias("file"), (3 * F.col("id") + F.col("id") % 3).cast("int").alias("line"), F.lit("g").alias("name"))
    r = store.enclosing(calls, functions).agg(F.count_if(F.col("caller") == F.concat(F.lit("f"), (F.col("line") / 3).cast("int").cast("string"))), F.count_if(F.col("caller").startswith("ts::"))).first()
    assert tuple(r) == (n - n // 3, n // 3)
