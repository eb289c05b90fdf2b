"""Swift-like source files written from the supplier table, one for each supplier.

What a file holds depends on its supplier's key and balance, so which findings
and symbols it has can be said in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file's lines; {0} is what comes with the line where it depends on the supplier.
LINES = (
    "import Foundation",
    "/* written by a program",
    "   /* let old = try? decoder.decode(A.self) */ var delegate: Old?",
    "   for x in xs { out.append(await x.load()) } */",
    "{0}class Supplier{1}: NSObject {",
    "    {0}var total = 0",
    "    {0}var delegate: SupplierDelegate?",
    '    let note = """',
    "        ForEach(xs) { Image(a) } func ghost() { \\(count(rows)) }",
    '        """',
    "    func load() {",
    "        {0}",
    "        for item in items {",
    "            out.append(item)",
    "            total += 1",
    "        }",
    "        let d = {0} decoder.decode(A.self, from: data)",
    "    }",
    "    func show() {",
    "        {0} {",
    "            ForEach(items) { row($0) }",
    "            Image(icon)",
    "            label.{0}(note)",
    "        }",
    "        completion = {0}",
    "            self.load()",
    "        }",
    "        let total = local(1)",
    "    }",
    "}",
    "extension Supplier{1} {",
    "    func poll() {",
    "        Timer.scheduledTimer(withTimeInterval: {0}, repeats: true) { _ in refresh() }",
    "        {0} { row(1) }",
    "        let f = Font.custom(name, size: 12{0})",
    "    }",
    "}",
)


def _chosen(key: Column, balance: Column) -> dict[int, Column]:
    """What stands at {0} in a line, by the line's number."""
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    return {
        5: either(balance > 5000, "@MainActor ", ""),
        6: either(key % 3 == 0, "@Published ", ""),
        7: either(key % 2 == 0, "weak ", ""),
        12: either(key % 4 == 0, "out.reserveCapacity(9)", "step(9)"),
        17: either(key % 5 == 0, "try?", "try"),
        20: either(key % 3 == 1, "LazyVStack", "VStack"),
        23: either(key % 2 == 1, "accessibilityLabel", "plain"),
        25: either(key % 7 == 0, "{ [weak self] in", "{"),
        33: either(key % 5 == 1, "0.5", "60"),
        34: either(key % 4 == 1, "NavigationView", "NavigationStack"),
        35: either(key % 2 == 0, ", relativeTo: .body", ""),
    }


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of the files."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, chosen = F.col("s_suppkey"), _chosen(F.col("s_suppkey"), F.col("s_acctbal"))
    lines = []
    for number, line in enumerate(LINES, 1):
        text = F.replace(F.lit(line), F.lit("{1}"), key.cast("string")) if "{1}" in line else F.lit(line)
        lines.append(F.replace(text, F.lit("{0}"), chosen[number]) if number in chosen else text)
    path = F.concat(F.lit("Sources/N"), F.col("s_nationkey").cast("string"), F.lit("/Supplier"), key.cast("string"), F.lit(".swift"))
    return rows.select(path.alias("path"), F.concat_ws("\n", *lines).alias("text"))


#: The files as SQL: put in front of a SELECT over swift_files (file, k, balance).
SQL = "WITH swift_files AS (SELECT 'Sources/N' || s_nationkey || '/Supplier' || s_suppkey || '.swift' AS file, s_suppkey AS k, s_acctbal AS balance FROM supplier) "
