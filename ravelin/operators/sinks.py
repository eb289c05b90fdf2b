"""Findings and rows as text, JSON and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.paths import basename
from ravelin.operators.rules import ORDER, by_severity, capped, severity_rank

#: SARIF's levels.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def as_json(rows: DataFrame) -> DataFrame:
    """One column json: each row as an object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def text_lines(issues: DataFrame) -> DataFrame:
    """One column line in report order: a line for each finding, with its fix."""
    fix = F.when(F.col("fix").isNotNull(), F.concat(F.lit("\n    Fix: "), "fix")).otherwise("")
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule", F.lit(" "), basename(F.col("file")), F.lit(":"), F.col("line").cast("string"), F.lit(" "), "message", fix)
    return issues.orderBy(F.desc(severity_rank()), *ORDER).select(line.alias("line"))


def text_header(issues: DataFrame) -> str:
    c = by_severity(issues).first()
    return f"{c.total} issues: {c.critical} critical, {c.high} high, {c.medium} medium, {c.low} low"


def sarif_rules(issues: DataFrame) -> DataFrame:
    """Each rule once, with the message of its first finding."""
    first = F.row_number().over(Window.partitionBy("rule").orderBy("file", "line", "message"))
    return issues.withColumn("n", first).where("n = 1").select("rule", "message", "severity")


def sarif_results(issues: DataFrame) -> DataFrame:
    """One column json: each finding as a SARIF result."""
    level = F.coalesce(*(F.when(F.col("severity") == s, F.lit(v)) for s, v in LEVELS.items()))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    fixes = F.when(F.col("fix").isNotNull(), F.array(F.struct(F.struct(F.col("fix").alias("text")).alias("description"))))
    return issues.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), fixes.alias("fixes"))).alias("json"))


def write_sarif_results(issues: DataFrame, folder: str) -> None:
    """Writes every finding as a SARIF result, one to a line, from the executors."""
    sarif_results(issues).write.text(folder)


def sarif(issues: DataFrame, tool: str = "ravelin", most: int = 10_000) -> str:
    """A SARIF 2.1.0 document for a reader, capped() to `most` findings, so that the driver's share is bounded; all of them: write_sarif_results()."""
    issues = capped(issues, most)
    rules = [{"id": r.rule, "shortDescription": {"text": r.message}} for r in sarif_rules(issues).orderBy("rule").collect()]
    results = [json.loads(r.json) for r in sarif_results(issues.orderBy(F.desc(severity_rank()), *ORDER)).collect()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)
