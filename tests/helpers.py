"""Small frames for tests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_column(spark: SparkSession, values: list, expression, kind: str = "string") -> list:
    """Values of an expression over a column of strings, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r["x"] for r in rows.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


def dicts(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def items_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Review items; what a row leaves out has a plain default."""
    from tidemark.schemas import EVIDENCE, severity_rank

    default = {"changeset_id": "c", "title": None, "category": "Behavior", "severity": "High", "priority": 50, "confidence": 0.8, "files": ["src/a.rs"], "symbols": [], "evidence": [], "why": "w"}
    full = []
    for r in rows:
        r = default | r
        r["title"] = r["title"] or f"title {r['id']}"
        r["evidence"] = [(k, s, "src/a.rs", None, None) for k, s in r["evidence"]]
        full.append(r)
    schema = f"changeset_id string, id string, title string, category string, severity string, priority int, confidence float, files array<string>, symbols array<string>, evidence array<{EVIDENCE}>, why string"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")[:6]] + ["confidence", "files", "symbols", "evidence", "why"]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema)
    return df.withColumn("severity_rank", severity_rank(F.col("severity")))


def lit_array(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")
