"""Judgements on review items: a local one from their facts, and answers of an outside judge."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVIDENCE
from .rank import judged

# Levels of severity in words, and the weights of the local risk.
LEVELS = ("Cosmetic, generated-adjacent, or test-only impact", "Minor feature impact, easily reverted", "Auth/security, data-loss, or migration impact")
RISKY_CATEGORIES = ("Auth", "Security", "Schema", "Migration", "ApiBreak")
RISKY_SIGNALS = ("validation-removed", "secret-handling", "unsafe")
RISK_QUESTION = "Does this change carry behavioral risk deserving human review?"
SEVERITY_QUESTION = "How severe would a bug in this change be?"
RISK_CRITERIA = {"true": "Logic change on a sensitive surface, or uncovered by tests", "false": "Mechanical, generated-adjacent, or fully covered change"}


class Judge(Protocol):
    """Anything that adds evidence to items."""

    name: str

    def apply(self, items: DataFrame) -> DataFrame: ...


def enrich(judge: Judge, items: DataFrame, *, has_key: bool = True) -> tuple[DataFrame, DataFrame]:
    """The items after a judge, and one row (judge, status, detail): Applied, SkippedNoKey, SkippedNoItems or Failed.

    A judge without its key, without items to judge or with an error leaves the items as they are.
    """
    spark, detail = items.sparkSession, None
    if not has_key:
        status = "SkippedNoKey"
    elif not judged(items).head(1):
        status = "SkippedNoItems"
    else:
        try:
            items, status = judge.apply(items), "Applied"
        except Exception as error:  # noqa: BLE001  a judge is someone else's code
            status, detail = "Failed", str(error)
    return items, spark.createDataFrame([(judge.name, status, detail)], "judge string, status string, detail string")


def _has(kind: str) -> Column:
    return F.exists("evidence", lambda e: e["kind"] == kind)


def local_judgement(items: DataFrame) -> DataFrame:
    """The judged items (25 per change set at most) with risk, in hundredths exact, score and level."""
    hundredths = 15 + F.when(F.col("category").isin(*RISKY_CATEGORIES), 25).otherwise(0) + F.when(_has("untested-change"), 20).otherwise(0)
    for kind in RISKY_SIGNALS:
        hundredths = hundredths + F.when(_has(kind), 10).otherwise(0)
    level = F.least(F.col("severity_rank"), F.lit(2))
    words = F.get(F.array(*map(F.lit, LEVELS)), level)
    return judged(items).select("changeset_id", "id", "pos", (F.least(hundredths, F.lit(95)) / 100).alias("risk"), level.cast("double").alias("score"), words.alias("level"))


class LocalJudge:
    """Adds the local judgement to the evidence of judged items."""

    name = "deterministic"

    def apply(self, items: DataFrame) -> DataFrame:
        found = local_judgement(items).select("changeset_id", "id", "risk", "score", "level")
        rows = items.join(found, ["changeset_id", "id"], "left")
        file = F.coalesce(F.get("files", F.lit(0)), F.lit(""))
        none = F.lit(None).cast("string")
        proof = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("summary"), file.alias("file"), none.alias("old_value"), none.alias("new_value"))
        risk = proof("judge-risk", F.format_string("Local P(risky)=%.2f (deterministic, no cloud call)", F.col("risk")))
        severity = proof("judge-severity", F.format_string("Local severity %.1f (%s, confidence 0.90)", F.col("score"), F.col("level")))
        added = F.when(F.col("risk").isNotNull() & (F.col("category") != "Mechanical"), F.concat("evidence", F.array(risk, severity))).otherwise(F.col("evidence"))
        return rows.withColumn("evidence", added.cast(f"array<{EVIDENCE}>")).drop("risk", "score", "level")


def item_state(items: DataFrame) -> Column:
    """Facts of an item as JSON: summaries of evidence only."""
    return F.to_json(F.struct("id", "title", "category", "severity", "priority", "confidence", "files", "symbols", F.col("evidence.summary").alias("evidence"), "why"))


def requests(items: DataFrame, base_ref: str, head_ref: str, model: str = "judge") -> DataFrame:
    """(changeset_id, request): two questions for each judged item, as one JSON text per change set."""
    facts = F.struct("id", "title", "category", "severity", "priority", "confidence", "files", "symbols", F.col("evidence.summary").alias("evidence"), "why")
    ask = lambda what, question, **more: F.struct(F.lit(what).alias("type"), F.struct(facts.alias("change"), F.lit(question).alias("question")).alias("instructions"), *[v.alias(k) for k, v in more.items()])
    criteria = F.struct(*[F.lit(v).alias(k) for k, v in RISK_CRITERIA.items()])
    pair = F.struct("pos", F.col("id"), F.to_json(ask("noul", RISK_QUESTION, criteria=criteria)).alias("risk"), F.to_json(ask("score", SEVERITY_QUESTION, criteria=F.array(*map(F.lit, LEVELS)))).alias("severity"))
    rows = judged(items).groupBy("changeset_id").agg(F.array_sort(F.collect_list(pair)).alias("q"))
    key = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    texts = F.transform("q", lambda x: F.concat(key(F.concat(x["id"], F.lit("::risk"))), F.lit(":"), x["risk"], F.lit(","), key(F.concat(x["id"], F.lit("::severity"))), F.lit(":"), x["severity"]))
    state = F.to_json(F.struct(F.lit(base_ref).alias("base"), F.lit(head_ref).alias("head"), F.size("q").alias("items_under_review")))
    return rows.select("changeset_id", F.concat(F.lit('{"model":"' + model + '","state":'), state, F.lit(',"questions":{'), F.array_join(texts, ","), F.lit("}}")).alias("request"))


def apply_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with the evidence of answers (changeset_id, question, type, noul, score, confidence); malformed ones are passed over."""
    risk = answers.where("type = 'noul' AND noul IS NOT NULL AND question LIKE '%::risk'").select("changeset_id", F.regexp_replace("question", "::risk$", "").alias("id"), F.col("noul").alias("p"))
    sev = answers.where("type = 'score' AND score IS NOT NULL AND confidence IS NOT NULL AND question LIKE '%::severity'").select("changeset_id", F.regexp_replace("question", "::severity$", "").alias("id"), F.col("score").alias("s"), F.col("confidence").alias("c"))
    rows = items.join(risk, ["changeset_id", "id"], "left").join(sev, ["changeset_id", "id"], "left")
    file = F.coalesce(F.get("files", F.lit(0)), F.lit(""))
    none = F.lit(None).cast("string")
    proof = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("summary"), file.alias("file"), none.alias("old_value"), none.alias("new_value"))
    level = F.get(F.array(*map(F.lit, LEVELS)), F.least(F.greatest(F.round("s"), F.lit(0)), F.lit(2)).cast("int"))
    more = F.array_compact(
        F.array(
            F.when(F.col("p").isNotNull(), proof("judge-risk", F.format_string("Judge P(risky)=%.2f", F.col("p")))),
            F.when(F.col("s").isNotNull(), proof("judge-severity", F.format_string("Judge severity %.1f (%s, confidence %.2f)", F.col("s"), level, F.col("c")))),
        )
    )
    return rows.withColumn("evidence", F.concat("evidence", more).cast(f"array<{EVIDENCE}>")).drop("p", "s", "c")
