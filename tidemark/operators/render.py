"""Review items as text, annotations, test reports and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_github, escape_github_prop, escape_xml, single_line
from ..schemas import REVIEW_ITEM, SCHEMA_VERSION, SEVERITIES, SYMBOL_CHANGE
from .numbering import numbered
from .rank import review_order, review_places


JSON_FIELDS = ("schema_version", "repo_root", "base_ref", "head_ref", "files", "symbol_changes", "review_items", "stats")


def _percent(confidence: Column) -> Column:
    return F.format_string("%.0f", confidence * 100)


def overview_lines(items: DataFrame) -> DataFrame:
    """(changeset_id, n, line) of the numbered meaningful items, judgements below them."""
    rows = review_order(items.where("category <> 'Mechanical'"))
    head = F.concat(F.col("pos"), F.lit(". ["), "severity", F.lit("] "), "title", F.lit(" (priority "), "priority", F.lit(", "), _percent(F.col("confidence")), F.lit("% confidence)\n"))
    why = F.when(F.col("why") != "", F.concat(F.lit("    "), "why", F.lit("\n"))).otherwise("")
    said = F.array_join(F.transform(F.filter("evidence", lambda e: F.startswith(e["kind"], F.lit("judge-"))), lambda e: F.concat(F.lit("    "), e["summary"], F.lit("\n"))), "")
    return rows.select("changeset_id", F.col("pos").alias("n"), F.concat(head, why, said).alias("line"))


def overview(items: DataFrame, stats: DataFrame, base_ref: str = "HEAD", head_ref: str = "worktree", tasks: DataFrame | None = None) -> DataFrame:
    """(changeset_id, overview): the whole text of each change set; ``tasks`` has (changeset_id, task_section)."""
    body = overview_lines(items).groupBy("changeset_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "").alias("body"))
    mechanical = review_order(items.where("category = 'Mechanical'")).groupBy("changeset_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title")))["title"].alias("m"))
    rows = stats.join(body, "changeset_id", "left").join(mechanical, "changeset_id", "left")
    if tasks is not None:
        rows = rows.join(tasks, "changeset_id", "left")
    else:
        rows = rows.withColumn("task_section", F.lit(""))
    counts = F.concat("files_changed", F.lit(" files · +"), "added_lines", F.lit(" −"), "deleted_lines", F.lit(" · "), "meaningful_changes", F.lit(" meaningful · "), "mechanical_files", F.lit(" mechanical\n\n"))
    listed = F.array_join(F.transform("m", lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), "")
    below = F.when(F.size("m") > 0, F.concat(F.lit("\nMechanical (collapsed): "), F.size("m"), F.lit(" item(s)\n"), listed)).otherwise("")
    whole = F.concat(F.lit(f"{base_ref} → {head_ref}\n"), counts, F.coalesce("body", F.lit("")), F.coalesce(below, F.lit("")), F.coalesce("task_section", F.lit("")))
    return rows.select("changeset_id", whole.alias("overview"))


def github_annotations(items: DataFrame) -> DataFrame:
    """(changeset_id, pos, annotation) of the meaningful items, in review order."""
    rows = review_order(items.where("category <> 'Mechanical'"))
    command = F.when(F.col("severity_rank") >= 2, "error").when(F.col("severity_rank") == 1, "warning").otherwise("notice")
    props = F.concat(F.lit("title="), "severity", F.lit(" "), escape_github_prop(F.col("title")))
    props = F.when(F.size("files") > 0, F.concat(F.lit("file="), escape_github_prop(F.get("files", F.lit(0))), F.lit(","), props)).otherwise(props)
    said = F.when(F.size("evidence") > 0, F.concat(F.lit(" | evidence: "), F.array_join("evidence.summary", "; "))).otherwise("")
    return rows.select("changeset_id", "pos", F.concat(F.lit("::"), command, F.lit(" "), props, F.lit("::"), escape_github(F.concat(single_line(F.col("why")), said))).alias("annotation"))


def junit_cases(items: DataFrame, threshold: str) -> DataFrame:
    """(changeset_id, id, failed, skipped, case) of every item."""
    mechanical = F.col("category") == "Mechanical"
    failed = ~mechanical & (F.col("severity_rank") >= SEVERITIES.index(threshold))
    failure = F.concat(F.lit('<failure message="['), "severity", F.lit("] "), escape_xml(single_line(F.col("title"))), F.lit('">'), escape_xml(single_line(F.col("why"))), F.lit("</failure>"))
    inner = F.when(mechanical, "<skipped/>").when(failed, failure).otherwise("")
    case = F.concat(F.lit('  <testcase classname="'), "category", F.lit('" name="'), escape_xml(F.col("title")), F.lit('">'), inner, F.lit("</testcase>\n"))
    return items.select("changeset_id", "id", failed.alias("failed"), mechanical.alias("skipped"), case.alias("case"))


def junit(items: DataFrame, threshold: str, suite: str = "tidemark") -> DataFrame:
    """(changeset_id, junit): a test suite per change set, cases by id."""
    rows = junit_cases(items, threshold).groupBy("changeset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed")).alias("f"), F.count_if(F.col("skipped")).alias("s"), F.array_join(F.array_sort(F.collect_list(F.struct("id", "case")))["case"], "").alias("cases")
    )
    return rows.select("changeset_id", F.concat(_suite_head(suite), "cases", F.lit("</testsuite>\n")).alias("junit"))


def _line(section: int, pos: Column | str, content: Column) -> list[Column]:
    return [F.col("changeset_id"), F.lit(section).alias("section"), (F.col(pos) if isinstance(pos, str) else pos).alias("pos"), content.alias("content")]


def annotation_lines(items: DataFrame) -> DataFrame:
    """The annotations as lines (changeset_id, section, pos, content) of a document."""
    return github_annotations(items).select(*_line(1, F.lpad(F.col("pos").cast("string"), 12, "0"), F.concat("annotation", F.lit("\n"))))


def junit_lines(items: DataFrame, threshold: str, suite: str = "tidemark") -> DataFrame:
    """The test suite as lines (changeset_id, section, pos, content): put in order they are junit(), and no row holds a whole suite."""
    cases = junit_cases(items, threshold)
    counts = cases.groupBy("changeset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("failed")).alias("f"), F.count_if(F.col("skipped")).alias("s"))
    none = F.lit("")
    head = counts.select(*_line(0, none, _suite_head(suite)))
    return head.unionByName(cases.select(*_line(1, "id", F.col("case")))).unionByName(counts.select(*_line(2, none, F.lit("</testsuite>\n"))))


def _suite_head(suite: str) -> Column:
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{suite}" tests="'), "n", F.lit('" failures="'), "f", F.lit('" skipped="'), "s", F.lit('">\n'))


def rendered(items: DataFrame, form: str, threshold: str = "High") -> DataFrame:
    """Items as ``github`` annotations or a ``junit`` suite."""
    if form == "github":
        return github_annotations(items)
    if form == "junit":
        return junit(items, threshold)
    raise ValueError(f"unknown format {form!r}: github or junit")


#: JSON texts that one row joins before the rows of a change set meet.
IN_BLOCK = 2_000


def _json_list(rows: DataFrame, sorted_by: list[str], order: list[Column], content: Column, name: str, how: dict) -> DataFrame:
    """(changeset_id, ``name``): the JSON texts of rows in order, joined by commas.

    Rows are rendered where they are and joined in blocks, so the task of a change set only puts its blocks together.
    ``order`` reads the columns ``sorted_by``.
    """
    texts = numbered(rows.select("changeset_id", *sorted_by, F.to_json(content, how).alias("json")), ["changeset_id"], order, "n")
    joined = lambda at, part: F.array_join(F.array_sort(F.collect_list(F.struct(at, part)))[part], ",").alias(part)
    blocks = texts.groupBy("changeset_id", F.floor(F.col("n") / IN_BLOCK).alias("block")).agg(joined("n", "json"))
    return blocks.groupBy("changeset_id").agg(joined("block", "json")).withColumnRenamed("json", name)


def changeset_json(files: DataFrame, changes: DataFrame, items: DataFrame, stats: DataFrame, *, repo_root: str = "", base_ref: str = "HEAD", head_ref: str = "worktree", tasks: DataFrame | None = None, pretty: bool = True) -> DataFrame:
    """(changeset_id, json): everything about a change set as one JSON document; fields that are null stay.

    ``tasks`` (changeset_id and the columns of a task check) adds a field task_check where a change set has one.  Without
    ``pretty`` the parts of a document are rendered by many tasks; a pretty one is rendered whole by one.
    """
    of_file = F.struct(*[c for c in files.columns if c != "changeset_id"])
    span = lambda a, b: F.when(F.col(a).isNotNull(), F.array(a, b))
    of_change = F.struct("file", "name", "kind", "change", "confidence", "old_signature", "new_signature", span("old_start", "old_end").alias("old_lines"), span("new_start", "new_end").alias("new_lines"), "evidence")
    of_item = F.struct("id", "title", "category", "severity", "priority", "confidence", "files", "symbols", "evidence", "why")
    counters = F.struct(*[c for c in stats.columns if c != "changeset_id"]).alias("stats")
    head = (F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(repo_root).alias("repo_root"), F.lit(base_ref).alias("base_ref"), F.lit(head_ref).alias("head_ref"))
    how = {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}
    rows = stats.select("changeset_id", counters)
    if tasks is not None:
        checked = tasks.groupBy("changeset_id").agg(F.first(F.struct("task_text", "verdict", "coverage", "matched_terms", "unmatched")).alias("task_check"))
        rows = rows.join(checked, "changeset_id", "left")
    if not pretty:
        whole = lambda df, content: (df.select("changeset_id", content.alias("o")), ["o"], [F.col("o")], F.col("o"))
        parts = {"files": whole(files, of_file), "symbol_changes": whole(changes, of_change), "review_items": (items, ["severity_rank", "priority", "title", "id"], review_places(), of_item)}
        for name, part in parts.items():
            rows = rows.join(_json_list(*part, name, how), "changeset_id", "left")
        of = lambda s: F.regexp_replace(s, r"^\{|\}$", "")
        lists = [F.concat(F.lit(f',"{name}":['), F.coalesce(name, F.lit("")), F.lit("]")) for name in parts]
        check = [F.coalesce(F.concat(F.lit(',"task_check":'), F.to_json("task_check", how)), F.lit(""))] if tasks is not None else []
        return rows.select("changeset_id", F.concat(F.lit("{"), of(F.to_json(F.struct(*head), how)), *lists, F.lit(',"stats":'), F.to_json("stats", how), *check, F.lit("}")).alias("json"))
    of_files = files.groupBy("changeset_id").agg(F.array_sort(F.collect_list(of_file)).alias("files"))
    of_changes = changes.groupBy("changeset_id").agg(F.array_sort(F.collect_list(of_change)).alias("symbol_changes"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", of_item.alias("item")))), lambda x: x["item"])
    of_items = review_order(items).groupBy("changeset_id").agg(ordered.alias("review_items"))
    rows = rows.join(of_files, "changeset_id", "left").join(of_changes, "changeset_id", "left").join(of_items, "changeset_id", "left")
    for c, kind in (("files", of_files), ("symbol_changes", of_changes), ("review_items", of_items)):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(kind.schema[c].dataType)))
    document = F.struct(*head, "files", "symbol_changes", "review_items", "stats")
    if tasks is None:
        return rows.select("changeset_id", F.to_json(document, how).alias("json"))
    whole = F.struct(*[document[c].alias(c) for c in JSON_FIELDS], "task_check")
    return rows.select("changeset_id", F.when(F.col("task_check").isNull(), F.to_json(document, how)).otherwise(F.to_json(whole, how)).alias("json"))


STORED = f"schema_version INT, repo_root STRING, base_ref STRING, head_ref STRING, symbol_changes ARRAY<STRUCT<{SYMBOL_CHANGE}>>, review_items ARRAY<STRUCT<{REVIEW_ITEM}>>"


def read_changesets(rows: DataFrame) -> DataFrame:
    """Stored change sets (changeset_id, json) as columns: version (1 where it is absent), refs, symbol changes and items, empty where absent."""
    found = rows.select("changeset_id", F.from_json("json", STORED).alias("d")).select("changeset_id", "d.*")
    found = found.withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))
    for c in ("symbol_changes", "review_items"):
        found = found.withColumn(c, F.coalesce(c, F.array().cast(found.schema[c].dataType)))
    return found
