"""Command line: review a git change with Spark.

    python -m tidemark.cli PATH [REVS [REV2]] [--staged] [--untracked] [--commit SHA] [--cache FOLDER] [--out FOLDER] [--overview | --json | --format github|junit | --escalate]

Exit code 2 means that a gate fired.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import escalate, rank, render, task
from .plans.review import Review, review_changes
from .schemas import parse_severity, parse_verdict
from .sources import git, repository, sink
from .sources.tasks import task_text


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.split("\n")[0])
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("revs", nargs="?")
    parser.add_argument("rev2", nargs="?")
    for flag in ("--staged", "--untracked", "--json", "--overview", "--local-judge", "--escalate"):
        parser.add_argument(flag, action="store_true")
    parser.add_argument("--commit")
    parser.add_argument("--format", choices=("github", "junit"))
    parser.add_argument("--fail-on", help="severity from which the exit code is 2")
    parser.add_argument("--task", help="task description, or @file")
    parser.add_argument("--fail-on-task", help="verdict at or below which the exit code is 2")
    parser.add_argument("--escalate-on", default="high")
    parser.add_argument("--max-escalations", type=int, default=10)
    parser.add_argument("--out", help="folder to which the executors write the report instead of its being printed")
    parser.add_argument("--cache", help="folder of a cache of symbols that spares parsing")
    args = parser.parse_args(argv)
    if args.escalate and args.format:
        parser.error("--escalate and --format exclude each other")
    if args.out and args.escalate:
        parser.error("--escalate is printed only")
    if args.fail_on_task and not args.task:
        parser.error("--fail-on-task needs --task")
    args.path, args.revs, args.rev2 = git.place_and_revisions(args.path, args.revs, args.rev2)
    return args


def level(spark: SparkSession, parse, text: str) -> str:
    return spark.range(1).select(parse(F.lit(text))).first()[0]


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    git.register(spark)
    reader = spark.read.format("git_changes").option("path", args.path).option("changeset", "change").option("untracked", str(args.untracked).lower())
    for key, value in git.resolve_revisions(revs=args.revs, rev2=args.rev2, staged=args.staged, commit=args.commit).items():
        reader = reader.option(key, value)
    return reader.load()


def review_of(spark: SparkSession, args: argparse.Namespace) -> Review:
    changes = load(spark, args)
    files = repository.read_files(spark, git.discover(args.path))
    tests, sources, definitions = repository.scan(files, changes.select("path"))
    tasks = None
    if args.task:
        tasks = spark.createDataFrame([("change", 0, task_text(spark, args.task))], "changeset_id string, task_id int, task_text string")
    return review_changes(changes, tests=tests.withColumn("changeset_id", F.lit("change")), sources=sources, definitions=definitions, local_judge=args.local_judge, tasks=tasks, cache_path=args.cache)


def write(spark: SparkSession, made: Review, args: argparse.Namespace) -> None:
    """Write the form asked for as a document per change set, from the executors."""
    one = lambda df, column: df.select("changeset_id", F.lit(1).alias("section"), F.lit("").alias("pos"), F.col(column).alias("content"))
    if args.json:
        lines, extension = one(render.changeset_json(made.files, made.changes, made.items, made.stats, repo_root=git.discover(args.path), tasks=made.tasks), "json"), "json"
    elif args.format == "github":
        lines, extension = render.annotation_lines(made.items), "txt"
    elif args.format == "junit":
        lines, extension = render.junit_lines(made.items, level(spark, parse_severity, args.fail_on or "high")), "xml"
    else:
        sections = task.task_section(made.tasks).select("changeset_id", "task_section") if made.tasks is not None else None
        lines, extension = one(render.overview(made.items, made.stats, tasks=sections), "overview"), "txt"
    sink.write_documents(lines, args.out, extension=extension)


def output(spark: SparkSession, made: Review, args: argparse.Namespace) -> str:
    """Text of the first form asked for: escalation, JSON, annotations or test report, overview."""
    first = lambda df: next((r[-1] for r in df.collect()), "")
    if args.escalate:
        package = made.escalation(floor=level(spark, parse_severity, args.escalate_on), most=args.max_escalations, task=made.tasks)
        return first(package.select(F.to_json(F.struct(*package.columns), {"ignoreNullFields": "false"}))) if args.json else first(escalate.summary(package))
    if args.json:
        return first(render.changeset_json(made.files, made.changes, made.items, made.stats, repo_root=git.discover(args.path), tasks=made.tasks))
    if args.format == "github":
        return "\n".join(r["annotation"] for r in render.github_annotations(made.items).orderBy("pos").collect())
    if args.format == "junit":
        return first(render.junit(made.items, level(spark, parse_severity, args.fail_on or "high")))
    sections = task.task_section(made.tasks).select("changeset_id", "task_section") if made.tasks is not None else None
    return first(render.overview(made.items, made.stats, tasks=sections))


def fired(spark: SparkSession, made: Review, args: argparse.Namespace) -> bool:
    if args.fail_on and made.gate(level(spark, parse_severity, args.fail_on)).head(1):
        return True
    if args.fail_on_task:
        trips = rank.task_gate(F.col("verdict"), level(spark, parse_verdict, args.fail_on_task))
        return bool(made.tasks.where(trips).head(1))
    return False


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        made = review_of(spark, args)
    except RuntimeError as error:
        print(error, file=sys.stderr)
        return 1
    if args.out:
        write(spark, made, args)
    else:
        print(output(spark, made, args))
    return 2 if fired(spark, made, args) else 0


if __name__ == "__main__":
    sys.exit(main())
