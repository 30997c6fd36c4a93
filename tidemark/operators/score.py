"""Importance of a changed file: points, severity, category and the evidence for them.

A rule is a condition with points, a severity floor and a category.  Points add up, the severity is the greatest
floor, and the category is the first one found unless a rule overrides it; evidence keeps the order of the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import EVIDENCE, SEVERITIES, evidence, name_of

# Words of paths and the weights of signals.
AUTH_WORDS = "auth session token password login oauth permission secret crypto signin sign-in".split()
SCHEMA_PARTS = ("migrat", "schema", "prisma/", "alembic/")
MANIFESTS = ("cargo.toml", "package.json", "pyproject.toml", "requirements.txt", ".csproj", "go.mod")
DEPLOY_PARTS = ("dockerfile", "k8s/", "deploy/", ".github/workflows/", "appsettings")
SECRET_PATH_WORDS = ("secret", "credential", "key")
SECRET_TEXT = ("secret", "token", "password")
UNSAFE_PARTS = ("unsafe fn", "unsafe {", "unsafe impl", "unsafe trait", "unsafe extern")
SYMBOL_POINTS = {"Removed": 25, "SignatureChanged": 22, "VisibilityChanged": 20, "Modified": 12, "Added": 8, "Renamed": 5, "Moved": 5}
SYMBOL_FLOOR = {"Removed": 2, "SignatureChanged": 1, "VisibilityChanged": 1}
SYMBOL_CATEGORY = {"Removed": "ApiBreak", "SignatureChanged": "Behavior", "VisibilityChanged": "ApiBreak", "Modified": "Behavior", "Added": "Behavior"}
SYMBOL_EVIDENCE = {
    "Removed": ("symbol-removed", "symbol removed: "), "SignatureChanged": ("signature-changed", "signature changed: "), "VisibilityChanged": ("visibility-changed", "visibility changed: "),
    "Renamed": ("rename-move", "renamed/moved: "), "Moved": ("rename-move", "renamed/moved: "),
}
SYMBOL_CAP = 25
BASE_POINTS = 20


def _lookup(table: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key).cast(kind)


def code_lines(rows: Column) -> Column:
    """Lines of code without literals and comments, lower-cased."""
    return F.transform(rows, lambda x: F.lower(text.strip_code(x)))


def symbol_bonus(changes: DataFrame) -> DataFrame:
    """(changeset_id, file, bonus): points of a file's symbol changes, up to a cap."""
    points = F.coalesce(_lookup(SYMBOL_POINTS, F.col("change"), "int"), F.lit(0))
    return changes.groupBy("changeset_id", "file").agg(F.least(F.sum(points), F.lit(SYMBOL_CAP)).cast("int").alias("bonus"))


def score_files(files: DataFrame) -> DataFrame:
    """``files`` with priority, severity_rank, severity, category and evidence.

    Reads path, language, is_generated, formatting_only, is_test_file, added and deleted (arrays of lines) and
    symbols, an array of (name, kind, change, confidence, moved_from) in the order of the changes.
    """
    path = F.lower("path")
    rows = files.withColumn("_lines", code_lines(F.col("added"))).withColumn("_added", F.array_join("_lines", "\n")).withColumn("_deleted", F.array_join(code_lines(F.col("deleted")), "\n"))
    added, deleted = F.col("_added"), F.col("_deleted")
    has = lambda s, *words: reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words])
    unsafe = F.exists("_lines", lambda x: text.trim_all(x).rlike("^unsafe|unsafe (fn|\\{|impl|trait|extern)"))
    test = F.col("is_test_file")
    docs = paths.ends_with_any(path, (".md", ".rst")) | F.contains(path, F.lit("/docs/"))
    secret = paths.has_part(F.col("path"), SECRET_PATH_WORDS) & has(added, *SECRET_TEXT)
    branch = lambda s: has(s, "if ", "match ")
    before = [  # condition, points, severity floor, category, evidence kind, summary
        (paths.has_part(F.col("path"), AUTH_WORDS), 45, 2, "Auth", "auth-surface", "change touches authentication/authorization surface"),
        (paths.contains_any(path, SCHEMA_PARTS) | F.endswith(path, F.lit(".sql")), 40, 2, "Schema", "schema", "database schema or migration change"),
        (paths.ends_with_any(path, MANIFESTS), 30, 1, "Dependency", "dependency-manifest", "dependency manifest changed"),
        (paths.contains_any(path, DEPLOY_PARTS) | F.endswith(path, F.lit(".env")), 25, 1, "Config", "deploy-config", "deployment or runtime configuration changed"),
        (test, -10, 0, None, "test-file", "test file — verifies behavior, rarely the risk itself"),
        (docs, -12, 0, None, "docs", "documentation change"),
    ]
    after = [
        ((F.col("language") == "Rust") & unsafe, 20, 2, "Security", "unsafe", "new `unsafe` code"),
        (has(deleted, "valid") & ~has(added, "valid"), 18, 2, "Security", "validation-removed", "deleted lines mention validation with no replacement"),
        (branch(deleted) & branch(added), 10, 0, None, "conditional-changed", "branch conditions modified"),
        (secret, 25, 3, None, "secret-handling", "secret/credential handling touched"),
    ]
    secret_, docs_ = "_secret", "_docs"
    flags = {f"_rule{i}": rule[0] for i, rule in enumerate(before + after)} | {secret_: secret, docs_: docs}
    rows = rows.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in flags.items()})  # columns, as each is read many times below
    before = [(F.col(f"_rule{i}"), *rule[1:]) for i, rule in enumerate(before)]
    after = [(F.col(f"_rule{len(before) + i}"), *rule[1:]) for i, rule in enumerate(after)]
    symbols = F.coalesce("symbols", F.array().cast("array<struct<name:string,kind:string,change:string,confidence:float,moved_from:string>>"))
    bonus = F.least(F.aggregate(symbols, F.lit(0), lambda n, s: n + F.coalesce(_lookup(SYMBOL_POINTS, s["change"], "int"), F.lit(0))), F.lit(SYMBOL_CAP))
    points = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, *_ in before + after], F.lit(BASE_POINTS) + bonus)
    priority = F.greatest(F.lit(0), F.least(F.lit(100), points))
    floor = F.coalesce(F.array_max(F.transform(symbols, lambda s: F.coalesce(_lookup(SYMBOL_FLOOR, s["change"], "int"), F.lit(0)))), F.lit(0))
    floor = F.greatest(floor, *[F.when(c, f).otherwise(0) for c, _, f, *_ in before + after])
    of_symbols = F.get(F.filter(F.transform(symbols, lambda s: _lookup(SYMBOL_CATEGORY, s["change"], "string")), lambda c: c.isNotNull()), F.lit(0))
    first = F.coalesce(*[F.when(c, g) for c, _, _, g, *_ in before if g], of_symbols, *[F.when(c, g) for c, _, _, g, *_ in after if g])
    rest = F.when(priority >= 55, "Behavior").when(test, "Test").otherwise("Refactor")
    category = F.when(F.col(secret_), "Security").when(F.col(docs_), "Docs").when(test, "Test").otherwise(F.coalesce(first, rest))
    rank = F.greatest(floor, F.when(priority >= 80, 3).when(priority >= 55, 1).otherwise(0))
    one = lambda c, kind, what: F.when(c, evidence(kind, what, F.col("path")))
    of_symbol = F.filter(
        F.transform(
            symbols,
            lambda s: F.when(
                _lookup({k: v[0] for k, v in SYMBOL_EVIDENCE.items()}, s["change"], "string").isNotNull(),
                F.struct(
                    _lookup({k: v[0] for k, v in SYMBOL_EVIDENCE.items()}, s["change"], "string").alias("kind"), F.concat(_lookup({k: v[1] for k, v in SYMBOL_EVIDENCE.items()}, s["change"], "string"), s["name"]).alias("summary"),
                    F.col("path").alias("file"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"),
                ),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    found = F.concat(F.array_compact(F.array(*[one(c, k, w) for c, _, _, _, k, w in before])), of_symbol, F.array_compact(F.array(*[one(c, k, w) for c, _, _, _, k, w in after])))
    generated, formatting = F.col("is_generated"), F.col("formatting_only")
    rows = rows.withColumn("priority", F.when(generated, 2).when(formatting, 3).otherwise(priority).cast("int"))
    rows = rows.withColumn("severity_rank", F.when(generated | formatting, 0).otherwise(rank).cast("int")).withColumn("category", F.when(generated | formatting, "Mechanical").otherwise(category))
    rows = rows.withColumn("severity", name_of(F.col("severity_rank"), SEVERITIES))
    proof = F.when(generated, F.array(evidence("generated", "generated or lockfile output — collapsed by default", F.col("path"))))
    proof = proof.when(formatting, F.array(evidence("formatting-only", "whitespace/punctuation-only diff", F.col("path")))).otherwise(found)
    return rows.withColumn("evidence", proof.cast(f"array<{EVIDENCE}>")).drop("_lines", "_added", "_deleted", *flags)
