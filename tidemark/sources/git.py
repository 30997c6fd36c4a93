"""Change records of a git repository, as a Spark data source that asks the git program.

    register(spark)
    spark.read.format("git_changes").option("path", repo).option("mode", "range").option("base", "a").option("head", "b").load()
    spark.readStream.format("git_changes").option("path", repo).option("branch", "main").load()

Modes: worktree (HEAD to the working tree, untracked files with it), staged (HEAD to the index), commit (a commit to its
first parent) and range (two trees).  The driver lists the files and asks for the sizes of their blobs; files are dealt to
partitions by bytes.  A partition reads the contents of its own one by one from ``git cat-file --batch``, of blobs over the limit
only the start, and their hunks from one ``git diff`` that it reads line by line.  Conditions on path and status are
applied before anything is read.

As a stream, each commit of a branch is a change set, named by its id, compared with its first parent.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..schemas import HUNK

SCHEMA = (
    "changeset_id STRING, file_idx BIGINT, old_path STRING, path STRING, status STRING, is_binary BOOLEAN, added_lines BIGINT, deleted_lines BIGINT, "
    f"hunks ARRAY<{HUNK}>, old_content STRING, new_content STRING"
)
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
MOST_CONTENT = 512 * 1024
MOST_UNTRACKED = 2 * 1024 * 1024
STATUS = {"A": "Added", "D": "Deleted", "R": "Renamed", "C": "Copied", "T": "TypeChanged"}
HUNK_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: Bytes of a file in which a zero byte makes it binary.
HEAD_BYTES = 8000
#: Bytes that one partition reads, by the sizes of its blobs.
MOST_PARTITION = 8 << 20
FLAGS = ("--minimal", "--indent-heuristic", "-M", "-C", "-l1000", "--ignore-submodules", "--no-ext-diff", "--no-textconv")


def git(root: str, *args: str, check: bool = True) -> bytes:
    run = subprocess.run(["git", "--literal-pathspecs", "-c", "core.quotePath=off", "-C", root, *args], capture_output=True)
    if check and run.returncode:
        raise RuntimeError(f"git {args[0]} failed in {root}: {run.stderr.decode(errors='replace').strip() or 'is it a repository?'}")
    return run.stdout


def discover(path: str) -> str:
    """Root of the repository that a path lies in; of a bare one, its own folder."""
    if git(path, "rev-parse", "--is-bare-repository").strip() == b"true":
        return git(path, "rev-parse", "--absolute-git-dir").decode().strip()
    return git(path, "rev-parse", "--show-toplevel").decode().strip()


def head_short(root: str) -> str:
    return git(root, "symbolic-ref", "--short", "-q", "HEAD", check=False).decode().strip() or "HEAD"


def resolve_revisions(*, revs: str | None = None, rev2: str | None = None, staged: bool = False, commit: str | None = None) -> dict[str, str]:
    """Options of the source from the ways to name a change: one commit, the index, a..b, two revisions, one revision, else the working tree.

    Of several the first in this order counts.
    """
    if commit:
        return {"mode": "commit", "commit": commit}
    if staged:
        return {"mode": "staged"}
    if not revs:
        return {"mode": "worktree"}
    if "..." in revs:
        raise ValueError("ranges with three dots are not supported; use two")
    if ".." in revs:
        base, _, head = revs.partition("..")
        return {"mode": "range", "base": base.strip() or "HEAD", "head": head.strip() or "HEAD"}
    return {"mode": "range", "base": revs, "head": rev2} if rev2 else {"mode": "commit", "commit": revs}


def place_and_revisions(path: str, revs: str | None, rev2: str | None) -> tuple[str, str | None, str | None]:
    """Folder and revisions of three positional arguments, of which the folder may have been left out.

    A first argument that is no existing path and reads as a revision (a range, or a name without a separator) moves up, and the
    folder is the current one.
    """
    exists = os.path.exists(path)
    is_range = ".." in path
    is_name = is_range or not set(path) & {"/", "\\"}
    moved = (is_name and not exists and not rev2) if revs else (path != "." and (is_range or (is_name and not exists)))
    return (".", path, revs) if moved else (path, revs, rev2)


class _File(NamedTuple):
    """A file that differs: its place in the list, and the blobs of both sides with their sizes; no blob where a side does not exist or
    lies on the disk."""

    index: int
    status: str
    old: str
    new: str
    old_blob: str | None
    new_blob: str | None
    old_size: int
    new_size: int


class _Files(InputPartition):
    def __init__(self, rows: list[_File]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = discover(options.get("path", "."))
        self.mode = options.get("mode", "worktree")
        self.name = options.get("changeset", "")
        self.batch = int(options.get("batch", "64"))
        self.bytes = int(options.get("partition_bytes", str(MOST_PARTITION)))
        self.untracked = options.get("untracked", "true") == "true"
        self.wanted: dict[str, set[str]] = {}
        if self.mode == "range":
            self.old, self.new = options["base"], options["head"]
        elif self.mode == "commit":
            self.new = options["commit"]
            parent = git(self.root, "rev-parse", "--verify", "-q", f"{self.new}^1", check=False).decode().strip()
            self.old = parent or EMPTY_TREE
        elif self.mode in ("worktree", "staged"):
            self.old, self.new = "HEAD", ""
        else:
            raise ValueError(f"unknown mode {self.mode!r}: worktree, staged, commit or range")
        for rev in (self.old, self.new):
            if rev.startswith("-"):
                raise ValueError(f"not a revision: {rev!r}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of path and status; nothing of other files is read then."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("status",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def _range(self) -> list[str]:
        return [self.old, self.new] if self.new else ["--cached", self.old] if self.mode == "staged" else [self.old]

    def _listed(self) -> list[tuple[str, str, str, str | None, str | None]]:
        """(status, old path, new path, old blob, new blob) of the files that differ."""
        fields = git(self.root, "diff", "--raw", "-z", "--no-abbrev", *FLAGS, *self._range(), "--").decode("utf-8", "surrogateescape").split("\0")
        rows, i = [], 0
        while i < len(fields) - 1:
            _, _, before, after, letter = fields[i].split(" ")
            both = letter[:1] in "RC"
            old, new = fields[i + 1], fields[i + 2] if both else fields[i + 1]
            i += 3 if both else 2
            rows.append((STATUS.get(letter[:1], "Modified"), old, new, *(None if not x.strip("0") else x for x in (before, after))))
        return rows

    def _sizes(self, blobs: list[str]) -> dict[str, int]:
        if not blobs:
            return {}
        run = subprocess.run(["git", "-C", self.root, "cat-file", "--batch-check"], input="".join(f"{b}\n" for b in blobs).encode(), capture_output=True)
        lines = [line.split(b" ") for line in run.stdout.splitlines()]
        return {b: int(x[2]) for b, x in zip(blobs, lines, strict=True) if len(x) == 3 and x[1] == b"blob"}

    def _disk_size(self, path: str) -> int:
        try:
            return os.stat(f"{self.root}/{path}").st_size
        except OSError:
            return 0

    def partitions(self) -> list[InputPartition]:
        rows = self._listed()
        if self.mode == "worktree" and self.untracked:
            listed = git(self.root, "ls-files", "--others", "--exclude-standard", "-z").decode("utf-8", "surrogateescape").split("\0")
            rows += [("Untracked", p, p, None, None) for p in listed if p]
        numbered = [(n, *r) for n, r in enumerate(rows)]
        paths, states = self.wanted.get("path"), self.wanted.get("status")
        numbered = [r for r in numbered if (paths is None or r[3].replace("\\", "/") in paths) and (states is None or r[1] in states)]
        sizes = self._sizes(sorted({b for r in numbered for b in r[4:] if b}))
        out, held, load = [], [], 0
        for index, status, old, new, before, after in numbered:
            on_disk = self.mode == "worktree" and status != "Deleted"
            file = _File(index, status, old, new, before if before in sizes else None, None if on_disk or after not in sizes else after, sizes.get(before, 0), self._disk_size(new) if on_disk else sizes.get(after, 0))
            weight = file.old_size + file.new_size
            if held and (len(held) >= self.batch or load + weight > self.bytes):
                out.append(_Files(held))
                held, load = [], 0
            held.append(file)
            load += weight
        return [*out, _Files(held)] if held or not out else out

    def _head(self, blob: str) -> bytes:
        """The first bytes of a large blob, which is not held whole by any process where git can stream it."""
        run = subprocess.Popen(["git", "-c", "core.bigFileThreshold=1m", "-C", self.root, "cat-file", "blob", blob], stdout=subprocess.PIPE)
        data = run.stdout.read(HEAD_BYTES)
        run.kill()
        run.stdout.close()
        run.wait()
        return data

    def _disk(self, path: str, most: int) -> bytes | None:
        try:
            with open(os.fsencode(f"{self.root}/{path}"), "rb") as file:
                return file.read(most)
        except OSError:
            return None

    def read(self, partition: _Files) -> Iterator[tuple]:
        if not partition.rows:
            return
        binary: dict[int, bool] = {}
        ask = _Blobs(self.root)
        try:
            for f in partition.rows:  # what is binary gets no line from git diff, so it need not read it
                binary[f.index] = any(x is not None and b"\0" in x[:HEAD_BYTES] for x in self._sides(f, ask, heads=True))
            patches = self._patches([f for f in partition.rows if not binary[f.index] and f.status != "Untracked"])
            for f in partition.rows:
                before, after = (None, None) if binary[f.index] else self._sides(f, ask)
                found = patches.pop(f.index, None) or []
                if f.status == "Untracked":
                    text = None if binary[f.index] or f.new_size > MOST_UNTRACKED else _decoded(self._disk(f.new, MOST_UNTRACKED + 1))
                    is_binary, texts = text is None, (None, text)
                    found = [] if text is None else [_untracked(text)]
                else:
                    is_binary, texts = binary[f.index], (_text(before), _text(after))
                count = lambda kind: sum(line["kind"] == kind for h in found for line in h["lines"])  # noqa: B023, E731
                rows = [(h["old_start"], h["old_lines"], h["new_start"], h["new_lines"], h["header"], [(x["kind"], x["text"]) for x in h["lines"]]) for h in found]
                old, new = (_shown(p) for p in (f.old, f.new))
                yield (self.name or f"{self.mode}:{self.old}..{self.new}", f.index, old, new, f.status, is_binary, count("Addition"), count("Deletion"), rows, *texts)
        finally:
            ask.close()

    def _sides(self, f: _File, ask: _Blobs, *, heads: bool = False) -> tuple[bytes | None, bytes | None]:
        """Both sides of a file; of those over the limit nothing, or the first bytes if only these are wanted."""
        out = []
        for blob, size in ((f.old_blob, f.old_size), (f.new_blob, f.new_size)):
            if blob is not None:
                out.append(ask.get(blob) if size <= MOST_CONTENT else self._head(blob) if heads else None)
            else:
                on_disk = len(out) == 1 and self.mode == "worktree" and f.status != "Deleted"
                out.append(self._disk(f.new, HEAD_BYTES if heads else MOST_CONTENT + 1) if on_disk else None)
        return out[0], out[1]

    def _patches(self, rows: list[_File]) -> dict[int, list[dict]]:
        """Hunks by index.  Files that keep their path come from one diff of these paths, renames and copies from a diff of their two blobs."""
        out: dict[int, list[dict]] = {}
        plain = {f.new: f.index for f in rows if f.status not in ("Renamed", "Copied")}
        flags = [x for x in FLAGS if x[:2] not in ("-M", "-C", "-l")]
        if plain:
            for path, found in self._diff("--no-renames", *flags, *self._range(), "--", *sorted(plain)):
                if path in plain:  # a path that became a folder brings its files along
                    out.setdefault(plain[path], []).extend(found)
        for f in rows:
            if f.status in ("Renamed", "Copied") and f.old_blob:
                ends = [f.old_blob, f.new_blob] if f.new_blob else [f.old_blob, "--", f.new]
                out[f.index] = [h for _, found in self._diff(*flags, *ends) for h in found]
        return out

    def _diff(self, *args: str) -> Iterator[tuple[str, list[dict]]]:
        """(path, hunks) of each file of a patch, read line by line.  A change of type comes as two of one path."""
        command = ["git", "--literal-pathspecs", "-C", self.root, "diff", "--raw", "-z", "--no-abbrev", "-p", "-U3", *args]
        run = subprocess.Popen([os.fsencode(c) for c in command], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        names: list[str] = []
        stream = run.stdout
        while True:  # records of the list end with zero bytes; an empty one stands before the patch
            head = _until_zero(stream)
            if not head:
                break
            status, path = head.decode().rsplit(" ", 1)[1], os.fsdecode(_until_zero(stream))
            names += [path] * (1 + (status[:1] == "T"))
        at, found, started = -1, [], False
        for raw in stream:
            line = raw.decode("utf-8", "replace").removesuffix("\n")
            if raw.startswith(b"diff --git ") and not _open(found):
                if started:
                    yield names[at] if at < len(names) else "", found
                at, found, started = at + 1, [], True
            else:
                _add_line(found, line)
        if started:
            yield names[at] if at < len(names) else "", found
        stream.close()
        if run.wait():
            raise RuntimeError(f"git diff failed in {self.root}")


class _Blobs:
    """One ``git cat-file --batch``, asked for a blob at a time, so no more than one is held."""

    def __init__(self, root: str):
        self.run = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def get(self, blob: str) -> bytes | None:
        self.run.stdin.write(f"{blob}\n".encode())
        self.run.stdin.flush()
        head = self.run.stdout.readline().split(b" ")
        if len(head) != 3:
            return None
        return self.run.stdout.read(int(head[2]) + 1)[:-1]

    def close(self) -> None:
        self.run.stdin.close()
        self.run.stdout.close()
        self.run.wait()


def _until_zero(stream) -> bytes:
    out = bytearray()
    while (byte := stream.read(1)) not in (b"", b"\0"):
        out += byte
    return bytes(out)


def _shown(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace").replace("\\", "/")


def _open(found: list[dict]) -> bool:
    """Whether the last hunk still waits for lines."""
    return bool(found) and (found[-1]["left"][0] > 0 or found[-1]["left"][1] > 0)


KIND_OF = {" ": "Context", "+": "Addition", "-": "Deletion"}


def _add_line(found: list[dict], line: str) -> None:
    """A line of one file's patch: the head of a hunk, or a line of the last one."""
    if _open(found):
        kind = KIND_OF.get(line[:1])
        if kind:
            found[-1]["lines"].append({"kind": kind, "text": line[1:]})
            found[-1]["left"][0] -= kind != "Addition"
            found[-1]["left"][1] -= kind != "Deletion"
        return
    head = HUNK_HEAD.match(line)
    if head:
        n = [int(x) if x else 1 for x in head.groups()]
        found.append({"old_start": n[0], "old_lines": n[1], "new_start": n[2], "new_lines": n[3], "header": line + "\n", "lines": [], "left": [n[1], n[3]]})


def _untracked(text: str) -> dict:
    lines = [x.removesuffix("\r") for x in (text[:-1] if text.endswith("\n") else text).split("\n")] if text else []
    return {"old_start": 0, "old_lines": 0, "new_start": 1, "new_lines": len(lines), "header": "untracked file", "lines": [{"kind": "Addition", "text": x} for x in lines]}


def _decoded(data: bytes | None) -> str | None:
    try:
        return None if data is None else data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _text(data: bytes | None) -> str | None:
    return None if data is None or len(data) > MOST_CONTENT else _decoded(data)


class _Commits(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _CommitStream(DataSourceStreamReader):
    """The commits of a branch, along first parents, oldest first.  An offset is the id of the last commit read."""

    def __init__(self, options: dict[str, str]):
        self.options = {k: options[k] for k in ("path", "batch", "partition_bytes") if k in options}
        self.root = discover(options.get("path", "."))
        self.branch = options.get("branch", "HEAD")
        self.since = options.get("since", "")
        self.commits = int(options.get("commits", "16"))
        if self.branch.startswith("-") or self.since.startswith("-"):
            raise ValueError("not a revision")

    def _id(self, revision: str) -> str:
        return git(self.root, "rev-parse", "--verify", "-q", f"{revision}^{{commit}}", check=False).decode().strip()

    def initialOffset(self) -> dict:
        return {"commit": self._id(self.since) if self.since else ""}

    def latestOffset(self) -> dict:
        return {"commit": self._id(self.branch) or self.initialOffset()["commit"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not end["commit"] or start == end:
            return []
        since = [f"^{start['commit']}"] if start["commit"] else []
        ids = git(self.root, "rev-list", "--reverse", "--first-parent", end["commit"], *since).decode().split()
        return [_Commits(ids[k : k + self.commits]) for k in range(0, len(ids), self.commits)]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        for commit in partition.ids:
            reader = _Reader({**self.options, "mode": "commit", "commit": commit, "changeset": commit})
            for part in reader.partitions():
                yield from reader.read(part)


class GitChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _CommitStream:
        return _CommitStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session; its code travels with it, so workers need not have the package.  Filters of Python
    sources are pushed down from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        spark.dataSource.register(GitChanges)
    finally:
        cloudpickle.unregister_pickle_by_value(package)
