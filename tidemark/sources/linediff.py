"""Line differences of two texts as hunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import HUNK

CONTEXT = 3


def _lines(text: str | None) -> list[str]:
    return text.split("\n")[:-1] if text and text.endswith("\n") else text.split("\n") if text else []


#: Edits up to which a search from both ends looks for the middle of a script; beyond, whole rows of lengths are computed bit by bit.
FEW_EDITS = 64
#: A line that stands in more places than this keeps its bit mask; the masks of others are made when needed.
RARE = 16


class _Masks:
    """Bit masks of the places of each line in y[left:right], for one stretch of it."""

    def __init__(self, y: list[int]):
        self.places: dict[int, list[int]] = {}
        for j, v in enumerate(y):
            self.places.setdefault(v, []).append(j)
        self.known: dict[int, int] = {}

    def __getitem__(self, value: int) -> int:
        places = self.places.get(value)
        if places is None:
            return 0
        if len(places) <= RARE:
            mask = 0
            for j in places:
                mask |= 1 << j
            return mask
        if value not in self.known:
            bits = bytearray(places[-1] // 8 + 1)
            for j in places:
                bits[j // 8] |= 1 << (j % 8)
            self.known[value] = int.from_bytes(bits, "little")
        return self.known[value]


def _row(x: list[int], y: list[int]) -> int:
    """Bits of the last row of the table of common lengths of x and y: a zero where the length grows by one."""
    masks, full = _Masks(y), (1 << len(y)) - 1
    row = full
    for v in x:
        mask = masks[v]
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return row


def _lengths(row: int, m: int) -> np.ndarray:
    """Common lengths with the first 0, 1 ... m lines."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((m + 7) // 8, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_length(a: list, b: list) -> int:
    """Length of a longest common subsequence, in about len(a) * len(b) / 64 steps."""
    known: dict = {}
    x, y = ([known.setdefault(line, len(known)) for line in side] for side in (a, b))
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    in_x, in_y = set(x), set(y)
    x, y = [v for v in x if v in in_y], [v for v in y if v in in_x]
    return lo + hi + (int(_lengths(_row(x, y), len(y))[-1]) if x and y else 0)


def shortest_edit(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Steps (kind, place in a, place in b) of a shortest edit script: Context, Deletion, Addition.

    The two lists are halved at a point that a shortest script passes, so memory stays linear whatever their distance.
    Lines are compared by number; lines that only one side has are taken out first, as they are edits in any script.
    """
    known: dict[str, int] = {}
    x, y = ([known.setdefault(line, len(known)) for line in side] for side in (a, b))
    in_x, in_y = set(x), set(y)
    xi, yi = [i for i, v in enumerate(x) if v in in_y], [j for j, v in enumerate(y) if v in in_x]
    pairs: list[tuple[int, int]] = []
    stack = [(0, len(xi), 0, len(yi))]
    xs, ys = [x[i] for i in xi], [y[j] for j in yi]
    while stack:
        lo, hi, left, right = stack.pop()
        while lo < hi and left < right and xs[lo] == ys[left]:
            pairs.append((lo, left))
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and xs[hi - 1] == ys[right - 1]:
            hi, right = hi - 1, right - 1
            pairs.append((hi, right))
        if hi - lo == 1 and xs[lo] in ys[left:right]:
            pairs.append((lo, ys.index(xs[lo], left)))
        elif hi - lo > 1 and left < right:
            i, j = _middle(xs, lo, hi, ys, left, right) or _halved(xs, lo, hi, ys, left, right)
            stack += [(lo, i, left, j), (i, hi, j, right)]
    pairs = sorted((xi[i], yi[j]) for i, j in pairs)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [("Deletion", k, j) for k in range(i, p)] + [("Addition", p, k) for k in range(j, q)]
        if p < len(a) and q < len(b):
            out.append(("Context", p, q))
        i, j = p + 1, q + 1
    return out


def _middle(x: list[int], lo: int, hi: int, y: list[int], left: int, right: int) -> tuple[int, int] | None:
    """A point of a shortest edit script of x[lo:hi] and y[left:right], whose first and last lines differ: searches from both ends meet there.

    None where they do not meet within FEW_EDITS edits each."""
    n, m = hi - lo, right - left
    most = min((n + m + 1) // 2, FEW_EDITS)
    delta, size = n - m, most + abs(n - m) + 2
    if abs(delta) > 2 * most:
        return None
    front, back = [0] * (2 * size + 1), [0] * (2 * size + 1)
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and front[size + k - 1] < front[size + k + 1])
            i = front[size + k + 1] if down else front[size + k - 1] + 1
            j = i - k
            while i < n and 0 <= j < m and x[lo + i] == y[left + j]:
                i, j = i + 1, j + 1
            front[size + k] = i
            if delta % 2 and -d < delta - k < d and 0 <= j <= m and i <= n and i + back[size + delta - k] >= n:
                return lo + i, left + j
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and back[size + k - 1] < back[size + k + 1])
            i = back[size + k + 1] if down else back[size + k - 1] + 1
            j = i - k
            while i < n and 0 <= j < m and x[hi - 1 - i] == y[right - 1 - j]:
                i, j = i + 1, j + 1
            back[size + k] = i
            if not delta % 2 and -d <= delta - k <= d and 0 <= j <= m and i <= n and i + front[size + delta - k] >= n:
                return hi - i, right - j
    return None


def _halved(x: list[int], lo: int, hi: int, y: list[int], left: int, right: int) -> tuple[int, int]:
    """The half of x[lo:hi] and the place in y[left:right] where a longest common subsequence passes it, from the rows of both halves."""
    half, m = (lo + hi) // 2, right - left
    above = _lengths(_row(x[lo:half], y[left:right]), m)
    below = _lengths(_row(x[half:hi][::-1], y[left:right][::-1]), m)[::-1]
    return half, left + int(np.argmax(above + below))


def hunks(old: str | None, new: str | None) -> list[dict]:
    """Hunks with three lines of context; deletions stand before additions."""
    a, b = _lines(old), _lines(new)
    steps = shortest_edit(a, b)
    changed = [p for p, s in enumerate(steps) if s[0] != "Context"]
    out: list[dict] = []
    groups: list[list[int]] = []
    for p in changed:
        if groups and p - groups[-1][1] <= 2 * CONTEXT:
            groups[-1][1] = p
        else:
            groups.append([p, p])
    for first, last in groups:
        part = steps[max(0, first - CONTEXT) : last + CONTEXT + 1]
        rows, block = [], {"Deletion": [], "Addition": []}
        for kind, i, j in [*part, ("Context", -1, -1)]:
            if kind == "Context":
                rows += [("Deletion", t) for t in block["Deletion"]] + [("Addition", t) for t in block["Addition"]]
                block = {"Deletion": [], "Addition": []}
                if i >= 0:
                    rows.append((kind, a[i]))
            else:
                block[kind].append(a[i] if kind == "Deletion" else b[j])
        olds, news = sum(k != "Addition" for k, _ in rows), sum(k != "Deletion" for k, _ in rows)
        at_old, at_new = part[0][1] + (olds > 0), part[0][2] + (news > 0)
        out.append({
            "old_start": at_old, "old_lines": olds, "new_start": at_new, "new_lines": news, "header": f"@@ -{at_old},{olds} +{at_new},{news} @@\n",
            "lines": [{"kind": k, "text": t} for k, t in rows],
        })
    return out


def with_hunks(changes: DataFrame) -> DataFrame:
    """Change records with their hunks and exact counts of added and deleted lines, in one Arrow pass.

    Reads old_content and new_content; further columns stay.  A null side is empty; equal sides have no hunk.
    """
    rest = [c for c in changes.columns if c not in ("hunks", "added_lines", "deleted_lines")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema if f.name in rest)

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hunks(o, n) for o, n in zip(batch["old_content"], batch["new_content"], strict=True)]
            count = lambda kind: [sum(line["kind"] == kind for h in hs for line in h["lines"]) for hs in found]
            yield batch[rest].assign(hunks=found, added_lines=count("Addition"), deleted_lines=count("Deletion"))

    return changes.select(*rest).mapInPandas(diff, f"{kinds}, hunks ARRAY<{HUNK}>, added_lines BIGINT, deleted_lines BIGINT")


def line_lists(changes: DataFrame) -> DataFrame:
    """Change records with ``added`` and ``deleted``, the texts of changed lines in order."""
    of = lambda kind: F.flatten(F.transform("hunks", lambda h: F.transform(F.filter(h["lines"], lambda x: x["kind"] == kind), lambda x: x["text"])))
    return changes.withColumn("added", of("Addition")).withColumn("deleted", of("Deletion"))


def snapshots(old: DataFrame, new: DataFrame, changeset_id: str = "snapshot") -> DataFrame:
    """Change records of two snapshots (path, content): files that one side lacks or that differ."""
    a, b = old.select("path", F.col("content").alias("old_content")), new.select("path", F.col("content").alias("new_content"))
    both = a.join(b, "path", "full_outer").where(~F.col("old_content").eqNullSafe(F.col("new_content")))
    status = F.when(F.col("old_content").isNull(), "Added").when(F.col("new_content").isNull(), "Deleted").otherwise("Modified")
    return both.select(F.lit(changeset_id).alias("changeset_id"), F.xxhash64("path").alias("file_idx"), "path", status.alias("status"), "old_content", "new_content")
