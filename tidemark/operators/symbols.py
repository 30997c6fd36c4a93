"""Comparison of the symbols of two versions of a file.

Symbols come as rows (changeset_id, file, side, sym_idx, name, kind, start_line, end_line, signature, is_test,
is_public, body); changes as rows of CHANGE.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE = (
    "changeset_id STRING, file STRING, name STRING, kind STRING, change STRING, confidence FLOAT, old_signature STRING, new_signature STRING, "
    "old_start INT, old_end INT, new_start INT, new_end INT, evidence ARRAY<STRING>, moved_from STRING"
)
_FIELDS = ("sym_idx", "start_line", "end_line", "signature", "is_public", "body")


def _change(name: Column, kind: str, confidence: float, evidence: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("change"), F.lit(confidence).cast("float").alias("confidence"), F.array(evidence).alias("evidence"))


def paired(symbols: DataFrame) -> DataFrame:
    """Old and new symbols side by side: the n-th of a kind and name in a file with the n-th of the other side.

    Where a file comes with several symbols of one place, signature and body settle their order.

    One aggregate over the key stands for a full outer join of the two sides.
    """
    turn = F.row_number().over(Window.partitionBy("changeset_id", "file", "kind", "name", "side").orderBy("sym_idx", "signature", "body"))
    sides = symbols.withColumn("rn", turn).withColumn("s", F.struct(*_FIELDS))
    return sides.groupBy("changeset_id", "file", "kind", "name", "rn").agg(
        F.max(F.when(F.col("side") == "old", F.col("s"))).alias("o"), F.max(F.when(F.col("side") == "new", F.col("s"))).alias("n")
    )


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select(
        "changeset_id", "file", F.col("c.name").alias("name"), "kind", F.col("c.change").alias("change"), F.col("c.confidence").alias("confidence"),
        F.col("o.signature").alias("old_signature"), F.col("n.signature").alias("new_signature"), F.col("o.start_line").alias("old_start"), F.col("o.end_line").alias("old_end"),
        F.col("n.start_line").alias("new_start"), F.col("n.end_line").alias("new_end"), F.col("c.evidence").alias("evidence"), F.lit(None).cast("string").alias("moved_from"),
    )


def _compared(name: Column, o: Column, n: Column, change) -> Column:
    """The changes (by ``change`` of name, kind of change, confidence and evidence) of a symbol that both sides have: signature, else body; and visibility besides."""
    signature = F.concat(F.lit("signature: '"), o["signature"], F.lit("' → '"), n["signature"], F.lit("'"))
    body = (o["body"] != n["body"]) & (o["body"] != "") & (n["body"] != "") & (o["start_line"] > 0) & (n["start_line"] > 0)
    return F.array_compact(
        F.array(
            F.when(o["signature"] != n["signature"], change(name, "SignatureChanged", 0.95, signature)).when(body, change(name, "Modified", 0.9, F.lit("body lines differ"))),
            F.when(o["is_public"] != n["is_public"], change(name, "VisibilityChanged", 0.95, F.lit("visibility flag changed"))),
        )
    )


def _added(name: Column, change) -> Column:
    return change(name, "Added", 0.98, F.lit("no matching symbol in base version"))


def _removed(name: Column, change) -> Column:
    return change(name, "Removed", 0.95, F.lit("symbol absent from new version"))


def compared(pairs: DataFrame) -> DataFrame:
    """Changes of symbols that both sides have: signature, else body; and visibility besides."""
    return _finished(pairs.where("o IS NOT NULL AND n IS NOT NULL").withColumn("c", F.explode(_compared(F.col("name"), F.col("o"), F.col("n"), _change))))


def added_removed(pairs: DataFrame) -> DataFrame:
    """Changes of symbols that one side alone has."""
    lone = pairs.where("o IS NULL OR n IS NULL")
    return _finished(lone.withColumn("c", F.when(F.col("o").isNull(), _added(F.col("name"), _change)).otherwise(_removed(F.col("name"), _change))))


def partner_places(old: pa.Array, new: pa.Array) -> pa.Array:
    """For two lists of keys in each row the place (from 0) of each key's partner in the other list, else -1: the n-th of equal keys and the n-th there are partners."""
    lists = (old, new)
    sizes = [np.asarray(pc.fill_null(pc.list_value_length(a), 0), np.int64) for a in lists]
    rows = np.concatenate([np.repeat(np.arange(len(old)), n) for n in sizes])
    at = np.concatenate([np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) for n in sizes])
    side = np.repeat([0, 1], [n.sum() for n in sizes])
    keys = np.asarray(pa.concat_arrays([a.flatten() for a in lists]).dictionary_encode().indices, np.int64)
    order = np.lexsort((at, side, keys, rows))
    same = lambda *xs: np.logical_and.reduce([x[1:] == x[:-1] for x in xs])
    place, again = np.arange(len(order)), np.concatenate([[False], same(rows[order], keys[order], side[order])])[: len(order)]
    turn = np.empty(len(order), np.int64)
    turn[order] = place - np.maximum.accumulate(np.where(again, 0, place))
    order = np.lexsort((side, turn, keys, rows))
    met = same(rows[order], keys[order], turn[order])
    a, b = order[:-1][met], order[1:][met]
    to = np.full(len(order), -1, np.int32)
    to[a], to[b] = at[b], at[a]
    ends = [np.concatenate([[0], n.cumsum()]).astype(np.int32) for n in sizes]
    parts = np.split(to, [sizes[0].sum()])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(e), pa.array(t)) for e, t in zip(ends, parts, strict=True)], names=["old", "new"])


def with_partners(files: DataFrame) -> DataFrame:
    """Files (old, new: the lists of their symbols, in order) with ``to``, the places of the symbols' partners.

    It pairs as paired() does, within the row of a file: no symbol is shuffled.
    """

    @F.arrow_udf("struct<old:array<int>,new:array<int>>")
    def match(old: pa.Array, new: pa.Array) -> pa.Array:
        return partner_places(old, new)

    key = lambda s: F.concat(s["kind"], F.lit("\0"), s["name"])
    return files.withColumn("to", match(F.transform("old", key), F.transform("new", key)))


def _lone(side: str) -> Column:
    return F.filter(side, lambda s, i: F.get(F.col("to")[side], i) < 0)


def lone_rows(files: DataFrame) -> DataFrame:
    """Added and removed symbols with their bodies, a row each, of files ``with_partners``: what moves.candidates() finds for added_removed()."""
    none = lambda kind: F.lit(None).cast(kind)

    def row(change: str):
        def of(s: Column) -> Column:
            field = lambda here, c, kind: (s[c] if change == here else none(kind))
            return F.struct(
                s["name"].alias("name"), s["kind"].alias("kind"), F.lit(change).alias("change"), field("Removed", "signature", "string").alias("old_signature"), field("Added", "signature", "string").alias("new_signature"),
                field("Removed", "start_line", "int").alias("old_start"), field("Removed", "end_line", "int").alias("old_end"), field("Added", "start_line", "int").alias("new_start"), field("Added", "end_line", "int").alias("new_end"),
                s["body"].alias("body"),
            )

        return of

    of_side = lambda change, side: F.coalesce(F.transform(_lone(side), row(change)), F.array())
    return files.select("changeset_id", F.col("path").alias("file"), F.inline(F.concat(of_side("Removed", "old"), of_side("Added", "new"))))


def change_lists() -> Column:
    """A file's symbol changes (name, kind, at, change, confidence, moved_from, evidence) in this order, of files ``with_partners``: what diff_symbols() finds without renames.  Null if none."""

    def change(kind: Column, at: Column):
        return lambda name, what, confidence, evidence: F.struct(
            name.alias("name"), kind.alias("kind"), at.alias("at"), F.lit(what).alias("change"), F.lit(confidence).cast("float").alias("confidence"), F.lit(None).cast("string").alias("moved_from"), F.array(evidence).alias("evidence")
        )

    pairs = F.filter(F.transform("old", lambda s, i: F.struct(s.alias("o"), F.get("new", F.when(F.get(F.col("to")["old"], i) >= 0, F.get(F.col("to")["old"], i))).alias("n"))), lambda p: p["n"].isNotNull())
    both = F.flatten(F.transform(pairs, lambda p: _compared(p["o"]["name"], p["o"], p["n"], change(p["o"]["kind"], p["n"]["start_line"]))))
    removed = F.transform(_lone("old"), lambda s: _removed(s["name"], change(s["kind"], s["start_line"])))
    added = F.transform(_lone("new"), lambda s: _added(s["name"], change(s["kind"], s["start_line"])))
    every = F.array_sort(F.concat(*[F.coalesce(x, F.array()) for x in (both, removed, added)]))
    return F.when(F.size(every) > 0, every)


def _bigrams(name: str) -> Counter:
    s = name.lower()
    return Counter([s[i : i + 2] for i in range(len(s) - 1)] or [s])


def similarity(a: str, b: str) -> tuple[int, int]:
    """Bigram Dice coefficient of two names without case, as a fraction."""
    if a == b:
        return 1, 1
    grams = [_bigrams(a), _bigrams(b)]
    return 2 * (grams[0] & grams[1]).total(), grams[0].total() + grams[1].total()


class _Names:
    """Names of one kind, with the places of each bigram, so that a name meets all of them in one pass over its own bigrams."""

    def __init__(self, names: list[str]):
        self.sizes = np.zeros(len(names), np.int64)
        places: dict[str, list[tuple[int, int]]] = {}
        for i, name in enumerate(names):
            grams = _bigrams(name)
            self.sizes[i] = grams.total()
            for gram, times in grams.items():
                places.setdefault(gram, []).append((i, times))
        self.places = {g: (np.array([i for i, _ in p]), np.array([t for _, t in p])) for g, p in places.items()}

    def shared(self, grams: Counter) -> np.ndarray:
        """Bigrams that each name has in common with these."""
        out = np.zeros(len(self.sizes), np.int64)
        for gram, times in grams.items():
            if gram in self.places:
                at, have = self.places[gram]
                out[at] += np.minimum(have, times)
        return out


def greedy_matches(olds: list[str], news: list[str]) -> list[tuple[int, int]]:
    """Places (old, new): new names, in order, each with the most similar old one left, over 0.6; of equals the first."""
    index, free, found = _Names(olds), np.ones(len(olds), bool), []
    for n, name in enumerate(news):
        if not free.any():
            break
        grams = _bigrams(name)
        hits, total = 2 * index.shared(grams), index.sizes + grams.total()
        # quotients of equal fractions are the same double, and those of different ones are not, below 2**26
        ratio = np.where(free & (10 * hits > 6 * total), hits / total, 0.0)
        best = int(ratio.argmax())
        if ratio[best] > 0:
            free[best] = False
            found.append((best, n))
    return found


def renamed(pairs: DataFrame) -> DataFrame:
    """Added, removed and renamed symbols of files where both happen.

    A match depends on those before it of its file and kind, so these leftover symbols meet in one task: no more than a
    source that is parsed at all holds.  Kinds without both sides left never leave the JVM.
    """
    lone = pairs.where("o IS NULL OR n IS NULL").withColumn("side", F.when(F.col("n").isNull(), "old").otherwise("new"))
    of_kind = Window.partitionBy("changeset_id", "file", "kind")
    both = (F.max("side").over(of_kind) == "old") & (F.min("side").over(of_kind) == "new")
    lone = lone.withColumn("both", both)
    mine = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("name", "rn")))).alias(side)
    kinds = lone.where("both").groupBy("changeset_id", "file", "kind").agg(mine("old"), mine("new"))

    # many small lists go through each Python call
    @F.pandas_udf("array<struct<o:int,n:int>>")
    def match(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[{"o": o, "n": n} for o, n in greedy_matches(list(a), list(b))] for a, b in zip(old, new, strict=True)])

    found = kinds.withColumn("m", F.explode(match(F.col("old")["name"], F.col("new")["name"])))
    at = lambda side, c: F.get(side, F.col("m")[side[0]])[c].alias(f"{side}_{c}")
    matched = found.select("changeset_id", "file", "kind", at("old", "name"), at("old", "rn"), at("new", "name"), at("new", "rn"))
    # a matched symbol takes its partner's place: both ends meet on the new one's name
    ends = matched.select("changeset_id", "file", "kind", F.explode(F.array(
        F.struct(F.lit("old").alias("side"), F.col("old_name").alias("name"), F.col("old_rn").alias("rn"), F.col("new_name").alias("to_name"), F.col("new_rn").alias("to_rn")),
        F.struct(F.lit("new").alias("side"), F.col("new_name").alias("name"), F.col("new_rn").alias("rn"), F.col("new_name").alias("to_name"), F.col("new_rn").alias("to_rn")),
    )).alias("e")).select("changeset_id", "file", "kind", "e.*")
    key = ["changeset_id", "file", "kind", "name", "rn", "side"]
    met = lone.where("both").join(ends, key, "left")
    two = met.where("to_rn IS NOT NULL").groupBy("changeset_id", "file", "kind", "to_name", "to_rn").agg(
        F.max(F.when(F.col("side") == "old", F.col("name"))).alias("old_name"), F.max("o").alias("o"), F.max("n").alias("n")
    )
    why = F.concat(F.lit("same-kind symbol with similar name ("), "old_name", F.lit(" vs "), "to_name", F.lit(")"))
    pairs_found = two.withColumn("c", _change(F.concat("old_name", F.lit(" → "), "to_name"), "Renamed", 0.7, why))
    return _finished(pairs_found).unionByName(added_removed(met.where("to_rn IS NULL"))).unionByName(added_removed(lone.where("NOT both")))


def diff_symbols(symbols: DataFrame, *, renames: bool = True) -> DataFrame:
    """All symbol changes between the two sides, at most two for a pair."""
    pairs = paired(symbols)
    return compared(pairs).unionByName(renamed(pairs) if renames else added_removed(pairs))

