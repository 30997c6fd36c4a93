"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, estimates, exact Jaccard, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast, give_back, hash_words, mix64, released, shuffle_partitions, small_batches, written
from .components import connected_components

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    """shingle: words.  percent: texts are linked if 100 * intersection >= percent * union of their shingle sets.
    sketch: k.  indexed: smallest values that get an inverted list in the first round of candidates.  slack: by how
    much an estimate may lie under the threshold; a link whose estimate lies lower is missed.
    near: neighbours by size that each document meets in a part of a list.  part: documents of such a part.
    cell: texts of one list that the second round compares in a task with as many others.
    block: shingles of documents whose exact links one task finds at a time."""

    shingle: int = 5
    percent: int = 80
    sketch: int = 64
    indexed: int = 12
    slack: float = 0.22
    near: int = 2
    part: int = 48
    cell: int = 2_000
    block: int = 1_500_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a whole text's word shingles, A-Z lower-cased; with fewer words one shingle of all."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    hashes = hash_words(words)
    k = min(shingle, n)
    z = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        z = z * _BASE + hashes[i : i + n - k + 1]
    return np.unique(mix64(z) >> np.uint64(1))


def sketches(docs: DataFrame, options: Options) -> DataFrame:
    """(id, n, s1, s2, sketch): set size, 128-bit signature of the whole set, its k smallest hashes."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, s1, s2, low = [], [], [], []
            for text in batch["text"]:
                found = shingle_set(text, options.shingle)
                both = xxhash.xxh3_128_intdigest(found.tobytes())
                n.append(len(found))
                s1.append((both >> 64) - (1 << 63))
                s2.append((both & ((1 << 64) - 1)) - (1 << 63))
                low.append(found[: options.sketch].astype(np.int64))
            yield pd.DataFrame({"id": batch["id"], "n": n, "s1": s1, "s2": s2, "sketch": low})
            give_back()

    return docs.mapInPandas(build, "id long, n long, s1 long, s2 long, sketch array<long>")


def candidate_pairs(sets: DataFrame, options: Options) -> DataFrame:
    """(a, b, likeness) of texts (rep, n, sketch) whose estimated similarity comes near the threshold, a < b.

    In each retained value's list every text meets the list's hub, a random member, and its neighbours by size in a
    part of the list.  That is linear in the list's length; a list of a few texts gives all its pairs.  Texts left
    apart by this are what pairs_between_groups looks for.
    """
    entries = sets.select("rep", "n", F.explode(F.slice("sketch", 1, options.indexed)).alias("value"))
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("rep", "n"), F.xxhash64("value", "rep")).alias("hub")).where("size > 1")
    entries = written(entries.join(lists, "value"))
    star = entries.select("rep", "n", F.col("hub.rep").alias("rep2"), F.col("hub.n").alias("n2")).where("rep <> rep2")
    parts = entries.groupBy("value", F.pmod(F.xxhash64("rep", "value"), F.ceil(F.col("size") / options.part)).alias("part"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("n", "rep"))).alias("m")).where(F.size("m") > 1)
    after = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.transform(F.slice("m", i + 1, options.near), lambda y: F.struct(F.get("m", i - 1).alias("x"), y.alias("y"))))
    met = parts.select(F.explode(F.flatten(after)).alias("p")).select(F.col("p.x.rep").alias("rep"), F.col("p.x.n").alias("n"), F.col("p.y.rep").alias("rep2"), F.col("p.y.n").alias("n2"))
    pairs = star.unionByName(met).where(100 * F.least("n", "n2") >= options.percent * F.greatest("n", "n2"))
    pairs = pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).where("a <> b").distinct()
    left = sets.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, options.sketch)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return joined.select("a", "b", (both / F.size(union)).alias("likeness")).where(F.col("likeness") >= options.percent / 100 - options.slack)


def _joining(rows: list[tuple], options: Options) -> list[tuple[int, int, float]]:
    """(i, j, likeness) that join the groups of a cell's rows (n, label, sketch, side) with an estimate near the threshold.

    All rows are compared with those of other groups, or where there are two sides, of other groups and the other side.  One of
    two such rows lies outside the cell's largest group, so only the rows outside it look for others.
    """
    least, found = options.percent / 100 - options.slack, []
    sizes, sides = np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
    _, group = np.unique([r[1] for r in rows], return_inverse=True)
    lengths = np.array([len(r[2]) for r in rows], np.int64)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(rows)), lengths)
    _, ids = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owners, nth = owner[order], (np.arange(cuts[-1]) - cuts[owner])[order]  # of each value: the rows that have it, and its place in their sketches
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    few = group != np.bincount(group).argmax()
    place, split = np.arange(len(rows)), sides.any()
    for at in np.flatnonzero(few).tolist():
        open_ = (group != group[at]) & (~few | (place > at))
        if split:
            open_ &= sides != sides[at]
        if not open_.any():
            continue
        shared, low = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i, v in enumerate(ids[cuts[at] : cuts[at + 1]].tolist()):  # ascending, so a shared value's place in the union is known from its places in both
            who = owners[starts[v] : starts[v + 1]]
            if len(who) > 1:
                low[who] += i + nth[starts[v] : starts[v + 1]] - shared[who] < options.sketch
                shared[who] += 1
        fits = 100 * np.minimum(sizes, sizes[at]) >= options.percent * np.maximum(sizes, sizes[at])
        near = open_ & fits & (shared >= least * np.maximum(lengths, lengths[at]) - 1e-9)
        likeness = low / np.minimum(options.sketch, lengths + lengths[at] - shared)
        for h in np.flatnonzero(near & (likeness >= least)).tolist():
            if group[h] != group[at]:
                found.append((at, h, float(likeness[h])))
                group[group == group[h]] = group[at]
    return found


def pairs_between_groups(sets: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """(a, b, likeness), a < b: pairs that join all groups ``labels`` (node, component) between which any two texts of
    ``sets`` (rep, n, sketch) have an estimate near the threshold.  Nothing is sampled.

    Such texts share most of their sketches' values, so one value at least is among the rarest of either sketch that
    are left when as many as must be shared are set aside.  Lists of these values alone are searched, each in full if it
    has texts of two groups: in cells of two parts of the list and of one step of sizes, so a long list is many tasks.
    """
    least = options.percent / 100 - options.slack
    entries = sets.select("rep", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rare = entries.join(common, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("size", "value"))).alias("v"))
    known = sets.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("component", "rep").alias("label"), F.size("sketch").alias("k"))
    must = F.ceil(F.col("k") * F.lit(least) - 1e-9).cast("int")
    rare = rare.join(known, "rep").where(F.size("v") >= must).select("rep", "n", "label", F.explode(F.slice("v", F.lit(1), F.size("v") - must + 1)).alias("e"))
    rare = written(rare.select("rep", "n", "label", F.col("e.value").alias("value")))
    lists = rare.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2")
    rare = rare.join(lists.select("value", "size"), "value")
    step = F.floor(F.log(F.col("n").cast("double")) / max(math.log(100 / options.percent) * (1 + 1e-9), 1e-9))
    rare = rare.withColumn("parts", F.ceil(F.col("size") / options.cell)).withColumn("mine", F.pmod(F.xxhash64("rep", "value"), F.col("parts")))
    bands = F.when(F.col("parts") > 1, F.array(step, step - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rare = rare.withColumn("band", F.explode(bands)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = rare.select("rep", "n", "label", "value", "band", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    cells = cells.join(sets.select(F.col("rep").alias("r"), "sketch"), F.col("rep") == F.col("r")).drop("r")
    cells = cells.repartition(shuffle_partitions(sets.sparkSession), "value", "band", "p", "q").sortWithinPartitions("value", "band", "p", "q", "rep")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, rows = None, [], []

        def joined() -> pd.DataFrame:
            found = _joining(rows, options) if len({r[1] for r in rows}) > 1 else []
            return pd.DataFrame({"x": [ids[i] for i, _, _ in found], "y": [ids[j] for _, j, _ in found], "likeness": [e for _, _, e in found]}).astype({"x": "int64", "y": "int64", "likeness": "float64"})

        for batch in batches:
            for *at, rep, n, label, sketch, side in zip(*(batch[c] for c in ("value", "band", "p", "q", "rep", "n", "label", "sketch", "side")), strict=True):
                if at != key:
                    if len(ids) > 1:
                        yield joined()
                    if len(ids) > 1000:
                        give_back()
                    key, ids, rows = at, [], []
                ids.append(rep)
                rows.append((n, label, np.asarray(sketch, np.int64), side))
        if len(ids) > 1:
            yield joined()

    found = cells.mapInPandas(search, "x long, y long, likeness double")
    return found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("likeness").alias("likeness"))


def exact_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join all texts of a block which are linked, directly or over others, on their full sets.

    From each text in turn, all texts not yet reached are compared at once by counting shared shingles; those linked
    are reached.  So each text is compared with all that are left, and groups of copies shrink at their first text.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if both and 100 * both >= percent * (sizes.sum() - both):
            yield 0, 1
        return
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, ids = np.unique(everything, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owners = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    left = np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            at = queue.pop()
            mine = ids[cuts[at] : cuts[at + 1]]
            lo, count = starts[mine], starts[mine + 1] - starts[mine]
            ends = np.cumsum(count)
            if not len(ends) or not ends[-1]:
                continue
            places = np.arange(ends[-1]) + np.repeat(lo - (ends - count), count)
            shared = np.bincount(owners[places], minlength=n)
            hit = np.flatnonzero(left & (shared > 0) & (100 * shared >= percent * (sizes + sizes[at] - shared)))
            left[hit] = False
            queue.extend(hit.tolist())
            for h in hit.tolist():
                yield at, h


def links_in_blocks(docs: DataFrame, members: DataFrame, options: Options) -> DataFrame:
    """(a, b): texts b that true links within a block of ``members`` (node, g1, g2) join with others, from the whole texts of
    ``docs`` (id, text); a is the smallest id of those so joined, so the links of a block are stars.

    Members are broadcast to the texts while their counted size allows; else the join shuffles.
    """
    spark = docs.sparkSession
    found = members.withColumnRenamed("node", "m")
    if fits_broadcast(members.count(), 40):
        found = F.broadcast(found)
    texts = docs.join(found, F.col("id") == F.col("m")).select("g1", "g2", "id", "text")
    texts = texts.repartition(shuffle_partitions(spark), "g1", "g2").sortWithinPartitions("g1", "g2", "id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sets = None, [], []

        def links() -> pd.DataFrame:
            first = list(range(len(sets)))  # in the order of ids; exact_links reaches all others from the first of them
            reached = []
            for i, j in exact_links(sets, options.percent) if len(sets) > 1 else ():
                first[j] = first[i]
                reached.append(j)
            return pd.DataFrame({"a": [ids[first[j]] for j in reached], "b": [ids[j] for j in reached]}, dtype=np.int64)

        for batch in batches:
            for g1, g2, id_, text in zip(batch["g1"], batch["g2"], batch["id"], batch["text"], strict=True):
                if (g1, g2) != key:
                    if len(ids) > 1:
                        yield links()
                    if len(ids) > 100:
                        give_back()
                    key, ids, sets = (g1, g2), [], []
                ids.append(id_)
                sets.append(shingle_set(text, options.shingle))
        if len(ids) > 1:
            yield links()

    return texts.mapInPandas(search, "a long, b long").where("a <> b")


def similar_texts(docs: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """(node, component) of the texts (rep, n, sketch) that have a link, confirmed on full sets.

    Estimates cut the texts into candidate groups: those of short ways through the lists first, joined by those of all
    pairs between groups.  A group of up to options.block shingles is searched whole in one
    task.  A larger one is dealt out to blocks at random and searched block by block; then, between parts not yet joined,
    candidate pairs are confirmed, the likeliest first and more of them in each round; at last every text that
    is still outside a group's largest part is compared with all of its group.
    """
    keep = Scratch()
    found = _similar_texts(docs, sets, options, keep)
    keep.clear()
    return found


def _similar_texts(docs: DataFrame, sets: DataFrame, options: Options, keep: Scratch) -> DataFrame:
    pairs = released(keep(candidate_pairs(sets, options)))
    labels = connected_components(pairs.select("a", "b"))
    more = released(keep(pairs_between_groups(sets, labels, options)))
    pairs = pairs.unionByName(more)
    if not pairs.head(1):
        return connected_components(pairs.select("a", "b"))
    groups = connected_components(labels.toDF("a", "b").unionByName(more.select("a", "b"))) if more.head(1) else labels
    groups = groups.join(sets.select("rep", "n"), F.col("node") == F.col("rep")).select("node", "component", "n")
    sizes = groups.groupBy(F.col("component").alias("c")).agg(F.sum("n").alias("size"))
    dealt = groups.join(sizes, F.col("component") == F.col("c"))
    dealt = keep(dealt.select("node", F.col("component").alias("g1"), F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / options.block)).alias("g2"), (F.col("size") > options.block).alias("large")))
    links = keep(links_in_blocks(docs, dealt.drop("large"), options))
    large = dealt.where("large").select("node", F.col("g1").alias("group"))
    if not large.head(1):
        return connected_components(links)
    members = large.select(F.col("node").alias("m"))
    open_pairs = keep(pairs.join(members, F.col("a") == F.col("m"), "left_semi"))
    for parts in (16, 128, 1024):
        labels = connected_components(links)
        of = lambda x: labels.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}"))  # noqa: B023, E731
        apart = open_pairs.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
        apart = apart.select("a", "b", "likeness", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        apart = keep(apart)
        best = apart.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"), F.pmod(F.xxhash64("a", "b"), F.lit(parts)).alias("part"))
        best = keep(best.agg(F.max_by(F.struct("a", "b"), F.struct("likeness", "a", "b")).alias("p")).select("p.a", "p.b"))
        if not best.head(1):
            break
        twos = best.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("g1"), F.col("b").alias("g2"))
        links = keep(links.unionByName(links_in_blocks(docs, twos, options)))
        open_pairs = keep(apart.select("a", "b", "likeness").join(best, ["a", "b"], "left_anti"))
    links = links.unionByName(links_in_blocks(docs, _last_blocks(large, connected_components(links), sets, options), options))
    return connected_components(keep(links))


def _last_blocks(large: DataFrame, labels: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """Blocks (node, g1, g2) in which every text of a large group meets every one outside the group's largest part.

    Texts of that part are joined with each other already.  The group is dealt out to blocks, the others to pieces,
    and each block meets each piece in a task of its own, so nothing is left to the estimates.
    """
    placed = large.join(labels, "node", "left").select("node", "group", F.coalesce("component", "node").alias("label"))
    placed = written(placed.join(sets.select("rep", "n"), F.col("node") == F.col("rep")).drop("rep"))
    parts = placed.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    placed = placed.join(main, "group").withColumn("outside", F.col("label") != F.col("main"))
    half = options.block // 2
    sums = placed.groupBy(F.col("group").alias("s")).agg(
        F.ceil(F.sum("n") / half).alias("blocks"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / half).alias("pieces")
    ).where("pieces > 0")
    placed = placed.join(sums, F.col("group") == F.col("s"))
    turn = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    inside = placed.select("node", "group", turn(F.col("blocks")).alias("block"), F.explode(each("pieces")).alias("piece"), "pieces")
    outside = placed.where("outside").select("node", "group", F.explode(each("blocks")).alias("block"), turn(F.col("pieces")).alias("piece"), "pieces")
    rows = inside.unionByName(outside).select("node", F.col("group").alias("g1"), (F.col("block") * F.col("pieces") + F.col("piece")).alias("g2"))
    return written(rows.distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document; one of each component, the smallest id, is kept.

    Equal sets are one text from the start, whatever their number, so only different texts are searched.  Null or
    wordless texts have an empty set and are linked with nothing.  Rows that repeat an id share its component.  A
    null id is linked with nothing, has no component, and is kept.  A very long text is one set, held whole.  An empty table gives
    an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = written(sketches(rows, options))
    live = known.where("n > 0 AND id IS NOT NULL")
    texts = live.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "sketch")).alias("m"))
    texts = written(texts.select("s1", "s2", F.col("m.id").alias("rep"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")))
    joined = similar_texts(rows, texts.drop("s1", "s2"), options)
    named = texts.join(joined, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("found"))
    placed = known.drop("sketch").join(named, ["s1", "s2"], "left")
    lone = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("found")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), lone.alias("component_id"), F.coalesce(F.col("id") == lone, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, as they are, with all their columns whatever these are named.

    Of rows that repeat a kept id all stay, and so do those without id and null, empty or wordless texts.  Very long texts
    are compared whole.  An empty table gives an empty table.  The ids that go are broadcast while their counted size allows;
    else the join shuffles.
    """
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, options=options)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    gone = written(marked.where("NOT kept").select(F.col(id_col).alias("gone")).distinct())
    gone = F.broadcast(gone) if fits_broadcast(gone.count(), 16) else gone
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = whole.join(gone, F.col(names[id_col]) == F.col("gone"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
