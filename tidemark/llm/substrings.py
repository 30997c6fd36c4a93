"""Substring dedup by recompression: long word sequences that an earlier document has too are found, compared and removed.

Recompression renames a sequence in rounds.  The first round names runs of one word; each later round splits the
symbols into left and right ones by a bit of their name and names every pair of a left and a right symbol.  As a
decision looks at two neighbours only, equal sequences get equal symbols inside: each round can lose one symbol at
either end.

The low rounds, up to ``CAPS[-1]`` words, run within a task: there a name is a hash of what it stands for, so it is the
same everywhere without an exchange of every word.  The sizes in ``CAPS`` add up so that every window of ``WINDOW`` words
has at least one symbol that is decided by words of the window alone: runs lose two words at either end, the rounds
2, 2, 2, 4, 4 and 4, and of the 10 words left one symbol of at most 8 is whole.  The longest such symbol (of the
largest name, between equals) is the window's *anchor*.

The high rounds are aggregates over all documents.  The first keeps the anchors that more than one document has.
Windows on end with one anchor make a run, a symbol of 50 words and more; the second round names all distinct runs and
finds the first document of each.  Where several runs share an anchor, the third round names the single windows of
each run's first document.  Symbols then grow: those of a document that lie on end in the document they were first
seen in become one stretch, as long as the repeat.

Names only find repeats.  Every stretch is then compared word for word with the earlier document that has it.  Should one
differ, the documents that say so, and those they were said to repeat, are searched again with other names; all others
are done.  So no word goes because of a hash alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, discard, give_back, hash_words, mix64, released, small_batches, split_join, split_words, written

WINDOW = 50
CAPS = (2, 2, 4, 4, 4, 8)
#: Words that are parsed at a time.
CHUNK_WORDS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(WORD_PATTERN)


def parse(names: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of a sequence after all rounds: name, start, end, and the stretch of words that decides each.

    ``wall`` marks places between documents; nothing joins across them, and what looks at one is decided outside.
    """
    n = len(names)
    places = np.arange(n, dtype=np.int32)
    # runs: two equal words become one symbol, of longer runs each word stays
    edge = np.ones(n, bool)
    edge[1:] = (names[1:] != names[:-1]) | wall[1:] | wall[:-1]
    starts = np.flatnonzero(edge)
    length = np.diff(np.append(starts, n))
    of_run = np.repeat(length, length)
    keep = edge | (of_run != 2)
    st = places[keep]
    k = of_run[keep]
    en = (st + np.where(k == 2, 2, 1)).astype(np.int32)
    reach = np.where(k > 2, 2, 1)
    dl, dr = (st - reach).astype(np.int32), (en + reach).astype(np.int32)
    name = names[keep]
    name = np.where(k == 2, mix64(name * _BASE + np.uint64(2)), name)
    wall = wall[keep]
    dl[wall], dr[wall] = st[wall], en[wall]
    for number, cap in enumerate(CAPS):
        right = (mix64(name ^ np.uint64(0xA5A5_0000 + number)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:] & (en[1:] - st[:-1] <= cap)
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        lone_left = ~right & ~pair & ~wall
        lone_right = right & ~second & ~wall
        # pairs and lone left symbols look at the next symbol, lone right ones at the one before
        i = np.flatnonzero(pair | lone_left)
        j = np.flatnonzero(lone_right)
        new_dl, new_dr = dl.copy(), dr.copy()
        new_dl[i], new_dr[i] = np.minimum(dl[i], dl[i + 1]), np.maximum(dr[i], dr[i + 1])
        new_dl[j], new_dr[j] = np.minimum(dl[j], dl[j - 1]), np.maximum(dr[j], dr[j - 1])
        p = np.flatnonzero(pair)
        name = name.copy()
        en = en.copy()
        name[p] = mix64(name[p] * _BASE + name[p + 1])
        en[p] = en[p + 1]
        keep = ~second
        name, st, en, dl, dr, wall = name[keep], st[keep], en[keep], new_dl[keep], new_dr[keep], wall[keep]
    inside = ~wall
    return name[inside], st[inside], en[inside], dl[inside], dr[inside]


def anchors(docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each document's word hashes the anchor of every window, in order of the windows."""
    sizes = [len(d) for d in docs]
    wall_name = np.zeros(1, np.uint64)
    names = np.concatenate([x for d in docs for x in (wall_name, d)] + [wall_name])
    firsts = np.cumsum([1] + [s + 1 for s in sizes])
    wall = np.zeros(len(names), bool)
    wall[np.append(0, firsts[1:] - 1)] = True
    name, st, en, dl, dr = parse(names, wall)
    rank = ((en - st).astype(np.uint64) << np.uint64(60)) | (name >> np.uint64(4))
    low = np.maximum(dr - WINDOW, 0)
    span = dl - low + 1
    use = span > 0
    low, span, rank = low[use], span[use], rank[use]
    level = np.frexp(span.astype(np.float64))[1] - 1
    n = len(names)
    best: np.ndarray | None = None
    for k in range(int(level.max(initial=0)), -1, -1):
        now = np.zeros(n, np.uint64)
        step = 1 << k
        if best is not None:
            np.maximum(now, best, out=now)
            np.maximum(now[step:], best[:-step], out=now[step:])
        at = level == k
        a, r = low[at], rank[at]
        np.maximum.at(now, a, r)
        np.maximum.at(now, a + span[at] - step, r)
        best = now
    if best is None:
        best = np.zeros(n, np.uint64)
    for first, size in zip(firsts, sizes, strict=False):
        yield best[first : first + max(0, size - WINDOW + 1)]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) of a sequence, from prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if len(_powers[0]) < n + 1:
        size = 1 << (n + 1).bit_length()
        for slot, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _powers[slot] = np.cumprod(p)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words) * _powers[0][:n])])
    return mix64((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def _chunks(rows: Iterator, size) -> Iterator[list]:
    held, words = [], 0
    for row in rows:
        held.append(row)
        words += size(row)
        if words >= CHUNK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


#: Words that a stretch is compared by at a time.
PIECE = 256
#: How words are hashed, in the order in which it is tried: seed and bits.
NAMES = ((0, 64), (1, 64), (2, 64), (3, 64))


def word_names(words: list[bytes], how: tuple[int, int]) -> np.ndarray:
    seed, bits = how
    names = hash_words(words, seed)
    return names if bits == 64 else names & np.uint64((1 << bits) - 1)


def _runs(rows: DataFrame, how: tuple[int, int]) -> DataFrame:
    """(id, h, key, extent, first, last): each run of windows of one anchor (key) in rows (id, h, text), and the name of its words."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = ((i, h, word_names(w, how)) for i, h, t in zip(batch["id"], batch["h"], batch["text"], strict=True) if len(w := split_words(t)) >= WINDOW)
            for chunk in _chunks(docs, lambda r: len(r[2])):
                out = []
                for (i, h, array), anchor in zip(chunk, anchors([r[2] for r in chunk]), strict=True):
                    cuts = np.flatnonzero(anchor[1:] != anchor[:-1])
                    a, b = np.append(0, cuts + 1), np.append(cuts, len(anchor) - 1)
                    extent = stretch_hashes(array, a, b + WINDOW).view(np.int64)
                    out.append((np.full(len(a), i), np.full(len(a), h), anchor[a].view(np.int64), extent, a.astype(np.int32), b.astype(np.int32)))
                yield pd.DataFrame(dict(zip(("id", "h", "key", "extent", "first", "last"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
            give_back()

    return rows.where("id IS NOT NULL").select("id", "h", "text").mapInPandas(find, "id long, h long, key long, extent long, first int, last int")


def _run_claims(found: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """Claims (id, h, first, last, lo, lo_h, at) of runs that a smaller id has whole, and open runs (id, h, first, last, key).

    Open are the runs of their first document whose anchor other runs have too: single windows decide there.
    """
    shared = found.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    runs = keep(split_join(found, keep(shared), ["key"], "n"))
    kinds = runs.groupBy("key", "extent").agg(F.min(F.struct("id", "h", "first")).alias("src"), F.count(F.lit(1)).alias("n"))
    kinds = keep(kinds)
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", (F.col("n") > 1).alias("mixed"), "n")
    kinds = keep(split_join(kinds.withColumnRenamed("n", "runs"), keep(many), ["key"], "n"))
    placed = keep(split_join(runs, kinds.where("mixed OR runs > 1").withColumnRenamed("runs", "n"), ["key", "extent"], "n"))
    claims = placed.where("id > src.id").select("id", "h", "first", "last", F.col("src.id").alias("lo"), F.col("src.h").alias("lo_h"), F.col("src.first").alias("at"))
    return claims, placed.where("id = src.id AND mixed").select("id", "h", "first", "last", "key")


def _window_claims(rows: DataFrame, open_runs: DataFrame, how: tuple[int, int], keep: Scratch) -> DataFrame:
    """Claims of single windows in open runs that a smaller id has in another open run.

    Equal windows have one anchor, so a window goes by its run's anchor and its own name, 128 bits together.
    """
    asked = open_runs.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last", "key")).alias("o"))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, text, runs in zip(batch["id"], batch["h"], batch["text"], batch["o"], strict=True):
                spans = sorted({(r["first"], r["last"], r["key"]) for r in runs})  # the runs of a document do not overlap
                at = spread([(a, b) for a, b, _ in spans])
                key = np.repeat(np.array([k for *_, k in spans], np.int64), [b - a + 1 for a, b, _ in spans])
                names = stretch_hashes(word_names(split_words(text), how), at, at + WINDOW).view(np.int64)
                out.append((key, names, np.full(len(at), i), np.full(len(at), h), at.astype(np.int32)))
            if out:
                yield pd.DataFrame(dict(zip(("key", "name", "id", "h", "first"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
            give_back()

    texts = rows.select("id", "h", "text").join(asked, ["id", "h"])
    windows = keep(texts.mapInPandas(name, "key long, name long, id long, h long, first int"))
    shared = windows.groupBy("key", "name").agg(F.min(F.struct("id", "h", "first")).alias("src"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("src.id < hi").select("key", "name", "src", "n")
    rows = split_join(windows, keep(shared), ["key", "name"], "n").where("id > src.id")
    return rows.select("id", "h", "first", F.col("first").alias("last"), F.col("src.id").alias("lo"), F.col("src.h").alias("lo_h"), F.col("src.first").alias("at"))


def grown(claims: list[tuple]) -> list[tuple]:
    """Stretches (first word, words, lo, lo_h, at) of claims (lo, lo_h, first, last, at): those on end in both documents joined."""
    out: list[list] = []
    for lo, lo_h, first, last, at in sorted(claims, key=lambda c: (c[0], c[1], c[4] - c[2], c[2])):
        end = last + WINDOW
        if out and out[-1][2:4] == [lo, lo_h] and out[-1][4] - out[-1][0] == at - first and first <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], end - out[-1][0])
        else:
            out.append([first, end - first, lo, lo_h, at])
    return [tuple(x) for x in out]


def _stretches(claims: DataFrame) -> DataFrame:
    """(id, h, s): each document's stretches, arrays of (first, n, lo, lo_h, at)."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [grown([(c["lo"], c["lo_h"], c["first"], c["last"], c["at"]) for c in cs]) for cs in batch["c"]]
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "s": found})

    listed = claims.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "lo_h", "first", "last", "at")).alias("c"))
    return listed.mapInPandas(grow, "id long, h long, s array<struct<first:int,n:int,lo:long,lo_h:long,at:int>>")


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Words that the windows starting at the given places cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, windows, 1)
    np.add.at(steps, np.minimum(windows + WINDOW, n), -1)
    return np.cumsum(steps[:n]) > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the given words; what is left between two cuts stays as it is, pieces joined by a line end."""
    words = list(_WORD.finditer(text))
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    breaks = np.flatnonzero(np.diff(kept) > 1)
    return "\n".join(text[words[a].start() : words[b].end()] for a, b in zip(kept[np.append(0, breaks + 1)], kept[np.append(breaks, len(kept) - 1)], strict=True))


def spread(runs) -> np.ndarray:
    """Windows of runs given as pairs of first and last."""
    return np.concatenate([np.arange(0), *(np.arange(a, b + 1) for a, b in runs)])


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()




def pieces(at: int, n: int) -> Iterator[tuple[int, int]]:
    """(start, words) of a stretch cut at every PIECE words of the document it is compared with.

    So many stretches of one document ask for the same whole pieces, and what they ask for stays within a bound
    that depends on that document's length only.
    """
    end = at + n
    while at < end:
        to = min(end, (at // PIECE + 1) * PIECE)
        yield at, to - at
        at = to


def _piece(k) -> Column:
    """The k-th piece of a stretch s, as pieces() cuts it."""
    start, end = F.greatest(F.col("s.at").cast("long"), k * PIECE), F.least(F.col("s.at") + F.col("s.n").cast("long"), (k + 1) * PIECE)
    return F.struct(start.cast("int").alias("at"), (end - start).cast("int").alias("n"))


def _settled(rows: DataFrame, stretches: DataFrame, carried: dict[str, str], with_text: bool) -> DataFrame:
    """Results and, beside them, the words of every piece of every stretch, from both documents it should be in."""
    steps = F.sequence(F.floor(F.col("s.at") / PIECE), F.floor((F.col("s.at") + F.col("s.n") - 1) / PIECE))
    each = F.transform(steps, _piece)
    asked = stretches.select(F.explode("s").alias("s")).select("s.lo", "s.lo_h", F.explode(each).alias("p"))
    asked = asked.groupBy("lo", "lo_h", "p").agg(F.lit(1).alias("one")).groupBy(F.col("lo").alias("id"), F.col("lo_h").alias("h")).agg(F.collect_list("p").alias("w"))
    joined = rows.where("id IS NOT NULL").join(stretches, ["id", "h"], "left").join(asked, ["id", "h"], "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("s", stretches.schema["s"].dataType), ("w", asked.schema["w"].dataType))]
    columns = ["id", "h", "text", *carried, "s", "w"]
    joined = joined.select(*columns).unionByName(rows.where("id IS NULL").select("id", "h", "text", *carried, *none))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_words, n_removed, shas, texts, proofs = [], [], [], [], []
            for id_, h, text, own, wanted in zip(batch["id"], batch["h"], batch["text"], batch["s"], batch["w"], strict=True):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                for x in own if own is not None else ():
                    gone[x["first"] : x["first"] + x["n"]] = True
                    back = x["first"] - x["at"]
                    proofs += [(x["lo"], x["lo_h"], a, n, b" ".join(words[a + back : a + back + n]), False, id_, h) for a, n in pieces(x["at"], x["n"])]
                for x in wanted if wanted is not None else ():
                    proofs.append((id_, h, x["at"], x["n"], b" ".join(words[x["at"] : x["at"] + x["n"]]), True, id_, h))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                shas.append(_sha([w for w, g in zip(words, gone, strict=True) if not g] if n_removed[-1] else words))
                texts.append(cut_text(text, gone) if with_text and n_removed[-1] else text if with_text else None)
            frame = pd.DataFrame({"id": batch["id"], **{c: batch[c] for c in carried}, "n_words": n_words, "n_removed": n_removed, "kept_sha256": shas, "kept_text": texts})
            yield frame.assign(h=batch["h"], lo=None, lo_h=None, at=None, n=None, words=None, source=None, of=None, of_h=None).astype({"id": "Int64"})
            if proofs:
                frame = pd.DataFrame(proofs, columns=["lo", "lo_h", "at", "n", "words", "source", "of", "of_h"])
                yield frame.reindex(columns=["id", *carried, "n_words", "n_removed", "kept_sha256", "kept_text", "h", *frame.columns]).astype(object).where(lambda t: t.notna(), None)
            give_back()

    kinds = "".join(f", {c} {t}" for c, t in carried.items())
    return joined.mapInPandas(settle, f"id long{kinds}, n_words long, n_removed long, kept_sha256 string, kept_text string, h long, lo long, lo_h long, at int, n int, words binary, source boolean, of long, of_h long")


def _refuted(state: DataFrame, stretches: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """Documents (id, h) of which a piece has other words than the document it should be in, and their stretches without such
    pieces; None where all agree.

    Whoever says that a window is in its first document has a piece there, so documents that share such a window with
    each other, but not with that first one, are all among these.
    """
    pieces_ = ["lo", "lo_h", "at", "n"]
    proofs = state.where("n_words IS NULL")
    wrong = proofs.groupBy(*pieces_).agg(F.min("words").alias("a"), F.max("words").alias("b"), F.max("source").alias("source")).where("a <> b OR NOT source")
    if not wrong.head(1):
        return None
    proofs = keep(proofs.join(wrong, pieces_, "left_semi"))
    right = keep(proofs.where("source").groupBy(*pieces_).agg(F.min("words").alias("words")))
    cut = F.transform(F.sequence(F.floor(F.col("s.at") / PIECE), F.floor((F.col("s.at") + F.col("s.n") - 1) / PIECE)), _piece)
    own = stretches.select("id", "h", F.explode("s").alias("s")).select("id", "h", "s.lo", "s.lo_h", (F.col("s.first") - F.col("s.at")).alias("back"), F.explode(cut).alias("p"))
    own = own.select("id", "h", "lo", "lo_h", "back", F.col("p.at").alias("at"), F.col("p.n").alias("n"))
    said = proofs.where("NOT source").join(right.withColumnRenamed("words", "true_words"), pieces_, "left").where("true_words IS NULL OR words <> true_words")
    said = keep(said.select(*pieces_, "of", "of_h").distinct())
    bad = keep(said.select(F.col("of").alias("id"), F.col("of_h").alias("h")).distinct())
    good = own.join(bad, ["id", "h"], "left_semi").join(said.withColumnRenamed("of", "id").withColumnRenamed("of_h", "h"), ["id", "h", *pieces_], "left_anti")
    row = F.struct((F.col("at") + F.col("back")).cast("int").alias("first"), F.col("n").cast("int").alias("n"), "lo", "lo_h", F.col("at").cast("int").alias("at"))
    return bad, keep(good.select("id", "h", row.alias("s")))


def _found_stretches(rows: DataFrame, how: tuple[int, int]) -> DataFrame:
    """Stretches of all documents of rows (id, h, text), as a written table."""
    keep = Scratch()
    found = released(written(_runs(rows, how)))
    claims, open_runs = _run_claims(found, keep)
    discard(found)
    claims = claims.unionByName(_window_claims(rows, open_runs, how, keep))
    stretches = released(written(_stretches(claims)))
    keep.clear()
    return stretches


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False, names: tuple[tuple[int, int], ...] = NAMES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text], carried columns) of every document.

    A word goes if a window of WINDOW words that covers it also starts in a document with a smaller id; windows are
    those of the input.  Null and short texts have no window.  Rows that repeat an id do not count as smaller than
    each other.  A null id neither removes nor loses anything.  An empty table gives an empty table.  kept_text is
    the text itself where nothing goes, and null for a null text.  A text of any length is read whole, CHUNK_WORDS or one
    document at a time.  Columns that are not carried are not read, so their names cannot clash.

    Texts are shuffled to meet the windows in question and once more to be compared and cut.  Keys that very many
    documents share are aggregated before each shuffle and joined without one (split_join).
    """
    spark = small_batches(docs.sparkSession)
    carried = {f"carry_{c}": docs.schema[c].dataType.simpleString() for c in carry}
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    stretches = _found_stretches(rows, names[0])
    state = released(written(_settled(rows, stretches, carried, with_text)))
    results = ["id", "h", "n_words", "n_removed", "kept_sha256", "kept_text", *carried]
    final, doubtful = state.where("n_words IS NOT NULL").select(*results), state
    for how in [*names[1:], None]:
        keep = Scratch()
        refuted = _refuted(doubtful, stretches, keep)
        if refuted is None:
            break
        if how is None:
            raise RuntimeError("different words have the same names under every hash that was tried")
        bad, good = refuted
        # only documents with refuted pieces, and those that they were said to repeat, are searched again, by other names
        ends = keep(stretches.join(bad, ["id", "h"], "left_semi").select(F.explode("s").alias("s")).select(F.col("s.lo").alias("id"), F.col("s.lo_h").alias("h")).unionByName(bad).distinct())
        again = keep(rows.join(ends, ["id", "h"], "left_semi"))
        found = _found_stretches(again, how).join(bad, ["id", "h"], "left_semi")
        every = found.select("id", "h", F.explode("s").alias("s")).unionByName(good)
        before, stretches = stretches, written(every.groupBy("id", "h").agg(F.collect_list("s").alias("s")))
        doubtful = written(_settled(again, stretches, carried, with_text))
        mended = doubtful.where("n_words IS NOT NULL").join(bad, ["id", "h"], "left_semi").select(*results)
        final = written(final.join(bad, ["id", "h"], "left_anti").unionByName(mended))
        discard(before)
        keep.clear()
    discard(stretches)
    result = final.drop("h").withColumnRenamed("id", id_col)
    for c in carry:
        result = result.withColumnRenamed(f"carry_{c}", c)
    return result if with_text else result.drop("kept_text")
