"""Operators on documents against brute-force versions, with edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import common, components, decontam, fingerprint, mixing, neardup, substrings, tokens, toxicity

WS = "\x20\t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# -- fingerprints


def test_fingerprints_of_edited_texts(edge_docs, edge_rows):
    got = rows_of(fingerprint.edited_fingerprints(edge_docs))
    assert len(got) == len(edge_rows)
    ordered = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in edge_rows), key=lambda r: (-r[0], r[1]))
    expected = collections.Counter()
    for k, (i, t) in enumerate(ordered):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]
        expected[(None if i == -(1 << 63) else i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint.sketch(t).text())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprints_empty_and_single(no_docs, edge_docs):
    assert fingerprint.edited_fingerprints(no_docs).count() == 0
    (one,) = rows_of(fingerprint.edited_fingerprints(edge_docs.where("doc_id = 9")))
    assert one["near_next"] == 1.0


def brute_shingles(text):
    """Hashes of a text's five-word shingles, in plain integers."""
    most = (1 << 64) - 1
    hashes = [xxhash.xxh64_intdigest(w) for w in words(text)]
    out = set()
    for j in range(max(1, len(hashes) - 4) if hashes else 0):
        z = k = min(5, len(hashes))
        for h in hashes[j : j + k]:
            z = (z * 0x9E3779B97F4A7C15 + h) & most
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & most
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & most
        out.add(z ^ (z >> 31))
    return out


def retained(found):
    return found if len(found) <= 256 else {h for h in found if h < 1 << 61}


def test_fingerprints_match_brute_force(edge_docs, edge_rows):
    """Fingerprints and likeness against sets of plain integers."""
    below = lambda found: {h for h in found if h < 1 << 61}
    expected = collections.Counter()
    ordered = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in edge_rows), key=lambda r: (-r[0], r[1]))
    for k, (i, t) in enumerate(ordered):
        cut, after = len(t) // 3, ordered[(k + 1) % len(ordered)][1]
        own, other, following = (brute_shingles(x) for x in (t, t[: len(t) - cut] + after[:cut], after))
        likeness = []
        for x in (other, following):
            a, b = (own, x) if len(own) <= 256 and len(x) <= 256 else (below(own), below(x))
            likeness.append(len(a & b) / len(a | b) if a | b else 1.0)
        expected[(None if i == -(1 << 63) else i, len(t), frozenset(retained(own)), frozenset(retained(other)), *likeness)] += 1
    kept = lambda text: frozenset(fingerprint.Sketch.parse(text).hashes.tolist())
    got = rows_of(fingerprint.edited_fingerprints(edge_docs))
    assert collections.Counter((r["doc_id"], r["n_chars"], kept(r["fingerprint"]), kept(r["edited_fingerprint"]), r["near_edited"], r["near_next"]) for r in got) == expected


def test_sketch_estimates_jaccard_and_containment():
    rng = random.Random(5)
    a = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    b = a[:3000] + [f"z{rng.randrange(10**6)}" for _ in range(3000)]
    whole, half, part = (fingerprint.sketch(" ".join(x)) for x in (a, b, a[:200]))
    assert abs(whole.likeness(half) - 1 / 3) < 0.08
    assert part.containment(whole) == 1.0 and whole.containment(part) < 0.1
    assert whole.merge(half).containment(whole) < 1 and whole.containment(whole.merge(half)) == 1.0
    assert fingerprint.Sketch.parse(whole.text()).text() == whole.text()


def test_merged_sketches_are_sketches_of_the_union():
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (0, 3, 100, 200, 256, 257, 900, 900, 5000)]
    for a in sets:
        for b in sets:
            assert fingerprint.Sketch.of(a).merge(fingerprint.Sketch.of(b)).text() == fingerprint.Sketch.of(np.union1d(a, b)).text()


def test_excerpts_of_a_long_text_are_contained_in_it():
    rng = random.Random(7)
    text = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    whole = fingerprint.sketch(" ".join(text))
    for n in (8, 20, 60, 400):
        found = [fingerprint.sketch(" ".join(text[a : a + n])).containment(whole) for a in range(0, 40_000, 4000)]
        assert {x for x in found if x is not None} == {1.0}
        stranger = fingerprint.sketch(" ".join(f"q{a}" for a in range(n))).containment(whole)
        assert stranger in (None, 0.0)


# -- token counts


def test_token_counts_match_greedy(spark, edge_docs, edge_rows):
    vocabulary = [b" a", b"ab", b" ab", b"abc", b"bc", b" one", b"o", b"ne", b"spam", b" spa", b"m", b"am", b"cd", b"abcde"]
    known = set(vocabulary) | {bytes([i]) for i in range(256)}

    def greedy(data):
        n, at = 0, 0
        while at < len(data):
            at = next(e for e in range(len(data), at, -1) if data[at:e] in known)
            n += 1
        return n

    automaton = tokens.LongestMatch(vocabulary)
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcdeo ") for _ in range(rng.randrange(12)))
        assert automaton.count(data) == greedy(data)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_bytes"], r["n_tokens"]) for r in rows_of(tokens.token_counts(edge_docs, vocabulary)))
    assert got == collections.Counter((i, len(words(t)), sum(map(len, words(t))), sum(greedy(b" " + w) for w in words(t))) for i, t in edge_rows)


def test_token_counts_empty(no_docs):
    assert tokens.token_counts(no_docs, [b"a"]).count() == 0


# -- substring dedup


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            if i is not None:
                key = b" ".join(w[j : j + 50])
                first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if i is not None and first[b" ".join(w[j : j + 50])] < i:
                gone[j : j + 50] = True
        out[(i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(edge_docs, edge_rows):
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substrings.remove_repeats(edge_docs)))
    assert got == brute_repeats(edge_rows)


def test_repeats_on_random_splices(spark):
    rng = random.Random(8)
    rows = []
    pool = [[f"t{rng.randrange(3 if k % 3 else 500)}" for _ in range(140)] for k in range(6)]
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(80)
            text += p[a : a + rng.randrange(30, 100)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
        rows.append((i, " ".join(text)))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == brute_repeats(rows)
    kept = {r["doc_id"]: r for r in rows_of(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True))}
    assert all(hashlib.sha256(b" ".join(words(r["kept_text"]))).hexdigest() == r["kept_sha256"] for r in kept.values())


def test_repeats_do_not_depend_on_hashes(spark):
    """With names of 3 bits different words share names everywhere; the comparison of words finds that out."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, " ".join([f"p{i}"] * (i % 3) + base[a : a + 80] + [f"w{rng.randrange(300)}" for _ in range(60)])) for i, a in enumerate(rng.randrange(120) for _ in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substrings.remove_repeats(docs, names=((0, 3), (1, 64)))))
    assert got == brute_repeats(rows)
    with pytest.raises(RuntimeError):
        substrings.remove_repeats(docs, names=((0, 3),))


def test_hot_rows_too_wide_to_broadcast_are_salted(spark):
    left = spark.range(9_000).selectExpr("id % 3000 * cast(id % 2 = 0 as int) AS k", "id", "array(id) AS more")
    right = common.written(left.groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.repeat(F.lit("wide "), 5_000).alias("wide")))
    plain = left.join(right.drop("w"), "k")
    for limit in (0, 32 << 20):
        for how in ("inner", "left"):
            got = common.split_join(left.unionByName(spark.createDataFrame([(-1, 5, [5])], left.schema)), right, ["k"], "w", how, limit_bytes=limit)
            assert "w" not in got.columns and got.where("wide IS NULL").count() == (how == "left")
            assert got.where("wide IS NOT NULL").agg(F.count(F.lit(1)), F.sum("id"), F.max(F.length("wide"))).first() == plain.agg(F.count(F.lit(1)), F.sum("id"), F.max(F.length("wide"))).first()
    salted = common.split_join(left, right, ["k"], "w", limit_bytes=0)
    assert "explode" in salted._jdf.queryExecution().toString() and common.split_join(left, right, ["k"], "w", limit_bytes=32 << 20)._jdf.queryExecution().toString().count("explode") == 0


def test_only_refuted_documents_are_searched_again(spark, monkeypatch):
    """Two words that share a name by chance refute one stretch: its documents alone take a second pass."""
    how = (0, 12)
    by_name = collections.defaultdict(list)
    for k in range(20_000):
        by_name[int(substrings.word_names([f"w{k}".encode()], how)[0])].append(f"w{k}")
    names = [v for v in by_name.values() if len(v) > 1]
    one, other = names[0][:2]
    apart = [v[0] for v in by_name.values()]
    text = lambda seed, n=70: random.Random(seed).sample(apart[:2_000], n)
    shared, far = text(1), text(2)
    rows = [(i, " ".join([f"w{i}", *far])) for i in range(5)] + [(10, " ".join([*shared[:35], one, *shared[35:]])), (11, " ".join([*shared[:35], other, *shared[35:]])), (12, " ".join(["x", *shared[:35], other, *shared[35:]]))]
    rows += [(20 + i, " ".join(text(100 + i))) for i in range(20)]
    passes, found = [], substrings._found_stretches
    monkeypatch.setattr(substrings, "_found_stretches", lambda rows, how: passes.append(sorted(r["id"] for r in rows.select("id").collect())) or found(rows, how))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), names=(how, (1, 64)))))
    assert got == brute_repeats(rows)
    assert len(passes) == 2 and passes[1] == [10, 11, 12]


def test_stretches_grow_past_windows():
    assert substrings.grown([(1, 0, 10, 12, 110), (1, 0, 13, 13, 113), (1, 0, 30, 40, 130), (1, 0, 200, 200, 300), (2, 0, 14, 14, 14)]) == [(10, 80, 1, 0, 110), (200, 50, 1, 0, 300), (14, 50, 2, 0, 14)]
    assert list(substrings.pieces(200, 400)) == [(200, 56), (256, 256), (512, 88)]


def test_every_window_has_an_anchor_of_its_content():
    rng = random.Random(4)
    for size in (1, 2, 3, 20, 5000):
        base = [str(rng.randrange(size)).encode() for _ in range(130)]
        docs = [[str(rng.randrange(size)).encode() for _ in range(rng.randrange(30))] + base[a : a + 70] for a in (0, 17, 41, 60)]
        seen = {}
        for doc, found in zip(docs, substrings.anchors([common.hash_words(d) for d in docs]), strict=True):
            assert len(found) == max(0, len(doc) - 49) and (found != 0).all()
            for j, anchor in enumerate(found):
                assert seen.setdefault(tuple(doc[j : j + 50]), anchor) == anchor


def test_repeats_empty(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


# -- decontamination


def test_wand_finds_all_above_threshold():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 20)))) for i in range(120)]
    df = collections.Counter(w for _, t in items for w in set(decontam.terms_of(t)))
    index = decontam.Index(items, df, len(items), 8.0, decontam.Options(threshold=0.5, block=4))
    for _ in range(200):
        terms = sorted({index.terms[w] for w in {rng.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(rng.randrange(1, 12))}})
        scores = collections.Counter()
        for t in terms:
            for i, w in zip(*index.postings[t], strict=True):
                scores[i] += w
        assert sorted(i for i, _ in index.search(terms)) == sorted(i for i, s in scores.items() if s >= 0.5 - 1e-9)


def test_leaks_are_found_and_others_left(spark, edge_docs, no_docs):
    rng = random.Random(6)
    word = lambda: f"k{rng.randrange(700)}"
    items = [(n, " ".join(word() for _ in range(n + 6)) + "?\n" + " ".join(word() for _ in range(8))) for n in range(12)] + [(90, None), (91, ""), (None, "x y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(40):
        filler = [word() for _ in range(rng.randrange(5, 500))]
        if i % 2 == 0:
            a = rng.randrange(len(filler))
            leak = items[i % 12][1].upper() if i % 4 == 0 else items[i % 12][1].replace("?", ",")
            filler[a:a] = leak.split()
        rows.append((i, " ".join(filler)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontam.contaminated(docs, bench))}
    assert got == {(i, i % 12) for i in range(0, 40, 2)}
    clean = decontam.without_contaminated(docs, bench)
    assert {r["doc_id"] for r in rows_of(clean)} == set(range(1, 40, 2)) and clean.columns == docs.columns
    few = decontam.Options(index_bytes=200)
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(decontam.contaminated(docs, bench, options=few))} == got
    assert decontam.contaminated(edge_docs, bench).count() == 0
    assert decontam.contaminated(no_docs, bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.without_contaminated(edge_docs, bench).count() == edge_docs.count()


def brute_leaks(rows, items, options):
    """BM25 scores, overlaps and best passages in plain Python, every item against every passage."""
    known = {i: decontam.terms_of(t) for i, t in items if i is not None and decontam.terms_of(t)}
    texts = dict(items)
    df = collections.Counter(w for ws in known.values() for w in set(ws))
    mean = sum(map(len, known.values())) / len(known)
    step = max(map(len, known.values()))
    out = {}
    for doc, text in rows:
        words_ = decontam.terms_of(text)
        for start in range(0, len(words_), step):
            passage = words_[start : start + 2 * step]
            for i, ws in known.items():
                norm = options.k1 * (1 - options.b + options.b * len(ws) / mean)
                raw = {w: np.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * n * (options.k1 + 1) / (n + norm) for w, n in collections.Counter(ws).items()}
                score = sum(x for w, x in raw.items() if w in set(passage)) / sum(raw.values())
                if score < options.threshold - 1e-9:
                    continue
                k = min(options.shingle, len(ws))
                there = {tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)}
                held = [tuple(ws[j : j + k]) in there for j in range(len(ws) - k + 1)]
                covered = [any(held[max(0, j - k + 1) : j + 1]) for j in range(len(ws))]
                q = decontam.question_words(texts[i])
                row = (sum(held) / len(held), score, start, sum(covered[:q]) / q, sum(covered[q:]) / (len(ws) - q) if len(ws) > q else 1.0)
                if row[0] >= options.overlap and min(row[3], row[4]) >= options.part and ((doc, i) not in out or row[:2] > out[doc, i][:2]):
                    out[doc, i] = row
    return out


def test_leaks_match_brute_force_whatever_the_number_of_indexes(spark):
    rng = random.Random(16)
    word = lambda: f"k{rng.randrange(400)}"
    items = [(n, " ".join(word() for _ in range(rng.randrange(3, 40))) + "? " + " ".join(word() for _ in range(rng.randrange(9)))) for n in range(25)]
    items += [(30, items[3][1]), (31, items[4][1] + " " + word())]
    rows = []
    for d in range(50):
        text = [word() for _ in range(rng.randrange(2, 300))]
        for _ in range(rng.randrange(3)):
            leak = [w for w in rng.choice(items)[1].split() if rng.random() < 0.97]
            at = rng.randrange(len(text))
            text[at:at] = leak
        rows.append((d, " ".join(text)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    options = decontam.Options(overlap=0.6, part=0.3)
    expected = brute_leaks(rows, items, options)
    assert len(expected) > 20
    for index_bytes in (1 << 20, 300):
        got = rows_of(decontam.contaminated(docs, bench, options=decontam.Options(overlap=0.6, part=0.3, index_bytes=index_bytes)))
        found = {(r["doc_id"], r["item_id"]): (r["overlap"], r["score"], r["passage_start"], r["question"], r["answer"]) for r in got}
        assert found.keys() == expected.keys() and len(got) == len(found)
        assert all(np.allclose(found[x], expected[x]) for x in expected)


# -- near duplicates


def brute_components(rows, shingle, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = [], {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        s = frozenset(tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
        sets.append((i, s))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def test_without_near_duplicates_keeps_all_columns(spark, edge_docs, no_docs):
    kept = neardup.without_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and no_docs.columns == neardup.without_near_duplicates(no_docs).columns
    assert sorted(str(r["doc_id"]) for r in rows_of(kept)) == sorted(str(r["doc_id"]) for r in rows_of(neardup.near_duplicates(edge_docs)) if r["kept"])


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 85, 1_500_000), (3, 85, 4_000), (5, 80, 1_500)])
def test_near_duplicates_match_brute_force(spark, edge_rows, shingle, percent, block):
    rng = random.Random(1)
    rows = list(edge_rows)
    for g in range(2):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows) + 100, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = neardup.Options(shingle=shingle, percent=percent, block=block)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(neardup.near_duplicates(docs, options=options)))
    assert got == brute_components(rows, shingle, percent)


@pytest.mark.parametrize("cell", [2_000, 16])
def test_near_copies_among_texts_with_one_passage(spark, cell):
    """Every indexed value is of a passage that all texts hold, so each list has all of them."""
    rng = random.Random(5)
    passage = [f"p{rng.randrange(9999)}" for _ in range(100)]
    bar = neardup.shingle_set(" ".join(passage), 5)[11]
    rows = []
    for _ in range(60):
        text = list(passage)
        while len(text) < 180 + rng.randrange(40):
            word = f"w{rng.randrange(99999)}"
            if neardup.shingle_set(" ".join([*text[-4:], word]), 5)[0] > bar:
                text.append(word)
        for body in (text, text[:-3]):
            rows.append((rng.randrange(1 << 40), " ".join(body)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = neardup.Options(cell=cell)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(neardup.near_duplicates(docs, options=options)))
    assert got == brute_components(rows, 5, 80)
    assert sum(n for (_, _, _, kept), n in got.items() if kept) == 60


@pytest.mark.parametrize("sides", [False, True])
def test_only_texts_outside_a_cells_largest_group_look_for_others(monkeypatch, sides):
    """A group of 2,000 near copies is not compared with itself, and the likeness of a text and all of them is found at once."""
    rng = np.random.default_rng(3)
    base = np.arange(0, 9600, 100)
    rows = [(96, 1, np.sort(np.concatenate([base[:60], rng.choice(base[:30], 4, replace=False) + 50 + k % 50])), k % 2 if sides else 0) for k in range(2_000)]
    half = [(96, 2 + k, np.sort(np.concatenate([base[:42], base[:22] + 1 + k])), k % 2 if sides else 0) for k in range(30)]  # share 42 values, enough for a look, but 38 of the union's 64
    close = (96, 90, np.sort(np.concatenate([base[:60], base[5:9] + 40])), 1 if sides else 0)
    calls = collections.Counter()
    for name in ("union1d", "flatnonzero"):  # flatnonzero: once for each text that looks, and once for these
        monkeypatch.setattr(np, name, lambda *a, _f=getattr(np, name), _n=name, **k: (calls.update([_n]), _f(*a, **k))[1])
    found = neardup._joining([*rows, *half, close], neardup.Options(shingle=3, percent=85))
    assert calls["union1d"] == 0 and calls["flatnonzero"] <= 1 + 31
    assert len(found) == 1 and found[0][0] == 2_030 and found[0][1] < 2_000
    union = np.union1d(close[2], rows[found[0][1]][2])[:64]
    assert found[0][2] == np.isin(union, np.intersect1d(close[2], rows[found[0][1]][2])).sum() / 64


def test_near_duplicates_edges(edge_docs, no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.without_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert 7 in ids and 8 not in ids and {1, 2, 3}.issubset(ids) and None in ids and 5 not in ids


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    found = {r["node"]: r["component"] for r in rows_of(components.connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df: tables.append(1) or common.written(df))
    links = spark.createDataFrame([(1, 1 + i) for i in range(1, 50)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r["node"]: r["component"] for r in rows_of(components.connected_components(links))} == {i: 1 for i in range(1, 51)} | {100: 100, 101: 100}
    assert len(tables) == 1


def test_components_beyond_broadcast_sizes(spark, monkeypatch):
    monkeypatch.setattr(components, "fits_broadcast", lambda *_: False)
    links = [(i, i + 1) for i in range(60)] + [(300 + i, 200) for i in range(9)]
    found = {r["node"]: r["component"] for r in rows_of(components.connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert found == {i: 0 for i in range(61)} | {i: 200 for i in (200, *range(300, 309))}


# -- mixing


def brute_mix(rows):
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or "")))}
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    target, open_, left = {}, set(weight), 1.5 * sum(size.values())
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2.0 * size[s]]
        if not over:
            total = sum(weight[x] for x in open_)
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(2.0 * size[s] for s in over)
        open_ -= set(over)
    return size, target


def test_mix_meets_targets(edge_docs, edge_rows, spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}" if i % 11 else None, rng.randrange(60)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, w long")
    from pyspark.sql import functions as F

    got = rows_of(mixing.mix(docs, F.col("w")))
    size, target = brute_mix(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    again = rows_of(mixing.mix(docs.repartition(5), F.col("w")))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_very_many_ranges_and_of_one_id(spark, monkeypatch):
    """More than 2**15 ranges of a source take the same words as one, and so do many rows of one id or none."""
    from pyspark.sql import functions as F

    rows = [(i % 90 if i % 7 else None, "s", i % 5) for i in range(500)] + [(1000 + i, "t", 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, w long")
    one = collections.Counter(map(str, rows_of(mixing.mix(docs, F.col("w")))))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 0.005)
    assert collections.Counter(map(str, rows_of(mixing.mix(docs, F.col("w"))))) == one
    assert sum(one.values()) == len(rows)


def test_mix_edges(edge_docs, edge_rows, no_docs):
    from pyspark.sql import functions as F

    got = rows_of(mixing.mix(edge_docs, common.word_count(F.col("text"))))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(words(t))) for i, t in edge_rows)
    assert mixing.mix(no_docs, common.word_count(F.col("text"))).count() == 0


# -- toxicity


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(9)
    common_words = [f"c{k}" for k in range(40)]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        text = [rng.choice(common_words) if rng.random() < 0.7 else f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile,", "nasty!", "rotten"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, marks))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, y) for i, y in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.97
    joined = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, marks, options=toxicity.Options(broadcast_bytes=0)))}
    assert all(abs(joined[i]["score"] - got[i]["score"]) < 1e-9 for i in got)
    flipped = spark.createDataFrame([(i, 1 - y if got[i]["held_out"] else y) for i, y in labels], "doc_id long, toxic int")
    assert all(abs(r["score"] - got[r["doc_id"]]["score"]) < 1e-12 for r in rows_of(toxicity.score(docs, flipped)))
    clean = toxicity.without_toxic(docs, marks)
    assert clean.columns == docs.columns and {r["doc_id"] for r in rows_of(clean)} == {i for i, r in got.items() if r["predicted"] == 0}


def test_class_models_match_brute_force(spark):
    """Interpolated Kneser-Ney in plain Python: probabilities that sum to 1 in every context, and their ratios."""
    rng = random.Random(13)
    options = toxicity.Options(least_docs=2, least_g2=1.0, rare=2)
    rows = []
    for k in range(60):
        toxic = k % 3 == 0
        rows.append((" ".join(rng.choice(["bad", "thing"] if toxic and rng.random() < 0.5 else ["a", "b", "c", "d", f"r{k}"]) for _ in range(12)), int(toxic)))
    counts = common.written(toxicity.count_expressions(spark.createDataFrame(rows, "text string, toxic int")))
    model = toxicity.models(counts, 40, 20, options)
    ids = lambda text: toxicity.word_ids(text).tolist()
    d, single, pair = options.discount, [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for text, toxic in rows:
        w = ids(text)
        single[toxic].update(set(w))
        pair[toxic].update(set(zip([toxicity.START, *w[:-1]], w, strict=True)))
    vocabulary = sorted(set(single[0]) | set(single[1]))
    n = [collections.Counter(w for _, w in pair[c]) for c in (0, 1)]
    total = [sum(n[c].values()) for c in (0, 1)]
    seen = {w for w in vocabulary if single[0][w] + single[1][w] >= options.rare}
    unknown = -1
    shared = {w: (n[0][w] + n[1][w] + 0.5) / (sum(total) + 0.5 * (len(vocabulary) + 1)) for w in [*vocabulary, unknown]}
    first = [{w: max(n[c][w] - d, 0) / total[c] if w in seen else 0.0 for w in shared} for c in (0, 1)]
    word_p = [{w: first[c][w] + (1 - sum(first[c].values())) * shared[w] for w in shared} for c in (0, 1)]
    kept = {(r["v"], r["w"]) for r in rows_of(model.rows) if r["v"] != toxicity.SINGLE and r["w"] != toxicity.ANY}
    assert kept and kept < set(pair[0]) | set(pair[1])
    assert {r["w"] for r in rows_of(model.rows) if r["v"] == toxicity.SINGLE} == seen

    def p(c, v, w):
        t = sum(x for (y, _), x in pair[c].items() if y == v)
        more = {y: max(pair[c][(v, y)] - d, 0) / t for x, y in kept if x == v} if t else {}
        return more.get(w, 0.0) + (1 - sum(more.values())) * word_p[c][w]

    for v in [toxicity.START, *vocabulary]:
        assert all(abs(sum(p(c, v, w) for w in shared) - 1) < 1e-9 for c in (0, 1))
    r = model.rows.toPandas()
    ratios = toxicity.Ratios.of_rows(*(r[c].to_numpy() for c in ("v", "w", "ratio", "strong")), model.unknown)
    for text, _ in [*rows, ("never seen words bad thing a", 0)]:
        w = ids(text)
        expected = []
        for v, x in zip([toxicity.START, *w[:-1]], w, strict=True):
            v, x = (v if v in vocabulary or v == toxicity.START else unknown), (x if x in vocabulary else unknown)
            expected.append(np.log(p(1, v, x) / p(0, v, x)))
        assert np.allclose(ratios.of(toxicity.word_ids(text))[0], expected, atol=1e-6)  # ratios are shipped in 32 bits
        assert abs(ratios.features(text, 8)[0] - np.mean(expected)) < 1e-6


def test_toxicity_of_texts_without_words(spark):
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "..."), (2, "plain words"), (3, None)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in rows_of(toxicity.score(docs, marks)))


def test_toxicity_edges(spark, edge_docs, no_docs):
    marks = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.score(edge_docs, marks).count() == edge_docs.count()
    assert toxicity.score(no_docs, marks).count() == 0
    got = rows_of(toxicity.score(edge_docs, marks.where("false")))
    assert {r["score"] for r in got} == {0.0}
    assert toxicity.without_toxic(edge_docs, marks.where("false")).columns == edge_docs.columns
