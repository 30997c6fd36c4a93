"""Operators on pages, with edge cases."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import urlgraph, warc, webtext

EXTRA = ("id", "host", "path", "h", "n", "ordinal", "archive", "s")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def page_rows():
    long = "<p>" + "word " * 60_000 + "</p>"
    return [
        (1, "http://A.example.net/en/x?q#f", "<p>one</p>"), (2, "https://b.example.com/de/y", "<p>one</p>"), (3, "http://x.org/fr/", None), (4, None, ""), (5, "no host", "<p>five"), (6, "http://org", long),
        (7, "http://org?x://y/fr/", "é\r\nü\x00"), (7, "http://org?x://y/fr/", "é\r\nü\x00"), (None, "http://q.net/", "<p>one</p>"), (8, "http://net.example/", "<p>one</p>"), (9, "ftp://deep.sub.net/a\r\nb", "WARC/1.1\r\n\r\n"),
    ]


@pytest.fixture(scope="session")
def pages(spark, page_rows):
    df = spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(3)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    return df


# -- urls


def test_hosts_paths_and_rules(pages, page_rows):
    got = {r["page_id"]: r for r in rows_of(urlgraph.judge(pages))}
    assert len(rows_of(urlgraph.judge(pages))) == len(page_rows)
    found = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert found[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[2] == ("b.example.com", "/de/y", "example.com/de/", "block")
    assert found[3] == ("x.org", "/fr/", "org/fr/", "allow")
    assert found[4] == ("", "", None, "allow") and found[5] == ("", "", None, "allow")
    assert found[6][:3] == ("org", "", None) and found[7][:3] == ("org", "", None)
    assert found[None] == ("q.net", "/", "net/", "block")
    assert found[8][2] is None and found[9][:3] == ("deep.sub.net", "/a\r\nb", "net/")
    assert urlgraph.judge(pages.where("false")).count() == 0
    assert {r["rule"] for r in rows_of(urlgraph.judge(pages, rules=()))} == {None}


def test_many_rules_are_joined(pages):
    host, path = urlgraph.host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    few, many = (urlgraph.with_rule(rows, most_literals=n).select("page_id", "fit.rule", "fit.verdict").collect() for n in (200, 0))
    assert collections.Counter(few) == collections.Counter(many) and len({r["rule"] for r in few}) > 3


def test_rules_match_brute_force(spark):
    """Host, path and longest rule of random urls in plain Python, with rules as literals and as a table."""
    rng = random.Random(37)
    label = lambda: rng.choice(["a", "b", "co", "net", "org"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(f"{rng.choice(['x', 'y', 'en'])}/" for _ in range(rng.randrange(3)))
    rules = sorted({(rng.choice(["allow", "block"]), f"{host()}/{path()}") for _ in range(40)})
    rows = [(k, rng.choice(["http://", "HTTPS://", "://", "", "ftp://u@"]) + rng.choice([host(), host().upper()]) + rng.choice(["", "/", f"/{path()}", f"?{path()}", f"#{path()}", f"/{path()}q?z=http://b.net/"])) for k in range(400)]

    def judged(url):
        _, there, rest = url.partition("://")
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest)) if there else 0
        host_ = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]) if there else ""
        tail = rest[end:] if there else ""
        path_ = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(len(r), r, v) for v, r in rules if (host_ == r.split("/")[0] or host_.endswith("." + r.split("/")[0])) and path_.startswith(r[r.index("/") :])]
        return (host_, path_, *(max(fits)[1:] if fits else (None, None)))

    host_of, path_of = urlgraph.host_and_path(F.col("url"))
    df = spark.createDataFrame(rows, "id long, url string").select("id", host_of.alias("host"), path_of.alias("path"))
    for most in (200, 0):
        got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.with_rule(df, rules, most_literals=most).select("id", "host", "path", "fit.rule", "fit.verdict").collect()}
        assert got == {k: judged(u) for k, u in rows}
    assert len({judged(u)[2] for _, u in rows}) > 8


def test_propagation_follows_links(spark):
    links = [("good", "friend", 3), ("friend", "far", 1), ("liar", "bad", 2), ("minion", "liar", 1), ("good", "bad", 1)]
    seeds = [("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("lone", 0.0, 0.0)]
    frame = spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")
    options = urlgraph.Options(rounds=40, still=1e-12)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows_of(urlgraph.propagate(*frame, options))}
    trust, distrust = collections.defaultdict(float), collections.defaultdict(float)
    out, into = collections.Counter(), collections.Counter()
    for s, d, n in links:
        out[s] += n
        into[d] += n
    for _ in range(60):
        t, b = collections.defaultdict(float), collections.defaultdict(float)
        for h, x, y in seeds:
            t[h] += 0.15 * x
            b[h] += 0.15 * y
        for s, d, n in links:
            t[d] += 0.85 * trust[s] * n / out[s]
            b[s] += 0.85 * distrust[d] * n / into[d]
        trust, distrust = t, b
    assert all(abs(got[h][0] - trust[h]) < 1e-6 and abs(got[h][1] - distrust[h]) < 1e-6 for h in got)
    assert got["liar"][1] > got["good"][1] and got["friend"][0] > got["far"][0] > 0


def test_propagation_runs_to_its_tolerance(spark):
    """A ring, on which nothing is ever lost: far hosts have what is theirs and all trust is accounted for."""
    n, still = 20, 1e-2
    links = [(f"h{k}", f"h{(k + 1) % n}", 1) for k in range(n)]
    seeds = [(f"h{k}", float(k == 0), float(k == 3)) for k in range(n)]
    frames = spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows_of(urlgraph.propagate(*frames, urlgraph.Options(still=still)))}
    ring = np.array([0.85**k for k in range(n)]) * 0.15 / (1 - 0.85**n)
    assert sum(abs(got[f"h{k}"][0] - ring[k]) for k in range(n)) <= still and sum(abs(got[f"h{(3 - k) % n}"][1] - ring[k]) for k in range(n)) <= still
    assert abs(sum(t for t, _ in got.values()) - 1) <= still and got["h19"][0] > 0


def test_propagation_over_ten_thousand_hosts(spark):
    """Hubs that everyone links to or that link to everyone, dangling hosts, and hosts apart, against plain Python."""
    rng = random.Random(29)
    hosts = [f"h{k}" for k in range(10_000)]
    links = {("h0", f"h{k}") for k in range(1, 4000)} | {(f"h{k}", "h1") for k in range(2, 5000)}
    links |= {(rng.choice(hosts[:9000]), rng.choice(hosts[:9500])) for _ in range(20_000)}
    links = [(a, b, 1 + len(a + b) % 3) for a, b in sorted(links) if a != b]
    seeds = [(h, 1 / 50 if k % 200 == 0 else 0.0, 1 / 50 if k % 200 == 1 else 0.0) for k, h in enumerate(hosts)]
    options = urlgraph.Options(rounds=5, still=0.0)
    frames = spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows_of(urlgraph.propagate(*frames, options))}
    out, into = collections.Counter(), collections.Counter()
    for a, b, n in links:
        out[a] += n
        into[b] += n
    start = {h: (0.15 * x, 0.15 * y) for h, x, y in seeds}
    trust, distrust = {h: x for h, (x, _) in start.items()}, {h: y for h, (_, y) in start.items()}
    for _ in range(options.rounds):
        t, b = {h: x for h, (x, _) in start.items()}, {h: y for h, (_, y) in start.items()}
        for x, y, n in links:
            t[y] += 0.85 * trust[x] * n / out[x]
            b[x] += 0.85 * distrust[y] * n / into[y]
        trust, distrust = t, b
    assert got.keys() == set(hosts)
    assert all(abs(got[h][0] - trust[h]) < 1e-12 and abs(got[h][1] - distrust[h]) < 1e-12 for h in hosts)


def test_distrust_blocks_pages_without_rule(spark):
    html = '<a href="http://bad.net/x">x</a>'
    rows = [(1, "http://liar.com/a", html), (2, "http://fine.com/a", '<a href="/in">x</a>'), (3, "http://bad.net/", "")]
    got = {r["page_id"]: r["verdict"] for r in rows_of(urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == {1: "block", 2: "allow", 3: "block"}


def plain_verdicts(rows, rules, options):
    """Verdicts by the contract's words: the longest rule, else distrust over links between hosts, with dense sums in Python."""
    def host_path(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else None
        if rest is None:
            return "", ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path

    def rule_of(host, path):
        fits = [(len(r), r, v) for v, r in rules for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        return max(fits)[1:] if fits else (None, None)

    placed = [(i, *host_path(u), h) for i, u, h in rows]
    decided = [(i, host, path, *rule_of(host, path), h) for i, host, path, h in placed]
    links, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, host, _, _, verdict, html in decided:
        if host:
            counts[host]["n"] += 1
            counts[host][verdict] += 1
            for to in re.findall(r'href="http://([^/"]+)', html or ""):
                if to.lower() != host:
                    links[host, to.lower()] += 1
    share = lambda h, v: counts[h][v] / counts[h]["n"] if counts[h][v] >= options.seed_share * counts[h]["n"] else 0.0
    seeds = {v: {h: share(h, v) for h in counts} for v in ("allow", "block")}
    hosts = sorted({*counts, *(x for pair in links for x in pair)})
    score = {}
    for v, ends in (("allow", 0), ("block", 1)):
        total, fan = sum(seeds[v].values()) or 1.0, collections.Counter()
        for pair, n in links.items():
            fan[pair[ends]] += n
        own = {h: 0.15 * seeds[v].get(h, 0.0) / total for h in hosts}
        now = own
        for _ in range(200):
            after = dict(own)
            for pair, n in links.items():
                after[pair[1 - ends]] += 0.85 * now[pair[ends]] * n / fan[pair[ends]]
            now = after
        score[v] = now
    known = len([h for h in hosts if h in counts or score["allow"][h] + score["block"][h] > 0 or any(h in p for p in links)])
    out = {}
    for i, host, path, rule, verdict, _ in decided:
        t, b = (score[v].get(host, 0.0) for v in ("allow", "block"))
        bad = b > t and b >= options.margin * 0.15 / max(known, 1)
        out[i] = (host, path, rule, verdict or ("block" if bad else "allow"))
    return out


def test_judge_matches_plain_python(spark):
    rng = random.Random(41)
    hosts = ["a.net", "B.net", "shop.example.com", "example.com", "en.example.net", "news.org", "x.org", "one.com", "two.com", "three.com", "four.com", "five.com"]
    rows = []
    for i in range(90):
        host = rng.choice(hosts)
        path = rng.choice(["", "/", "/en/a", "/de/b?q=/fr/", "/fr/c#x", "/other"])
        to = "".join(f'<a href="http://{rng.choice(hosts[:4] if host in ("one.com", "two.com") else hosts)}/z">' for _ in range(rng.randrange(4)))
        rows.append((i, f"http://{host}{path}", to))
    rows += [(90, None, "<a href='http://a.net/'>"), (91, "no scheme", None), (92, "ftp://", "")]
    options = urlgraph.Options(still=1e-4)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), options=options))}
    assert got == plain_verdicts(rows, urlgraph.RULES, options)
    assert {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}


# -- archives


def test_archives_round_trip(pages, page_rows):
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(warc.archive_round_trip(pages)))
    firsts, expected, seen = {}, collections.Counter(), set()
    for i, _, h in page_rows:
        key = (h or "").encode()
        firsts[key] = min(firsts.get(key, 1 << 62), i if i is not None else 1 << 62)
    for i, _, h in page_rows:
        data = (h or "").encode()
        first = i == firsts[data] and data not in seen
        if first:
            seen.add(data)
        expected[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else firsts[data])] += 1
    assert got == expected
    assert {r["record_type"] for r in rows_of(warc.archive_round_trip(pages, least_bytes=1 << 40))} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_null_ids_and_repeated_rows_in_archives(spark, tmp_path):
    rows = [(None, "http://a/", "same"), (None, "http://b/", "same"), (5, None, "x"), (5, None, "x"), (None, None, "x"), (None, None, None), (7, "", "")]
    got = rows_of(warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), folder=str(tmp_path)))
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == collections.Counter(
        [(None, 4, "response", None), (None, 4, "revisit", None), (5, 1, "response", None), (5, 1, "revisit", 5), (None, 1, "revisit", 5), (7, 0, "response", None), (None, 0, "revisit", 7)]
    )
    ids = [line.split("\t")[0] for idx in (tmp_path / "normalised").glob("*.idx") for line in idx.read_text().splitlines()]
    assert len(ids) == len(set(ids)) == len(rows)


def test_normaliser_reads_any_member_layout():
    data = [warc.response(warc.record_id(str(k), "part-0", k), f"http://h/{k}", b"x" * k * 7, warc.payload_digest(b"x" * k * 7), "2020-01-01T00:00:00Z") for k in range(6)]
    for layout in ([data], [data[:2], data[2:]], [[d] for d in data]):
        source = io.BytesIO(b"".join(gzip.compress(b"".join(part)) for part in layout))
        target = io.BytesIO()
        index = list(warc.normalise_archive(source, target, {3: "<urn:page:1:part-0:1> http://h/1"}))
        out = target.getvalue()
        assert [i for i, *_ in index] == [f"<urn:page:{k}:part-0:{k}>" for k in range(6)]
        for k, (_, offset, length) in enumerate(index):
            ((headers, block),) = warc.records(iter([gzip.decompress(out[offset : offset + length])]))
            assert headers["WARC-Type"] == ("revisit" if k == 3 else "response")
            assert (headers.get("WARC-Refers-To"), headers.get("WARC-Refers-To-Target-URI")) == (("<urn:page:1:part-0:1>", "http://h/1") if k == 3 else (None, None))
            assert block.endswith(b"\r\n\r\n" if k == 3 else b"x" * k * 7)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(iter([data[5][:-20]])))


def test_archives_have_members_and_indexes(pages, tmp_path):
    assert warc.archive_round_trip(pages, folder=str(tmp_path)).count() == pages.count()
    files = sorted(p.name for p in (tmp_path / "normalised").iterdir())
    assert files and all(f.endswith((".warc.gz", ".warc.gz.idx")) for f in files)
    assert not (tmp_path / "monolithic").exists()
    for idx in (tmp_path / "normalised").glob("*.idx"):
        data = (tmp_path / "normalised" / idx.name.removesuffix(".idx")).read_bytes()
        for line in idx.read_text().splitlines():
            record, offset, length = line.split("\t")
            assert f"WARC-Record-ID: {record}".encode() in gzip.decompress(data[int(offset) : int(offset) + int(length)])


# -- main text


def page(main, nav="a b", ad="buy", extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">{nav}</a></li></ul></nav><!-- x --><div class="ad">{ad}</div>{main}{extra}<footer>&copy; f</footer></body></html>'


def test_extraction_of_an_article():
    source = page("<article><h1>H &amp; h</h1><p><b>One<br><p>Two <em>x</em>y\n\n z</p><ul><li>a<li>b</ul><form><p>mail</p></form><aside>s</aside></article>", extra='<div id="comments"><article><p>c</p></article></div><div class="cookie-notice">ok</div>')
    assert webtext.extract(source).split("\n\n") == ["H & h", "One", "Two xy z", "a", "b"]
    assert webtext.extract(None) == "" and webtext.extract("") == "" and webtext.extract("plain  text") == "plain text"
    assert webtext.extract("<p>a" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "a\n\ndeep"


def test_wrappers_that_sound_like_boilerplate_stay():
    story = "<p>" + "long story " * 40 + "</p>"
    text = ("long story " * 40).strip()
    assert webtext.extract(f'<body><form id="page"><nav>a</nav><div class="with-sidebar">{story}<div class="sidebar">s</div></div></form></body>') == text
    assert webtext.extract(f'<body><div class="page-header-wrapper"><article><div class="post-header"><h1>T</h1></div>{story}</article></div></body>') == "T\n\n" + text
    assert webtext.extract('<body><div id="comments"><article><p>only comments</p></article></div><p>x</p></body>') == "x"


def learnt(pages, options=webtext.Options()):
    """The wrapper of one host, counted in plain Python: the first two pages are the references."""
    wrapper = webtext.Wrapper([webtext.parse(p).shape() for p in pages[:2]])
    counts = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    for p in pages:
        for k, at, t, c in webtext.observed(webtext.parse(p), wrapper, options):
            counts[k, at][t][0] += 1
            counts[k, at][t][1] += c
    rows = []
    for (k, at), texts in counts.items():
        t, (n, c) = max(texts.items(), key=lambda x: (x[1][0], x[0]))
        held = t != 0 and n >= options.least_pages and n >= options.held_share * sum(x for x, _ in texts.values())
        every = sum(c for _, c in texts.values())
        rows.append((k, at, t if held else 0, every - (c if held else 0), every))
    wrapper.learn(rows, options)
    return wrapper


def hosts_of(pages_by_host):
    return [(1000 * h + k, f"http://h{h}.example/{k}", p) for h, pages in enumerate(pages_by_host) for k, p in enumerate(pages)]


def test_template_leaves_pages_with_and_without_article(spark):
    """The alignment decides, without a word of a class name, inside a marked article too."""
    make = lambda k, tag: f'<body><div class="q1"><p>Welcome to our site</p></div><{tag}><h1>Head {k}</h1><p>Story {k} begins</p><div class="q2">We thank all our friends</div><p>and goes on {k * 7} for long</p></{tag}><div class="q3">see {k}</div></body>'
    story = lambda k: f"Head {k}\n\nStory {k} begins\n\nand goes on {k * 7} for long"
    for tag in ("article", "section"):
        pages = [make(k, tag) for k in range(9)]
        assert [webtext.extract(p, learnt(pages)) for p in pages] == [story(k) for k in range(9)]
        assert "friends" in webtext.extract(pages[3])
    got = {r["page_id"]: r["text"] for r in rows_of(webtext.main_text(spark.createDataFrame(hosts_of([[make(k, t) for k in range(9)] for t in ("article", "section")]), "page_id long, url string, html string")))}
    assert got == {1000 * h + k: story(k) for h in range(2) for k in range(9)}


def test_outlines_travel_as_text():
    shape = webtext.parse(page('<article><p>x</p><ul class="a (b)\n c"><li>1</li></ul></article>')).shape()
    assert [(x.label, x.text) for x in shape.all()] == [(x.label, x.text) for x in webtext._from_text(webtext._to_text(shape)).all()]
    deep = webtext.parse("<div>" * 3000 + "x").shape()
    assert webtext._to_text(webtext._from_text(webtext._to_text(deep))) == webtext._to_text(deep)


def test_deep_trees_are_aligned():
    make = lambda k: "<body>" + "<div>" * 1500 + f"<p>story {k} goes on</p><pre>same on all</pre>" + "</div>" * 1500 + "</body>"
    pages = [make(k) for k in range(4)]
    assert webtext.extract(pages[2], learnt(pages)) == "story 2 goes on"


def test_alignment_is_a_largest_simple_tree_matching():
    """Scores against the recursion of simple tree matching, written out."""

    def matching(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + matching(x, y))
        return 1 + (a.text == b.text != 0) + best[-1][-1]

    rng = random.Random(17)

    def tree(depth):
        tag = rng.choice(("div", "section", "ul"))
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else rng.choice(("x", "y", "z"))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(150):
        one, two = webtext.parse(tree(3)), webtext.parse(tree(3))
        score, found = webtext.align(one, two.shape(), one.shape(), 1_000_000)
        assert score == matching(one.shape(), two.shape())
        assert score == sum(1 + (bool(n.text) and n.shape().text == b.text) for n, b in found)


def test_long_child_lists_are_aligned_whole():
    def make(k, n):
        return "<body>" + f"<h2>head {k}</h2>" * (k % 2) + "".join(f"<p>story {k} part {i}</p>" + "<pre>rule of the house</pre>" * (i % 400 == 7) for i in range(n)) + "<div>all rights kept</div><h3>foot text</h3></body>"

    pages = [make(k, n) for k, n in ((1, 1003), (2, 1100), (3, 1050), (5, 1020))]
    got = webtext.extract(pages[2], learnt(pages))
    assert got.split("\n\n") == ["head 3", *(f"story 3 part {i}" for i in range(1050))]


def test_halved_alignments_match_as_much_as_whole_ones():
    rng = random.Random(3)
    for _ in range(60):
        one, two = ("<body>" + "".join(f"<{t}>{rng.randrange(4)}<div>{rng.randrange(3)}</div></{t}>" for t in rng.choices(("p", "div", "h2", "pre"), k=rng.randrange(1, 14))) + "</body>" for _ in range(2))
        found = []
        for cells in (1_000_000, 3):
            root = webtext.parse(one)
            found.append(webtext.align(root, webtext.parse(two).shape(), root.shape(), cells)[0])
        assert found[0] == found[1]


def test_template_is_counted_over_all_pages_of_a_host(spark):
    """Two layouts, each with its own notice, and two pages that have a paragraph in common."""
    rows = []
    for k in range(24):
        layout = "one" if k % 2 else "two"
        shared = "<p>of both pages alone</p>" if k in (4, 6) else ""
        rows.append((k, f"http://h.example/{k}", f'<body><div class="{layout}"><p>Notice of layout {layout}</p><div class="text"><p>Story {k} begins</p>{shared}<p>and goes on {k * 7}</p></div></div></body>'))
    rows += [(90 + k, f"http://two.example/{k}", f"<body><h1>T {k}</h1><p>body {k}</p></body>") for k in range(2)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in rows_of(webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    story = {k: [f"Story {k} begins", *["of both pages alone"] * (k in (4, 6)), f"and goes on {k * 7}"] for k in range(24)}
    assert got == story | {90 + k: [f"T {k}", f"body {k}"] for k in range(2)}


def test_copies_are_no_evidence_of_a_template(spark):
    """Copies count once, and near copies vary too little for what they share to be a template."""
    rows = hosts_of([[f"<body><article><p>same words of a long story that {'one two three'}</p><p>end {k % 3}</p></article></body>" for k in range(12)]])
    got = rows_of(webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert all(r["text"].startswith("same words") and r["text"].endswith(f"end {r['page_id'] % 3}") for r in got)


def test_main_text_of_all_pages(pages, page_rows):
    got = collections.Counter((r["page_id"], r["url"], r["n_chars"] == len(r["text"]), r["text"][:20]) for r in rows_of(webtext.main_text(pages)))
    start = {1: "one", 2: "one", 3: "", 4: "", 5: "five", 6: ("word " * 9)[:20], 7: "é ü\x00", None: "one", 8: "one", 9: "WARC/1.1"}
    assert got == collections.Counter((i, u, True, start[i].replace("\x00", "\x00")) for i, u, _ in page_rows)
    assert webtext.main_text(pages.where("false")).count() == 0


def test_attributes_of_pages_are_read_once():
    from tidemark.llm import webtext

    webtext._short_attributes.cache_clear()
    long = " a='" + "x" * webtext.MOST_CACHED + "' class=footer"
    for _ in range(3):
        root = webtext.parse(f"<main><div class='a header'>t</div></main><div class='a header'>t</div><div{long}>t</div>")
    assert [n.boiler for n in root.nodes() if n.tag.startswith("div")] == [False, True, True]
    found = webtext._short_attributes.cache_info()
    assert found.currsize == found.misses == 3 and found.hits == 6
