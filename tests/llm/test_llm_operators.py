"""Each operator against brute force or SQL, and on odd input: nulls, empty and long texts, repeated rows, clashing names."""

import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyframe.llm import components, decontaminate, html_text, license_scan, line_dedup, mixture, neighbours, ngram_join, queries, toxicity, url_filter, wavelet
from tallyframe.llm.common import hash_spans, pack, text_buffers, unpack, words_of

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "some words that have no id at all", "b"), (4, "repeated row of text with several words", "b"), (4, "repeated row of text with several words", "b"), (5, LONG, "c"), (6, LONG, "c"), (-7, "ünïcode … 中文", None)]
SCHEMA = "doc_id long, text string, source string, n long, rank string, score string, component_id string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with odd values, and with columns of the operators' own names."""
    return spark.createDataFrame([(*r, 1, "r", "s", "c", "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- shared helpers


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab  cd\n", None, "", "x" * 2000 + " y", "é \x0b É", "Ab cd"]
    raw, offsets = text_buffers(pa.array(texts))
    low, starts, lengths, doc = words_of(raw, offsets)
    got = [(int(d), low[s : s + n].tobytes()) for d, s, n in zip(doc, starts, lengths, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    h = hash_spans(low, starts, lengths)
    assert len(set(h.tolist())) == len({w for _, w in got})
    assert [a.tolist() for a in unpack(pack(np.arange(5, dtype=np.uint64), np.array([], np.uint32)))] == [[0, 1, 2, 3, 4], []]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1, 1), (None, 2), (1000, 1001), (1001, 1002)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# ---- 1


def test_decontamination(spark, docs, sf_dir):
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t or "").lower().split())
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    held = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, q in items if q in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == held
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in held}


def test_decontamination_of_new_values(spark, none):
    ask = "In March Alice bought 12 apples and 7 pears for 19 dollars, so how many did Alice eat in 12 days?"
    other = "In March Bob bought 15 apples and 9 pears for 20 dollars, so how many did Bob eat in 15 days?"
    mixed = "In March Bob bought 15 apples and 9 pears for 20 dollars, so how many did Carl eat in 16 days?"
    bench = spark.createDataFrame([(1, ask), (2, None), (3, "too short"), (None, ask)], "item_id long, text string")
    rows = [(1, f"before. {other} after"), (2, mixed), (3, None), (None, ask), (4, ask), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1, "reparameterised"), (4, 1, "exact")}
    assert decontaminate.contaminated(none, bench).isEmpty()
    assert decontaminate.contaminated(docs, bench.limit(0)).isEmpty()


def test_decontamination_of_repeated_templates(spark):
    """A template that stands twice in the item, or twice in the document with other values."""
    twice = "Alice bought 12 apples and 7 pears for 19 dollars. Later Bob bought 3 apples and 9 pears for 4 dollars."
    ask = "In March Alice bought 12 apples and 7 pears for 19 dollars, so how many did Alice eat in 12 days?"
    one = "In March Bob bought 15 apples and 9 pears for 20 dollars, so how many did Bob eat in 15 days?"
    stray = "In March Carl bought 1 apples and 2 pears for 3 dollars, so what? "
    bench = spark.createDataFrame([(1, twice), (2, ask)], "item_id long, text string")
    docs = spark.createDataFrame([(1, twice), (2, f"{one} {ask}"), (3, stray + one)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1, "exact"), (2, 2, "exact"), (3, 2, "reparameterised")}


def test_decontamination_of_numbers_equal_by_chance(spark):
    ask = "In March Alice bought {} apples and {} pears at the old market in town before Carl came"
    bench = spark.createDataFrame([(1, ask.format(12, 7)), (2, ask.replace("market", "harbour").format(3, 3))], "item_id long, text string")
    rows = [(1, ask.format(9, 9)), (2, ask.replace("market", "harbour").format(4, 5)), (3, ask.replace("Carl", "Alice").format(9, 9))]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("item_id = doc_id or doc_id = 3").collect()}
    assert got == {(1, 1, "reparameterised"), (2, 2, "reparameterised")}


def test_decontamination_of_any_case_and_short_items(spark):
    ask = "Yesterday in March Alice bought 12 apples and 7 pears for 19 dollars, so how many did Alice eat?"
    dense = "12 kg 7 m 9 l 4 days 3 km"
    bench = spark.createDataFrame([(1, ask), (2, "What is 7 times 8 plus nine?"), (3, dense), (4, "")], "item_id long, text string")
    rows = [(1, ask.lower()), (2, ask.upper()), (3, f"so {ask.title()}"), (4, "then what is 70 times 8,000 plus nine so"), (5, f"list {dense} end"), (6, "list 1 kg 2 m 3 l 6 days 5 km end"), (7, "what is 7 times eight plus nine")]
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, "exact"), (2, 1, "exact"), (3, 1, "exact"), (4, 2, "reparameterised"), (5, 3, "exact")}


def test_decontamination_of_new_values_by_brute_force(spark):
    """Random questions, copies with other names and numbers, and near misses, against a search for the filled template."""
    rng, names = random.Random(6), ["Ann", "Bob", "Carl", "Dora", "Emil", "Fay"]
    frames = ["when {a} gave {b} some {n} coins at the fair and {a} kept {m} of them how many had {b} then", "the train of {a} left at {n} and {b} saw it pass after {m} minutes so how far did {a} go by evening"]
    fill = lambda f, a, b, a2, b2: "Well, " + f.replace("{a}", a, 1).replace("{b}", b, 1).replace("{a}", a2).replace("{b}", b2).replace("{n}", str(rng.randrange(100))).replace("{m}", str(rng.randrange(100)))
    bench, rows, want = [], [], set()
    for i, f in enumerate(frames):
        a, b = rng.sample(names, 2)
        bench.append((i, fill(f, a, b, a, b)))
    for d in range(80):
        i = rng.randrange(2)
        a, b, a2, b2 = (rng.choice(names) for _ in range(4))
        kind = rng.randrange(3)
        if kind == 0:
            (a, b), (a2, b2) = rng.sample(names, 2), (None, None)
            a2, b2 = a, b
        text = fill(frames[i], a, b, a2, b2) if kind < 2 else f"nothing of {a} here, {rng.randrange(9)} words only"
        rows.append((d, f"It was late. {text}. Then all went home."))
        if kind < 2 and a == a2 and (b == b2 or i == 1) and a != b:
            want.add((d, i))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_names_what_it_found(spark):
    ask = "In March Alice bought 12 apples and 7 pears for 19 dollars at the small market, so how many did Alice still have left to eat in 12 days?"
    texts = [ask, ask.lower(), ask.replace("small", "small old"), ask.replace("12", "15"), ask.replace("12 apples", "five apples"), ask.replace("12 apples", "five apples").replace("19", "20")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.coverage == 1) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, ask)], "item_id long, text string")).collect()}
    assert got == {0: ("exact", True), 1: ("exact", True), 2: ("partial", False), 3: ("reparameterised", True), 4: ("partial", False), 5: ("reparameterised", False)}


def test_decontamination_of_many_copies_in_one_text(spark):
    """Rows are linear in the copies: a place is a row, whatever the length of its text."""
    ask = "In March Alice bought 12 apples and 7 pears for 19 dollars, so how many did Alice eat in 12 days?"
    docs = spark.createDataFrame([(1, " ".join(f"{ask} Number {i}." for i in range(3000))), (2, "nothing")], "doc_id long, text string")
    began = time.time()
    assert [(r.doc_id, r.kind) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, ask)], "item_id long, text string")).collect()] == [(1, "exact")]
    assert time.time() - began < 30


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "repeated row of text with several words"), (1, "repeated row of text with several words"), (2, "some words that have no id at all")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(odd, bench).collect()} == {(4, 1, "exact")}
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2


# ---- 2


def test_line_dedup(docs, same, odd, none):
    same(line_dedup.dedup_lines(docs), line_dedup.ORACLE_SQL)
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.text) for r in got if r.doc_id != 6} == {(i, t) for i, t, _ in ODD if i != 6}
    assert next(r for r in got if r.doc_id == 6).n_removed == 1
    assert line_dedup.dedup_lines(none).isEmpty()


def test_line_dedup_extends_both_ways(spark):
    line = lambda c: " ".join([c] * 20)
    a, b, c, x = line("a"), line("b"), line("c"), line("x")
    rows = [(1, "\n".join([x, a, "", b, c, "end"])), (2, "\n".join(["start", a, b, c, "end"])), (3, "\n".join([a, "gap", b]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("start", 4), 3: (rows[2][1], 0)}


def brute_repeats(rows, least=50):
    """{(doc, line)} of lines in a run of so many words that stands at an earlier place, by comparing all windows."""
    lines = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in rows}
    seen, gone = {}, set()
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b][1].split())
                if words >= least:
                    content = tuple(x for _, x in own[a : b + 1])
                    if seen.setdefault(content, (i, a)) != (i, a):
                        gone |= {(i, k) for k, _ in own[a : b + 1]}
                    elif words >= 3 * least:
                        break
    return gone


def test_line_dedup_of_random_runs(spark):
    """Few different lines of uneven length, so that common lines are fingerprints and runs overlap, end and begin everywhere."""
    rng = random.Random(8)
    kinds = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (1, 2, 3, 8, 20, 30, 49, 60)] + [""]
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute_repeats(rows)
    for i, text in rows:
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert got[i].n_removed == sum(d == i for d, _ in gone) and got[i].n_lines == text.count("\n") + 1


def test_line_dedup_selects_fewer_places_than_windows(docs):
    wins = line_dedup.windows(line_dedup._lines(docs.select("doc_id", "text")))
    places, all_windows = line_dedup.fingerprints(wins).where("not backward").count(), wins.where("not backward").count()
    assert places < 0.8 * all_windows


def test_line_dedup_of_a_long_repeat(spark):
    import time

    line = "one and the same line of text that comes again and again"
    rows = [(1, "\n".join([line] * 50_000)), (2, "\n".join(f"line {i} of a long text that stands in two documents" for i in range(50_000)))]
    rows.append((3, rows[1][1]))
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (50_000, 49_999, line), 2: (50_000, 0, rows[1][1]), 3: (50_000, 50_000, "")} and time.time() - began < 60


# ---- 3


def test_url_filter(spark, sf_dir, same, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    same(url_filter.judge(pages, url_filter.RULES).select(cols), url_filter.ORACLE_SQL)
    monkeypatch.setattr(url_filter, "TRIE_RULES", 0)
    same(url_filter.judge(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")).select(cols), url_filter.ORACLE_SQL)


def test_url_filter_precedence(spark, monkeypatch):
    rules = [("block", "b.com", "/"), ("allow", "b.com", "/ok"), ("allow", "a.b.com", "/"), ("block", "a.b.com", "/x/y"), ("allow", "same.org", "/"), ("block", "same.org", "/")]
    urls = {
        "http://b.com/": "block", "http://b.com": "allow", "HTTP://B.com/okay?q": "allow", "http://z.a.b.com/x/": "allow", "http://a.b.com/x/yz": "block", "http://xb.com/": "allow", None: "allow", "b.com/": "allow", "://": "allow", "http://same.org/#f": "block",
    }
    table = spark.createDataFrame([(u, "old") for u in urls], "url string, verdict string")
    for _ in range(2):
        got = {r.url: r.verdict for r in url_filter.judge(table, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
        assert got == urls
        monkeypatch.setattr(url_filter, "TRIE_RULES", 0)
    assert url_filter.judge(table.limit(0), rules).isEmpty()


def test_url_filter_of_many_tails_and_clashing_names(spark):
    import time

    rules = [("block", "h.com", f"/a/item{i}") for i in range(100_000)] + [("allow", "h.com", "/a/item77777x")]
    trie = url_filter.build_trie(rules)
    began = time.time()
    assert all(url_filter.find(trie, "www.h.com", f"/a/item{i}?") == (f"h.com/a/item{i}", "block") for i in range(0, 100_000, 50))
    assert url_filter.find(trie, "h.com", "/a/item77777xyz") == ("h.com/a/item77777x", "allow") and time.time() - began < 5
    table = spark.createDataFrame([("http://h.com/a/item5", 1, "x")], "url string, _found int, host string")
    got = url_filter.judge(table, rules[:10]).collect()
    assert [(r._found, r.host, r.rule) for r in got] == [(1, "h.com", "h.com/a/item5")]


# ---- 4


def brute_components(rows, size=5):
    sets, parent = {}, {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in index[g])
        for g in sets[i]:
            index[g].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_components_of_families(spark):
    """Many near copies around the threshold, so that centres don't settle everything."""
    rng, rows = random.Random(5), []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(50)}" for _ in range(60)]
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(60)] = f"edit{rng.randrange(10)}"
            rows.append((len(rows), " ".join(own[: rng.choice([60, 60, 52, 47])])))
    rows += [(900, "one two three"), (901, "One  two THREE"), (902, "one two"), (903, ""), (904, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_components_of_few_words_a_task(spark):
    """A task whose texts have fewer words together than an n-gram."""
    rows = [(i, t) for i, t in enumerate(["a b", "c", "A  b", "d e f", ""])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")).collect()}
    assert got == brute_components(rows)
    for n in range(7):
        raw = np.frombuffer(b"w " * n, np.uint8)
        assert ngram_join.shingle_sets(raw, np.array([0, len(raw)]), 5)[1].tolist() == [min(n, 1)]


def test_sets_of_hashes_take_seven_bytes_each():
    raw = np.frombuffer(b"some words that stand here and there", np.uint8)
    grams, counts = ngram_join.shingle_sets(raw, np.array([0, len(raw)]), 5)
    assert counts.tolist() == [3] and len(ngram_join.narrow(grams)) == 21
    for own in (grams, grams[:0], np.array([0, 1, 2**56 - 1], np.uint64)):
        assert ngram_join.widen(ngram_join.narrow(own)).tolist() == own.tolist()


def test_jaccard_components_of_odd_rows(odd, none):
    got = sorted(map(tuple, ngram_join.jaccard_components(odd).collect()), key=str)
    want = [(-7, 1, -7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (4, 3, 4), (5, 997, 5), (6, 997, 5), (None, 4, None)]
    assert got == sorted(want, key=str)
    assert ngram_join.jaccard_components(none).isEmpty()


# ---- 5


def exact_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect() if r.embedding]
    want, got = exact_nearest(rows, 20), defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in got for i, s in got[q] if i in scores[q])


def test_nearest_of_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)] + [(i, [2.0, 2.0]) for i in range(100, 160)] + [(40, None), (41, []), (42, [0.0, 0.0]), (43, [nan, 1.0]), (44, [inf, 1.0]), (45, [1.0, None]), (46, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    got = defaultdict(list)
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double")
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: v for i, v in rows if i is not None and (i < 40 or i >= 100)}
    assert dict(got) == exact_nearest(sorted(good.items()), 20)
    # lists of few entries, and small blocks and slices
    for name, value in (("BLOCK", 7), ("SLICE", 2), ("SHARE", 0.0)):
        monkeypatch.setattr(neighbours, name, value)
    lone = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(120)]
    found = neighbours.nearest(spark.createDataFrame(lone, "vec_id long, embedding array<double>")).collect()
    assert Counter(r.query_id for r in found) == {q: 20 for q in range(0, 120, 20)}
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in few} == {(0, 1, 20, 2.0), (20, 1, 0, 2.0)}
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


def test_nearest_of_other_queries_and_poor_codes(spark, monkeypatch):
    """Few queries that don't look like the rows, and codes whose errors hide the best from a short rerank."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(200, 16)))
    clusters, plain = unit(centres[rng.integers(200, size=6000)] + 0.01 * rng.normal(size=(6000, 16))), rng.normal(size=(3000, 16))

    def recall(rows, asked):
        table = [(20 * i, v.tolist()) for i, v in enumerate(asked)] + [(i + i // 19 + 1, v.tolist()) for i, v in enumerate(rows)]
        want = exact_nearest(table, 20)
        got = neighbours.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
        return sum(r.vec_id in dict(want[r.query_id]) for r in got) / sum(map(len, want.values()))

    assert recall(clusters, rng.normal(size=(8, 16))) >= 0.9
    for name, value in (("MOST_LISTS", 1), ("RERANK", 22), ("CODES", 8)):
        monkeypatch.setattr(neighbours, name, value)
    assert recall(plain, rng.normal(size=(8, 16))) >= 0.9


# ---- 6


def test_wavelet_matrix():
    rng = random.Random(1)
    for ids in ([], [0], [7] * 100, [rng.randrange(300) for _ in range(70_000)], [70_000, 3, 70_000]):
        m = wavelet.WaveletMatrix(wavelet.encode_matrix(np.array(ids, np.int64)))
        assert m.decode().tolist() == ids and [m.access(i) for i in range(0, len(ids), 1111)] == ids[::1111]
        for v in {*ids[:5], 1, 299, 999_999}:
            assert m.count(v) == ids.count(v) and m.rank(v, len(ids) // 2) == ids[: len(ids) // 2].count(v)
            assert m.occurrences(v).tolist() == [i for i, x in enumerate(ids) if x == v]
            assert [m.select(v, k) for k in range(min(9, m.count(v)))] == [i for i, x in enumerate(ids) if x == v][:9]
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"other bytes")


def test_a_lookup_inflates_a_block_or_two_of_each_plane(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 50_000, 1_000_000)
    m = wavelet.WaveletMatrix.build(ids)
    inflated, block = [], wavelet.WaveletMatrix.block
    monkeypatch.setattr(wavelet.WaveletMatrix, "block", lambda self, *at: inflated.append(at) or block(self, *at))
    assert m.access(777_777) == ids[777_777] and len(inflated) == len(m.zeros)
    inflated.clear()
    assert m.count(5) == (ids == 5).sum() and len(inflated) <= 2 * len(m.zeros)


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, ours, rng = Tokenizer.from_file(path), wavelet.Encoder(path), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", ".", "'s", "\t", "\xa0", "\x1c", "<|endoftext|>", "中", "Ab", " \n ", "!", "\x85", ".", "***", "-", "_", "x,", "²", "\u0301", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    import pyarrow as pa

    for _ in range(2):  # the second time from memory
        flat, sizes = ours.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_encoder_memory_is_bounded_and_other_tokenizers_are_refused(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(wavelet, "REMEMBERED", 20_000)
    path = queries.tokenizer_path()
    ours, plain = wavelet.Encoder(path), Tokenizer.from_file(path)
    for k in range(3):
        text = " ".join(f"word{i}x{k}." for i in range(3000)) + "y" * 100_000
        assert ours.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
        known = ours.known
        assert sum(x.nbytes for x in (known.h1, known.h2, known.start, known.size, known.ids)) <= 20_000
    with pytest.raises(ValueError):
        wavelet.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_tokens_are_looked_up_in_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path, plain = str(tmp_path / "shards"), Tokenizer.from_file(queries.tokenizer_path())
    wavelet.write_shards(docs, path, queries.tokenizer_path(), 20_000)
    ids = [i for r in docs.orderBy("doc_id").collect() for i in [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]]
    often = Counter(ids).most_common(1)[0][0]
    asked = [0, ids[5], often, often, 49_999]
    assert {r.token: r.n for r in wavelet.count_tokens(spark, path, asked).collect()} == {t: ids.count(t) for t in asked}
    found = sorted((r.token, r.position) for r in wavelet.find_tokens(spark, path, asked).collect())
    assert found == sorted((t, i) for t in set(asked) for i, x in enumerate(ids) if x == t)
    positions = [*range(0, len(ids), 997), 0, None, -1, len(ids)]
    got = sorted((r.position, r.token) for r in wavelet.tokens_at(spark, path, spark.createDataFrame([(p,) for p in positions], "position long")).collect())
    assert got == sorted((p, ids[p]) for p in positions if p is not None and 0 <= p < len(ids))


def round_trip(spark, table, tmp_path, shard):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    wavelet.write_shards(table, str(tmp_path), queries.tokenizer_path(), shard)
    rows = sorted(((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, wavelet.read_documents(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want


def test_tokens(spark, docs, tmp_path):
    round_trip(spark, docs, tmp_path / "a", 20_000)


def test_tokens_of_odd_rows(spark, odd, none, tmp_path):
    round_trip(spark, odd, tmp_path / "b", 1000)
    assert wavelet.tokens(none, queries.tokenizer_path()).isEmpty()


def test_words_and_lines_need_no_loop(monkeypatch):
    """Words without white space, and lines of them, go to the library by arrays; only other white space is looked at word by word."""
    import pyarrow as pa

    encoder = wavelet.Encoder(queries.tokenizer_path())
    looked = []
    monkeypatch.setattr(wavelet.Encoder, "_parts", lambda self, word, spaced, plain=wavelet.Encoder._parts: looked.append(word) or plain(self, word, spaced))
    rng = random.Random(4)
    ends, heads = ["", ".", ",", "...", "'s", "1", "\u00fc", "\x00"], ["ab", "Xyz", "\u4e2d\u6587", "7", "-", "it's", "\u00e9t\u00e9"]
    word = lambda: rng.choice(heads) + rng.choice(heads) + rng.choice(ends)
    texts = [" ".join("\n".join(word() for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    odd = ["tab\there now", "two\n\nfeeds and", "no\u00a0break it", ""]
    for size in (wavelet.REMEMBERED, 1000):  # what is remembered, and little of it
        monkeypatch.setattr(wavelet, "REMEMBERED", size)
        for _ in range(2):
            ids, sizes = encoder.encode(pa.array(texts + odd))
            want = [e.ids for e in encoder.tokenizer.encode_batch(texts + odd, add_special_tokens=False)]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for e in want for i in e]
        encoder.known = wavelet.Memory()
    assert looked and all(not w or any(c.isspace() and c != "\n" for c in w) or "\n\n" in w for w in looked)


def test_a_stem_goes_to_the_library_once(monkeypatch):
    """Words that differ in their punctuation or lines only share their pieces, in a slice and later."""
    import pyarrow as pa

    encoder, sent, called = wavelet.Encoder(queries.tokenizer_path()), [], wavelet.Encoder._called
    monkeypatch.setattr(wavelet.Encoder, "_called", lambda self, texts, *more: sent.extend(texts) or called(self, texts, *more))
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdeghilmnorstu\u00e9\u00df") for _ in range(9)) for _ in range(3000)]
    for ends in (["", ".", ",", "!", "...", ")"], ["?", ";", ":", "%%%", ".\nAnd", "-"]):
        texts = [" ".join(["so", *(s + end for s in stems)]) for end in ends]
        ids, sizes = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for e in want for i in e]
    assert sum(map(len, sent)) < 2 * sum(map(len, stems))


def test_pieces_of_every_kind_with_and_without_the_model_alone(monkeypatch):
    import pyarrow as pa

    encoder, rng = wavelet.Encoder(queries.tokenizer_path()), random.Random(8)
    assert encoder.bare is not None
    parts = ["ab", "Z", "\u00fc", "\u00d7", "\u00f7", "\u0149", "\u017f", "\u01c6", "\u00aa", "\u00b2", "\u0301", "\u4e2d", "'", "'s", "'ll", "7", ".", ",", "...", "_", "\x00", "<|endoftext|>", "<|endoftext", "|>", " ", " ", " ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "\u2028"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(5000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for bare, size in ((encoder.bare, wavelet.REMEMBERED), (None, wavelet.REMEMBERED), (encoder.bare, 3000)):
        monkeypatch.setattr(wavelet, "REMEMBERED", size)
        encoder.bare, encoder.known = bare, wavelet.Memory()
        for _ in range(2):
            ids, sizes = encoder.encode(pa.array(texts))
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for e in want for i in e]


# ---- 7


def test_license_base(spark, docs):
    extra = [(-1, "Foo under the MIT License; under-the mit LICENSE cc-by-nc cc by nc. Apache License, Version 2.0"), (-2, None), (-3, ""), (-4, "éunder the mit license"), (-5, "cc by nc cc by nc")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    for i, text in table.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words, starts, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
        for phrase, label in license_scan.BASE:
            own = phrase.split()
            found = [j for j in range(len(words) - len(own) + 1) if words[j : j + len(own)] == own]
            starts += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_rules(spark, odd, none):
    texts = ["SPDX-License-Identifier: MIT", "licensed under the GNU Affero General Public License", "CC-BY-NC-SA 4.0", "This is the BSD 3-Clause License.", "nothing here", "a zlib license and a zlib license"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(table).collect()}
    assert got == {0: "mit", 1: "agpl-3", 2: "cc-by-nc,cc-by-nc-sa", 3: "bsd-3", 4: "", 5: "zlib"}
    found = {(r.label, r["first"], r["last"]) for r in license_scan.detections(table).where("doc_id = 5").collect()}
    assert found == {("zlib", 1, 2), ("zlib", 5, 6)}
    assert len(license_scan.rules()) > 200
    assert len(license_scan.scan(odd).collect()) == len(ODD) and license_scan.scan(none).isEmpty()


def test_every_license_rule_fires_alone(spark):
    """On a text of nothing but its own example, without the optional parts and with the first of its choices."""
    rows = []
    for label, *_, pattern in license_scan.rules():
        text = re.sub(r"(?<=https)\?", "", re.sub(r"\.\{[^}]*\}\?", "x ", pattern))
        text = re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", re.sub(r"\(\?:(?:[^()]|\([^)]*\)\?)*\)\?", "", pattern)))
        rows.append((len(rows), " ".join(text.split()), label))
    rows += [(len(rows) + i, t, n) for i, (t, n) in enumerate([("Released under the GPLv3 license", "gpl-3"), ("licensed under GPL v2", "gpl-2"), ("MPLv2 license", "mpl-2"), ("AGPLv3 licensed", "agpl-3"), ("Released under GPLv3.", "gpl-3"), ("gnu gpl v3 license", "gpl-3")])]
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert [(t, n, got[i]) for i, t, n in rows if n not in got[i][0] or not got[i][1]] == []


def test_license_rules_by_brute_force(spark):
    """All rules, their keywords aside, and suppression, over random sentences of pieces of the rules' own examples."""
    rng, rules = random.Random(9), license_scan.rules()
    bits = [" ".join(re.sub(r"\(\?:([^|)]*)[^)]*\)\??|\[(.)[^]]*\]|\.\{[^}]*\}\??", r"\1\2", r[5]).replace("?", "").split()) for r in rules]
    rows = [(i, " ".join(rng.choice([*rng.choices(bits, k=3), "and", "the Software", "CC0 1.0"]) for _ in range(rng.randrange(1, 7)))) for i in range(150)]
    want = {}
    for i, text in rows:
        words = re.findall(r"[a-z0-9]+", text.lower())
        spaced, found = "".join(f" {w} " for w in words), set()
        for label, priority, _, _, _, pattern in rules:
            for m in re.finditer(pattern, spaced):
                first = spaced[: m.start()].count(" ") // 2
                found.add((label, priority, first, first + m[0].count(" ") // 2 - 1))
        # an interval is out if another one of no lower priority holds it: a longer one, or, equal, a higher or a sooner one
        out = {x for x in found for y in found if y != x and y[1] >= x[1] and y[2] <= x[2] and y[3] >= x[3] and (y[2:] != x[2:] or (-y[1], y[0]) < (-x[1], x[0]))}
        want[i] = sorted((l, p, a, b) for l, p, a, b in found - out)
    got = defaultdict(list)
    for r in license_scan.detections(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.label, r.priority, r["first"], r["last"]))
    assert {i: sorted(got[i]) for i in want} == want


def test_license_words_and_literals(spark):
    """Words are counted without an object for each, and each rule's literal stands in whatever its regex finds."""
    texts = ["", " ", "one", "One,TWO  three!", "\u00e9t\u00e9 \u4e2d\u6587-x", "a\tb\nC", "under the MIT license, twice: under the MIT license", "1 2 3", "...", "end\u00a0here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = license_scan.scan(table)
    assert {r.doc_id: r.n_words for r in scanned.collect()} == {i: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)) for i, t in enumerate(texts)}
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan and "RegExpCount" not in plan
    for *_, key, pattern in license_scan.rules():
        found = license_scan.literal(pattern, key)
        # of each group and optional letter the longest form and none
        for shape in (re.sub(r"https\?", "http", pattern), re.sub(r"https\?", "https", pattern)):
            while re.search(r"\(\?:[^()]*\)", shape):
                shape = re.sub(r"\(\?:([^()|]*)[^()]*\)(\??)", lambda m: "" if m[2] and "https" not in shape else m[1], shape)
            text = re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\.\{\d+,\d+\}\?", "x", shape))
            assert len(found.strip()) > 1 and found in text and re.search(pattern, text)


def test_every_license_rule_passes_the_gate():
    for _, _, _, word, key, pattern in license_scan.rules():
        fixed = re.sub(r"\(\?:(?:[^()]|\([^)]*\)\??)*\)\?", " ", pattern)
        assert any(g in fixed for g in license_scan.GATE), pattern
        assert f" {key} " in re.sub(r"\(\?:[^)]*\)", " ", fixed) + " ", (key, pattern)


def test_license_rows_of_one_id_and_many_hits(spark):
    import time

    many = "a zlib license and " * 8000
    table = spark.createDataFrame([(1, "Released under the GPLv3 license"), (1, "zlib license"), (2, many)], "doc_id long, text string")
    license_scan.scan(table).collect()
    began = time.time()
    got = sorted((r.doc_id, r.n_words, r.labels) for r in license_scan.scan(table).collect())
    assert got == [(1, 2, "zlib"), (1, 5, "gpl-3"), (2, 32_000, "zlib")] and time.time() - began < 15
    assert license_scan.detections(table.where("doc_id = 2")).count() == 8000


# ---- 8


def test_factorization_machine_learns_pairs():
    """x AND y is toxic, each alone isn't: no additive weights can say that and leave both alone."""
    rows = [(1, [0, 1])] * 40 + [(0, [0])] * 40 + [(0, [1])] * 40 + [(0, [])] * 40
    model = toxicity.train(np.array([r[0] for r in rows]), np.array([len(r[1]) for r in rows]), np.array([x for r in rows for x in r[1]], np.int64), np.array([3, 9]))
    m = toxicity.margins(model, np.array([2, 1, 1, 0]), np.array([0, 1, 0, 1]))
    assert m[0] > 0.85 and (m[1:] < 0).all()


def test_toxicity_on_held_out_rows(spark, docs, sf_dir):
    rng = random.Random(2)
    neutral = [f"n{i}" for i in range(400)]
    rows = [(i, " ".join([*rng.choices(neutral, k=40), *(rng.choices(["vilex", "grubz"], k=2) if i % 6 == 0 else [])])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(table, toxicity.fit(table, labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 800 and all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b], ids=["both", "either"])
def test_toxicity_of_pairs_through_fit(spark, rule):
    """Two words that are common in clean texts decide together only; among many words that say nothing."""
    rng, rows, toxic = random.Random(4), [], {}
    for i in range(6000):
        a, b = rng.random() < 0.6, rng.random() < 0.6
        rows.append((i, " ".join([*(f"n{rng.randrange(400)}" for _ in range(30)), *(["groupx"] if a else []), *(["insulty"] if b else [])])))
        toxic[i] = int(rule(a, b))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    held = [r for r in toxicity.score(table, toxicity.fit(table, labels)).collect() if r.held_out]
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    assert len(caught) > 500 and sum(caught) >= 0.95 * len(caught)
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.01 * len(held)


def test_toxicity_model_ignores_partitions(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7, "source").sortWithinPartitions("text"), labels.repartition(3))
    assert a.bias == b.bias and all(np.array_equal(x, y) for x, y in ((a.slots, b.slots), (a.weights, b.weights), (a.factors, b.factors)))


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(none, labels), toxicity.fit(odd, labels.limit(0))):
        got = toxicity.score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.score(none, model).isEmpty() and toxicity.keep_clean(odd, model).columns == odd.columns


# ---- 9


def test_mixture(docs, same):
    same(mixture.taken_words(docs), mixture.ORACLE_SQL)
    rows = mixture.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert abs(sum(v[0].target for v in by.values()) - sum(r.size for r in rows)) < 1e-6
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    repeated = Counter(r.doc_id for r in mixture.mix(docs).collect())
    assert repeated == {r.doc_id: r.taken // r.size for r in rows if r.taken}


def test_mixture_of_odd_rows(odd, none):
    got = mixture.taken_words(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixture.taken_words(none).isEmpty() and mixture.mix(none).isEmpty()
    assert mixture.mix(odd).columns == odd.columns


# ---- 10


def test_main_text():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site</header><nav>menu</nav><div class="cookie-notice">We use</div><main><article class="post"><h1>Hi &amp; b&eacute;</h1>
<p>a <b>bo</b>ld<br>x&nbsp;y</p><script>var a="</p>";</script><ul><li>one<li>two</ul><div class="share">tw</div><section id="comments"><p>first!</p></section><form>sub</form></article></main><aside>side</aside><footer>f</footer>"""
    assert html_text.main_text(page) == "Hi & bé a bold x y one two"
    assert html_text.main_text('<div class="content"><p>hello<p>world</div><div class="left-sidebar">no</div> tail <!-- c -->end 1 < 2 &lt;b&gt;') == "hello world tail end 1 < 2 <b>"
    assert html_text.main_text("<p>&am<b>p;</b> lt &lt;</p>") == "&amp; lt <"
    assert html_text.main_text("") == "" and html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<div>" * 20_000 + "x") == "x" and html_text.main_text('<a href="' * 500) == ('<a href="' * 500)


def test_templates_go_and_articles_stay(spark):
    page = lambda i, own: f"<body><div class=x><p>Follow us everywhere</p></div>{own}</body>"
    rows = [(i, f"http://h.org/{i}", page(i, f"<p>story {i}</p>")) for i in range(10)] + [(20 + i, f"http://h.org/{i}", page(i, "<article><p>same story</p></article>")) for i in range(10)]
    rows += [(50, None, page(0, "<p>no host</p>")), (51, "http://h.org/z", None), (52, "http://other.org", page(0, "<p>alone</p>"))]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()}
    want = {i: f"story {i}" for i in range(10)} | {20 + i: "same story" for i in range(10)} | {50: "Follow us everywhere no host", 51: "", 52: "Follow us everywhere alone"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_templates_inside_articles(spark, monkeypatch):
    """A block of neutral class in every article of a host goes; syndicated articles, near copies of one, and what few articles share stay."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    block = "<div class=x><p>Read our other stories too, they are as good</p></div>"
    page = lambda *parts: f"<body><article><h1>Summary</h1>{''.join(parts)}</article></body>"
    p = lambda t: f"<p>{t}</p>"
    rows, want = [], {}

    def add(host, html_, text):
        want[len(rows)] = f"Summary {text}"
        rows.append((len(rows), f"http://{host}/{len(rows)}", html_))

    shared = words(30)
    for i in range(30):
        own, few = words(40), i < 9
        add("recurs.org", page(p(own), p(shared) if few else "", block, p(f"<b>Note</b> {i}")), f"{own} {shared + ' ' if few else ''}Note {i}")
    one = words(80)
    for _ in range(30):
        add("syndicated.org", page(p(one), block), f"{one} Read our other stories too, they are as good")
    parts = [words(30) for _ in range(6)]
    for i in range(30):
        own = list(parts)
        own[i % 6] = own[i % 6].replace(" ", f" edit{i} ", 1)
        add("copies.org", page(*map(p, own)), " ".join(own))
    for i in range(4):
        own = words(20)
        add("small.org", page(p(own), block), f"{own} Read our other stories too, they are as good")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want
    # without the counted templates those texts keep the block
    found = html_text.templates
    monkeypatch.setattr(html_text, "templates", lambda pages: found(pages).limit(0))
    bare = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert {i for i in want if bare[i] != want[i]} == set(range(30))


def test_pages_of_the_driver(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        bare = re.sub(r"</?([a-z0-9]+)[^>]*>", lambda m: "" if m[1] == "b" else " ", inner[1]) if inner else ""
        assert got[r.page_id] == " ".join(html.unescape(bare).split())
