import hashlib
import re

import numpy as np
import pytest
import xxhash

from quantloom.llm import exactdedup, simhash, substrings
from quantloom.llm.components import components
from quantloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, most=3):
    """doc_id -> smallest doc_id reachable, by comparing everything."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    u = np.array(fps, np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= most):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op2_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: fingerprint(r.text) for r in docs}
    want = classes(list(fps), list(fps.values()))
    got = QUERIES["op2_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert len(got) == len(docs)


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_is_near(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 30)}
    for x in list(fps)[:6]:
        for _ in range(40):
            y = x
            for b in rng.integers(0, 63, rng.integers(1, 5)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    want = classes(fps, np.array(fps, np.int64).view(np.uint64))
    nodes = spark.createDataFrame([(x, x) for x in fps], "node long, fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    assert all(got.get(x, x) == want[x] for x in fps)


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward_rows(spark):
    docs = cases.docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[0] == by[1] == by[2] == {("0" * 16, 0)}  # null, empty and blank texts are linked
    assert by[4] == by[5] or len(by[4]) == 1
    assert {c for _, c in by[None]} == {None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id in {c for v in by.values() for _, c in v})
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def test_op3_matches_sql(spark, sf_dir, duck):
    want = duck.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE_SQL['op3_exact_dedup']})").fetchall()
    got = QUERIES["op3_exact_dedup"](spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    return groups


@pytest.mark.parametrize("capacity,bits", [(1_000_000, 64), (2, 64), (3, 2), (1, 0)])
def test_exact_awkward_rows(spark, capacity, bits):
    """With few bits of hash, different texts share an entry and are told apart by their bytes."""
    rows = cases.rows()
    got = exactdedup.groups(cases.docs(spark), capacity, bits).collect()
    want = []
    for text, own in exact(rows).items():
        best = min((r for r in own), key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], best, len(own), r[0] == best or best is None, hashlib.sha256(text.encode()).hexdigest()) for r in own]
    show = lambda x: sorted(map(repr, x))
    assert show((r.doc_id, r.keep_id, r.group_size, bool(r.kept), r.text_sha256) for r in got) == show(want)
    assert exactdedup.groups(cases.empty(spark), capacity, bits).count() == 0
    kept = exactdedup.keep_first(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 not in ids and 1 not in ids and 2 in ids and ids.count(None) == 1  # the null text without an id is a copy of 2's


def test_rows_that_share_an_id_are_judged_apart(spark):
    docs = spark.createDataFrame([(3, "A"), (5, "A"), (3, "B"), (5, "B "), (-(2**63), "C"), (2**63 - 1, "C")], "doc_id long, text string")
    got = exactdedup.keep_first(docs).collect()
    assert sorted(map(tuple, got)) == [(-(2**63), "C"), (3, "A"), (5, "B ")]


def test_lookups_go_through_the_directory(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "1 AS points", "xxhash64(id) AS h")
    index, slots = exactdedup.build_index(rows, 50)
    assert index.select("bucket").distinct().count() > 40
    found = exactdedup.lookup(rows, index, slots)
    assert found.count() == 3000 and found.where("doc_id = keep_id").count() == 3000
    wrong = slots.withColumn("bucket", exactdedup.F.col("bucket") + 1)
    assert exactdedup.lookup(rows, index, wrong).where("keep_id is not null").count() == 0


def test_overflow_pages(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "MOST_DEPTH", 2)
    rows = spark.range(1000).selectExpr("id AS doc_id", "1 AS points", "xxhash64(id) AS h")
    index, slots = exactdedup.build_index(rows, 20)
    held = index.groupBy("bucket", "page").count()
    assert held.count() > 40 and exactdedup.lookup(rows, index, slots).where("doc_id = keep_id").count() == 1000


def test_may_hold_never_leaves_out(spark):
    from quantloom.llm.common import may_hold

    rows = spark.range(20_000).selectExpr("xxhash64(id) AS h", "id")
    got = {r.id for r in may_hold(rows, "h", rows.where("id % 10 = 0")).collect()}
    assert {i for i in range(0, 20_000, 10)} <= got and len(got) < 2100


def test_directory_splits_overfull_buckets(spark):
    index = spark.range(4096).selectExpr("xxhash64(id) AS h")
    assert {r.pages for r in exactdedup.directory(index, 100).collect()} == {1}
    slots = exactdedup.directory(index, 100).collect()
    held = {}
    for r in slots:
        held.setdefault((r.bucket, r.depth), 0)
    counts = {r.slot: r.n for r in index.selectExpr("shiftrightunsigned(h, 48) AS slot").groupBy("slot").count().withColumnRenamed("count", "n").collect()}
    for r in slots:
        held[(r.bucket, r.depth)] += counts[r.slot]
    assert sum(held.values()) == 4096 and max(held.values()) <= 100 and len(held) > 40


def brute_cut(rows, k=13):
    first = {}
    for r in rows:
        if r[0] is not None:
            w = WORD.findall(r[1] or "")
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w, gone = WORD.findall(r[1] or ""), set()
        for j in range(len(w) - k + 1):
            if r[0] is not None and first[tuple(w[j : j + k])] < r[0]:
                gone.update(range(j, j + k))
        out.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("held", [200_000, 3])
def test_op5_matches_brute_force(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_cut([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = QUERIES["op5_substring_dedup"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == {(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want}
    assert len(got) == len(want) and any(m for _, _, m, _ in want)


def test_substrings_awkward_rows(spark):
    rows = cases.rows()
    got = substrings.cut_repeats(cases.docs(spark)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, brute_cut(rows)))
    assert substrings.cut_repeats(cases.empty(spark)).count() == 0


def test_ids_with_several_texts_and_other_lengths(spark):
    base = " ".join(cases.PROSE)
    rows = [(1, base), (2, "x y z " + base + " tail"), (2, base + " other words"), (2, "x y z " + base + " tail"), (3, "own text"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (1, 3, 13):
        assert sorted(map(repr, map(tuple, substrings.cut_repeats(docs, k).collect()))) == sorted(map(repr, brute_cut(rows, k)))
    with pytest.raises(ValueError):
        substrings.cut_repeats(docs, 0)


def test_paths_are_whole(spark):
    """A passage that passes many minimisers is one path, with the place where it stands in the smaller document."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b " + " ".join(words[50:350]) + " c")], "doc_id long, text string")
    got = substrings.paths(substrings.spans(substrings.stretches(docs, 13))).collect()
    assert [(r.doc_id, r.place & 0xFFFFFFFF, r.n, r.src, r.src_place & 0xFFFFFFFF) for r in got] == [(2, 2, 288, 1, 50)]


@pytest.mark.parametrize("k, bits", [(1, 3), (2, 1), (3, 2), (13, 1)])
def test_shared_hashes_are_settled_by_words(spark, k, bits):
    """With so few bits of a word's hash nearly all runs meet others, whose words tell them apart."""
    words = [f"w{i % 90}" if i % 7 else f"v{i}" for i in range(300)]
    texts = [words, words[::-1], words[100:] + words[:100], ["x"] + words[150:], words[:40] * 2, [f"u{i}" for i in range(50)]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts, 1)] + [(2, " ".join(words[20:60])), (9, None), (None, " ".join(words)), (3, rows_text := " ".join(texts[2])), (3, rows_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.cut_repeats(docs, k, bits=bits).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_cut(rows, k)))


def test_nothing_is_settled_without_need(spark, monkeypatch):
    """Whole hashes of so few words are all different: texts are not read again."""
    monkeypatch.setattr(substrings, "settled", None)
    assert substrings.cut_repeats(cases.docs(spark)).count() == len(cases.rows())
