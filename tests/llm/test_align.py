"""Cross-tokenizer alignment, best-fit packing and hard negatives against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from quantloom.llm import align, bestfit, negatives
from quantloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import cases


def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of():
    """The printable stand-in of each byte in a byte-level vocabulary, undone."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    return table


def brute_align(rows):
    """Rows of doc_id and text to the contract's columns, pair by pair with plain loops."""
    t, sp = libraries()
    table, out, linked = byte_of(), [], []
    for doc, text in rows:
        a, b, best = [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = [], []
        links, groups = [], []
        if a:
            ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
            i = j = low_a = low_b = 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                x, y = ends_a[i], ends_b[j]
                i, j = i + (x <= y), j + (y <= x)
                if x == y:
                    groups.append(",".join(map(str, a[low_a:i])) + "|" + ",".join(map(str, b[low_b:j])))
                    low_a, low_b = i, j
            assert i == len(a) and j == len(b)
        linked.append(links)
        out.append([doc, len(a), len(b), len(groups), len(links), best, 0, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count, top = {}, {}
    for links in linked:
        for p in set(links):
            count[p] = count.get(p, 0) + 1
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    for row, links in zip(out, linked):
        row[5], row[6] = sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links)
    return sorted(map(tuple, out), key=repr)


def check_align(rows, got):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute_align(rows)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 50])
def test_op11_matches_brute_force(spark, sf_dir, monkeypatch, frequent):
    """Also where nearly every pair is rare, so that counts come by the join."""
    monkeypatch.setattr(align, "FREQUENT", frequent)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_align(docs, QUERIES["op11_align_tokens"](spark, sf_dir).collect())


ODD = ["▁ a mark", "tab\tand\x0b", " ", "  two", "<|endoftext|> plain", "<s>x</s><unk>", "naïve café ﬁ ½", "日本語のテキスト", "🙂🙂 é", "a\u0000b", " x", "line\r\nline", "ends ", " ", "x" * 300]


def test_align_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows()] + [(900 + i, x) for i, x in enumerate(ODD)]
    docs = spark.createDataFrame(cases.rows() + [(i, x, None, None, 0, 0, 0, "", "") for i, x in rows[-len(ODD) :]], cases.SCHEMA).repartition(3)
    check_align(rows, align.link_counts(docs).collect())
    assert align.link_counts(cases.empty(spark)).count() == 0
    own = {r.doc_id: r for r in align.align(docs).collect()}
    assert own[0].groups == "" and own[0].a == [] and own[0].links == []
    t, sp = libraries()
    assert own[3].a == t.encode(" one").ids and own[3].b == sp.encode("one") and [(x.a, x.b) for x in own[3].links] == [(0, 0)]


def test_pairs_are_summed_over_flushes(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    table = align.aligned(docs)
    size = len(align.sides("byte_bpe_50k.json", "piece_bpe_32k.model").bytes_b)
    want = {(r.pair, r.n, r.best) for r in align.pair_counts(table, size).collect()}
    monkeypatch.setattr(align, "HELD_PAIRS", 10)
    assert {(r.pair, r.n, r.best) for r in align.pair_counts(table, size).collect()} == want


def check_packs(rows, got, window=1024):
    t = libraries()[0]
    t.encode_special_tokens = False
    by, used = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(by)
    total = 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // window)))
        assert [r.length for r in own] == [len(ids) % window or window] + [window] * (len(own) - 1)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += r.length
        total += len(ids)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(used) / max(1, total / window)


def test_op12_packs_whole_documents(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packs(docs, QUERIES["op12_best_fit"](spark, sf_dir).collect()) < 1.1


def test_best_fit_awkward_rows(spark):
    rows = {r[0]: r for r in cases.rows() if r[0] is not None}
    docs = spark.createDataFrame(list(rows.values()), cases.SCHEMA).repartition(3)
    check_packs([(i, r[1]) for i, r in rows.items()], bestfit.digest(bestfit.pack(docs, task_rows=5, open_bins=2)).collect())
    assert bestfit.pack(cases.docs(spark)).count() >= len(cases.rows())
    assert bestfit.pack(cases.empty(spark)).count() == 0


def test_open_bins_equal_a_plain_search():
    rng = np.random.default_rng(4)
    for most in (1, 3, 40):
        bins, open_, made = bestfit.OpenBins(64, most), {}, 0
        for length in rng.integers(1, 64, 3000).tolist():
            own, offset = bins.place(length)
            fit = [f for f in open_.values() if f >= length]
            if fit:
                assert open_[own] == min(fit)
            else:
                if len(open_) == most:
                    fullest = min(open_.values())
                    gone = [k for k, f in open_.items() if f == fullest]
                    del open_[gone[-1]]  # of equally full ones the last that came to be so
                assert own == made
                made, open_[own] = made + 1, 64
            assert offset == 64 - open_[own]
            open_[own] -= length
            free = open_.pop(own)
            if free:
                open_[own] = free
            assert sorted(f for f, x in enumerate(bins._free) for _ in x) == sorted(open_.values())


def brute_negatives(rows, config=negatives.NegativeConfig()):
    """rows: vec_id, label, integer vector. Plain loops over all rows for each anchor."""
    out = set()
    for i, label, v in rows:
        if i % 50:
            continue
        met = [(-int(np.dot(v, w)), j, other) for j, other, w in rows if j != i]
        for s, j, _ in sorted(x for x in met if x[2] == label)[: config.positives]:
            fit = sorted(x for x in met if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out |= {(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit[: config.negatives])}
    return out


def as_set(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_op13_matches_sql(spark, duck, sf_dir):
    got = as_set(QUERIES["op13_hard_negatives"](spark, sf_dir))
    sql = duck.sql(ORACLE_SQL["op13_hard_negatives"])
    assert sql.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got == set(sql.fetchall()) and len(got) > 50


def test_negatives_over_shards_blocks_and_hot_clusters(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 12))
    own = rng.integers(0, 6, 1500)
    x = centre[own] + 0.3 * rng.normal(size=(1500, 12))
    x[:500] = x[0]  # a third of all rows are one vector
    rows = [(int(i), int((own[i] + (rng.random() < 0.4)) % 3), x[i].tolist()) for i in range(1500)]
    v = negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    config = negatives.NegativeConfig(clusters=5, shard_rows=200, block_anchors=8, step=16)
    want = brute_negatives([(i, label, np.floor(np.array(e) * 256).astype(np.int64)) for i, label, e in rows])
    assert as_set(negatives.mine(v, v.where("vec_id % 50 = 0"), config)) == want and len(want) > 100


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(6)
    centre = np.eye(16)[0]
    u = np.round(1000 * (centre + 0.02 * rng.normal(size=(20, 16)))).astype(np.int64)
    x = np.round(300 * rng.normal(size=(4000, 16))).astype(np.int64)
    ids = rng.permutation(4000)
    who, score, row, made = negatives.walk(u, x, ids, centre, 5, lambda m, r, s: np.ones(s.shape, bool), np.full(20, -np.inf), 64)
    assert made < 20 * 4000 / 4  # the bound, not the list's end, stopped the walk
    for m in range(20):
        s = x @ u[m]
        assert row[who == m].tolist() == np.lexsort((ids, -s))[:5].tolist() and score[who == m].tolist() == sorted(s.tolist(), reverse=True)[:5]


def test_awkward_vectors_as_anchors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.8, 0.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 2, []), (9, 2, [1.0, 2.0, 3.0]), (None, 2, [0.8, 0.0]), (10, 2, [1e30, 0.0]), (50, 3, [0.0, 0.0]), (11, 3, [0.0, 0.0]), (2, 2, [0.8, 0.0])]
    v = spark.createDataFrame([(i, x, y, 1, 2) for i, y, x in rows], "vec_id long, embedding array<double>, label int, v int, rank int")
    good = negatives.usable(v)
    got = sorted(negatives.mine(good, good.where("vec_id % 50 = 0")).collect())
    # the zero anchor's positive has score 0, and every row of another label has score 0 with it
    zero = [(50, 11, 1, 0, 0, 0), (50, 11, 2, 1, 0, 0), (50, 11, 3, 2, 0, 0)]
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 52224), (0, 1, 2, 2, 65536, 52224), *zero]
    assert negatives.mine(good.limit(0), good.limit(0)).count() == 0
