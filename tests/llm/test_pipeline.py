import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

import corpus_pipeline
from quantloom.llm import secrets, simhash
from tests.llm import cases
from tests.llm.test_dedup import classes, exact, fingerprint
from tests.llm.test_text import check_packing, naive_length, naive_ppm


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        rows = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name == "exact_dedup":
            assert set(kept[name]) == {min(own, key=lambda r: (-len(r[1] or ""), r[0]))[0] for own in exact(rows).values()}
        elif name == "simhash_dedup":
            ids = [r[0] for r in rows]
            assert set(kept[name]) == set(classes(ids, np.array([fingerprint(r[1]) for r in rows], np.uint64)).values())
        elif name == "secret_scan":
            model, text = secrets.fit(spark), columns.index("text")
            for r in rows:  # the forest's word on each candidate, and replacement from the last to the first
                want = r[text]
                for start, end, _ in reversed(secrets.spans(want or "")):
                    x = secrets.features(want[start:end], r[text][max(0, start - 40) : start], r[text][end : end + 40], r[columns.index("source")] or "")
                    if model.predictProbability(Vectors.dense(x))[1] >= 0.5:
                        want = want[:start] + "<secret>" + want[end:]
                assert kept[name][r[0]].text == want
            assert set(kept[name]) == {r[0] for r in rows}
        else:
            trees = naive_ppm([(r[1], r[columns.index("lang")]) for r in rows if r[1] is not None and r[columns.index("lang")] is not None])
            for r in rows:
                if r[1] and len(r[1]) < 3000:
                    bits = sorted(naive_length(t, r[1]) for t in trees.values())
                    p = 1 / sum(np.exp(-(b - bits[0]) * np.log(2) * 0.2) for b in bits)
                    assert abs(p - 0.5) < 0.01 or (r[0] in kept[name]) == (p >= 0.5 and any(c.isalpha() for c in r[1]))
                elif not r[1]:
                    assert r[0] not in kept[name]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing([(i, r.text) for i, r in kept["secret_scan"].items()], got)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.doc_tokens) for r in run} == {(r.doc_id, r.doc_tokens) for r in got}


@pytest.mark.parametrize("table", [cases.docs, cases.empty])
def test_pipeline_of_awkward_rows(spark, tmp_path, table):
    """Nulls, repeats, long and empty texts, clashing columns; and no rows at all."""
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert {0, 1, 2, 12}.isdisjoint(ids) and bool(got) == (table is cases.docs)


def test_near_duplicates_that_share_an_id_are_judged_apart(spark):
    text = " ".join(cases.PROSE) * 3
    docs = spark.createDataFrame([(3, text), (5, text), (5, "another text stands here alone with its own words"), (None, text)], "doc_id long, text string")
    assert sorted(map(repr, simhash.keep_one(docs).collect())) == sorted(map(repr, [r for r in docs.collect() if (r.doc_id, r.text) != (5, text)]))
