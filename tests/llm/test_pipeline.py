"""The pipeline, stage by stage on what the one before kept."""

import re

import corpus_pipeline
import pytest
from leafmill.llm import language_id
from tests.conftest import SF_DIR
from tests.llm.test_near import brute
from tests.llm.test_text import check_packing, plain_secrets
from tests.llm.util import docs, read, with_clashes


def test_stages(spark, tmp_path):
    rows = read(spark, SF_DIR)
    junk = spark.createDataFrame([(10_001, "0123 4567 !!!", "en", "src0", 13), (10_002, None, "fr", "src1", None), (None, "zxqz qxzq zzxq " * 50, "de", None, 750)], rows.schema)
    docs, before = rows.unionByName(junk), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        was, now = ({r["doc_id"]: r for r in d.collect()} for d in (before, docs)) if name != "best_fit_packing" else ({}, {})
        if name == "language_id":
            assert set(was) - set(now) == {10_001, 10_002, None}
        elif name == "exact_dedup":
            groups = {}
            for i, r in was.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), i if i is not None else -1))
            assert {i if i is not None else -1 for i in now} == {min(g)[1] for g in groups.values()}
        elif name == "minhash_near_dedup":
            want = brute({-1 if i is None else i: r["text"] for i, r in was.items()}, words=5)
            assert {-1 if i is None else i for i in now} == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "secret_scan":
            assert set(was) == set(now)
            for i, r in now.items():
                assert (r["text"] == was[i]["text"]) == (not plain_secrets(was[i]["text"]))
                assert r["n_chars"] == len(r["text"]) and not plain_secrets(r["text"].replace("[SECRET]", "\n"))
        else:
            check_packing(docs.collect(), {r["doc_id"]: r["text"] for r in before.collect()})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("stored", [False, True])
def test_rows_of_repeated_and_null_ids(spark, tmp_path, stored):
    """Each row is judged for itself: copies under one id, other texts under it, rows without id."""
    texts = [r["text"] for r in read(spark, SF_DIR).where("lang = 'en' AND n_chars > 1500 AND n_chars < 6000").orderBy("doc_id").limit(40).collect()]
    texts = [t for i, t in enumerate(texts) if t not in texts[:i]][:6]
    a, b, c, d, e, _ = texts
    near = a + " one more word"
    rows = [(1, a), (1, a), (1, b), (2, a), (None, c), (None, c), (None, d), (3, near), (4, "0123 !!"), (4, e), (5, None), (6, None), (7, "")]
    df = docs(spark, rows)
    if stored:
        df.repartition(3).write.parquet(f"file://{tmp_path}/t")
        df = spark.read.parquet(f"file://{tmp_path}/t")
    assert kept(stage("exact_dedup")(spark, df, SF_DIR)) == sorted([(1, a), (1, b), (None, c), (None, d), (3, near), (4, "0123 !!"), (4, e), (5, None)], key=str)
    assert kept(stage("minhash_near_dedup")(spark, df, SF_DIR)) == sorted([(1, a), (1, b), (None, c), (None, d), (4, "0123 !!"), (4, e), (5, None), (6, None), (7, "")], key=str)
    whole = read(spark, SF_DIR).select(df.columns).unionByName(df.selectExpr("doc_id - 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    odd = stage("language_id")(spark, whole, SF_DIR).where("doc_id < 0 OR doc_id IS NULL")
    assert kept(odd) == sorted([(i - 1_000_000 if i else None, t) for i, t in rows if t and len(t) > 20], key=str)


def test_stages_on_empty_tables_and_other_columns(spark):
    none = docs(spark, ["x"]).limit(0)
    few = with_clashes(docs(spark, ["the password: hunter22, ok", None, "", "the password: hunter22, ok"]))
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, none, SF_DIR).count() == 0
        out = run(spark, few, SF_DIR)
        if name != "best_fit_packing":
            assert out.columns == few.columns
        rows = out.count()
        assert rows == {"language_id": rows, "exact_dedup": 2, "minhash_near_dedup": 3, "secret_scan": 4, "best_fit_packing": 4}[name]


def test_run_gives_packed_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "secret_scan", "best_fit_packing"]
    assert language_id.NONE == "und"
