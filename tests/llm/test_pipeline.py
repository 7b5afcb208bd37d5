"""Each stage of the pipeline against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
from timbrel.llm import mixing, near_dup, quality

from ..conftest import SF
from .test_operators import WORD, brute_windows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows[k] = (before, docs)
    before, after = rows[0]
    labels = quality.learnable(spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(before, labels).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == good
    before, after = rows[1]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_dup.near_duplicates(before).collect() if r.kept}
    before, after = rows[2]
    want = {i: (n, gone) for i, n, gone, _ in brute_windows([(r.doc_id, r.text) for r in before.collect()])}
    left = {r.doc_id: len(WORD.findall(r.text)) for r in after.collect()}
    assert left == {i: n - gone for i, (n, gone) in want.items() if n > gone or not gone}
    before, after = rows[3]
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(before).collect() if r["size"]}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in times.items() if n})
    before, after = rows[4]
    tokens = Counter()
    for r in after.collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == {r.doc_id for r in before.collect()}


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    from .test_operators import ALL, AWKWARD

    for rows in (AWKWARD, []):
        docs = spark.createDataFrame(rows, ALL)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() > 0 if rows else docs.count() == 0, name
