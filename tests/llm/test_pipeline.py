"""Every stage of the pipeline against a brute-force version of its own input."""

import pytest
from gyeol.llm import decontamination, pii, toxicity

from tests.llm.test_corpus import D, groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels, bench = spark.read.parquet(f"{D}/labels.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    machine = toxicity.fit(docs, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in out.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "toxicity":
            assert set(after) == {i for i, r in before.items() if machine.score(r.text) < toxicity.THRESHOLD}
        elif name == "near duplicates":
            comp, _ = groups({i: r.text or "" for i, r in before.items()}, 5)
            assert set(after) == {i for i, c in comp.items() if i == c}
        elif name == "benchmark decontamination":
            items = [" ".join(decontamination.words(r.text)) for r in bench.collect()]
            held = {i for i, r in before.items() if any(t in " ".join(decontamination.words(r.text)) for t in items)}
            assert held and not held & set(after) and len(before) - len(after) - len(held) <= 1
        elif name == "personal data":
            assert set(after) == set(before) and not any("@example.com" in (r.text or "") for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
        docs = out
    assert pii.KINDS
    assert corpus_pipeline.run(spark, D).count() == len(after)
