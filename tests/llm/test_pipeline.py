"""The corpus pipeline, stage by stage against plain versions on each stage's own input."""

from __future__ import annotations

import corpus_pipeline

from faultline.llm import quality
from faultline.llm.queries import VOCABULARY
from faultline.session import store
from test_documents import LIBRARY, SF, check_packing, plain_classes, plain_lines


def test_stages_do_what_they_say(spark, documents):
    assert VOCABULARY and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, SF), f"test_{name}")
        assert docs.columns == documents.columns
        kept.append({r.doc_id: r for r in docs.collect()})
    good, lined, near = kept
    told = {r.doc_id: r.quality_keep for r in quality.classify(documents).collect()}
    assert set(good) == {i for i, keep in told.items() if keep} and 0 < len(good) < len(told)
    assert {i: r.text for i, r in lined.items()} == {i: x[2] for i, x in plain_lines({i: r.text for i, r in good.items()}).items()}
    assert all(r.n_chars == len(r.text) for r in lined.values())
    classes = plain_classes({i: r.text for i, r in lined.items()})
    assert set(near) == set(classes.values()) and all(near[i].text == lined[i].text for i in near)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check_packing({i: [*LIBRARY.encode(r.text, add_special_tokens=False).ids, 2] for i, r in near.items()}, rows, 4096) == 0


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for given in (odd_docs.withColumnRenamed("h", "n_chars"), no_docs):
        docs, before = given, 9
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = store(stage(spark, docs, SF), "odd")
            assert docs.columns == given.columns and docs.count() <= before
            before = docs.count()
        kept = docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("start = 0").count() == kept
