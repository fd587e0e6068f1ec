"""The pipeline's stages one after the other on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from test_documents import brute_components, shingle_sets, targets_by_weight

from vendaflux.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_it_should(spark):
    """Brute force: pipeline, stage by stage."""
    import sentencepiece

    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "pipeline_test")
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == before.columns
    clean = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len(clean - {r.doc_id for r in kept["toxicity"]}) <= 0.02 * len(clean)
    texts = [" ".join((r.text or "").split()) for r in kept["exact_dedup"]]
    assert len(set(texts)) == len(texts) == len({" ".join((r.text or "").split()) for r in kept["toxicity"]})
    roots = brute_components(shingle_sets([(r.doc_id, r.text) for r in kept["exact_dedup"]], 5), 80)
    assert {r.doc_id for r in kept["ngram_jaccard"]} == set(roots.values())
    sizes, taken = {}, {}
    for rows, sums in ((kept["ngram_jaccard"], sizes), (kept["mixing"], taken)):
        for r in rows:
            sums[r.source] = sums.get(r.source, 0) + len((r.text or "").split())
    for source, target in targets_by_weight(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(len(r.text.split()) for r in kept["ngram_jaccard"] if r.source == source)
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    by_id = {r.doc_id: r.text for r in kept["mixing"]}
    assert len(kept["sentencepiece"]) == len(kept["mixing"])
    assert all(list(r.ids) == sp.encode(by_id[r.doc_id]) for r in kept["sentencepiece"])
