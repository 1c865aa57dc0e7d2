import corpus_pipeline
import public_tokenizers

from cellweave.llm import packing, quality_classifier, quality_rules
from cellweave.llm.runtime import read
from tests.llm.test_similar import brute_groups


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    labels = read(spark, sf, "labels")
    columns, kept = docs.columns, docs
    good = {r["doc_id"] for r in quality_classifier.classify(docs, quality_classifier.learn(docs, labels)).collect() if r["predicted"] == 1}
    kept = corpus_pipeline.classified(spark, docs, sf)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == good and 0 < len(good) < docs.count()
    passed = {r["doc_id"] for r in quality_rules.apply_rules(kept, quality_rules.learn(docs, labels)).collect() if r["kept"]}
    ruled = corpus_pipeline.ruled(spark, kept, sf)
    assert ruled.columns == columns and {r["doc_id"] for r in ruled.collect()} == passed
    rows = [(r["doc_id"], r["text"]) for r in ruled.collect()]
    single = [min(rows[k][0] for k in group) for group in brute_groups([t for _, t in rows])]
    last = corpus_pipeline.deduplicated(spark, ruled, sf)
    assert last.columns == columns and sorted(r["doc_id"] for r in last.collect()) == sorted(single)
    ids = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {r["doc_id"]: len(ids.encode(r["text"])) // 4 + 1 for r in last.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_clean_documents_with_labels_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    kept = {r["doc_id"] for r in corpus_pipeline.classified(spark, docs, sf).collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [i for i, q in quality.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_stages_without_rows_or_labels(spark, sf, odd, none, tmp_path):
    """The stages on odd rows and on nothing, beside tables that hold nothing."""
    for name in ("documents", "labels"):
        read(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.packed(spark, docs, str(tmp_path)).agg({"length": "sum"}).first() is not None
