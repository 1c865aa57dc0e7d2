import corpus_pipeline
from cellweave.llm.runtime import read


def test_without_labels_nothing_is_rejected(spark, sf, odd, tmp_path):
    """No label, or none that can be used: the classifier's stage keeps every row."""
    rows = lambda df: sorted(map(str, df.collect()))
    labels = read(spark, sf, "labels")
    for name, table in (("none", labels.limit(0)), ("null", labels.selectExpr(*(f"cast(null as int) as {c}" if c == "quality" else c for c in labels.columns)))):
        read(spark, sf, "documents").write.parquet(str(tmp_path / name / "documents.parquet"))
        table.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert rows(corpus_pipeline.classified(spark, odd, str(tmp_path / name))) == rows(odd)
