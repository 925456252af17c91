import corpus_pipeline
from terraloom.llm import registry


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out.cache()
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert "[SECRET]" not in str(docs.columns) and docs.select("sequence_id").distinct().count() > 1


def test_every_operator_has_a_query():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
