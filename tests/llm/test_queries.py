"""The registered queries with SQL against DuckDB, and the pipeline against its stages' plain versions."""

import pytest

from lifelane.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, same, name):
    same(queries()[name](spark, SF), duck.sql(oracle_sql()[name]))


def test_pipeline_stages(spark):
    import sentencepiece
    from test_operators import brute_components, words

    import corpus_pipeline
    from lifelane.llm import sentencepiece_codec
    from lifelane.llm.common import stored, table

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert ids["near_dedup"] <= ids["toxicity"] <= ids["quality"] and len(ids["quality"]) > 100
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in ids["toxicity"] for i in good) >= 0.95 * len(good)
    want = brute_components([(r.doc_id, r.text) for r in kept["toxicity"]], 5, 80, 100)
    assert ids["near_dedup"] == {i for i, (_, c) in want.items() if c == i}
    # A source of a few documents can miss its target by up to its longest one.
    total, longest = sum(len(words(r.text)) for r in kept["near_dedup"]), {}
    for r in kept["near_dedup"]:
        longest[r.source] = max(longest.get(r.source, 0), len(words(r.text)))
    assert abs(sum(len(words(r.text)) for r in kept["mixture"]) - total) <= sum(longest.values())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert all(r.ids == library.encode(r.text) and r.decoded == r.text for r in kept["sentencepiece"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["sentencepiece"])


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and no rows at all."""
    import corpus_pipeline
    from lifelane.llm.common import stored
    from test_operators import ROWS, text

    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in ROWS]
    rows += [(500, text(9, 20_000), "en", "a", None), (501, text(9, 20_000) + " end", None, "a", 1), (None, None, None, None, None), (502, "tie one two three", "en", "b", 3), (503, "tie one two three", "en", "b", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (12, 0, 1), (8, 1, None)]
    for name, table, marks in (("some", rows, labels), ("none", [], [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        known = {str(r) for r in docs.collect()}
        for stage, run in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = stored(run(spark, docs, folder), stage)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {str(r) for r in docs.collect()} <= known
            assert stage == "mixture" or docs.count() <= before
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert out.columns == [*docs.columns, "ids", "decoded"] and out.count() == docs.count()
        assert all(r.decoded == r.text for r in out.collect() if "▁" not in (r.text or ""))
        assert corpus_pipeline.run(spark, folder).count() == out.count()
