"""The whole pipeline on odd tables."""

import numpy as np
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark that no document may hold in any form")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables_and_null_ids(spark, tmp_path, empty):
    leak = "before a passage of the benchmark that no document may hold in any form after"
    rows = [(None, "one text about rivers and hills, write to a.b@example.org", None, None, None), (None, "another text about cities and streets", "en", "s", 3), (7, None, None, None, None), (8, leak, "en", "s", 4), (None, leak, "en", "s", 4)]
    folder = tables(spark, tmp_path / "sf", [] if empty else rows)
    pieces = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    if empty:
        assert pieces == []
        return
    from tokenizers import Tokenizer
    import public_tokenizers

    decode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).decode
    whole = "".join(decode(np.frombuffer(p[4], "<u4").tolist()) for p in pieces if not p[0])
    assert "rivers and hills" in whole and "cities" in whole and "benchmark" not in whole and "example.org" not in whole
    assert {p[1] for p in pieces if p[0]} <= {7}
