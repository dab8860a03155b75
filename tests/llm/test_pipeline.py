"""The pipeline's stages against brute force on a small corpus."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from tests.llm.test_operators import prose

    passage, item = prose(2, 60), prose(50, 25)
    docs = [
        (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(3, 60) + " " + passage), (4, prose(4, 60) + " " + passage + " " + prose(5, 40)), (5, prose(6, 40) + " " + item + " " + prose(7, 40)),
        (6, "too short"), (7, None), (None, prose(8, 90)), (8, "spam " * 200), (2, prose(1, 120))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 3, 4, None}
    assert out[3].text.endswith(passage) and passage not in out[4].text and out[4].n_chars == len(out[4].text)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
