"""The pipeline's stages, one after another, on awkward rows."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.tables import ROWS, TOKENIZERS, documents, empty

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="tokenizer files are not here")
LABELS = "doc_id long, quality int, toxic int"


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = stored(documents(spark), tmp_path / "documents.parquet")
    columns, ids = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, str(tmp_path)), tmp_path / f"stage{i}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or i == 4
    known = {d for d, *_ in ROWS}
    assert ids[0] == known - {4, 5, 6, 9, 12, 13} and ids[1] == ids[0] - {2, 3} and ids[2] == ids[1] - {8}
    assert ids[3] <= ids[2] and ids[4] == ids[3] and docs.filter(F.size("pieces") == 0).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_last_stage_decodes(spark, tmp_path):
    got = corpus_pipeline.STAGES[-1][1](spark, documents(spark), str(tmp_path)).collect()
    assert len(got) == len(ROWS) and all(r["lossless"] for r in got)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def batch_sizes(spark):
    """Bytes of the batches in which Python gets 22 MB of text that lie in one partition."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("some words "), 1000).alias("text"))
    return [r["n"] for r in texts.mapInArrow(run, "n long").collect()]


@pytest.mark.parametrize("stage", [0, 2, 4])
def test_python_stages_get_texts_in_small_batches(spark, tmp_path, stage):
    spark.conf.unset(corpus_pipeline.ARROW_BYTES)
    try:
        corpus_pipeline.STAGES[stage][1](spark, documents(spark), str(tmp_path))
        assert max(batch_sizes(spark)) < 4 << 20
        spark.conf.set(corpus_pipeline.ARROW_BYTES, "8m")
        corpus_pipeline.STAGES[stage][1](spark, documents(spark), str(tmp_path))
        assert spark.conf.get(corpus_pipeline.ARROW_BYTES) == "8m"
    finally:
        spark.conf.unset(corpus_pipeline.ARROW_BYTES)
