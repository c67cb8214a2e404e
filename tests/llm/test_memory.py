"""What the tasks of the pipeline hold at once."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import bootstrap_pii, divergence, packing
from wayfold.llm.common import TOGETHER
from wayfold.session import BATCH_BYTES, MOST_BYTES, small_batches

MB = 1 << 20
N = 4000


def texts():
    """Different texts of 4 KB, 16 MB of them, with something to find in each."""
    return [f"call +1 555 0100 {i:04d} or mail u{i}@example.org " + "plain words go on here " * 175 for i in range(N)]


def held(run):
    """MB of Python objects that ``run`` holds at most, its batches dropped as they come."""
    tracemalloc.start()
    rows = sum(len(x) if isinstance(x, pa.Array) else x.num_rows for x in run)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most / MB


def test_personal_data_holds_few_texts_at_once():
    text, added = pa.array(texts()), pa.nulls(N, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
    rows, most = held(bootstrap_pii._redacted(iter([(text, added)])))
    assert rows == N and most < 9
    rows, most = held(bootstrap_pii._instances(iter([pa.record_batch([text, text], names=["text_key", "text"])])))
    assert rows >= 2 * N and most < 9  # a key is as long as a text here


def test_word_counts_leave_in_bounded_batches():
    words = pa.record_batch([pa.array(["en"] * 40), pa.array([" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(40)])], names=["lang", "text"])
    out = list(divergence._count(iter([words])))
    assert max(x.num_rows for x in out) <= TOGETHER and sum(x.num_rows for x in out) == 80_000 + 9 - 1
    assert sum(sum(x.column("n").to_pylist()) for x in out if 0 in x.column("kind").to_pylist()) >= 80_000


def test_verdicts_hold_few_texts_at_once():
    text = pa.array(texts())
    rows, most = held([divergence._judged_texts(text, pa.array(["en"] * N), pa.nulls(N, pa.string()))])
    assert rows == N and most < 6


def test_pieces_leave_in_bounded_batches():
    batch = pa.record_batch([pa.array([None, *range(1, 3000)], pa.int64()), pa.array(range(3000)), pa.array(["a b c"] * 3000)], names=["doc_id", "row", "text"])
    out = list(packing._pieces(iter([batch]), packing.tokenizer_path(), 2048))
    assert [x.num_rows for x in out] == [1024, 1024, 952] and out[0].column("doc_id").null_count == 1


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "personal_data", "pack"])
def test_stages_bound_the_bytes_of_a_batch(spark, odd, name):
    spark.conf.unset(MOST_BYTES)
    dict(corpus_pipeline.STAGES)[name](spark, odd, "")
    many = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    n = [r["n"] for r in many.mapInArrow(sizes, "n long").collect()]
    spark.conf.unset(MOST_BYTES)
    assert sum(n) == 6000 and max(n) * 2000 <= BATCH_BYTES


def test_a_smaller_bound_of_the_session_stays(spark):
    try:
        for said in ("1m", "65536", str(BATCH_BYTES)):
            spark.conf.set(MOST_BYTES, said)
            small_batches(spark)
            assert spark.conf.get(MOST_BYTES) == said
    finally:
        spark.conf.unset(MOST_BYTES)
