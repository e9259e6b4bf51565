import pyarrow as pa

from visitprep.llm import common, packing


def test_encoder_keeps_a_word_once_and_batches_are_cut():
    """A piece that is one word is not kept as a word too; texts become Python's in parts of a bounded size."""
    enc = packing.WordEncoder(packing.default_tokenizer())
    texts = ["hello", "hello,hello Hello", "world hello's"]
    assert [enc.encode(t) for t in texts] == [enc.direct(t) for t in texts]
    assert "hello" in enc.chunks and "hello" not in enc.words
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 700_000, None, "", "y" * 700_000, "z" * 2_000_000, "w"], kind)], names=["doc_id", "text"])
        parts = list(common.pieces(batch, "text"))
        assert [p.num_rows for p in parts] == [3, 1, 1, 1] and [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
