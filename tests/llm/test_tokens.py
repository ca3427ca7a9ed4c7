"""Token files: exact round trip, random access, order and starts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import tokens
from eventlake.llm.tokens import Image, WordCoder, encode, read_token_files, write_token_files
from eventlake.session import scratch_dir

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, here. And (more) words!", "", None, "don't it's 'S a'b x'll", "É é ΟΔΟΣ ΟΔΟΣ. a　b é́.x", "<|endoftext|> Foo <|ENDOFTEXT|>",
    "\x01 a \x01\x01 b", "123 4a5 ###x!!y $$$ a_b", " \t\n ", "word " * 3000, "İstanbul ǅ ẞ ß", "a\x0bb\x0cc\x1cd\x85e",
]


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1, 0, 1] * 400, list(range(3000)), [49407] * 1025])
def test_image_round_trip_and_random_access(ids):
    image = Image(encode(np.array(ids, np.uint64)))
    assert image.all().tolist() == ids and [image[i] for i in range(len(image))] == ids
    with pytest.raises(IndexError):
        image[len(ids)]


def test_by_word_equals_whole_texts():
    coder = WordCoder(PATH)
    for _ in range(2):  # the second time from the store of words
        ids, counts = coder.column(pa.array(TEXTS))
        ends = np.cumsum(counts)
        for text, end, n in zip(TEXTS, ends, counts):
            assert ids[end - n : end].tolist() == coder._plain(text or ""), text


def test_store_of_words_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(WordCoder, "LIMIT", 5)
    coder = WordCoder(PATH)
    ids, _ = coder.column(pa.array(["one two three four", "five six seven one two"]))
    assert ids.tolist() == coder._plain("one two three four five six seven one two")


def test_a_task_leaves_no_words_in_its_worker(monkeypatch):
    """Workers outlive the stage: what a task has learnt would stay beside the memory of all later stages."""
    monkeypatch.setattr(tokens.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(TEXTS[:2])], ["doc_id", "text"])
    (image,) = tokens._pack(PATH, 2)(iter([batch]))
    assert image.column("part").to_pylist() == [3] and tokens._coder.cache_info().currsize == 0
    with pytest.raises(KeyError):
        list(tokens._pack(PATH, 2)(iter([batch.select(["doc_id"])])))
    assert tokens._coder.cache_info().currsize == 0 and WordCoder.LIMIT <= 300_000


def test_a_tokenizer_that_keeps_white_space_sees_whole_texts():
    coder = WordCoder(P.path("byte_bpe_50k.json"))
    assert not coder.by_word
    ids, counts = coder.column(pa.array(["a  b c", None, "d"]))
    assert ids.tolist() == coder._plain("a  b c") + coder._plain("d") and counts.tolist()[1] == 0


def test_files(spark):
    rows = [(i * 3 % 37, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x"), (5, "repeated", "x"), (5, "repeated", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = scratch_dir(spark, "t")
    write_token_files(docs, path, PATH)
    got = read_token_files(spark, path).collect()
    plain = WordCoder(PATH)._plain
    want = {(d, len(plain(t or "")) + 1, zlib.crc32(np.array([*plain(t or ""), 2], "<u4").tobytes())) for d, t, _ in rows}
    assert len(got) == len(rows) and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at
        at += row["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_empty_table(spark):
    path = scratch_dir(spark, "t")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_token_files(spark, path).count() == 0
