from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import id_files, mixing_coder, subwords
from evenkeel.llm.mixing_coder import decode_block, encode_block
from evenkeel.llm.subwords import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=[(BYTE, True), (WORD, False)])
def encoder(request):
    return PieceEncoder(*request.param)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \n\t\r\u00a0\u3000abÉßé1.,'$<|>", max_size=30), max_size=5))
def test_pieces_equal_whole_texts(encoder, texts):
    ids, sizes = encoder.encode(texts, 0)
    want = [e.ids + [0] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_pieces_equal_whole_documents(encoder, documents):
    texts = [r["text"] or "" for r in documents.collect()]
    ids, _ = encoder.encode(texts, 0)
    assert ids.tolist() == [i for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
                            for i in e.ids + [0]]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 129, 5000, 300_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.zeros(n, np.int64), rng.zipf(1.3, n) % 50_000):
        assert (decode_block(encode_block(ids, 50_257), n, 50_257) == ids).all()


@pytest.mark.parametrize("vocab", [1, 2, 3, 300, 70_000])
def test_blocks_round_trip_in_any_vocabulary(vocab):
    rng = np.random.default_rng(vocab)
    for ids in (rng.integers(0, vocab, 9001), np.tile(rng.integers(0, vocab, 7), 900), np.full(5000, vocab - 1)):
        assert (decode_block(encode_block(ids, vocab), len(ids), vocab) == ids).all()


def test_reading_searches_nothing(monkeypatch):
    """An id is looked up by its place, once per id, not searched among all ids' bounds."""
    ids = np.random.default_rng(1).zipf(1.3, 20_000) % 50_000
    data, looked_up, id_at = encode_block(ids, 50_257), [], mixing_coder._Model.id_at
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: pytest.fail("searched"))
    monkeypatch.setattr(mixing_coder._Model, "id_at", lambda m, p: looked_up.append(len(p)) or id_at(m, p))
    assert (decode_block(data, len(ids), 50_257) == ids).all()
    assert sum(looked_up) == len(ids)


def test_letters_are_learned_once_whatever_closes_them(encoder):
    own = PieceEncoder(BYTE if encoder.spaced else WORD, encoder.spaced)
    marks = ["", ",", ".", "!?", "...", ")", "'"]
    own.encode(["x " + " ".join(f"Liebling{m} \u00e9t\u00e9{m}" for m in marks)], 0)
    assert len([k for k in own.index if k in ("Liebling", "\u00e9t\u00e9")]) == 2
    assert not [k for k in own.index if k[-1] in ",.!?)'"]


def test_full_store_keeps_what_is_met_again(encoder, monkeypatch):
    own = PieceEncoder(BYTE if encoder.spaced else WORD, encoder.spaced)
    monkeypatch.setattr(subwords, "MAX_PIECES", 60)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh\u00e9"), 5)) for _ in range(400)]
    held = []
    for k in range(0, 400, 10):
        texts = ["it is often said,", " ".join(words[k:k + 10]) + "\nits end."]
        ids, _ = own.encode(texts, 0)
        assert ids.tolist() == [i for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)
                                for i in e.ids + [0]]
        held.append("often" in own.index and own.stored <= 60 + len(own.tails))
    assert all(held)


def test_repetition_is_cheap():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 500), 200)
    assert len(encode_block(ids, 50_257)) < 2 * len(ids) / 4


def test_files_hold_ascending_documents(spark, odd_docs, odd_rows):
    path = id_files.write_ids(odd_docs, BYTE, block_ids=200)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in id_files.read_documents(spark, path).collect())
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    start, want = 0, []
    for doc, text in sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.append((start, doc, len(ids), crc32(ids)))
        start += len(ids)
    assert got == want


def test_damage_is_noticed(spark, documents):
    from pyspark.sql import functions as F
    path = id_files.write_ids(documents.limit(20), BYTE)
    bad = spark.read.parquet(path).withColumn("payload", F.concat(F.col("payload"), F.lit(b"x")))
    bad.write.mode("overwrite").parquet(path + "-bad")
    with pytest.raises(Exception, match="checksum mismatch"):
        id_files.read_documents(spark, path + "-bad").collect()


def test_empty_table(spark, no_docs):
    assert id_files.read_documents(spark, id_files.write_ids(no_docs, BYTE)).count() == 0


def test_one_row_repeated_often_fills_many_shards(spark):
    rows = spark.range(20_000).selectExpr("7L AS doc_id", "'same words in every row' AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few bytes are one task
    try:
        path = id_files.write_ids(rows, BYTE, block_ids=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = id_files.read_documents(spark, path).collect()
    assert sorted(r["start"] for r in docs) == [k * docs[0]["n_tokens"] for k in range(20_000)]
    assert spark.read.parquet(path).select("shard").distinct().count() >= 3
