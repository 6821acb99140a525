from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import grouping_packer as G

WORD = public_tokenizers.path("word_bpe_49k.json")


def _fills(genome, sizes):
    fills = defaultdict(int)
    for b, s in zip(genome, sizes):
        fills[b] += s
    return fills


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 99), min_size=1, max_size=80), seed=st.integers(0, 9))
def test_evolution_never_breaks_or_worsens_a_packing(sizes, seed):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    start = len(G.best_fit(sizes, order, 100).items)
    genomes = G.evolve(sizes, [], 100, seed)
    for g in genomes:
        assert len(g) == len(sizes) and max(_fills(g, sizes).values()) <= 100
    assert -(-sum(sizes) // 100) <= len(_fills(genomes[0], sizes)) <= start
    again = G.evolve(sizes, genomes, 100, seed + 1)
    assert len(_fills(again[0], sizes)) <= len(_fills(genomes[0], sizes))


def test_crossover_injects_whole_bins():
    import random
    sizes = [60, 40, 55, 45, 70, 30, 80, 20]
    a = G._bins_of([0, 1, 2, 1, 3, 4, 5, 6], sizes, 100)
    b = G._bins_of([0, 0, 1, 1, 2, 2, 3, 3], sizes, 100)
    child = G.crossover(a, b, random.Random(1), share=1.0)
    held = [sorted(x) for x in child.items]
    assert sorted(i for x in held for i in x) == list(range(8))
    assert sum(x in ([0, 1], [2, 3], [4, 5], [6, 7]) for x in held) >= 2


def test_evolution_beats_plain_best_fit():
    """Triplets that fill bins exactly, a known hard case for best fit."""
    rng = np.random.default_rng(2)
    sizes = []
    for _ in range(20):
        a = int(rng.integers(380, 495))
        b = int(rng.integers(251, (1000 - a) // 2))
        sizes += [a, b, 1000 - a - b]
    order = sorted(range(60), key=lambda i: (-sizes[i], i))
    start = len(G.best_fit(sizes, order, 1000).items)
    best = min(len(_fills(G.evolve(sizes, [], 1000, s, offspring=400)[0], sizes)) for s in range(3))
    assert best < start


def _check(rows, docs, capacity):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    want = Counter()
    for doc, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc, k, at, len(ids[at:at + capacity]), crc32(ids[at:at + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return seqs


def test_odd_documents_are_packed(odd_docs, odd_rows, no_docs):
    rows = G.pack_documents(odd_docs, WORD, capacity=64).collect()
    _check(rows, [(r[0], r[1]) for r in odd_rows], 64)
    assert G.pack_documents(no_docs, WORD).count() == 0


def test_documents_are_packed_tightly(spark, documents):
    rows = G.pack_documents(documents, WORD).collect()
    seqs = _check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], 2048)
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_several_cells_and_islands(spark):
    rng = np.random.default_rng(0)
    items = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(rng.integers(1, 100, 1500))], "key long, length long")
    a = G.pack(items, capacity=100, cell=200, islands=3, epochs=3).collect()
    assert sorted(r["key"] for r in a) == list(range(1500))
    assert sorted(map(tuple, a)) == sorted(map(tuple, G.pack(items.repartition(4), capacity=100, cell=200, islands=3,
                                                             epochs=3).collect()))
