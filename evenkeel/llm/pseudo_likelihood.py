"""Masked pseudo-likelihood scores from a bidirectional window network over words of their own.

Every word and every pair of neighbours is counted over the whole corpus, by
hash, in tables that grow with it. A word in the middle is predicted by
three experts, each without the occurrence that is masked:

* the words around it: a network (embeddings of the classes of ``SIDE``
  words on both sides, one tanh layer, softmax) gives the word's class, the
  word's own count its share inside the class;
* its left neighbour: how often this word followed it elsewhere;
* its right neighbour: how often this word went before it elsewhere.

The network also weighs the experts, from the hidden layer and the counts
of both neighbours; an expert whose neighbour occurs nowhere else gets no
weight. So each word has its own conditional probability from both sides. A
document's score is the sum of the logarithms over all its words. The places
before and after a document count as one further word.

Documents are cut into blocks; a block sends its distinct words and pairs
with counts, packed, to shards by hash, which add them up and answer with
the totals (a frequent word is one entry per block). Keys of pairs keep 32 bits
beyond the shard's, so about one in 5,000 shares its count with another, at any
size; keys of words keep 44. Training runs in
rounds: every partition trains the current network on its share of positions
(round r: places congruent to r, so all rounds together see every word once)
and the networks are averaged, weighted by words. Only the network, a
histogram of counts and the ``OWN`` most frequent words reach the driver.

Defined results: null, empty and blank texts score 0 with 0 words and a
null mean; repeated rows count and score each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import slices
from evenkeel.session import tasks, written

CLASSES = 32
OWN = 20  # the most frequent words are classes of their own
SIDE = 3
EMBED = 8
HIDDEN = 16
EXPERTS = 3
ROUNDS = 4
BATCH = 1024
RATE = 0.1
CHUNK = 1 << 11
SMOOTH = 0.5  # added to a word's count inside its class
SHARD_WORDS = 1 << 21  # running words of the corpus per shard of the counts
WORD_BITS, PAIR_BITS = 44, 32  # of a key beyond the bits of its shard

_OUTSIDE = np.uint64(0)  # the word before and after every document


# ---------------------------------------------------------------- blocks

_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; high planes of zeros are left out."""
    x = x.astype("<u8")
    size = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = x.view(np.uint8).reshape(len(x), 8)[:, :size].T
    return _PACKER.compress(bytes([size]) + np.ascontiguousarray(planes).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    raw = _UNPACKER.decompress(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.view("<u8").reshape(-1)


_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("words", pa.binary())])
_BLOCK_DDL = "block long, n long, doc_ids array<long>, sizes array<long>, ids binary, words binary"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words of every text, all words one after the other); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty piece
    kept = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return np.diff(np.append(0, kept[ends])).astype(np.int64), words.filter(real)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words: every byte at its place gives a number, the numbers are added up."""
    if not len(words):
        return np.empty(0, "<u8")
    words = pa.concat_arrays([words.cast(pa.large_binary())])  # offset 0
    ends = np.frombuffer(words.buffers()[1], "<i8")[:len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[:ends[-1]].astype(np.uint64)
    places = (np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed(places * np.uint64(256) + data + np.uint64(1)), ends[:-1]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random permutation of 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: words numbered by their frequency in the block, and the hash of each."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch):
            sizes, flat = split_words(part.column("text"))
            coded = flat.dictionary_encode()
            words = word_hashes(coded.dictionary)
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([sizes.tolist()], pa.list_(pa.int64())),
                 pa.array([_packed(rank[ids])], pa.binary()), pa.array([words[order].tobytes()], pa.binary())], schema=_BLOCK)
            block += 1


def layout(ids: np.ndarray, sizes: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of some documents end to end with ``SIDE`` places ``outside`` around each, places of the words)."""
    places = np.repeat(SIDE * (np.arange(len(sizes)) + 1), sizes) + np.arange(len(ids))
    flat = np.full(int(sizes.sum()) + SIDE * (len(sizes) + 1), outside, np.int64)
    flat[places] = ids
    return flat, places


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of word hashes."""
    return _mixed(left * np.uint64(0x94D049BB133111EB) + (right ^ (right >> np.uint64(29))))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a batch may hold many blocks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """Words, neighbours and keys of a block's documents."""

    def __init__(self, ids: bytes, words: bytes, sizes: list[int], bits: int):
        sizes = np.array(sizes, np.int64)
        self.hashes = np.append(np.frombuffer(words, "<u8"), _OUTSIDE)
        outside = len(self.hashes) - 1
        self.flat, self.places = layout(_numbers(ids), sizes, outside)
        self.counts = np.bincount(self.flat[self.places], minlength=outside + 1)
        self.counts[outside] = int((sizes > 0).sum())
        self.word_keys = self.hashes >> np.uint64(64 - WORD_BITS - bits)
        # Pair i: the words at the places i and i + 1, unless both are outside.
        self.real = np.flatnonzero((self.flat[:-1] != outside) | (self.flat[1:] != outside))
        self.pairs = _pair_keys(self.hashes[self.flat[self.real]], self.hashes[self.flat[self.real + 1]]) \
            >> np.uint64(64 - PAIR_BITS - bits)


_ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKED_DDL = "shard int, block long, keys binary, counts binary"


def _ask(bits: int):
    """Distinct words and pairs of a block by shard; pairs go to shards beyond those of words."""
    shards = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                b = Block(r["ids"], r["words"], r["sizes"], bits)
                out = []
                keys, where = np.unique(b.word_keys, return_inverse=True)
                for base, wide, (k, n) in ((0, WORD_BITS, (keys, np.bincount(where, weights=b.counts))),
                                           (shards, PAIR_BITS, np.unique(b.pairs, return_counts=True))):
                    starts = np.arange(shards, dtype=np.uint64) << np.uint64(wide)
                    cut = [*np.searchsorted(k, starts).tolist(), len(k)]
                    out += [(base + s, np.diff(k[i:j], prepend=starts[s]), n[i:j])
                            for s, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, *_ in out], pa.int32()), pa.array([r["block"]] * len(out), pa.int64()),
                     pa.array([_packed(k) for _, k, _ in out], pa.binary()),
                     pa.array([_packed(n) for *_, n in out], pa.binary())], schema=_ASKED)
    return run


_TOTALS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("totals", pa.binary())])
_TOTALS_DDL = "shard int, block long, keys binary, totals binary"


def _add_up(bits: int):
    """Totals for every block, in the order it asked; a shard of words also gives all its words (block -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            asked = [np.cumsum(_numbers(k)) for _, k, _ in held]  # gaps of sorted keys
            keys, where = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([_numbers(c) for *_, c in held])).astype("<u8")
            answer = np.split(total[where], np.cumsum([len(a) for a in asked])[:-1])
            rows = [(b, None, _packed(t)) for (b, *_), t in zip(held, answer)]
            if at < 1 << bits:
                rows.append((-1, ((np.uint64(at) << np.uint64(WORD_BITS)) | keys).astype("<u8").tobytes(), total.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([at] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], _TOTALS.field(i + 1).type)
                                                          for i in range(3))], schema=_TOTALS)

        for batch in batches:
            for shard, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    if held:
                        yield from close()
                    at, held = shard, []
                held.append(rest)
        if held:
            yield from close()
    return run


# ---------------------------------------------------------------- classes

FINE, STEPS = 1024, 32


def count_bin(n: np.ndarray) -> np.ndarray:
    """Bin of a count: itself up to ``FINE``, then ``STEPS`` bins an octave."""
    n = np.asarray(n, np.float64)
    return np.where(n <= FINE, n, FINE + np.ceil(np.log2(np.maximum(n, FINE) / FINE) * STEPS)).astype(np.int64)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and occurrences per bin of counts, and the most frequent words (key and count)."""
    for batch in batches:
        for keys, totals in zip(batch.column("keys").to_pylist(), batch.column("totals").to_pylist()):
            key, n = np.frombuffer(keys, "<u8"), np.frombuffer(totals, "<u8").astype(np.int64)
            key, n = key[key != _OUTSIDE], n[key != _OUTSIDE]  # no word to predict
            b = count_bin(n)
            size, weight = np.bincount(b), np.bincount(b, weights=n)
            bins = np.flatnonzero(size)
            top = np.lexsort((key, -n))[:OWN]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bins, np.full(len(top), -1)]), pa.int32()),
                 pa.array(np.concatenate([np.zeros(len(bins), np.int64), key[top].astype(np.int64)])),
                 pa.array(np.concatenate([size[bins], np.ones(len(top), np.int64)])),
                 pa.array(np.concatenate([weight[bins].astype(np.int64), n[top]]))], names=["bin", "key", "size", "weight"])


class Classes:
    """Classes of words: the most frequent ones by themselves, the others in bands of counts."""

    def __init__(self, top: list[tuple[int, int]], bins: dict[int, tuple[int, int]]):
        self.top = np.array(sorted(k for k, _ in top), np.uint64)
        rest = {b: list(v) for b, v in bins.items()}
        self.size, self.weight = np.zeros(CLASSES), np.zeros(CLASSES)
        own = {k: i for i, k in enumerate(self.top.tolist())}
        for k, n in top:
            b = int(count_bin(n))
            rest[b][0] -= 1
            rest[b][1] -= n
            self.size[own[k]], self.weight[own[k]] = 1, n
        order = np.array(sorted((b for b, v in rest.items() if v[0] > 0), reverse=True), np.int64)
        size = np.array([rest[b][0] for b in order.tolist()], np.float64)
        weight = np.array([rest[b][1] for b in order.tolist()], np.float64)
        self.band = np.full(int(max(bins, default=0)) + 1, CLASSES - 1, np.uint8)
        if len(order):
            share = np.cumsum(np.sqrt(size * weight))  # size * sqrt(mean count)
            cls = OWN + np.minimum((share / share[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
            self.band[order] = cls
            self.size += np.bincount(cls, weights=size, minlength=CLASSES)
            self.weight += np.bincount(cls, weights=weight, minlength=CLASSES)

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Classes of words, given by key and corpus count."""
        cls = self.band[np.minimum(count_bin(counts), len(self.band) - 1)]  # outside may be the most frequent
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
            cls = np.where(self.top[at] == keys, at, cls).astype(np.uint8)
        return cls

    def share(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of a word inside its class, one occurrence of it left out."""
        return (counts - 1 + SMOOTH) / (self.weight[cls] - 1 + SMOOTH * self.size[cls])


def classes_of(totals: DataFrame) -> Classes:
    """Classes from the totals of all words."""
    rows = totals.where("block = -1").select("keys", "totals").mapInArrow(
        _histogram, "bin int, key long, size long, weight long")
    bins = {r["bin"]: (r["size"], r["weight"]) for r in rows.where("bin >= 0").groupBy("bin").agg(
        F.sum("size").alias("size"), F.sum("weight").alias("weight")).collect()}
    top = rows.where("bin < 0").orderBy(F.desc("weight"), "key").limit(OWN).collect()
    return Classes([(r["key"], r["weight"]) for r in top], bins)


# ---------------------------------------------------------------- counts joined to blocks

_READY = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()),
                    ("totals", pa.binary()), ("classes", pa.binary()), ("pairs", pa.binary())])
_READY_DDL = "doc_ids array<long>, sizes array<long>, ids binary, totals binary, classes binary, pairs binary"


def _joined(bits: int, classes: Classes):
    """Blocks with the corpus counts of their words and of the pairs around every place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, ([], [])

        def close() -> pa.RecordBatch:
            b = Block(block["ids"], block["words"], block["sizes"], bits)
            words, pairs = (np.concatenate([_numbers(t) for t in a] or [np.empty(0, "<u8")]) for a in answers)
            totals = words[np.unique(b.word_keys, return_inverse=True)[1]]
            around = np.ones(max(len(b.flat) - 1, 0), "<u8")
            around[b.real] = pairs[np.unique(b.pairs, return_inverse=True)[1]]
            cls = classes.of(b.word_keys, totals)
            cls[-1] = CLASSES
            return pa.RecordBatch.from_arrays(
                [pa.array([block["doc_ids"]], pa.list_(pa.int64())), pa.array([block["sizes"]], pa.list_(pa.int64())),
                 *(pa.array([v], pa.binary()) for v in (block["ids"], _packed(totals), cls.tobytes(), _packed(around)))],
                schema=_READY)

        for batch in batches:
            for r in _rows(batch):
                if r["shard"] < 0:
                    if block is not None:
                        yield close()
                    block, answers = r, ([], [])
                else:
                    answers[r["shard"] >> bits].append(r["totals"])
        if block is not None:
            yield close()
    return run


class Positions:
    """What the network sees of a block: classes and counts by place."""

    def __init__(self, row: dict, classes: Classes):
        sizes = np.array(row["sizes"], np.int64)
        totals, cls = _numbers(row["totals"]).astype(np.float64), np.frombuffer(row["classes"], np.uint8).astype(np.intp)
        share = np.append(classes.share(cls[:-1], totals[:-1]), 0.0)
        flat, self.places = layout(_numbers(row["ids"]), sizes, len(totals) - 1)
        self.cls, self.elsewhere, self.share = cls[flat], totals[flat] - 1, share[flat]
        self.beside = _numbers(row["pairs"]).astype(np.float64) - 1

    def window(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the places ``p``: classes around, class in the middle, expert inputs, probabilities beside the network's.

        The expert inputs are how often the left and the right neighbour occur elsewhere; the probabilities are
        the word's share inside its class and those given the left and the right neighbour.
        """
        beside = np.stack([self.elsewhere[p - 1], self.elsewhere[p + 1]], axis=1)
        given = np.empty((len(p), EXPERTS))
        given[:, 0], given[:, 1], given[:, 2] = self.share[p], self.beside[p - 1], self.beside[p]
        given[:, 1:] /= np.maximum(beside, 1)
        return self.cls[p[:, None] + _STEPS], self.cls[p], beside, given


_STEPS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


# ---------------------------------------------------------------- network

class Network:
    """Parameters and passes; ``CLASSES`` itself is the class of places outside a document."""

    SHAPES = [(CLASSES + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,),
              (HIDDEN + 2, EXPERTS), (EXPERTS,)]

    def __init__(self, flat: np.ndarray | None = None, dtype=np.float32):
        if flat is None:
            rng = np.random.default_rng(5)
            self.parts = [rng.normal(0, 0.3 if len(s) == 2 else 0, s).astype(dtype) for s in self.SHAPES]
        else:
            cuts = np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1]
            self.parts = [p.reshape(s).astype(dtype).copy() for p, s in zip(np.split(flat, cuts), self.SHAPES)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def forward(self, around: np.ndarray, beside: np.ndarray):
        """(inputs, hidden layer and neighbours' counts, class probabilities, expert weights)."""
        e, w1, b1, w2, b2, w3, b3 = self.parts
        x = e.take(around, axis=0).reshape(len(around), -1)
        h = np.tanh(x @ w1 + b1)
        p = _softmax(h @ w2 + b2)
        k = np.concatenate([h, (np.log1p(beside) / 8).astype(h.dtype)], axis=1)
        g = k @ w3 + b3
        g[:, 1:][beside < 1] = -1e9
        return x, k, p, _softmax(g)

    def _experts(self, p, weights, middle, given):
        parts = weights.astype(np.float64) * given
        parts[:, 0] *= p[np.arange(len(middle)), middle]
        return parts, np.maximum(parts.sum(axis=1), 1e-300)

    def log_prob(self, around, middle, beside, given) -> np.ndarray:
        _, _, p, weights = self.forward(around, beside)
        return np.log(self._experts(p, weights, middle, given)[1])

    def gradients(self, around, middle, beside, given) -> list[np.ndarray]:
        """Gradients of the mean negative log-probability."""
        x, k, p, weights = self.forward(around, beside)
        parts, total = self._experts(p, weights, middle, given)
        due = (parts / total[:, None]).astype(x.dtype)  # how much of the word each expert answers for
        dg = (weights - due) / len(middle)
        p[np.arange(len(middle)), middle] -= 1
        dz = p * (due[:, :1] / len(middle))
        h = k[:, :HIDDEN]
        dh = (dz @ self.parts[3].T + dg @ self.parts[5][:HIDDEN].T) * (1 - h * h)
        dx = dh @ self.parts[1].T
        at, dx = around.ravel(), dx.reshape(-1, EMBED)
        de = np.stack([np.bincount(at, weights=column, minlength=CLASSES + 1) for column in dx.T], axis=1)
        return [de.astype(x.dtype), x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0), k.T @ dg, dg.sum(axis=0)]

    def train(self, around, middle, beside, given, memory: list[np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step."""
        for part, grad, seen in zip(self.parts, self.gradients(around, middle, beside, given), memory):
            seen += grad * grad
            part -= rate * grad / np.sqrt(seen + 1e-6)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _trainer(start: np.ndarray, classes: Classes, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = Network(start), 0
        memory = [np.zeros_like(p) for p in net.parts]
        for batch in batches:
            for row in _rows(batch):
                seen = Positions(row, classes)
                places = seen.places[(seen.places + turn) % rounds == 0]
                places = np.random.default_rng(turn).permutation(places)
                for at in range(0, len(places), BATCH):
                    net.train(*seen.window(places[at:at + BATCH]), memory)
                n += len(places)
        if n:
            v = net.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v * n),
                                              pa.array(np.full(len(v), float(n)))], names=["i", "v", "w"])
    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64())])


def _scorer(params: np.ndarray, classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(params)
        for batch in batches:
            for row in _rows(batch):
                seen, sizes = Positions(row, classes), np.array(row["sizes"], np.int64)
                got = np.empty(len(seen.places))
                for at in range(0, len(got), CHUNK):
                    got[at:at + CHUNK] = net.log_prob(*seen.window(seen.places[at:at + CHUNK]))
                sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=got, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(sums)],
                                                 schema=_SCORED)
    return run


# ---------------------------------------------------------------- on Spark

def encode(docs: DataFrame) -> DataFrame:
    """Blocks of the rows of ``docs``; written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_encode, _BLOCK_DDL), "words")


def corpus_counts(encoded: DataFrame) -> tuple[DataFrame, int]:
    """Totals of every word and pair by shard, block by block and (block -1) of all words; bits of a shard's number."""
    spark = encoded.sparkSession
    n = encoded.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(n // SHARD_WORDS).bit_length())
    asked = (encoded.select("block", "sizes", "ids", "words").mapInArrow(_ask(bits), _ASKED_DDL)
             .repartition(tasks(spark), "shard").sortWithinPartitions("shard", "block"))
    return written(asked.mapInArrow(_add_up(bits), _TOTALS_DDL), "word_totals"), bits


def with_counts(encoded: DataFrame, totals: DataFrame, bits: int, classes: Classes) -> DataFrame:
    """Blocks with the totals of their words and pairs; written."""
    both = encoded.drop("n").withColumn("shard", F.lit(-1)).unionByName(
        totals.where("block >= 0").select("shard", "block", "totals"), allowMissingColumns=True)
    dealt = both.repartition(tasks(encoded.sparkSession), "block").sortWithinPartitions("block", "shard")
    return written(dealt.mapInArrow(_joined(bits, classes), _READY_DDL), "word_places")


def train(ready: DataFrame, classes: Classes, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` rounds of local training and averaging."""
    params = Network().flat()
    for turn in range(rounds):
        got = (ready.mapInArrow(_trainer(params, classes, turn, rounds), "i int, v double, w double")
               .groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).collect())
        for r in got:
            params[r["i"]] = r["v"]
    return params


def prepared(docs: DataFrame) -> tuple[DataFrame, Classes]:
    """Blocks with their counts, and the classes of words."""
    encoded = encode(docs)
    totals, bits = corpus_counts(encoded)
    classes = classes_of(totals)
    return with_counts(encoded, totals, bits, classes), classes


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of every row of ``docs`` (doc_id, text)."""
    ready, classes = prepared(docs)
    params = train(ready, classes, rounds)
    out = ready.mapInArrow(_scorer(params, classes), "doc_id long, n_words long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
