"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become ids; longer ones than a sequence are cut into full
pieces. Full pieces are sequences of their own; the others are dealt by a
hash into cells of bounded size, and each cell is packed by a grouping
genetic algorithm: an individual is a set of bins, crossover injects whole
well-filled bins of one parent into the other, removes the bins that now
hold duplicates and best-fits the displaced pieces, longest first. Every
cell evolves on several islands (rows that Spark spreads); between epochs
each island's elite migrates to the next one. A cell that reaches the
volume bound ceil(sum / capacity) is optimal and stops.

Defined results: null and empty texts are the end id alone (one piece of
length 1); repeated rows are packed each; an empty table gives an empty
result; extra columns are not read. The same input gives the same packing.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import slices
from evenkeel.llm.subwords import encoder
from evenkeel.session import written

CAPACITY = 2048
END = 0
#: Expected pieces in a cell; a hash deals them, so no cell is much larger.
CELL = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
OFFSPRING = 12

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def _cutter(path: str, spaced: bool, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced)
        for batch in batches:
            for part in slices(batch):
                flat, lens = enc.encode([t or "" for t in part.column("text").to_pylist()], END)
                raw = flat.astype("<u4")
                docs, nums, starts, sizes, crcs = [], [], [], [], []
                base = 0
                for doc, n in zip(part.column("doc_id").to_pylist(), lens.tolist()):
                    for k, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        docs.append(doc)
                        nums.append(k)
                        starts.append(start)
                        sizes.append(size)
                        crcs.append(crc32(raw[base + start:base + start + size]))
                    base += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip((docs, nums, starts, sizes, crcs), _PIECES)], schema=_PIECES)
    return cut


def pieces(docs: DataFrame, tokenizer: str, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, key (unique) of ``docs`` (doc_id, text); written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(_cutter(tokenizer, spaced, capacity),
                          "doc_id long, piece int, start long, length long, ids_crc32 long")
    return written(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")


# ---------------------------------------------------------------- one cell

class Bins:
    """Bins of item numbers with best-fit insertion: a bit per free space that some bin has."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], free: int) -> None:
        b = len(self.items)
        self.items.append(items)
        self.free.append(free)
        self.at[free].append(b)
        self.mask |= 1 << free

    def put(self, item: int) -> None:
        """Into the fullest bin with room, else a new one."""
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.add([item], self.capacity - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        b = self.at[free].pop()
        if not self.at[free]:
            self.mask ^= 1 << free
        self.items[b].append(item)
        left = free - size
        self.free[b] = left
        self.at[left].append(b)
        self.mask |= 1 << left


def best_fit(sizes: list[int], order: list[int], capacity: int) -> Bins:
    bins = Bins(sizes, capacity)
    for i in order:
        bins.put(i)
    return bins


def worth(bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (mean square fill)."""
    return len(bins.items), -sum((bins.capacity - f) ** 2 for f in bins.free) / max(len(bins.free), 1)


def crossover(a: Bins, b: Bins, rng: random.Random, share: float = 0.3) -> Bins:
    """Inject whole well-filled bins of ``b`` into ``a``; best-fit what they displace."""
    order = sorted(range(len(b.items)), key=lambda k: (b.free[k], rng.random()))
    injected = order[:max(1, int(len(order) * share * rng.uniform(0.5, 1.5)))]
    taken = set()
    for k in injected:
        taken.update(b.items[k])
    child = Bins(a.sizes, a.capacity)
    displaced: list[int] = []
    for k in injected:
        child.add(list(b.items[k]), b.free[k])
    for items, free in zip(a.items, a.free):
        if taken.isdisjoint(items):
            child.add(list(items), free)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: (-a.sizes[i], i))
    for i in displaced:
        child.put(i)
    return child


def reopened(bins: Bins, rng: random.Random, share: float = 0.1) -> Bins:
    """Mutation: empty the least filled bins and some random ones, and best-fit their pieces."""
    worst = sorted(range(len(bins.items)), key=lambda k: -bins.free[k])[:max(1, int(len(bins.items) * share))]
    gone = {*worst, *(rng.randrange(len(bins.items)) for _ in worst)}
    out = Bins(bins.sizes, bins.capacity)
    loose: list[int] = []
    for k, (items, free) in enumerate(zip(bins.items, bins.free)):
        if k in gone:
            loose += items
        else:
            out.add(list(items), free)
    loose.sort(key=lambda i: (-bins.sizes[i] * rng.uniform(0.9, 1.0), i))
    for i in loose:
        out.put(i)
    return out


def evolve(sizes: list[int], genomes: list[list[int]], capacity: int, seed: int,
           population: int = POPULATION, offspring: int = OFFSPRING) -> list[list[int]]:
    """Genomes (bin of every item) after some generations, best first."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bound = -(-sum(sizes) // capacity)
    pool = [_bins_of(g, sizes, capacity) for g in genomes]
    if not pool:
        pool.append(best_fit(sizes, order, capacity))
    if worth(min(pool, key=worth))[0] > bound:
        while len(pool) < population:
            shaken = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
            pool.append(best_fit(sizes, shaken, capacity))
        for _ in range(offspring):
            pool.sort(key=worth)
            if len(pool[0].items) <= bound:
                break
            a, b = rng.sample(pool[:population], 2)
            pool = pool[:population] + [reopened(crossover(a, b, rng), rng)]
    pool.sort(key=worth)
    return [_genome(p, len(sizes)) for p in pool[:population]]


def _bins_of(genome: list[int], sizes: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(genome):
        groups.setdefault(b, []).append(i)
    bins = Bins(sizes, capacity)
    for _, items in sorted(groups.items()):
        bins.add(items, capacity - sum(sizes[i] for i in items))
    return bins


def _genome(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins.items):
        for i in items:
            out[i] = b
    return out


# ---------------------------------------------------------------- islands

_ISLAND = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("keys", pa.list_(pa.int64())),
                     ("sizes", pa.list_(pa.int64())), ("genomes", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32())])
_ISLAND_DDL = "cell long, island int, keys array<long>, sizes array<long>, genomes array<array<int>>, bins int"


def _epoch(number: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                seed = (r["cell"] * 1009 + r["island"]) * 1009 + number
                genomes = evolve(r["sizes"], r["genomes"] or [], capacity, seed)
                row = [[r["cell"]], [r["island"]], [r["keys"]], [r["sizes"]], [genomes],
                       [max(genomes[0], default=-1) + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _ISLAND)], schema=_ISLAND)
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """key, sequence_id, offset of every row of ``items`` (key unique and not null, length up to ``capacity``)."""
    full = items.where(F.col("length") >= capacity).select(
        "key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = items.where(F.col("length") < capacity)
    cells = max(1, -(-loose.count() // cell))
    groups = (loose.groupBy(F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell"))
              .agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("of")))
    state = groups.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                          F.col("of.key").alias("keys"), F.col("of.length").alias("sizes"),
                          F.lit(None).cast("array<array<int>>").alias("genomes"), F.lit(0).alias("bins"))
    for number in range(epochs):
        spread = state.repartition("cell", "island")
        state = written(spread.mapInArrow(_epoch(number, capacity), _ISLAND_DDL), "islands")
        if number < epochs - 1:
            elite = state.select("cell", ((F.col("island") + 1) % islands).cast("int").alias("island"),
                                 F.col("genomes")[0].alias("elite"))
            state = state.join(elite, ["cell", "island"]).withColumn(
                "genomes", F.concat(F.array("elite"), "genomes")).select(*_ISLAND.names)
    best = state.groupBy("cell").agg(F.min_by(F.struct("keys", "sizes", F.col("genomes")[0].alias("genome")),
                                              F.struct("bins", "island")).alias("b"))
    spec = pa.schema([("key", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                bins, sizes = np.array(r["b"]["genome"], np.int64), np.array(r["b"]["sizes"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                starts = ends - sizes[order]
                first = np.searchsorted(bins[order], bins[order], side="left")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(r["b"]["keys"], np.int64)[order]),
                    pa.array((r["cell"] << 24) + bins[order]), pa.array(starts - starts[first])], schema=spec)

    return best.mapInArrow(places, "key long, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    cut = pieces(docs, tokenizer, spaced, capacity)
    placed = pack(cut.select("key", "length"), capacity)
    return cut.join(placed, "key").drop("key")
