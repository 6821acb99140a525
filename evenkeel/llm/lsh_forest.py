"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles (fewer words: one shingle of all of
them). Equal word sequences are collapsed to one representative first.
Every tree of the forest labels a text with a sequence of minhash values;
texts that share a label prefix meet in a node of that tree's prefix trie.
All texts are matched by their whole labels first. From what a text has met,
weighed by the chance that a text so similar shares a label (the
Horvitz-Thompson estimate of what it has missed), follows its recall so far.
Texts that stay below the target, or have met nothing, go up the tries: their
prefixes are shortened by one value and meet all texts with that prefix,
those that have stopped too. No prefix is shorter than the longest one at
which a pair at the threshold meets with the target recall in any case.

The members of each node, sorted by signature, are compared with the
node's leaders by estimated similarity, far below the threshold, and only a
spanning forest of likely relations leaves the node: groups of any size
give linear output. Components of these relations are then verified
exactly, every pair of different texts in them, in blocks: a large
component is cut into blocks of texts, and pairs of blocks are tasks that
return counts per text and a spanning forest of the true links. Classes
are the components of those.

Defined results: null, empty and blank texts have no shingles, link with
nothing and are classes of their own; copies link with each other; a class
is named by its least doc_id; rows with null doc_id take part and get their
class's name (null if nothing in it has one); repeated rows are copies; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import fresh, mark, slices, texts_of, with_marks
from evenkeel.llm.components import components, spanning_forest
from evenkeel.session import written

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
RECALL = 0.999
#: Estimated similarity of a met text that counts as a match: the threshold less two deviations of the estimate.
MATCH = 0.72
#: Standard deviation of the estimate at the threshold (96 values), taken off before a text may stop.
ERROR = 0.04
#: Estimated similarity from which a member needs no leader of its own, and from which it is related to one.
#: A text linked (0.8) with a member near a leader (0.85) has similarity 0.65 or more with that leader.
NEAR, RELATED = 0.85, 0.45
BLOCK = 256
#: The columns that name a row of a class.
JUDGED = ("doc_id", "text")

_U = np.uint64


def prefix_length(depth: int = DEPTH, trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The shortest prefix that a text may need: the longest at which a pair at the threshold is found often enough."""
    k = depth
    while k > 1 and 1 - (1 - threshold ** k) ** trees < recall:
        k -= 1
    return k


def _constants(n: int) -> np.ndarray:
    return np.array([int.from_bytes(md5(f"minhash:{i}".encode()).digest()[:8], "big") | 1 for i in range(n)], _U)


_WORD_MULT = _constants(SHINGLE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    width = min(n, SHINGLE)
    m = n - width + 1
    h = np.zeros(m, _U)
    for k in range(width):
        h += ids[k:k + m] * _WORD_MULT[k]
    return np.unique(_mix(h + _U(width)))


_SKETCH = pa.schema([("mark", pa.binary()), ("doc_id", pa.int64()), ("key", pa.binary()), ("nodes", pa.list_(pa.int64())),
                     ("sig", pa.binary())])


def _sketcher(trees: int, depth: int, prefix: int):
    params = _constants(SHINGLE + trees * depth)[SHINGLE:]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, sets = [], []
                for text in texts_of(part.column("text")):
                    words = text.split()
                    keys.append(md5(b" ".join(words)).digest() if words else None)
                    sets.append(shingles(words))
                full = [i for i, s in enumerate(sets) if len(s)]
                nodes, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    flat = np.concatenate([sets[i] for i in full])
                    ends = np.cumsum([len(sets[i]) for i in full])
                    first = np.concatenate(([0], ends[:-1]))
                    values = np.empty((len(full), len(params)), np.uint32)
                    work = np.empty_like(flat)
                    tries = np.empty((len(full), depth - prefix + 1, trees), np.int64)
                    for j, p in enumerate(params):
                        np.multiply(flat, p, out=work)
                        values[:, j] = np.minimum.reduceat(work, first) >> _U(32)
                    for t in range(trees):
                        h = np.full(len(full), t + 1, _U)
                        for d in range(depth):
                            h = _mix(h * _U(0x9E3779B97F4A7C15) + values[:, t * depth + d])
                            if d + 1 >= prefix:
                                tries[:, d + 1 - prefix, t] = h.view(np.int64)
                    for i, v in zip(full, tries.reshape(len(full), -1)):
                        nodes[i] = v
                    low = values.astype("<u2")
                    for k, i in enumerate(full):
                        sigs[i] = low[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("mark"), part.column("doc_id"), pa.array(keys, pa.binary()),
                     pa.array(nodes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=_SKETCH)
    return sketch


# ---------------------------------------------------------------- nodes -> likely relations

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])


class _Sets:
    """Union-find over small integers."""

    def __init__(self):
        self.up: list[int] = []

    def new(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _related(ids: np.ndarray, sigs: np.ndarray, leaders: dict) -> list[tuple[int, int, float]]:
    """Forest edges, with estimated similarity, of one node's (further) members; ``leaders`` carries its state between calls."""
    edges = []
    for rep, sig in zip(ids.tolist(), sigs):
        n = leaders["n"]
        alike = (leaders["sigs"][:n] == sig).mean(axis=1) if n else np.zeros(0)
        near = np.flatnonzero(alike >= RELATED)
        sets: _Sets = leaders["sets"]
        root = None
        for k in near.tolist():
            r = sets.find(k)
            if root is None:
                root = r
                edges.append((rep, leaders["ids"][k], float(alike[k])))
            elif r != root:
                sets.up[r] = root
                edges.append((rep, leaders["ids"][k], float(alike[k])))
        if not len(near) or alike[near].max() < NEAR:
            k = sets.new()
            if root is not None:
                sets.up[k] = root
            if n == len(leaders["sigs"]):
                leaders["sigs"] = np.concatenate((leaders["sigs"], np.zeros_like(leaders["sigs"])))
            leaders["sigs"][n] = sig
            leaders["ids"].append(rep)
            leaders["n"] = n + 1
    return edges


def _relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream members sorted by node; only the open node's leaders are held."""
    node, leaders = None, None
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        raw = batch.column("sig").to_pylist()
        if not len(raw):
            continue
        sigs = np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)
        cuts = np.concatenate(([0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]))
        edges: list[tuple[int, int, float]] = []
        # Pairs that are whole nodes inside the batch: all at once.
        size = np.diff(cuts)
        pairs = cuts[:-1][(size == 2) & (np.arange(len(size)) > 0) & (np.arange(len(size)) < len(size) - 1)]
        if len(pairs):
            alike = (sigs[pairs] == sigs[pairs + 1]).mean(axis=1)
            hit = pairs[alike >= RELATED]
            edges += zip(ids[hit].tolist(), ids[hit + 1].tolist(), alike[alike >= RELATED].tolist())
        done = set(pairs.tolist())
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if start in done:
                continue
            if node is None or nodes[start] != node:
                node = nodes[start]
                leaders = {"n": 0, "ids": [], "sets": _Sets(), "sigs": np.zeros((8, sigs.shape[1]), sigs.dtype)}
            edges += _related(ids[start:end], sigs[start:end], leaders)
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], f.type) for k, f in enumerate(_EDGE)],
                                         schema=_EDGE)


def _level(texts: DataFrame, stopped: DataFrame | None, at: int, trees: int) -> DataFrame:
    """Likely relations a, b, s (estimated similarity) inside the nodes of one level; written.

    A node counts if a text that has not stopped is in it, and then with all its texts.
    """
    member = texts.select("rep", F.explode(F.slice("nodes", at * trees + 1, trees)).alias("node"))
    if stopped is None:
        shared = member.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    else:
        awake = texts.select("rep").join(stopped, "rep", "left_anti").withColumn("awake", F.lit(1))
        shared = (member.join(awake, "rep", "left").groupBy("node")
                  .agg(F.count(F.lit(1)).alias("n"), F.max("awake").alias("awake")).where("n > 1 AND awake = 1"))
    met = member.join(shared.select("node"), "node").join(texts.select("rep", "sig"), "rep")
    met = met.repartition("node").sortWithinPartitions("node", "sig", "rep")
    return written(met.select("node", "rep", "sig").mapInArrow(_relate, "a long, b long, s double").distinct(), "likely")


def found_share(s: F.Column, depth: int, trees: int) -> F.Column:
    """Chance that two texts of a similarity share a prefix of this length in some tree."""
    return 1 - F.pow(1 - F.pow(s, F.lit(depth)), F.lit(trees))


def reached(relations: DataFrame, depth: int, trees: int, recall: float) -> DataFrame:
    """rep of the texts whose matches at this depth are, by estimate, at least ``recall`` of all they have."""
    ends = relations.where(F.col("s") >= MATCH).select("a", "b", "s").distinct()
    ends = ends.select(F.col("a").alias("rep"), "s").unionByName(ends.select(F.col("b").alias("rep"), "s"))
    return (ends.groupBy("rep").agg((F.count(F.lit(1)) / F.sum(1 / found_share(F.col("s") - ERROR, depth, trees))).alias("share"))
            .where(F.col("share") >= recall).select("rep"))


def likely_relations(texts: DataFrame, depth: int = DEPTH, trees: int = TREES, shortest: int | None = None,
                     recall: float = RECALL) -> DataFrame:
    """a, b of a spanning part of the likely relations of ``texts`` (rep, nodes, sig), by the forest."""
    shortest = prefix_length(depth, trees, recall=recall) if shortest is None else shortest
    relations, stopped = None, None
    for k in range(depth, shortest - 1, -1):
        level = _level(texts, stopped, k - shortest, trees)
        relations = level if relations is None else relations.unionByName(level)
        if k > shortest:
            stopped = written(reached(relations, k, trees, recall), "stopped")
    return written(relations.select("a", "b").distinct(), "relations")


# ---------------------------------------------------------------- exact verification

_SETS = pa.schema([("doc", pa.int64()), ("text_key", pa.binary()), ("set", pa.binary())])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = [t.split() for t in texts_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([md5(b" ".join(w)).digest() if w else None for w in words], pa.binary()),
                 pa.array([shingles(w).tobytes() for w in words], pa.binary())], schema=_SETS)


def overlaps(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections, by blocks of shingles that at least two sets hold."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.zeros((n, n), np.float32)
    if not len(col):
        return out
    col = np.cumsum(np.concatenate(([True], col[1:] != col[:-1]))) - 1
    for base in range(0, int(col[-1]) + 1, columns):
        lo, hi = np.searchsorted(col, [base, base + columns])
        m = np.zeros((n, int(min(columns, col[-1] + 1 - base))), np.float32)
        m[owner[lo:hi], col[lo:hi] - base] = 1
        out += m @ m.T
    return out


def verify(reps: list[int], blocks: list[int], copies: list[int], sets: list[np.ndarray], first: int, second: int,
           threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links (weighted by copies) per text and a spanning forest of them, for one pair of blocks."""
    size = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        common = overlaps(sets).astype(np.float64)
    link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(link, False)
    if first != second:
        side = np.array(blocks)
        link &= side[:, None] != side[None, :]
    weight = np.array(copies, np.int64)
    counts = link @ weight
    forest = [(reps[x], reps[y]) for x, y in spanning_forest(link)]
    return {reps[i]: int(c) for i, c in enumerate(counts) if c}, forest


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stream texts sorted by task (component, pair of blocks); one task is held at a time."""
        at, held = None, {}
        found: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                rows = list(held.values())
                counts, forest = verify([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows],
                                        [r[3] for r in rows], at[1], at[2], threshold)
                found.extend((a, None, n) for a, n in counts.items())
                found.extend((a, b, 0) for a, b in forest)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "first", "second", "rep", "block", "copies", "set")]
            for root, first, second, rep, block, copies, data in zip(*cols):
                if (root, first, second) != at:
                    close()
                    at, held = (root, first, second), {}
                held[rep] = (rep, block, copies, np.frombuffer(data, _U))
            yield _found(found)
            found.clear()
        close()
        yield _found(found)
    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)],
                                      schema=_FOUND)


# ---------------------------------------------------------------- the join

def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, kept of every row of ``docs`` (doc_id, text).

    ``n_links``: other rows with similarity at or above the threshold; ``class_id``: the least doc_id
    reachable by links; ``kept``: true for one row of each class.
    """
    return _judge(docs, **options).drop("mark", "blank")


def _judge(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
           depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Verdicts of ``join`` with the row's mark and whether it is blank (has no words)."""
    rows = docs.select(mark(*JUDGED).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    prefix = prefix_length(depth, trees, threshold, recall)
    sketch = rows.mapInArrow(_sketcher(trees, depth, prefix),
                             "mark binary, doc_id long, key binary, nodes array<long>, sig binary")
    sketch = written(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")

    first = F.struct("row", "doc_id")
    reps = written(sketch.where(F.col("key").isNotNull()).groupBy("key")
                   .agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
                   .select("key", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("doc"), "copies", "least"), "reps")
    texts = written(sketch.join(reps.select("rep"), F.col("row") == F.col("rep")).select("rep", "nodes", "sig"), "texts")
    likely = likely_relations(texts, depth, trees, prefix, recall)

    group = written(components(likely).withColumnRenamed("node", "rep"), "groups")
    sizes = group.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    placed = (group.join(sizes, "root").join(reps, "rep")
              .withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    placed = written(placed.select("root", "rep", "doc", "key", "copies", "blocks", "block"), "placed")
    wanted = placed.select(F.col("doc").alias("_doc")).distinct()
    sets = (rows.drop("mark").join(wanted, F.expr("doc_id <=> _doc"), "left_semi").withColumnRenamed("doc_id", "doc")
            .mapInArrow(_shingle_sets, "doc long, text_key binary, set binary")
            .withColumnRenamed("doc", "set_doc"))
    # Every text goes to the tasks that pair its block with another (or itself).
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = (placed.join(sets, F.expr("key = text_key AND doc <=> set_doc"))
             .select("root", "rep", "copies", "block", "set", other)
             .select("root", "rep", "copies", "block", "set", F.least("block", "other").alias("first"),
                     F.greatest("block", "other").alias("second"))
             .repartition("root", "first", "second").sortWithinPartitions("root", "first", "second", "rep"))
    found = written(tasks.select("root", "first", "second", "rep", "block", "copies", "set")
                    .mapInArrow(_verifier(threshold), "a long, b long, links long"), "found")

    links = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    classes = components(found.where(F.col("b").isNotNull()).select("a", "b").distinct())
    named = (reps.join(classes, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
             .select("key", "rep", "copies", "least", F.coalesce("root", "rep").alias("root"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    named = written(named, "named")
    # The kept row of a class: the first row of its least doc_id.
    per_class = named.groupBy("root").agg(F.min("least").alias("class_id"))
    per_text = named.join(per_class, "root").select("key", "root", "class_id", (F.col("links") + F.col("copies") - 1)
                                                    .alias("n_links"))
    out = sketch.select("row", "mark", "doc_id", "key").join(per_text, "key", "left")
    out = out.withColumn("class_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    stays = (out.where(F.col("key").isNotNull() & F.expr("doc_id <=> class_id")).groupBy("root")
             .agg(F.min("row").alias("stays")).select(F.col("stays").alias("_row")))
    return (out.join(stays, F.col("row") == F.col("_row"), "left")
            .select("mark", F.col("key").isNull().alias("blank"), "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (F.col("key").isNull() | F.col("_row").isNotNull()).alias("kept")))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with the columns of ``docs``; blank rows are classes of their own and stay.

    Verdicts join back on doc_id and text. Rows that share both are copies, of which one stays if
    ``join`` keeps any of them; all others have a verdict of their own.
    """
    verdict = (_judge(docs, **options).groupBy("mark")
               .agg(F.bool_or("kept").alias("kept"), F.first("blank").alias("blank"), F.count(F.lit(1)).alias("n")))
    verdict = written(verdict.where("kept").select("mark", "blank", "n"), "verdict")
    out = with_marks(docs, verdict.where("blank OR n = 1").select("mark"), *JUDGED)
    again = verdict.where("NOT blank AND n > 1").select("mark")
    if not again.limit(1).count():
        return out
    name = fresh(docs, "mark")
    return out.unionByName(with_marks(docs, again, *JUDGED).withColumn(name, mark(*JUDGED))
                           .dropDuplicates([name]).drop(name))
