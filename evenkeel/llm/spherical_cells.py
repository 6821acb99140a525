"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

Equal vectors of a label are collapsed first. Spherical k-means, fitted on
a bounded hash sample, assigns every vector to the cell of its nearest
centre (its home). A vector is also a guest in each cell whose boundary is
so near that a vector linked with it could live there: if ``y`` lives with
centre ``c`` and ``x`` with ``h``, then ``x.(h - c) <= |x - y| |h - c|``, and
linked unit vectors are at most ``sqrt(2 - 2 cos)`` apart. So every link of
a vector is found in its home cell, and none is lost between cells.

Neighbouring cells form blocks of at most 8 MB of a label (a fuller block is
dealt over several). A task holds the vectors at home in one block and streams
past it the guests of its cells; of two blocks one streams past the other, so a
pair is met once, and a vector is sent once for each block it visits, however
many of its cells that has. Products are taken cell by cell, and a streamed vector
skips cells whose own vectors are all too far from it. A task returns link
counts and a spanning forest of the links; components of the forests give one
representative per group. Rows find their vector by a digest of 128 bits, so that
vectors move twice: when equal ones are collapsed, and to the tasks.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null label, link with nothing and
are kept; vectors of different lengths link with nothing; repeated rows
are equal vectors; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.components import components, spanning_forest
from evenkeel.session import written

COSINE = 0.98
#: Vectors that the centres are fitted on, at most about so many (chosen by a hash).
SAMPLE = 20_000
#: Vectors of the largest label per centre, and the most centres (bounds what a task is sent).
PER_CENTRE = 2000
MAX_CENTRES = 4096
ITERATIONS = 8
#: Bytes of vectors at home in a block, and vectors multiplied at once.
BLOCK_BYTES = 8 << 20
TILE = 2048
#: Doubles keep cosines to far less than this.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors ``x``; an emptied centre moves to the worst served vector."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(iterations):
        sims = x @ centres.T
        home = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(length < 1e-12)
        if len(empty):
            worst = np.argsort(sims.max(axis=1), kind="stable")[:len(empty)]
            sums[empty], length[empty] = x[worst], 1.0
        centres = sums / length[:, None]
    return centres


_PLACED_DDL = "rep long, label long, dim int, copies long, vector array<float>, cell int, to int, home boolean"
_PLACED = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("copies", pa.int64()),
                     ("vector", pa.list_(pa.float32())), ("cell", pa.int32()), ("to", pa.int32()), ("home", pa.bool_())])


def goes(own, other):
    """Of two blocks or parts exactly one streams past the other: does ``own``?"""
    return ((own + other) % 2 == 0) == (other < own)


def gaps(centres: np.ndarray, home: np.ndarray, cells=slice(None)) -> np.ndarray:
    """Distance of each home centre to the centres ``cells``."""
    c, h = centres[cells], centres[home]
    return np.sqrt(np.maximum(0, (h * h).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * h @ c.T))


def _assign(centres: dict[int, np.ndarray], reach: float, block: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the block where a vector is at home, and one for each block that it visits."""
        for batch in batches:
            dims, rows = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "rows"))
            for d, n in np.unique(np.stack([dims, rows]), axis=1).T.tolist():
                part = batch.filter(pa.array((dims == d) & (rows == n)))
                x = unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                c = centres[d]
                k = len(c)
                b = min(k, -(-n // (block or block_rows(d))))
                block_of = np.arange(k) * b // k
                first = np.searchsorted(block_of, np.arange(b))
                for at in range(0, len(x), 1024):
                    sims = x[at:at + 1024] @ c.T
                    home = sims.argmax(axis=1)
                    own = block_of[home]
                    visits = np.zeros((len(home), b), bool)
                    if b > 1:
                        margin = sims[np.arange(len(home)), home][:, None] - sims
                        near = margin <= reach * gaps(c, home) + SLACK
                        visits = np.logical_or.reduceat(near, first, axis=1) & goes(own[:, None], np.arange(b)[None])
                    visits[np.arange(len(home)), own] = True
                    row, to = np.nonzero(visits)
                    take = pa.array(row + at)
                    cols = [part.column(n).take(take) for n in ("rep", "label", "dim", "copies", "vector")]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(home[row].astype(np.int32)), pa.array(to.astype(np.int32)),
                         pa.array(to == own[row])], schema=_PLACED)
    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Boolean matrix of the pairs of unit rows with at least this cosine."""
    return left @ right.T >= cosine


class _Side:
    """Vectors of a task with what is found of them, sorted by home cell."""

    def __init__(self, rep: np.ndarray, copies: np.ndarray, cell: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(cell, kind="stable")
        self.rep, self.copies, self.cell, self.x = rep[order], copies[order].astype(np.float64), cell[order], unit(x[order])
        self.links, self.up = np.zeros(len(rep)), {}


class _Task:
    """The vectors at home in a block (or a part of one), and those that are streamed past them."""

    def __init__(self, held: _Side, centres: np.ndarray, reach: float, cosine: float) -> None:
        self.held, self.centres, self.reach, self.cosine = held, centres, reach, cosine
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self.cells, start = np.unique(held.cell, return_index=True)
        self.spans = list(zip(start.tolist(), [*start[1:].tolist(), len(held.cell)]))
        #: Least cosine with its centre that a vector linked with one at home in the cell can have.
        own = np.einsum("ij,ij->i", held.x, centres[held.cell])
        widest = np.arccos(np.clip(np.minimum.reduceat(own, start), -1, 1)) if len(start) else np.empty(0)
        self.least = np.cos(np.minimum(np.pi, widest + np.arccos(np.clip(cosine, -1, 1))))
        for (begin, end), c in zip(self.spans, self.cells.tolist()):
            for at in range(begin, end, TILE):
                for to in range(at, end, TILE):
                    self._meet(held, np.arange(at, min(at + TILE, end)), held, np.arange(to, min(to + TILE, end)),
                               once=at == to)
        self._pass(held, later=True)

    def stream(self, side: _Side) -> None:
        self._pass(side, later=False)

    def _pass(self, side: _Side, later: bool) -> None:
        """Meet the guests of each cell; ``later``: of the held vectors, those at home in later cells."""
        for at in range(0, len(side.rep), TILE):
            x, home = side.x[at:at + TILE], side.cell[at:at + TILE]
            sims = x @ self.centres[self.cells].T
            own = np.einsum("ij,ij->i", x, self.centres[home])
            guest = ((own[:, None] - sims <= self.reach * gaps(self.centres, home, self.cells) + SLACK)
                     & (sims >= self.least[None] - SLACK))
            same = home[:, None] == self.cells[None]
            guest = guest & (home[:, None] > self.cells[None]) if later else guest | same
            for k in np.flatnonzero(guest.any(axis=0)).tolist():
                cols = at + np.flatnonzero(guest[:, k])
                begin, end = self.spans[k]
                for row in range(begin, end, TILE):
                    self._meet(self.held, np.arange(row, min(row + TILE, end)), side, cols)

    def _meet(self, left: _Side, rows: np.ndarray, right: _Side, cols: np.ndarray, once: bool = False) -> None:
        link = linked(left.x[rows], right.x[cols], self.cosine)
        if once:
            link = np.triu(link, 1)
        a, b = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if not len(a):
            return
        link, rows, cols = link[np.ix_(a, b)], rows[a], cols[b]
        left.links[rows] += link @ right.copies[cols]
        right.links[cols] += left.copies[rows] @ link
        names = [*left.rep[rows].tolist(), *right.rep[cols].tolist()]
        both, n = np.zeros((len(names), len(names)), bool), len(rows)
        both[:n, n:], both[n:, :n] = link, link.T
        for i, j in spanning_forest(both):
            u, v = self._root(names[i]), self._root(names[j])
            if u != v:
                self.up[u] = v
                self.edges.append((names[i], names[j]))

    def _root(self, name: int) -> int:
        up = self.up
        while (above := up.get(name, name)) != name:
            up[name] = name = up.get(above, above)
        return name

    def found(self, side: _Side) -> pa.RecordBatch:
        """Links of the vectors of ``side``, and the forest's edges since the last call."""
        some = np.flatnonzero(side.links)
        edges, self.edges = np.array(self.edges, np.int64).reshape(-1, 2), []
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(side.rep[some], edges[:, 0])), pa.concat_arrays([none, pa.array(edges[:, 1])]),
             pa.array(np.append(side.links[some], np.zeros(len(edges))).astype(np.int64))], schema=_FOUND)


def _compare(centres: dict[int, np.ndarray], reach: float, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by task, the held ones first; held are those and what one batch has of the others."""
        at, task, waiting = None, None, []

        def begin() -> None:
            nonlocal task, waiting
            if task is None and waiting:
                task = _Task(_Side(*(np.concatenate(c) for c in zip(*waiting))), centres[at[1]], reach, cosine)
            waiting = []

        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False)
                    for n in ("label", "dim", "to", "part", "streamed", "rep", "copies", "cell")}
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            base = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for n in ("label", "dim", "to", "part", "streamed"):
                new[1:] |= cols[n][1:] != cols[n][:-1]
            starts = np.flatnonzero(new).tolist()
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(int(cols[n][i]) for n in ("label", "dim", "to", "part"))
                if key != at:
                    begin()
                    if task is not None:
                        yield task.found(task.held)
                    at, task = key, None
                rows = (cols["rep"][i:j], cols["copies"][i:j], cols["cell"][i:j], flat[base[i]:base[j]].reshape(j - i, -1))
                if not cols["streamed"][i]:
                    waiting.append(tuple(r.copy() for r in rows))
                    continue
                begin()
                if task is not None:  # else nothing is at home in the block
                    side = _Side(*rows)
                    task.stream(side)
                    yield task.found(side)
        begin()
        if task is not None:
            yield task.found(task.held)
    return run


def block_rows(dim: int) -> int:
    """Vectors of a length at home in a block, at most."""
    return max(1, BLOCK_BYTES // (4 * max(1, dim)))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, per_centre: int = PER_CENTRE,
                    block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    ``block``: vectors at home in a block (default: by ``BLOCK_BYTES``).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<float>").alias("vector"))
    sound = (F.col("label").isNotNull() & F.col("vector").isNotNull()
             & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
             & F.exists("vector", lambda v: v != 0))
    plus = F.transform("vector", lambda v: v + F.lit(0.0).cast("float"))  # -0 is 0
    rows = rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), plus))
    digest = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), F.col("vector")).alias("h2")]
    good = rows.where(F.col("vector").isNotNull())
    reps = written(good.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
                   .select("label", "vector", "copies", "least", *digest, F.size("vector").alias("dim"),
                           F.monotonically_increasing_id().alias("rep")), "vector_reps")

    centres: dict[int, np.ndarray] = {}
    labels = reps.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.groupBy("dim").agg(
        F.sum("n").alias("n"), F.max("n").alias("most")).collect()  # one row per vector length
    for r in sizes:
        wanted = int(min(1.0, SAMPLE / r["n"]) * 1_000_000)
        picked = (reps.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < wanted))
                  .select("vector").collect())
        k = int(min(MAX_CENTRES, max(1, -(-r["most"] // per_centre))))
        x = unit(np.array([p["vector"] for p in picked], np.float32)) if picked else np.eye(1, r["dim"])
        centres[r["dim"]] = spherical_kmeans(x, k)

    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    most = F.lit(block) if block else F.expr(f"greatest(1, {BLOCK_BYTES} div (4 * dim))")
    # Only labels of more than a block have a row here, and below only blocks of more than a part: few, whatever the data.
    large = labels.where(F.col("n") > most).select("label", "dim", F.col("n").alias("rows"))
    placed = (reps.join(F.broadcast(large), ["label", "dim"], "left")
              .select("rep", "label", "dim", "copies", "vector", F.coalesce("rows", F.lit(1).cast("long")).alias("rows"))
              .mapInArrow(_assign(centres, reach, block), _PLACED_DDL))
    full = (placed.where("home").groupBy("label", "dim", "to").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            .select("label", "dim", "to", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    sent = (placed.join(F.broadcast(full), ["label", "dim", "to"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .where(F.expr("own IS NULL OR part = own OR ((own + part) % 2 = 0) = (part < own)"))
            .withColumn("streamed", ~F.expr("part <=> own")))
    key = ["label", "dim", "to", "part"]
    found = written(sent.select(*key, "streamed", "rep", "copies", "cell", "vector")
                    .repartition(*key).sortWithinPartitions(*key, "streamed", "rep")
                    .mapInArrow(_compare(centres, reach, cosine), "a long, b long, links long"), "vector_links")

    links = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    named = (reps.select("rep", "label", "h1", "h2", "copies", "least")
             .join(groups, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
             .select("label", "h1", "h2", "least", F.coalesce("root", "rep").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = written(named, "vector_groups")
    per_group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_vector = named.join(per_group, "root").select("label", "h1", "h2", "n_links", "component_id")
    held = F.col("vector").isNotNull()
    rows = rows.select("vec_id", "label", held.alias("sound"), *[F.when(held, h).alias(n) for h, n in zip(digest, ("h1", "h2"))])
    out = rows.join(per_vector, ["label", "h1", "h2"], "left").withColumn(
        "component_id", F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.expr("vec_id <=> component_id"), F.lit(False)).alias("kept"))
