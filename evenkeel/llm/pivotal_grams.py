"""Spelling variants: words one edit apart, joined by pivotal bigrams.

Bigrams of a word (with their positions) are ordered by how many words hold
them, rarest first. The first three are the word's prefix; dynamic
programming picks the cheapest two of them that don't overlap, its pivots.
One edit spoils at most one of two disjoint bigrams, and moves the others by
at most one place. So of two near words, the one whose prefix reaches
further in the order has the other word's spared pivot in its prefix: it is
enough to look up pivots among prefixes, within one position and one code
point of length, in both directions. Pairs that meet are verified: one edit
leaves the first or the second half as it is, so those that share neither go
at once, by sorting half against half, and the rest is compared exactly.

Words are counted per task before the shuffle, so a frequent word or a hot
source costs nothing extra. A bigram's pivots and prefixes are dealt to
blocks by a hash once they outgrow one, and each pair of blocks is a task's
unit of work: no bigram is held whole, and only near pairs leave a task.

Defined results: a null text has no words; a null doc_id counts as an empty
one in the deletion rule; repeated rows count as often as they occur; an
empty table gives an empty result; columns other than doc_id and the text
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import slices, texts_of
from evenkeel.session import written

#: Words have at least so many code points and occurrences; a form at least so many times a word's n.
LEAST_LENGTH, LEAST_N, FORM_TIMES = 6, 5, 5
#: A run whose hash this divides loses a code point (planted misspellings).
DROP = 199
GRAM, PREFIX, PIVOTS = 2, 3, 2
#: Entries of a bigram and length in one block, and code points in one block.
BLOCK, BLOCK_POINTS = 4096, 4_000_000
#: Words counted in a task before their counts are passed on.
FLUSH = 300_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def _count(drop: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text"))):
                    head = crc32(b"%d:" % doc if doc is not None else b":")
                    for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                        h = crc32(word.encode(), head)
                        if h % drop == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least_length:
                            counts[word] += n
                if len(counts) > FLUSH:
                    yield passed_on()
        yield passed_on()
    return run


def words(docs: DataFrame, text: str = "text", drop: int = DROP, least_length: int = LEAST_LENGTH,
          least_n: int = LEAST_N) -> DataFrame:
    """word, n of every word that is long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return (rows.mapInArrow(_count(drop, least_length), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def pick_pivots(places: list[int], costs: list[int], wanted: int = PIVOTS, width: int = GRAM) -> list[int]:
    """Indices of ``wanted`` places at least ``width`` apart with the least total cost.

    ``places`` ascend. best[k][j]: cheapest choice of j among the first k places; a place is
    either left out or taken after those that end before it.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * wanted]
    for k, place in enumerate(places):
        clear = sum(p + width <= place for p in places[:k])
        row = list(best[-1])
        for j in range(1, wanted + 1):
            before = best[clear][j - 1]
            if before is not None:
                cost = before[0] + costs[k], before[1] + [k]
                if row[j] is None or cost < row[j]:
                    row[j] = cost
        best.append(row)
    return best[-1][wanted][1]


def prefix_and_pivots(word: str, weight: dict[str, int]) -> list[tuple[str, int, bool]]:
    """(bigram, position, pivot?) of the word's three rarest bigrams; ties by bigram, then position."""
    order = sorted((weight[word[i:i + GRAM]], word[i:i + GRAM], i) for i in range(len(word) - GRAM + 1))[:PREFIX]
    order.sort(key=lambda g: g[2])
    chosen = pick_pivots([g[2] for g in order], [g[0] for g in order])
    return [(gram, place, k in chosen) for k, (_, gram, place) in enumerate(order)]


_GRAMS = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("size", pa.int32()),
                    ("gram", pa.string()), ("place", pa.int32()), ("pivot", pa.bool_())])
_GRAMS_DDL = "id long, word string, n long, size int, gram string, place int, pivot boolean"


def _grams(weight: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w, n, len(w), *g) for i, w, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")))
                    for g in prefix_and_pivots(w, weight)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_GRAMS)],
                                             schema=_GRAMS)
    return run


def codes_of(texts: list[str], width: int) -> np.ndarray:
    """Code points of words, one row each, padded with 0."""
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def halves_of(codes: np.ndarray, size: np.ndarray, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's first and last code points: half of ``shorter``, and the rest of it."""
    half = shorter // 2
    rows = np.arange(len(codes))

    def hashed(columns: Iterator[np.ndarray]) -> np.ndarray:
        out = np.full(len(codes), 7, np.uint64)
        for c in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + c
        return out

    return (hashed(codes[:, i].astype(np.uint64) for i in range(half)),
            hashed(codes[rows, size - shorter + i].astype(np.uint64) for i in range(half, shorter)))


def matching(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with left[i] == right[j]."""
    order = np.argsort(right, kind="stable")
    low = np.searchsorted(right[order], left, "left")
    n = np.searchsorted(right[order], left, "right") - low
    i = np.repeat(np.arange(len(left)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def one_edit_apart(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether rows of padded code points differ by exactly one inserted, deleted or replaced one."""
    swap = nx > ny
    short, long = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
    n, gap = np.minimum(nx, ny), np.abs(nx - ny)
    width = x.shape[1]
    at = np.arange(width)
    inside = at < n[:, None]
    head = np.where((short != long) & inside, at, n[:, None]).min(axis=1)
    # Compared from the end: position i of the shorter word with i + gap of the longer.
    shifted = np.where(gap[:, None] == 0, long, np.concatenate([long[:, 1:], np.zeros((len(x), 1), long.dtype)], axis=1))
    last = np.where((short != shifted) & inside, at, -1).max(axis=1)
    tail = n - 1 - last
    same = np.where(gap == 0, (head == last) & (head < n), head + tail >= n)
    return same & (gap <= 1)


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_b", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream blocks sorted by unit (bigram, length, pair of blocks), pivots first; one unit is held at a time."""
    names = ("id", "word", "n", "size", "place", "pivot")
    unit, held = None, []

    def near(parts: list[list]) -> Iterator[pa.RecordBatch]:
        ids, texts, n, size, place, pivot = (sum((p[k] for p in parts), []) for k in range(len(names)))
        pivot = np.array(pivot, bool)
        if pivot.all() or not pivot.any():
            return
        ids, n, size, place = (np.array(v, np.int64) for v in (ids, n, size, place))
        width = int(size.max())
        codes = codes_of(texts, width)
        own = int(size[pivot][0])
        pace = max(1, 4_000_000 // width)
        for other in np.unique(size[~pivot]):
            # One edit leaves the first half of the shorter word or the rest of it as it is.
            heads, tails = halves_of(codes, size, min(own, int(other)))
            for p in np.unique(place[pivot]):
                left = np.flatnonzero(pivot & (place == p))
                right = np.flatnonzero(~pivot & (size == other) & (np.abs(place - p) <= 1))
                for half in (heads, tails):
                    row, col = matching(half[left], half[right])
                    for j in range(0, len(row), pace):
                        x, y = left[row[j:j + pace]], right[col[j:j + pace]]
                        good = one_edit_apart(codes[x], size[x], codes[y], size[y])
                        x, y = x[good], y[good]
                        if len(x):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.concatenate(v)) for v in ((ids[x], ids[y]), (ids[y], ids[x]), (n[y], n[x]))],
                                schema=_NEAR)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("gram", "around", "first", "second"))))
        cols = [batch.column(c).to_pylist() for c in names]
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if keys[at] != unit:
                if held:
                    yield from near(held)
                unit, held = keys[at], []
            held.append([c[at:stop] for c in cols])
            at = stop
    if held:
        yield from near(held)


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b, n_b: each ordered pair of near words once, by id; ``vocabulary`` has id, word, n (ids distinct)."""
    # At most 90 * 90 bigrams: 26 lower-case letters and 64 code points from À to ÿ.
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.col("word").substr(i, F.lit(GRAM)))
    weight = dict(map(tuple, vocabulary.select(F.explode(cut).alias("gram")).groupBy("gram").count().collect()))
    grams = written(vocabulary.select("id", "word", "n").mapInArrow(_grams(weight), _GRAMS_DDL), "bigrams")

    # A unit: pivots of one bigram and length against prefixes of that length, one less or one more.
    pivots = grams.where("pivot").withColumn("around", F.col("size"))
    prefixes = (grams.withColumn("pivot", F.lit(False))
                .withColumn("around", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))))
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_POINTS) / F.col("around"))))
    blocks = (pivots.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n_pivots"))
              .join(prefixes.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n_prefixes")), ["gram", "around"])
              .select("gram", "around", F.ceil(F.col("n_pivots") / room).cast("int").alias("of_pivots"),
                      F.ceil(F.col("n_prefixes") / room).cast("int").alias("of_prefixes")))
    blocks = written(blocks, "bigram_blocks")

    def dealt(side: DataFrame, mine: str, other: str, own: str, opposite: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return (side.join(blocks, ["gram", "around"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
                .withColumn(opposite, every)
                .select("gram", "around", "first", "second", "id", "word", "n", "size", "place", "pivot"))

    units = dealt(pivots, "of_pivots", "of_prefixes", "first", "second").unionByName(
        dealt(prefixes, "of_prefixes", "of_pivots", "second", "first"))
    key = ["gram", "around", "first", "second"]
    found = units.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "a long, b long, n_b long")
    return found.distinct()


def group(docs: DataFrame, text: str = "text", times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    A form is far more frequent than its word, so chains are short (n grows ``times``-fold per
    step); they are followed by pointer jumping, each round a written table.
    """
    # Ids follow the order of the words, so that ties between forms go to the smaller word.
    vocabulary = written(words(docs, text).repartitionByRange("word").sortWithinPartitions("word")
                         .withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = (near_words(vocabulary).groupBy(F.col("a").alias("id"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b"))).alias("top")))
    chosen = F.when(-F.col("top.less") >= times * F.col("n"), F.col("top.b"))
    step = written(vocabulary.join(best, "id", "left")
                   .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           chosen.alias("form_id")), "forms")
    links = written(step.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        on = links.select(F.col("id").alias("via"), F.col("root_id").alias("further"))
        jumped = written(links.join(on, F.col("root_id") == F.col("via"), "left")
                         .select("id", F.coalesce("further", "root_id").alias("root_id"),
                                 F.col("further").isNotNull().alias("moved")), "roots")
        links = jumped.select("id", "root_id")
        if not jumped.where("moved").limit(1).count():
            break
    named = vocabulary.select("id", "word", "n")
    form = named.toDF("form_id", "form", "form_n")
    root = links.join(named.toDF("root_id", "root", "root_n"), "root_id").select("id", "root")
    return (step.join(form, "form_id", "left").join(root, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
