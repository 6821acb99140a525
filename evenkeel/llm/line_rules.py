"""Quality rules: per-text statistics and cross-document line frequency.

Lines are normalised (words joined by one space, ASCII letters lowered,
digits as 0), hashed with their host and counted per host in *distinct
documents*. So that copies of one document don't make its own lines look
like boilerplate, each line of a document carries four signatures of the
*rest* of it (least hashes over its five-word windows outside the line):
documents whose rests agree in all of them are one, and a document weighs one
over the documents with the line that share a signature. Documents with
different rests count one each, however little of them is left beside the
line; any number of copies counts
once, near copies of one text count about one together, and copies of one
text take nothing from the count of the others. Lines above the limit are
removed; a document that keeps too few of its words is depleted and rejected, and
``kept_documents`` returns the others without these lines.

Defined results: null and empty texts have no words (all counts 0, base
rule failed, not kept); null hosts form a host of their own; repeated rows
and repeated doc_ids are judged row by row; an empty table gives an empty
result; extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import ASCII_SPACE, fresh, mark, slices, texts_of
from evenkeel.session import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Content-defined sample for the signatures: windows whose byte length is a multiple of this.
SAMPLE = 16
#: Independent signatures of a rest: documents are copies where they share any of them.
SIGNATURES = 4

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate of its host above this number of distinct documents.
LINE_LIMIT = 10.0
#: A document is depleted when fewer words, or a smaller share of them, remain.
LEFT_WORDS = 10
LEFT_SHARE = 0.2
#: The columns that the verdict of a row is made of.
JUDGED = ("doc_id", "source", "text")

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def _first8(data: bytes) -> int:
    return int.from_bytes(md5(data).digest()[:8], "big", signed=False)


def repeat_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice, first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += (ids[k:k + n] ^ (ids[k:k + n] >> np.uint64(29))) * _MULT[k]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hits = np.flatnonzero(np.isin(h, twice))
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def _hashes(digests: list[bytes]) -> np.ndarray:
    """One row per digest: its eight bytes at 0, 4, 8 and 12 (cyclic), as unsigned numbers."""
    twice = np.frombuffer(b"".join(d + d for d in digests), np.uint8).reshape(len(digests), 32)
    return np.stack([np.ascontiguousarray(twice[:, 4 * k:4 * k + 8]).view(">u8")[:, 0].astype(np.uint64)
                     for k in range(SIGNATURES)], axis=1)


def rest_signatures(words: list[bytes], owner: np.ndarray, normal: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Signatures of a text without one of its lines: those that most lines have, and other lines' own.

    ``owner`` is the line of each word, ``normal`` the normalised lines. A signature is the least
    hash over the sampled windows that don't touch the line; over all other lines where no window is left.
    """
    at = np.zeros(0, np.int64)
    n = len(words) - WINDOW + 1
    if n > 0:
        total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        at = np.flatnonzero((total[WINDOW:] - total[:n] + (WINDOW - 1)) % SAMPLE == 0)
    if not len(at):
        return np.zeros(SIGNATURES, np.uint64), _without(normal, range(len(normal)))
    hashes = _hashes([md5(b" ".join(words[i:i + WINDOW])).digest() for i in at])
    touched = owner[at[:, None] + np.arange(WINDOW)]
    least = hashes.argmin(axis=0)
    own, bare = {}, []
    for line in np.unique(touched[least]).tolist():
        free = ~(touched == line).any(axis=1)
        if free.any():
            own[line] = hashes[free].min(axis=0)
        else:
            bare.append(line)
    return hashes.min(axis=0), own | _without(normal, bare)


def _without(normal: list[bytes], lines) -> dict[int, np.ndarray]:
    """Least hashes of all other lines, for each of ``lines``."""
    lines = list(lines)
    if not lines:
        return {}
    if len(normal) == 1:
        return {lines[0]: _hashes([md5(b"").digest()])[0]}
    hashes = _hashes([md5(x).digest() for x in normal])
    order = np.argpartition(hashes, 1, axis=0)[:2]
    columns = np.arange(SIGNATURES)
    first, second = hashes[order[0], columns], hashes[order[1], columns]
    return {i: np.where(order[0] == i, second, first) for i in lines}


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = text.split()
    bare = text.translate(None, ASCII_SPACE)
    chars = len(bare.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tag(host: bytes | None) -> bytes:
    return b"\x01\x00" if host is None else b"\x02" + host + b"\x00"


def _normal(words: list[bytes]) -> bytes:
    return b" ".join(words).translate(_FOLD)


def _line_hash(tag: bytes, words: list[bytes]) -> int:
    return _signed(_first8(tag + _normal(words)))


def distinct_lines(text: bytes, host: bytes | None) -> tuple[list[int], list[int], list[int], list[int], list[dict]]:
    """(hashes, words, counts) of the distinct (host, normalised line) with a word; the signatures of the
    text without a line, as most lines have them; and the lines with others, with theirs."""
    tag = _tag(host)
    lines: dict[int, list] = {}
    words, owner, sizes = [], [], []
    for line in text.split(b"\n"):
        part = line.split()
        if part:
            key = _line_hash(tag, part)
            held = lines.setdefault(key, [len(part), 0, len(lines), part])
            held[1] += 1
            words += part
            owner.append(held[2])
            sizes.append(len(part))
    if not words:
        return [], [], [], [], []
    rows = list(lines.values())
    sigs, own = rest_signatures(words, np.repeat(owner, sizes), [_normal(r[3]) for r in rows])
    keys = list(lines)
    odd = [{"line": keys[i], "sigs": v.view(np.int64).tolist()} for i, v in own.items()]
    return keys, [r[0] for r in rows], [r[1] for r in rows], sigs.view(np.int64).tolist(), odd


def without_lines(text: bytes, host: bytes | None, gone: list[int]) -> bytes:
    """The text without the lines whose hashes are in ``gone``; all other lines as they are."""
    tag, hashes = _tag(host), set(gone)

    def stays(line: bytes) -> bool:
        words = line.split()
        return not words or _line_hash(tag, words) not in hashes
    return b"\n".join(filter(stays, text.split(b"\n")))


_STATS = pa.schema([
    ("mark", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32())), ("line_counts", pa.list_(pa.int32())),
    ("sigs", pa.list_(pa.int64())), ("odd", pa.list_(pa.struct([("line", pa.int64()), ("sigs", pa.list_(pa.int64()))])))])
_DDL = ("mark binary, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "lines array<long>, line_words array<int>, line_counts array<int>, sigs array<long>, "
        "odd array<struct<line: long, sigs: array<long>>>")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            cols: list[list] = [[] for _ in _STATS]
            hosts = part.column("source").cast(pa.large_binary()).to_pylist()
            marks, docs = part.column("mark").to_pylist(), part.column("doc_id").to_pylist()
            for name, doc, host, text in zip(marks, docs, hosts, texts_of(part.column("text"))):
                stats = text_stats(text)
                row = (name, doc, *stats, *distinct_lines(text, host))
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STATS)], schema=_STATS)


def measure(docs: DataFrame) -> DataFrame:
    """Statistics and line hashes of every text; one written row per input row, ``row`` names it."""
    rows = docs.select(mark(*JUDGED).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_measure, _DDL)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "lines")


def frequent_lines(measured: DataFrame, limit: float = LINE_LIMIT) -> DataFrame:
    """Hashes of (host, line) held by more than ``limit`` documents, copies and near copies collapsed.

    Documents whose rests agree in all signatures are one unit. A unit weighs one over the units with
    the line that share a signature with it, by the signature that most of them share: any number of
    copies adds nothing, a group of near copies about one, and unrelated documents one each. No links
    are chained, so documents that have a passage in common do not all become one.
    """
    # No line of so few documents can pass; the others are few. Written before the join, so that the planner knows their size.
    often = (measured.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > F.lit(float(limit))).select("line"))
    often = written(often, "often")
    plain = measured.select("sigs", F.explode(F.array_except("lines", "odd.line")).alias("line")).select("line", "sigs")
    odd = measured.select(F.explode("odd").alias("o")).select("o.line", "o.sigs")
    units = written(plain.unionByName(odd).join(often, "line").select("line", "sigs").distinct(), "units")
    shared = units.select("line", "sigs", F.posexplode("sigs").alias("k", "v"))
    sizes = written(shared.groupBy("line", "k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    alike = shared.join(sizes, ["line", "k", "v"], "left")
    weight = alike.groupBy("line", "sigs").agg(F.max(F.coalesce("n", F.lit(1))).alias("n"))
    return (weight.groupBy("line").agg(F.round(F.sum(1 / F.col("n")), 6).alias("w"))
            .where(F.col("w") > F.lit(float(limit))).select("line"))


def _judge(docs: DataFrame, limit: float = LINE_LIMIT, left_words: int = LEFT_WORDS,
           left_share: float = LEFT_SHARE) -> DataFrame:
    """Verdicts of ``apply_rules`` with the row's mark and ``gone``, the hashes of its frequent lines (null: none)."""
    measured = measure(docs)
    # Written, so that the planner knows the size of the frequent lines before it picks the join.
    frequent = written(frequent_lines(measured, limit), "frequent")
    pieces = F.arrays_zip("lines", "line_words", "line_counts")
    removed = (measured.select("row", F.explode(pieces).alias("p"))
               .select("row", F.col("p.lines").alias("line"),
                       (F.col("p.line_words") * F.col("p.line_counts")).alias("w"))
               .join(frequent, "line")
               .groupBy("row").agg(F.sum("w").alias("removed_words"), F.collect_list("line").alias("gone")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < left_words) | (left < F.lit(left_share) * F.col("n_words")))
    return (measured.drop("lines", "line_words", "line_counts", "sigs", "odd")
            .join(removed, "row", "left").drop("row")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & ~depleted))


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, statistics, base_failed, removed_words, kept for every row of ``docs``.

    ``docs`` needs doc_id, source (the host) and text. Lines are counted as in ``ORACLE``.
    """
    return _judge(docs, **limits).drop("mark", "gone")


def _cleaner(gone: str, mark_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("text")
                lines = part.column(gone).to_pylist()
                if any(lines):
                    hosts = part.column("source").cast(pa.large_binary()).to_pylist()
                    left = [without_lines(t, h, g) if g else t
                            for t, h, g in zip(texts_of(part.column(at)), hosts, lines)]
                    kind = part.schema.field(at).type
                    part = part.set_column(at, part.schema.field(at),
                                           pa.array(left, pa.large_binary()).cast(kind, safe=False))
                yield part.drop_columns([gone, mark_name])
    return run


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, their text without its frequent lines; other columns as given.

    A verdict follows from the row's doc_id, source and text (and the table), so rows that are equal in
    these share it, and all others have their own.
    """
    verdict = _judge(docs, **limits).where("kept").select("mark", "gone").dropDuplicates(["mark"])
    name = fresh(docs, "mark")
    gone = fresh(docs.withColumn(name, F.lit(1)), "gone")
    rows = docs.withColumn(name, mark(*JUDGED)).join(written(verdict, "verdict").toDF(name, gone), name)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), name, gone).mapInArrow(
        _cleaner(gone, name), docs.schema)


#: DuckDB form of the whole operator over ``documents``.
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
wins AS (
  SELECT rid, len(w) AS n, i, w[i:i+4] AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT rid, win FROM wins GROUP BY rid, win HAVING count(*) > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT wins.rid, unnest(range(i, i + 5)) AS p FROM wins JOIN twice USING (rid, win)) GROUP BY rid),
lines AS (
  SELECT rid, source, ln, k, regexp_extract_all(ln, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS k
        FROM docs)),
norm AS (
  SELECT rid, source, len(w) AS nw, sum(len(w)) OVER (PARTITION BY rid ORDER BY k) - len(w) AS start,
         translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
                   'abcdefghijklmnopqrstuvwxyz000000000') AS line
  FROM lines WHERE len(w) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT ln) AS n_dup_lines FROM lines WHERE len(w) > 0 GROUP BY rid),
often AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT rid) > {LINE_LIMIT}),
held AS (
  SELECT DISTINCT n.rid, n.source, n.line FROM norm n
  JOIN often o ON n.line = o.line AND n.source IS NOT DISTINCT FROM o.source),
sampled AS (SELECT rid, i, md5(array_to_string(win, ' ')) AS h FROM wins WHERE strlen(array_to_string(win, ' ')) % {SAMPLE} = 0),
place AS (SELECT rid, line, unnest(range((start + 1)::BIGINT, (start + nw + 1)::BIGINT)) AS p FROM norm),
touched AS (
  SELECT DISTINCT s.rid, s.i, place.line
  FROM (SELECT rid, i, unnest(range(i, i + 5)) AS p FROM sampled) s JOIN place USING (rid, p)),
free AS (
  SELECT rid, held.source, held.line, h FROM held JOIN sampled USING (rid)
  ANTI JOIN touched t ON t.rid = held.rid AND t.i = sampled.i AND t.line = held.line),
rest AS (
  SELECT rid, source, line, h FROM free
  UNION ALL
  SELECT b.rid, b.source, b.line, md5(coalesce(n.line, ''))
  FROM (SELECT * FROM held ANTI JOIN free ON free.rid = held.rid AND free.line = held.line) b
  LEFT JOIN norm n ON n.rid = b.rid AND n.line <> b.line),
units AS (
  SELECT DISTINCT source, line, s0, s1, s2, s3 FROM (
    SELECT rid, source, line, {', '.join(f"min(substr(h || h, {8 * k + 1}, 16)) AS s{k}" for k in range(SIGNATURES))}
    FROM rest GROUP BY rid, source, line)),
weights AS (
  SELECT source, line, 1.0::DOUBLE / greatest({', '.join(
      f"count(*) OVER (PARTITION BY source, line, s{k})" for k in range(SIGNATURES))}) AS w FROM units),
frequent AS (
  SELECT source, line FROM weights GROUP BY source, line HAVING round(sum(w), 6) > {LINE_LIMIT}),
removed AS (
  SELECT rid, sum(nw) AS removed_words FROM norm
  JOIN frequent f ON norm.line = f.line AND norm.source IS NOT DISTINCT FROM f.source GROUP BY rid),
stats AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM docs JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid)
  LEFT JOIN removed USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < {LEFT_WORDS}
                                  OR n_words - removed_words < {LEFT_SHARE} * n_words)) AS kept
FROM stats
"""
