"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of all words,
stopped at ``cap`` times the words it has, the excess shared again by
weight. Inside a source a document's expected number of copies is
``min(cap, c * rate)``, where the rate is the bit length of its word count
(longer documents are likelier) and ``c`` makes the expectations add up to
the target. The whole part of it is taken for certain; for the fraction
``pi`` documents are ranked by random odds over inclusion odds,
``u/(1-u) * (1-pi)/pi`` with ``u`` a hash of the row (doc_id, source, text, its
number among equal rows) and seed, and taken in
that order up to a sample size fixed in words. A few documents per source
then settle what the last one over- or undershot, where that helps.

The ranking never sorts a whole source in one task: words are summed in
4096 bins of the rank first, and only the bin that the sample ends in is
ordered.

Defined results: null text has size 0; null source is a source of its own,
last in order; rows that share a doc_id, or have none, are drawn one by one;
equal rows are numbered and interchangeable; an empty table or one without words takes nothing; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import fresh, mark, n_words
from evenkeel.operators.numbering import rank_within, sorted_table
from evenkeel.session import written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 11
BINS = 4096
#: Documents per source that may settle what the sample over- or undershot.
SETTLE = 3
#: The columns that name a row; rows equal in them are numbered.
NAMED = ("doc_id", "source", "text")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, size).

    Sources sorted by how soon they reach their cap: those before the first
    one that stays below it are capped, the rest share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rank", F.row_number().over(order)).withColumn(
        "share", (F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .cast("double") / F.sum("w").over(after))
    free = F.col("share") * F.col("w") <= cap * F.col("source_size")
    per = (per.withColumn("first", F.min(F.when(free, F.col("rank"))).over(whole))
           .withColumn("level", F.max(F.when(F.col("rank") == F.col("first"), F.col("share"))).over(whole)))
    capped = F.col("first").isNull() | (F.col("rank") < F.col("first"))
    return per.select("source", "source_size", F.when(capped, (cap * F.col("source_size")).cast("double"))
                      .otherwise(F.col("level") * F.col("w")).alias("target"))


def copy_levels(sizes: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """source, rate, copies: expected copies of each (source, rate) class, adding up to the targets."""
    per = (sizes.groupBy("source", "rate").agg(F.sum("size").alias("s"))
           .join(goal, F.expr("source <=> _source"), "left").drop("_source"))
    by = Window.partitionBy("source").orderBy(F.col("rate").desc())
    above = by.rowsBetween(Window.unboundedPreceding, -1)
    below = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    left = F.col("target") - cap * F.coalesce(F.sum("s").over(above), F.lit(0))
    c = left / F.nullif(F.sum(F.col("s") * F.col("rate")).over(below).cast("double"), F.lit(0.0))
    per = per.withColumn("c", c).withColumn(
        "top", F.max(F.when(F.col("c") * F.col("rate") <= cap, F.col("rate"))).over(whole))
    per = per.withColumn("c", F.max(F.when(F.col("rate") == F.col("top"), F.col("c"))).over(whole))
    copies = F.least(F.lit(float(cap)), F.coalesce("c", F.lit(float(cap))) * F.col("rate"))
    return per.select("source", "rate", F.greatest(copies, F.lit(0.0)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs`` (doc_id, source, text)."""
    return _drawn(docs, F.monotonically_increasing_id(), weights, cap, seed).drop("place")


def _drawn(docs: DataFrame, place: F.Column, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
           seed: int = SEED) -> DataFrame:
    """``mix`` with ``place``, which names the row in ``docs``."""
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size"), mark(*NAMED).alias("mark"), place.alias("place")), "mix_rows")
    # Equal rows get numbers without meeting in one task: they are sorted by place and cut anywhere.
    rows = rank_within(sorted_table(rows, ["mark"], ["place"], "mix_order"), ["mark"], "copy")
    digest = F.md5(F.concat(F.lower(F.hex("mark")), F.lit(":"), F.col("copy").cast("string"), F.lit(f":{seed}")).cast("binary"))
    rows = written(rows.select("doc_id", "source", "size", "place", "row", F.length(F.bin("size")).cast("long").alias("rate"),
                               ((F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)).alias("u")),
                   "mix")
    per_class = written(rows.groupBy("source", "rate").agg(F.sum("size").alias("size")), "classes")
    goal = written(targets(per_class, weights, cap), "targets")
    keyed_goal = goal.select(F.col("source").alias("_source"), "target")
    levels = written(copy_levels(per_class, keyed_goal, cap), "levels")

    pi = F.col("copies") - F.floor("copies")
    key = F.when(pi > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - pi) / pi))
    # One row per (source, bit length): sized by the planner from the written file.
    ranked = (rows.join(levels.select(F.col("source").alias("_s"), F.col("rate").alias("_r"), "copies"),
                        F.expr("source <=> _s AND rate = _r")).drop("_s", "_r")
              .withColumn("whole", F.floor("copies").cast("long")).withColumn("key", key)
              .withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * BINS)))
    sums = (ranked.groupBy("source", "bin")
            .agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("whole")).alias("sure")))
    per_source = Window.partitionBy("source")
    upto = per_source.orderBy("bin")
    quota = F.col("target") - F.sum("sure").over(per_source)
    bins = (sums.join(keyed_goal, F.expr("source <=> _source")).drop("_source")
            .withColumn("quota", quota).where(F.col("bin").isNotNull())
            .withColumn("end", F.sum("s").over(upto)).withColumn("start", F.col("end") - F.col("s")))
    bins = written(bins.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "quota", "start", "end"), "bins")

    placed = ranked.join(bins, F.expr("source <=> _s AND bin = _b"), "left").drop("_s", "_b")
    inside = placed.where((F.col("start") <= F.col("quota")) & (F.col("quota") < F.col("end")))
    order = per_source.orderBy("key", "doc_id", "size", "row")
    ends = inside.withColumn("upto", F.col("start") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.where(F.col("upto") - F.col("size") / 2 <= F.col("quota")).select(F.col("row").alias("_row"))
    drawn = placed.join(ends, F.col("row") == F.col("_row"), "left").withColumn(
        "extra", (F.coalesce(F.col("end") <= F.col("quota"), F.lit(False)) | F.col("_row").isNotNull()).cast("long"))
    state = written(drawn.select("doc_id", "source", "size", "whole", (F.col("whole") + F.col("extra")).alias("copies"),
                                 "u", "row", "place"), "drawn")
    for _ in range(SETTLE):
        state = written(_settled(state, goal, cap), "settled")
    return (state.join(goal.withColumnRenamed("source", "_s"), F.expr("source <=> _s"))
            .select("place", "doc_id", "source", "size", "source_size", "target",
                    F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def _settled(state: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of the one document per source that best closes the gap to its target."""
    got = (state.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
           .join(goal.select(F.col("source").alias("_source"), "target"), F.expr("source <=> _source"))
           .select(F.col("source").alias("_s"), (F.col("target") - F.col("got")).alias("gap")))
    got = written(got, "gaps")
    miss = F.abs(F.col("size") - F.abs("gap"))
    fits = state.join(got, F.expr("source <=> _s")).where(
        F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > F.col("whole"))
        & (miss < F.abs("gap")))
    best = fits.groupBy("source").agg(F.min(F.struct(
        miss.alias("miss"), "u", "doc_id", "size", "row", F.signum("gap").cast("long").alias("step"))).alias("b"))
    chosen = written(best.select(F.col("b.row").alias("_row"), "b.step"), "chosen")
    return (state.join(chosen, F.col("row") == F.col("_row"), "left").drop("_row")
            .withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step"))


def mixed_documents(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    ``docs`` is written once with a number per row; counts join back on that number. A ``stored``
    Parquet table is not written again: its file and the place there name a row.
    """
    name, place, times = (fresh(docs, n) for n in ("mixed_row", "mixed_place", "mixed_times"))
    if stored:
        rows = docs.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))
    else:
        rows = written(docs.withColumn(name, F.monotonically_increasing_id()), "mix_docs")
    copies = (_drawn(rows, F.col(f"`{name}`"), **options).where("copies > 0")
              .select(F.col("place").alias(place), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(times)))
    joined = rows.join(written(copies, "mix_copies"), F.col(f"`{name}`") == F.col(place))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(times).alias(times)).drop(times)


def oracle(table: str = "documents", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> str:
    """DuckDB form of ``mix`` over a table."""
    settle = "".join(f""",
gaps{i} AS (SELECT source, target - sum(size * copies) AS gap FROM drawn{i} GROUP BY source, target),
fits{i} AS (
  SELECT rid, sign(gap)::BIGINT AS step, row_number() OVER (
      PARTITION BY d.source ORDER BY abs(size - abs(gap)), u, doc_id, size, rid) AS k
  FROM drawn{i} d JOIN gaps{i} g ON d.source IS NOT DISTINCT FROM g.source
  WHERE CASE WHEN gap > 0 THEN copies < {cap} ELSE copies > whole END AND abs(size - abs(gap)) < abs(gap)),
drawn{i + 1} AS (
  SELECT d.* EXCLUDE (copies), copies + coalesce(step, 0) AS copies
  FROM drawn{i} d LEFT JOIN (SELECT rid, step FROM fits{i} WHERE k = 1) f USING (rid))""" for i in range(SETTLE))
    return f"""
WITH rows AS (
  SELECT *, (('0x' || substr(md5(mark || ':' || (row_number() OVER (PARTITION BY mark)) || ':{seed}'), 1, 12))::BIGINT
      + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
          row_number() OVER () AS rid,
          md5({" || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in NAMED)}) AS mark
        FROM {table})),
rated AS (SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END)::BIGINT AS rate FROM rows),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}
    {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(weights))} END AS w
  FROM rated GROUP BY source),
shares AS (
  SELECT *, row_number() OVER o AS rk,
    (sum(source_size) OVER () - {cap} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM per WINDOW o AS (ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST)),
firsts AS (SELECT min(rk) AS f FROM shares WHERE share * w <= {cap} * source_size),
goal AS (
  SELECT source, source_size, CASE WHEN f IS NULL OR rk < f THEN ({cap} * source_size)::DOUBLE
    ELSE (SELECT share FROM shares, firsts WHERE rk = f) * w END AS target FROM shares, firsts),
classes AS (SELECT source, rate, sum(size)::BIGINT AS s FROM rated GROUP BY source, rate),
lv AS (
  SELECT c.source, rate, (target - {cap} * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / nullif((sum(s * rate) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS c
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
  WINDOW o AS (PARTITION BY c.source ORDER BY rate DESC)),
cs AS (SELECT source, arg_max(c, rate) AS c FROM lv WHERE c * rate <= {cap} GROUP BY source),
levels AS (
  SELECT r.*, g.source_size, g.target,
    greatest(least({cap}.0::DOUBLE, coalesce(cs.c, {cap}.0::DOUBLE) * rate), 0.0::DOUBLE) AS copies
  FROM rated r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
  LEFT JOIN cs ON r.source IS NOT DISTINCT FROM cs.source),
keyed AS (
  SELECT *, floor(copies)::BIGINT AS whole,
    CASE WHEN copies - floor(copies) > 0
      THEN (u / (1 - u)) * ((1 - (copies - floor(copies))) / (copies - floor(copies))) END AS key FROM levels),
quota AS (SELECT source, target - sum(size * whole) AS q FROM keyed GROUP BY source, target),
drawn AS (
  SELECT k.*, CASE WHEN key IS NOT NULL AND
      sum(CASE WHEN key IS NOT NULL THEN size END) OVER (PARTITION BY k.source ORDER BY key NULLS LAST, doc_id, size, rid
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE <= q THEN 1 ELSE 0 END AS extra
  FROM keyed k JOIN quota t ON k.source IS NOT DISTINCT FROM t.source),
drawn0 AS (SELECT * EXCLUDE (copies), whole + extra AS copies FROM drawn){settle}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM drawn{SETTLE}
"""
