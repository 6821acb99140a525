import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.llm import pivotal_grams
from evenkeel.llm.queries import op13_pivotal_grams

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [] for w in n}
    by = {}
    for w in n:  # two words one edit apart share a word with one code point left out
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(key, []).append(w)
    for a, b in {tuple(sorted(p)) for g in by.values() for p in combinations(g, 2)}:
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    assert len(want) > 100 and any(r[1] for r in want)
    assert rows_of(op13_pivotal_grams(spark, SF)) == want


@pytest.fixture(scope="module")
def crowded():
    """Few letters, so every bigram is frequent and words have many near words; chains of forms."""
    random.seed(5)
    words = ["".join(random.choice("abé") for _ in range(random.randint(5, 9))) for _ in range(500)]
    rows = [(i, " ".join(random.choices(words, k=600)) + "\n" + words[i % 500].upper()) for i in range(40)]
    chain = ["colour", "colours", "coloursx", "coloursxy"]
    rows += [(100 + k, " ".join([w] * (5 * 6 ** (3 - k)))) for k, w in enumerate(chain)]
    rows += [(None, "colour COLOUR Ästhetik ästhetik ÄSTHETIK"), (7, None), (7, ""), (8, "x" * 50_000 + " "),
             (8, ("long" * 900 + " ") * 6 + ("long" * 900 + "s ") * 40)]
    return rows + rows[:3]


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_brute_force_on_crowded_words(spark, crowded, block, monkeypatch):
    monkeypatch.setattr(pivotal_grams.near_words, "__defaults__", (block,))
    docs = spark.createDataFrame(crowded, "doc_id long, text string").repartition(3)
    for name in ("word", "n", "gram", "pivot", "id"):
        docs = docs.withColumn(name, F.lit("x"))
    want = brute(crowded)
    got = rows_of(pivotal_grams.group(docs))
    assert got == want
    assert next(r for r in got if r[0] == "coloursxy")[2] == "colour"


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert rows_of(pivotal_grams.group(odd_docs)) == brute([(r[0], r[1]) for r in odd_rows])
    assert pivotal_grams.group(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=1, max_size=8,
                unique_by=lambda p: p[0]), st.integers(1, 3))
def test_pivots_are_the_cheapest_disjoint_choice(entries, wanted):
    entries.sort()
    places, costs = [p for p, _ in entries], [c for _, c in entries]
    fitting = [c for c in combinations(range(len(entries)), wanted)
               if all(places[y] - places[x] >= 2 for x, y in zip(c, c[1:]))]
    if not fitting:
        return
    got = pivotal_grams.pick_pivots(places, costs, wanted)
    assert tuple(got) in fitting
    assert sum(costs[k] for k in got) == min(sum(costs[k] for k in c) for c in fitting)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=9), st.integers(0, 8), st.sampled_from("abcd"), st.sampled_from("ird"),
       st.randoms())
def test_near_words_meet(word, at, letter, kind, rnd):
    other = {"i": word[:at] + letter + word[at:], "r": word[:at] + letter + word[at + 1:],
             "d": word[:at] + word[at + 1:]}[kind]
    if len(other) < 6 or not one_edit(word, other):
        return
    weight = {x + y: rnd.randint(1, 5) for x in "abcd" for y in "abcd"}
    a, b = (pivotal_grams.prefix_and_pivots(w, weight) for w in (word, other))
    assert any(g == h and abs(p - q) <= 1 for x, y in ((a, b), (b, a))
               for g, p, pivot in x if pivot for h, q, _ in y)
