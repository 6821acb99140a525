import random
import re
from collections import Counter, defaultdict

from evenkeel.llm import line_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(wins).items() if n > 1}
    covered = {p for i, w in enumerate(wins) if w in twice for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_statistics_match_brute_force(odd_rows, documents):
    texts = [r[1] for r in odd_rows] + [r["text"] for r in documents.collect()]
    for t in texts:
        assert R.text_stats((t or "").encode()) == brute(t)


def test_every_row_gets_a_verdict(odd_docs, odd_rows):
    got = R.apply_rules(odd_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i in (100, 101, 102, 108):
        assert by[i][0]["base_failed"] and not by[i][0]["kept"]
    assert by[104][0]["kept"] and all(by[i][0]["kept"] for i in range(40))


def test_boilerplate_counts_distinct_documents_not_copies(spark):
    body = "own words of document {0} number {0} with enough of them to stay {0} after all is done {0}"
    notice = "this notice stands in very many documents of one host and says nothing at all here"
    rows = [(i, body.format("abcdef"[i % 6] * (i + 1)) + "\n" + notice, "h") for i in range(30)]
    rows += [(100 + i, "short " + str(i) + "\n" + notice, "h") for i in range(3)]        # depleted
    copy = "a clean text that was copied many times\nit has two lines of plain words in it and no more"
    rows += [(200 + i, copy, "h") for i in range(60)]
    rows += [(300 + i, "short " + str(i) + "\n" + notice, "other") for i in range(2)]    # rare on that host
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in R.apply_rules(df).collect()}
    assert all(kept[i] for i in range(30)) and all(kept[200 + i] for i in range(60))
    assert not any(kept[100 + i] for i in range(3)) and all(kept[300 + i] for i in range(2))


def test_stage_keeps_columns_and_empty_tables(odd_docs, no_docs):
    out = R.kept_documents(odd_docs)
    assert out.columns == odd_docs.columns and {r["doc_id"] for r in out.collect()} >= set(range(40))
    assert R.apply_rules(no_docs).count() == 0 and R.kept_documents(no_docs).count() == 0


def test_kept_documents_lose_their_frequent_lines(spark):
    own = "own words of document {0} number {0} with enough of them to stay {0} after all is done {0}"
    notice, other = "All rights reserved by the host in the year 2021", "ALL rights  reserved by the host in the year 1999"
    rows = [(i, own.format("abcdef"[i % 6] * (i + 1)) + f"\n\n{notice}\n  end é {'ghij'[i % 4] * (i + 1)}", "h", i) for i in range(30)]
    rows += [(100, own.format("upper") + "\n" + other + "\nend", "h", 100), (101, own.format("far") + "\n" + notice, "g", 101),
             (None, own.format("null one") + "\n" + notice, "h", 102), (None, own.format("null two") + "\nend", None, 103)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int").repartition(3)
    out = R.kept_documents(df)
    assert out.schema == df.schema
    want = {place: t if source != "h" else "\n".join(x for x in t.split("\n") if x not in (notice, other))
            for _, t, source, place in rows}
    assert {r["place"]: r["text"] for r in out.collect()} == want
    assert not any("reserved" in t for p, t in want.items() if p != 101) and "reserved" in want[101]


def test_a_dominant_copy_group_hides_no_line(spark):
    rng = random.Random(3)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    notice, own = "subscribe to our letter and never miss a story", words(60)
    rows = [(i, own + "\n" + notice, "h") for i in range(100)] + [(1000 + i, words(60) + "\n" + notice, "h") for i in range(200)]
    lines = [words(12) for _ in range(20)]  # near copies: a group of its own counts about one
    for i in range(300):
        changed = list(lines)
        changed[i % 20] = words(12)
        rows.append((2000 + i, "\n".join(changed), "near"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for copies in (0, 100, 3000):
        more = spark.createDataFrame([(5000 + i, rows[0][1], "h") for i in range(copies)], df.schema)
        assert R.frequent_lines(R.measure(df.unionByName(more))).count() == 1
    out = {r["doc_id"]: r["text"] for r in R.kept_documents(df).collect()}
    assert out == {i: t.removesuffix("\n" + notice) for i, t, _ in rows}


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_query_and_stage_agree_on_a_host_of_depleted_documents(spark):
    rng = random.Random(5)
    line, own = _words(rng, 49), _words(rng, 60)
    rows = [(i, own + "\n" + line, "h") for i in range(1000)]
    rows += [(1000 + i, _words(rng, 3) + "\n" + line, "h") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in R.apply_rules(df).collect()}
    assert all(r["removed_words"] == 49 for r in got.values())
    assert all(got[i]["kept"] for i in range(1000)) and not any(got[1000 + i]["kept"] for i in range(2000))
    left = {r["doc_id"]: r["text"] for r in R.kept_documents(df).collect()}
    assert left == {i: own for i in range(1000)}


def test_copies_never_lower_a_count(spark):
    rng = random.Random(6)
    line = _words(rng, 9)
    rows = [(i, _words(rng, 40) + "\n" + line, "h") for i in range(11)]
    for copies in (0, 1, 50, 2000):
        more = rows + [(100 + i, rows[0][1], "h") for i in range(copies)]
        df = spark.createDataFrame(more, "doc_id long, text string, source string").repartition(3)
        assert R.frequent_lines(R.measure(df)).count() == 1


def test_removed_words_are_those_the_stage_removes(spark, documents):
    rules = {r["doc_id"]: r for r in R.apply_rules(documents).collect()}
    before = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    after = {r["doc_id"]: r["text"] or "" for r in R.kept_documents(documents).collect()}
    assert set(after) == {i for i, r in rules.items() if r["kept"]}
    for i, text in after.items():
        assert len(before[i].encode().split()) - len(text.encode().split()) == rules[i]["removed_words"]
