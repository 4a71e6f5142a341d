"""Operators that compare documents: repeated passages and lines, near duplicates, benchmark leaks; components."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, graph, jaccard, lines, substring

from .conftest import WORDS, prose


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, size=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 900])
def test_passages(rough, rough_docs, chunk_bytes, monkeypatch):
    monkeypatch.setattr(substring, "RANGE_ANCHORS", 400)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(rough_docs, 13, chunk_bytes).collect())
    assert got == without_repeats(rough)


def test_passages_at_every_shift(spark):
    rng = random.Random(8)
    block = [f"w{rng.randrange(10**6)}" for _ in range(13)]
    rows = [(k, " ".join([f"x{k}_{j}" for j in range(k)] + block + [f"y{k}"])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (13, 9):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, size, 700).collect())
        assert got == without_repeats(rows, size)
    with pytest.raises(ValueError):
        substring.remove_repeats(df, 7)


def test_passages_of_nothing(no_docs):
    assert substring.remove_repeats(no_docs).count() == 0


def without_later_lines(rows, least=50):
    """{(id, text): (lines, removed, text left)} by comparing every window with every other."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda x: x[0])
    assert len({i for i, _ in docs}) == len(docs)
    spans = []
    for i, t in docs:
        split = t.split("\n")
        full = [(k, len(words_of(x))) for k, x in enumerate(split) if words_of(x)]
        found = set()
        for s in range(len(full)):
            for direction in (1, -1):
                total, e = 0, s
                while 0 <= e < len(full):
                    total += full[e][1]
                    if total >= least:
                        lo, hi = min(s, e), max(s, e)
                        found.add((full[lo][0], full[hi][0], tuple(split[full[j][0]] for j in range(lo, hi + 1))))
                        break
                    e += direction
        spans += [(i, a, b, content) for a, b, content in found]
    first = {}
    for i, a, b, content in sorted(spans, key=lambda x: x[:3]):
        first.setdefault(content, (i, b))
    gone = defaultdict(set)
    for i, a, b, content in spans:
        fi, fb = first[content]
        if i > fi or a > fb:
            gone[i].update(range(a, b + 1))
    out = Counter()
    for i, t in rows:
        if t is None:
            out[i, 0, 0, None] += 1
            continue
        split = t.split("\n")
        drop = gone.get(i, set()) if i is not None else set()
        out[i, len(split), len(drop), "\n".join(x for k, x in enumerate(split) if k not in drop)] += 1
    return out


def test_lines(rough, rough_docs, no_docs):
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(rough_docs).collect())
    assert got == without_later_lines(rough)
    assert lines.dedup_lines(no_docs).count() == 0
    assert lines.dedup_lines(rough_docs).select("row.*").columns == rough_docs.columns


def test_lines_random(spark):
    rng = random.Random(5)
    pool = [prose(rng, rng.choice([1, 3, 8, 30, 60]), 99) for _ in range(12)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect())
    assert got == without_later_lines(rows)


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(random.Random(k).randrange(80), random.Random(-k - 1).randrange(80)) for k in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == components_of({x for e in real for x in e}, real)


def shingles(text, size):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1))


def near_groups(rows, size=4, num=85, den=100):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    group = components_of(sets, edges)
    return Counter((i, len(shingles(t, size)), group.get(i)) for i, t in rows)


def groups(df, **how):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, **how).collect())


def test_near_duplicates(rough, rough_docs, no_docs):
    assert groups(rough_docs) == near_groups(rough)
    assert jaccard.jaccard_groups(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_random(spark, seed):
    """Chains and clouds of edited copies around the threshold, with a passage that nearly all texts share."""
    rng = random.Random(seed)
    common = prose(rng, 40)
    rows = []
    for family in range(12):
        text = prose(rng, rng.choice([3, 12, 60, 150])).split(" ")
        for _ in range(rng.choice([1, 2, 5, 14])):
            if rng.random() < 0.5:
                text = list(text)
            edited = list(text)
            for _ in range(rng.randrange(4)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS) + str(rng.randrange(99))
            if rng.random() < 0.4:
                text = edited
            rows.append((len(rows), " ".join(edited) + ("\n" + common if family % 2 else "")))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert groups(df) == near_groups(rows)
    assert groups(df, size=5, num=80, den=100) == near_groups(rows, 5, 80, 100)


@pytest.mark.parametrize("block", [jaccard.BLOCK if hasattr(jaccard, "BLOCK") else 0, 50])
def test_near_duplicates_of_a_crowd(spark, block, monkeypatch):
    """Many copies of one text, most of them just beyond the threshold from each other: no table of their pairs is written."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for k in range(300):
        edited = list(base)
        for at in rng.sample(range(160), rng.randrange(1, 9)):
            edited[at] = f"e{k}_{at}"
        rows.append((k, " ".join(edited)))
    rows += [(300 + k, rows[k][1] + f" more{k}") for k in range(0, 300, 30)]
    written = []

    def counted(df, write=jaccard.materialize):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    monkeypatch.setattr(jaccard, "BLOCK", block, raising=False)
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == near_groups(rows)
    placements = sum(n - -(-85 * n // 100) + 1 + n // 32 for n in (len(shingles(t, 4)) for _, t in rows))
    assert max(written) <= placements < len(rows) ** 2 / 6


def test_regions_of_the_same_documents_are_one(spark, monkeypatch):
    """Two near copies share dozens of rare shingles; what is sent on must not grow with these."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:200] + ["other"] + words[201:]))]
    seen = []

    def counted(members, *rest, links=jaccard.links):
        seen.append(members.count())
        return links(members, *rest)

    monkeypatch.setattr(jaccard, "links", counted)
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == near_groups(rows)
    assert seen == [80]


def test_threshold_is_met_exactly(spark):
    # 17 of 20 shingles in common is 0.85, 16 of 19 is below
    base = [f"a{k}" for k in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "z1", "z2", "z3"])), (3, " ".join(f"b{k}" for k in range(19))), (4, " ".join([*(f"b{k}" for k in range(19)), "y1", "y2", "y3"]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


QUESTION = "Maria buys 12 red apples for 3 dollars each and gives 12 of them to her brother Tom, who walks 5 km home before dinner. How much does she pay?"


def found(spark, texts, bench=((7, QUESTION),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_id) for r in decontam.decontaminate(docs, spark.createDataFrame(list(bench), "item_id long, text string")).collect()}


def test_leaks(spark):
    rng = random.Random(4)
    around = lambda q: prose(rng, 40) + "\n" + q + "\n" + prose(rng, 30)
    changed = QUESTION.replace("Tom", "Ben").replace("12", "30").replace("5 km", "9 miles").replace("3", "8").replace("80 red", "30 red").replace("80 of", "30 of")
    torn = QUESTION.replace("gives 12", "gives 11")  # the same value becomes two
    merged = QUESTION.replace("3 dollars", "12 dollars").replace("5 km", "12 km")  # different values become one
    half = " ".join(QUESTION.split()[:11])
    texts = [around(QUESTION), around(changed), around(torn), around(merged), around(half), prose(rng, 200), None, "", QUESTION.upper(), around(QUESTION.replace(" ", "  "))]
    assert found(spark, texts) == {0: (True, 7), 1: (True, 7), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (True, 7), 9: (True, 7)}


def test_leaks_with_names_that_open_sentences(spark):
    asked = "Tom has 5 apples. Tom gives 2 to Ann. How many does Tom have?"
    texts = [f"Some words stand here.\n{asked.replace('Tom', name)}\nAnd here." for name in ("Tom", "Ben")] + ["How Tom has apples. How many? " + asked.replace("Tom", "Ben"), asked.replace("apples", "pears")]
    assert [found(spark, texts, [(3, asked)])[k][0] for k in range(4)] == [True, True, True, False]


def test_leaks_with_glued_numbers(spark):
    asked = "a 7-year-old horse runs 5km for £30 on the 3rd day and 4km for 20€ on the 21st day until noon"
    other = "a 9-year-old horse runs 8km for £45 on the 4th day and 6km for 25€ on the 22nd day until noon"
    texts = [asked, other, other.replace("km", " miles").replace("£45", "€45"), asked.replace("horse", "cat").replace("day", "night").replace("runs", "sits").replace("for", "by")]
    assert [found(spark, texts, [(3, asked)])[k][0] for k in range(4)] == [True, True, True, False]


def found_whole(spark, texts, bench, **how):
    """As the registered query and the pipeline look."""
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_id) for r in decontam.decontaminate(docs, items, per_window=True, **how).collect()}


def test_leaks_with_one_value_changed(spark):
    boxes = "there are 5 boxes in the old barn and every one of them holds 5 balls so how many balls are there"
    texts = [QUESTION.replace("gives 12", "gives 11"), QUESTION.replace("3 dollars", "12 dollars").replace("5 km", "12 km"), boxes.replace("5 boxes", "6 boxes").replace("5 balls", "7 balls"), "nothing of it"]
    got = found_whole(spark, texts, [(7, QUESTION), (8, boxes)])
    assert got == {0: (True, 7), 1: (True, 7), 2: (True, 8), 3: (False, None)}


def test_leaks_of_edited_short_and_partial_items(spark):
    short = "the old miller walks slowly along a narrow river before every winter and sings of home"
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    sums = "12 + 5 * 3 = 27"
    bench = [(1, short), (2, long), (3, sums), (4, "why do cats sleep"), (5, "Yes"), (6, "how many legs have 3 cats")]
    texts = [f"x y {short.replace('narrow', 'broad')} z", f"x y {' '.join(long.split()[20:33])} z", f"x y {sums} z", "x why do cats sleep z", "x yes z", "Yes!", "x how many legs have 9 cats z",
             f"x y {' '.join(long.split()[20:32])} z", "x 12 + 5 * 3 = 28 z", f"x y {short.replace('narrow', 'very broad')} z", None, ""]
    got = found_whole(spark, texts, bench, passages=True)
    assert [got[k][1] for k in range(12)] == [1, 2, 3, 4, None, 5, 6, None, None, 1, None, None]


def test_templates_take_little_memory():
    """Numpy arrays of a task at their peak, over 6 MB of text."""
    class Texts:
        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=300)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    work = decontam.template_windows(Texts(), np.zeros(1 << 18, np.uint64), True, [3, 9])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in work(iter([batch]))) == 0
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_leaks_in_rough_tables(spark, rough_docs, no_docs, rough):
    passage = rough[-1][1]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "too short"), (None, passage), (5, passage)], "item_id long, text string")
    got = decontam.decontaminate(rough_docs, bench)
    inside = " ".join(words_of(passage))
    want = Counter((i, inside in " ".join(words_of(t))) for i, t in rough if i is not None)
    assert Counter((r.doc_id, r.contaminated) for r in got.where("doc_id IS NOT NULL").collect()) == want
    assert got.where("contaminated").select("item_id", "n_items").distinct().collect() == [(1, 2)]
    assert got.select("row.*").columns == rough_docs.columns
    assert decontam.decontaminate(no_docs, bench).count() == 0
    assert decontam.decontaminate(rough_docs, bench.where("item_id > 99")).where("contaminated").count() == 0
