"""The registered queries and the pipeline against SQL, brute force and the libraries."""

import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import queries

from .conftest import prose
from .test_copies import near_groups, without_later_lines, words_of
from .test_texts import BYTE, WORD, check_packing, ids

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_every_operator_has_one_query():
    numbers = Counter(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == Counter(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(cur.fetchall())


@needs_tables
def test_near_duplicates_of_the_table(spark, documents):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, SF).collect())
    assert got == near_groups(documents)


@needs_tables
def test_tokens_of_the_table(spark, documents):
    docs = sorted(documents)
    texts = [t or "" for _, t in docs]
    got = [(r.doc_id, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SF).orderBy("doc_id").collect()]
    byte = ids(BYTE, texts)
    assert got == [(i, len(x), len(x) > 512) for (i, _), x in zip(docs, byte)]
    files = [(r.doc_id, r.start, r.n_tokens) for r in queries.op7_token_files(spark, SF).orderBy("doc_id").collect()]
    sizes = [len(x) for x in ids(WORD, texts, 2)]
    assert files == [(i, int(a), n) for (i, _), a, n in zip(docs, np.cumsum([0, *sizes]), sizes)]
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    used, least = check_packing(rows, list(zip([i for i, _ in docs], ids(BYTE, texts, 0))), 2048)
    assert used <= 1.05 * least + 1


@needs_tables
def test_leaks_of_the_table(spark, documents):
    bench = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, t in documents if any(q in " ".join(words_of(t)) for q in bench)}
    got = {r.doc_id for r in queries.op8_decontamination(spark, SF).where("contaminated").collect()}
    assert want <= got and len(got) <= len(want) + 2


@needs_tables
@pytest.mark.parametrize("name", ["op4_toxicity", "op6_language_id"])
def test_models_cover_the_table(spark, name, documents):
    got = queries.QUERIES[name](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in documents) and all(0 <= r.score <= 1 for r in got)
    import zlib
    part, fold = (3, 1) if name == "op4_toxicity" else (4, 2)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % part == fold) for r in got)


@pytest.fixture(scope="module")
def folder(spark, rough, tmp_path_factory):
    """Small tables with the columns of the given ones."""
    rng = random.Random(12)
    question = prose(rng, 24)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rough]
    rows += [(100 + k, prose(rng, 30) + "\n" + question.replace("\n", " "), "en", "s", 1) for k in range(3)]
    for k in range(400):
        words = prose(rng, rng.randrange(6, 70)).split(" ")
        for _ in range(3 * (k % 2)):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "vilebert"]))
        rows.append((1000 + k, " ".join(words), "en", "s", 1))
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), question


def test_pipeline_stages(spark, folder):
    d, question = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), lambda df: [(r.doc_id, r.text) for r in df.collect()]
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    step = stages["toxicity"](spark, docs, d).cache()
    assert step.columns == docs.columns
    rude = lambda t: "vilewort" in (t or "") or "vilebert" in (t or "")
    calm = Counter(x for x in kept(docs) if not rude(x[1]))
    got = Counter(kept(step))
    assert got <= Counter(kept(docs)) and sum((calm - got).values()) <= 8 and sum(1 for _, t in got if rude(t)) <= 8

    before = kept(step)
    step2 = stages["line_dedup"](spark, step, d).cache()
    want = Counter((i, t) for (i, _, gone, t), n in without_later_lines(before).items() for _ in range(n) if not gone or words_of(t))
    assert step2.columns == docs.columns and Counter(kept(step2)) == want
    assert all(r.n_chars == len(r.text) for r in step2.collect() if r.text is not None and r.doc_id is not None and dict(before).get(r.doc_id) != r.text)

    before = kept(step2)
    step3 = stages["jaccard_join"](spark, step2, d).cache()
    first = {i for i, _, group in near_groups(before, 5, 80, 100) if i is not None and i == group}
    after = kept(step3)
    assert step3.columns == docs.columns and Counter(i for i, _ in after if i is not None) == Counter(first)
    assert Counter(x for x in after if x[0] is None) == Counter(x for x in before if x[0] is None) and set(after) <= set(before)

    step4 = stages["decontamination"](spark, step3, d).cache()
    inside = " ".join(words_of(question))
    assert step4.columns == docs.columns and Counter(kept(step4)) == Counter(x for x in after if x[0] is None or inside not in " ".join(words_of(x[1])))

    texts = kept(step4)
    rows = stages["packing"](spark, step4, d).collect()
    check_packing(rows, list(zip([i for i, _ in texts], ids(BYTE, [t or "" for _, t in texts], 0))), 2048)
    run = corpus_pipeline.run(spark, d).collect()
    key = lambda r: (r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, rows))


def test_one_id_with_two_texts(spark, folder):
    d, _ = folder
    rng = random.Random(21)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a), (4, None), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert kept(stages["toxicity"](spark, docs, d)) == Counter(rows)
    assert kept(stages["jaccard_join"](spark, docs, d)) == Counter([(1, a), (1, b), (2, c), (4, None), (4, ""), (None, a), (None, a)])
    assert kept(stages["decontamination"](spark, docs, d)) == Counter(rows)
    packed = stages["packing"](spark, docs, d).collect()
    check_packing(packed, list(zip([i for i, _ in rows], ids(BYTE, [t or "" for _, t in rows], 0))), 2048)


def test_pipeline_of_nothing(spark, folder, tmp_path):
    d, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
