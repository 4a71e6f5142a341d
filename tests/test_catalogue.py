import random

from pyspark.sql import functions as F

from tidemark.operators import catalogue as cat, scoring as sc


def test_hits_equal_contains_for_every_term(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("最好抗菌除臭第一名ab") for _ in range(n))
    versions = {v: [(word(rng.randrange(1, 4)), "k") for _ in range(40)] for v in ("a", "b")}
    versions["b"] += [("", "none"), (" ", "none"), ("最 好", "spaced")]
    texts = [(i, word(rng.randrange(30))) for i in range(60)] + [(60, None), (61, ""), (62, "最最最"), (63, "ＡＢ")]
    df = spark.createDataFrame(texts, "i int, t string")
    got = {tuple(r) for r in cat.catalogue_hits(df, ["i"], F.col("t"), cat.claim_catalogue(spark, versions)).collect()}
    plain = lambda t: (t or "").replace(" ", "").replace("ＡＢ", "ab").lower()
    assert got == {(i, v, term, kind) for i, t in texts for v, terms in versions.items() for term, kind in terms if plain(term) and plain(term) in plain(t)} and got


def test_facts_of_a_version(spark):
    products = spark.createDataFrame([("i", 1, "old", "x"), ("i", 2, "new", None), ("i", 3, "late", "z"), ("j", 3, "n", "m")], "item string, v int, name string, made_in string")
    facts = cat.product_facts(products, "item", ["name", "made_in"], F.col("v"))
    assert {tuple(r) for r in cat.facts_as_of(facts, 2).select("item_id", "field", "version", "value").collect()} == {("i", "name", 2, "new"), ("i", "made_in", 1, "x")}


def test_scores_are_bound_to_the_answer_they_judged(spark):
    answers = spark.createDataFrame([(1, "e1", "tools", "r1", "facts", "", 10), (2, "e1", "tools", "r1", "facts", "", 20), (3, "e1", "tools", "r1", "facts", "error: x", 25), (4, "e1", "tools", "r2", "facts", "", 30), (5, "e2", "none", "r1", "other", "", 10)],
                                    "event_id int, case_id string, mode string, run_id string, kind string, status string, created_us long")
    scores = spark.createDataFrame([(1, "e1", "tools", "human", 2, "a", "", "r1", "v", 15), (2, "e1", "tools", "human", 1, "b", "", "r1", "v", 40), (3, "e1", "tools", "rule", 0, "c", "", "r2", "v", 29), (4, "e1", "tools", "rule", 1, "d", "", "r2", "v", 30),
                                    (5, "e2", "none", "rule", 2, "e", "", "r1", "v", 9), (6, "e2", "none", "human", 2, "f", "", "r1", "v", 11), (7, "e9", "none", "human", 2, "g", "", "r1", "v", 11), (8, "e1", "tools", "human", 2, "h", "error", "r2", "v", 50)],
                                   "event_id int, case_id string, mode string, grader string, score int, explanation string, status string, answer_run_id string, spec string, created_us long")
    got = {r.event_id: (r.answer_event_id, r.state) for r in sc.bound_scores(scores, answers, cuts=[12.0, 26.0]).collect()}
    assert got == {1: (1, "stale"), 2: (2, "stale"), 3: (None, "orphan"), 4: (4, "current"), 5: (None, "orphan"), 6: (5, "current"), 7: (None, "orphan"), 8: (4, "current")}
    # a score of an older answer, or one that failed, does not count
    assert {(r.case_id, r.grader, r.score) for r in sc.latest_scores(scores, answers).collect()} == {("e1", "rule", 1), ("e2", "human", 2)}
