"""Cleaning pipeline over ``documents``: toxic texts, repeated lines, near duplicates and benchmark leaks go, the rest is packed for training.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept; all but the last return the columns of
``documents``. ``run`` writes every result below the shared folder and reads it again as input of the next stage.
"""

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import decontam, jaccard, lines, packing, toxicity
from tidemark.llm.common import materialize, table

CAPACITY = 2048
DIGEST = "_digest_of_text"


def drop_toxic(spark, docs, sf_dir):
    """Operator 4: rows scoring 0.7 or more go. Labels of the held-out third are not used.

    Null, empty and wordless texts score like an empty window; equal rows share their fate; null ids are scored like others; an empty table
    stays empty, and without labels of both kinds every row stays.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), held_out=held_out, threshold=0.7)


def drop_repeated_lines(spark, docs, sf_dir):
    """Operator 10: later runs of repeated lines go, and with them documents of which no word is left; ``n_chars`` follows the text.

    A null or empty text has no line to lose and stays, also under a null id; of equal rows the later ones lose their long repeats; an empty table stays empty.
    """
    done = lines.dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return left.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 5: of documents linked by 5-word shingles at Jaccard similarity 0.8 or more the one with the smallest id stays.

    Rows that agree in id and text are one document and leave one row. Different texts under one id all stay or go with that id. Null and empty
    texts are linked with nothing and stay, as do all rows without an id; an empty table stays empty.
    """
    groups = jaccard.jaccard_groups(docs, size=5, num=80, den=100)
    first = materialize(groups.where("doc_id = component_id").select("doc_id").distinct())
    kept = docs.join(first, "doc_id", "left_semi").withColumn(DIGEST, F.sha2(F.col("text").cast("binary"), 256))
    return kept.dropDuplicates(["doc_id", DIGEST]).select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Operator 8: documents that hold a benchmark item, perhaps with other numbers or names, go.

    Null and empty texts hold none and stay, as do all rows if the benchmark is empty; equal rows share their fate; null ids are read like others.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), per_window=True, passages=True).where("NOT contaminated").select("row.*")


def pack_sequences(spark, docs, sf_dir):
    """Operator 9: pieces of at most 2048 tokens and where they stand.

    A null or empty text is one piece that holds the end id alone; every row, also of a repeated or null id, is packed; an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

# A trained network and a tokenizer are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
