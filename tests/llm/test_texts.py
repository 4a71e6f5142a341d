"""Operators on single texts: token counts, quality rules, token files, packing."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import bpe_count, chunks, frames, packing, rules  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n\n b", "x  y", "don't they'll", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "aaaaaaaaaaa", "\x1c \x1d", "日本語 テキスト", "1234 5.6",
       "!!??  ..", "a\0b c", "　 x", "ß Ǆ ﬁ", "é É", "<|startoftext|> hi<|endoftext|>", "tab\tsep  two", "\n", " \n "]


def ids(path, texts, end=None):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return [e.ids + ([] if end is None else [end]) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    assert bpe_count.Counter(BYTE)(ODD) == [len(x) for x in ids(BYTE, ODD)]
    long = ["ab" * 3000, "the " * 2000, "\n" * 999, "x" * 1001 + " y"]
    assert bpe_count.Counter(BYTE)(long) == [len(x) for x in ids(BYTE, long)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_do_not_change_identifiers(path):
    from tidemark.llm.encode import Encoder
    got = Encoder(path).encode(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == ids(path, ODD)
    assert all("".join(chunks.chunks(t)) == t for t in ODD)


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(chunks, "ENTRIES", 10)
    monkeypatch.setattr(bpe_count, "PIECE_ENTRIES", 10)
    c = bpe_count.Counter(BYTE)
    for k in range(5):
        texts = [f"word{k}{j} other{j}" for j in range(30)]
        assert c(texts) == [len(x) for x in ids(BYTE, texts)]
    assert len(c.memo.known) <= 100


def test_merges_must_be_in_order():
    shown = bpe_count._byte_symbols()
    vocab = {s: i for i, s in enumerate([*shown, "ab", "abc"])}
    with pytest.raises(ValueError):
        bpe_count.PairMerger(vocab, [("ab", "c"), ("a", "b")])


def test_token_counts_table(rough, rough_docs, no_docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.token_counts(rough_docs, BYTE).collect())
    texts = [t or "" for _, t in rough]
    assert got == Counter((i, len(t.encode()), len(x), len(x) > 512) for (i, _), t, x in zip(rough, texts, ids(BYTE, texts)))
    assert bpe_count.token_counts(no_docs, BYTE).count() == 0


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words)


def test_quality_measures(spark, rough, rough_docs, no_docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality(rough_docs).collect())
    assert got == Counter((i, *quality(t)) for i, t in rough)
    assert rules.quality(no_docs).count() == 0


def test_quality_verdicts(spark):
    good = "the river runs over the green stone and the light of the house was on the table to the north of a window"
    texts = [good, good.replace(" ", " ### "), good.upper().replace(" ", "!! "), "Lorem " + "xyzzy plugh frobnicate quux bar baz qux corge grault garply waldo fred thud wibble wobble flob " * 2]
    got = [r.failed_rules for r in rules.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == [] and "symbols" in got[1] and "upper_case" in got[2] and "few_stop_words" in got[3]
    plan = rules.quality(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.fixture(scope="module")
def files(rough_docs, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tokens')}"
    return frames.write_token_files(rough_docs, WORD, 2, folder, shard_bytes=40_000)


def test_token_files_round_trip(rough, files):
    got = frames.read_token_files(files).collect()
    want = Counter((i, tuple(x)) for (i, _), x in zip(rough, ids(WORD, [t or "" for _, t in rough], 2)))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert files.count() > 1
    ordered = sorted(got, key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys) and [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:k]) for k in range(len(ordered))]
    crc = Counter((r.doc_id, r.ids_crc32) for r in frames.token_digests(files).collect())
    assert crc == Counter((i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.elements())


def test_only_wanted_frames_are_read(files, monkeypatch):
    assert sorted(r.doc_id for r in frames.read_token_files(files, [11, 50, 999]).collect()) == [11, 50]
    path = files.orderBy("shard").first().path
    reader, touched = frames.Reader(path), []
    plain = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: touched.append(k) or plain(k))
    assert len(reader.tokens(0)) == reader.lengths()[0] and touched == [0]


def test_damage_is_noticed(files, tmp_path):
    source = files.orderBy("shard").first().path.removeprefix("file://")
    raw = bytearray(open(source, "rb").read())
    reader = frames.Reader(source)
    raw[int(reader.at[1]) - 6] ^= 255
    (tmp_path / "bad.zst").write_bytes(raw)
    bad = frames.Reader(str(tmp_path / "bad.zst"))
    with pytest.raises(Exception):
        bad.tokens(0)
    bad.tokens(1)
    (tmp_path / "short.zst").write_bytes(raw[:-3])
    with pytest.raises(Exception):
        frames.Reader(str(tmp_path / "short.zst"))


def test_token_files_of_nothing(no_docs, tmp_path):
    manifest = frames.write_token_files(no_docs, WORD, 2, f"file://{tmp_path}")
    assert manifest.count() == 0 and frames.token_digests(manifest).count() == 0


def check_packing(rows, texts, capacity, end=0):
    want = Counter()
    for i, x in texts:
        n = len(x)
        first = n % capacity or capacity
        edges = [0, *range(first, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_packing_table(rough, rough_docs, capacity):
    rows = packing.pack(rough_docs, BYTE, 0, capacity).collect()
    used, least = check_packing(rows, list(zip([i for i, _ in rough], ids(BYTE, [t or "" for _, t in rough], 0))), capacity)
    assert used <= 1.15 * least + 1


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_histogram_plans(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([8, 32, 512, 2048]))
    lengths = rng.integers(1, capacity + 1, int(rng.choice([1, 7, 300, 40_000])))
    if seed % 3 == 0:
        lengths[: len(lengths) // 3] = lengths[0]
    plan = packing.Plan.of(packing.pack_histogram(np.bincount(lengths, minlength=capacity + 1), capacity))
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), int)
    rank[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
    seq, off = plan.place(lengths, rank)
    k = np.lexsort((off, seq))
    s, o, n = seq[k], off[k], lengths[k]
    new = np.append(True, s[1:] != s[:-1])
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= capacity and len(np.unique(s)) == plan.sequences
    if len(lengths) == 40_000:
        halves = (lengths > capacity // 2).sum()
        assert plan.sequences <= 1.05 * max(halves, -(-lengths.sum() // capacity)) and len(plan.keys) < 40 * capacity
