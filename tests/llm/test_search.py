"""Periodic runs, URL filter and ranked search against plain restatements of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import ball_search, queries, reputation, runs  # noqa: E402


def plain_runs(words, least=6, powers=4):
    out = {}
    for q in range(1, len(words) // powers + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, powers * q):
                out.setdefault((s, i + q), q)
            i = i + 1 if i == s else i
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(rng):
    kind, n = rng.random(), rng.randrange(120)
    if kind < 0.3:
        return [rng.randrange(2) for _ in range(n)]
    if kind < 0.6:
        out = []
        while len(out) < n:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            out += (unit * 9)[:rng.randrange(1, 9 * len(unit))]
        return out
    unit = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
    return [rng.randrange(4) for _ in range(rng.randrange(9))] + (unit * 9)[:rng.randrange(1, 9 * len(unit))] + [1, 2]


def test_cover_and_extensions():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))
    rng = np.random.default_rng(0)
    for top in (1, 2, 5, 400):
        ids = np.append(np.tile(rng.integers(0, top, 90), 4), 10_000)
        ext = runs.Extensions(ids)
        i = rng.integers(0, len(ids), 400)
        j = rng.integers(0, len(ids), 400)
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j):
            n = 0
            while max(a, b) + n < len(ids) and ids[a + n] == ids[b + n]:
                n += 1
            want.append(n)
        assert ext(i, j).tolist() == want


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for trial in range(400):
        if trial == 300:
            monkeypatch.setattr(runs, "PAIRS", 7)
        texts = [periodic(rng) for _ in range(rng.randrange(1, 8))]
        got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_word_numbers_survive_colliding_hashes(monkeypatch):
    import pyarrow as pa
    from tidemark.llm.common import Words
    words = Words(pa.array(["a b a c b"], pa.large_string()))
    hashes = words.hashes
    monkeypatch.setattr(words, "hashes", lambda lane: np.zeros(5, np.uint64) if lane == 0 else hashes(lane))
    assert runs.word_numbers(words).tolist() == [0, 1, 0, 2, 1]


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_table(spark, rough, no_docs):
    rng = random.Random(4)
    rows = [(i, t if len(t or "") < 9000 else t[:9000]) for i, t in rough]
    rows += [(i, " ".join("abcd"[w] + "é" for w in periodic(rng))) for i in range(100, 260)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, start int").repartition(3)
    got = queries.runs.run_digests(runs.periodic_runs(docs, rewrite=queries.turned))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(digest(i, t) for i, t in rows) and sum(r[1] for r in found) > 50
    assert queries.runs.run_digests(runs.periodic_runs(no_docs)).count() == 0


def test_a_long_text_is_searched_to_its_end(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(300_000)) + " " + "so it goes " * 5
    row = runs.run_digests(runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 300_000, 15, 3, 5000)


def address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_filter(rows, rules, threshold, z):
    pages, hosts = [], {}
    for page, url in rows:
        host, path = address(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: (len(r.text), len(r.host)), default=None)
        pages.append((page, host, path, rule))
        n = hosts.setdefault(host, [0, 0])
        if rule:
            n[0] += 1
            n[1] += rule.verdict == "allow"

    def names(host):
        p = host.split(".")
        k = 0 if len(p) < 2 or re.fullmatch("[0-9]*", p[-1]) else 2 if len(p) > 2 and re.fullmatch("[a-z]{2}", p[-1]) and p[-2] in reputation.SECOND_LEVEL else 1
        return (host, host) if k == 0 else (".".join(p[-k - 1:]), ".".join(p[-k:]))

    def level(counts, above):
        extra = sum((g - n * above[k]) ** 2 - n * above[k] * (1 - above[k]) for k, (n, g) in counts.items())
        room = sum(n * (n - 1) * above[k] * (1 - above[k]) for k, (n, g) in counts.items())
        least, most, weight = reputation.WEIGHTS
        if room > 0:
            weight = 1 / min(max(extra / room, 1 / (most + 1)), 1 / (least + 1)) - 1
        return {k: (g + weight * above[k], n - g + weight * (1 - above[k])) for k, (n, g) in counts.items()}

    def roll(counts, up):
        out = {}
        for k, (n, g) in counts.items():
            c = out.setdefault(up(k), [0, 0])
            c[0], c[1] = c[0] + n, c[1] + g
        return out

    domains = roll(hosts, lambda h: names(h)[0])
    of = {names(h)[0]: names(h)[1] for h in hosts}
    suffixes = roll(domains, of.get)
    total = [sum(c[k] for c in suffixes.values()) for k in (0, 1)]
    mean = lambda post: {k: a / (a + b) for k, (a, b) in post.items()}
    top = mean(level(suffixes, dict.fromkeys(suffixes, (total[1] + 1) / (total[0] + 2))))
    mid = mean(level(domains, {d: top[of[d]] for d in domains}))
    post = level(hosts, {h: mid[names(h)[0]] for h in hosts})
    bound = {h: a / (a + b) + z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) for h, (a, b) in post.items()}
    return Counter((p, h, path, r.text if r else None, r.verdict if r else "block" if bound[h] < threshold else "allow", round(bound[h], 6)) for p, h, path, r in pages)


def urls():
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "no address"), (4, "http://"), (None, "http://a.org/x"), (5, "x://ORG/é?q"), (6, "http://org?x/"), (7, "http://a.b.example.org/es/1#t"), (8, "http://example.org/en/12"),
            (9, "http://myexample.org/es/"), (10, "http://a.com/fr/#"), (11, "http://a.com/de/"), (12, "http://1.2.3.4/"), (13, "https://shop.x.co.uk/a"), (14, "http://x.y.z/?u=http://b.org/"), (15, "h://" + "a." * 3000 + "org/q"),
            (16, "http://É.com/fr/x"), (17, "mailto:x://y.org/\nz"), (1, None)]
    for i in range(100, 900):
        host = rng.choice(["bad.com", "www.bad.com", "good.com", "mixed.com", "a.mixed.com", "b.co.uk", "new.net", "one.example.org", "example.org"])
        lang = "de" if host.endswith("bad.com") and rng.random() < 0.95 else rng.choice(["fr", "de", "en", "es"]) if "mixed" in host else rng.choice(["fr", "en", "fr"])
        rows.append((i, f"http://{host}/{lang}/{rng.randrange(30)}"))
    return rows


def test_urls_equal_a_plain_count(spark):
    rows = urls()
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in rows], "page_id long, url string, host string, rule string, upper double").repartition(3)
    got = reputation.filter_urls(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "upper"]
    found = Counter(tuple(r) for r in got.collect())
    assert found == plain_filter(rows, reputation.RULES, 0.5, 1.645)
    own = {(h, v) for _, h, _, rule, v, _ in found if rule is None}
    assert ("bad.com", "block") in own and ("good.com", "allow") in own and ("new.net", "allow") in own
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_urls_without_labels_rows_or_with_cold_hosts(spark, monkeypatch):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert reputation.filter_urls(empty).count() == 0
    none = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in reputation.filter_urls(none).collect()} == {(1, None, "allow"), (2, None, "allow")}
    monkeypatch.setattr(reputation, "SHARE", 3)  # most hosts take the shuffled way
    rows = urls()
    got = Counter(tuple(r) for r in reputation.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == plain_filter(rows, reputation.RULES, 0.5, 1.645)
    with pytest.raises(ValueError):
        reputation.first_rule((reputation.Rule("allow", "a/"), reputation.Rule("block", "a/")))


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        asked = Counter(terms(text))
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in asked.items() if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for r, (s, _, _, i) in enumerate(sorted(scored)[:k]):
            out[item, r + 1, i, -s] += 1
    return out


@pytest.fixture(scope="module")
def questions(rough):
    rng = random.Random(9)
    texts = [t for _, t in rough if t]
    rows = [(i, " ".join(rng.sample(rng.choice(texts).split() or ["x"], 1) * rng.randrange(1, 3) + rng.choice(texts).split()[:rng.randrange(12)])) for i in range(30)]
    return rows + [(40, None), (41, ""), (42, "--- !!"), (43, "unheard xyzzy"), (44, "River RIVER wörter Wörter"), (44, "another text of the river"), (3, rows[3][1]), (None, "stone")]


@pytest.mark.parametrize("block, leaf, item_bytes", [(4096, 32, 256 << 10), (16, 2, 60)])
def test_search_equals_all_scores(spark, rough, rough_docs, questions, monkeypatch, block, leaf, item_bytes):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("ITEM_BYTES", item_bytes)):
        monkeypatch.setattr(ball_search, name, value)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in questions], "item_id long, text string, doc_id int, score int")
    got = ball_search.rank_documents(rough_docs, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_search(rough, questions, 10)


def test_search_of_nothing(spark, rough_docs, no_docs, questions):
    asked = spark.createDataFrame(questions, "item_id long, text string")
    assert ball_search.rank_documents(no_docs, asked).count() == 0
    assert ball_search.rank_documents(rough_docs, asked.where("text IS NULL")).count() == 0


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(ball_search, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows, values, ptr = [], [], [0]
    topics = [(np.unique(rng.integers(0, 30, 9) + 30 * k), rng.integers(10**9, 3 * 10**10, 9)) for k in range(12)]
    for _ in range(900):  # small changes of twelve documents
        own, value = topics[rng.integers(0, 12)]
        rows.append(own)
        values.append(value[:len(own)] + rng.integers(0, 10**8, len(own)))
        ptr.append(ptr[-1] + len(own))
    term, value = np.concatenate(rows).astype(np.int32), np.concatenate(values)
    make = lambda: ball_search.Rows(np.array(ptr), term.copy(), value.copy())
    items = ball_search.Rows(np.array([0, 3, 7]), np.concatenate((topics[0][0][:3], topics[1][0][:4])).astype(np.int32), np.array([1, 2, 1, 1, 1, 3, 1]))
    tree = ball_search.BallTree(make(), 360)
    lengths = np.sqrt(np.add.reduceat(items.value.astype(float) ** 2, items.ptr[:-1]))
    dense = np.zeros((2, 360), np.int64)
    for k in (0, 1):
        dense[k, items.term[items.ptr[k]:items.ptr[k + 1]]] = items.value[items.ptr[k]:items.ptr[k + 1]]
    for node, (lo, hi, _, _) in enumerate(tree.nodes):
        bound = tree.bounds(node, items, lengths)
        assert all(tree.rows.dot(dense[k], lo, hi).max() <= bound[k] for k in (0, 1))
    best = ball_search.Best(2, 5)
    scored = ball_search.search_tree(tree, np.arange(900), np.zeros(900, bool), items, best)
    for k in (0, 1):
        want = make().dot(dense[k])
        first = np.lexsort((np.arange(900), -want))[:5]
        assert best.doc[k].tolist() == first.tolist() and best.score[k].tolist() == want[first].tolist()
    assert scored < 2 * 900  # some subtrees were dropped
