"""Periodic runs, the Jaccard join and the prefix trie: brute force and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicata.llm import jaccard_join, periodic_runs, prefix_trie
from indicata.llm.queries import op11_periodic_runs, op12_jaccard_join, op13_prefix_trie

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACES = r"[\x20\x09-\x0D]+"
CLASH = ("tie", "node", "group", "runs", "words", "start", "length", "period", "n", "h", "w", "a", "p", "s1", "root", "level", "chain", "pos", "low", "key", "_id", "_tie")


def words_of(text):
    return [w for w in re.split(SPACES, text or "") if w]


def with_clashes(frame):
    for name in CLASH:
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


# ---- periodic runs --------------------------------------------------------

def runs_brute(words):
    """(start, length, period) by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def report_brute(words):
    runs = runs_brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def report(row):
    return row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.runs_sha256, row.collapsed_sha256


def pieced(rng, n):
    """Words with repeats of all kinds, some right after another."""
    words = []
    while len(words) < n:
        if rng.random() < 0.4:
            words += [str(rng.randrange(rng.choice([1, 2, 3, 1000]))) for _ in range(rng.randrange(1, 40))]
        else:
            block, times = [str(rng.randrange(rng.choice([1, 2, 50]))) for _ in range(rng.randrange(1, 60))], rng.randrange(2, 7)
            words += (block * times)[:int(len(block) * (times - rng.random()))]
    return words


def test_fragments_of_tiles_stitch_to_the_runs_of_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        words, whole = pieced(rng, rng.choice([10, 60, 200, 500])), []
        by_period = collections.defaultdict(list)
        for q, low, high in periodic_runs.document_fragments(periodic_runs.word_ids([w.encode() for w in words])):
            by_period[q].append((low, high))
        for q, pieces in by_period.items():
            spans = []
            for low, high in sorted(pieces):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            whole += [(low, high - low + q, q) for low, high in spans if high - low + q >= max(24, 3 * q)]
        assert sorted(whole, key=lambda r: (r[0], r[2])) == runs_brute(words)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        assert periodic_runs.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_periodic_runs_edge_cases(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", " ".join(["a"] * 23), " ".join(["a"] * 24), "\n".join(["a b"] * 12), "x " + "a b c " * 9 + "y " + "a b c " * 9,
             " ".join(pieced(rng, 900)), "ä b c " * 20, "tie " + "a b " * 13 + "- " + "c d " * 13]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "n o " * 30), (None, None), (3, "again " * 30), (8, texts[8]), (8, texts[8])]
    frame = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, report(r)) for r in periodic_runs.periodic_runs(frame).collect())
    assert got == collections.Counter((d, report_brute(words_of(t))) for d, t in rows)
    own = periodic_runs.periodic_runs(frame.filter("doc_id = 5")).first()
    assert (own.n_words, own.collapsed, [tuple(x) for x in own.runs]) == (24, "a", [(0, 24, 1)])
    assert periodic_runs.periodic_runs(frame.filter("false")).collect() == []


def test_periodic_runs_of_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    words[7000:25_000] = (words[7000:12_000] * 4)[:18_000]
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words)), (2, "a " * 40_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.start, r.length, r.period) for r in row] == [(7000, 18_000, 5000), (0, 40_000, 1)]


def test_periodic_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, text in docs:
        words, h = words_of(text), zlib.crc32(str(d).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want[d] = report_brute(words)
    got = op11_periodic_runs(spark, SF).collect()
    assert {r.doc_id: report(r) for r in got} == want and len(got) == len(want)


# ---- Jaccard join ---------------------------------------------------------

def shingles(text):
    words = words_of((text or "").translate(LOWER))
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def join_brute(rows, percent=85):
    """{row number: (n_shingles, number of its component's first row, links)}, by all pairs that share a shingle."""
    sets, held = [shingles(t) for _, t in rows], collections.defaultdict(set)
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for k, own in enumerate(sets):
        for s in own:
            held[s].add(k)
    for k, own in enumerate(sets):
        for j, common in collections.Counter(j for s in own for j in held[s] if j < k).items():
            if 100 * common >= percent * (len(own) + len(sets[j]) - common):
                links[k], links[j] = links[k] + 1, links[j] + 1
                a, b = find(k), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(sets[k]), find(k), links[k]) for k in range(len(rows))]


def alike(seed=3, near=150):
    """Chains of texts near their neighbours only, a group of near copies, a passage that unlike texts share, copies."""
    rng, rows = random.Random(seed), []
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(160)]
        for step in range(8):
            rows.append(" ".join(words))
            for _ in range(2):
                words[rng.randrange(160)] = f"c{c}s{step}r{rng.randrange(10 ** 6)}"
    for i in range(30):
        rows.append(" ".join([f"p{j}" for j in range(60)] + [f"u{i}x{j}" for j in range(rng.randrange(0, 40))]))
    for _ in range(near):
        words = [f"b{i}" for i in range(120)]
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"z{rng.randrange(10 ** 6)}"
        rows.append(" ".join(words))
    return [*rows, rows[0], rows[0].upper(), rows[30], None, "", " \n", "a", "A", "a b c", "one two three four five"]


@pytest.mark.parametrize("block_sets, heap_most, long_list, batch_rows", [(512, 4096, 1024, 10_000), (24, 0, 1, 7), (64, 10 ** 9, 40, 3)])
def test_join_equals_brute_force(spark, monkeypatch, block_sets, heap_most, long_list, batch_rows):
    """In one block and in many, by heap and by counting, with and without lists dealt out, in batches of any size."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(jaccard_join, "HEAP_MOST", heap_most)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 12)
    rows = list(enumerate(alike()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == dict(enumerate(join_brute(rows)))


@pytest.mark.parametrize("heap_most, dense_sets", [(0, 64), (10 ** 9, 64), (10 ** 9, 2)])
def test_search_equals_counting(monkeypatch, heap_most, dense_sets):
    monkeypatch.setattr(jaccard_join, "HEAP_MOST", heap_most)
    monkeypatch.setattr(jaccard_join, "DENSE_SETS", dense_sets)
    rng = random.Random(6)
    for _ in range(40):
        base = [rng.getrandbits(63) for _ in range(60)]
        sets = [np.array(sorted({*rng.sample(base, rng.randrange(30, 60)), *(rng.getrandbits(63) for _ in range(rng.randrange(0, 8)))}), np.uint64) for _ in range(30)]
        sets.sort(key=len)
        index = jaccard_join.Index(sets)
        for k in range(1, len(sets)):
            for percent in (50, 70, 85):
                low = int(np.searchsorted(index.sizes, jaccard_join.least_common(len(sets[k]), percent)))
                own = set(sets[k].tolist())
                want = [j for j in range(low, k) if 100 * len(own & set(sets[j].tolist())) >= percent * len(own | set(sets[j].tolist()))]
                assert index.search(k, low, percent).tolist() == want if low < k else not want


def test_short_lists_are_merged_by_a_heap():
    rng = random.Random(7)
    lists = [np.array(sorted(rng.sample(range(100), rng.randrange(1, 60)))) for _ in range(12)]
    counts = collections.Counter(k for x in lists for k in x.tolist())
    for least in range(1, 13):
        found, common = jaccard_join.merge_short(lists, least)
        assert dict(zip(found.tolist(), common.tolist())) == {k: n for k, n in counts.items() if n >= least}


def test_join_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(50_000))
    rows = [(1, long), (2, long + " end"), (None, long), (None, None), (None, ""), (7, "a b c d e"), (7, "v w x y z"), (7, "a b c d e"), (3, "A B\tC D\nE"), (9, None)]
    got = collections.Counter(map(tuple, jaccard_join.jaccard_join(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()))
    assert got == collections.Counter([
        (1, 49_997, 1, 2), (2, 49_998, 1, 2), (None, 49_997, 1, 2), (None, 0, None, 0), (None, 0, None, 0),
        (7, 2, 3, 2), (7, 2, 7, 0), (7, 2, 3, 2), (3, 2, 3, 2), (9, 0, 9, 0)])
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert jaccard_join.jaccard_join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1, 0)]


def test_join_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {d: (n, rows[first][0], k) for (d, _), (n, first, k) in zip(rows, join_brute(rows))}
    got = op12_jaccard_join(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want and len(got) == len(want)


# ---- prefix trie ----------------------------------------------------------

def trie_brute(convs):
    """{conv_id: [(role, text), ...]} to the rows of every node."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(own) - 1) * len(words_of(k[-1][1])) if k else 0
    return collections.Counter(
        (min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, own in members.items())


def rows_of(frame):
    return collections.Counter(map(tuple, frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def table(spark, convs):
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")
    return turns, spark.createDataFrame([(c,) for c in convs], "conv_id long")


@pytest.mark.parametrize("segment, stretch, parts", [(1024, 20_000, 5), (3, 4, 7), (1, 1, 3), (2, 20_000, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, stretch, parts):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rng = random.Random(segment)
    convs = {}
    for c in rng.sample(range(-50, 400), 120):
        turns = [(rng.choice(["user", "assistant"]), " ".join(["x"] * rng.randrange(0, 3))) for _ in range(rng.randrange(0, 7))]
        base = rng.choice(list(convs.values())) if convs and rng.random() < 0.6 else []
        convs[c] = base[:rng.randrange(0, 9)] + turns
    convs[1000] = convs[1001] = [("user", "same")] * 8
    turns, every = table(spark, convs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(prefix_trie.prefix_trie(turns.repartition(5), every)) == trie_brute(convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_forest_sums_over_any_stretches():
    rng = random.Random(9)
    node = {}

    def chain(turns):
        return b"".join(node.setdefault(tuple(turns[:d + 1]), hashlib.md5(repr(turns[:d + 1]).encode()).digest()) for d in range(len(turns)))

    for _ in range(50):
        every = {tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6))) for _ in range(30)}
        rows = sorted((chain(list(t)), list(t)) for t in every)
        chains = [r[0] for r in rows]
        shared = [0, *(prefix_trie.common_turns(a, b) for a, b in zip(chains, chains[1:])), 0]
        full = [(prefix_trie.ROOT, c, [1 + w for w in t], 1, k, 0, 0, 0, shared[k], shared[k + 1]) for k, (c, t) in enumerate(rows)]

        def summed(parts):
            total = collections.defaultdict(lambda: [0] * 4)
            for part in parts:
                for key, _, depth, _, convs, children, leaves, saved in prefix_trie.forest(part, 0):
                    for k, x in enumerate((convs, children, leaves, saved)):
                        total[key, depth][k] += x
            return dict(total)

        cut = rng.randrange(1, len(full)) if len(full) > 1 else 0
        assert summed([full]) == summed([full[:cut], full[cut:]]) == summed([[r] for r in full])


def test_trie_edge_cases(spark):
    role = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (2, 0, "user", None), (2, 1, None, ""), (3, 0, "user", ""), (4, 0, "user", "a"), (4, 0, "user", "a"),
            (None, 0, "user", "lost"), (5, 1, "a,b", "c"), (6, 1, "a", "b,c"), (7, 0, "user", "w " * 60_000)]
    turns = prefix_trie.numbered_turns(with_clashes(spark.createDataFrame(rows, role)))
    convs = {1: [("user", "a"), ("user", "b")], 2: [("user", ""), ("", "")], 3: [("user", "")], 4: [("user", "a"), ("user", "a")],
             5: [("a,b", "c")], 6: [("a", "b,c")], 7: [("user", "w " * 60_000)]}
    assert rows_of(prefix_trie.prefix_trie(turns)) == trie_brute(convs)
    none = spark.createDataFrame([], role)
    assert prefix_trie.prefix_trie(prefix_trie.numbered_turns(none)).collect() == []
    assert prefix_trie.prefix_trie(prefix_trie.numbered_turns(none), none).collect() == []
    alone = spark.createDataFrame([(4,), (9,)], "conv_id long")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.numbered_turns(none), alone)) == trie_brute({4: [], 9: []})


def test_trie_query_against_brute_force(spark):
    own = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy(F.col("conv_id"), F.col("turn").asc_nulls_first()).collect():
        own[r.conv_id].append((r.role or "", r.text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert rows_of(op13_prefix_trie(spark, SF)) == trie_brute(convs)
