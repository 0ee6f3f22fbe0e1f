"""Near duplicates, decontamination, mixing, chat formatting, extraction and the pipeline: brute force and edge cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from indicata.llm import chat_format, decontaminate, html_extract, mixing, near_dup
from indicata.llm.queries import op3_chat_format, op8_html_extract

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CLASH = ("tie", "_id", "_tie", "key", "node", "doc", "group", "size", "target", "copies", "_rows", "span", "items", "kept")


def with_clashes(frame):
    for name in CLASH:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def components_brute(rows):
    """rows: (doc_id, text); ids distinct and not null."""
    sets, top = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def chains(seed=3):
    """Chains of texts, each near its neighbours only, and a passage that many unlike texts share."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for c in range(4):
        words = [f"c{c}w{i}" for i in range(120)]
        for step in range(12):
            rows.append((len(rows), " ".join(words)))
            for _ in range(2):
                words[rng.randrange(120)] = f"c{c}s{step}r{rng.randrange(10 ** 6)}"
    for i in range(40):
        rows.append((len(rows), " ".join(passage + [f"u{i}x{k}" for k in range(50)])))
    return rows + [(len(rows) + i, t) for i, t in enumerate(["", "one", "one", "two words", "Two  words", "three little words"])]


def test_near_duplicates_match_brute_force(spark):
    smoke = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (smoke, chains()):
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        want = components_brute(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id if r.n_shingles else r.doc_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    rows = chains(5)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_brute(rows)


def test_min_and_max_signatures_estimate_similarity():
    import numpy as np

    one, two = ([f"w{i}".encode() for i in range(a, a + 400)] for a in (0, 40))
    a, b = (near_dup.shingle_hashes(w) for w in (one, two))
    exact = len(near_dup.shingle_set(one) & near_dup.shingle_set(two)) / len(near_dup.shingle_set(one) | near_dup.shingle_set(two))
    same = np.mean(np.concatenate([x == y for x, y in zip(near_dup.signature(a), near_dup.signature(b))]))
    assert abs(same - exact) < 0.1
    assert len(a) == len(near_dup.shingle_set(one))


def test_components_of_a_long_chain(spark):
    rows = [(i + 1, i) for i in range(60)] + [(100, 99), (101, 99)]
    random.Random(1).shuffle(rows)
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 99, 101: 99}


def test_one_of_each_with_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (2, text), (None, text), (None, "only without an id here"), (None, "only without an id here"), (7, None), (8, ""), (8, ""),
            (9, text + " more"), (11, "same id"), (11, "same id other")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(2, text), (None, "only without an id here"), (7, None), (8, ""), (8, ""), (11, "same id"), (11, "same id other")])
    assert near_dup.one_of_each(docs.limit(0)).count() == 0


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, "..."), (None, "no id at all"), (1, item)], "item_id long, text string")
    rows = [(1, item.upper()), (2, "x " * 300 + item), (3, "a short, item!"), (4, None), (None, item), (5, ""), (6, " ".join(f"q{i}" for i in range(12))),
            (7, "fine text"), (7, "fine text"), (7, item), (8, "no id at all")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    assert got == collections.Counter([
        (1, 15, 15, ("1",), True), (2, 315, 15, ("1",), False), (3, 3, 2, ("2",), True), (4, 0, 0, (), False), (None, 15, 15, ("1",), True), (5, 0, 0, (), False),
        (6, 12, 0, (), False), (7, 2, 0, (), False), (7, 2, 0, (), False), (7, 15, 15, ("1",), True), (8, 4, 0, (), False)])
    assert decontaminate.contamination(docs, bench, block_windows=1).filter("contaminated").count() == 4
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6, 7, 7, 8]
    cut = {(r.doc_id, r.text) for r in decontaminate.remove_spans(docs, bench).collect()}
    assert (3, "a ") in cut and (2, "x " * 300) in cut and (4, None) in cut
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def targets_brute(sizes):
    """The rule as told: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_totals(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 90), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)] + [(9000, "w " * 5, "e"), (9001, "w", "é"), (9002, None, "z")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets_brute(sizes), collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    again = mixing.mix(docs.repartition(3), buckets=7).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    whole = mixing.repeat_documents(docs)
    assert whole.columns == docs.columns
    assert collections.Counter(r.doc_id for r in whole.collect()) == collections.Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_takes_no_source_through_one_window(spark):
    # the small source stands at its cap, the others have p near 0 and 1
    rows = [(i, "a word or two", "b" if i < 40 else "a" if i < 1000 else "c") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(50, 50, 2), buckets=64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # two branches: the documents with p = 0 are in one that no window over documents stands in
    assert "Union" in plan
    copies = collections.defaultdict(list)
    for r in got.collect():
        copies[r.source].append(r.copies)
    assert copies["b"] == [3] * 40 and sum(map(len, copies.values())) == 1500


def test_mixing_repeated_rows_and_empty(spark):
    rows = [(1, "a b c", "x")] * 7 + [(None, "a b", "x"), (2, "a b", None), (2, "c d", None), (3, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(docs)
    assert drawn.count() == len(rows)
    assert mixing.repeat_documents(docs).count() == drawn.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repeat_documents(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(""))).agg(F.sum("taken")).first()[0] == 0


def test_mixing_draws_each_row_apart(spark):
    rows = [(None, f"text number {k} of no id", "a") for k in range(2000)] + [(7, "b " * 40, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    uniform = mixing.uniform(7, F.col("doc_id"), F.lit(5), F.md5("text"))
    assert docs.filter("source = 'a'").select(uniform).distinct().count() == 2000
    got = mixing.mix(docs, weights=(2, 1)).filter("source = 'a'")
    picked = got.groupBy("copies").count().collect()
    assert {r["copies"] for r in picked} <= {0, 1, 2, 3} and sum(r["count"] for r in picked) == 2000


def test_mixing_levels_share_the_target_by_weight(spark):
    """The words expected of a source are its target, no document more than three times its size, whatever the weights."""
    rng = random.Random(3)
    for _ in range(12):
        rows = [(s, float(w), rng.randrange(1, 500)) for s in "ab" for w in rng.sample(range(1, 20), rng.randrange(1, 6))]
        targets = {s: rng.random() * 3 * sum(n for x, _, n in rows if x == s) for s in "ab"}
        targets["b"] = 3.0 * sum(n for x, _, n in rows if x == "b") if rng.random() < 0.3 else targets["b"]
        frame = spark.createDataFrame([(s, targets[s], w, n) for s, w, n in rows], "source string, target double, weight double, size long")
        got = {(r.source, r.weight): r.expected for r in mixing.levels(frame).collect()}
        for s in "ab":
            assert abs(sum(got[s, w] * n for x, w, n in rows if x == s) - targets[s]) < 1e-6 * targets[s] + 1e-6
            free = {round(got[s, w] / w, 9) for x, w, n in rows if x == s and got[s, w] < 3}
            assert len(free) <= 1 and all(0 <= got[x, w] <= 3 for x, w, _ in rows)


def test_mixing_takes_long_documents_of_a_source_more_often(spark):
    from indicata.llm.queries import by_size
    docs = spark.createDataFrame([(k, "w " * (20 if k % 2 else 300), "a" if k < 2000 else "b") for k in range(2400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 4), weight=by_size).filter("source = 'a'")
    copies = {r["size"]: r["copies"] for r in got.groupBy("size").agg(F.avg("copies").alias("copies")).collect()}
    assert abs(copies[300] / copies[20] - 3) < 0.4      # weights 3 and 1


def test_mixing_weights_make_inclusion_unequal(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, weights=(1, 7), weight=F.when(F.col("doc_id") % 4 == 0, 3.0).otherwise(1.0)).filter("source = 'a'")
    by = {r.heavy: r.copies for r in got.groupBy((F.col("doc_id") % 4 == 0).alias("heavy")).agg(F.sum("copies").alias("copies")).collect()}
    assert 2.3 < by[True] / by[False] < 3.7


def test_chat_query_reads_back_what_went_in(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    held = collections.defaultdict(list)
    for r in turns:
        held[r.conv_id].append((r.turn, r.role, r.text or ""))
    held[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    want = {}
    for conv, own in held.items():
        own.sort()
        said = [t for _, role, t in own if role == "assistant"]
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), sum(map(len, said)),
                      hashlib.sha256("".join(said).encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op3_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_trees_rank_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.0),
            ("t", 5, 2, "user", "late", 9.0), ("u", 1, 99, "user", None, None), ("v", 1, 2, "user", "cycle", 0.0), ("v", 2, 1, "user", "cycle", 0.0),
            (None, 1, None, "user", "no tree", 0.0), ("w", None, None, "user", "no id", 0.0)]
    frame = with_clashes(spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double"))
    best = chat_format.format_trees(frame).orderBy("tree", "depth").collect()
    assert [(r.tree, r.leaf, r.depth) for r in best] == [("t", 5, 1), ("t", 5, 2), ("t", 5, 3), ("u", 1, 1)]
    every = chat_format.paths(frame, branches=None).collect()
    assert collections.Counter((r.tree, r.leaf) for r in every) == {("t", 5): 3, ("t", 4): 3, ("u", 1): 1}
    assert chat_format.format_trees(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "<\\\\||", "a<", "<\\", "\n<|im_start|>user\n", "", "plain", "<<||>>"])
def test_chat_escape_is_reversible(spark, text):
    role = f"r\\{text}\n"
    frame = spark.createDataFrame([("t", 1, None, role, text, 0.0), ("t", 2, 1, "assistant", text, 0.0)], "tree string, id long, parent long, role string, text string, score double")
    formatted = chat_format.format_trees(frame)
    assert "<|" not in "".join(r.segment for r in formatted.collect()).replace(chat_format.START, "").replace(chat_format.END, "")
    row = chat_format.read_back(formatted).first()
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.turns_sha256 == hashlib.sha256(f"{role}\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_turns_with_ties_nulls_and_long_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x"), (1, 0, "user", "a")]
    rows += [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.tree: r for r in chat_format.read_back(chat_format.format_trees(chat_format.from_turns(frame))).collect()}
    assert got["1"].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert got["2"].n_turns == 300 and got["2"].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()
    assert got["null"].n_turns == 1


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header><h2>Site</h2></header>
<ul class="m"><li><a href=/a>Home</a><li><a href=/b>News</a></ul><div class="cookie-notice">We use cookies</div>
{main}<div id="comments"><p>reader {n} says</div><form><label>Name</label><input></form><footer>&copy; site</footer></body>"""


def test_extraction_rules():
    article = PAGE.format(main="<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four<aside>ad</aside></article>", n=1)
    assert html_extract.extract(article) == "A & B\none two three\nfour"
    plain = PAGE.format(main="<div><h1>T</h1><p>body text &eacute;</p></div>", n=1)
    assert html_extract.extract(plain) == "T\nbody text é"
    assert html_extract.extract("") == "" and html_extract.extract("just text") == "just text"
    assert html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_extract.extract("<p>a <b>b</p><p>c & d < e</p><!-- x") == "a b\nc & d < e"


def test_wrapper_takes_constant_boxes_as_template(spark):
    box = '<div class="x1"><p>Our offices are open from nine to five.</p></div>'
    pages = [(i, f"https://h.example.com/{i}", f"<html><body>{box}<div><p>text number {i} differs</p><p>always</p></div></body></html>") for i in range(6)]
    pages += [(10, "https://one.example.com/", f"<body>{box}</body>"), (11, None, "<p>no url</p>"), (12, "https://h.example.com/z", None), (13, "", ""), (0, "https://h.example.com/0", pages[0][2])]
    frame = with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = collections.Counter((r.page_id, r.text) for r in html_extract.main_text(frame).collect())
    assert got == collections.Counter([(i, f"text number {i} differs\nalways") for i in (0, 0, 1, 2, 3, 4, 5)] + [
        (10, "Our offices are open from nine to five."), (11, "no url"), (12, ""), (13, "")])
    assert html_extract.main_text(frame.limit(0)).count() == 0


def main_texts(spark, bodies):
    """Texts of the pages of one host with these bodies, in their order."""
    rows = [(i, f"https://h.example.com/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_constant_siblings_of_one_signature_are_template(spark):
    text = [f"text {'abcdef'[i] * 5} of this page" for i in range(6)]
    got = main_texts(spark, [f"<p>Open nine to five.</p><p>Call us.</p><div>{t}</div>" for t in text])
    assert got == text
    boxes = '<div class="widget-1"><p>Weather is fine</p></div><div class="widget-2"><p>Shares are up</p></div>'
    assert main_texts(spark, [f"{boxes}<section>{t}</section>" for t in text]) == text
    # a box without a class beside the content, which has more kinds of children
    got = main_texts(spark, [f"<div><p>Open nine to five.</p></div><div><h1>{t}</h1><p>p {t}</p><ol><li>{t}</li></ol></div>" for t in text])
    assert got == [f"{t}\np {t}\n{t}" for t in text]


def test_wrapper_counts_all_pages_of_a_host(spark):
    # a second page type and rotating boxes, each on a few of many pages
    text = [f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 4} {i // 26} text of its own that no other page holds" for i in range(60)]
    adverts = [f'<div class="b"><p>Buy {x} today</p></div>' for x in ("soap", "tea", "ink", "rope")]
    second = "<table><tr><td>Prices</td><td>on demand</td></tr></table>"
    got = main_texts(spark, [f"{adverts[i % 4]}<div><p>{t}</p></div>{second if i % 5 == 0 else ''}" for i, t in enumerate(text)])
    assert got == text


def test_near_copies_are_one_page(spark):
    words = [[f"{x}{y}" for y in "abcdefghijklmnopqrstuvwxyz"] for x in ("one", "two", "six")]
    article = [f'<div class="t"><h1>{" ".join(w[:4])}</h1><section><p>{" ".join(w)}</p><p>{" ".join(w[::-1])}</p></section></div>' for w in words]
    lines = [f"{' '.join(w[:4])}\n{' '.join(w)}\n{' '.join(w[::-1])}" for w in words]
    assert main_texts(spark, ["", "<script>x</script>", "<hr>"]) == ["", "", ""]
    # one article under several dates only, and beside other articles
    assert main_texts(spark, [f"{article[0]}<p>{d}</p>" for d in ("May 1", "May 2", "June 3", "July 4")]) == [
        f"{lines[0]}\n{d}" for d in ("May 1", "May 2", "June 3", "July 4")]
    box = '<div class="x"><p>Open nine to five</p></div>'
    assert main_texts(spark, [f"{box}{article[k]}<p>{d}</p>" for k, d in ((0, "May 1"), (0, "May 2"), (0, "June 3"), (1, "July 4"), (2, "May 5"))]) == [
        f"{lines[k]}\n{d}" for k, d in ((0, "May 1"), (0, "May 2"), (0, "June 3"), (1, "July 4"), (2, "May 5"))]


def test_varying_slots_outside_of_articles_are_text(spark):
    text = [f"{'abcdef'[i] * 5} is the main text of this page" for i in range(6)]
    cards = '<article class="card"><p>Read on: Prices</p></article><article class="card"><p>Read on: Jobs</p></article>'
    assert main_texts(spark, [f"{cards}<div><p>{t}</p><p>more of {t}</p></div>" for t in text]) == [f"{t}\nmore of {t}" for t in text]
    got = main_texts(spark, [f"<article class='post has-comments'><header><h1>{t}</h1></header><p>p {t}</p></article><div><p>after {t}</p></div>" for t in text])
    assert got == [f"{t}\np {t}\nafter {t}" for t in text]


STORY = [" ".join(f"s{i}w{j}" for j in range(40)) for i in range(60)]


def test_versions_of_a_story_keep_its_text(spark):
    # a passage that two versions of one story share among 18 other stories, and 50 stories of two versions each
    shared = " ".join(f"both{j}" for j in range(30))
    bodies = [f"<article><section><p>{t}</p></section></article>" for t in STORY[:18]]
    bodies += [f"<article><section><p>{shared}</p></section><p>{t}</p></article>" for t in STORY[18:20]]
    want = [*STORY[:18], *(f"{shared}\n{t}" for t in STORY[18:20])]
    assert main_texts(spark, bodies) == want
    ids = [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    ends = [" ".join(f"e{i}x{k}y{j}" for j in range(20)) for i in range(50) for k in range(2)]
    bodies = [f'<div id="{ids[i // 2]}"><section><p>{STORY[i // 2]}</p></section></div><p>{t}</p>' for i, t in enumerate(ends)]
    assert main_texts(spark, bodies) == [f"{STORY[i // 2]}\n{t}" for i, t in enumerate(ends)]
    # a host of two versions of one story only
    assert main_texts(spark, [f"<section><p>{STORY[0]}</p></section><p>{t}</p>" for t in ("one end", " ".join(STORY[1].split()[:12]))]) == [
        f"{STORY[0]}\none end", f"{STORY[0]}\n{' '.join(STORY[1].split()[:12])}"]


def test_names_do_not_drop_the_element_that_holds_the_text(spark):
    text = STORY[0]
    for around in ('<div class="elementor-widget-container">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="post has-comments">{}</div>',
                   '<div class="legal-article">{}</div>', '<div id="main" class="share-holder-news">{}</div>', '<form id="aspnetForm">{}</form>',
                   '<div class="widget"><div class="widget-inner"><div class="promo">{}</div></div></div>'):
        page = '<body><nav>Home News</nav><div class="menu">Home About</div>' + around.format(f"<p>{text}</p>") + '<div class="comments"><p>reader says</p></div></body>'
        assert html_extract.extract(page) == text, around
        pages = [page.replace(text, t) for t in STORY[:6]]
        assert main_texts(spark, pages) == STORY[:6], around
        break_at = page.replace("reader says", STORY[1] + " " + STORY[2])   # long comments are still comments
        assert html_extract.extract(break_at) == text, around
    assert html_extract.extract(f'<body><p>{text}</p><div class="sidebar"><p>Prices</p></div><form>Sign in <input></form></body>') == text


@pytest.mark.parametrize("depth", [117, 118, 119, 125, 3000])
def test_nothing_leaks_or_is_lost_at_any_depth(depth):
    inner = "<p>one</p><nav><a>Home</a> About</nav>two<form>Contact <input>Sign in</form><script>x()</script><div>three <b>four</b></div><aside><div>ad</div></aside>five"
    assert html_extract.extract("<div>" * depth + inner + "</div>" * depth + "<p>after</p>") == "one\ntwo\nthree four\nfive\nafter"


def test_wrapper_size_does_not_grow_with_the_pages(spark):
    sizes = []
    for n in (50, 200):
        rows = [(i, f"https://h.example.com/{i}", f'<body><div class="a"><p>Open nine to five</p></div><div class="b"><p>Buy {i % 7}</p></div>'
                 f'<div class="c{i % (n // 2)}x"><p>part {i % (n // 2)}</p></div><div><p>{i} {STORY[i % 60]} {i}</p></div></body>') for i in range(n)]
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        (row,) = html_extract.wrappers(frame).collect()
        sizes.append(len(row.wrapper))
    assert sizes[1] <= sizes[0]


def test_a_very_long_page_is_read_whole():
    blocks = [f"block {i} of the page" for i in range(60_000)]
    assert html_extract.extract("<body><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div></body>") == "\n".join(blocks)


def test_comment_and_promo_articles_are_no_text():
    page = '<body><article class="{0}"><p>reader says</p></article><article class="post has-comments"><p>the text</p></article>'
    for name in ("comment", "promo", "comment-body", "card ad"):
        assert html_extract.extract(page.format(name)) == "the text"
        assert html_extract.extract(page.format(name), ["#", [], []]) == "the text"


def test_tree_matching_counts_the_best_alignment():
    a = ["div", "", [["p", "", []], ["ul", "", [["li", "", []]]], ["p", "", []]]]
    b = ["div", "", [["ul", "", [["li", "", []]]], ["p", "", []], ["table", "", []]]]
    assert [x[0] for x, _ in html_extract.match(a, b)].count("li") == 1 and len(html_extract.match(a, b)) == 4


def test_extraction_of_the_smoke_pages(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in op8_html_extract(spark, SF).collect()}
    assert got.keys() == raw.keys()
    for page_id, html in raw.items():
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = (" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[page_id].text == "\n".join(b for b in blocks if b) and got[page_id].n_chars == len(got[page_id].text)


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    unique = stages["near_duplicates"](spark, good, SF)
    groups = components_brute(rows)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(d for d, (n, top) in groups.items() if not n or d == top)
    clean = stages["decontamination"](spark, unique, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(unique, bench).filter("contaminated").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - bad
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns
    out = stages["token_output"](spark, mixed, SF)
    assert out.count() == mixed.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_stages_on_edges(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "a plain sentence of well more than ten words that says nothing of any use to anyone"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (None, text + " again", None, None, None)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        frame = with_clashes(frame)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() >= 0 and (name == "token_output" or out.columns == frame.columns)


def test_turns_are_ordered_by_whole_texts_in_ranges_of_their_beginnings(spark):
    rng = random.Random(5)
    same = "b" * chat_format.RANGE_CHARS
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1]), rng.choice([None, "user", same + "x", same]), rng.choice([None, "", "a", same, same + "a", same + "b", "c" * 100_000]))
            for _ in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat_format.from_turns(with_clashes(frame)).collect()
    key = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    for tree in ("1", "2", "null"):
        own = sorted((r for r in got if r.tree == tree), key=lambda r: r.id)
        assert [(r.role, r.text) for r in own] == [r[2:] for r in sorted((r for r in rows if ("null" if r[0] is None else str(r[0])) == tree), key=lambda r: key(r[1:]))]
        assert [r.parent for r in own] == [None, *(r.id for r in own[:-1])]
    assert chat_format.from_turns(frame.filter("false")).collect() == []
