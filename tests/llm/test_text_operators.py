"""Line dedup, secret scan, quality, language and token store: brute force on the smoke tables and edge cases."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicata.llm import language_id, line_dedup, quality, secret_scan, token_store
from indicata.llm.queries import VOCABULARY, op2_secret_scan, op9_token_store, tokenizer_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
LINE = "this line is long enough to be seen as one that repeats"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, f"{LINE}\na", "en", "s"), (2, f"  {LINE.upper()}\t\nb", "en", None), (3, f"{LINE}\n{LINE}", None, "s"), (4, LINE, "fr", "s"),
    (5, f"x\n{LINE}", "fr", "s"), (None, LINE, "en", "s"), (None, None, None, None), (6, None, "en", "s"), (7, "", "en", "s"), (8, LONG, "en", "s"),
    (8, LONG, "en", "s"), (8, "another text under the same id", "en", "s"), (9, "\n\n", "de", "s"), (10, "1234 5678", "de", "s"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns that clash with helper names."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in ("tie", "kept", "n_words", "llr", "_id", "_tie", "h1", "spans", "doc", "c0", "rank", "score", "payload"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lines_brute(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(doc_id)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def test_line_dedup_matches_brute_force(edge, documents):
    for docs in (edge, documents.select("doc_id", "text")):
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
        want = lines_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == want


def test_line_dedup_settles_runs_that_cross_partitions(spark):
    rows = [(i, f"{LINE}\nown {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_dropped for r in line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: int(i != 199) for i in range(200)}


def test_keep_bitmap_is_compressed_bits(edge):
    row = line_dedup.keep_bitmaps(edge).filter("doc_id = 3").first()
    assert row is None or row.n_lines >= row.n_dropped
    row = line_dedup.keep_bitmaps(edge).filter("doc_id = 1").first()
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bytes(row.bitmap)), np.uint8), count=row.n_lines)
    assert bits.tolist() == [0, 1]


def test_secret_spans(spark, edge):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = [
        'Password = "hunter2x" and api_key: abc', f"see {key} here", "0123456789abcdef01234567 is a digest",
        'const seed = "k9Q!x7Lp2Vz4";\nclient.db_password = seed', "<clientSecret>zX81-qq07-LLm2</clientSecret>", "tool --auth-token q7w8e9r0t1y2",
        "password_length = 12\ntoken_count: 400", "the secret of it: patience", "ſecret = abcdefgh",
    ]
    got = [r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    spans = [[(texts[i][s.start:s.end], s.kind) for s in r.spans] for i, r in enumerate(got)]
    assert spans[0] == [('Password = "hunter2x', "assign")]
    assert spans[1] == [(key, "access")]
    assert spans[2] == [("0123456789abcdef01234567", "hex")]
    assert ("k9Q!x7Lp2Vz4", "literal") in spans[3]
    assert ("zX81-qq07-LLm2", "literal") in spans[4]
    assert any(kind in ("literal", "assign") for _, kind in spans[5])
    assert spans[6] == [] and spans[8] == []
    assert got[0].base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest()
    out = secret_scan.scan(edge).collect()
    assert len(out) == len(ROWS) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)


def found_secrets(spark, texts):
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [[(texts[r.doc_id][s.start:s.end], s.kind) for s in r.spans] for r in rows]


def test_secret_literals_beyond_a_base_span_are_reported(spark):
    digits = "0123456789abcdef01234567"
    got = found_secrets(spark, ['password = "S3cret!pass#word"', f'client_secret = "Xy-{digits}-Zw!9"', 'password = "S3cretpass"'])
    assert got[0] == [('password = "S3cret', "assign"), ("S3cret!pass#word", "literal")]
    assert (f"Xy-{digits}-Zw!9", "literal") in got[1] and (digits, "hex") in got[1]
    assert got[2] == [('password = "S3cretpass', "assign")]


@pytest.mark.parametrize("text, literals", [
    (f'secret_{"a" * 122} = "S3cr3tValue99x"', ["S3cr3tValue99x"]), (f'secret_{"a_" * 5000}x = "S3cr3tValue99x"', ["S3cr3tValue99x"]),
    ('password = "$ecret!Pass99"', ["$ecret!Pass99"]), ('secret = "(8xQ!zz91)"', ["(8xQ!zz91)"]), ('password = """tr1ple!\nQuoted9"""', ["tr1ple!\nQuoted9"]),
    ('passphrase = "correct horse battery staple"', ["correct horse battery staple"]), ('password = "Enter your password here"', []),
    ("postgres://admin:hunter2!xy@db/x", ["hunter2!xy"]), ("postgres://admin:${PASSWORD}@db/x", []),
    ("token = self.get_token(user)", []), ('password = getpass.getpass("Enter it 99x!")', []), ("secret = config.read(x)", []), ("secret = os.environ['X9!abcdef']", []),
    ('password = "S3cr3t!" + "morePart99"', ["S3cr3t!", "morePart99"]), ('password = ("S3cr3t!"\n)', []), ('password = u"S3cr3t!99" "more77"', ["S3cr3t!99", "more77"]),
    ('PREFIX = "ab"\nsecret_token = PREFIX + "Cd3!efgh9"', ["ab", "Cd3!efgh9"]), ('k = "Zq8!kkWw91"\npassword = k', ["Zq8!kkWw91"]),
    ("password: |\n  Zq8!kkWw91abc\n  d\nnext: 1", ["Zq8!kkWw91abc\n  d"]), ('"password": "${DB_PASSWORD}"', []), ("password=<your password>", []),
    ('connect(db, password="Zq8!kkWw91", user=u)', ["Zq8!kkWw91"]), ('x = {"secret": "Zq8!kkWw91", "b": 1}', ["Zq8!kkWw91"]), ('token := `Zq8!kkWw91`', ["Zq8!kkWw91"]),
    ('conn = "Server=x;Password=abc!12345;x"', ["abc!12345"]), ("", []), ("password =", []), ('password = "', [])])
def test_lexed_literals(text, literals):
    assert [text[a:b] for a, b, _ in secret_scan.literal_spans(text)] == literals


@pytest.mark.parametrize("text", ["secret " + "a" * 400_000, "secret " + "a=" * 150_000, "secret " + 'a="' * 50_000, 'secret="""' * 20_000, "secret <a>" * 40_000,
                                  "secret ://a:" * 40_000 + "@", "secret: |\n" * 20_000, "secret=" + "a.b(" * 50_000, 'secret="a"+' * 20_000])
def test_lexing_takes_linear_time(text):
    began = time.time()
    secret_scan.literal_spans(text)
    assert time.time() - began < 10


def test_base_spans_against_brute_force(spark, documents):
    """All documents of the smoke tables, and texts that hold every kind: the rules as they are written."""
    def brute(text):
        found = [(m.start(), m.end(), "assign") for m in re.finditer(
            r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
        found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        order = ["assign", "access", "hex"]
        return [f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], order.index(x[2])))]

    extra = [(10 ** 6, "token: abcdef password='q' secret=abcdefg AKIA" + "Z" * 16 + " " + "0f" * 12 + " apikey = tokens/abc.def"), (10 ** 6 + 1, None), (10 ** 6 + 2, "")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = secret_scan.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.span_text.split(",")) if want else True


def test_secret_values_and_names_of_any_length(spark):
    value = "".join(hashlib.sha256(str(i).encode()).hexdigest().upper() for i in range(160))[:10_000] + "xyz"
    name = "a" * 80 + "Password"
    got = found_secrets(spark, [
        f"<clientSecret>{value}</clientSecret>", f"tool --auth-token {value} x", f"signing_key = '{value}'", f"credential: {value}",
        f"<{name}>zX81-qq07-LLm2</{name}>", f"tool --{'a' * 80}-token zX81-qq07-LLm2"])
    assert [(value, "literal") in spans for spans in got[:4]] == [True] * 4
    assert [("zX81-qq07-LLm2", "literal") in spans for spans in got[4:]] == [True] * 2
    assert found_secrets(spark, ["-a" * 500 + "-token = zX81-qq07-LLm2"]) == [[("token = zX81-qq07-LLm2", "assign")]]
    assert found_secrets(spark, ["-a" * 500 + "-pwd = zX81-qq07-LLm2"]) == [[("zX81-qq07-LLm2", "literal")]]


def test_secret_lexer_takes_long_runs_in_linear_time():
    for text in ("-a" * 100_000, "-a" * 100_000 + " ;", "<a" * 100_000, "a-" * 100_000 + '"', "-a" * 100_000 + " = ;"):
        began = time.process_time()
        assert secret_scan.literal_spans(text + "\nkey=1") == []
        assert time.process_time() - began < 5


def test_secret_query_keeps_every_document(spark, documents):
    rows = op2_secret_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())


def quality_brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def invented(letters, rng, bad=False):
    """Text of words of 2 to 6 of the letters; bad text has marks strewn in and one run of letters again and again."""
    words = ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(60)]
    return " ".join(f"{w}##" if k % 2 else letters[:4] for k, w in enumerate(words)) if bad else " ".join(words) + "."


def test_quality_of_other_scripts(spark):
    rng = np.random.default_rng(3)
    latin, russian = "abcdefghijklmnoprstuvw", "абвгдежзийклмнопрстуф"
    chinese = "".join(chr(0x4E00 + k) for k in range(40))
    # a third of the rows in another script, of which one or no row is labelled
    for letters in (russian, chinese):
        texts = [invented(letters if k % 3 == 0 else latin, rng) for k in range(300)]
        docs = spark.createDataFrame([(k, t, "x", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
        for good in ([k for k in range(300) if k % 3 and k % 2], [0, *(k for k in range(300) if k % 3 and k % 2)]):
            labels = spark.createDataFrame([(k, 1, 0) for k in good], "doc_id long, quality int, toxic int")
            assert all(r.kept for r in quality.score(docs, labels).collect())
    # good and bad are told apart within a script
    bad = [k % 4 == 0 for k in range(300)]
    docs = spark.createDataFrame([(k, invented(chinese, rng, x)) for k, x in enumerate(bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150) if not bad[k]], "doc_id long, quality int, toxic int")
    llr = {r.doc_id: r.llr for r in quality.score(docs, labels).collect()}
    assert max(llr[k] for k in range(300) if bad[k]) < quality.THRESHOLD < 0 < min(llr[k] for k in range(300) if not bad[k])


def test_quality_shapes_are_of_code_points():
    read = quality.reader()
    for one, other in (("l'été où ça", "l'ete ou ca"), ("one\u00a0two, three", "one two, three"), ("“ab cd” ef", '"ab cd" ef')):
        assert read([one.encode()])[1].tolist() == read([other.encode()])[1].tolist()
    assert read(["中文，中文。中文".encode()])[1].tolist() != read(["中文中中文文中文".encode()])[1].tolist()


def test_quality_counts_and_verdict(spark, edge, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for docs in (edge, documents):
        got = quality.score(docs, labels).drop("llr").collect()
        texts = collections.Counter(quality_brute(r.text) for r in docs.select("text").collect())
        assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    kept = quality.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.filter("tie <> 'clash'").count() == 0


def test_quality_follows_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = quality.score(docs, labels).join(labels, "doc_id").filter("not base_failed")
    good, bad = (told.filter(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.1


def test_quality_without_labels_keeps_by_base_rules(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(documents, labels).filter("kept = base_failed").count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.98


def test_language_edges(spark, edge):
    got = language_id.identify(edge).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id in (6, 7, 9, 10)}
    assert set(by_id.values()) == {"und"}
    nothing = language_id.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(edge.limit(0)).count() == 0
    assert [r.held_out for r in got if r.doc_id == 1] == [zlib.crc32(b"1") % 4 == 2]


def test_token_store_equals_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    want = []
    for r in documents.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op9_token_store(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_frequent_pieces_outlive_a_full_memory(monkeypatch):
    import tokenizers
    monkeypatch.setattr(token_store, "REMEMBERED", 60)
    monkeypatch.setattr(tokenizers, "_piece_encoders", {}, raising=False)
    encoder, whole = token_store.PieceEncoder(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())
    for k in range(12):
        texts = [f"Often, seen word{k}x, caf\u00e9{k}... {chr(97 + k) * 3}q. it's", "", "A <|endoftext|>", "\u0130stanbul " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(20))]
        got = [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode([t.encode() for t in texts])]
        assert got == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts], k
        assert len(encoder.known) <= 120
    encoder.known.clear()
    encoder.pool.clear()
    for part in ("a", "b"):
        encoder.encode([("often, " + " ".join(part + chr(97 + j) * 2 for j in range(26)) + " " + " ".join(part + chr(97 + j) * 3 for j in range(26))).encode()])
    assert encoder.encode([b"other often,"])[0] == encoder.encode([b"other"])[0][:-4] + encoder.encode([b"often,"])[0]
    assert b"often," in encoder.known and b"other" in encoder.known and len(encoder.known) < 10   # what came once made room


def test_token_store_edges(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    odd = ["É.,", "x'S. it's", "<|endoftext|>. A", "<|ENDOFTEXT|>", "word.́ x", "İI ΑΣ. ΑΣ", "\x1c.a\x85b c.", "日本語。 ab。.", "a\x00b.", "ab'.", "éé", "Σ Ñ."]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    blocks = token_store.write_store(docs, tokenizer_path(), VOCABULARY, str(tmp_path / "store"))
    got = token_store.read_store(blocks).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert len(got) == len(ROWS) + len(odd) and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    for i, text in enumerate(odd):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert token_store.read_document(blocks, 100 + i) == ids, text
    assert token_store.read_document(blocks, 6) == [1] and token_store.read_document(blocks, 12345) == []
    assert token_store.read_store(token_store.write_store(docs.limit(0), tokenizer_path(), VOCABULARY)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = token_store.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert token_store.unpack(packed, bits, 0, 1000).tolist() == ids.tolist()
    assert token_store.unpack(packed, bits, 333, 41).tolist() == ids[333:374].tolist()
    assert token_store.bits_for(1 << bits) == bits


def test_language_sample_is_bounded_whatever_the_labels(spark):
    rows = [(k, f"text {k} of a junk label", f"j{k % 3000:04d}", "s") for k in range(9000)] + [(10_000 + k, f"the good text {k}", "en", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language_id.sample(docs).groupBy("lang").count().collect()
    assert sum(r["count"] for r in got) <= language_id.IN_ALL and len(got) <= language_id.LANGUAGES and max(r["count"] for r in got) <= language_id.IN_ALL // language_id.LANGUAGES
    assert "en" in {r["lang"] for r in got}
    model = language_id.fit(docs, in_all=60, languages=20)
    assert len(model.families) + len(model.pairs) <= 20 and model.weights.shape[1] == len(model.bias)
    # one id repeated by many rows is one vector
    same = spark.createDataFrame([(1, f"text number {k}", "en", "s") for k in range(500)], "doc_id long, text string, lang string, source string")
    assert language_id.fit(same).families == ["germanic"]


def test_language_votes_against_brute_force(spark, documents):
    """Frequencies counted n-gram by n-gram, margins as sums of products, every pair of the best family votes."""
    docs = documents.select("doc_id", "text", "lang").limit(60)
    model = language_id.fit(documents)
    want = {}
    for doc_id, text, _ in docs.collect():
        if text is None or not any(c.isalpha() for c in text):
            want[doc_id] = "und"
            continue
        data = text.lower().encode()
        margins = model.bias.astype(float).copy()
        for k, n in enumerate(language_id.GRAMS):
            grams = collections.Counter(data[i:i + n] for i in range(len(data) - n + 1))
            for gram, count in grams.items():
                (bucket,) = language_id.gram_buckets(np.frombuffer(gram, np.uint8), n, language_id.BITS)
                margins += model.weights[(k << language_id.BITS) + int(bucket)] / language_id.SCALE * count / max(1, sum(grams.values()))
        family = model.families[int(np.argmax(margins[:len(model.families)]))]
        votes = collections.Counter({code: 0.0 for code in model.members[family]})
        for (one, other), margin in zip(model.pairs, margins[len(model.families):]):
            if one in votes:
                chance = 1 / (1 + np.exp(-margin))
                votes[one if margin > 0 else other] += 1
                votes[one] += 1e-3 * chance
                votes[other] += 1e-3 * (1 - chance)
        want[doc_id] = max(sorted(votes), key=votes.get)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()} == want
