"""Operators on single texts against brute force, round trips and the public libraries."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from rankloom.llm import bpe, counts, decontaminate, language, lattice, quality, secret_scan
from rankloom.llm.queries import BYTE_BPE, PIECES

SCHEMA = "doc_id long, text string, lang string, score string, TEXT2 string"


def docs(spark, *texts):
    """Documents with an extra column whose name an operator's result has too."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts)], SCHEMA)


ODD = (None, "", " \n\t", "a", "é日本 😀", "x" * 70_000, "same text", "same text")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(BYTE_BPE)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(BYTE_BPE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, alphabet="abcdeeetthhan  \n.,'é日ж😀12", size=60, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, size))) for _ in range(n)]


def test_bpe_equals_the_library(spark, vocabulary, library):
    texts = [*(t or "" for t in ODD), *random_texts(300), "aaaa" * 50 + "don't   stop\n\n"]
    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    rows = {r.doc_id: r for r in bpe.encode(docs(spark, *texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(docs(spark, None), path, pattern).first().n_tokens == 0
    assert bpe.encode(docs(spark).limit(0), path, pattern).count() == 0


def test_bpe_appends_and_edits(vocabulary):
    draw = random.Random(4)
    for text in random_texts(60, "abcdethn", 200, 3):
        data = bytearray(text.encode())
        table = bpe.Prefixes(vocabulary, bytes(data))
        before = list(table.last)
        table.append(b"there")
        assert table.last[: len(before)] == before
        data += b"there"
        a = draw.randint(0, len(data))
        b = draw.randint(a, min(len(data), a + 5))
        table.replace(a, b, b"xyz")
        data[a:b] = b"xyz"
        assert table.data == data and table.last == bpe.Prefixes(vocabulary, bytes(data)).last


def test_edit_far_from_the_end_is_local(vocabulary):
    table = bpe.Prefixes(vocabulary, b"theretohere" * 500)
    assert table.replace(10, 12, b"zz") < 200


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path(PIECES)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    scores = counts.raised({p.piece: p.score for p in proto.pieces if p.type == 1})
    for p in proto.pieces:
        p.score = scores.get(p.piece, p.score)
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [*(t or "" for t in ODD if len(t or "") < 1000), *random_texts(400, seed=5), "the theatre of the thing\n\n the"]
    rows = {r.doc_id: r.n_tokens for r in counts.token_counts(docs(spark, *texts), path).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == sum(len(model.encode(line)) for line in t.split("\n")) + t.count("\n"), t
    assert counts.token_counts(docs(spark, None), path).first().n_tokens == 0


def test_count_ties_go_to_the_longer_last_piece():
    u = counts.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁ab": -3.0, "▁a": -2.0})
    assert u.count("ab") == 1 and u.count("ba") == 3 and u.count("é") == 1 + 2


def brute_word(word, p):
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum(total[i] * p.get(word[i:end], 0.0) for i in range(end))
    return total[-1]


def test_lattice_sums_all_segmentations():
    pieces = lattice.first_distribution([(b" a", -1.0), (b"ab", -2.0), (b"bc", -3.0), (b" abc", -4.0), (b"a b", -5.0), (b" ", -6.0)])
    p = dict(zip(pieces.strings, np.exp(pieces.log_p)))
    assert abs(sum(p.values()) - 1) < 1e-12
    words = [b"abc", b"a", b"\xc3\xa9abab", b"abcabcabc", b"abc" * 30]
    log_p, expected = pieces.log_probs(words, np.array([2.0, 1, 1, 1, 1]))
    assert np.allclose(log_p, [np.log(brute_word(b" " + w, p)) for w in words])
    # The expected bytes of all segmentations are the bytes of the words.
    length = sum(e * len(s) for e, s in zip(expected, pieces.strings))
    assert abs(length - sum(c * (len(w) + 1) for c, w in zip([2, 1, 1, 1, 1], words))) < 1e-6


def test_lattice_scores(spark):
    texts = [None, "", "The the  cat\n", "the cat sat", "dog", "the cat sat", *random_texts(20)]
    for head in (lattice.HEAD, 2, 0):
        train = docs(spark, *texts[1:5])
        model = lattice.train(train, public_tokenizers.path(PIECES), head)
        rows = {r.doc_id: r for r in lattice.score(docs(spark, *texts), model).collect()}
        seen = collections.Counter(w for t in texts[1:5] for w in (*lattice.words_of(t), b" "))
        n, v = sum(seen.values()), len(seen)
        for i, t in enumerate(texts):
            tokens = [*lattice.words_of(t or ""), b" "]
            base = sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            assert rows[i].n_tokens == len(tokens) and rows[i].n_known == sum(seen[w] > 0 for w in tokens)
            assert rows[i].train_tokens == n and abs(rows[i].base_score - base) < 1e-9
            words = model.pieces.log_probs(tokens[:-1])[0].sum() if tokens[:-1] else 0.0
            assert abs(rows[i].score - (words + model.pieces.end_log_p) / np.log(10)) < 1e-9
    empty = lattice.train(docs(spark).limit(0), public_tokenizers.path(PIECES))
    assert lattice.score(docs(spark, "a b"), empty).first().base_score == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_contamination_against_brute_force(spark):
    draw = random.Random(9)
    items = ["the quick brown fox jumps", "over  the LAZY dog again", "", None, "zz"]
    texts = []
    for k in range(40):
        t = list(draw.choice(items[:2]))
        for _ in range(draw.randint(0, 5)):
            t[draw.randrange(len(t))] = draw.choice("abc ")
        texts.append("".join(random_texts(1, "abcdefg ", 30, k)) + "".join(t) + " tail")
    texts += [None, "", "nothing here", items[0].upper(), "ab zz"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 10):
        found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(docs(spark, *texts), benchmark, 0.1, block).collect()}
        for i, t in enumerate(texts):
            plain = decontaminate.normal(t or "")
            for k, item in enumerate(items):
                item = decontaminate.normal(item or "")
                e = int(len(item) * 0.1)
                best = min((edit_distance(item, plain[a:b]) for a in range(len(plain)) for b in range(a, min(len(plain), a + len(item) + e) + 1) if b - a >= len(item) - e), default=99)
                assert found.get((i, k)) == (best if item and best <= e else None)


def test_contamination_places(spark):
    benchmark = spark.createDataFrame([(7, "Some benchmark item text")], "item_id long, text string")
    row = decontaminate.contaminated(docs(spark, "é  x\n\nsome   BENCHMARK item text."), benchmark).first()
    assert "é  x\n\nsome   BENCHMARK item text."[row.start : row.end] == "some   BENCHMARK item text"
    assert decontaminate.contaminated(docs(spark, "abc"), benchmark.limit(0)).count() == 0


def brute_spans(text):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24))
    out = []
    for place, (kind, pattern, least) in enumerate(kinds):
        out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_base_spans(spark):
    texts = ['é API_KEY: "abcdef123" secret=token: abcdefgh', "token=ab token=abcdef", "AKIA" + "A1" * 8 + " AKIASHORT", "0123456789abcdef" * 2, "password = 'x' passwd:y.z/=_",
             "tokenTOKEN=abcdef==", None, "", "apikey=AKIA" + "B2" * 10, *random_texts(200, "token=:ab'\" 0f", 60, 8)]
    rows = {r.doc_id: r for r in secret_scan.scan(docs(spark, *texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == brute_spans(t or "")
        assert {tuple(s) for s in rows[i].base} <= {tuple(s) for s in rows[i].spans}


def test_random_tokens_are_found_and_words_are_not(spark):
    draw = random.Random(11)
    secret = ["".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(40)]
    plain = ["thethethe1thethethe2thethethe3", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "version_1_of_the_document_version_2_of", "4929348385146306", "zbzbzbzbzbzbzbzbzbzbzbzb12"]
    texts = [f"x {s} y" for s in secret] + [f"x {p} y" for p in plain] * 8
    rows = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, *texts)).collect()}
    assert sum(any((s.start, s.end) == (2, 42) for s in rows[i]) for i in range(40)) >= 37
    assert all(not rows[i] for i in range(40, len(texts)))


def test_random_values_behind_names_and_paths_are_found(spark):
    draw = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    forms = ("client_key={}", "auth={}", "SharedAccessSignature=sv/2020-08-04/{}", "https://a.b/c?sig={}&x=1", "export KEY={}", "a==b={}==", "some-path/of_it/{}", "x-y+{} end")
    made = [(f, "".join(draw.choice(letters + "0123456789") for _ in range(40))) for f in forms for _ in range(10)]
    made += [("auth={}", "".join(draw.choice("0123456789ABCDEF") for _ in range(40))) for _ in range(10)]
    texts = [f.format(v) for f, v in made]
    rows = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, *texts)).collect()}
    for form in dict.fromkeys(f for f, _ in made):
        own = [i for i, (f, _) in enumerate(made) if f == form]
        pad = 2 if form.endswith("==") else 0
        found = [any((s.start, s.end) == (form.index("{"), form.index("{") + 40 + pad) for s in rows[i]) for i in own]
        assert sum(found) >= 0.8 * len(own), form


def test_battery_follows_its_definition(spark):
    """The three statistics and their combination against plain numpy, for each encoding."""
    draw = random.Random(31)
    letters = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789"}
    tokens = [(e, "".join(draw.choice(a) for _ in range(draw.randint(20, 60)))) for e, a in letters.items() for _ in range(20)]
    tokens += [("base36", "user1table2chapter6name"), ("base36", "a" * 30 + "1"), ("base36", "1a" * 20)]

    def two_sided(z):
        x = abs(z)
        return x * x / (2 * np.log(10)) - np.log10(4 / np.sqrt(2 * np.pi) / (x + np.sqrt(x * x + 8 / np.pi)))

    def plain(encoding, token):
        x = np.array([ord(c) for c in token.lower()], float)
        n, a = len(token), secret_scan.ALPHABET[encoding]
        pairs, every = sum(v * (v - 1) / 2 for v in collections.Counter(token).values()), n * (n - 1) / 2
        even = (pairs - every / a) / np.sqrt(every / a * (1 - 1 / a))
        digit = np.array([c.isdigit() for c in token])
        ones, zeros = digit.sum(), n - digit.sum()
        mean = 2 * ones * zeros / n
        variance = mean * (2 * ones * zeros - n) / (n * (n - 1))
        runs = ((digit[1:] != digit[:-1]).sum() - mean) / np.sqrt(variance) if variance > 0 else 0.0
        off = x - x.mean()
        serial = (off[1:] * off[:-1]).sum() / (off**2).sum() * np.sqrt(n)
        return max(max(two_sided(max(even, 0.0)), two_sided(runs), two_sided(serial)) - np.log10(3), 0.0)

    table = spark.createDataFrame(tokens, "e string, t string")
    for r in table.select("*", secret_scan.battery(F.col("t"), F.col("e")).alias("p")).collect():
        assert r.p == pytest.approx(plain(r.e, r.t), rel=1e-9, abs=1e-9)


def test_thresholds_bound_both_sides():
    rows = lambda p: list(collections.Counter(int(-np.log10(x) * secret_scan.STEPS) for x in p).items())
    draw = np.random.default_rng(5)
    spread = np.minimum(3 * draw.random((400, 3)).min(1), 1.0)
    # Random tokens alone: nearly all are kept. A lone token is kept.
    limit = secret_scan.ordinary_from(rows(spread))
    assert limit is None or (spread > 10 ** (-limit / secret_scan.STEPS)).mean() > 0.9
    assert secret_scan.ordinary_from([(10, 1)]) is None
    # Ordinary tokens with middling p-values beside them: few of these are kept.
    ordinary = 10 ** -draw.uniform(0.4, 2.5, 400)
    limit = secret_scan.ordinary_from(rows(np.concatenate([spread, ordinary])))
    kept = lambda p: (np.floor(-np.log10(p) * secret_scan.STEPS) < limit).sum()
    assert kept(ordinary) <= 0.1 * (kept(ordinary) + kept(spread)) and kept(spread) > 100


def test_texts_with_very_many_matches(spark):
    """A key list of 16,000 hex strings: places by blocks are right, and the mask hides each."""
    draw = random.Random(41)
    keys = ["".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(16_000)]
    text = "é " + ", ".join(keys) + " end"
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secret_scan.scan(table).first()
    assert [(s.kind, s.start, s.end) for s in row.base] == [("hex", 2 + 34 * i, 34 + 34 * i) for i in range(16_000)]
    assert len(row.spans) == len(set(row.spans)) and {(s.start, s.end) for s in row.spans} == {(s.start, s.end) for s in row.base}
    assert secret_scan.redact(table).first().text == "é " + ", ".join(["[secret]"] * 16_000) + " end"


def test_padding_ends_a_token(spark):
    whole = "Zx9k+Qm2/Lp7vRt4Ws8yBn3c=="
    texts = [f"x {whole} y", f"name={whole}", f"{whole[:-2]}=name", "a1b2c3d4e5f6g7h8==i"]
    found = docs(spark, *texts).select("doc_id", secret_scan.matches(F.col("text"), secret_scan.TOKEN, F.lit(True)).alias("m"))
    got = {r.doc_id: [m.value for m in r.m] for r in found.collect()}
    assert got == {0: [whole], 1: [whole], 2: [whole[:-2]], 3: ["a1b2c3d4e5f6g7h8"]}


def test_redaction_keeps_rows_and_columns(spark):
    rows = docs(spark, None, "", "clean", "é token=abcdef0123 and secret: xyzxyz1 end").withColumn("n_chars", F.length("text").cast("long")).withColumn("base", F.lit(1))
    out = secret_scan.redact(rows)
    assert out.columns == rows.columns and out.schema.simpleString() == rows.schema.simpleString()
    assert [r.text for r in out.orderBy("doc_id").collect()] == [None, "", "clean", "é [secret] and [secret] end"]
    assert out.where("doc_id = 3").first().n_chars == len("é [secret] and [secret] end")


def brute_viterbi(scores, switch):
    value, back = scores[0], []
    for row in scores[1:]:
        move = value[None, :] - switch * (1 - np.eye(len(value)))
        back.append(move.argmax(1))
        value = move.max(1) + row
    return value.max(), back


def test_viterbi_is_the_optimum():
    draw = np.random.default_rng(2)
    length = [1, 5, 64, 65, 200, 128]
    text = np.repeat(np.arange(len(length)), length)
    scores = draw.normal(size=(len(text), 3)).astype(np.float32) * 3
    labels = language.best_labels(scores, text, 2.0)
    for i in range(len(length)):
        own = np.flatnonzero(text == i)
        value = scores[own, labels[own]].sum() - 2.0 * (np.diff(labels[own]) != 0).sum()
        assert abs(value - brute_viterbi(scores[own].astype(float), 2.0)[0]) < 1e-3


def test_language_of_odd_and_mixed_texts(spark):
    english, russian = "the house and the garden are green ", "дом и сад очень зелёные "
    train = spark.createDataFrame([("en", english * 5), ("ru", russian * 5), (None, "junk"), ("en", None)], "lang string, text string")
    model = language.train(train)
    assert model.languages == ["en", "ru"]
    mixed = english * 3 + russian
    rows = {r.doc_id: r for r in language.identify(docs(spark, *ODD, "12 !!", english, russian, mixed), model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4
    assert (rows[9].lang_pred, rows[10].lang_pred, rows[11].lang_pred) == ("en", "ru", "en")
    assert [(mixed[s.start : s.end].strip()[:3], s.lang) for s in rows[11].spans] == [("the", "en"), ("дом", "ru")]
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows.values())
    nothing = language.train(train.limit(0))
    assert {r.lang_pred for r in language.identify(docs(spark, "abc"), nothing).collect()} == {"und"}


def test_quality_ranks_held_out_texts(spark):
    good = random_texts(60, "abcdefghij   .", 200, 1)
    bad = [t.replace(" ", "$$ ") + "!!" for t in random_texts(60, "ABCDEFG   |", 200, 2)]
    table = docs(spark, *good, *bad, None, "")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120) if i % 2] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    rows = {r.doc_id: r for r in quality.rate(table, model).collect()}
    assert len(rows) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= quality.CUT) for r in rows.values())
    assert np.mean([rows[i].predicted == int(i < 60) for i in range(0, 120, 2)]) > 0.9
    assert quality.train(table, labels.where("quality = 1")) is None
    assert {r.score for r in quality.rate(table, None).collect()} == {0.5}


def test_quality_learns_from_every_labelled_text(spark):
    # More than 4,000 texts of each class.
    rows = [(i, ("a b " * (i % 7 + 1) + f"w{i} ") * 3 if i % 2 else f"{i}#" * 9) for i in range(8400)]
    labels = [(i, i % 2, 0) for i in range(8400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, table_of = quality.train(table, marks), quality.class_table()
    x = np.stack([quality.features(t, table_of) for _, t in rows]).astype(np.float32).astype(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) < 1e-6, 1, x.std(0)), atol=1e-6)
    raw = np.sort(model.raw(x))
    assert model.cut == pytest.approx(raw[4199:4201].mean())
    draw = np.random.default_rng(3).normal(size=999).round(2).tolist()
    for below in (1, 400, 999):
        # Values are repeated; what lies below the cut is the least one and its like.
        ranked = sorted(draw)
        over = [v for v in ranked if v > ranked[below - 1]][:1]
        assert quality.cut_at(spark.createDataFrame([(v,) for v in draw], "raw double"), below) == pytest.approx(np.mean([ranked[below - 1], *over]))
