"""Operators that compare documents or vectors, and the pipeline, against brute force."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import near_copies, simhash, suffix, topk
from rankloom.llm.oracle import SQL
from rankloom.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def words(draw, n):
    return " ".join("".join(draw.choice("abcdé") for _ in range(draw.randint(1, 4))) for _ in range(n))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min(root[j] for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 3) for i in range(len(rows))]
        if new == root:
            break
        root = new
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, root):
        least[r].append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return [(i, f"{p:016x}", name[r]) for (i, _), p, r in zip(rows, prints, root)]


@pytest.fixture(scope="module")
def near(spark):
    draw = random.Random(1)
    rows = [(None, "only one"), (5, None), (3, ""), (9, " \n"), (7, "two words"), (7, "two words"), (8, "Two  WORDS")]
    for k in range(12):
        base = words(draw, 60).split()
        for c in range(6):
            own = list(base)
            if c:
                own[draw.randrange(60)] = "zz"
            rows.append((1000 - 8 * k - c, " ".join(own)))
    return rows


def test_simhash_components(spark, near):
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(near, DOCS).withColumn("fp", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(brute_components(near), key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_loses_no_link_in_large_buckets(spark):
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 1 << 62, 6)
    values = sorted({int(c) ^ sum(1 << int(b) for b in draw.integers(0, 63, draw.integers(0, 5))) for c in centre for _ in range(60)})
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    own = simhash.forest(np.array(values, np.int64), 3)
    expected = {v: values[own[i]] for i, v in enumerate(values)}
    for block in (2048, 8):
        found = {r.node: r.root for r in simhash.components(simhash.links(table, block=block)).collect()}
        assert {v: found.get(v, v) for v in values} == expected


def test_every_pair_within_the_radius_collides():
    draw = random.Random(5)
    for _ in range(3000):
        bits = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3)))
        assert any(m & bits == 0 for m in (x % (1 << 64) for x in simhash.masks()))


def test_one_of_each_group_stays(spark, near):
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(near)], DOCS + ", digest int")
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    groups = {(c, None) if c is not None else (None, p) for _, p, c in brute_components(near)}
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(c for c, _ in groups if c is not None)


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def planted_copies():
    """Texts, chains of them with few edits between neighbours (0.75 to 0.95 in common), and short, empty and null ones."""
    draw = random.Random(21)
    rows = [(None, "only one"), (5, None), (3, ""), (9, " \n"), (7, "two words"), (7, "two words"), (8, "Two  WORDS"), (None, "Only ONE")]
    for k, n in enumerate((12, 30, 60, 120, 400, 1500) * 4):
        own = ["".join(draw.choice("abcde") for _ in range(draw.randint(3, 7))) for _ in range(n)]
        for c in range(5):
            rows.append((1000 - 10 * k - c, " ".join(own)))
            # An edit takes five shingles from each set.
            for at in draw.sample(range(n), max(1, round(n * draw.choice((0.006, 0.012, 0.019, 0.022, 0.028))))):
                own[at] = f"zz{draw.randrange(1000)}"
    # Beginnings of one text: the first and the last are no pair, the middle one links both.
    for k in range(10):
        own = words(draw, 300).split()
        rows += [(2000 + 10 * k + c, " ".join(own[:n])) for c, n in enumerate((200, 245, 300))]
    return rows


def test_near_copies_are_all_pairs_with_four_fifths_of_the_shingles(spark):
    rows = planted_copies()
    sets = [brute_shingles(t) for _, t in rows]
    near = [[len(a & b) * 5 >= len(a | b) * 4 for b in sets] for a in sets]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if near[i][j]) for i in range(len(rows))]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != b]
    assert sum(0.8 <= x < 0.95 for x in alike) > 50 and sum(0.7 <= x < 0.8 for x in alike) > 20
    groups = collections.defaultdict(list)
    for (i, _), r in zip(rows, label):
        groups[r].append(i)
    expected = sorted((min((i for i in ids if i is not None), default=None) for ids in groups.values()), key=str)
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], DOCS + ", digest int")
    for block, mass in ((near_copies.BLOCK, near_copies.MASS), (2, near_copies.MASS), (8, 200)):
        kept = near_copies.one_of_each(table, block, mass)
        assert kept.columns == table.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == expected
    staged = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert sorted((r.doc_id for r in staged.collect()), key=str) == expected


def test_exact_links_and_edges_of_one_cluster():
    """Copies of one text that are mostly just under the limit: all pairs are compared, and fewer edges than sets come out."""
    draw = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    sets = []
    for _ in range(400):
        own = list(base)
        for k in draw.sample(range(300), draw.choice([2, 5, 5, 5])):
            own[k] = f"x{draw.random()}"
        sets.append(np.sort(near_copies.shingles(" ".join(own))))
    n = np.array([len(s) for s in sets])
    every = np.ones((400, 400), bool) & ~np.eye(400, dtype=bool)
    link = near_copies.exact_links(sets, every)
    brute = [[i != j and len(np.intersect1d(a, b)) * 9 >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets[:40])]
    assert (link[:40] == np.array(brute)).all() and 0 < link.sum() < every.sum() / 2
    few = np.zeros_like(every)
    few[:3, :3] = every[:3, :3]
    assert (near_copies.exact_links(sets, few) == (link & few)).all()
    edges = near_copies.star(link, np.arange(400))
    label = list(range(400))
    for _ in range(400):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(400)]
        if new == label:
            break
        label = new
    assert len(edges) == sum(x != i for i, x in enumerate(label)) < 400
    assert all(label[a] == b for a, b in edges)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Few edges leave a task whatever the size of a group, and blocks lose none."""
    draw = random.Random(22)
    base = words(draw, 200).split()
    rows = []
    for i in range(300):
        own = list(base)
        for k in draw.sample(range(200), draw.choice([0, 1, 3, 4])):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    sets = [brute_shingles(t) for _, t in rows]
    label = list(range(300))
    near = [[len(a & b) * 5 >= len(a | b) * 4 for b in sets] for a in sets]
    for _ in rows:
        new = [min(label[j] for j in range(300) if near[i][j]) for i in range(300)]
        if new == label:
            break
        label = new
    table = spark.createDataFrame(rows, DOCS)
    for block in (512, 40):
        assert sorted(r.doc_id for r in near_copies.one_of_each(table, block).collect()) == sorted(set(label))


def test_fingerprints_bring_sets_together(spark):
    """Without a common key only covering SimHash finds the copy; the exact share still decides."""
    draw = random.Random(31)
    base = words(draw, 2000).split()
    for k in range(2000):
        changed = [*base[:k], "zz", *base[k + 1 :]]
        if 0 < (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(changed))).bit_count() <= 3:
            break
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(changed)), (3, words(draw, 2000)), (4, None)], DOCS)
    rows = near_copies.signed(docs).withColumn("bands", F.transform("bands", lambda b: F.xxhash64(b, "doc_id")))
    keys = {r["doc_id"]: r["key"] for r in rows.collect()}
    root = {r["id"]: r["root"] for r in near_copies.roots(docs, rows).collect()}
    assert set(root) == {keys[1], keys[2]} and len(set(root.values())) == 1


def test_one_python_worker_a_task_signs_texts(spark, near):
    """Two functions in one task take two workers, which live on with what they hold."""
    signed = near_copies.signed(spark.createDataFrame(near, DOCS))
    assert signed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = signed.collect()
    assert sorted(r["fp"] % (1 << 64) for r in rows) == sorted(brute_fingerprint(t) for _, t in near)
    tracemalloc.start()
    try:
        own = [near_copies.signature(f"{i} is a text") for i in range(500)]
        assert tracemalloc.get_traced_memory()[0] < 1000 * len(own)
    finally:
        tracemalloc.stop()


def brute_dedup(rows, width):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + width] for _, b in data for s in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        kept = bytes(c for c, x in zip(b, gone) if not x)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(spark):
    draw = random.Random(3)
    passages = [words(draw, 30) for _ in range(4)]
    rows = [(1000, "a" * 500), (1001, None), (1002, ""), (1003, "ab" * 40), (1004, passages[0]), (1004, passages[0]), (1005, passages[0] + "x"), (None, passages[1])]
    for i in range(150):
        text = words(draw, draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            text += draw.choice(passages)[draw.randint(0, 20) : draw.randint(30, 90)] + words(draw, draw.randint(0, 10))
        rows.append((i, text))
    table = spark.createDataFrame(rows, DOCS).withColumn("name", F.lit("x")).withColumn("bytes", F.lit(0))
    for shard in (suffix.SHARD_BYTES, 2000):
        assert sorted(map(tuple, suffix.deduplicated(table, 48, 8, shard).collect()), key=str) == brute_dedup(rows, 48)
    assert suffix.deduplicated(table.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    draw = random.Random(6)
    for text in (b"banana" * 3, b"a" * 50, bytes(draw.choice(b"ab") for _ in range(300)), b"x"):
        data = np.frombuffer(text, np.uint8)
        order = suffix.suffix_array(data, len(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffix.common_prefixes(data, order)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_top_k(spark):
    draw = np.random.default_rng(8)
    rows = [(i, draw.integers(-3, 4, 6).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(15)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (205, [0.5]), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in topk.top_k(table, F.col("id") % 5 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and (i < 200 or i > 203)}
    for q in (i for i in whole if i % 5 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:10]
        assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not got
    few = topk.top_k(table.where("vec_id in (0, 1)"), F.col("id") == 0, 10).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
    assert topk.top_k(table.limit(0), F.col("id") == 0).count() == 0


def test_top_k_holds_a_bounded_chunk_of_queries(spark, monkeypatch):
    for name, size in (("HELD", 7), ("QUERIES", 3), ("CANDIDATES", 5)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(9)
    rows = [(int(i), draw.integers(-2, 3, 4).astype(float).tolist()) for i in draw.integers(0, 50, 120)]
    top = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 2 == 0, 4)
    # Blocks of queries and of candidates were joined in rows, many of which an Arrow batch held at once.
    assert "Join" not in top._jdf.queryExecution().sparkPlan().toString()
    got = collections.defaultdict(list)
    for r in top.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in {i for i, _ in rows if i % 2 == 0}:
        own = min([int(1024 * x) for x in v] for i, v in rows if i == q)
        best = collections.defaultdict(lambda: -(1 << 62))
        for i, v in rows:
            if i != q:
                best[i] = max(best[i], sum(a * int(1024 * x) for a, x in zip(own, v)))
        assert got.pop(q) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert not got


def test_queries_and_pipeline_run_over_a_whole_table(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op1_secret_scan", "op3_quality", "op4_language", "op9_token_counts"):
        assert QUERIES[name](spark, folder).count() == n
    assert set(SQL) <= set(QUERIES)


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(12)
    clean = [words(draw, 40) for _ in range(30)]
    item = "this benchmark item must never be trained on by any model"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(50, clean[0], "en", "s", 1), (51, clean[1] + " " + item, "en", "s", 1), (52, "key token=abcdef123456 " + words(draw, 30), "en", "s", 1), (53, None, "en", None, None), (54, "", "en", "s", 0), (55, "12 34 !!", "en", "s", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        ids.append({r.doc_id for r in docs.collect()})
        if k == 3:
            assert "[secret]" in docs.where("doc_id = 52").first().text
    assert ids[0] == {*range(30), 50, 51, 52}
    assert ids[1] == ids[0] - {50}
    assert ids[2] == ids[3] == ids[4] == ids[1] - {51}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_memory_of_a_shard():
    draw = np.random.default_rng(32)
    base = bytes(draw.integers(97, 123, 20_000).astype(np.uint8))
    pieces = [base[a : a + 430] for a in draw.integers(0, 19_000, 1000).tolist()]
    tracemalloc.start()
    try:
        suffix.shard_windows(pieces, np.full(1000, 31), np.ones(1000, np.int64), 400)
        assert tracemalloc.get_traced_memory()[1] < 70 * sum(map(len, pieces))
    finally:
        tracemalloc.stop()
