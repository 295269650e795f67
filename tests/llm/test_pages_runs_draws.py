"""HTML extraction, periodic runs and importance resampling against brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import periods, resample, tag_paths
from rankloom.llm.queries import QUERIES, repeated_tail

SMALL = "/root/testdata/sf0.001"


# --- runs -----------------------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            own = words[i : i + size]
            if size >= max(6, 4 * q) and not any(own[p:] == own[: size - p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1 if j > i else i + 1
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def word_lists(count, seed=1):
    draw = random.Random(seed)
    for _ in range(count):
        n, letters = draw.randint(0, 90), draw.choice([1, 2, 3, 6])
        words = [str(draw.randint(1, letters)) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + draw.randrange((n - a) // 3 + 1)
            words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
        yield words + [str(draw.randint(1, 3)) for _ in range(draw.choice([0, 0, 15]))]


def test_runs_equal_brute_force_whatever_the_steps():
    texts = list(word_lists(400))
    for words in texts:
        codes = np.array([int(w) for w in words], np.int64)
        for step in (1, 5, 1 << 17):
            assert [tuple(r) for r in periods.catch(codes, None, step).tolist()] == brute_runs(words)
    together = periods.runs_of_texts([[w.encode() for w in words] for words in texts])
    assert [[tuple(r) for r in runs.tolist()] for runs in together] == [brute_runs(words) for words in texts]


def test_each_word_reports_the_squares_it_completes():
    catchers = periods.Catchers()
    # Two neighbouring blocks of one word are met after the third equal word.
    assert [catchers.append(np.array([c])) for c in (7, 7, 7, 8)] == [0, 0, 1, 0]
    assert periods.runs_of(np.array([7, 7, 7, 8]), catchers.squares(), least=3).tolist() == []
    assert periods.runs_of(np.array([7] * 4), np.array([[1, 0, 3]]), least=3).tolist() == [[0, 4, 1]]


def test_wrong_hashes_are_found_out_by_the_words(monkeypatch):
    monkeypatch.setattr(periods, "mixed", lambda x: x & np.uint64(1))
    for words in word_lists(200, seed=2):
        codes = np.array([int(w) for w in words], np.int64)
        assert [tuple(r) for r in periods.catch(codes).tolist()] == brute_runs(words)


def test_long_texts_with_one_or_many_runs():
    assert periods.catch(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    codes = np.concatenate([np.arange(50_000), 50_000 + np.arange(200_000) % 40_000, [-1]])
    assert periods.catch(codes).tolist() == [[50_000, 200_000, 40_000]]
    many = np.repeat(np.arange(20_000), 6)
    assert len(periods.catch(many)) == 20_000
    assert len(periods.catch(np.array([bin(i).count("1") % 2 for i in range(1 << 15)]))) == 0


def test_periodic_runs_of_documents(spark):
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (4, "b \x0b b\x0cb b  b b c"), (4, "x y x y x y x y"), (4, "x y x y x y x y"), (5, " a  " * 9), (6, "w " * 70_000)]
    rows += [(i + 100, " ".join(words)) for i, words in enumerate(word_lists(40, seed=3))]
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, runs string, TEXT int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(table).collect()), key=str)
    expected = []
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = [(0, 70_000, 1)] if i == 6 else brute_runs(words)
        expected.append((i, len(words), runs, collapsed(words, runs) if i != 6 else "w"))
    assert got == sorted(expected, key=str)
    assert periods.periodic_runs(table.limit(0)).count() == 0


def test_op12_equals_brute_force_over_a_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        words = re.findall("[^\x20\x09-\x0d]+", row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        r = got.pop(row.doc_id)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        facts = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *facts)
        assert r.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == digest(collapsed(words, runs))
    assert not got and repeated_tail(0, 10) is None


# --- resampling -----------------------------------------------------------------------------------------------------------


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_draw(docs, target, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    corpus, wanted, own = Counter(), Counter(), []
    for i, t in docs:
        n, f = brute_features(t)
        own.append((i, n, Counter(map(bucket, f))))
        corpus.update(own[-1][2])
    for t in target:
        wanted.update(map(bucket, brute_features(t)[1]))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000))))
    rows = []
    for i, n, counts in own:
        weight = sum(gain(b) * c for b, c in counts.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_overlapped_scan_emits_all_spans():
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice("abZ9é_- \n日") for _ in range(draw.randint(0, 40)))
        n, features = brute_features(text)
        data = resample.collapsed(text)
        assert sorted(data[a:b].decode() for a, b in resample.spans(data)) == sorted(features)
        words, codes = resample.buckets(text)
        assert words == n and sorted(codes.tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in features)


def test_resampling_equals_brute_force(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["Alpha", "beta", "gé", "x1", "the", "of"]) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    rows = [(i * 3 % 151, t) for i, t in enumerate(texts)] + [(None, texts[0]), (900, None), (901, ""), (902, "-- !!"), (903, "a " * 60_000), (7, texts[1]), (7, texts[1])]
    table = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, score int, RANK string")
    goal = ["the alpha of beta", None, "", "x1 x1 the"]
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    for percent in (5, 40, 100):
        got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resampled(table, target, percent).collect()]
        assert sorted(got, key=str) == brute_draw(rows, goal, percent=percent)
    assert resample.resampled(table.limit(0), target).count() == 0
    assert resample.resampled(table, target.limit(0)).count() == len(rows)


def test_op13_equals_brute_force_over_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    goal = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_resampling"](spark, SMALL).collect()]
    assert sorted(got, key=str) == brute_draw(docs, goal)


# --- pages ----------------------------------------------------------------------------------------------------------------

LONG = "Words of an article, with commas; and full stops. " * 6
SAID = LONG.strip()


@pytest.mark.parametrize(
    "source, expected",
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; more", "no markup & more"),
        ("<p>One.<p>Two<div>x", "One.\n\nTwo\n\nx"),
        ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x < y</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --><p title='a>b'>c<br>d", "a <b> &amp; é x < y\n\nc d"),
        (f"<body class='has-sidebar'><nav><a href=/>Home</a></nav><div id=content><p>{LONG}</p><p>Short.</p></div><div class='left sideBar'><p>{LONG}</p></div></body>", f"{SAID}\n\nShort."),
        (f"<article><header><h1>Head</h1><p>by me</p></header><p>{LONG}<aside>no</aside><form>Mail <input></form><p>End.<section id=comments><p>{LONG}</p></section></article><footer>{LONG}</footer>", f"Head\n\n{SAID}\n\nEnd."),
        (f"<title>Story - Site</title><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>Buy</div><h1>Story</h1><div><p>{LONG}</p><ul><li>point<li>other</ul><p>{LONG}</p></div><div>Made by us</div>", f"Story\n\n{SAID}\n\npoint\n\nother\n\n{SAID}"),
        (f"<main><p>{LONG}</p><article class=comment><p>{LONG}</p></article><div class='cookie-notice'>Accept</div><div role=navigation>go</div><div hidden>h</div><p>Last</p></main>", f"{SAID}\n\nLast"),
        (f"<article><p><b>{LONG}<br><p>Next <span class=ad>buy</span>one <i>two</i></p></article>", f"{SAID}\n\nNext one two"),
        (f"<div class=comments><p>{LONG}</p></div>", SAID),
        (f"<table><tr><td><ul><li><a href=a>aa</a><li><a href=b>bb</a></ul><td><p>{LONG}<p>{LONG}<tr><td>foot</table>", f"{SAID}\n\n{SAID}"),
        ("<article><p>Be. Erin.</p></article><div>A longer line of something else, said by nobody.</div>", "Be. Erin."),
        ("<nav>only</nav><script>x", ""),
        ("<p>cut <a href='x", "cut"),
    ],
)
def test_pages(source, expected):
    assert tag_paths.main_text(source or "") == expected


def test_every_page_gives_its_article(spark):
    """The articles of the test pages, cut out by hand: all else on them is menu, advert and footer."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op11_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    for row in pages.collect():
        inside = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        r = got.pop(row.page_id)
        assert r.url == row.url and r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert not got


def test_pages_of_odd_tables(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (1, "u", f"<p>{LONG}", "t"), (1, "u", f"<p>{LONG}", "t"), (2, "u", "<p>word, word. " * 40_000, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = [(r.page_id, r.n_chars) for r in tag_paths.extracted(table).collect()]
    assert got == [(None, 0), (1, 0), (1, len(SAID)), (1, len(SAID)), (2, 40_000 * 11 + 39_999 * 2)]
    assert tag_paths.extracted(table.limit(0)).count() == 0
    for source in ("<b>" * 20_000 + "x", "<div>" * 20_000 + "x", "<li>" * 20_000, '<a "' * 20_000, "<u><p>" + "<b>" * 20_000 + "</u>" * 20_000):
        tag_paths.main_text(source)


def test_path_ratios_follow_their_definition():
    page = tag_paths.Page("<div>ab, cd.</div><p>abcd</p><p>ab</p>")
    score, links, threshold = tag_paths.path_scores(page.blocks)
    chars, marks = [7, 3, 3], [2, 0, 0]
    kernel = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
    smooth = lambda x: [sum(x[j] * kernel[j - i] for j in range(3)) / sum(kernel[j - i] for j in range(3)) for i in range(3)]
    fused = [math.sqrt(a * (1 + b) * c * (1 + d)) for a, b, c, d in zip(smooth(chars), smooth(marks), chars, marks)]
    assert sorted(score.values()) == pytest.approx(sorted([fused[0], (fused[1] + fused[2]) / 2]))
    assert threshold == pytest.approx(0.5 * np.std(fused)) and set(links.values()) == {0.0}
