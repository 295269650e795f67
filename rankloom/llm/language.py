"""Language identification: script ranges narrow the candidates, Viterbi labels the spans.

A word is a run of letters and marks. Its score in a language is the log likelihood of its
letter trigrams (with word ends), counted over all training texts; trigrams are hashed into
``BUCKETS`` cells, so a model has at most languages x BUCKETS numbers whatever the corpus holds.
A word is only compared over languages that use its script in training texts. The best sequence
of labels pays ``SWITCH`` for each change of language; neighbouring words with one label form a span.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import chunks, held, pick, share, whole_text

BUCKETS = 1 << 16
#: Nats that a change of language costs.
SWITCH = 8.0
#: A language uses a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Words of a block of the Viterbi recursion, and characters handled at once.
BLOCK = 64
CHUNK = 400_000
#: Score of a language that does not use the word's script.
BARRED = -1.0e4

#: First and last code point of Unicode script ranges.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("latin", 0x2C60, 0x2C7F),
    ("latin", 0xA720, 0xA7FF),
    ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("arabic", 0x08A0, 0x08FF),
    ("arabic", 0xFB50, 0xFDFF),
    ("arabic", 0xFE70, 0xFEFF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0x3130, 0x318F),
    ("hangul", 0xAC00, 0xD7AF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("han", 0xF900, 0xFAFF),
    ("han", 0x20000, 0x3134F),
)
OTHER = 1  # script number of letters outside the ranges; 0 is no letter


@dataclass
class Alphabet:
    """By code point: script number (0: part of no word), whether it is a letter, lower case."""

    script: np.ndarray
    letter: np.ndarray
    lower: np.ndarray
    n_scripts: int


def alphabet() -> Alphabet:
    size = 0x110000
    names = {name: OTHER + 1 + i for i, name in enumerate(dict.fromkeys(s[0] for s in SCRIPTS))}
    script, letter = np.zeros(size, np.uint8), np.zeros(size, bool)
    lower = np.arange(size, dtype=np.uint32)
    for code in range(size):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            script[code], letter[code] = OTHER, kind == "L"
            low = c.lower()
            if len(low) == 1:
                lower[code] = ord(low)
    for name, first, last in SCRIPTS:
        part = script[first : last + 1]
        part[part > 0] = names[name]
    return Alphabet(script, letter, lower, OTHER + 1 + len(names))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    barred: np.ndarray  # scripts x languages
    letters: Alphabet
    switch: float = SWITCH


@dataclass
class Words:
    """The words of some texts joined by line ends: code point bounds, script, owner, trigram cells."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    n_letters: np.ndarray
    text: np.ndarray
    cells: np.ndarray = field(repr=False)
    first_cell: np.ndarray = field(repr=False)


def words_of(texts: list[str], letters: Alphabet) -> Words:
    # A separator on both ends makes every word end inside the array.
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = letters.script[codes]
    inside = script > 0
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    is_letter = letters.letter[codes]
    n_letters = np.add.reduceat(is_letter, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    if len(start):
        # reduceat runs on to the next word's start; between words there are no letters.
        keep = n_letters > 0
        start, end, n_letters = start[keep], end[keep], n_letters[keep]
    low = np.where(inside, letters.lower[codes], 0).astype(np.uint64)
    mixed = low[:-2] * np.uint64(0x9E3779B1) + low[1:-1] * np.uint64(0x85EBCA77) + low[2:] * np.uint64(0xC2B2AE3D)
    cells = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    # The cell of the trigram around position p stands at p - 1.
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(bounds, start - 1, "right") - 1
    return Words(start, end, script[start], n_letters, text, cells, start - 1)


def word_cells(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of all words one after the other, and where each word's begin."""
    length = words.end - words.start
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(words.first_cell - begin, length)
    return words.cells[at], begin


def train(docs: DataFrame) -> Model:
    """Count trigrams and scripts by language over all rows of ``docs`` (text, lang).

    Rows with a null text or language teach nothing. Without any row the model has no language.
    Each task sends one row per language and cell, so the shuffle does not grow with the texts.
    """
    spark = docs.sparkSession
    letters = alphabet()
    sent = share(spark, letters)

    def count(batches):
        table, seen = held(sent), {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                cells, scripts = seen.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(table.n_scripts, np.int64)))
                for _, texts in chunks(part["text"].tolist(), CHUNK):
                    words = words_of(texts, table)
                    cells += np.bincount(word_cells(words)[0], minlength=BUCKETS)
                    scripts += np.bincount(words.script, words.n_letters, table.n_scripts).astype(np.int64)
        for lang, (cells, scripts) in seen.items():
            both = np.concatenate([cells, scripts])
            at = np.flatnonzero(both)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": both[at]})

    rows = pick(docs, "text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # At most BUCKETS + scripts rows per language.
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    n_scripts = letters.n_scripts
    table = np.zeros((BUCKETS + n_scripts, len(languages)))
    if languages:
        table[found["cell"], np.searchsorted(languages, found["lang"])] = found["n"]
    cells, scripts = table[:BUCKETS], table[BUCKETS:]
    log_p = np.log((cells + 0.5) / (cells.sum(0) + 0.5 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    # A script that no language uses bars none.
    barred = np.where(uses | ~uses.any(1, keepdims=True), 0, BARRED)
    model = Model(languages, log_p.astype(np.float32), barred.astype(np.float32), letters)
    sent.unpersist()
    return model


def best_labels(scores: np.ndarray, text: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of each text's words; ``text`` numbers the texts in rising order.

    Words are cut into blocks of BLOCK. All blocks first compute their best path from each entry
    label to each exit label side by side, then the blocks of a text are chained, and last each block
    finds its own path between the labels known at its ends. Every path of the whole text is covered, so
    the result is the exact optimum; ties go to staying, then to the first language.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    length = np.diff(np.append(first, n))
    blocks = -(-length // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    place = np.arange(n) - np.repeat(first, length)
    block_of = np.repeat(first_block, length) + place // BLOCK
    total = int(blocks.sum())
    emit = np.zeros((BLOCK, total, k), np.float32)
    emit[place % BLOCK, block_of] = scores
    # Exit scores from every entry label.
    reach = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-switch))[None].repeat(total, 0) + emit[0][:, None, :]
    for step in range(1, BLOCK):
        reach = np.maximum(reach, reach.max(2, keepdims=True) - np.float32(switch)) + emit[step][:, None, :]
    # Chain the blocks of each text; the first word of a text may have any label at no cost.
    entry = np.zeros(total, np.int64)
    exit_ = np.zeros(total, np.int64)
    came = np.zeros((total, k), np.int64)
    best = np.zeros((len(first), k), np.float32)
    order = np.argsort(-blocks, kind="stable")
    alive = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max()) + 1), "right")
    for step, count in enumerate(alive):
        own = order[:count]
        at = first_block[own] + step
        through = best[own][:, :, None] + reach[at]
        came[at] = through.argmax(1)
        best[own] = through.max(1)
    last = best.argmax(1)
    for step in range(len(alive) - 1, -1, -1):
        own = order[: alive[step]]
        at = first_block[own] + step
        exit_[at] = last[own]
        entry[at] = last[own] = came[at, last[own]]
    # Paths inside the blocks.
    value = np.full((total, k), -switch, np.float32)
    value[np.arange(total), entry] = 0
    value += emit[0]
    back = np.zeros((BLOCK, total, k), np.uint16)
    own_label = np.arange(k)
    for step in range(1, BLOCK):
        top = value.argmax(1)
        moved = value.max(1)[:, None] - np.float32(switch)
        stay = value >= moved
        back[step] = np.where(stay, own_label, top[:, None])
        value = np.where(stay, value, moved) + emit[step]
    labels = np.zeros((BLOCK, total), np.int64)
    now = exit_
    for step in range(BLOCK - 1, -1, -1):
        labels[step] = now
        now = back[step, np.arange(total), now].astype(np.int64)
    return labels[place % BLOCK, block_of]


def label_texts(texts: list[str], model: Model, spans: bool) -> list[tuple]:
    """(language, score, spans) of each text."""
    if not model.languages:
        return [("und", 0.0, [])] * len(texts)
    out: list[tuple] = []
    for _, part in chunks(texts, CHUNK):
        words = words_of(part, model.letters)
        cells, begin = word_cells(words)
        if len(begin):
            scores = np.stack([np.add.reduceat(column[cells], begin) for column in model.log_p.T], 1) + model.barred[words.script]
        else:
            scores = np.zeros((0, len(model.languages)), np.float32)
        labels = best_labels(scores.astype(np.float32), words.text, model.switch)
        k = len(model.languages)
        share = np.bincount(words.text * k + labels, words.n_letters, len(part) * k).reshape(len(part), k)
        total, winner = share.sum(1), share.argmax(1)
        if spans:
            offset = np.cumsum([1, *(len(t) + 1 for t in part)])
            cut = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
            stop = np.append(cut[1:], len(labels)) - 1 if len(cut) else cut
            found: list[list] = [[] for _ in part]
            for a, b in zip(cut, stop):
                owner = words.text[a]
                found[owner].append((int(words.start[a] - offset[owner]), int(words.end[b] - offset[owner]), model.languages[labels[a]]))
        for i in range(len(part)):
            own = found[i] if spans else []
            out.append((model.languages[winner[i]], float(share[i, winner[i]] / total[i]), own) if total[i] else ("und", 0.0, own))
    return out


def labeller(docs: DataFrame, model: Model, spans: bool = False) -> Column:
    """Struct column lang_pred, score, spans for the ``text`` column of ``docs``."""
    shared = share(docs.sparkSession, model)
    kind = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(label_texts(batch.tolist(), held(shared), spans), columns=["lang_pred", "score", "spans"])

    return label(whole_text())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans for every row of ``docs`` (doc_id, text).

    ``lang_pred`` is the language with most letters over the spans (ties: first by name), ``score`` its
    share of the letters; ``und`` and 0.0 if the text is null, empty or without letters, or if the
    model knows no language. Spans are code point ranges, end exclusive. Rows are independent: repeated rows
    give repeated results, null ids stay null, an empty table gives no rows. Texts of any length are labelled whole.
    """
    plain = pick(docs, "doc_id", "text")
    return plain.withColumn("__label", labeller(plain, model, spans=True)).select("doc_id", "__label.*")
