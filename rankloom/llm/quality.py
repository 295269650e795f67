"""Quality scores by Bradley-Terry pairwise ranking.

Each pair of a good and a bad labelled text is a preference. Every labelled text takes part, in pairs with the texts of the
other class in its group, a bounded part of the table by a hash of the id. A linear score over features of the text is fitted by logistic
loss on the feature differences, so only the order of scores is learned; the cut between good and bad is then put at the
quantile of the scores of all labelled texts that the share of bad labels names. Tasks add up the sums of each step; only sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import held, pick, share, whole_text
from rankloom.session import durable

#: Labelled texts of a group, about, inside which every good text is compared with every bad one; texts of the rarer class in it.
GROUP = 128
RARE = 16
#: Bins that a cut is searched in at once, and passes; what is left is less than a 10^9th of the range.
BINS = 4096
PASSES = 3
#: Tasks of a step of the fit at most: each sends its sums to the driver.
TASKS = 64
RIDGE = 1e-2
#: Score at the cut.
CUT = 0.3

#: Classes of ASCII characters; bytes outside them form three more (controls, lead bytes, tail bytes).
CLASSES = (" ", "\n", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "0123456789", ".", ",;:", "!?", "|", "#$%&*+=<>@~^\\", "\"'`()[]{}", "-_/")
N_CLASSES = len(CLASSES) + 3


def class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    table[0xC0:] = len(CLASSES) + 1
    table[0x80:0xC0] = len(CLASSES) + 2
    for i, chars in enumerate(CLASSES):
        table[list(chars.encode())] = i
    return table


def features(text: str, table: np.ndarray) -> np.ndarray:
    """Shares of neighbouring character classes, and length, word and line figures, of the whole text."""
    data = text.encode("utf-8", "surrogatepass")
    kinds = table[np.frombuffer(data, np.uint8)].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES**2) / max(len(kinds) - 1, 1)
    words, lines = data.split(), data.split(b"\n")
    extra = (
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / (len(words) + 1),
        len(set(words)) / (len(words) + 1),
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)),
    )
    return np.concatenate([np.sqrt(pairs), extra])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Feature rows of each group, good ones first, how many are good, and which rows are texts of this group, not copies."""
    for batch in batches:
        for good, own, x in zip(batch["good"], batch["own"], batch["x"]):
            mine = np.frombuffer(own, bool)
            yield np.frombuffer(x, np.float32).reshape(len(mine), -1).astype(np.float64), good, mine


def summed(groups: DataFrame, sums) -> np.ndarray:
    """The sum of ``sums`` (a vector for a matrix of rows, its good rows, its own rows) over all groups; each task sends one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for one in matrices(batches):
            part = sums(*one)
            total = part if total is None else total + part
        yield pd.DataFrame({"sums": [] if total is None else [total.tobytes()]})

    tasks = min(groups.sparkSession.sparkContext.defaultParallelism, TASKS)
    found = groups.coalesce(tasks).mapInPandas(run, "sums binary").collect()
    return np.sum([np.frombuffer(r.sums) for r in found], axis=0)


def moments(x: np.ndarray, _good: int, own: np.ndarray) -> np.ndarray:
    return np.concatenate([[own.sum()], x[own].sum(0), (x[own] ** 2).sum(0)])


def fit_pairs(groups: DataFrame, scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights with the least mean log(1 + exp(-difference @ weight)) + ridge / 2 * |weight|² over the pairs of all groups, by Newton steps."""
    d = len(scale)

    def step_at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(x: np.ndarray, good: int, _own: np.ndarray) -> np.ndarray:
            x = x / scale
            z, a, b = x @ w, x[:good], x[good:]
            z = z[:good, None] - z[None, good:]
            p = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            bend = p * (1 - p)
            across = a.T @ bend @ b
            whole = (a * bend.sum(1)[:, None]).T @ a + (b * bend.sum(0)[:, None]).T @ b - across - across.T
            return np.concatenate([[z.size, np.logaddexp(0, -z).sum()], a.T @ p.sum(1) - b.T @ p.sum(0), whole.ravel()])

        n, loss, *_ = total = summed(groups, sums)
        slope = ridge * w - total[2 : d + 2] / n
        return loss / n + ridge / 2 * (w @ w), slope, total[d + 2 :].reshape(d, d) / n + ridge * np.eye(d)

    weight = np.zeros(d)
    now, slope, bend = step_at(weight)
    for _ in range(50):
        step, size = np.linalg.solve(bend, slope), 1.0
        while (new := step_at(weight - size * step))[0] > now and size > 1e-6:
            size /= 2
        if now - new[0] < 1e-10:
            break
        weight, (now, slope, bend) = weight - size * step, new
    return weight


def cut_at(scores: DataFrame, below: int) -> float:
    """Half way between the ``below``-th least value of ``raw`` and the next greater one, found by counts in ever finer bins."""
    raw = F.col("raw")
    low, high = scores.agg(F.min("raw"), F.max("raw")).first()
    high = float(np.nextafter(high, np.inf))
    for _ in range(PASSES):
        width = (high - low) / BINS
        if low + width / BINS == low or high - width / BINS == high:
            break
        place = F.floor((raw - F.lit(low)) / F.lit(width))
        counts = np.zeros(BINS + 1, np.int64)
        for row in scores.where(raw < high).groupBy(F.greatest(F.lit(-1), F.least(place, F.lit(BINS - 1))).alias("bin")).count().collect():
            counts[row["bin"] + 1] = row["count"]
        at = int(np.searchsorted(np.cumsum(counts), below)) - 1
        # One bin more on each side, against the rounding of the edges.
        low, high = max(low, low + (at - 1) * width), min(high, low + (at + 2) * width)
    rank = scores.where(raw < low).count()
    for value, n in scores.where((raw >= low) & (raw < high)).groupBy("raw").count().orderBy("raw").collect():
        rank += n
        if rank >= below:
            break
    after = scores.where(raw > value).agg(F.min("raw")).first()[0]
    return value if after is None else (value + after) / 2


def train(docs: DataFrame, labels: DataFrame, group: int = GROUP, rare: int = RARE) -> Model | None:
    """Fit on all labelled texts.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (0 or 1). Null ids and labels and ids with both labels teach
    nothing. Without texts of both classes there is no model. Texts of the rarer class are copied to as many groups as
    it takes to give each about ``rare`` of them.
    """
    marks = (
        pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    )
    plain = pick(docs, "doc_id", "text").where("doc_id is not null")
    total = {int(q): n for q, n in plain.select("doc_id").join(marks, "doc_id").groupBy("quality").count().collect()}
    if len(total) < 2:
        return None
    fewer = min(total, key=lambda q: (total[q], q))
    n_groups = -(-sum(total.values()) // group)
    copies = min(n_groups, max(1, -(-rare * n_groups // total[fewer])))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = class_table()
        for batch in batches:
            x = [features(t, table).astype(np.float32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": x})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["g", "quality", "doc_id", "x"], ascending=[True, False, True, True], kind="stable")
        out = [(int(r["quality"].sum()), r["own"].to_numpy(bool).tobytes(), b"".join(r["x"])) for _, r in rows.groupby("g")]
        return pd.DataFrame(out, columns=["good", "own", "x"])

    # Features meet the labels, so no text is shuffled.
    scanned = plain.select("doc_id", whole_text().alias("text")).mapInPandas(compute, f"doc_id {kind}, x binary")
    known = scanned.join(marks.hint("merge"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "x")
    turns = F.when(F.col("quality") == fewer, copies).otherwise(1)
    known = known.select("*", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    place = F.pmod(F.xxhash64("doc_id") + F.col("turn") * (n_groups // copies), F.lit(n_groups)).alias("g")
    known = known.select("doc_id", "quality", "x", place, (F.col("turn") == 0).alias("own"))
    groups = durable(known.groupBy("g").applyInPandas(packed, "good int, own binary, x binary"), "quality_groups")

    n, *rest = summed(groups, moments)
    mean, square = np.split(np.array(rest) / n, 2)
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    model = Model(mean, scale, fit_pairs(groups, scale), 0.0)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, _, own in matrices(batches):
            yield pd.DataFrame({"raw": model.raw(x[own])})

    model.cut = cut_at(durable(groups.mapInPandas(raw, "raw double"), "quality_scores"), total[0])
    return model


def scorer(docs: DataFrame, model: Model | None) -> Column:
    """Score from 0 to 1 for the ``text`` column of ``docs``; 0.5 for all without a model."""
    if model is None:
        return F.lit(0.5)
    shared = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = class_table()
        for batch in batches:
            x = [features(t, table) for t in batch]
            yield pd.Series(held(shared).score(np.stack(x)) if x else [], dtype=float)

    return score(whole_text())


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted (1 if score >= CUT) for every row of ``docs`` (doc_id, text).

    A null text counts as empty and is scored too. Null ids stay null; repeated rows give repeated results, an empty table none.
    """
    plain = pick(docs, "doc_id", "text")
    rows = plain.select("doc_id", scorer(plain, model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
