"""Fit feature encoders on one table and apply them to others.

Fitted state is small tables and numbers; applying it is projections and joins.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.columns import (
    CANONICAL,
    ITEM,
    RATING,
    RELEVANT,
    ROW,
    TEXT_DIM,
    TIME,
    UNDEFINED,
    USER,
)
from rankloom.functions.hashing import digest, digest_number
from rankloom.functions.text import category, text_document, tokens_of
from rankloom.functions.vectors import l2_normalize
from rankloom.operators.cleaning import number
from rankloom.operators.ordering import with_positions
from rankloom.session import durable

# The roles that a source declares for its columns, and the kind of feature that each becomes.
KIND_OF_ROLE = {"num": "numeric", "bin": "categorical", "cat": "categorical", "text": "text", "list": "list"}
FEATURE_TYPES = tuple(dict.fromkeys(KIND_OF_ROLE.values()))
# Asked for in published settings, but no feature here.
NO_FEATURE = "time"


def feature_types(names) -> tuple[str, ...]:
    """The kinds of features asked for, each once; one that is not known is an error, ``time`` is passed over."""
    asked = dict.fromkeys(names)
    asked.pop(NO_FEATURE, None)
    if not asked.keys() <= set(FEATURE_TYPES):
        raise ValueError(f"features are of the kinds {', '.join(FEATURE_TYPES)}; asked for {', '.join(map(str, asked))}")
    return tuple(asked)


def resolve_roles(roles: dict[str, list[str]], columns: list[str], types=FEATURE_TYPES) -> dict[str, list[str]]:
    """Columns of each kind of feature: declared by a role, present, not canonical, and of a kind asked for."""
    present, asked = set(columns) - set(CANONICAL), feature_types(types)
    found: dict[str, list[str]] = {kind: [] for kind in FEATURE_TYPES}
    for role, kind in KIND_OF_ROLE.items():
        if kind in asked:
            found[kind] += [c for c in roles.get(role, ()) if c in present]
    return found


# --- numeric ----------------------------------------------------------------------


def fit_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, minimum and maximum per column, as rows, from one aggregation."""
    stats = []
    for c in columns:
        x = number(F.col(c))
        stats.append(F.struct(F.lit(c).alias("column"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def encode_numeric(columns: list[str], stats: list) -> list[Column]:
    """Impute by the mean, then scale to the fitted range; a constant column gives 0."""
    known = {r["column"]: r for r in stats}
    out = []
    for c in columns:
        s = known[c]
        mean = s["mean"] if s["mean"] is not None else 0.0
        low = s["low"] if s["low"] is not None else 0.0
        high = s["high"] if s["high"] is not None else 0.0
        width = high - low if high != low else 1.0
        value = F.coalesce(number(F.col(c)), F.lit(mean))
        out.append(((value - F.lit(low)) / F.lit(width)).alias(f"num__{c}"))
    return out


# --- categories and list vocabularies ------------------------------------------------


def _codes(values: DataFrame) -> DataFrame:
    placed = with_positions(values.distinct(), ["column"], [F.col("value").asc()], "_pos")
    return placed.select("column", "value", (F.col("_pos") - 1).cast("int").alias("code"))


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Codes ``(column, value, code)`` by sorted value; a missing value is a category."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(category(F.col(c)), F.lit(UNDEFINED)).alias("value"))
        for c in columns
    ])
    return _codes(df.select(F.inline(cells)))


def encode_categories(df: DataFrame, columns: list[str], codes: DataFrame) -> DataFrame:
    """Add ``cat__<column>`` codes; a value not seen when fitting becomes -1."""
    for c in columns:
        near = codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        value = F.coalesce(category(F.col(c)), F.lit(UNDEFINED))
        df = df.join(near, value == F.col("_v"), "left")
        df = df.withColumn(f"cat__{c}", F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
    return df


def cardinalities(codes: DataFrame) -> DataFrame:
    """Categories per column plus one."""
    return codes.groupBy("column").agg((F.count(F.lit(1)) + 1).alias("cardinality"))


def fit_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Vocabulary ``(column, value, code)`` of list-like columns by sorted token."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), tokens_of(df, c).alias("tokens")) for c in columns])
    lists = df.select(F.inline(cells))
    return _codes(lists.select("column", F.explode("tokens").alias("value")))


def encode_lists(df: DataFrame, columns: list[str], vocabulary: DataFrame) -> DataFrame:
    """Add ``list__<column>``: the sorted codes of a row's tokens; tokens outside the vocabulary count for nothing.

    One join on (column, token) serves all columns. Rows with the same tokens in every column are looked up once, by what they
    hold and not by a key, which may repeat or be null. ``dense_list`` gives the 0/1 vector.
    """
    if not columns:
        return df
    sets = F.array(*[F.array_sort(F.array_distinct(tokens_of(df, c))) for c in columns])
    given = df.withColumn("_sets", sets)
    entries = given.select("_sets").distinct().select("_sets", F.posexplode("_sets").alias("_at", "_set"))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_at") + 1).alias("column")
    entries = entries.select("_sets", "_at", named, F.explode("_set").alias("value"))
    found = entries.join(vocabulary.select("column", "value", "code"), ["column", "value"])
    found = found.groupBy("_sets").agg(F.sort_array(F.collect_list(F.struct("_at", "code"))).alias("_found"))
    rows = given.join(found, "_sets", "left")
    held = F.coalesce("_found", F.array().cast("array<struct<_at:int,code:int>>"))

    def codes_at(place: int) -> Column:
        return F.transform(F.filter(held, lambda h: h["_at"] == place), lambda h: h["code"])

    codes = {f"list__{c}": codes_at(i) for i, c in enumerate(columns)}
    return rows.withColumns(codes).select(*df.columns, *codes)


def dense_list(codes: Column, size: int) -> Column:
    """The 0/1 vector over a vocabulary of ``size`` tokens, for exports."""
    if size == 0:
        return F.array().cast("array<float>")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(codes, i).cast("float"))


def vocabulary_sizes(vocabulary: DataFrame) -> dict[str, int]:
    """Tokens per column; one row per column."""
    return {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


# --- text -------------------------------------------------------------------------


COUNTS = "_counts"
#: Words whose dimension a task remembers.
HELD_WORDS = 1 << 18


def word_counts(dim: int):
    """Words of a text by dimension, as a function of a column. A word is hashed once while a task remembers it."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch:
                counts = [0] * dim
                for word, n in Counter(text.split(" ")).items():
                    place = places.get(word)
                    if place is None and word:
                        if len(places) >= HELD_WORDS:
                            places.clear()
                        digest = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
                        place = places[word] = int(digest[:8], 16) % dim
                    if word:
                        counts[place] += n
                out.append(counts)
            yield pd.Series(out)

    return run


@dataclass
class HashedTextEncoder:
    """Unit vectors from hashed word counts weighted by inverse document frequency.

    A word's dimension is the first 32 bits of its md5 modulo ``dim``, so any engine can repeat it. Fitting keeps one
    number a dimension: ln((documents + 1) / (documents with the dimension + 1)).
    """

    dim: int = TEXT_DIM
    weights: list[float] | None = None

    def counted(self, documents: DataFrame) -> DataFrame:
        """``documents`` with the number of words of each dimension; written once, they serve the fit and the vectors."""
        if COUNTS in documents.columns:
            return documents
        return documents.withColumn(COUNTS, word_counts(self.dim)(F.coalesce("document", F.lit(""))))

    def fit(self, documents: DataFrame) -> "HashedTextEncoder":
        places = F.sequence(F.lit(0), F.lit(self.dim - 1))
        held = self.counted(documents).select(F.filter(places, lambda i: F.get(COUNTS, i) > 0).alias("_d"))
        # At most ``dim`` counts, and that of the documents.
        counts = held.select(F.explode(F.concat("_d", F.array(F.lit(-1)))).alias("d")).groupBy("d").count().collect()
        found = {r["d"]: r["count"] for r in counts}
        total = found.get(-1, 0)
        self.weights = [math.log((total + 1.0) / (found.get(i, 0) + 1.0)) for i in range(self.dim)]
        return self

    def transform(self, documents: DataFrame, name: str = "text") -> DataFrame:
        if self.weights is None:
            raise RuntimeError("the text encoder is not fitted")
        weighted = F.zip_with(COUNTS, F.lit(self.weights), lambda n, w: n * w)
        return self.counted(documents).withColumn(name, l2_normalize(weighted).cast("array<float>")).drop(COUNTS)


def encode_text(df: DataFrame, encoder, dim: int, name: str = "text") -> DataFrame:
    """Vectors of a user's Arrow ``pandas_udf`` encoder: checked width, unit length."""
    wrong = F.raise_error(F.lit(f"the text encoder must return {dim} numbers")).cast("array<double>")
    raw = df.withColumn("_raw", encoder(F.col("document")).cast("array<double>"))
    checked = F.when(F.size("_raw") == dim, F.col("_raw")).otherwise(wrong)
    return raw.withColumn(name, l2_normalize(checked).cast("array<float>")).drop("_raw")


# --- feature vectors of any width -----------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Places of a feature vector: numbers and tokens, then text, then category codes."""

    dense: int = 0
    text: int = 0
    codes: int = 0

    @property
    def width(self) -> int:
        return self.dense + self.text + self.codes


def layouts(metadata: DataFrame) -> dict[str, Layout]:
    """The layout of each group that feature metadata describe."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("int").alias(kind)
    rows = metadata.groupBy("grp").agg(of("dense", F.lit(1)), of("text", F.col("cardinality")), of("categorical", F.lit(1)))
    return {r["grp"]: Layout(r["dense"], r["text"], r["categorical"]) for r in rows.collect()}


def seeded_signs(dim: int, seed: Column, *parts: Column) -> tuple[Column, list[Column]]:
    """Digests to be named ``_h``, and ``dim`` signs (1 or -1) read from a column of that name."""
    hexes = F.array(*[digest(seed, *parts, b) for b in range((dim + 3) // 4)])
    even = [F.pmod(digest_number(F.get("_h", F.lit(i // 4)), i % 4), F.lit(2)) == 0 for i in range(dim)]
    return hexes, [F.when(e, F.lit(1.0)).otherwise(F.lit(-1.0)) for e in even]


def project(features: DataFrame, layout: Layout, dim: int, seeds) -> DataFrame:
    """Seeded random projections ``(seed, id, vector, plain)`` of ``(id, features)`` to ``dim`` numbers, for each seed.

    A number or a text entry counts with its value in the signs of its place, a category with 1 in the signs of its place and
    code. ``plain`` leaves the text out. Entries are added up per dimension before the shuffle, so neither the width of a vector nor
    the size of a vocabulary reaches it. A null vector gives no row, another width than the layout's is an error.
    """
    wrong = F.raise_error(F.lit(f"feature vectors must have {layout.width} entries")).cast("array<double>")
    whole = F.when(F.size("features") == layout.width, F.col("features").cast("array<double>")).otherwise(wrong)
    given = features.where(F.col("features").isNotNull()).select("id", whole.alias("_f"))
    entries = given.select("id", F.posexplode("_f").alias("_at", "_x"))
    code = F.col("_at") >= layout.dense + layout.text
    spelled = F.when(code, F.concat_ws(":", "_at", F.col("_x").cast("long"))).otherwise(F.col("_at").cast("string"))
    amount = F.when(code, F.lit(1.0)).otherwise(F.nanvl(F.coalesce("_x", F.lit(0.0)), F.lit(0.0)))
    plain = code | (F.col("_at") < layout.dense)
    entries = entries.select("id", spelled.alias("_token"), amount.alias("_x"), plain.alias("_plain"))
    # A vector of zeros keeps one entry, so that its entity is known.
    entries = entries.where((F.col("_x") != 0) | (F.col("_token") == "0"))
    entries = entries.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hexes, signs = seeded_signs(dim, F.col("seed"), F.lit("feature"), F.col("_token"))
    root = F.lit(dim**0.5)
    sums = []
    for i, sign in enumerate(signs):
        part = F.col("_x") * sign / root
        sums += [F.sum(part).alias(f"_d{i}"), F.sum(F.when(F.col("_plain"), part).otherwise(F.lit(0.0))).alias(f"_p{i}")]
    summed = entries.withColumn("_h", hexes).groupBy("seed", "id").agg(*sums)
    arrays = [F.array(*[F.col(f"_{c}{i}") for i in range(dim)]).alias(name) for c, name in (("d", "vector"), ("p", "plain"))]
    return summed.select("seed", "id", *arrays)


# --- everything together ------------------------------------------------------------


@dataclass
class FeatureEncoder:
    """Encoders of one table: fit once, then transform any table of that shape.

    Users and items are fitted on their full tables, interactions on training rows.
    """

    roles: dict[str, list[str]]
    key: str
    types: tuple[str, ...] = FEATURE_TYPES
    text_dim: int = TEXT_DIM
    max_tokens: int | None = None
    text_encoder: object = None
    groups: dict[str, list[str]] = field(default_factory=dict)
    numeric: list = field(default_factory=list)
    codes: DataFrame | None = None
    vocabulary: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)
    fitted: bool = False

    def fit(self, df: DataFrame) -> "FeatureEncoder":
        self.groups = resolve_roles(self.roles, df.columns, self.types)
        g = self.groups
        if g["numeric"]:
            self.numeric = fit_numeric(df, g["numeric"]).collect()
        if g["categorical"]:
            self.codes = durable(fit_categories(df, g["categorical"]), "categories")
        if g["list"]:
            self.vocabulary = durable(fit_vocabulary(df, g["list"]), "vocabulary")
            self.sizes = vocabulary_sizes(self.vocabulary)
        if g["text"] and self.text_encoder is None:
            self.text_encoder = HashedTextEncoder(self.text_dim).fit(self._documents(df))
        self.fitted = True
        return self

    def _documents(self, df: DataFrame) -> DataFrame:
        return df.withColumn("document", text_document(self.groups["text"], self.max_tokens))

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encoded columns ``num__…``, ``list__…``, ``text`` and ``cat__…`` per row; lists are codes until ``vector``."""
        if not self.fitted:
            raise RuntimeError("the encoder is not fitted")
        g, keep = self.groups, keep or [self.key]
        out = df.select("*", *encode_numeric(g["numeric"], self.numeric))
        if g["categorical"]:
            out = encode_categories(out, g["categorical"], self.codes)
        if g["list"]:
            out = encode_lists(out, g["list"], self.vocabulary)
        if g["text"]:
            out = self._documents(out)
            if isinstance(self.text_encoder, HashedTextEncoder):
                out = self.text_encoder.transform(out)
            else:
                out = encode_text(out, self.text_encoder, self.text_dim)
        return out.select(*keep, *self.columns())

    def columns(self) -> list[str]:
        g = self.groups
        return [
            *[f"num__{c}" for c in g["numeric"]],
            *[f"list__{c}" for c in g["list"]],
            *(["text"] if g["text"] else []),
            *[f"cat__{c}" for c in g["categorical"]],
        ]

    def vector(self, encoded: DataFrame) -> DataFrame:
        """One ``(key, features)`` row per entity: numbers, lists, text, then codes."""
        parts = []
        for c in self.columns():
            if c.startswith("list__"):
                parts.append(dense_list(F.col(c), self.sizes.get(c.removeprefix("list__"), 0)))
            else:
                parts.append(F.col(c) if c == "text" else F.array(F.col(c).cast("float")))
        empty = F.array().cast("array<float>")
        return encoded.select(self.key, F.concat(empty, *parts).cast("array<float>").alias("features"))

    def layout(self) -> "Layout":
        g = self.groups
        return Layout(len(g["numeric"]) + sum(self.sizes.values()), self.text_dim if g["text"] else 0, len(g["categorical"]))

    def metadata(self, group: str, spark) -> DataFrame:
        """Rows ``(grp, column, kind, cardinality)`` that describe the feature vector.

        A list column counts one per token and text one per vector entry.
        """
        g = self.groups
        fixed = [(group, c, "dense", 1) for c in g["numeric"]]
        fixed += [(group, "text", "text", self.text_dim)] if g["text"] else []
        schema = "grp string, column string, kind string, cardinality bigint"
        out = spark.createDataFrame(fixed, schema)
        if self.codes is not None:
            sized = cardinalities(self.codes)
            out = out.unionByName(sized.select(F.lit(group).alias("grp"), "column", F.lit("categorical").alias("kind"), "cardinality"))
        if self.vocabulary is not None:
            tokens = self.vocabulary.select(
                F.lit(group).alias("grp"),
                F.concat_ws("__", F.lit("list"), "column", "value").alias("column"),
                F.lit("dense").alias("kind"),
                F.lit(1).cast("bigint").alias("cardinality"),
            )
            out = out.unionByName(tokens)
        return out


def encode_passthrough(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Canonical columns as numbers: dense ids, strict times, other nulls as 0.

    ``users`` and ``items`` map raw ids to ``idx``; an unknown id becomes -1 and a
    time that is no number fails the job.
    """
    from rankloom.operators.ids import map_ids

    out = map_ids(map_ids(df, users, USER), items, ITEM)
    for c in (RATING, RELEVANT):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(number(F.col(c)), F.lit(0.0)))
    if TIME in out.columns:
        bad = F.raise_error(F.lit("interactions hold invalid timestamps")).cast("bigint")
        out = out.withColumn(TIME, F.coalesce(F.col(TIME).try_cast("bigint"), bad))
    return out.select(*[c for c in (*CANONICAL, ROW) if c in out.columns], *[
        c for c in out.columns if c not in CANONICAL and c != ROW
    ])
