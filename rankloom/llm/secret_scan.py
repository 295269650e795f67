"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

Everything is a DataFrame expression. Patterns give the base spans. Besides, every run of letters, digits and
``+/`` or ``_-`` (and ``=`` at its end) that mixes letters and digits is a candidate; its encoding (hex, base32, base36, base62, base64) is inferred from the
characters. Under the hypothesis "symbols are drawn evenly and independently" three tests give p-values:

* chi-squared: even use of the encoding's alphabet, from the count of equal pairs with its exact mean and variance;
* runs: the number of changes between letters and digits;
* serial correlation: neighbouring symbol values are unrelated.

Three times the least of them (Bonferroni) is the token's p-value. Ordinary words and identifiers fail it. Two rules, each within an
encoding and length class, decide from the counts of all tokens of the table which of them are called ordinary:

* Benjamini-Hochberg, so that the share of random strings among the tokens thrown out stays below ``RATE`` at each length;
* what is left may hold at most a share of ``FALSE`` of ordinary tokens, by the excess over random ones: random tokens
  spread their p-values as the three tests make them, so those above one half tell how many there are at each smaller value.

What is not thrown out and carries at least ``BITS`` bits is a secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import pick, whole_text
from rankloom.session import durable

KINDS = ("assign", "access", "hex")
#: The patterns of the base kinds. Access and hex hold their least length; letters of assign are in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: At least this many characters of the assigned value.
ASSIGN_VALUE = 6
#: A candidate has this many characters at least, and this many bits if all symbols were random.
LEAST = 16
BITS = 80.0
#: A whole run of ``+/`` text, or a piece of ``_-`` text, which a '+' or '/' ends. A '=' is part of a token only as padding at its end.
PADDING = r"(?:=++(?![A-Za-z0-9+/_-]))?"
TOKEN = (
    r"(?:(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{%d,}+(?![_-])|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{%d,}+)%s"
    % (LEAST, LEAST, PADDING)
)
RATE = 0.01
#: Estimated share of ordinary tokens among those reported, at most.
FALSE = 0.05
#: p-values are kept as whole steps of -log10 p: STEPS to a power of ten, down to 10 ** -DEEPEST.
STEPS, DEEPEST = 20, 60
ENCODINGS = ("hex", "base32", "base36", "base62", "base64")
#: Kind of a span that the battery adds.
RANDOM = "random_{}"
ALPHABET = {"hex": 16, "base32": 32, "base36": 36, "base62": 62, "base64": 64}
SPAN = "array<struct<start:long,end:long,kind:string>>"
CANDIDATE = "array<struct<start:long,end:long,encoding:string,length_class:int,step:int>>"
#: Items of an array that are folded at once.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, zero: Column, step) -> Column:
    """A fold (``at``, ``out``) over an array, block by block, so that the time grows with the length and not with its square.

    ``step`` takes a block's start state and its items and gives the state after them, with the block's own output in ``out``.
    """

    def walk(every: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))

        def block(state: Column, k: Column) -> Column:
            own = step(state["at"], F.slice(every, k * BLOCK + 1, F.lit(BLOCK)))
            return bound(own, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(blocks, zero, block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))

    return bound(items, walk)


def matches(text: Column, pattern: str, needs: Column, group: int = 0) -> Column:
    """Leftmost matches as array of (start, end, value): value is the matched group, places are code points.

    ``split`` gives what lies between the matches, so running lengths give the places. ``needs`` is a cheap test that
    every text with a match passes; texts that fail it or hold no match are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<start:long,end:long,value:string>>")

    def step(state: Column, part: Column) -> Column:
        a = state["at"] + F.length(part["gap"])
        b = a + F.coalesce(F.length(part["hit"]), F.lit(0))
        own = F.array(F.struct(a.alias("start"), b.alias("end"), part["value"].alias("value")))
        return F.struct(b.alias("at"), F.when(part["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], own)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,end:long,value:string>>>").alias("out"))
    every = folded(parts, zero, lambda at, block: F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step))["out"]
    return F.when(needs & text.rlike(pattern), every).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then by kind as listed."""
    assign = F.filter(matches(text, ASSIGN, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)

    def placed(found: Column, i: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("place"), m["end"].alias("end")))

    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    named = F.array_sort(F.concat(placed(assign, 0), placed(access, 1), placed(matches(text, HEX, F.lit(True)), 2)))
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(named, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kinds[m["place"]].alias("kind"))).cast(SPAN)


def tail(z: Column) -> Column:
    """-log10 of the chance that a standard normal value is farther from 0 than ``z``.

    1.1283 / (z + sqrt(z² + 2.546)) times the density approximates the tail (relative error below 1 %) for all z.
    """
    x = F.abs(z)
    return x * x / F.lit(2 * math.log(10)) - F.log10(F.lit(4 / math.sqrt(2 * math.pi)) / (x + F.sqrt(x * x + F.lit(8 / math.pi))))


def encoding_of(token: Column) -> Column:
    """The narrowest alphabet that a token with letters and digits fits; null if it does not mix them so."""
    body = F.rtrim(token, F.lit("="))
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    both = body.rlike("[a-z]") & body.rlike("[A-Z]")
    return (
        F.when(~mixed, None)
        .when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(body.rlike("^[0-9A-Za-z]+$"), "base62")
        .when(both & body.rlike("^([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)$"), "base64")
    )


def battery(token: Column, encoding: Column) -> Column:
    """-log10 of the combined p-value of evenness, runs and serial correlation. Sums are whole numbers, taken in one pass."""
    alphabet = F.create_map(*(F.lit(x) for pair in ALPHABET.items() for x in pair))[encoding].cast("double")
    names = ("n", "ones", "changes", "total", "squares", "products", "first", "last", "digit")
    zero = F.struct(*(F.lit(-1 if k in ("first", "digit") else 0).cast("long").alias(k) for k in names))

    def step(s: Column, c: Column) -> Column:
        x = F.ascii(F.lower(c)).cast("long")
        digit = F.when((c >= "0") & (c <= "9"), 1).otherwise(0).cast("long")
        new = {
            "n": s["n"] + 1,
            "ones": s["ones"] + digit,
            "changes": s["changes"] + F.when((s["digit"] >= 0) & (s["digit"] != digit), 1).otherwise(0),
            "total": s["total"] + x,
            "squares": s["squares"] + x * x,
            "products": s["products"] + x * s["last"],
            "first": F.when(s["first"] < 0, x).otherwise(s["first"]),
            "last": x,
            "digit": digit,
        }
        return F.struct(*(new[k].cast("long").alias(k) for k in names))

    def equal_pairs(symbols: Column) -> Column:
        each = lambda s, c: s + _choose_two(F.size(F.filter(symbols, lambda x: x == c)))
        return F.aggregate(F.array_distinct(symbols), F.lit(0.0), each)

    def combined(s: Column) -> Column:
        n = s["sums"]["n"].cast("double")
        # Pairs of equal symbols: n (n - 1) / 2 pairs are equal with chance 1 / alphabet, and pairwise independent.
        every = n * (n - 1) / 2
        z_even = (s["pairs"] - every / alphabet) / F.sqrt(every / alphabet * (1 - 1 / alphabet))
        ones = s["sums"]["ones"].cast("double")
        zeros = n - ones
        mean = 2 * ones * zeros / n
        variance = mean * (2 * ones * zeros - n) / (n * (n - 1))
        z_runs = F.when(variance > 0, (s["sums"]["changes"] - mean) / F.sqrt(variance)).otherwise(0.0)
        # n² times the sum of products of neighbours about the mean, and n² times the sum of squares about it.
        total, ends = s["sums"]["total"].cast("double"), s["sums"]["first"] + s["sums"]["last"]
        cross = n * n * s["sums"]["products"] - n * total * (2 * total - ends) + (n - 1) * total * total
        square = n * (n * s["sums"]["squares"] - total * total)
        z_serial = F.when(square > 0, cross / square * F.sqrt(n)).otherwise(F.sqrt(n))
        # Only too many equal pairs speak against randomness, so that side is one-sided.
        worst = F.greatest(tail(F.greatest(z_even, F.lit(0.0))), tail(z_runs), tail(z_serial))
        return F.greatest(worst - F.lit(math.log10(3)), F.lit(0.0))

    symbols = F.split(F.rtrim(token, F.lit("=")), "")
    sums = lambda own: F.struct(F.aggregate(own, zero, step).alias("sums"), equal_pairs(own).alias("pairs"))
    return bound(symbols, lambda own: bound(sums(own), combined))


def _choose_two(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def length_class(length: Column) -> Column:
    """Eight classes to each doubling of the length."""
    return F.floor(F.log2(length.cast("double")) * 8).cast("int")


def candidates(text: Column) -> Column:
    """Tokens that mix letters and digits: (start, end, encoding, class, step)."""
    sizes = F.create_map(*(F.lit(x) for pair in ALPHABET.items() for x in pair))
    bits = lambda m: F.length(F.rtrim(m["value"], F.lit("="))) * F.log2(sizes[m["encoding"]].cast("double"))
    token = matches(text, TOKEN, text.rlike("[0-9]"))
    typed = F.filter(
        F.transform(token, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), encoding_of(m["value"]).alias("encoding"))),
        lambda m: m["encoding"].isNotNull() & (bits(m) >= BITS),
    )
    tested = F.transform(
        typed,
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["encoding"].alias("encoding"),
            length_class(F.length(m["value"])).alias("length_class"),
            F.least(F.floor(battery(m["value"], m["encoding"]) * STEPS), F.lit(STEPS * DEEPEST)).cast("int").alias("step"),
        ),
    )
    return F.when(text.rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}"), tested).otherwise(F.array().cast(CANDIDATE))


def random_below(p: float) -> float:
    """Chance that a random token's combined p-value is at most ``p``: three times the least of three even values."""
    return 1.0 - (1.0 - p / 3.0) ** 3 if p < 1 else 1.0


def ordinary_from(rows: list[tuple[int, int]]) -> int | None:
    """The least step that is called ordinary, from the tokens (step, count) of one encoding and length class; None if none is."""
    total, below, limit = sum(c for _, c in rows), 0, None
    for step, count in sorted(rows, reverse=True):
        below += count
        # Every p-value of the step is at most 10 ** (-step / STEPS).
        if 10 ** (-step / STEPS) <= below * RATE / total:
            limit = step
    # p-values above one half, and one more so that a lone token is not taken for an excess, give the number of random tokens.
    half = next(s for s in range(STEPS) if 10 ** (-s / STEPS) <= 0.5)
    steady = (1 + sum(c for s, c in rows if s < half)) / (1.0 - random_below(10 ** (-half / STEPS)))
    ends = sorted({s + 1 for s, _ in rows if limit is None or s < limit}, reverse=True)
    for end in ends:
        if end <= half:
            break
        reported = sum(c for s, c in rows if s < end)
        expected = steady * (1.0 - random_below(10 ** (-end / STEPS)))
        if reported - expected <= FALSE * reported:
            return limit if end == ends[0] else end
    return half if ends and ends[0] > half else limit


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """By encoding and length class the least step that is called ordinary.

    Counts by step come from all candidates of the table; there are at most encodings x length classes x
    (STEPS * DEEPEST + 1) of them, so they fit the driver however many tokens there are. A class without such a step is absent.
    """
    tokens = found.select(F.inline("candidates")).groupBy("encoding", "length_class", "step").count()
    steps: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for encoding, length, step, count in tokens.collect():
        steps.setdefault((encoding, length), []).append((step, count))
    limits = {key: ordinary_from(rows) for key, rows in steps.items()}
    return {key: limit for key, limit in limits.items() if limit is not None}


def scanned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with array columns base and candidates, as a written table."""
    text = whole_text()
    return durable(docs.withColumns({"base": base_spans(text), "candidates": candidates(text)}), "secrets")


def all_spans(limits: dict[tuple[str, int], int]) -> Column:
    """Base spans and the tokens that pass the battery, by start, kind of the base, then encoding."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, *map(RANDOM.format, ENCODINGS))) for x in (k, i)))
    kept = F.col("candidates")
    if limits:
        table = F.create_map(*(F.lit(x) for (e, c), s in sorted(limits.items()) for x in (f"{e} {c}", s)))
        limit = lambda m: table[F.concat_ws(" ", m["encoding"], m["length_class"].cast("string"))]
        kept = F.filter(kept, lambda m: F.coalesce(m["step"] < limit(m), F.lit(True)))
    fresh = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.format_string(RANDOM.format("%s"), m["encoding"]).alias("kind")))
    placed = F.transform(
        F.concat(F.col("base"), fresh.cast(SPAN)),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), order[m["kind"]].alias("place"), m["kind"].alias("kind")),
    )

    def once(every: Column) -> Column:
        # Sorted so, an added span that is a base span already stands right behind it, and is not listed twice.
        before = lambda i: F.get(every, i - 1)
        again = lambda m, i: (m["place"] >= len(KINDS)) & (before(i)["start"] == m["start"]) & (before(i)["end"] == m["end"])
        return F.filter(every, lambda m, i: ~F.coalesce(again(m, i), F.lit(False)))

    kept = bound(F.array_sort(placed), once)
    by_kind = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["place"].alias("place"), m["end"].alias("end"), m["kind"].alias("kind")))
    return F.transform(F.array_sort(by_kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))).cast(SPAN)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by ``mask``; the text is cut once for each block of spans."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<string>>").alias("out"))

    def block(at: Column, own: Column) -> Column:
        stop = F.array_max(F.transform(own, lambda m: m["end"]))

        def inside(piece: Column) -> Column:
            def step(state: Column, m: Column) -> Column:
                gap = F.substring(piece, (state["at"] - at + 1).cast("int"), F.greatest(m["start"] - state["at"], F.lit(0)).cast("int"))
                more = F.when(m["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], F.array(gap, F.lit(mask))))
                return F.struct(F.greatest(state["at"], m["end"]).alias("at"), more.alias("out"))

            return F.aggregate(own, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)

        return bound(F.substring(text, (at + 1).cast("int"), F.greatest(stop - at, F.lit(0)).cast("int")), inside)

    whole = folded(spans, zero, block)
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(bound(whole, rest))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans (arrays of start, end, kind) for every row of ``docs`` (doc_id, text).

    Places are code points of the whole text, end exclusive. A null or empty text has no spans; null ids stay null;
    repeated rows give repeated results (and their tokens count as often in the false-discovery control); an empty table gives no rows.
    """
    plain = pick(docs, "doc_id", "text")
    found = durable(
        plain.select("doc_id", base_spans(whole_text()).alias("base"), candidates(whole_text()).alias("candidates")), "secrets"
    )
    return found.select("doc_id", "base", all_spans(thresholds(found)).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """All columns of ``docs`` with the secrets in ``text`` masked; n_chars, if there, follows the new text.

    Rows without a secret come out as they were, a null text stays null.
    """
    columns = docs.columns
    rows = docs.toDF(*(f"column_{i}" for i in range(len(columns)))).withColumn("text", F.col(f"column_{columns.index('text')}"))
    found = scanned(rows)
    spans = all_spans(thresholds(found))
    out = found.withColumn("spans", spans).withColumn("clean", masked(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0

    def column(i: int, name: str) -> Column:
        old = F.col(f"column_{i}")
        if name == "text":
            return F.when(hit, F.col("clean")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(hit, F.length("clean").cast(docs.schema[i].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*(column(i, c) for i, c in enumerate(columns)))
