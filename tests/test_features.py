
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import names
from rankloom.functions.hashing import digest, draw, unit_draw
from rankloom.functions.text import (
    category,
    clean_text,
    flatten_list_text,
    list_tokens,
    literal_list,
    text_document,
    unescape_html,
)
from rankloom.functions.times import academic_year, epoch_seconds
from rankloom.operators import encoding as E
from rankloom.operators import ids

# Text, and what is left of it when read by hand.
CLEANED = [
    ("Tom &amp; Jerry &lt;b&gt;Bold&lt;/b&gt; <i>x</i>", "tom & jerry bold x"),
    ("see https://a.example/b?c=1&amp;d and www.z.example now", "see and now"),
    ("  Tabs\tand\nlines\xa0non-breaking\u2003wide  ", "tabs and lines non-breaking wide"),
    ("&eacute;t&eacute; &#39;q&#39; &notanentity; &copy 2020", "été 'q' ¬anentity; © 2020"),
    ("ÀÉ <br/>Z", "àé z"),
    ("", ""),
    (None, ""),
    ("<unclosed and plain > done", "done"),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).select("i", expression(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def test_clean_text(spark):
    texts, expected = zip(*CLEANED)
    assert apply(spark, texts, clean_text) == list(expected)
    assert apply(spark, ["a &amp; &lt;b&gt;", "&#39;&eacute;&#39; &copy 1", "no sign", None], unescape_html) == ["a & <b>", "'é' © 1", "no sign", None]


def test_character_references_equal_the_standard_library(spark):
    """Numbers of every kind, all names with and without what follows them, and random mixtures."""
    import random
    from html import unescape
    from html.entities import html5

    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**25]
    texts = [f"a&#{n};b&#x{n:X}c&#X000{n:x};" for n in numbers]
    texts += [f"&{n}&{n.rstrip(';')}x;&{n.rstrip(';')} " for n in html5]
    draw = random.Random(5)
    bits = ["&", "#", "x", "amp", ";", "lt", "not", "in", "ity", "41", " ", "é", "\n", "&notin;", "&&", "&#;", "&#x;", "<", "𝒜", "&acE;", "a" * 40]
    texts += ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(3000)]
    assert apply(spark, texts, unescape_html) == [unescape(t) for t in texts]


def test_list_literals_equal_the_standard_parser(spark):
    import ast
    import random

    def plain(text):
        try:
            found = ast.literal_eval(text.strip())
        except (SyntaxError, ValueError):
            return None
        return [str(x) for x in found] if isinstance(found, list) else None

    draw = random.Random(6)
    bits = ["'a'", '"b"', "'it\\'s'", '"q\\"r"', "'c\\\\n'", "'d\\n'", "'e\\te'", "'\\x41'", "1", "-2", "0", "-0", "007", "1.50", "None", "True", "Falsey", "['n']", "''", "'[,]'", "'x\ny'"]
    texts = ["[" + draw.choice([", ", ",", " , "]).join(draw.choices(bits, k=draw.randint(0, 5))) + draw.choice(["]", "]", "]", ",]", " ]"]) for _ in range(1500)]
    texts += [f"[{b}]" for b in bits] + ["[,]", "['a' 'b']", "[1 2]", "[True False]", "[1,,2]"]
    assert apply(spark, texts, literal_list) == [plain(t) for t in texts]


# Lists written in several ways, and their tokens by hand.
LISTS = [
    ("['a', 'b']", ["a", "b"]),
    ('["x", "y z"]', ["x", "y z"]),
    ("[1, 2.5, None]", ["1", "2.5", "None"]),
    ("[\"it's\", 'b']", ["it's", "b"]),
    ("['a' 'b']", ["ab"]),
    ("[]", []),
    ("['a', ' ', '']", ["a"]),
    ("[broken, 'x'", ["[broken", "'x'"]),
    ("[bad, list]", ["[bad", "list]"]),
    ("a;b", ["a", "b"]),
    ("a|b", ["a", "b"]),
    ("a, b;c", ["a", "b;c"]),
    ("a", ["a"]),
    ("  ", []),
    (None, []),
    ("('t', 'u')", ["('t'", "'u')"]),
    ("['a\\'b', 'c']", ["a'b", "c"]),
    ("[['n'], 'm']", ["['n']", "m"]),
    ("['a',]", ["a"]),
]


def test_list_tokens(spark):
    values, expected = zip(*LISTS)
    assert apply(spark, values, list_tokens) == list(expected)
    arrays = apply(spark, [[" a ", "", "b"], None], lambda c: list_tokens(c, T.ArrayType(T.StringType())), "array<string>")
    assert arrays == [["a", "b"], []]
    numbers = apply(spark, [7.5, float("nan"), None], lambda c: list_tokens(c, T.DoubleType()), "double")
    assert numbers == [["7.5"], [], []]


def test_flatten_list_text(spark):
    got = apply(spark, ["['a', ' b ']", "[]", "plain, text", "[broken", None], flatten_list_text)
    assert got == ["a b", "", "plain, text", "[broken", None]


def test_text_document(spark):
    df = spark.createDataFrame([("Big <b>Cat</b>", None), (None, "d"), (None, None)], "a string, b string")
    docs = [r[0] for r in df.select(text_document(["a", "b"])).collect()]
    assert docs == ["a: big cat", "b: d", ""]
    both = spark.createDataFrame([("x y", "z")], "a string, b string")
    assert both.select(text_document(["a", "b"])).first()[0] == "a: x y [SEP] b: z"
    assert both.select(text_document(["a", "b"], 4)).first()[0] == "a: x y [SEP]"


def test_small_functions(spark):
    assert apply(spark, [" a ", " \t", None], category) == ["a", None, None]
    assert apply(spark, ["19-20", "1920", None, "x"], academic_year) == [2019, None, None, None]
    times = ["2024-01-01 00:00:01", "1969-12-31 23:59:59.5", "never", None]
    assert apply(spark, times, epoch_seconds) == [1704067201, -1, None, None]
    assert apply(spark, ["Hit @10!", "__x--Y__"], names.safe_name) == ["hit_10", "x_y"]
    assert apply(spark, ["COCO", "my_set"], names.dataset_label) == ["COCO", "My Set"]
    assert apply(spark, ["no_graph", "extra_part"], names.component_label) == ["Grafo", "Extra Part"]
    assert apply(spark, ["mrr", "hit", "zzz"], lambda c: names.place_in(c, names.METRIC_ORDER)) == [5, 1, 7]


def test_field_names():
    assert [names.field_name(n) for n in (" A b ", "2x", "__", "a--b__c")] == ["a_b", "f_2x", "field", "a_b_c"]
    got = names.field_names(["user_id", "A b", "a_b", "a-b"], "inter")
    assert got == {"user_id": "user_id", "A b": "inter_a_b", "a_b": "inter_a_b_2", "a-b": "inter_a_b_3"}
    # A name that a column has on its own is not given to another one.
    assert names.field_names(["a", "A", "a_2"], None) == {"a": "a", "A": "a_3", "a_2": "a_2"}
    assert names.field_type("item_id", set()) == "token" and names.field_type("x", {"x"}) == "token"
    assert names.field_type("x", set()) == "float"


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    pick = lambda d: sorted(map(tuple, d.select("id", draw(97, 5, F.col("id")), unit_draw(5, F.col("id"))).collect()))
    assert pick(df) == pick(df.repartition(9))
    assert all(0 <= a < 97 and 0 <= b < 1 for _, a, b in pick(df))
    import hashlib

    assert df.select(digest("s", F.col("id"))).first()[0] == hashlib.md5(b"s|0").hexdigest()


# --- encoders -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, 1.0, 5.0, "b", "['x', 'y']", "Red car"),
        (2, 3.0, 5.0, " a ", "y;z", "blue car"),
        (3, None, 5.0, None, None, None),
        (4, 2.0, 5.0, "b", "z", "red bus"),
    ]
    return spark.createDataFrame(rows, "item_id int, n double, const double, c string, l string, t string")


ROLES = {"num": ["n", "const", "absent"], "cat": ["c"], "list": ["l"], "text": ["t"]}


def test_encoder(table, spark):
    enc = E.FeatureEncoder(ROLES, "item_id", text_dim=8).fit(table)
    rows = {r["item_id"]: r for r in enc.transform(table).collect()}
    assert [rows[i]["num__n"] for i in (1, 2, 3, 4)] == [0.0, 1.0, 0.5, 0.5]
    assert {r["num__const"] for r in rows.values()} == {0.0}
    assert [rows[i]["cat__c"] for i in (1, 2, 3, 4)] == [2, 1, 0, 2]  # Undefined, a, b
    assert [rows[i]["list__l"] for i in (1, 2, 3, 4)] == [[0, 1], [1, 2], [], [2]]
    assert sum(x * x for x in rows[1]["text"]) == pytest.approx(1, abs=1e-5) and set(rows[3]["text"]) == {0.0}
    assert enc.vector(enc.transform(table)).count() == table.count()
    assert {len(r["features"]) for r in enc.vector(enc.transform(table)).collect()} == {2 + 3 + 8 + 1}
    new = spark.createDataFrame([(9, 5.0, 7.0, "q", "unknown", "z")], table.schema)
    row = enc.transform(new).first()
    assert (row["num__n"], row["num__const"], row["cat__c"], row["list__l"]) == (2.0, 2.0, -1, [])
    meta = {(r["column"], r["kind"], r["cardinality"]) for r in enc.metadata("items", spark).collect()}
    assert ("c", "categorical", 4) in meta and ("list__l__x", "dense", 1) in meta and ("text", "text", 8) in meta


def test_encoder_guards(table):
    with pytest.raises(RuntimeError):
        E.FeatureEncoder(ROLES, "item_id").transform(table)
    with pytest.raises(RuntimeError):
        E.HashedTextEncoder(4).transform(table)
    with pytest.raises(ValueError):
        E.feature_types(("numeric", "sound"))
    assert E.feature_types(("time", "text", "text", "list")) == ("text", "list")
    groups = E.resolve_roles({"bin": ["b"], "cat": ["rating", "c"], "num": ["n"]}, ["b", "c", "rating", "n"], ("categorical",))
    assert groups == {"numeric": [], "categorical": ["b", "c"], "text": [], "list": []}


def test_hashed_text_matches_brute_force(spark):
    import hashlib
    import math

    docs = ["a b a", "b c", "c", "", "  a  d "]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, document string")
    enc = E.HashedTextEncoder(6).fit(df)
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 6
    counts = [[0] * 6 for _ in docs]
    for row, d in zip(counts, docs):
        for w in d.split():
            row[place(w)] += 1
    found = [sum(1 for r in counts if r[j]) for j in range(6)]
    for r in enc.transform(df).collect():
        raw = [n * math.log((len(docs) + 1) / (found[j] + 1)) for j, n in enumerate(counts[r["i"]])]
        length = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert r["text"] == pytest.approx([x / length for x in raw], abs=1e-6)


def test_custom_text_encoder_is_checked(table):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def two(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [3.0, 4.0])

    enc = E.FeatureEncoder(ROLES, "item_id", text_dim=2, text_encoder=two).fit(table)
    assert enc.transform(table).first()["text"] == pytest.approx([0.6, 0.8])
    enc = E.FeatureEncoder(ROLES, "item_id", text_dim=3, text_encoder=two).fit(table)
    with pytest.raises(Exception, match="3 numbers"):
        enc.transform(table).collect()


# --- ids ----------------------------------------------------------------------------------


def test_ids(spark):
    entities = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "k string, o int")
    events = spark.createDataFrame([("z", 0), ("a", 1), ("c", 2), ("z", 3)], "k string, o int")
    for hot_rows in (100, 1):
        got = ids.first_seen_ids(entities, F.col("o"), events, F.col("o"), "k", hot_rows=hot_rows)
        assert {r["k"]: r["idx"] for r in got.collect()} == {"b": 0, "a": 1, "z": 2, "c": 3}
    mapped = ids.map_ids(spark.createDataFrame([("a",), ("q",)], "k string"), got, "k")
    assert sorted(r["k"] for r in mapped.collect()) == [-1, 1]


def test_translation_needs_a_counterpart(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, token string")
    right = spark.createDataFrame([(7, "x")], "id bigint, token string")
    assert ids.translate_ids(left.where("id = 1").select("id"), left, right).first()["id"] == 7
    with pytest.raises(Exception, match="counterpart"):
        ids.translate_ids(left.select("id"), left, right).collect()


def test_passthrough_rejects_bad_times(spark):
    users = spark.createDataFrame([(5, 0)], "user_id bigint, idx bigint")
    items = spark.createDataFrame([(8, 0)], "item_id bigint, idx bigint")
    good = spark.createDataFrame([(5, 9, "x", "12")], "user_id bigint, item_id bigint, rating string, timestamp string")
    row = E.encode_passthrough(good, users, items).first()
    assert (row["user_id"], row["item_id"], row["rating"], row["timestamp"]) == (0, -1, 0.0, 12)
    with pytest.raises(Exception, match="timestamps"):
        E.encode_passthrough(good.withColumn("timestamp", F.lit("soon")), users, items).collect()


def test_counted_texts_are_read_once(spark):
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(["a b a", "b c", None, ""])], "i int, document string")
    counted = E.HashedTextEncoder(6).counted(docs).drop("document")
    got = E.HashedTextEncoder(6).fit(counted).transform(counted).orderBy("i").collect()
    whole = E.HashedTextEncoder(6).fit(docs).transform(docs).orderBy("i").collect()
    assert [r["text"] for r in got] == [r["text"] for r in whole]
    assert sum(counted.orderBy("i").first()[E.COUNTS]) == 3
