"""The same results as plain SQL over the test tables, for checking."""

from __future__ import annotations

PROTOCOL = "one-target-per-interaction-v1"

# --- shared views -------------------------------------------------------------------------

EV = """ev AS (
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_id, value AS rating,
         epoch_us(ts) // 1000000 AS t, event_id AS row_id, event_type
  FROM events)"""

ORD = """ord AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, epoch_us(o_orderdate) // 1000000 AS t,
         l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ORD_KEY = "l_orderkey DESC, l_linenumber DESC, item_id DESC, l_suppkey DESC, rating DESC, l_extendedprice DESC"


def dedup(source: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t DESC, {key}) AS rn FROM {source})
  WHERE rn = 1)"""


SIZES = """greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS a,
  greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS b"""


def split(source: str, order: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (n, pos, a, b),
  CASE WHEN n < 3 THEN 'train'
       WHEN pos <= CASE WHEN a + b >= n THEN 1 ELSE a END THEN 'test'
       WHEN pos <= CASE WHEN a + b >= n THEN 2 ELSE a + b END THEN 'val'
       ELSE 'train' END AS split
  FROM (SELECT *, {SIZES} FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
           row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS pos FROM {source})))"""


def label(source: str, name: str) -> str:
    return f"""{name} AS (SELECT s.*,
  CASE WHEN s.rating >= coalesce(m.mean, (SELECT avg(rating) FROM {source} WHERE split = 'train')) THEN 1 ELSE 0 END AS relevant
  FROM {source} s LEFT JOIN (SELECT user_id, avg(rating) AS mean FROM {source} WHERE split = 'train' GROUP BY 1) m
  ON s.user_id = m.user_id)"""


LAB = ",\n".join([EV, dedup("ev", "row_id DESC", "evd"), split("evd", "t DESC, row_id DESC", "evs"), label("evs", "lab")])
HIST = LAB + """,
pos AS (SELECT * FROM lab WHERE relevant > 0),
hist AS (SELECT *, list(item_id) OVER (PARTITION BY user_id ORDER BY t, row_id
                                       ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS raw_history FROM pos),
h AS (SELECT * EXCLUDE (raw_history), coalesce(raw_history, []) AS history FROM hist)"""
TRAIN = HIST + """,
train AS (SELECT * FROM pos WHERE split = 'train'),
cat AS (SELECT DISTINCT item_id FROM ev)"""


def sel(view: str, body: str) -> str:
    return f"WITH {view}\n{body}"


def text(column: str) -> str:
    return f"array_to_string({column}, ' ') AS {column}"


HASH = "CAST('0x' || substr(md5({0}), {1}, 8) AS BIGINT)"


# --- metrics --------------------------------------------------------------------------------

GAINS = {
    "precision": "1.0 / {k}",
    "recall": "1.0",
    "ndcg": "1.0 / log2(rank + 1.0)",
    "hit": "1.0",
    "map": "1.0 / rank",
    "mrr": "1.0 / rank",
}


def metrics(source: str, ks=(5, 10, 20), ids: str = "") -> str:
    lead = f"{ids}, " if ids else ""
    group = f" GROUP BY {ids}" if ids else ""
    rows = [
        f"SELECT {lead}'{m}@{k}' AS metric, "
        f"round(avg(CASE WHEN rank <= {k} THEN CAST({g.format(k=k)} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS value "
        f"FROM {source}{group}"
        for k in ks
        for m, g in GAINS.items()
    ]
    return "\nUNION ALL ".join(rows)


POP = TRAIN + """,
place AS (SELECT c.item_id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, c.item_id) AS place
  FROM cat c LEFT JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) k ON c.item_id = k.item_id),
pop_rank AS (SELECT h.row_id AS query_id,
    (SELECT count(*) FROM place p WHERE p.place < t.place AND NOT list_contains(h.history, p.item_id)) + 1 AS rank
  FROM h JOIN place t ON h.item_id = t.item_id WHERE h.split = 'test')"""


def neighbors(n: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT i AS item_id, j AS neighbor_id, similarity,
         row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS rank
  FROM cosine) WHERE rank <= {n})"""


KNN = TRAIN + """,
cnt AS (SELECT item_id, count(*) AS c FROM train GROUP BY 1),
both_items AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n
  FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
cosine AS (SELECT i, j, n / sqrt(CAST(x.c AS DOUBLE) * CAST(y.c AS DOUBLE)) AS similarity
  FROM both_items JOIN cnt x ON x.item_id = i JOIN cnt y ON y.item_id = j)"""


def dense_ranks(scores: str, name: str, split_name: str = "test") -> str:
    """Ranks from a sparse score view (query_id, item_id, score) over the whole catalog."""
    return f"""{name}_all AS (SELECT h.row_id AS query_id, h.item_id AS target, h.history, c.item_id, coalesce(s.score, 0) AS score
  FROM h CROSS JOIN cat c LEFT JOIN {scores} s ON s.query_id = h.row_id AND s.item_id = c.item_id
  WHERE h.split = '{split_name}'),
{name} AS (SELECT a.query_id, count(*) FILTER (WHERE (a.item_id = a.target OR NOT list_contains(a.history, a.item_id))
      AND (a.score > o.score OR (a.score = o.score AND a.item_id < a.target))) + 1 AS rank
  FROM {name}_all a JOIN {name}_all o ON a.query_id = o.query_id AND o.item_id = o.target GROUP BY 1)"""


def knn_scores(near: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, neighbor_id AS item_id, round(sum(similarity), 9) AS score
  FROM (SELECT row_id AS query_id, unnest(history) AS item_id FROM h) e JOIN {near} k USING (item_id) GROUP BY 1, 2)"""


TRANS = TRAIN + """,
steps AS (SELECT lag(item_id) OVER (PARTITION BY user_id ORDER BY t, row_id) AS from_item, item_id FROM train),
tc AS (SELECT from_item, item_id, count(*) AS n FROM steps WHERE from_item IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT from_item, item_id, n / CAST(sum(n) OVER (PARTITION BY from_item) AS DOUBLE) AS probability,
    row_number() OVER (PARTITION BY from_item ORDER BY n DESC, item_id) AS rank FROM tc)"""

TRANS_SCORES = """trs AS (SELECT h.row_id AS query_id, tr.item_id, tr.probability AS score
  FROM h JOIN tr ON tr.from_item = h.history[-1])"""


# --- negatives ----------------------------------------------------------------------------------


def negatives(split_name: str) -> str:
    draws = []
    for j in range(4):
        draws.append(f"{HASH.format(chr(39) + '42|' + chr(39) + ' || row_id || ' + chr(39) + '|0' + chr(39), j * 8 + 1)} AS h{j}")
    hashes = ", ".join(draws)
    return TRAIN + f""",
idx AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM cat),
seen AS (SELECT user_id, idx, idx - (row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1) AS gap
  FROM (SELECT DISTINCT user_id, item_id FROM pos) JOIN idx USING (item_id)),
base AS (SELECT p.row_id, p.user_id, {hashes},
    (SELECT count(*) FROM cat) - (SELECT count(*) FROM seen s WHERE s.user_id = p.user_id) AS u
  FROM pos p WHERE split = '{split_name}'),
p0 AS (SELECT *, h0 % (u - 3) AS d0 FROM base),
p1 AS (SELECT *, CASE WHEN h1 % (u - 2) = d0 THEN u - 3 ELSE h1 % (u - 2) END AS d1 FROM p0),
p2 AS (SELECT *, CASE WHEN h2 % (u - 1) IN (d0, d1) THEN u - 2 ELSE h2 % (u - 1) END AS d2 FROM p1),
p3 AS (SELECT *, CASE WHEN h3 % u IN (d0, d1, d2) THEN u - 1 ELSE h3 % u END AS d3 FROM p2),
places AS (SELECT row_id, user_id, u, unnest([0, 1, 2, 3]) AS slot,
    unnest(CASE WHEN u >= 4 THEN [d0, d1, d2, d3] ELSE [h0 % u, h1 % u, h2 % u, h3 % u] END) AS place FROM p3),
neg AS (SELECT row_id, user_id, CAST(slot AS INTEGER) AS slot, idx.item_id FROM (
    SELECT p.*, place + (SELECT count(*) FROM seen s WHERE s.user_id = p.user_id AND s.gap <= place) AS spot FROM places p)
  JOIN idx ON idx.idx = spot)"""


# --- vectors ------------------------------------------------------------------------------------

VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
DIMS = "vd AS (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS dim FROM vec)"
GRAPH = LAB + """,
nu AS (SELECT max(user_id) + 1 AS n FROM ev),
e1 AS (SELECT user_id AS src, item_id + n AS dst FROM lab CROSS JOIN nu WHERE split = 'train' AND relevant > 0),
edges AS (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1)"""


def layer_norm(v: str) -> str:
    mean = f"list_avg({v})"
    return f"list_transform({v}, lambda x: (x - {mean}) / sqrt(list_avg(list_transform({v}, lambda y: (y - {mean}) * (y - {mean}))) + 1e-5))"


# --- experiment tables ------------------------------------------------------------------------------

WIDE = EV + """,
wide AS (SELECT event_type AS dataset, 'm' || (item_id % 5) AS model, CAST(user_id % 4 AS INTEGER) AS seed,
    round(avg(rating) / 100, 3) AS hit10, round(avg(sqrt(rating)) / 10, 2) AS mrr10, round(max(rating) / 1000, 3) AS ndcg5
  FROM ev GROUP BY 1, 2, 3),
long AS (SELECT dataset, seed, model, 'hit@10' AS metric, hit10 AS value FROM wide
  UNION ALL SELECT dataset, seed, model, 'mrr@10', mrr10 FROM wide)"""

SUMMARY = WIDE + """,
summ AS (SELECT dataset, model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n_seeds
  FROM long GROUP BY 1, 2, 3)"""

RANKS = WIDE + """,
full_blocks AS (SELECT metric, dataset, seed FROM long l GROUP BY 1, 2, 3
  HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM long k WHERE k.metric = l.metric)),
blocks AS (SELECT l.* FROM long l JOIN full_blocks USING (metric, dataset, seed)),
ranks AS (SELECT metric, dataset, seed, model, value,
    rank() OVER (PARTITION BY metric, dataset, seed ORDER BY value DESC)
    + (count(*) OVER (PARTITION BY metric, dataset, seed, value) - 1) / CAST(2 AS DOUBLE) AS rank
  FROM blocks)"""

FRIEDMAN = RANKS + """,
rank_sets AS (SELECT metric AS grp, * FROM ranks UNION ALL SELECT 'all_metrics', * FROM ranks),
sums AS (SELECT grp, model, sum(rank) AS r, count(*) AS n FROM rank_sets GROUP BY 1, 2),
ties AS (SELECT grp, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (
  SELECT grp, metric, dataset, seed, value, count(*) AS t FROM rank_sets GROUP BY 1, 2, 3, 4, 5) GROUP BY 1),
agg AS (SELECT grp, max(n) AS n, count(*) AS k, sum(r * r) AS sq, min(r / n) AS best_rank,
    arg_min(model, row(r, model)) AS best_model FROM sums GROUP BY 1)"""

# The normal distribution as rational form, and the range of k normal values as a sum over equal steps of the largest one.
ABOVE = ["3.52624965998911e-02", "0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"]
BELOW = ["8.83883476483184e-02", "1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831",
         "793.826512519948", "440.413735824752"]


def horner(coefficients: list[str], x: str) -> str:
    out = f"CAST({coefficients[0]} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c} AS DOUBLE))"
    return out


def normal_below(x: str) -> str:
    size = f"abs({x})"
    far = f"({size} + 0.65)"
    for c in (4, 3, 2, 1):
        far = f"({size} + {c} / {far})"
    tail = f"""CASE WHEN {size} < 7.07106781186547 THEN exp(-{size} * {size} / 2) * {horner(ABOVE, size)} / {horner(BELOW, size)}
      ELSE exp(-{size} * {size} / 2) / {far} / sqrt(2 * pi()) END"""
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def range_tail(q: str, k: str) -> str:
    return f"1 - {k} * sum(w * power(p - {normal_below(f'(z - ({q}))')}, {k} - 1))"


QUADRATURE = f"""grid AS (SELECT CAST(i AS DOUBLE) / 8 AS z FROM range(-72, 73) t(i)),
nodes AS (SELECT z, exp(-z * z / 2) / sqrt(2 * pi()) / 8 AS w, {normal_below('z')} AS p FROM grid)"""

RUNS = EV + """,
runs AS (SELECT event_type AS dataset, ['full', 'base', 'no_graph', 'no_sequence', 'sum_fusion'][item_id % 5 + 1] AS variant,
    user_id % 4 AS seed, round(avg(rating) / 100, 4) AS v, item_id % 5 <> 4 AS applicable
  FROM ev GROUP BY event_type, item_id % 5, user_id % 4),
imp AS (SELECT r.dataset, r.variant, avg(f.v - r.v) AS mean, coalesce(stddev_samp(f.v - r.v), 0) AS std, count(*) AS n
  FROM runs r JOIN runs f ON f.variant = 'full' AND f.dataset = r.dataset AND f.seed = r.seed
  WHERE r.variant NOT IN ('full', 'base') AND r.applicable GROUP BY 1, 2),
named AS (SELECT *, CASE variant WHEN 'no_graph' THEN 'Grafo' WHEN 'no_sequence' THEN 'Secuencia' ELSE 'Fusión (suma)' END AS component FROM imp)"""

# --- features and text ---------------------------------------------------------------------------

PART = "p AS (SELECT *, replace(p_type, ' ', '|') AS words FROM part)"
WORDS = PART + """,
tok AS (SELECT p_partkey, trim(unnest(string_split(words, '|'))) AS w FROM p),
voc AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS code FROM (SELECT DISTINCT w FROM tok WHERE w <> '')),
hits AS (SELECT DISTINCT p_partkey, code FROM tok JOIN voc USING (w))"""
CODES = PART + """,
fitp AS (SELECT * FROM p WHERE p_size >= (SELECT avg(p_size) FROM p)),
brand AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT p_brand AS b FROM fitp)),
kind AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT p_type AS b FROM fitp))"""

# Entities that occur in the test pages; a bare ampersand last.
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#39;": "''", "&amp;": "&"}


def clean(column: str) -> str:
    out = column
    for entity, sign in ENTITIES.items():
        out = f"replace({out}, '{entity}', '{sign}')"
    space = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    solid = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    out = f"regexp_replace(lower({out}), '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, 'https?://{solid}+|www\\.{solid}+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{space}+', ' ', 'g'))"


WRITTEN = """f AS (SELECT p_partkey, p_name, CASE length(p_name) % 5
    WHEN 0 THEN '[''' || replace(p_name, ' ', ''', ''') || ''']'
    WHEN 1 THEN replace(p_name, ' ', ', ') WHEN 2 THEN replace(p_name, ' ', ';')
    WHEN 3 THEN replace(p_name, ' ', ' | ') ELSE p_name END AS written FROM part)"""

STUDENTS = """st AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars,
    list_transform(string_split(text, ' '), lambda w: length(w)) AS courses FROM documents),
ent AS (SELECT id, unnest(courses) AS n FROM st WHERE NOT (n_chars % 10 = 3 AND len(courses) > 1)),
enr AS (SELECT id AS user_id, 'C_' || n AS item_id,
    CAST(epoch(make_timestamp(2000 + n % 100, 1, 1, 0, 0, 0.0)) AS BIGINT) AS t FROM ent WHERE n % 7 <> 0)"""
ENROLLED = sel(STUDENTS, "SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS n_users, min(t) AS time FROM enr GROUP BY 1")


def kcore_views(k: int, rounds: int) -> str:
    views = [ORD, dedup("ord", ORD_KEY, "k0")]
    for r in range(1, rounds + 1):
        views.append(f"""k{r} AS MATERIALIZED (SELECT * FROM k{r - 1}
  WHERE user_id IN (SELECT user_id FROM k{r - 1} GROUP BY 1 HAVING count(*) >= {k})
    AND item_id IN (SELECT item_id FROM k{r - 1} GROUP BY 1 HAVING count(*) >= {k}))""")
    return ",\n".join(views)


ORD_DEDUP = ",\n".join([ORD, dedup("ord", ORD_KEY, "od")])
ROUNDS = 8

SQL: dict[str, str] = {
    "dedup_latest": sel(ORD_DEDUP, "SELECT user_id, item_id, rating, l_orderkey, l_linenumber, l_suppkey FROM od"),
    "dedup_last_in_file": sel(EV, """SELECT user_id, item_id, row_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY row_id DESC) AS rn FROM ev) WHERE rn = 1"""),
    "kcore": sel(kcore_views(20, ROUNDS), f"SELECT user_id, item_id, rating, l_orderkey, l_linenumber, l_suppkey FROM k{ROUNDS}"),
    "kcore_entities": sel(kcore_views(20, ROUNDS), f"""SELECT (SELECT count(*) FROM k{ROUNDS}) AS n_interactions,
  (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM k{ROUNDS})) AS n_users,
  (SELECT round(sum(c_acctbal), 2) FROM customer WHERE c_custkey IN (SELECT user_id FROM k{ROUNDS})) AS balance,
  (SELECT count(*) FROM part WHERE p_partkey IN (SELECT item_id FROM k{ROUNDS})) AS n_items,
  (SELECT CAST(sum(p_size) AS BIGINT) FROM part WHERE p_partkey IN (SELECT item_id FROM k{ROUNDS})) AS sizes"""),
    "split_temporal": sel(
        ORD_DEDUP + ",\n" + split("od", "t DESC, " + ORD_KEY, "os"),
        "SELECT user_id, item_id, l_orderkey, l_linenumber, l_suppkey, split FROM os",
    ),
    "split_random": sel(
        ORD_DEDUP + ",\n" + split(
            "od", "md5('42|' || user_id || '|' || item_id), l_orderkey, l_linenumber, item_id, l_suppkey, rating, l_extendedprice", "os"
        ),
        "SELECT user_id, item_id, l_orderkey, l_linenumber, l_suppkey, split FROM os",
    ),
    "relevance_labels": sel(
        ORD_DEDUP + ",\n" + split("od", "t DESC, " + ORD_KEY, "os") + ",\n" + label("os", "ol"),
        "SELECT user_id, item_id, rating, split, relevant FROM ol",
    ),
    "relevance_implicit": sel(EV, "SELECT event_type, count(*) AS n_relevant FROM ev GROUP BY 1"),
    "relevance_thresholds": sel(LAB, """SELECT user_id, round(avg(rating), 6) AS user_mean,
  (SELECT round(avg(rating), 6) FROM lab WHERE split = 'train') AS global_mean FROM lab WHERE split = 'train' GROUP BY 1"""),
    "dataset_profile": sel(EV, """SELECT 'explicit' AS feedback_type, 'temporal' AS split_strategy,
  (SELECT count(*) FROM customer) AS num_users, (SELECT count(DISTINCT item_id) FROM ev) AS num_items,
  count(*) AS num_interactions, 4 AS num_user_feats, 0 AS num_item_feats, 1 AS num_ctx_feats,
  round(1 - count(*) / (CAST((SELECT count(*) FROM customer) AS DOUBLE) * (SELECT count(DISTINCT item_id) FROM ev)), 6) AS sparsity
  FROM ev"""),
    "user_history": sel(HIST, f"SELECT row_id, user_id, item_id, split, {text('history')} FROM h"),
    "history_entries": sel(HIST, """SELECT row_id, CAST(position AS INTEGER) AS position, item_id, position = size - 1 AS is_last FROM (
  SELECT row_id, unnest(history) AS item_id, unnest(range(0, len(history))) AS position, len(history) AS size FROM h)"""),
    "padded_history": sel(HIST, """SELECT row_id, array_to_string(list_concat(list_transform(history, lambda x: x + 1),
    list_transform(range(0, 50 - len(history)), lambda x: 0)), ' ') AS items,
  CAST(len(history) AS INTEGER) AS valid, 50 AS width FROM h"""),
    "sequence_export": sel(HIST, """SELECT CASE split WHEN 'train' THEN 'train_seq' WHEN 'val' THEN 'valid_seq' ELSE 'test_seq' END AS file,
  CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, array_to_string(history, ' ') AS item_id_list
  FROM h WHERE split <> 'train' OR len(history) > 0"""),
    "model_rows": sel(HIST, """SELECT row_id AS query_id, user_id, item_id AS target_item_id, array_to_string(history, ' ') AS history,
  CASE WHEN event_type = 'purchase' THEN '1.0' ELSE '0.0' END AS context FROM h"""),
    "batch_entities": sel(HIST, """SELECT DISTINCT 'user' AS kind, user_id AS id FROM h
  UNION SELECT 'item', item_id FROM h UNION SELECT 'item', unnest(history) FROM h"""),
    "interaction_graph": sel(GRAPH, "SELECT src, dst FROM edges"),
    "edge_dropout_view": sel(GRAPH, f"""SELECT src, dst FROM edges
  WHERE {HASH.format("'13|' || least(src, dst) || '|' || greatest(src, dst)", 1)} / CAST(4294967296 AS DOUBLE) >= 0.2"""),
    "graph_smooth": sel(GRAPH + f""",
{VEC}, {DIMS},
x0 AS (SELECT n.id, i AS dim, coalesce(vd.x, 0) AS x FROM (SELECT id FROM vec UNION SELECT src FROM edges) n CROSS JOIN range(0, 64) t(i)
  LEFT JOIN vd ON vd.id = n.id AND vd.dim = i),
deg AS (SELECT dst AS id, count(*) AS d FROM edges GROUP BY 1),
w AS (SELECT src, dst, 1 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst),
x1 AS MATERIALIZED (SELECT x0.id, x0.dim, coalesce(s, 0) AS x FROM x0 LEFT JOIN (
  SELECT dst AS id, dim, sum(w * x) AS s FROM w JOIN x0 ON x0.id = src GROUP BY 1, 2) USING (id, dim)),
x2 AS (SELECT x0.id, x0.dim, coalesce(s, 0) AS x FROM x0 LEFT JOIN (
  SELECT dst AS id, dim, sum(w * x) AS s FROM w JOIN x1 ON x1.id = src GROUP BY 1, 2) USING (id, dim))""",
        """SELECT id, CAST(dim AS INTEGER) AS dim, round((x0.x + x1.x + x2.x) / 3, 6) AS value
  FROM x0 JOIN x1 USING (id, dim) JOIN x2 USING (id, dim)"""),
    "graph_nodes": sel(EV, """SELECT CAST(id AS BIGINT) AS id, CAST(CASE WHEN id >= nu THEN 1 ELSE 0 END AS INTEGER) AS node_type FROM (
  SELECT nu, unnest(range(0, nu + ni)) AS id FROM (SELECT max(user_id) + 1 AS nu, max(item_id) + 1 AS ni FROM ev))"""),
    "negative_samples": sel(negatives("train"), "SELECT row_id, user_id, slot, item_id FROM neg"),
    "negative_lists": sel(negatives("train"), """SELECT row_id, t.user_id, t.item_id, array_to_string(negs, ' ') AS negatives
  FROM (SELECT row_id, list(item_id ORDER BY slot) AS negs FROM neg GROUP BY 1) JOIN train t USING (row_id)"""),
    "candidate_rows": sel(negatives("train"), """SELECT row_id, user_id, 0 AS position, CAST(item_id AS BIGINT) AS item_id, 1 AS label FROM train
  UNION ALL SELECT row_id, user_id, CAST(slot + 1 AS INTEGER), CAST(item_id AS BIGINT), 0 FROM neg"""),
    "candidate_metrics": sel(negatives("test") + """,
sc AS (SELECT item_id, count(*) AS n FROM train GROUP BY 1),
cr AS (SELECT p.row_id, p.item_id AS target, coalesce(a.n, 0) AS own, neg.item_id, coalesce(b.n, 0) AS other
  FROM pos p JOIN neg USING (row_id) LEFT JOIN sc a ON a.item_id = p.item_id LEFT JOIN sc b ON b.item_id = neg.item_id),
r AS (SELECT row_id, 1 + sum(CASE WHEN other > own OR (other = own AND item_id < target) THEN 1 ELSE 0 END) AS rank
  FROM cr GROUP BY 1)""", metrics("r", (1, 3))),
    "popularity_metrics": sel(POP, metrics("pop_rank")),
    "popularity_ranks": sel(POP, "SELECT query_id, rank FROM pop_rank"),
    "popularity_prior": sel(TRAIN, "SELECT item_id, round(ln(1 + count(*)), 6) AS bias FROM train GROUP BY 1"),
    "top_items_per_user": sel(EV, """SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank, CAST(11 - rank AS INTEGER) AS rank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT user_id AS query_id, item_id, round(sum(rating), 4) AS score FROM ev GROUP BY 1, 2)) WHERE rank <= 10"""),
    "masked_top_items": sel(KNN + ",\n" + neighbors(20, "near") + ",\n" + knn_scores("near", "ks"), """SELECT query_id, item_id,
  CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT s.query_id, s.item_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.item_id) AS rank
  FROM ks s JOIN h ON h.row_id = s.query_id AND h.split = 'test'
  WHERE s.item_id = h.item_id OR NOT list_contains(h.history, s.item_id)) WHERE rank <= 5"""),
    "item_neighbors": sel(KNN + ",\n" + neighbors(10, "near"), """SELECT item_id, neighbor_id, CAST(rank AS INTEGER) AS rank,
  round(similarity, 6) AS similarity FROM near"""),
    "item_cooccurrence": sel(ORD + """,
pr AS (SELECT DISTINCT user_id, item_id FROM ord),
ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM pr)),
cells AS (SELECT a.item_id, b.item_id AS j, count(*) AS n FROM pr a JOIN pr b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)""",
        """SELECT idx, count(*) AS n_neighbors, CAST(sum(n) AS BIGINT) AS n_shared, max(n) AS max_shared
  FROM cells JOIN ix USING (item_id) GROUP BY 1"""),
    "neighbor_metrics": sel(KNN + ",\n" + neighbors(20, "near") + ",\n" + knn_scores("near", "ks") + ",\n" + dense_ranks("ks", "r"), metrics("r")),
    "transition_top": sel(TRANS, """SELECT from_item, item_id, CAST(rank AS INTEGER) AS rank, round(probability, 6) AS probability
  FROM tr WHERE rank <= 10"""),
    "transition_metrics": sel(TRANS + ",\n" + TRANS_SCORES + ",\n" + dense_ranks("trs", "r"), metrics("r")),
    "model_comparison": sel(
        POP + KNN[len(TRAIN):] + ",\n" + neighbors(20, "near") + ",\n" + knn_scores("near", "ks") + ",\n"
        + dense_ranks("ks", "kr") + TRANS[len(TRAIN):] + ",\n" + TRANS_SCORES + ",\n" + dense_ranks("trs", "tr_rank")
        + """,
r AS (SELECT 'popularity' AS model, rank FROM pop_rank UNION ALL SELECT 'item-knn', rank FROM kr
  UNION ALL SELECT 'transition', rank FROM tr_rank)""",
        metrics("r", ids="model"),
    ),
    "dot_top_k": sel(VEC, """SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT a.id AS query_id, b.id AS item_id, list_dot_product(a.v, b.v) / 8 AS score FROM vec a JOIN vec b ON a.id <> b.id))
  WHERE rank <= 10"""),
    "dot_target_ranks": sel(VEC + """,
s AS (SELECT a.id, b.id AS item, list_dot_product(a.v, b.v) / 8 AS score,
    CASE WHEN a.id = (SELECT max(id) FROM vec) THEN 0 ELSE a.id + 1 END AS target FROM vec a JOIN vec b ON a.id <> b.id)""",
        """SELECT s.id AS query_id, count(*) FILTER (WHERE s.score > o.score OR (s.score = o.score AND s.item < s.target)) + 1 AS rank
  FROM s JOIN s o ON o.id = s.id AND o.item = s.target GROUP BY 1"""),
    "candidate_scores": sel(EV + f""",
{VEC},
pr AS (SELECT DISTINCT user_id, CAST(item_id AS BIGINT) AS item_id FROM ev),
c AS (SELECT item_id, ln(1 + count(*)) AS bias FROM pr GROUP BY 1)""",
        """SELECT user_id, item_id, round(coalesce(list_dot_product(u.v, i.v), 0) / 8 + bias, 6) AS score
  FROM pr LEFT JOIN vec u ON u.id = user_id LEFT JOIN vec i ON i.id = item_id JOIN c USING (item_id)"""),
    "history_vectors": sel(HIST + f""",
{VEC}, {DIMS},
hq AS (SELECT row_id, history FROM h WHERE split = 'test'),
he AS (SELECT row_id, unnest(history) AS item, unnest(range(0, len(history))) AS spot, len(history) AS n FROM hq),
mean AS (SELECT row_id, dim, sum(x * power(CAST(0.9 AS DOUBLE), n - 1 - spot)) / sum(power(CAST(0.9 AS DOUBLE), n - 1 - spot)) AS x
  FROM he JOIN vd ON vd.id = item GROUP BY 1, 2)""",
        """SELECT hq.row_id AS query_id, count(dim) > 0 AS available, round(coalesce(sum(x), 0), 6) AS total,
  round(sqrt(coalesce(sum(x * x), 0)), 6) AS length FROM hq LEFT JOIN mean USING (row_id) GROUP BY 1"""),
    "masked_fusion": sel(f"""s0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
s1 AS (SELECT id, label % 3 <> 0 AS use_a, label % 2 = 0 AS use_b, {layer_norm('a')} AS a, {layer_norm('list_reverse(a)')} AS b FROM s0),
s2 AS (SELECT id, use_a OR use_b AS any_use, a, b, CASE WHEN use_a THEN 1.0 ELSE 0.0 END AS ea, CASE WHEN use_b THEN exp(1.0) ELSE 0.0 END AS eb FROM s1),
s3 AS (SELECT id, any_use, list_transform(range(1, 65), lambda i: (a[i] * ea + b[i] * eb) / CASE WHEN ea + eb = 0 THEN 1 ELSE ea + eb END) AS f FROM s2),
s4 AS (SELECT id, any_use, {layer_norm('f')} AS f FROM s3)""",
        """SELECT id, CAST(unnest(range(0, 64)) AS INTEGER) AS dim,
  round(unnest(CASE WHEN any_use THEN f ELSE list_transform(f, lambda x: CAST(0 AS DOUBLE)) END), 6) AS value FROM s4"""),
    "sum_fusion": sel(VEC, """SELECT id, CAST(i AS INTEGER) AS dim, round(v[i + 1] + v[64 - i], 6) AS value FROM vec, range(0, 64) t(i)"""),
    "unit_vectors": sel(VEC, """SELECT id, CAST(i AS INTEGER) AS dim,
  round(v[i + 1] / sqrt(list_dot_product(v, v)), 6) AS value FROM vec, range(0, 64) t(i)"""),
    "encode_numeric": """SELECT p_partkey,
  round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS num__p_size,
  round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS num__p_retailprice
  FROM part""",
    "encode_categories": sel(CODES, """SELECT p_partkey, CAST(coalesce(brand.code, -1) AS INTEGER) AS cat__p_brand,
  CAST(coalesce(kind.code, -1) AS INTEGER) AS cat__p_type
  FROM p LEFT JOIN brand ON brand.b = p_brand LEFT JOIN kind ON kind.b = p_type"""),
    "category_cardinalities": """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) + 1 AS cardinality FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) + 1 FROM part""",
    "encode_lists": sel(WORDS, """SELECT p_partkey, string_agg(CASE WHEN hits.code IS NULL THEN '0' ELSE '1' END, '' ORDER BY voc.code) AS bits
  FROM p CROSS JOIN voc LEFT JOIN hits USING (p_partkey, code) GROUP BY 1"""),
    "feature_vectors": sel(WORDS + """,
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
nv AS (SELECT count(*) AS n FROM voc),
st AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part)""",
        """SELECT p_partkey, CAST(0 AS INTEGER) AS place, round(CAST(CAST((p_size - s0) / CAST(s1 - s0 AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS value FROM part, st
  UNION ALL SELECT p_partkey, 1, round(CAST(CAST((p_retailprice - r0) / (r1 - r0) AS FLOAT) AS DOUBLE), 4) FROM part, st
  UNION ALL SELECT p_partkey, CAST(2 + voc.code AS INTEGER), CASE WHEN hits.code IS NULL THEN 0.0 ELSE 1.0 END
    FROM p CROSS JOIN voc LEFT JOIN hits USING (p_partkey, code)
  UNION ALL SELECT p_partkey, CAST(2 + n AS INTEGER), CAST(b.code AS DOUBLE) FROM part JOIN b USING (p_brand) CROSS JOIN nv
  UNION ALL SELECT p_partkey, CAST(3 + n AS INTEGER), CAST(k.code AS DOUBLE) FROM part JOIN k USING (p_type) CROSS JOIN nv"""),
    "feature_metadata": sel(WORDS, """SELECT 'items' AS grp, 'p_size' AS "column", 'dense' AS kind, CAST(1 AS BIGINT) AS cardinality
  UNION ALL SELECT 'items', 'p_retailprice', 'dense', 1
  UNION ALL SELECT 'items', 'list__words__' || w, 'dense', 1 FROM voc
  UNION ALL SELECT 'items', 'p_brand', 'categorical', count(DISTINCT p_brand) + 1 FROM part
  UNION ALL SELECT 'items', 'p_type', 'categorical', count(DISTINCT p_type) + 1 FROM part"""),
    "passthrough": sel(LAB + """,
tr AS (SELECT * FROM lab WHERE split = 'train'),
uf AS (SELECT user_id, min(k) AS k, min(o) AS o FROM (
    SELECT c_custkey AS user_id, 0 AS k, c_custkey AS o FROM customer
    UNION ALL SELECT user_id, 1, row_id FROM tr WHERE user_id NOT IN (SELECT c_custkey FROM customer)) GROUP BY 1),
ui AS (SELECT user_id, row_number() OVER (ORDER BY k, o, user_id) - 1 AS idx FROM uf),
ii AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM tr WHERE item_id % 2 = 0))""",
        """SELECT row_id, coalesce(ui.idx, -1) AS user_id, coalesce(ii.idx, -1) AS item_id, rating,
  CAST(relevant AS DOUBLE) AS relevant, t AS timestamp
  FROM lab LEFT JOIN ui ON ui.user_id = lab.user_id LEFT JOIN ii ON ii.item_id = lab.item_id"""),
    "first_seen_ids": sel(EV + """,
u AS (SELECT c_custkey AS user_id, 0 AS k, c_custkey AS o FROM customer WHERE c_nationkey < 13
  UNION ALL SELECT user_id, 1, min(row_id) FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 13) GROUP BY 1)""",
        "SELECT user_id, row_number() OVER (ORDER BY k, o, user_id) - 1 AS idx FROM u"),
    "translated_ids": sel(EV + """,
tk AS (SELECT 'C_' || item_id AS token, item_id FROM (SELECT DISTINCT item_id FROM ev)),
nn AS (SELECT item_id, row_number() OVER (ORDER BY token) - 1 AS idx FROM tk)""",
        "SELECT idx AS id, row_id FROM ev JOIN nn USING (item_id)"),
    "clean_pages": f"SELECT page_id, {clean('html')} AS text FROM pages",
    "clean_documents": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "text_documents": """SELECT p_partkey, 'p_name: ' || lower(p_name) || ' [SEP] p_brand: ' || lower(p_brand)
  || CASE WHEN p_type = 'PROMO' THEN '' ELSE ' [SEP] p_type: ' || lower(p_type) END AS document FROM part""",
    "list_values": "SELECT p_partkey, CASE WHEN length(p_name) % 5 = 4 THEN p_name ELSE replace(p_name, ' ', '/') END AS tokens FROM part",
    "flattened_lists": sel(WRITTEN, "SELECT p_partkey, CASE WHEN length(p_name) % 5 = 0 THEN p_name ELSE written END AS plain FROM f"),
    "categories": "SELECT p_partkey, CASE WHEN p_size < 5 THEN NULL ELSE nullif(p_brand, 'Brand#11') END AS value FROM part",
    "academic_years": """SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 2000 + CAST(year(o_orderdate) % 100 AS BIGINT) END AS year,
  count(*) AS n FROM orders GROUP BY 1""",
    "valid_times": """SELECT event_id, epoch_us(ts) // 1000000 AS timestamp FROM events WHERE event_type NOT IN ('error', 'signup')""",
    "numbers": """SELECT p_size < 10 AS is_null, count(*) AS n, round(sum(CASE WHEN p_size >= 10 THEN p_retailprice END), 2) AS total
  FROM part GROUP BY 1""",
    "display_names": r"""SELECT DISTINCT p_type, p_brand,
  trim(regexp_replace(lower(p_brand || '##' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS safe,
  array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part""",
    "ordered_places": """SELECT event_type, count(*) AS n,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS place FROM events GROUP BY 1""",
    "class_counts": sel(EV, """SELECT item_id, count(*) FILTER (WHERE event_type = 'click') AS num_clicks,
  count(*) FILTER (WHERE event_type = 'view') AS num_views, count(*) FILTER (WHERE event_type = 'purchase') AS num_purchases,
  count(*) FILTER (WHERE event_type = 'refund') AS num_refunds FROM ev GROUP BY 1"""),
    "entity_stats": """SELECT p_partkey AS course_id, p_name, coalesce(n, 0) AS num_instructors,
  coalesce(a, 0) AS instructor_enrollments, coalesce(b, 0) AS instructor_reviews
  FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS a,
    CAST(coalesce(sum(s_nationkey), 0) AS DOUBLE) AS b
    FROM lineitem LEFT JOIN supplier s ON s_suppkey = l_suppkey GROUP BY 1) ON l_partkey = p_partkey""",
    "enrollment_events": ENROLLED,
    "stream_enrollments": ENROLLED,
    "csv_scan": "SELECT c_custkey, c_mktsegment AS market_segment, c_acctbal FROM customer",
    "capped_rows": sel(EV, "SELECT row_id, user_id, item_id FROM ev ORDER BY row_id LIMIT 500"),
    "first_per_id": sel(EV, "SELECT user_id, arg_min(item_id, row_id) AS item_id, arg_min(event_type, row_id) AS event_type, min(row_id) AS row_id FROM ev GROUP BY 1"),
    "atomic_frame": """SELECT CAST(p_partkey AS VARCHAR) AS "item_id:token",
  CASE WHEN p_brand = 'Brand#11' THEN 'Undefined' ELSE p_brand END AS "item_brand_name:token",
  CAST(p_size AS VARCHAR) AS "item_size:token", CAST(p_retailprice AS FLOAT) AS "item_f_2_price:float",
  CAST(CAST(substr(p_brand, 7, 2) AS BIGINT) AS VARCHAR) AS "item_brand_name_2:token" FROM part""",
    "atomic_export": sel(LAB, """SELECT CASE split WHEN 'train' THEN 'train.inter' WHEN 'val' THEN 'valid.inter' ELSE 'test.inter' END AS file,
  CAST(user_id AS VARCHAR) AS user_token, CAST(item_id AS VARCHAR) AS item_token, event_type AS event_token,
  CAST(1 AS DOUBLE) AS relevant FROM lab WHERE relevant > 0"""),
    "prepared_tables": sel(LAB, """SELECT split, count(*) AS n, CAST(sum(relevant) AS BIGINT) AS n_relevant,
  count(DISTINCT user_id) AS n_users FROM lab GROUP BY 1"""),
    "latest_artifacts": """SELECT lang AS dataset, arg_max(doc_id, row(source, n_chars, doc_id)) AS path FROM documents WHERE n_chars > 100 GROUP BY 1""",
    "stored_results": sel(WIDE, 'SELECT dataset, model, seed, round(hit10, 6) AS "hit@10", round(mrr10, 6) AS "mrr@10" FROM wide'),
    "metric_files": sel(WIDE, "SELECT dataset, seed, model, metric, round(value, 6) AS value FROM long"),
    "unpivoted_results": sel(WIDE, "SELECT dataset, seed, model, metric, round(value, 6) AS value FROM long"),
    "seed_summary": sel(SUMMARY, "SELECT dataset, model, metric, round(mean, 6) AS mean, round(std, 6) AS std, n_seeds FROM summ"),
    "summary_text": sel(WIDE, "SELECT dataset, model, " + ", ".join(
        f"printf('%.4f ± %.4f', round(avg({c}), 12), round(coalesce(stddev_samp({c}), 0), 12)) AS {n}"
        for c, n in (("hit10", "hit_10"), ("mrr10", "mrr_10"), ("ndcg5", "ndcg_5"))) + " FROM wide GROUP BY ALL"),
    "summary_order": sel(SUMMARY, "SELECT dataset, model, metric, n_seeds FROM summ"),
    "pending_pairs": sel(WIDE, """SELECT model, seed FROM (SELECT DISTINCT model FROM wide) CROSS JOIN (SELECT DISTINCT seed FROM wide)
  EXCEPT SELECT model, seed FROM wide WHERE dataset = 'click' AND hit10 > 0.49 AND model <> 'm0'"""),
    "collected_results": sel(WIDE, """SELECT dataset, model, seed, round(hit10, 6) AS "hit@10" FROM wide w WHERE model <> 'm0'
  AND EXISTS (SELECT 1 FROM wide a WHERE a.dataset = 'click' AND a.hit10 > 0.49 AND a.model = w.model AND a.seed = w.seed)"""),
    "model_ranks": sel(RANKS, "SELECT metric, dataset, seed, model, round(value, 6) AS value, rank FROM ranks"),
    "mean_ranks": sel(RANKS, "SELECT dataset, metric, model, round(avg(rank), 6) AS rank FROM ranks GROUP BY 1, 2, 3"),
    "friedman": sel(FRIEDMAN, """SELECT grp AS metric, n AS n_blocks, k AS n_models,
  round((12.0 / (CAST(n AS DOUBLE) * k * (k + 1)) * sq - 3.0 * n * (k + 1)) / (1.0 - ties / (CAST(n AS DOUBLE) * k * (CAST(k AS DOUBLE) * k - 1))), 6) AS friedman_statistic,
  best_model, round(best_rank, 6) AS best_rank FROM agg JOIN ties USING (grp) WHERE n >= 2 AND k >= 3"""),
    # Closed form of the chi-square tail for an even number of degrees, here four.
    "friedman_report": sel(FRIEDMAN + """,
stat AS (SELECT *, (12.0 / (CAST(n AS DOUBLE) * k * (k + 1)) * sq - 3.0 * n * (k + 1)) / (1.0 - ties / (CAST(n AS DOUBLE) * k * (CAST(k AS DOUBLE) * k - 1))) AS x
  FROM agg JOIN ties USING (grp) WHERE n >= 2 AND k = 5 AND grp <> 'all_metrics')""",
        """SELECT grp AS metric, n AS n_blocks, k AS n_models, round(x, 6) AS friedman_statistic, best_model, round(best_rank, 6) AS best_rank,
  round(exp(-x / 2) * (1 + x / 2), 9) AS friedman_pvalue FROM stat"""),
    "nemenyi": sel(f"""RECURSIVE {RANKS},
{QUADRATURE},
mr AS (SELECT metric, model, avg(rank) AS m, count(*) AS n, count(*) OVER (PARTITION BY metric) AS k FROM ranks GROUP BY 1, 2),
halves(k, low, high, i) AS (
  SELECT DISTINCT k, CAST(0 AS DOUBLE), CAST(40 AS DOUBLE), 0 FROM mr
  UNION ALL
  SELECT k, CASE WHEN tail > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE (low + high) / 2 END, i + 1 FROM (
    SELECT h.k, low, high, i, {range_tail("(low + high) / 2", "h.k")} AS tail FROM halves h CROSS JOIN nodes WHERE i < 45 GROUP BY h.k, low, high, i)),
pr AS (SELECT a.metric, a.model, b.model AS other_model, abs(a.m - b.m) AS gap, a.k, sqrt(CAST(a.k AS DOUBLE) * (a.k + 1) / (12.0 * a.n)) AS unit
  FROM mr a JOIN mr b ON a.metric = b.metric AND a.model < b.model),
tails AS (SELECT metric, model, other_model, gap, unit, pr.k, {range_tail("gap / unit", "pr.k")} AS p FROM pr CROSS JOIN nodes GROUP BY metric, model, other_model, gap, unit, pr.k)""",
        """SELECT metric, model, other_model, round(gap, 6) AS rank_difference, round(CASE WHEN gap = 0 THEN 1 ELSE p END, 9) AS p_value,
  round(unit * (low + high) / 2, 6) AS critical_distance, gap > unit * (low + high) / 2 AS significant
  FROM tails t JOIN halves h ON h.k = t.k AND h.i = 45"""),
    "relative_improvement": sel(SUMMARY + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY mean DESC, model) AS rn
  FROM summ WHERE model <> 'm1') WHERE rn = 1)""",
        """SELECT dataset, metric, 'm1' AS proposed_model, b.model AS baseline, round(s.mean, 6) AS proposed_value,
  round(b.mean, 6) AS baseline_value, round(100.0 * (s.mean - b.mean) / abs(b.mean), 6) AS relative_improvement_percent
  FROM summ s JOIN best b USING (dataset, metric) WHERE s.model = 'm1'"""),
    "improvement_named": sel(SUMMARY, """SELECT s.dataset, s.metric, b.model AS baseline,
  round(100.0 * (s.mean - b.mean) / abs(b.mean), 6) AS relative_improvement_percent
  FROM summ s JOIN summ b ON b.dataset = s.dataset AND b.metric = s.metric AND b.model = 'm3' WHERE s.model = 'm1'"""),
    "importance": sel(RUNS, """SELECT dataset, variant, component, round(mean, 6) AS importance_mean, round(std, 6) AS importance_std,
  n AS n_seeds FROM named"""),
    "importance_matrix": sel(RUNS, "SELECT component, " + ", ".join(
        f"round(max(mean) FILTER (WHERE dataset = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM named GROUP BY 1"),
    "stream_history": sel(EV, """SELECT row_id, user_id, CAST(item_id AS BIGINT) AS item_id, coalesce(array_to_string(list(item_id) OVER (
  PARTITION BY user_id ORDER BY t, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ' '), '') AS history FROM ev"""),
    "epoch": """SELECT o_orderpriority, max(CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT)) AS latest FROM orders GROUP BY 1""",
}


def _trials() -> str:
    views, rows = [KNN], []
    for n in (5, 20):
        views.append(neighbors(n, f"near{n}"))
        for length in (3, 50):
            name = f"{n}_{length}"
            entries = f"(SELECT DISTINCT row_id AS query_id, unnest(history[-{length}:]) AS item_id FROM h WHERE len(history) > 0)"
            views.append(f"""ks{name} AS (SELECT query_id, neighbor_id AS item_id, round(sum(similarity), 9) AS score
  FROM {entries} e JOIN near{n} k USING (item_id) GROUP BY 1, 2)""")
            views.append(dense_ranks(f"ks{name}", f"r{name}", "val"))
            rows.append(f"""SELECT {len(rows)} AS trial, '{{"n_neighbors":{n},"history":{length}}}' AS params,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END), 6) AS value FROM r{name}""")
    return sel(",\n".join(views), "\nUNION ALL ".join(rows))


def _prepared() -> str:
    """Views of the prepared data: k-core of 3 over events, then split, labels and ids."""
    views = [EV, dedup("ev", "row_id DESC", "c0")]
    for r in range(1, 6):
        views.append(f"""c{r} AS MATERIALIZED (SELECT * FROM c{r - 1}
  WHERE user_id IN (SELECT user_id FROM c{r - 1} GROUP BY 1 HAVING count(*) >= 3)
    AND item_id IN (SELECT item_id FROM c{r - 1} GROUP BY 1 HAVING count(*) >= 3))""")
    views += [split("c5", "t DESC, row_id DESC", "cs"), label("cs", "lab")]
    views.append("""tr AS (SELECT * FROM lab WHERE split = 'train'),
ui AS (SELECT user_id, row_number() OVER (ORDER BY k, o) - 1 AS idx FROM (
  SELECT c_custkey AS user_id, 0 AS k, c_custkey AS o FROM customer WHERE c_custkey IN (SELECT user_id FROM c5)
  UNION ALL SELECT user_id, 1, min(row_id) FROM tr WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1)),
ii AS (SELECT item_id, row_number() OVER (ORDER BY k, o) - 1 AS idx FROM (
  SELECT p_partkey AS item_id, 0 AS k, p_partkey AS o FROM part WHERE p_partkey IN (SELECT item_id FROM c5)
  UNION ALL SELECT item_id, 1, min(row_id) FROM tr WHERE item_id NOT IN (SELECT p_partkey FROM part) GROUP BY 1)),
et AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM tr)),
pr AS (SELECT row_id, t, ui.idx AS user_id, ii.idx AS item_id, split, coalesce(et.code, -1) AS event_code
  FROM lab JOIN ui ON ui.user_id = lab.user_id JOIN ii ON ii.item_id = lab.item_id
  LEFT JOIN et ON et.event_type = lab.event_type WHERE relevant > 0)""")
    return ",\n".join(views)


SQL["prepared_interactions"] = sel(_prepared(), """SELECT row_id, user_id, item_id, split, CAST(event_code AS INTEGER) AS event_code,
  coalesce(array_to_string(list(item_id) OVER (PARTITION BY user_id ORDER BY t, row_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), ' '), '') AS history
  FROM pr""")
SQL["prepared_features"] = sel(_prepared() + """,
cu AS (SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM c5)),
sg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM cu))""",
    """SELECT ui.idx, round(CAST(CAST((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS FLOAT) AS DOUBLE), 4) AS balance,
  CAST(sg.code AS INTEGER) AS segment FROM cu JOIN ui ON ui.user_id = c_custkey JOIN sg USING (c_mktsegment)""")
SQL["pivoted_results"] = sel(RANKS, "SELECT metric, dataset, seed, " + ", ".join(
    f"round(max(value) FILTER (WHERE model = 'm{i}'), 6) AS m{i}" for i in range(5)) + " FROM blocks GROUP BY 1, 2, 3")
#: Positive orders over the catalog of items that have a vector: other items may be targets, and users may lack a vector.
ORDER_HIST = ",\n".join([ORD_DEDUP, split("od", f"t DESC, {ORD_KEY}", "os"), label("os", "lab")]) + """,
pos AS (SELECT * FROM lab WHERE relevant > 0),
h AS (SELECT *, row_number() OVER (ORDER BY user_id, item_id) AS q, coalesce(list(item_id) OVER (PARTITION BY user_id ORDER BY t, l_orderkey, l_linenumber, item_id, l_suppkey, rating, l_extendedprice
  ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), []) AS history FROM pos),
train AS (SELECT * FROM pos WHERE split = 'train'),
steps AS (SELECT lag(item_id) OVER (PARTITION BY user_id ORDER BY t, l_orderkey, l_linenumber, item_id, l_suppkey, rating, l_extendedprice) AS from_item, item_id
  FROM train),
tc AS (SELECT from_item, item_id, count(*) AS n FROM steps WHERE from_item IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT from_item, item_id, n / CAST(sum(n) OVER (PARTITION BY from_item) AS DOUBLE) AS p FROM tc),
pop AS (SELECT item_id, count(*) AS n FROM train GROUP BY 1),
seen AS (SELECT q, l_orderkey, l_linenumber, user_id, item_id AS target, history, c.id AS item, c.v AS iv
  FROM h CROSS JOIN vec c WHERE split = 'test' AND (c.id = item_id OR NOT list_contains(history, c.id))),
scored AS (SELECT s.*, coalesce(pop.n, 0) AS popularity, coalesce(tr.p, 0) AS transition, coalesce(list_dot_product(u.v, s.iv), 0) / 8 AS dot
  FROM seen s LEFT JOIN pop ON pop.item_id = s.item LEFT JOIN tr ON tr.from_item = s.history[-1] AND tr.item_id = s.item
  LEFT JOIN vec u ON u.id = s.user_id),
own AS (SELECT q, popularity AS p0, transition AS t0, dot AS d0 FROM scored WHERE item = target)"""
SQL["vector_catalog_ranks"] = sel(f"{ORDER_HIST.replace('pos AS', VEC + ', pos AS', 1)}", "\nUNION ALL ".join(
    f"""SELECT '{m}' AS model, l_orderkey, l_linenumber, target AS l_partkey, count(*) FILTER (WHERE {o} IS NULL OR {m} > {o} OR ({m} = {o} AND item < target)) + 1 AS rank
  FROM scored LEFT JOIN own USING (q) GROUP BY q, 2, 3, 4"""
    for m, o in (("popularity", "p0"), ("transition", "t0"), ("dot", "d0"))))
SQL["factor_ids"] = sel(LAB, """SELECT DISTINCT 'user' AS kind, 'U_' || user_id AS id, 16 AS width FROM lab WHERE split = 'train' AND relevant > 0
  UNION ALL SELECT DISTINCT 'item', 'C_' || item_id, 16 FROM lab WHERE split = 'train' AND relevant > 0""")
SQL["text_vectors"] = f"""WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim
    FROM (SELECT doc_id, unnest(string_split('text: ' || t, ' ')) AS word FROM (SELECT doc_id, {clean('text')} AS t FROM documents) WHERE t <> '')
    WHERE word <> ''),
tf AS (SELECT doc_id, dim, count(*) AS n FROM w GROUP BY 1, 2),
idf AS (SELECT dim, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS x FROM tf GROUP BY 1),
v AS (SELECT doc_id, dim, n * x AS y FROM tf JOIN idf USING (dim)),
u AS (SELECT doc_id, dim, CAST(CAST(y / sqrt(sum(y * y) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS value FROM v WHERE y <> 0)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM u WHERE value <> 0"""
SQL["search_trials"] = _trials()
SQL["best_trial"] = f"SELECT * FROM ({_trials()}) ORDER BY value DESC, trial LIMIT 1"
