import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankloom.operators.cleaning import processed_profile
from rankloom.operators.sequences import positive_history, user_history
from rankloom.plans import experiments, preparation
from rankloom.plans.preparation import labelled_splits
from rankloom.sources import artifacts, datasets
from rankloom.streaming import histories, ingest


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for lang, shift in (("en", 0), ("fr", 10)):
        put(root / "mars", f"items_{lang}.csv",
            "item_id,type,language,difficulty,nb_views,duration,name,description,job,software,theme\n"
            + f'{shift + 1},course,{lang},easy,10,5,"First, one","line one\nline ""two""","[\'dev\', \'ops\']",excel;word,a|b\n'
            + f"{shift + 2},video,{lang},hard,,7,Second,,dev,,\n" + "1,again,xx,xx,0,0,dup,,,,\n")
        put(root / "mars", f"users_{lang}.csv", f"user_id,job\n{shift + 1},dev\n{shift + 2},\n")
        ratings = [(shift + 1, shift + 1, "2020-01-0%d 00:00:00" % k, k, 10 * k) for k in (1, 2)]
        ratings += [(shift + 2, shift + 2, "bad", 1, 1), (shift + 2, shift + 1, "1950-01-01", 2, 2)]
        head = "user_id,item_id,created_at,rating,watch_percentage\n"
        put(root / "mars", f"explicit_ratings_{lang}.csv", head + "".join(f"{u},{i},{t},{r},{w}\n" for u, i, t, r, w in ratings))
        put(root / "mars", f"implicit_ratings_{lang}.csv", "user_id,item_id,created_at\n" + "".join(f"{u},{i},{t}\n" for u, i, t, _, _ in ratings))
    put(root / "itm", "ratings.csv", "UserID,Item,Rating,App,Data,Ease,Class,Semester,Lockdown\n1,10,4,1,1,1,DA,Fall,PRE\n2,11,x,1,1,1,DA,Fall,PRE\n")
    put(root / "itm", "items.csv", "Item,URL,Title,Descriptions\n10,u,T,D\n11,u,T2,D2\n")
    put(root / "itm", "users.csv", "UserID,Gender,Age,Married\n1,F,20,0\n2,M,30,1\n")
    put(root / "doris", "CourseSelectionTable.csv",
        "StudedntId,CourseId,Score,AcademicYear,semester,coursecollege,coursename\ns1,c1,90,19-20,1,x,y\ns1,c2,absent,19-20,1,x,y\ns2,c1,70,2019,1,x,y\n")
    put(root / "doris", "CourseInformationTable.csv", "CourseId,type,grade,prerequisite,introduction\nc1,t,1,,intro\n")
    put(root / "doris", "StudentInformationTable.csv", "StudentId,enrollmentyear,education,major\ns1,2018,b,m\n")
    courses = [{"id": "C_1", "name": "one", "field": ["f"], "prerequisites": "", "about": "a", "resource": [{"t": 1}, {"t": 2}]},
               {"id": "C_2", "name": "two", "field": [], "prerequisites": "", "about": "a", "resource": []}]
    users = [
        {"id": "U_1", "gender": 1, "school": "s", "year_of_birth": 1990, "course_order": [1, 2, 3, 1], "enroll_time": ["2020-01-01 00:00:00", "2020-01-02 00:00:00", "2020-01-03 00:00:00", "bad"]},
        {"id": "U_2", "gender": 2, "school": None, "year_of_birth": None, "course_order": [1], "enroll_time": []},
        {"id": "U_3", "gender": 2, "school": None, "year_of_birth": None, "course_order": [2], "enroll_time": ["2021-01-01 00:00:00"]},
    ]
    put(root / "mooccubex", "entities/course.json", "\n".join(map(json.dumps, courses)))
    put(root / "mooccubex", "entities/user.json", "\n".join(map(json.dumps, users)))
    put(root / "coco", "evaluate_latest.csv",
        "learner_id,course_id,learner_rating,learner_timestamp,learner_comment\n1,100,4.5,2019-01-01T00:00:00Z,c\n2,100,,2019-01-01T00:00:00Z,c\n2,101,3,never,c\n3,101,2,2019-01-03T00:00:00Z,c\n")
    put(root / "coco", "course_latest.csv",
        "course_id,short_url,language,first_level_category,second_level_category,instructional_level,subtitles,short_description,objectives,requirements,target_audience,long_description\n"
        '100,u,en,a,b,c,"[\'en\', \'es\']",s,"[\'know\', \'do\']",,,"long\ntext"\n101,u,en,a,b,c,,s,,,,\n')
    put(root / "coco", "teach_latest.csv", "course_id,instructor_id\n100,1\n100,2\n100,2\n")
    put(root / "coco", "instructor_latest.csv", "instructor_id,total_enrollments,total_reviews\n1,10,1\n")
    put(root / "coco", "curriculum_lesson_chapter_latest.csv", "course_id,class\n100,lecture\n100,lecture\n100,quiz\n100,other\n")
    return root


def load(spark, raw, name, **options):
    folder = "mars" if name.endswith("mars") else name
    return datasets.load(spark, name, str(raw / folder), **options)


def test_mars(spark, raw):
    seen = Observation("times")
    b = load(spark, raw, "explicit_mars", observation=seen)
    rows = sorted(b.interactions.collect(), key=lambda r: r["row_id"])
    assert [(r["user_id"], r["item_id"], r["rating"]) for r in rows] == [("1", "1", 1.0), ("1", "1", 2.0), ("11", "11", 1.0), ("11", "11", 2.0)]
    assert seen.get["invalid_times"] == 4
    first = b.items.where("item_id = '1'").first()
    assert (first["item_type"], first["description"]) == ("course", 'line one\nline "two"')
    assert b.items.count() == 4 and b.users.count() == 4
    assert "rating" not in load(spark, raw, "implicit_mars").interactions.columns


def test_itm_and_doris(spark, raw):
    b = load(spark, raw, "itm")
    assert set(b.interactions.columns) == {"user_id", "item_id", "rating", "row_id", "class", "semester", "lockdown"}
    assert sorted(b.items.columns) == ["descriptions", "item_id", "row_id", "title"]
    d = load(spark, raw, "doris").interactions.collect()
    assert [(r["user_id"], r["rating"], r["timestamp"]) for r in d] == [("s1", 90.0, 2019)]


def test_mooccubex(spark, raw):
    b = load(spark, raw, "mooccubex")
    got = sorted((r["user_id"], r["item_id"], r["timestamp"]) for r in b.interactions.collect())
    assert got == [("U_1", "C_1", 1577836800), ("U_1", "C_2", 1577923200), ("U_3", "C_2", 1609459200)]
    assert {r["item_id"]: r["resource_count"] for r in b.items.collect()} == {"C_1": 2, "C_2": 0}
    assert b.users.count() == 3
    assert load(spark, raw, "mooccubex", limit=2).interactions.count() == 2


def test_coco(spark, raw):
    b = load(spark, raw, "coco")
    assert sorted((r["user_id"], r["item_id"]) for r in b.interactions.collect()) == [("1", 100), ("3", 101)]
    rows = {r["item_id"]: r for r in b.items.collect()}
    assert (rows[100]["num_instructors"], rows[100]["instructor_enrollments"], rows[100]["num_lectures"], rows[100]["num_quizzes"]) == (2, 10, 2, 1)
    assert rows[101]["num_instructors"] == rows[101]["num_chapters"] == 0
    assert rows[100]["objectives"] == "know do"
    assert b.users.count() == 2 and "row_id" in b.users.columns
    assert load(spark, raw, "coco", limit=1).interactions.count() == 1


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        datasets.load(spark, "nope", "/")

    @datasets.register("mine")
    def mine(spark, folder):
        return folder

    assert datasets.load(spark, "mine", "x") == "x"
    del datasets.READERS["mine"]


# --- prepared data ---------------------------------------------------------------------------


def bundle(spark, events, explicit):
    if not explicit:
        events = events.drop("rating")
    events = events.withColumn("place", F.concat(F.lit("p"), F.col("item_id") % 3))
    users = spark.range(12).select(F.col("id").alias("user_id"), (F.col("id") % 4).cast("string").alias("job"))
    items = spark.range(40).select(
        F.col("id").alias("item_id"), F.col("id").cast("double").alias("size"), F.concat(F.lit("course number "), F.col("id")).alias("name")
    )
    return datasets.Bundle(events, items, users, datasets.roles({"cat": ["job"]}, {"num": ["size"], "text": ["name"]}, {"cat": ["place"]}))


@pytest.mark.parametrize("explicit", [True, False])
def test_prepare_and_reload(spark, events, tmp_path, explicit):
    done = preparation.prepare(bundle(spark, events, explicit), seed=7, min_interactions=4, text_dim=8, negatives=2)
    rows = done.rows.collect()
    assert rows and all(r["relevant"] > 0 and r["user_id"] >= 0 and r["item_id"] >= 0 for r in rows)
    assert ("negatives" in done.rows.columns) == (not explicit)
    if not explicit:
        seen = {}
        for r in rows:
            seen.setdefault(r["user_id"], set()).add(r["item_id"])
        for r in rows:
            assert len(r["negatives"]) == (2 if r["split"] == "train" else 0)
            assert not set(r["negatives"]) & seen[r["user_id"]]
    n_items = done.item_features.count()
    assert {r["idx"] for r in done.item_features.collect()} == set(range(n_items))
    assert {len(r["features"]) for r in done.item_features.collect()} == {9}
    folder = str(tmp_path / "prepared")
    assert not artifacts.prepared_exists(spark, folder)
    done.save(folder)
    assert artifacts.prepared_exists(spark, folder, done.parameters)
    assert not artifacts.prepared_exists(spark, folder, {"random_state": 8})
    back = artifacts.load_prepared(spark, folder)
    assert back["interactions"].count() == done.interactions.count()
    wide = artifacts.feature_columns(back["item_features"], "idx", [f"f{i}" for i in range(9)])
    assert len(wide.columns) == 10
    with pytest.raises(Exception, match="expected 2 features"):
        artifacts.feature_columns(back["item_features"], "idx", ["a", "b"]).collect()


def test_prepared_tables_reach_the_hybrid_scorer(spark, events):
    done = preparation.prepare(bundle(spark, events, True), seed=7, min_interactions=4, text_dim=8)
    given = experiments.hybrid_inputs(done)
    held = {k: next(iter(v.table.select(F.size("features")).distinct().collect()))[0] for k, v in given.items() if isinstance(v, experiments.Features)}
    assert held and all(given[k].layout.width == n for k, n in held.items())
    shown = processed_profile(done.interactions, done.user_ids, done.item_ids, done.metadata)
    row = shown.first()
    assert (row["num_users"], row["num_items"]) == (given["num_users"], given["num_items"])
    assert row["num_item_feats"] == held["item_features"] and row["num_item_text"] == given["item_features"].layout.text
    data = experiments.availability(shown, done.rows)
    assert data.item_features == held["item_features"] and data.history
    assert data.context == (given["context"].layout.width if given["context"] else 0)
    table = experiments.run_variants(**given, names=("full", "no_text", "no_features"), seeds=(3,), top_ks=(5,), dim=8).collect()
    assert [r["variant"] for r in table] == ["full", "no_text", "no_features"]
    assert [r["applicable"] for r in table] == [int(experiments.applicable(r["variant"], data)) for r in table]
    assert all(0 <= r["ndcg@5"] <= 1 for r in table) and table[2]["module_item_features"] == 0


def test_prepare_from_files(spark, raw):
    done = preparation.prepare(load(spark, raw, "explicit_mars"), min_interactions=1, text_dim=4)
    assert done.interactions.count() == 2  # one latest event per pair and language
    # Ids follow the source: the English files come first, then the French ones.
    assert {r["user_id"]: r["idx"] for r in done.user_ids.collect()} == {"1": 0, "11": 1}


def test_sequence_export_needs_rows(spark, events, tmp_path):
    rows = positive_history(labelled_splits(events))
    written = artifacts.save_sequences(str(tmp_path / "seq"), "x", rows)
    assert artifacts.tsv_fields(spark, written["test_seq"]) == ["user_id", "item_id", "item_id_list"]
    with pytest.raises(RuntimeError, match="no usable queries"):
        artifacts.save_sequences(str(tmp_path / "none"), "x", rows.where("split <> 'val'"))


def test_atomic_frame(spark):
    df = spark.createDataFrame([(1.0, "a", " ", "3"), (2.4, None, "b", None)], "user_id double, c string, d string, x string")
    out = artifacts.atomic_frame(df, {"c", "d"}, "user")
    assert out.columns == ["user_id:token", "user_c:token", "user_d:token", "user_x:float"]
    assert sorted(map(tuple, out.collect())) == [("1", "a", "Undefined", 3.0), ("2", "Undefined", "b", 0.0)]


def test_results_are_replaced_per_run(spark, tmp_path):
    folder = str(tmp_path / "results")
    rows = lambda v, seed: spark.createDataFrame([("d", "m", seed, v)], "dataset string, model string, seed int, `hit@5` double")
    artifacts.save_results(rows(0.1, 1), folder)
    artifacts.save_results(rows(0.2, 2), folder)
    artifacts.save_results(rows(0.3, 1), folder)
    got = {r["seed"]: r["hit@5"] for r in artifacts.load_results(spark, folder).collect()}
    assert got == {1: 0.3, 2: 0.2}


def test_metric_files_and_latest(spark, tmp_path):
    for name in ("coco", "itm"):
        put(tmp_path / name, "evaluation_results.csv", "model,seed,hit@10,note\nA,1,0.5,x\nB,1,,y\n")
    rows = artifacts.load_metric_files(spark, str(tmp_path / "*" / "evaluation_results.csv"))
    assert sorted({r["dataset"] for r in rows.collect()}) == ["coco", "itm"]
    found = spark.createDataFrame(
        [("d", "2020", 9, "old", True, True), ("d", "2021", 1, "new", True, True), ("d", "2022", 1, "half", True, False)],
        "dataset string, name string, modified int, path string, has_model boolean, has_metadata boolean",
    )
    assert artifacts.latest_artifact(found).first()["path"] == "new"


# --- streams -------------------------------------------------------------------------------


def test_stream_history_matches_batch(spark, events, tmp_path):
    known = events.dropna()
    folder = str(tmp_path / "in")
    known.coalesce(1).write.parquet(folder)
    stream = ingest.stream_files(spark, folder, known.schema, "parquet")
    got = ingest.run_available(histories.stream_history(stream, 4), str(tmp_path / "out"))
    expected = {r["row_id"]: r["history"] for r in user_history(known, 4).collect()}
    assert {r["row_id"]: list(r["history"]) for r in got.collect()} == expected


def test_stream_state_survives_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "user_id bigint, item_id bigint, timestamp bigint, row_id bigint"
    for k in range(3):
        put(folder, f"{k}.json", json.dumps({"user_id": 1, "item_id": k, "timestamp": k, "row_id": k}))
        stream = ingest.stream_files(spark, str(folder), spark.createDataFrame([], schema).schema)
        got = ingest.run_available(histories.stream_history(stream, 2), out)
    assert {r["row_id"]: list(r["history"]) for r in got.collect()} == {0: [], 1: [0], 2: [0, 1]}


def test_stream_enrollments_match_batch(spark, raw, tmp_path):
    put(tmp_path / "in", "user.json", (raw / "mooccubex/entities/user.json").read_text())
    got = ingest.run_available(ingest.stream_enrollments(spark, str(tmp_path / "in")).select("user_id", "item_id", "timestamp"), str(tmp_path / "out"))
    assert sorted((r["user_id"], r["item_id"]) for r in got.collect()) == [("U_1", "C_1"), ("U_1", "C_2"), ("U_1", "C_3"), ("U_3", "C_2")]


def test_quoted_csv_is_split(spark, tmp_path):
    """Many small ranges of a file with line breaks inside quotes give the rows of the one-task reader, in the same order."""
    rows = [f'{i},"a ""{i}"" b{"" if i % 3 else chr(10) + ", c" + chr(10) * (i % 2)}",{"" if i % 5 else i},"é, {i}"' for i in range(60)]
    for name, text in (("one.csv", "id,note,n,extra\n" + "\n".join(rows) + "\n\n"), ("two.csv", "id,note,n,extra\r\n7,\"x\r\ny\",,z\r\n"), ("none.csv", "id,note,n,extra\n")):
        (tmp_path / name).write_bytes(text.encode())
    whole = datasets.read_csv(spark, [str(tmp_path)], "n, note, id", ordered=True, multiline=True)
    expected = sorted([(r["row_id"]["file"], r["id"], r["note"], r["n"]) for r in whole.collect()], key=str)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for hot_rows in (10, 1_000_000):
            got = datasets.read_quoted_csv(spark, str(tmp_path), "n, note, id", hot_rows).collect()
            assert sorted([(r["row_id"]["file"], r["id"], r["note"], r["n"]) for r in got], key=str) == expected
            ordered = [int(r["id"]) for r in sorted(got, key=lambda r: r["row_id"]) if r["row_id"]["file"] == "one.csv"]
            assert ordered == list(range(60)) and len({r["row_id"]["start"] for r in got}) > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
