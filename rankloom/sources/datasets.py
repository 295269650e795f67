"""Raw course-recommendation datasets as bundles of three tables and their roles.

Every reader declares its columns, keeps the order of the source rows in
``row_id``, and returns DataFrames that have not run yet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.columns import ITEM, RATING, ROW, TIME, USER
from rankloom.functions.text import flatten_list_text
from rankloom.functions.times import academic_year, epoch_seconds
from rankloom.operators.cleaning import number
from rankloom.operators.ordering import HOT_ROWS, running_sums
from rankloom.session import durable

KINDS = ("bin", "num", "cat", "text", "list")


@dataclass(frozen=True)
class Bundle:
    """Interactions, item and user tables, and the role of each feature column."""

    interactions: DataFrame
    items: DataFrame
    users: DataFrame
    roles: dict[str, dict[str, list[str]]]


def roles(users=None, items=None, inter=None) -> dict[str, dict[str, list[str]]]:
    return {
        group: {kind: list((given or {}).get(kind, [])) for kind in KINDS}
        for group, given in (("users", users), ("items", items), ("inter", inter))
    }


def _fields(text: str) -> T.StructType:
    return T.StructType([T.StructField(n.strip(), T.StringType()) for n in text.split(",")])


def file_order() -> Column:
    """Place of a row in its files: file, split start, and order within the split."""
    return F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_csv(spark: SparkSession, paths, columns: str, ordered: bool = False, multiline: bool = False) -> DataFrame:
    """CSV files with a header as text columns; only the listed columns are kept.

    Columns are matched by header name, so files may hold others in any order.
    ``multiline`` allows line breaks inside quotes; such a file is read by one task; ``read_quoted_csv`` splits it.
    """
    wanted = [n.strip() for n in columns.split(",")]
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for path in paths:
        raw = reader.csv(path)
        part = raw.select(*[F.col(f"`{n}`") for n in wanted if n in raw.columns], *([file_order().alias(ROW)] if ordered else []))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_quoted_csv(spark: SparkSession, path: str, columns: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Like an ordered ``read_csv`` with ``multiline``, but many tasks read one file.

    Files are read as lines. A line begins a record if an even number of quotes lies before it in its file, which a running sum over
    ranges of lines tells; the lines of a record are put together and parsed. So a quote may stand only around a value or, doubled, inside
    a quoted one, and the header is one line. ``row_id`` is the place of a record's first line. A file without records gives no rows.
    """
    wanted = [n.strip() for n in columns.split(",")]
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    place = ["start", "line"]
    lines = spark.read.option("lineSep", "\n").text(path).select(file_order().alias("_o"), F.regexp_replace("value", "\r$", "").alias("text"))
    # Numbers of lines are fixed here, before several jobs read them.
    lines = durable(lines.select("_o.*", "text"), "csv-lines")
    order = [F.col(c) for c in place]
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    counted = running_sums(lines, ["file"], order, {"_quotes": quotes}, hot_rows=hot_rows)
    begins = (F.pmod(F.col("_quotes") - quotes, F.lit(2)) == 0).cast("long")
    records = running_sums(counted.withColumn("_begins", begins).drop("_quotes"), ["file"], order, {"_record": F.col("_begins")}, hot_rows=hot_rows)
    parts = F.sort_array(F.collect_list(F.struct(*place, "text")))
    whole = records.groupBy("file", "_record").agg(parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")
    first = F.col("_parts")[0]
    rows = whole.where(F.col("_record") > 1).select(
        text.alias("_text"), F.struct("file", first["start"].alias("start"), first["line"].alias("line")).alias(ROW)
    )
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    parsed = rows.where(F.trim("_text") != "").select(F.from_csv("_text", schema, {"escape": '"'}).alias("_r"), ROW)
    return parsed.select(*[F.col(f"_r._c{names.index(n)}").alias(n) for n in wanted if n in names], ROW)


def first_per_id(df: DataFrame, key: str) -> DataFrame:
    """One row per entity: the first in source order, which ``row_id`` keeps."""
    columns = [c for c in df.columns if c != key]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.col(ROW)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def capped(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in source order, or all of them."""
    return df if limit is None else df.orderBy(ROW).limit(limit)


def valid_times(df: DataFrame, non_negative: bool = False) -> DataFrame:
    """Turn ``timestamp`` into epoch seconds and drop rows without a valid one."""
    timed = df.withColumn(TIME, epoch_seconds(F.col(TIME)))
    return timed.where((F.col(TIME) >= 0) if non_negative else F.col(TIME).isNotNull())


def observe_dropped_times(df: DataFrame, observation) -> DataFrame:
    """Count rows with an invalid or negative time while the data passes by."""
    seconds = epoch_seconds(F.col(TIME))
    bad = F.coalesce((seconds < 0), F.lit(True)).cast("bigint")
    return df.observe(observation, F.coalesce(F.sum(bad), F.lit(0)).alias("invalid_times"))


def mars(spark: SparkSession, folder: str, feedback: str, limit: int | None = None, observation=None) -> Bundle:
    """English and French course ratings, explicit or implicit."""
    explicit = feedback == "explicit"
    languages = ("en", "fr")
    wanted = "user_id, item_id, created_at, watch_percentage" + (", rating" if explicit else "")
    events = read_csv(spark, [f"{folder}/{feedback}_ratings_{x}.csv" for x in languages], wanted, ordered=True)
    events = events.withColumnsRenamed({"created_at": TIME})
    if observation is not None:
        events = observe_dropped_times(events, observation)
    events = capped(valid_times(events, non_negative=True), limit)
    for c in (RATING, "watch_percentage"):
        if c in events.columns:
            events = events.withColumn(c, number(F.col(c)))
    items = read_csv(
        spark,
        [f"{folder}/items_{x}.csv" for x in languages],
        "item_id, type, language, difficulty, nb_views, duration, name, description, job, software, theme",
        ordered=True,
        multiline=True,
    ).withColumnsRenamed({"type": "item_type"})
    users = read_csv(spark, [f"{folder}/users_{x}.csv" for x in languages], "user_id, job", ordered=True)
    return Bundle(
        events,
        first_per_id(items, ITEM),
        first_per_id(users, USER),
        roles(
            users={"cat": ["job"]},
            items={
                "num": ["nb_views", "duration"],
                "cat": ["language", "difficulty", "item_type"],
                "text": ["name", "description"],
                "list": ["job", "software", "theme"],
            },
            inter={"num": ["watch_percentage"]} if explicit else None,
        ),
    )


def explicit_mars(spark: SparkSession, folder: str, **options) -> Bundle:
    return mars(spark, folder, "explicit", **options)


def implicit_mars(spark: SparkSession, folder: str, **options) -> Bundle:
    return mars(spark, folder, "implicit", **options)


def itm(spark: SparkSession, folder: str, limit: int | None = None) -> Bundle:
    """Project ratings with situation columns and no time.

    The aspect ratings given together with the rating are left out: they are known
    only after the event.
    """
    renamed = {"UserID": USER, "Item": ITEM, "Rating": RATING}
    events = read_csv(spark, f"{folder}/ratings.csv", "UserID, Item, Rating, Class, Semester, Lockdown, class, semester, lockdown", ordered=True)
    events = events.withColumnsRenamed(renamed).withColumn(RATING, number(F.col("rating")))
    events = capped(events.toDF(*[c.lower() for c in events.columns]), limit)
    items = read_csv(spark, f"{folder}/items.csv", "Item, Title, Descriptions, title, descriptions", ordered=True, multiline=True)
    users = read_csv(spark, f"{folder}/users.csv", "UserID, Gender, Age, Married, gender, age, married", ordered=True)
    items = items.withColumnsRenamed({"Item": ITEM})
    users = users.withColumnsRenamed({"UserID": USER})
    return Bundle(
        events,
        first_per_id(items.toDF(*[c.lower() for c in items.columns]), ITEM),
        first_per_id(users.toDF(*[c.lower() for c in users.columns]), USER),
        roles(
            users={"bin": ["gender", "married"], "cat": ["age"]},
            items={"text": ["title", "descriptions"]},
            inter={"cat": ["class", "semester", "lockdown"]},
        ),
    )


def doris(spark: SparkSession, folder: str, limit: int | None = None) -> Bundle:
    """Course selections with a score and an academic year, from CSV exports."""
    events = read_csv(
        spark,
        f"{folder}/CourseSelectionTable.csv",
        "StudedntId, CourseId, Score, AcademicYear, semester, coursecollege, coursename",
        ordered=True,
    )
    events = events.withColumnsRenamed(
        {"StudedntId": USER, "CourseId": ITEM, "Score": RATING, "AcademicYear": TIME}
    )
    events = events.withColumn(RATING, number(F.col(RATING))).withColumn(TIME, academic_year(F.col(TIME)))
    events = capped(events.dropna(subset=[RATING, TIME]), limit)
    items = read_csv(
        spark, f"{folder}/CourseInformationTable.csv", "CourseId, type, grade, prerequisite, introduction",
        ordered=True, multiline=True,
    ).withColumnsRenamed({"CourseId": ITEM, "type": "item_type"})
    users = read_csv(
        spark, f"{folder}/StudentInformationTable.csv", "StudentId, enrollmentyear, education, major", ordered=True
    ).withColumnsRenamed({"StudentId": USER})
    return Bundle(
        events,
        first_per_id(items, ITEM),
        first_per_id(users, USER),
        roles(
            users={"cat": ["enrollmentyear", "education", "major"]},
            items={"cat": ["item_type", "grade", "prerequisite"], "text": ["introduction"]},
            inter={"cat": ["semester", "coursecollege"], "text": ["coursename"]},
        ),
    )


COURSE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("field", T.ArrayType(T.StringType())),
        T.StructField("prerequisites", T.StringType()),
        T.StructField("about", T.StringType()),
        T.StructField("resource", T.ArrayType(T.StringType())),
    ]
)
STUDENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("school", T.StringType()),
        T.StructField("year_of_birth", T.StringType()),
        T.StructField("course_order", T.ArrayType(T.LongType())),
        T.StructField("enroll_time", T.ArrayType(T.StringType())),
    ]
)


def enrollments(students: DataFrame, order: Column) -> DataFrame:
    """One event per aligned entry of the course and time arrays of a student.

    Students whose arrays differ in length are left out, and so are entries
    without a course or a valid time.
    """
    aligned = students.where(F.size("course_order") == F.size("enroll_time"))
    entries = aligned.select(
        F.col("id").alias(USER),
        order.alias("_order"),
        F.posexplode(F.arrays_zip("course_order", "enroll_time")).alias("_at", "_entry"),
    )
    events = entries.select(
        USER,
        F.concat(F.lit("C_"), F.col("_entry.course_order").cast("string")).alias(ITEM),
        F.col("_entry.enroll_time").alias(TIME),
        F.struct(F.col("_order").alias("source"), F.col("_at").alias("at")).alias(ROW),
    )
    return valid_times(events.where(F.col(ITEM).isNotNull()))


def mooccubex(spark: SparkSession, folder: str, limit: int | None = None) -> Bundle:
    """Course enrollments nested in JSON Lines student records."""
    courses = spark.read.schema(COURSE_SCHEMA).json(f"{folder}/entities/course.json")
    items = courses.withColumnRenamed("id", ITEM).withColumn("resource_count", F.size("resource"))
    items = first_per_id(items.drop("resource").withColumn(ROW, file_order()), ITEM)
    students = spark.read.schema(STUDENT_SCHEMA).json(f"{folder}/entities/user.json")
    ordered = students.withColumn("_file", file_order())
    events = enrollments(ordered, F.col("_file")).join(items.select(ITEM), ITEM, "left_semi")
    users = ordered.select(
        F.col("id").alias(USER), "gender", "school", number(F.col("year_of_birth")).alias("year_of_birth"),
        F.col("_file").alias(ROW),
    )
    return Bundle(
        capped(events.select(USER, ITEM, TIME, ROW), limit),
        items,
        first_per_id(users, USER),
        roles(
            users={"num": ["year_of_birth"], "cat": ["gender", "school"]},
            items={"num": ["resource_count"], "text": ["name", "prerequisites", "about"], "list": ["field"]},
        ),
    )


# Counted lesson classes and the columns that hold the counts.
LESSON_CLASSES = {
    "lecture": "num_lectures",
    "chapter": "num_chapters",
    "quiz": "num_quizzes",
    "practice": "num_practices",
}
COURSE_TEXTS = ("short_description", "objectives", "requirements", "target_audience", "long_description")
INSTRUCTOR_STATS = ("num_instructors", "instructor_enrollments", "instructor_reviews")


def instructor_stats(teach: DataFrame, instructors: DataFrame, course: str = "course_id") -> DataFrame:
    """Distinct instructors and their summed reach per course."""
    joined = teach.join(instructors, "instructor_id", "left")
    return joined.groupBy(course).agg(
        F.countDistinct("instructor_id").alias("num_instructors"),
        F.coalesce(F.sum(number(F.col("total_enrollments"))), F.lit(0.0)).alias("instructor_enrollments"),
        F.coalesce(F.sum(number(F.col("total_reviews"))), F.lit(0.0)).alias("instructor_reviews"),
    )


def class_counts(rows: DataFrame, key: str, column: str, classes: dict[str, str]) -> DataFrame:
    """Rows per key and fixed class, one column per class; other classes are ignored."""
    counts = [F.count_if(F.col(column) == value).alias(name) for value, name in classes.items()]
    return rows.groupBy(key).agg(*counts)


def coco(spark: SparkSession, folder: str, limit: int | None = None) -> Bundle:
    """Course reviews with curriculum and instructor statistics per course."""
    # Comments may hold line breaks.
    events = read_quoted_csv(spark, f"{folder}/evaluate_latest.csv", "learner_id, course_id, learner_rating, learner_timestamp")
    events = capped(events, limit).dropna()
    events = events.withColumnsRenamed(
        {"learner_id": USER, "course_id": ITEM, "learner_rating": RATING, "learner_timestamp": TIME}
    )
    events = events.withColumn(ITEM, F.col(ITEM).cast("double").cast("bigint"))
    events = valid_times(events.withColumn(RATING, F.col(RATING).cast("float")))
    items = read_csv(
        spark,
        f"{folder}/course_latest.csv",
        "course_id, language, first_level_category, second_level_category, instructional_level, subtitles, "
        + ", ".join(COURSE_TEXTS),
        ordered=True,
        multiline=True,
    )
    items = items.withColumns({c: flatten_list_text(F.col(c)) for c in COURSE_TEXTS if c in items.columns})
    items = first_per_id(items, "course_id")
    teach = read_csv(spark, f"{folder}/teach_latest.csv", "course_id, instructor_id")
    people = read_csv(spark, f"{folder}/instructor_latest.csv", "instructor_id, total_enrollments, total_reviews")
    lessons = read_csv(spark, f"{folder}/curriculum_lesson_chapter_latest.csv", "course_id, class")
    counted = [*INSTRUCTOR_STATS, *LESSON_CLASSES.values()]
    items = items.join(instructor_stats(teach, people), "course_id", "left")
    items = items.join(class_counts(lessons, "course_id", "class", LESSON_CLASSES), "course_id", "left")
    items = items.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("float") for c in counted})
    items = items.withColumn(ITEM, F.col("course_id").cast("bigint")).drop("course_id")
    return Bundle(
        events,
        items,
        events.groupBy(USER).agg(F.min(ROW).alias(ROW)),
        roles(
            items={
                "num": counted,
                "cat": ["language", "first_level_category", "second_level_category", "instructional_level"],
                "text": list(COURSE_TEXTS),
                "list": ["subtitles"],
            }
        ),
    )


READERS: dict[str, Callable[..., Bundle]] = {
    "explicit_mars": explicit_mars,
    "implicit_mars": implicit_mars,
    "itm": itm,
    "doris": doris,
    "mooccubex": mooccubex,
    "coco": coco,
}

# Event caps that the published experiments used, for ``limit``.
PUBLISHED_LIMITS = {"mooccubex": 500_000, "coco": 100_000}


def register(name: str) -> Callable:
    """Decorator that adds a reader under a name."""

    def add(reader: Callable[..., Bundle]) -> Callable[..., Bundle]:
        READERS[name] = reader
        return reader

    return add


def load(spark: SparkSession, name: str, folder: str, **options) -> Bundle:
    if name not in READERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(READERS)}")
    return READERS[name](spark, folder, **options)
