import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Small interactions with ties, repeats, null times and one heavy user."""
    rows, row = [], 0
    for user in range(12):
        n = 120 if user == 3 else 2 + user
        for k in range(n):
            item = (user * 7 + k * k) % 23
            time = None if (user, k) == (5, 1) else (k * 3) % 40 if user == 3 else k // 2
            rating = None if (user, k) in ((4, 2), (6, 0)) else float((user + k * 5) % 7)
            rows.append((user, item, rating, time, row))
            row += 1
    schema = "user_id bigint, item_id bigint, rating double, timestamp bigint, row_id bigint"
    return spark.createDataFrame(rows, schema)
