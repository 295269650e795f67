"""Canonical column names and default parameters shared by all operators."""

from __future__ import annotations

# Names and defaults that results depend on.
USER = "user_id"
ITEM = "item_id"
RATING = "rating"
RELEVANT = "relevant"
TIME = "timestamp"
CANONICAL = (USER, ITEM, RATING, RELEVANT, TIME)

MIN_INTERACTIONS = 3
VAL_RATIO = 0.1
TEST_RATIO = 0.2
HISTORY_LENGTH = 50
NEGATIVES_PER_POSITIVE = 4
TOP_KS = (5, 10, 20)
METRICS = ("precision", "recall", "ndcg", "hit", "map", "mrr")
TEXT_DIM = 384
GRAPH_LAYERS = 2
EDGE_DROP = 0.2
EVALUATION_PROTOCOL = "one-target-per-interaction-v1"
UNDEFINED = "Undefined"

# Ours: the explicit tie-breaker that replaces file order, and the split tag.
ROW = "row_id"
SPLIT = "split"
SPLITS = ("train", "val", "test")


def require(df, *names: str) -> None:
    """Raise a plan-time error when a needed column is absent."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(sorted(missing))}")


def is_explicit(df) -> bool:
    return RATING in df.columns


def is_temporal(df) -> bool:
    return TIME in df.columns


def context_columns(df) -> list[str]:
    """Interaction columns that describe the situation of an event."""
    return [c for c in df.columns if c not in (*CANONICAL, ROW, SPLIT)]


def ordered_columns(columns: list[str]) -> list[str]:
    """The columns with the canonical ones in front, in their fixed order."""
    place = {name: at for at, name in enumerate(CANONICAL)}
    return sorted(columns, key=lambda name: place.get(name, len(place)))
