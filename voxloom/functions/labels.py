"""Label vocabularies as plain values, column lookups and dimension frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw class on disk -> train class; any other raw class is 0.
RAW_TO_TRAIN = {
    0: 0, 1: 0, 10: 1, 11: 2, 13: 5, 15: 3, 16: 5, 18: 4, 20: 5, 30: 6, 31: 7, 32: 8, 40: 9, 44: 10, 48: 11, 49: 12, 50: 13,
    51: 14, 52: 0, 60: 9, 70: 15, 71: 16, 72: 17, 80: 18, 81: 19, 99: 0, 252: 20, 253: 21, 254: 22, 255: 23, 256: 24, 257: 24,
    258: 25, 259: 24,
}

#: Train class -> weight of its residuals.
WEIGHT = {**{k: 1.0 for k in range(20)}, 16: 1.2, 18: 1.2, 19: 1.2, **{k: 0.0 for k in range(20, 26)}}

#: Train class -> priority of a ring/sector cell, 0 to leave it out.
PRIORITY = {
    0: 0, 1: 22, 2: 0, 3: 0, 4: 21, 5: 20, 6: 0, 7: 0, 8: 0, 9: 10, 10: 11, 11: 12, 12: 13, 13: 15, 14: 16, 15: 14, 16: 17,
    17: 9, 18: 18, 19: 19, 20: 0, 21: 0, 22: 0, 23: 0, 24: 0, 25: 0,
}

#: Train class -> colour for display.
COLOUR = {
    0: (0, 0, 0), 1: (100, 150, 245), 2: (100, 230, 245), 3: (30, 60, 150), 4: (80, 30, 180), 5: (100, 80, 250), 6: (255, 30, 30),
    7: (255, 40, 200), 8: (150, 30, 90), 9: (255, 0, 255), 10: (255, 150, 255), 11: (75, 0, 75), 12: (175, 0, 75),
    13: (255, 200, 0), 14: (255, 120, 50), 15: (0, 175, 0), 16: (135, 60, 0), 17: (150, 240, 80), 18: (255, 240, 150),
    19: (255, 0, 0), 20: (100, 150, 245), 21: (255, 40, 200), 22: (255, 30, 30), 23: (150, 30, 90), 24: (0, 0, 255),
    25: (80, 30, 180),
}

FOREGROUND = (1, 4, 5, 16, 18)
BACKGROUND = (9, 13, 14, 15)
VEHICLE, TRUNK, POLE = 1, 2, 3
#: Node class -> train class for messages.
NODE_TO_TRAIN = {1: 1, 2: 16, 3: 18}
FIRST_MOVING = 20


def lookup(table: dict[int, float], key: Column, default: float) -> Column:
    """A literal table as one array access: no join, and the key is computed once."""
    dense = F.array(*[F.lit(table.get(k, default)) for k in range(max(table) + 1)])
    return F.coalesce(F.get(dense, key.cast("int")), F.lit(default))


def train_label(raw: Column) -> Column:
    return lookup(RAW_TO_TRAIN, raw, 0)


def semantic_weight(label: Column) -> Column:
    return lookup(WEIGHT, label, 1.0)


def priority(label: Column) -> Column:
    return lookup(PRIORITY, label, 0)


def node_class(label: Column) -> Column:
    """Train class -> node class: vehicle 1, trunk 2, pole 3, else null."""
    return F.when(label.isin(1, 4, 5), VEHICLE).when(label == 16, TRUNK).when(label == 18, POLE)


def colour(label: Column) -> Column:
    parts = [lookup({k: v[i] for k, v in COLOUR.items()}, label, 0) for i in range(3)]
    return F.struct(*(p.alias(n) for p, n in zip(parts, "rgb")))


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """One of the tables as a frame of a few dozen rows: label_map, weight, priority, colour."""
    if name == "label_map":
        return spark.createDataFrame(list(RAW_TO_TRAIN.items()), "raw_label int, label int")
    if name == "weight":
        return spark.createDataFrame(list(WEIGHT.items()), "label int, weight double")
    if name == "priority":
        return spark.createDataFrame(list(PRIORITY.items()), "label int, priority int")
    if name == "colour":
        return spark.createDataFrame([(k, *v) for k, v in COLOUR.items()], "label int, r int, g int, b int")
    raise ValueError(f"no dimension {name}")
