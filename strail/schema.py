"""Tables of the data model and the settings of an index."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

UNITS = T.StructType(
    [
        T.StructField("trajectory_id", T.LongType()),
        T.StructField("unit_index", T.LongType()),
        *(T.StructField(n, t) for n, t in (("x0", T.FloatType()), ("y0", T.FloatType()), ("t0", T.LongType()), ("x1", T.FloatType()), ("y1", T.FloatType()), ("t1", T.LongType()))),
        T.StructField("label_id", T.LongType()),
    ]
)
LABELS = T.StructType([T.StructField("label_id", T.LongType()), T.StructField("name", T.StringType())])
KEYS = ["trajectory_id", "unit_index"]
MAX_TIME = 2**32 - 1
MAX_FLOAT = 3.4028234663852886e38


@dataclass(frozen=True)
class IndexConfig:
    """Settings that an index is built with; an index is only opened with the settings it was built with."""

    layout: str = "str_lf"
    leaf_fanout: int = 113
    internal_fanout: int = 127
    lambda_: int = 40
    id_set: str = "interval"
    beta: float = 0.5
    beta_mode: str = "normal"
    version: int = 1

    def __post_init__(self) -> None:
        if self.leaf_fanout < 1 or self.internal_fanout < 2:
            raise ValueError("fan-outs are too small")
        if self.lambda_ < 1:
            raise ValueError("lambda must be at least 1")
        if self.id_set not in ("exact", "interval", "bloom", "null"):
            raise ValueError(f"unknown id set {self.id_set}")
        if self.beta_mode not in ("normal", "increasing", "decreasing"):
            raise ValueError(f"unknown beta mode {self.beta_mode}")
        if not 0 <= self.beta <= 1:
            raise ValueError("beta must be between 0 and 1")

    def row(self) -> dict:
        return asdict(self)

    def beta_at(self, height: int, level: int) -> float:
        """Weight of the spatial cost on a level (the root's is 0)."""
        h = max(1, height - level)
        return {"normal": self.beta, "increasing": self.beta ** (1 / h), "decreasing": self.beta**h}[self.beta_mode]
