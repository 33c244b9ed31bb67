"""Folds as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Arguments of each kind of fold and their defaults (None: has to be given).
KINDS = {
    "timeseries": {"splits": None, "step": None, "test": 0, "max_train": 0},
    "rolling": {"window": None, "step": None, "test": None},
    "expanding": {"start": None, "step": None, "test": None},
}


class CvFolds:
    """``cv_folds(TABLE(counts) PARTITION BY sym, kind => 'rolling', window => 100, step => 50, test => 25)``.

    The table has one row for each series, its name first and its number of rows ``n`` as the column of that name; the name's type is the
    result's. Returns the name, ``fold, train_start, train_end, test_start, test_end``, the ends exclusive: the same folds as the
    ``cv_*`` functions of ``operators.learning``."""

    @staticmethod
    def analyze(counts: AnalyzeArgument, kind: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        if not counts.isTable or "n" not in counts.dataType.names or len(counts.dataType) < 2:
            raise ValueError("the first argument is a table of a series' name and n")
        if kind.value not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        known = KINDS[kind.value]
        if odd := [k for k in options if k not in known] + [k for k, v in known.items() if v is None and k not in options]:
            raise ValueError(f"{kind.value} folds have the arguments {', '.join(known)}; not right: {', '.join(odd)}")
        if any(v.value is None or v.value < 0 or v.value == 0 and known[k] is None for k, v in options.items()):
            raise ValueError("arguments are whole numbers over 0")
        name = next(f for f in counts.dataType.fields if f.name != "n")
        schema = StructType().add(name.name, name.dataType).add("fold", IntegerType())
        for c in ("train_start", "train_end", "test_start", "test_end"):
            schema = schema.add(c, LongType())
        return AnalyzeResult(schema)

    def eval(self, counts, kind: str, **options) -> Iterator[tuple]:
        name = next(counts[f] for f in counts.__fields__ if f != "n")
        o = {**KINDS[kind], **options}
        n = counts["n"]
        if kind == "timeseries":
            size = o["test"] or n // (o["splits"] + 1)
            for k in range(o["splits"]):
                at = size + k * o["step"]
                if at + size <= n:
                    yield name, k, max(0, at - o["max_train"]) if o["max_train"] else 0, at, at, at + size
            return
        first = o["window"] if kind == "rolling" else o["start"]
        for k, at in enumerate(range(first, n - o["test"] + 1, o["step"])):
            yield name, k, at - first if kind == "rolling" else 0, at, at, at + o["test"]


def register_folds(spark: SparkSession) -> None:
    """Makes ``cv_folds`` known to the session's SQL."""
    spark.udtf.register("cv_folds", udtf(CvFolds))
