"""Model inputs as an ML estimator: fitted once, saved, loaded elsewhere and applied to new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmetrics.operators.order_stats import quantiles
from flowmetrics.schemas import quoted
from flowmetrics.session import settle

ENCODING_LEAF, ENCODING_SMOOTHING = 20.0, 10.0


def encoding_weight(n: Column) -> Column:
    return 1 / (1 + F.exp(-(n - ENCODING_LEAF) / ENCODING_SMOOTHING))


class _Columns(Params):
    numCols = Param(Params._dummy(), "numCols", "number columns: median imputed and standardised", TypeConverters.toListString)
    catCols = Param(Params._dummy(), "catCols", "category columns: target encoded", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "the number to predict", TypeConverters.toString)

    def names(self) -> tuple[list[str], list[str]]:
        return self.getOrDefault(self.numCols), self.getOrDefault(self.catCols)


class FeatureEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`FeatureEncoderModel`: ``num_i`` from ``numCols`` (median imputed, standardised by the population
    deviation) and ``cat_i`` from ``catCols`` (target encoded, the prior for unseen categories)."""

    @keyword_only
    def __init__(self, *, numCols: Sequence[str] = (), catCols: Sequence[str] = (), target: str = "y"):
        super().__init__()
        self._set(**{k: list(v) if k != "target" else v for k, v in {"numCols": numCols, "catCols": catCols, "target": target, **self._input_kwargs}.items()})

    def _fit(self, train: DataFrame) -> FeatureEncoderModel:
        num_cols, cat_cols = self.names()
        target = quoted(self.getOrDefault(self.target))
        middle = quantiles(train, [], {f"m{i}": (c, 0.5) for i, c in enumerate(num_cols)}).first() if num_cols else {}
        middle = [middle[f"m{i}"] if middle is not None else None for i in range(len(num_cols))]
        filled = [_filled(c, m) for c, m in zip(num_cols, middle)]
        moments = [f(v).alias(f"{n}{i}") for i, v in enumerate(filled) for n, f in (("a", F.avg), ("s", F.stddev_pop))]
        whole = train.agg(F.count("*").alias("rows"), F.avg(target).alias("prior"), *moments).first()
        numbers = [[m, whole[f"a{i}"], whole[f"s{i}"]] for i, m in enumerate(middle)]
        w = encoding_weight(F.count("*").cast("double"))
        value = (w * F.avg(target) + (1 - w) * F.lit(whole["prior"])).alias("valor")
        tables = [settle(train.groupBy(quoted(c).alias("categoria")).agg(F.count("*").alias("n"), value)) for c in cat_cols]
        model = FeatureEncoderModel(whole["prior"], numbers, tables if whole["rows"] else None)
        return self._copyValues(model)


def _filled(column: str, middle: float | None) -> Column:
    return F.coalesce(quoted(column).cast("double"), F.lit(middle).cast("double"))


class FeatureEncoderModel(Model, _Columns, MLReadable, MLWritable):
    """``numbers``: median, mean and deviation of each number column; ``encodings``: a table ``categoria, n, valor`` of each
    category column, however many categories there are. All inputs are NULL where there was no training row."""

    def __init__(self, prior: float | None = None, numbers: Sequence[Sequence[float]] = (), encodings: Sequence[DataFrame] | None = None):
        super().__init__()
        self.prior, self.numbers, self.encodings = prior, [list(x) for x in numbers], encodings

    def _transform(self, rows: DataFrame) -> DataFrame:
        num_cols, cat_cols = self.names()
        if self.encodings is None:
            return rows.withColumns({c: F.lit(None).cast("double") for c in [*[f"num_{i}" for i in range(len(num_cols))], *[f"cat_{i}" for i in range(len(cat_cols))]]})
        out = rows
        for i, (c, (middle, mean, deviation)) in enumerate(zip(num_cols, self.numbers)):
            out = out.withColumn(f"num_{i}", (_filled(c, middle) - F.lit(mean)) / F.lit(deviation or 1.0))
        for i, (c, table) in enumerate(zip(cat_cols, self.encodings)):
            known = table.select(F.col("categoria").alias(f"_c{i}"), F.col("valor").alias(f"cat_{i}"))
            out = out.join(known, quoted(c).eqNullSafe(F.col(f"_c{i}")), "left").drop(f"_c{i}")
            out = out.withColumn(f"cat_{i}", F.coalesce(F.col(f"cat_{i}"), F.lit(self.prior)))
        return out

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Parameters and numbers as ML metadata, every encoding as a Parquet table beside them."""

    def __init__(self, model: FeatureEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        more = {"prior": self.model.prior, "numbers": self.model.numbers, "encodings": None if self.model.encodings is None else len(self.model.encodings)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=more)
        for i, table in enumerate(self.model.encodings or ()):
            table.write.parquet(f"{path}/encodings/{i}")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureEncoderModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = None if found["encodings"] is None else [self.sparkSession.read.parquet(f"{path}/encodings/{i}") for i in range(found["encodings"])]
        model = self.cls(found["prior"], found["numbers"], tables)
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model
