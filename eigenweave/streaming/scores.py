"""Scores of samples as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..operators.base import SingleSet
from ..plans.matrix import arrays, slices


def transform_stream(model: SingleSet, rows: DataFrame, keys: Sequence[str], features: str) -> DataFrame:
    """Scores of packed samples (key columns and an array of all features in the model's order), streaming or not.

    A row is projected by itself: no state, no shuffle, so it works in any output mode. Rows whose array is null, of another length, or holds missing
    values come out with a null `scores`.
    """
    offset, factor = model.preprocessor.factors()
    weights = model._ready().get("projection", model.data["components"])
    if np.iscomplexobj(weights) or model.preprocessor.is_complex:
        raise TypeError("only real models project streams")
    p, keys = len(offset), tuple(keys)
    kinds = {f.name: f for f in rows.schema.fields}
    schema = StructType([*[StructField(k, kinds[k].dataType) for k in keys], StructField("scores", ArrayType(DoubleType()))])

    def run(batches):
        for b in slices(batches):
            x = b.column(b.schema.get_field_index("__x"))
            known = x.is_valid()
            good = known.to_numpy(zero_copy_only=False)
            v = x.filter(known).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            out = ((v - offset) * factor) @ weights
            at = pa.array(np.cumsum(good) - 1, pa.int64(), mask=~good)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], arrays(out, False)[0].take(at)], names=[*keys, "scores"])

    x = F.col(features).cast("array<double>")
    whole = (F.size(x) == p) & F.forall(x, lambda c: F.coalesce(~F.isnan(c), F.lit(False)))
    return rows.select(*keys, F.when(whole, x).alias("__x")).mapInArrow(run, schema)


def window_fields(events: DataFrame, time: str, feature: Sequence[str], value: str, width: str, late: str) -> DataFrame:
    """Events summed by tumbling window and feature, with a watermark: the long cells that a model's `transform` takes from each micro-batch."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("__w"), *feature).agg(F.sum(value).alias("value")).select(F.col("__w.start").alias(time), *feature, "value")
