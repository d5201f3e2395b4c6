"""Plug-in points for models: a factory builds a predictor once per Python
worker, Spark feeds it Arrow batches. Filter decided rows before calling;
Python functions run for every row they are planned over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presence.config import DEFAULTS, Settings
from presence.operators.scores import ensemble_vote

Predict = Callable[[np.ndarray], np.ndarray]


def class_probs(
    df: DataFrame, factory: Callable[[], Predict], tensor: str, shape: list[int], batch: int = 256
) -> DataFrame:
    """One model's class probabilities ``p0, p1, p2`` for every row.

    Byte tensors are unsigned pixels; the predictor gets floats.
    """

    def unsigned() -> Predict:
        predict = factory()

        def run(x: np.ndarray) -> np.ndarray:
            return predict((x.view(np.uint8) if x.dtype == np.int8 else x).astype(np.float32))

        return run

    udf = predict_batch_udf(
        unsigned,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch,
        input_tensor_shapes=[shape],
    )
    scored = df.withColumn("_p", udf(F.col(tensor)))
    return scored.withColumns({f"p{k}": F.col("_p")[k] for k in range(3)}).drop("_p")


def score_model(
    inputs: list[tuple[DataFrame, Callable[[], Predict]]],
    key: str,
    tensor: str,
    shape: list[int],
    batch: int = 256,
    s: Settings = DEFAULTS,
) -> DataFrame:
    """Ensemble label and score per key.

    Each model reads its own input table (they may be the same one). Only the
    three probabilities per model and key are exchanged, never the tensors.
    """
    probs = [
        class_probs(df, factory, tensor, shape, batch).select(key, "p0", "p1", "p2")
        for df, factory in inputs
    ]
    out = probs[0]
    for more in probs[1:]:
        out = out.unionByName(more)
    return ensemble_vote(out, key, s)


def embed(
    df: DataFrame,
    factory: Callable[[], Predict],
    pixels: str,
    shape: list[int],
    batch: int = 64,
    out: str = "embedding",
) -> DataFrame:
    """Unit embeddings of pixel tensors; inputs are scaled to -1..1 first."""

    def scaled() -> Predict:
        predict = factory()

        def run(x: np.ndarray) -> np.ndarray:
            v = np.asarray(predict((x.astype(np.float64) / 255.0 - 0.5) / 0.5), dtype=np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return v / np.where(norm < 1e-9, 1.0, norm)

        return run

    udf = predict_batch_udf(
        scaled,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch,
        input_tensor_shapes=[shape],
    )
    return df.withColumn(out, udf(F.col(pixels)))


DETECTION = "cand int, conf double, l double, t double, r double, b double"


def detect(
    images: DataFrame,
    factory: Callable[[], Callable[[np.ndarray], np.ndarray]],
    key: str = "frame_id",
) -> DataFrame:
    """Detection candidates of packed images, one row each.

    The factory's detector maps an (h, w, channels) image to an (m, 5) array
    of confidence and relative corners; images without candidates yield none.
    """
    key_type = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for batch in batches:
            found = []
            for frame, h, w, data in zip(batch[key], batch["frame_h"], batch["frame_w"], batch["data"]):
                image = np.frombuffer(data, dtype=np.uint8).reshape(h, w, -1)
                for cand, row in enumerate(np.asarray(detector(image)).reshape(-1, 5)):
                    found.append((frame, cand, *map(float, row)))
            yield pd.DataFrame(found, columns=[key, "cand", "conf", "l", "t", "r", "b"])

    return images.select(key, "frame_h", "frame_w", "data").mapInPandas(run, f"{key} {key_type}, {DETECTION}")
