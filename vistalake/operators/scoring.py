"""B1, B2: scoring with a user's model, failures kept apart by item."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_models: dict[str, object] = {}


def score_batches(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch_size: int = 32) -> DataFrame:
    """B1: rows through a model in batches; the model is made once per Python worker and maps a frame to one of the same length.

    B2: `schema` gets success and error_msg. A batch that fails is scored row by row; rows that fail
    alone carry the message and null results, the others are not touched.
    """
    key = uuid.uuid4().hex
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _models:
            _models[key] = make_model()
        model = _models[key]
        for frame in batches:
            for low in range(0, len(frame), batch_size):
                part = frame.iloc[low : low + batch_size].reset_index(drop=True)
                try:
                    out = model(part).assign(success=True, error_msg=None)
                except Exception:  # noqa: BLE001 - whatever the model raises
                    rows = []
                    for k in range(len(part)):
                        one = part.iloc[[k]].reset_index(drop=True)
                        try:
                            rows.append(model(one).assign(success=True, error_msg=None))
                        except Exception as e:  # noqa: BLE001
                            rows.append(one.reindex(columns=names).assign(success=False, error_msg=str(e)))
                    out = pd.concat(rows, ignore_index=True)
                yield out[[*names, "success", "error_msg"]].astype({"success": bool})

    return df.mapInPandas(run, f"{schema}, success boolean, error_msg string")


def with_outcome(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: results that succeeded, and those that failed."""
    return results.filter("success"), results.filter("not success")
