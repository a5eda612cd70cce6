"""Models by task, and stages that run them: ONNX files in the workers, or a vision model behind HTTP."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.enrich import Stage, model_stage
from lectern.sources.reader import DocFrames

TASKS = ("layout_analysis", "table_structure", "ocr", "vlm", "picture_classification")


@dataclass
class Registry:
    """Model files by task."""

    models: dict[str, str] = field(default_factory=dict)

    def register(self, task: str, path: str) -> None:
        if task not in TASKS:
            raise ValueError(f"task is one of {', '.join(TASKS)}")
        self.models[task] = path

    def scan(self, folder: str) -> list[str]:
        """Register the ``.onnx`` files of a folder that are named by a task, and tell which."""
        found = [(p.stem, str(p)) for p in sorted(Path(folder).glob("*.onnx")) if p.stem in TASKS]
        for task, path in found:
            self.register(task, path)
        return [task for task, _ in found]

    def path(self, task: str) -> str:
        if task not in self.models:
            raise KeyError(f"no model for {task}")
        return self.models[task]


def infer(rows: DataFrame, model: bytes, tensor: str, shape: tuple[int, ...], name: str = "output") -> DataFrame:
    """``rows`` with the first output of an ONNX model for the array in column ``tensor``, batch by batch.

    The model's bytes travel to the workers once; each opens one session.  Null tensors give null.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        entry = session.get_inputs()[0].name
        for batch in batches:
            given, made = batch[tensor].tolist(), [None] * len(batch)
            there = [k for k, x in enumerate(given) if x is not None]
            if there:
                stacked = np.stack([np.asarray(given[k], np.float32).reshape(shape) for k in there])
                for k, x in zip(there, session.run(None, {entry: stacked})[0].reshape(len(there), -1), strict=True):
                    made[k] = x.astype(np.float32)
            yield batch.assign(**{name: pd.Series(made, dtype=object, index=batch.index)})

    return rows.mapInPandas(run, f"{fields}, `{name}` array<float>")


def described(url: str, body: Callable[[dict], dict], read: Callable[[dict], str], timeout: float = 60.0) -> Callable:
    """Rows (el, text) from a model that answers one POST a row; what fails gives no row and leaves the element as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                request = urllib.request.Request(url, json.dumps(body(row)).encode(), {"Content-Type": "application/json"})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as answer:
                        out.append((row["el"], read(json.loads(answer.read()))))
                except (OSError, ValueError, KeyError, IndexError):
                    continue
            yield pd.DataFrame(out, columns=["el", "text"])

    return run


def text_stage(rows: Callable[[DocFrames], DataFrame], model: Callable) -> Stage:
    """A stage whose model gives (el, text), which replaces the texts of those elements."""

    def merge(f: DocFrames, found: DataFrame) -> DocFrames:
        from pyspark.sql import functions as F

        new = found.select("el", F.col("text").alias("_text"))
        return f.with_(elements=f.elements.join(new, "el", "left").withColumn("text", F.coalesce("_text", "text")).drop("_text"))

    return model_stage(rows, model, "el string, text string", merge)
