"""Saving fitted stages: ``PipelineModel.write().save(path)`` and ``PipelineModel.load(path)`` for the library's models.

A stage's plain values go into its metadata as JSON, its fitted tables next to it as Parquet, its inner models as saved
models of their own. Paths may lie on any file system that Spark writes to.
"""

from __future__ import annotations

import dataclasses
import importlib

import numpy as np
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


def _name(cls: type) -> str:
    return f"{cls.__module__}:{cls.__qualname__}"


def _class(name: str) -> type:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


def _pack(value, path: str, spark, made: list[int]):
    """A JSON form of a value; tables and models are written below ``path`` and named by a running number."""
    if isinstance(value, DataFrame):
        made[0] += 1
        value.write.parquet(f"{path}/tables/{made[0]}")
        return {"table": made[0]}
    if isinstance(value, MLWritable):
        made[0] += 1
        value.write().session(spark).save(f"{path}/models/{made[0]}")
        return {"model": made[0]}
    if dataclasses.is_dataclass(value):
        fields = {f.name: _pack(getattr(value, f.name), path, spark, made) for f in dataclasses.fields(value)}
        return {"record": _name(type(value)), "fields": fields}
    if isinstance(value, dict):
        return {"pairs": [[_pack(k, path, spark, made), _pack(v, path, spark, made)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        kind = "list" if isinstance(value, list) else "tuple"
        return {kind: [_pack(v, path, spark, made) for v in value]}
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, np.generic):
        value = value.item()
    if value is None or isinstance(value, (bool, int, float, str)):
        return {"value": value}
    raise TypeError(f"cannot save a {type(value).__name__}")


def _unpack(form: dict, path: str, spark):
    (kind, value), *rest = form.items()
    if kind == "table":
        return spark.read.parquet(f"{path}/tables/{value}")
    if kind == "model":
        return DefaultParamsReader.loadParamsInstance(f"{path}/models/{value}", spark)
    if kind == "record":
        return _class(value)(**{k: _unpack(v, path, spark) for k, v in form["fields"].items()})
    if kind == "pairs":
        return {_unpack(k, path, spark): _unpack(v, path, spark) for k, v in value}
    if kind in ("list", "tuple"):
        items = [_unpack(v, path, spark) for v in value]
        return items if kind == "list" else tuple(items)
    return np.array(value) if kind == "array" else value


class _Writer(MLWriter):
    def __init__(self, instance: "Saved"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, made = self.sparkSession, [0]
        state = {k: _pack(v, path, spark, made) for k, v in vars(self.instance).items()
                 if not k.startswith("_") and k != "uid" and not isinstance(v, Param)}
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"state": state})


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls.__new__(self.cls)
        Params.__init__(stage)
        stage._resetUid(metadata["uid"])
        for k, form in metadata["state"].items():
            setattr(stage, k, _unpack(form, path, spark))
        return stage


class Saved(MLWritable, MLReadable):
    """Mixin: everything in the instance's attributes is saved and comes back."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
