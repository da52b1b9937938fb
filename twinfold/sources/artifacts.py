"""Models and role maps as JSON, on any file system Spark can write to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.model import Model
from ..operators.roles import Roles


def _save(spark: SparkSession, content: dict, path: str) -> None:
    text = json.dumps(content, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    _save(spark, model.to_dict(), path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_dict(_load(spark, path))


def save_roles(spark: SparkSession, roles: Roles, path: str) -> None:
    _save(spark, dict(roles), path)


def load_roles(spark: SparkSession, path: str) -> Roles:
    return Roles(_load(spark, path))
