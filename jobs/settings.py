"""What both jobs share: their settings files, logs and sessions."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

Settings = TypeVar("Settings")


def read_settings(path: str | None, kind: type[Settings]) -> Settings:
    """Settings from a small JSON file beside the job, or the defaults; an unknown name is an error."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    unknown = sorted(set(found) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{path} sets {', '.join(unknown)}, which {kind.__name__} does not have")
    return kind(**found)


def command(name: str, about: str, paths: dict[str, str], kind: type[Settings], run: Callable[..., object]) -> None:
    """The command line of a job: its paths and settings file; creates the session and stops it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, what in paths.items():
        parser.add_argument(path, help=what)
    parser.add_argument("--settings", help="JSON file of settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = read_settings(given.pop("settings"), kind)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **given, settings=settings)
    finally:
        spark.stop()
