"""Logging and deprecation."""

from __future__ import annotations

import functools
import logging
import os
import tempfile
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the largest table that goes to every executor: twice the default grid's voxels.
MAX_BROADCAST_ROWS = 2_000_000


def small(table: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``table`` marked to be broadcast if it was counted and has at most ``most`` rows, else as it is."""
    return F.broadcast(table) if table.count() <= most else table


def cut(table: DataFrame) -> DataFrame:
    """``table`` written to the folder of ``spark.checkpoint.dir``, without its lineage; a local master may do without the setting."""
    spark = table.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return table.checkpoint()


def deprecated(*args):
    """Decorator, with or without a message: a call warns with DeprecationWarning."""
    message = args[0] if args and isinstance(args[0], str) else ""

    def wrap(f):
        @functools.wraps(f)
        def call(*a, **k):
            warnings.warn(f"{f.__name__} is deprecated. {message}".strip(), DeprecationWarning, stacklevel=2)
            return f(*a, **k)

        return call

    return wrap(args[0]) if args and callable(args[0]) else wrap


def set_logging_level(level: str | None = None) -> None:
    """The package's logging level: the argument, or FOCALGRID_LOGLEVEL, or warn."""
    name = (level or os.environ.get("FOCALGRID_LOGLEVEL") or "warn").upper()
    logging.getLogger("focalgrid").setLevel("WARNING" if name == "WARN" else name)
