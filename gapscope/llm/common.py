"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gapscope.operators.rounds import cut, drop_table, shared_folder

__all__ = ["ASCII_SPACE", "claim", "crc32", "cut", "drop_table", "give_back", "in_small_batches", "shared_folder", "small_batches", "text_key", "worker_store"]

ASCII_SPACE = "\t\n\x0b\x0c\r "


def give_back() -> None:
    """Hand freed memory back to the system where the C library can; workers live on from task to task."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return
    trim(0)


def worker_store(owner: str, name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, so later tasks find it warm.

    Objects of one owner are kept at a time: a worker that goes on with another operator
    drops what the former one remembered.
    """
    held = claim(owner)
    if name not in held:
        held[name] = make()
    return held[name]


def claim(owner: str) -> dict[str, object]:
    """What this worker remembers for ``owner``; anything held for another one is dropped."""
    module = sys.modules.setdefault("_task_local_store", types.ModuleType("_task_local_store"))
    held = module.__dict__.setdefault("held", {})
    if module.__dict__.get("owner") != owner:
        held.clear()
        give_back()
        module.owner = owner
    return held


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Python tasks get at most ``BATCH_BYTES`` of rows at a time; a smaller setting stays.

    Whole texts travel in these batches, and a worker holds a batch as bytes and as strings.
    """
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


@contextmanager
def in_small_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` for what runs inside; the session's own setting comes back afterwards."""
    before = spark.conf.get(BATCH_SETTING)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def crc32(text):
    """CRC-32 of the UTF-8 text, unsigned; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_key(text):
    """128 bits that stand for a text (null is a text of its own)."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))
