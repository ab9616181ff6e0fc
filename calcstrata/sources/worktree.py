"""Files of a working tree as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import tree
from .files import Files

#: Fixed value: the folder of the store inside a working tree.
STORE = ".calcstrata"
IGNORE_FILE = ".calcstrataignore"


def scan(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """path (relative), mtime, size_bytes[, content] of all files under ``root``, hidden ones too, but the store's own and the ignore file."""
    return tree.read(spark, root, contents, skip=[STORE]).where(F.col("path") != IGNORE_FILE)


def patterns(files: Files) -> list[str]:
    """Patterns of the ignore file; none if it is missing or unreadable."""
    try:
        return S.ignore_patterns(files.read(IGNORE_FILE) if files.exists(IGNORE_FILE) else "")
    except UnicodeDecodeError:
        return []
