"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what ``bytes.split()`` and ``[\x20\x09-\x0D]`` agree on.
ASCII_SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def ship_package(spark: SparkSession) -> None:
    """Gives this package's code to the Python workers of a session, once (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if getattr(sc, "_tracefuse_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tracefuse-code-")) / "tracefuse.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tracefuse_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(name: str) -> Column:
    """UTF-8 bytes of a text column, empty for NULL."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def id_crc32(name: str) -> Column:
    """Unsigned CRC-32 of an id written as text (NULL: of the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def blobs(column) -> list[bytes]:
    """Binary Arrow column as Python bytes, empty for NULL."""
    return [v or b"" for v in column.to_pylist()]


def texts(column) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def word_spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in ``b' '.join(words)``."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[:1] = 0
    starts[1:] = ends[:-1] + 1
    return starts, ends


def splitmix64(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit mixing: spreads structured keys evenly, without collisions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of :func:`splitmix64`."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x
