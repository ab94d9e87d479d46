"""What the text operators share: byte-level words and Arrow column access.

Texts travel to Python as UTF-8 bytes in Arrow batches. ``bytes.lower`` lowers exactly
A-Z, and ``bytes.split``/``bytes.strip`` cut exactly at the bytes 0x20 and 0x09-0x0D, so
both follow the operators' definitions without a regular expression. A byte of a longer
UTF-8 sequence is never one of those, so that no character is ever cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of A-Z lowered; everything but 0-9, a-z and bytes of non-ASCII characters becomes a blank.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.translate(ALNUM).split()


def as_bytes(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text as bytes, null as empty."""
    return df.select(*columns, F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text"))


def cut(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects of few texts exist at once. A worker waits for its next task without
    the buffers of this one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def crc_mod(doc_id, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def crc_mod_col(column: str, mod: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(mod))
