"""Word rules that several operators share.

A word is a run of code points other than space and \\x09-\\x0D; in UTF-8 those
six separators are single bytes that appear in no other code point, so
bytes.split() finds exactly these words.
"""

from __future__ import annotations

import pyarrow as pa


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of a column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def n_words(text: bytes | None) -> int:
    return len(text.split()) if text else 0
