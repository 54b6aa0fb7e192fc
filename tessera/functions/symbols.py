"""40-bit symbols as BIGINT, their text forms, and ids derived by hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORE = 0x10 << 32  # symbols allocated in order start here


def symbol_hex(symbol: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(symbol), 10, "0"))


def symbol_of_hex(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def symbol_bytes(symbol: Column) -> Column:
    """Five bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(symbol), 10, "0"))


def allocated(index: Column) -> Column:
    """Symbol of an allocation index (from 0)."""
    return F.lit(CORE) + index.cast("long")


def local_symbol(source_id: Column, anchor: Column) -> Column:
    """Symbol text of a token that the lexicon doesn't have, local to its source."""
    return F.concat(F.lit("0xF"), F.upper(F.substring(F.sha1(F.concat_ws("\n", source_id.cast("string"), anchor).cast("binary")), 1, 9)))


# Codes of the categories of labels.
CATEGORIES = {"core": 0, "specialized": 1, "future": 2}


def label_symbol(label: Column, category: str = "specialized", priority: int = 4) -> Column:
    """Symbol text of a label: a byte of category and priority (0 to 7), then four of the label's SHA-256."""
    first = CATEGORIES[category] << 5 | max(0, min(7, priority)) << 2
    return F.concat(F.lit(f"0x{first:02X}"), F.upper(F.substring(F.sha2(F.lower(F.trim(label)).cast("binary"), 256), 1, 8)))


def temp_symbol(version: str, source_id: Column, anchor: Column, salt: Column) -> Column:
    joined = F.concat_ws("::", F.lit(version), source_id.cast("string"), anchor, salt.cast("string"))
    return F.concat(F.lit("U"), F.upper(F.substring(F.sha2(joined.cast("binary"), 256), 1, 11)))


def phrase_id(anchors: Column, symbols: Column) -> Column:
    seed = F.concat(F.array_join(anchors, "\x1f"), F.lit("\x1e"), F.array_join(symbols, "\x1f"))
    return F.concat(F.lit("0x"), F.upper(F.substring(F.sha2(seed.cast("binary"), 256), 1, 10)))


def grid_bits(symbol: Column) -> Column:
    """The 40 bits of a symbol, most significant first."""
    return F.transform(F.sequence(F.lit(39), F.lit(0), F.lit(-1)), lambda k: (F.shiftright(symbol, 0) / F.pow(F.lit(2.0), k)).cast("long") % 2)
