"""Bloom filters as a table of blocks that is small enough to broadcast.

A 64-bit hash names PROBES of the filter's cells. A filter has BITS cells for each hash it is
made for, at most max_blocks blocks of 4 KiB whatever the input: 4096 blocks, 16 MiB, hold
8 million hashes at 1.4 % of false answers, 33 million at 15 %. A filter never misses; false
answers only cost work. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: Bits of one block of a filter: what bitmap_construct_agg gathers.
BLOCK_BITS = 32768
#: Blocks at most.
MAX_BLOCKS = 4096
#: Cells for each hash, as far as MAX_BLOCKS allows, and those that a hash names.
BITS, PROBES = 16, 2


def blocks_for(hashes: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, hashes * BITS // BLOCK_BITS + 1))


def _cell(h: Column, probe: int, blocks: int) -> Column:
    """The two halves of the hash choose cells apart from each other."""
    half = F.shiftrightunsigned(h, 32 * probe).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(half, F.lit(blocks * BLOCK_BITS)).cast("int")


class Bloom:
    """A filter of the column `h` of hashes: of all of them, or of those that may come `least` times.

    Counts combine in each task before they travel, so a task sends at most the filter, and are
    merged by ranges of cells.
    """

    def __init__(self, hashes: DataFrame, h: str, least: int = 1, max_blocks: int = MAX_BLOCKS):
        self.blocks = blocks_for(hashes.count(), max_blocks)
        cells = hashes.select(F.explode(F.array(*[_cell(F.col(h), i, self.blocks) for i in range(PROBES)])).alias("cell"))
        if least > 1:
            cells = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        bits = cells.groupBy((F.col("cell") / BLOCK_BITS).cast("int").alias("block")).agg(F.bitmap_construct_agg((F.col("cell") % BLOCK_BITS).cast("long")).alias("bits"))
        self.bits = stored(bits, "bloom")

    def mark(self, rows: DataFrame, h: str, flag: str) -> DataFrame:
        """rows with a boolean: whether the filter may hold the hash h. The broadcast is the filter; a null hash is not in it."""
        names = [free_name(rows, f"bloom{i}") for i in range(PROBES)]
        out = rows
        for i, name in enumerate(names):
            bits = self.bits.select(F.col("block").alias(f"{name}_b"), F.col("bits").alias(f"{name}_x"))
            cell = _cell(F.col(h), i, self.blocks)
            out = out.join(F.broadcast(bits), (cell / BLOCK_BITS).cast("int") == F.col(f"{name}_b"), "left")
            bit = (cell % BLOCK_BITS).cast("int")
            byte = F.conv(F.hex(F.substring(F.col(f"{name}_x"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
            out = out.withColumn(name, F.coalesce(F.call_function("getbit", byte, bit.bitwiseAND(7)) == 1, F.lit(False))).drop(f"{name}_b", f"{name}_x")
        met = F.col(names[0])
        for name in names[1:]:
            met = met & F.col(name)
        return out.withColumn(flag, met).drop(*names)
