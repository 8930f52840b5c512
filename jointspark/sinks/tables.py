"""Site sets as bitset files, and tab-separated tables."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitset_bytes(positions: np.ndarray) -> bytes:
    """Little-endian size, then bits from 0, the lowest bit of a byte first."""
    size = int(positions.max()) // 8 + 1 if len(positions) else 0
    bits = np.zeros(size * 8, np.uint8)
    bits[positions] = 1
    return struct.pack("<i", size) + np.packbits(bits, bitorder="little").tobytes()


def bitset_positions(data: bytes) -> np.ndarray:
    size = struct.unpack_from("<i", data)[0]
    if size != len(data) - 4:
        raise ValueError("a bitset file differs from its declared size")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 4), bitorder="little"))


def site_words(sites: DataFrame, pos: str = "pos") -> DataFrame:
    """(contig, word, bits): a site set as 64-bit words, the distributed form of a bitset."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({pos}, 64) as int))")
    return sites.groupBy("contig", F.floor(F.col(pos) / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def sites_of_words(words: DataFrame) -> DataFrame:
    """(contig, pos) of :func:`site_words`."""
    return words.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("(shiftrightunsigned(bits, _k) & 1L) = 1")).select("contig", (F.col("word") * 64 + F.col("_k")).alias("pos"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def block_line(contig: Column, start: Column, end: Column, ref: Column, quality: Column, depth: Column, least_depth: Column, pl: Column) -> Column:
    """A reference block's record line of one sample."""
    info = F.concat(F.lit("END="), end.cast("string"))
    call = F.concat_ws(":", F.lit("0/0"), depth.cast("string"), quality.cast("string"), least_depth.cast("string"), F.array_join(pl.cast("array<string>"), ","))
    return F.concat_ws("\t", contig.cast("string"), start.cast("string"), F.lit("."), ref, F.lit("<NON_REF>"), F.lit("."), F.lit("."), info, F.lit("GT:DP:GQ:MIN_DP:PL"), call)
