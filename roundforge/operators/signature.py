"""Signatures of sets of ids: FNV-1a, in order of the ids, of these joined by '|'.

The hash is a chain, but its pieces can be joined. A code unit u takes a state h to (h xor u) * PRIME, and h xor u is h + d, where d follows from the bits of h that units
have. So a part of n units takes h to h * PRIME^n + c, and c follows from these low bits alone, 7 of them if all ids are ASCII, else 16. Low bits never depend on higher ones:
each pass folds all parts at once, from each value that the next four bits of a part's first state may have, and then the few numbers that each part gives
tell these bits for all parts. The last pass gives the states themselves. No part waits for another, and a task holds the ids of one part, never a set's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundforge.functions import hashing
from roundforge.session import checkpointed

#: Ids that a part has at most.
PART_IDS = 5_000
#: Bits of the state that a pass settles.
STEP = 4
#: The state that '|' takes to the first one, as each part begins with '|'.
BEFORE = hashing.FNV_START * pow(hashing.FNV_PRIME, -1, 1 << 32) % (1 << 32) ^ ord("|")
_UNITS = 1 << 13  # that are folded at once


def folded_from(units: np.ndarray, states: np.ndarray, bits: int) -> np.ndarray:
    """The states to which code units (of ``bits`` bits at most) take each of ``states``; all arrays are uint32."""
    prime = np.uint32(hashing.FNV_PRIME)
    for at in range(0, len(units), _UNITS):
        u = units[at : at + _UNITS]
        low = np.zeros((len(states), len(u)), np.uint32)  # the lowest bits of the state before each unit
        for k in range(bits):
            flips = (((low ^ (u & np.uint32((1 << k) - 1))) * prime ^ u) >> np.uint32(k)) & np.uint32(1)
            before = np.bitwise_xor.accumulate(flips, axis=1) ^ flips ^ ((states >> np.uint32(k)) & np.uint32(1))[:, None]
            low |= before << np.uint32(k)
        powers = np.multiply.accumulate(np.full(len(u), prime, np.uint32), dtype=np.uint32)[::-1]
        states = states * powers[0] + (((low ^ u) - low) * powers).sum(axis=1, dtype=np.uint32)
    return states


def _ends(parts: DataFrame, known: int, bits: int) -> DataFrame:
    """__row, the power of the prime and the states at the end of each part, from its lowest ``known`` bits (__low) and each value of the next ones."""
    first = (np.arange(1 << STEP, dtype=np.uint32) << np.uint32(known)).astype(np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, text, low in zip(b["__row"], b["__text"], b["__low"], strict=True):
                units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
                out.append((row, pow(hashing.FNV_PRIME, len(units), 1 << 32), folded_from(units, first | np.uint32(low), bits).tolist()))
            yield pd.DataFrame(out, columns=["__row", "power", "ends"])

    return parts.select("__row", "__text", "__low").mapInPandas(run, "__row long, power long, ends array<long>")


def _next(state: Column, part: Column, known: int) -> Column:
    """The state after a part; its bits beyond those of this pass may be wrong, until the last one."""
    mask = F.lit(hashing.FNV_MASK).cast("long")
    lane = F.shiftright(state, known).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))
    more = F.shiftleft(F.shiftright(state, known + STEP), known + STEP)  # bits that no fold began with
    high = F.shiftleft((F.shiftright(part["power"], 16) * more).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (F.get(part["ends"], lane.cast("int")) + high + part["power"].bitwiseAND(F.lit(0xFFFF).cast("long")) * more).bitwiseAND(mask)


def signatures(rows: DataFrame, column: str, *group: str, part_ids: int = PART_IDS) -> DataFrame:
    """group and signature: of each group's ids in ``column``, null as the empty id, repeated ones as often as they come. A table without rows has one signature,
    that of no ids, if there is no group."""
    named = rows.select(*group, F.coalesce(F.col(column), F.lit("")).alias("__id"))
    key = [f"__g{i}" for i in range(len(group))] or ["__g"]
    keyed = named.select(*(F.struct(F.col(g)).alias(k) for g, k in zip(group, key, strict=False)), *([] if group else [F.lit(0).alias("__g")]), "__id")  # structs, as a null names a group too
    # ranges are drawn from a sample, so that partitions are about as large; a part is so many rows of a partition, in order
    at = F.monotonically_increasing_id()
    part = (F.shiftleft(F.shiftright(at, 33), 33) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / part_ids)).cast("long")
    placed = keyed.repartitionByRange(*key, "__id").sortWithinPartitions(*key, "__id").withColumn("__part", part)
    texts = placed.groupBy(*key, "__part").agg(F.concat(F.lit("|"), F.array_join(F.array_sort(F.collect_list("__id")), "|")).alias("__text"))
    texts = checkpointed(texts.withColumn("__row", F.monotonically_increasing_id()))
    plain = texts.agg(F.bool_and(F.octet_length("__text") == F.length("__text"))).first()[0]
    if plain is None:
        empty = rows.sparkSession.createDataFrame([(f"{hashing.FNV_START:x}",)], "signature string")
        return named.limit(0).select(*group, F.lit("").alias("signature")) if group else empty
    bits = 7 if plain else 16
    parts, start = texts.withColumn("__low", F.lit(0).cast("long")), F.lit(BEFORE).cast("long")
    for known in range(0, bits, STEP):
        told = texts.select(*key, "__part", "__row").join(_ends(parts, known, bits), "__row")
        chain = F.array_sort(F.collect_list(F.struct("__part", "__row", "power", "ends")))
        chains = told.groupBy(*key).agg(chain.alias("__chain"))  # a few numbers for each part
        if known + STEP >= bits:
            break
        seen = F.array().cast("array<struct<row:bigint,state:bigint>>")

        def step(a: Column, p: Column) -> Column:
            return F.struct(_next(a["state"], p, known).alias("state"), F.concat(a["seen"], F.array(F.struct(p["__row"].alias("row"), a["state"].alias("state")))).alias("seen"))

        walked = chains.select(F.explode(F.aggregate("__chain", F.struct(start.alias("state"), seen.alias("seen")), step)["seen"]).alias("s"))
        low = checkpointed(walked.select(F.col("s.row").alias("__row"), F.col("s.state").bitwiseAND(F.lit((1 << (known + STEP)) - 1).cast("long")).alias("__low")))
        parts = texts.join(low, "__row")
    state = F.aggregate("__chain", start, lambda h, p: _next(h, p, known))
    return checkpointed(chains.select(*(F.col(k)[g].alias(g) for g, k in zip(group, key, strict=False)), F.lower(F.hex(state)).alias("signature")))
