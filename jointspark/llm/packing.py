"""Packing documents into sequences of fixed capacity by cutting-stock column generation.

Each document's ids are cut into full pieces, which are sequences by themselves, and one remainder.
Remainders are counted by length class (their length rounded up to ``UNIT`` ids); that histogram, of
at most capacity / UNIT numbers, is all that reaches the driver.  There a linear program over packing
patterns is solved by column generation: a knapsack dynamic program over the dual prices finds each
new pattern.  Patterns are rounded down, the few remainders left over are packed by first fit, and
every remainder gets its sequence from its rank in its class.  Ranks come from counts per class and
partition, never from a global sort, and offsets are summed inside a sequence from true lengths.

A null or empty text is its end id alone.  Repeated rows are packed each on their own, ties of length in any order;
null ids stay null; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

CAPACITY = 1024
#: Lengths are rounded up to so many ids in the linear program.
UNIT = 8
END = 0
#: The byte-level splitting rule.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelIds:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    A file whose tokens are numbered in the order of their merges, with no other step, is the same as a
    table of ranks; such a file is encoded from the table by tiktoken, which needs no memory between
    texts.  Any other file is left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = None
        if self._is_table(spec):
            import tiktoken

            printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
            ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _is_table(spec: dict) -> bool:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return bool(plain) and merged == sorted(set(merged)) and merged[:1] >= [256]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.fast is None:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        return [self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() for t in texts]


_workers: dict[str, ByteLevelIds] = {}


@dataclass
class Plan:
    """Patterns in use: how many sequences of each, and each pattern's pieces per class."""

    counts: np.ndarray
    patterns: np.ndarray


def _best_pattern(prices: np.ndarray, units: int) -> np.ndarray:
    """The pattern of greatest total price that fits, by unbounded knapsack; class k takes k + 1 units."""
    value, took = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        gain = value[room - 1 :: -1][: len(prices)] + prices[:room]
        k = int(gain.argmax())
        if gain[k] > value[room - 1] + 1e-12:
            value[room], took[room] = gain[k], k + 1
        else:
            value[room] = value[room - 1]
    out, room = np.zeros(len(prices), np.int64), units
    while room > 0:
        if took[room]:
            out[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return out


def plan(demand: np.ndarray, gap: float = 1e-3, most: int = 4000) -> Plan:
    """Integer patterns that cover ``demand``, pieces per class of one to len(demand) units, exactly."""
    units = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return Plan(np.zeros(0, np.int64), np.zeros((0, units), np.int64))
    copies = units // (used + 1)
    columns = np.zeros((len(used), units), np.int64)
    columns[np.arange(len(used)), used] = copies
    inverse = np.diag(1.0 / copies)
    x = demand[used] / copies
    for _ in range(most):
        duals = np.ones(len(used)) @ inverse
        prices = np.zeros(units)
        prices[used] = np.maximum(duals, 0)
        pattern = _best_pattern(prices, units)
        worth = float(pattern @ prices)
        # Farley's bound: the optimum is at least the present value over the best pattern's worth.
        if worth <= 1 + gap:
            break
        direction = inverse @ pattern[used]
        ratio = np.where(direction > 1e-10, x / np.where(direction > 1e-10, direction, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        columns[leave] = pattern
    counts = np.floor(x + 1e-9).astype(np.int64)
    left = demand - counts @ columns
    # Rounding noise must not pack what is not there.
    while (left < 0).any():
        over = int(np.flatnonzero(left < 0)[0])
        give = int(np.flatnonzero((counts > 0) & (columns[:, over] > 0))[0])
        counts[give] -= 1
        left = demand - counts @ columns
    kept = counts > 0
    counts, columns = list(counts[kept]), list(columns[kept])
    while left.any():
        pattern, room = np.zeros(units, np.int64), units
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // (k + 1))
            pattern[k] += n
            room -= n * (k + 1)
        repeat = int((left[pattern > 0] // pattern[pattern > 0]).min())
        counts.append(repeat)
        columns.append(pattern)
        left = left - repeat * pattern
    return Plan(np.array(counts, np.int64), np.array(columns, np.int64))


def _piece_rows(vocabulary: str, capacity: int, unit: int):
    def run(batches):
        worker = _workers.get(vocabulary) or _workers.setdefault(vocabulary, ByteLevelIds(vocabulary))
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                rows = []
                for source, tokens in zip(ids[at : at + 256], worker.encode([t or "" for t in texts[at : at + 256].to_pylist()]), strict=True):
                    tokens += end
                    total = len(tokens) // 4
                    for start in range(0, total, capacity):
                        piece = tokens[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        kind = -(-length // unit) if length < capacity else 0
                        rows.append((source, start, length, zlib.crc32(piece), total, kind, int(seen[kind]), part))
                        seen[kind] += 1
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 8)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), *columns], names=["id", "start", "length", "ids_crc32", "doc_tokens", "kind", "local", "part"])

    return run


def _placed(found: Plan, fulls: int, units: int):
    """Sequence and slot of each piece from its class and rank."""
    begins = fulls + np.concatenate([[0], np.cumsum(found.counts)])[:-1]
    tables = {}
    for kind in range(1, units + 1):
        per = found.patterns[:, kind - 1] if len(found.patterns) else np.zeros(0, np.int64)
        which = np.flatnonzero(per)
        tables[kind] = (per[which], np.concatenate([[0], np.cumsum(per[which] * found.counts[which])]), begins[which])

    def run(batches):
        for batch in batches:
            kind, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = rank.copy(), np.zeros(len(rank), np.int64)
            for k in np.unique(kind[kind > 0]):
                rows = np.flatnonzero(kind == k)
                per, reach, begin = tables[k]
                at = np.searchsorted(reach, rank[rows], "right") - 1
                sequence[rows] = begin[at] + (rank[rows] - reach[at]) // per[at]
                slot[rows] = (units + 1 - k) * (units + 1) + (rank[rows] - reach[at]) % per[at]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())], names=[*names, "sequence_id", "slot"])

    return run


def packed(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    ws = Workspace(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = ws.save(source.mapInArrow(_piece_rows(vocabulary, capacity, unit), f"{columns}, kind long, local long, part long"), "pieces")
    by_part = ws.save(cut.groupBy("kind", "part").agg(F.count("*").alias("n")), "counts")
    units = capacity // unit
    demand = np.zeros(units + 1, np.int64)
    for row in by_part.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most units + 1 rows
        demand[row["kind"]] = row["n"]
    found = plan(demand[1:])
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("kind", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["kind", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.mapInArrow(_placed(found, int(demand[0]), units), f"{columns}, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("slot")
    return offsets.withColumnRenamed("id", id_column)
