"""Text scoring by a probabilistic suffix tree over words.

Symbols are lower-cased words and one end per text.  The root is the discounted distribution of all
symbols.  A context of up to ``DEPTH`` symbols is a candidate if the training texts hold it ``least``
times, an absolute number from a small corpus on, so that the tree grows with the corpus.  It is
retained if its next-symbol counts diverge from those that its longest retained suffix predicts, by a
likelihood-ratio test.  A token is scored in the state of its longest retained suffix, whose
distribution is smoothed by that of the next shorter one.

Neither words nor tree are bounded, so no task and no driver holds them.  Texts are dealt once into blocks,
which keep their tokens as numbers of the block's own words.  A block sends its distinct keys, sorted, in parts by
their range, each part as one compressed string, and gets numbers in the same order back: first how often the training
texts hold a word, then level by level how often they hold a gram of one to DEPTH + 1 symbols (a context of d symbols with
its next is also a context of d + 1), and whether a context is retained.  A gram is asked for only if its context and its suffix occur
often enough, which the block knows from the level before.  One block of those that ask for a gram reports it to its
context, so that each context is tested over all its next symbols.  A frequent context is a row of each
block, not of each occurrence.  In the end a block has what its tokens' probabilities need; the tree is nowhere gathered.

A null text is empty: its one token is the end.  Rows with a null id are training rows.  Repeated
rows count and are scored each on their own.  An empty table gives an empty one; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .words import U64, pieces, window_hashes, word_hashes

DEPTH = 3
#: Least share of the training tokens that a context has in a corpus too small for LEAST.
P_MIN = 1e-4
#: Least share of the training tokens that a next symbol has in a corpus too small for LISTED.
Q_MIN = 1e-6
#: Occurrences that admit a context at any size of corpus.
LEAST = 8
#: Occurrences that list a next symbol under a context at any size of corpus.
LISTED = 2
#: Strength of smoothing: tokens' worth of the shorter context's distribution.
STRENGTH = 4.0
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Tokens for each part that keys are dealt into.
PART_TOKENS = 2 << 20
#: Questions are answered in so many rounds, each with a share of the parts; in a small corpus only those about pairs of symbols.
ROUNDS = 3
#: Blocks take their answers in so many turns, which bounds what is shuffled at once; 2**32 % TURNS is 1, so that a task's blocks fall into all.
TURNS = 3
#: Without effect: grams are thinned by exact counts, not by a filter. Kept as a test sets it.
FILTER_MOST = 1 << 29
_END = U64(0x454E44)
_BITS = 15


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes of all rows, each row's end included, and each row's first token."""
    words, _, _, first = word_hashes(data, offsets, lower=True)
    rows = len(offsets) - 1
    out = np.empty(len(words) + rows, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(first))] = words
    out[first[1:] + np.arange(rows)] = _END
    return out, first + np.arange(rows + 1)


@dataclass
class Tree:
    """Totals of the training tokens and the root's distribution.

    ``symbols`` and ``levels`` hold a small tree in memory by ids; a corpus' levels are with its blocks (:class:`_Block`).
    """

    tokens: int = 0
    types: int = 0
    discount: float = 0.5
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Per depth: context keys, counts, counts of unlisted nexts, entry keys, entry counts.
    levels: list = field(default_factory=list)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for a symbol that contexts know, else 0."""
        if not len(self.symbols):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.symbols, hashes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == hashes, at + 1, 0)

    @staticmethod
    def contexts(ids: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
        """Key of the ``depth`` symbols before each token; -1 across a text's start or over an unknown symbol."""
        key, ok = np.zeros(len(ids), np.int64), np.arange(len(ids)) - begin >= depth
        for k in range(1, depth + 1):
            earlier = np.zeros(len(ids), np.int64)
            earlier[k:] = ids[:-k]
            key |= earlier << (_BITS * (k - 1))
            ok &= earlier > 0
        return np.where(ok, key, -1)

    def root(self, counts: np.ndarray) -> np.ndarray:
        n = max(self.tokens, 1)
        unknown = self.discount * self.types / n if self.tokens else 1.0
        return np.where(counts > 0, (counts - self.discount) / n, unknown)

    def probabilities(self, hashes: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p, ids = self.root(counts), self.ids(hashes)
        for depth, (keys, total, rest, entries, entry_counts) in enumerate(self.levels, 1):
            if not len(keys):
                continue
            context = self.contexts(ids, begin, depth)
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            rows = np.flatnonzero(keys[at] == context)
            at = at[rows]
            entry = (at << _BITS) | ids[rows]
            j = np.minimum(np.searchsorted(entries, entry), max(len(entries) - 1, 0))
            n = np.where((entries[j] == entry) & (ids[rows] > 0), entry_counts[j], 0) if len(entries) else np.zeros(len(rows))
            p[rows] = (n + (STRENGTH + rest[at]) * p[rows]) / (total[at] + STRENGTH)
        return p

    def extend(self, keys: np.ndarray, nexts: np.ndarray, n: np.ndarray, symbol_counts: np.ndarray) -> None:
        """Adds one depth from (context, next id or 0, count) rows: the contexts that diverge from their suffix."""
        depth = len(self.levels) + 1
        order = np.lexsort((nexts, keys))
        keys, nexts, n = keys[order], nexts[order], n[order].astype(np.float64)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n)
        listed = (nexts > 0) & (n >= Q_MIN * self.tokens)
        # What the longest retained suffix predicts, for listed nexts; the rest is one class.
        p = np.where(nexts > 0, self.root(symbol_counts[np.maximum(nexts, 1) - 1]), 1.0)
        for d, (known, all_, rest, entries, counts) in enumerate(self.levels, 1):
            if not len(known):
                continue
            suffix = keys & ((1 << (_BITS * d)) - 1)
            at = np.minimum(np.searchsorted(known, suffix), len(known) - 1)
            hit = known[at] == suffix
            entry = (at << _BITS) | nexts
            j = np.minimum(np.searchsorted(entries, entry), max(len(entries) - 1, 0))
            m = np.where(entries[j] == entry, counts[j], 0) if len(entries) else np.zeros(len(keys))
            p = np.where(hit, (m + (STRENGTH + rest[at]) * p) / (all_[at] + STRENGTH), p)
        share = np.bincount(inverse, np.where(listed, p, 0))
        seen = np.bincount(inverse, np.where(listed, n, 0))
        gain = np.bincount(inverse, np.where(listed, n * np.log(n / (total[inverse] * p)), 0))
        other = np.maximum(total - seen, 0)
        gain += np.where(other > 0, other * np.log(np.maximum(other, 1e-9) / (total * np.maximum(1 - share, 1e-9))), 0)
        freedom = np.bincount(inverse, listed).astype(np.float64)
        keep = (2 * gain > freedom + 4 * np.sqrt(2 * np.maximum(freedom, 1)) + 4) & (total >= P_MIN * self.tokens)
        new = np.cumsum(keep) - 1
        chosen = keep[inverse] & listed
        entries = (new[inverse[chosen]] << _BITS) | nexts[chosen]
        self.levels.append((unique[keep], total[keep], other[keep], entries, n[chosen]))
        assert depth == len(self.levels)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits by planes of bytes, without those that are 0 everywhere."""
    x = np.ascontiguousarray(x if x.dtype.itemsize == 8 else x.astype(np.int64)).view(np.uint64)
    width = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data, kind=np.int64) -> np.ndarray:
    data = memoryview(data)
    n, width = struct.unpack("<QB", data[:9])
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[9:], n * width), np.uint8).reshape(width, n) if n * width else ()
    out = np.zeros((n, 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.reshape(-1).view(kind)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a row of each, and each row's place among them."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


def _before(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


@dataclass
class _Model:
    """What all blocks know of the tree."""

    tree: Tree
    parts: int
    least: float = 0.0
    listed: float = 0.0


class _Block:
    """Texts' tokens and what is known of them.

    ``state`` only grows: lengths of texts, which of them are held out, words, tokens as places of words, training counts of words in
    the block and in all texts; then for each level the counts of the grams that end at each token (0: too rare to matter) and 1 +
    unlisted count of the contexts before it (0: not retained), the latter by word at the first level.
    """

    def __init__(self, state: list[np.ndarray], model: _Model):
        self.state, self.model = state, model
        self.lengths, self.held, words, self.stream = state[:4]
        self.words, self.counts = words.view(np.uint64), state[4:6][-1]
        self.tokens = self.words[self.stream]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.stream)) - np.repeat(self.first, self.lengths)

    def occurrences(self, length: int) -> np.ndarray:
        """Counts of the grams of ``length`` symbols that end at each token."""
        return self.counts[self.stream] if length == 1 else self.state[2 * length + 2]

    def under(self, depth: int) -> np.ndarray:
        """Whether the ``depth`` symbols before a token may be a context."""
        return (self.at >= depth) & (_before(self.occurrences(depth)) >= self.model.least)

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that have a candidate context, its keys and each token's place among them."""
        rows = np.flatnonzero(self.under(depth))
        if depth > 1:
            keys, _, place = _distinct(window_hashes(self.tokens, rows - depth, depth))
            return rows, keys, place
        order = np.argsort(self.words)
        found = np.bincount(self.stream[rows - 1], minlength=len(self.words))[order] > 0
        place = np.empty(len(self.words), np.int64)
        place[order] = np.cumsum(found) - 1
        return rows, self.words[order][found], place[self.stream[rows - 1]]

    def grams(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose gram of ``depth`` + 1 symbols may be listed, the grams' keys, a token of each and each token's place."""
        rows = np.flatnonzero(self.under(depth) & (self.occurrences(depth) >= self.model.listed))
        keys, at, place = _distinct(window_hashes(self.tokens, rows - depth, depth + 1))
        return rows, keys, rows[at], place

    def probabilities(self) -> np.ndarray:
        p = self.model.tree.root(self.counts)[self.stream]
        for depth in range(1, (len(self.state) - 6) // 2 + 1):
            n, rest = self.state[2 * depth + 4 : 2 * depth + 6]
            if depth == 1:
                rest = np.where(self.under(1), _before(rest[self.stream]), 0)
            rows = np.flatnonzero(rest)
            seen = np.where(n[rows] >= self.model.listed, n[rows], 0)
            p[rows] = (seen + (STRENGTH + rest[rows] - 1) * p[rows]) / (self.occurrences(depth)[rows - 1] + STRENGTH)
        return p

    def ask_words(self):
        order = np.argsort(self.words)
        return self.words[order], [self.counts[order]]

    def take_words(self, answer: np.ndarray) -> None:
        counts = np.empty(len(self.words), np.int64)
        counts[np.argsort(self.words)] = answer >> 1
        self.counts = counts
        self.state.append(counts)

    def ask_grams(self, depth: int):
        rows, keys, _, place = self.grams(depth)
        train = np.repeat(self.held == 0, self.lengths)[rows]
        return keys, [np.bincount(place[train], minlength=len(keys))]

    def take_grams(self, depth: int, answer: np.ndarray):
        """What is asked of the contexts then: totals, and sums over the next symbols that this block reports."""
        rows, keys, at, place = self.grams(depth)
        p = self.probabilities()
        n = answer >> 1
        counts = np.zeros(len(self.stream), np.int64)
        counts[rows] = n[place]
        under, contexts, context = self.contexts(depth)
        total = np.zeros(len(contexts), np.int64)
        total[context] = self.occurrences(depth)[under - 1]
        of = np.zeros(len(self.stream), np.int64)
        of[under] = context
        told = (answer & 1 > 0) & (n >= self.model.listed)
        n, p, of = n[told], p[at[told]], of[at[told]]
        sums = [np.bincount(of, w, len(contexts)) for w in (n, None, p, n * np.log(n / p))]
        self.state.append(counts)
        return contexts, [total, sums[0].astype(np.int64), sums[1], sums[2], sums[3]]

    def take_contexts(self, depth: int, answer: np.ndarray) -> None:
        rows, _, place = self.contexts(depth)
        rest = np.zeros(len(self.words if depth == 1 else self.stream), np.int64)
        rest[self.stream[rows - 1] if depth == 1 else rows] = answer[place]
        self.state.append(rest)


_BLOBS = pa.list_(pa.binary())
_ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("data", _BLOBS)])
_COLUMNS = "kind int, block long, part int, data array<binary>"


def _asked(block: int, parts: int, keys: np.ndarray, values: list[np.ndarray]):
    """Rows of what a block asks: for each part the differences of its sorted keys, and their values."""
    part = ((keys >> U64(32)) * U64(parts)) >> U64(32)
    cuts = np.append(np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)), len(keys))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield dict(kind=1, block=block, part=int(part[lo]), data=[_packed(np.append(keys[lo], np.diff(keys[lo:hi]))), *(_packed(v[lo:hi]) for v in values)])


def _encoded(id_type: pa.DataType):
    """Blocks of texts: ids, tokens and words, whose counts are those of the block's training texts."""

    def block(number, held):
        tokens, lengths, ids, out = (np.concatenate(x) if k != 2 else pa.chunked_array(x).combine_chunks() for k, x in enumerate(zip(*held, strict=True)))
        words, _, place = _distinct(tokens)
        order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        stream = rank[place]
        counts = np.bincount(stream[np.repeat(~out, lengths)], minlength=len(words))
        state = [_packed(x) for x in (lengths, out.astype(np.int64), words[order], stream, counts)]
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([state], _BLOBS), _long(np.array([len(tokens)]))], names=["block", "ids", "data", "tokens"])

    def run(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            out = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            ids = batch.column("id").cast(id_type)
            for lo, hi, data, offsets in pieces(batch.column("text")):
                tokens, first = _tokens(data, offsets)
                held.append((tokens, np.diff(first), ids[lo:hi], out[lo:hi]))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield block(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield block(number, held)

    return run


def _words_asked(model: _Model):
    def run(batches):
        for batch in batches:
            for k, number in enumerate(batch.column("block").to_pylist()):
                block = _Block([_unpacked(b.as_buffer()) for b in batch.column("data")[k]], model)
                yield pa.RecordBatch.from_pylist([*_asked(number, model.parts, *block.ask_words())], _ROWS)

    return run


def _by_block(rows: pa.Table, columns: range):
    """Sorted by block, a part's keys, the given values and where each block's end."""
    rows = rows.sort_by("block")
    asks = [[b.as_buffer() for b in ask] for ask in rows.column("data")]
    keys = [np.cumsum(_unpacked(ask[0], np.uint64), dtype=np.uint64) for ask in asks]
    values = [np.concatenate([_unpacked(ask[k], kind) for ask in asks]) for k, kind in columns]
    return rows, np.concatenate(keys), values, np.cumsum([len(k) for k in keys])[:-1]


def _counted(rows: pa.Table) -> pa.Table:
    """For each key its training count, twice, and 1 more for the block that reports it; the sum, keys, ones and twos of all counts."""
    rows, keys, (n,), cuts = _by_block(rows, [(1, np.int64)])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(order)]
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    answer = np.empty(len(keys), np.int64)
    answer[order] = 2 * total[np.cumsum(new) - 1] + new
    sums = np.zeros((4, len(rows)), np.int64)
    sums[:, 0] = total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()
    return pa.table([rows["block"], rows["part"], pa.array([_packed(a) for a in np.split(answer, cuts)], pa.binary()), *map(_long, sums)], names=["block", "part", "answer", "tokens", "types", "once", "twice"])


def _tested(rows: pa.Table) -> pa.Table:
    """For each context 1 + its unlisted count if its next symbols diverge from what its suffix predicts, else 0."""
    rows, keys, values, cuts = _by_block(rows, [*((k, np.int64) for k in (1, 2, 3)), *((k, np.float64) for k in (4, 5))])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(order)]
    first = np.flatnonzero(new)
    total = values[0][order][first]
    seen, freedom, share, gain = (np.add.reduceat(v[order], first) for v in values[1:])
    rest = total - seen
    gain = gain - seen * np.log(total) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (total * np.maximum(1 - share, 1e-9))), 0)
    kept = (freedom > 0) & (2 * gain > freedom + 4 * np.sqrt(2 * freedom) + 4)
    answer = np.empty(len(keys), np.int64)
    answer[order] = np.where(kept, rest + 1, 0)[np.cumsum(new) - 1]
    return pa.table([rows["block"], rows["part"], pa.array([_packed(a) for a in np.split(answer, cuts)], pa.binary())], names=["block", "part", "answer"])


def _read(texts: pa.Table, answers: pa.Table, model: _Model) -> tuple[_Block, np.ndarray]:
    block = _Block([_unpacked(b.as_buffer()) for data in texts.sort_by("step").column("data") for b in data], model)
    found = [_unpacked(a.as_buffer()) for a in answers.sort_by("part").column("answer")]
    return block, np.concatenate(found) if found else np.zeros(0, np.int64)


def _after_words(block: _Block, answer: np.ndarray):
    block.take_words(answer)
    return block.ask_grams(1)


def _after_grams(depth: int):
    def step(block: _Block, answer: np.ndarray):
        return block.take_grams(depth, answer)

    return step


def _after_contexts(depth: int):
    def step(block: _Block, answer: np.ndarray):
        block.take_contexts(depth, answer)
        return block.ask_grams(depth + 1)

    return step


def _after_last(block: _Block, answer: np.ndarray) -> None:
    block.take_contexts(DEPTH, answer)


def _stepped(model: _Model, step):
    """What a block adds to its state (kind 0), and what it asks next (kind 1)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, answer = _read(texts, answers, model)
        number, known = texts.column("block")[0].as_py(), len(block.state)
        asked = [*_asked(number, model.parts, *step(block, answer))]
        return pa.Table.from_pylist([dict(kind=0, block=number, part=None, data=[_packed(x) for x in block.state[known:]]), *asked], _ROWS)

    return run


def _scored(model: _Model, take, id_type: pa.DataType):
    floor = np.log10(float(model.tree.tokens + model.tree.types + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, answer = _read(texts, answers, model)
        take(block, answer)
        base, p = (np.log10(block.counts + 1.0) - floor)[block.stream], np.log10(block.probabilities())
        hit, base, score = (np.add.reduceat(x, block.first) for x in ((block.counts > 0)[block.stream].astype(np.int64), base, p))
        ids = texts.sort_by("step").column("ids").slice(0, 1).combine_chunks().flatten()
        return pa.table({"id": ids.cast(id_type), "held_out": pa.array(block.held > 0), "n_tokens": _long(block.lengths), "n_known": _long(hit), "train_tokens": _long(np.full(len(hit), model.tree.tokens)), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ws = Workspace(spark)
    kind = docs.schema[id_column].dataType
    id_type = to_arrow_type(kind)
    held_out = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), held_out.alias("held_out"))
    encoded = source.mapInArrow(_encoded(id_type), f"block long, ids array<{kind.simpleString()}>, data array<binary>, tokens long")
    parts = ws.split(encoded.withColumn("turn", F.expr(f"cast(block % {TURNS} as int)")), "texts", "turn", TURNS)
    texts = reduce(DataFrame.union, parts)
    size = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    model = _Model(Tree(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS)))
    states = [[t] for t in parts] if size > TURNS * PART_TOKENS else [[texts]]

    def answered(asks: DataFrame, of, extra: str = "", rounds: int = 1) -> list[DataFrame]:
        turns = [asks if rounds == 1 else asks.where(f"part % {rounds} = {k}") for k in range(rounds)]
        return [ws.save(turn.groupBy("part").applyInArrow(of, f"block long, part int, answer binary{extra}"), "answers") for turn in turns]

    def joined(turn: int, *more: str):
        rows = [t.select("block", F.lit(k).alias("step"), "data", *(c if c in t.columns else F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in more)) for k, t in enumerate(states[turn])]
        found = reduce(DataFrame.union, [a.select("block", "part", "answer") for a in answers])
        found = found if len(states) == 1 else found.where(f"block % {TURNS} = {turn}")
        return reduce(DataFrame.union, rows).groupBy("block").cogroup(found.groupBy("block"))

    sums = ", tokens long, types long, once long, twice long"
    answers = answered(texts.select("block", "data").mapInArrow(_words_asked(model), _COLUMNS), _counted, sums)
    tokens, types, once, twice = answers[0].agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    model.tree = Tree(int(tokens), int(types), min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9))
    model.least, model.listed = min(LEAST, max(2, P_MIN * tokens)), min(LISTED, max(1, Q_MIN * tokens))
    last = _Block.take_words
    if tokens:
        rounds = ROUNDS if len(states) > 1 else 1
        steps = [(_after_words, _counted, ROUNDS)]
        for depth in range(1, DEPTH + 1):
            steps.append((_after_grams(depth), _tested, rounds))
            if depth < DEPTH:
                steps.append((_after_contexts(depth), _counted, rounds))
        for step, of, n in steps:
            done = [ws.split(joined(k).applyInArrow(_stepped(model, step), _COLUMNS), "steps", "kind", 2) for k in range(len(states))]
            ws.drop(*answers)
            for state, (own, _) in zip(states, done, strict=True):
                state.append(own)
            asks = [a for _, a in done]
            answers = answered(reduce(DataFrame.union, asks), of, sums if of is _counted else "", n)
            ws.drop(*asks)
        last = _after_last
    columns = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = [ws.save(joined(k, "ids").applyInArrow(_scored(model, last, id_type), columns), "scores") for k in range(len(states))]
    ws.drop(*parts, *answers, *(t for state in states for t in state[1:]))
    return reduce(DataFrame.union, out).withColumnRenamed("id", id_column)
