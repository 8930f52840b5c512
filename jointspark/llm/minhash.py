"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Each text becomes a set of word shingles, a set digest and a signature of ``K`` minima.  Texts
   with one set are one node from here on.
2. Nodes are posted under their signature's coordinate values.  A pair at the similarity sought
   agrees in at least T coordinates except with probability up to ``MISS`` (binomial tail of K=32;
   T=16 for 85 percent).  Such a pair shares one of each node's ``K-T+1`` rarest values, so only these
   are merged (prefix); the T-1 most frequent are skipped and only probed in the signatures.  Values
   held by one node are dropped, and so are nodes with under T shared values.
3. The collisions of a posting list are counted against T.  What leaves a list is a spanning forest of
   its matches, and a list whose nodes are connected is done: rows grow with a group, not its square.
4. The groups so connected are confirmed the same way on full sets, by exact intersection counts; the
   confirmed links' components are the result.

Steps 3 and 4 treat a hot list or group alike (:func:`_linked`).  It is dealt into blocks of bounded
size, each of which is linked inside; its members are then contracted to components, and only members
outside the largest one, the stragglers, still meet all others, block by block.  Two members never
meet only if they are in one component already, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import block_components, components
from .store import Workspace
from .words import U64, mix, pieces, window_hashes, window_starts, word_hashes

K = 32
#: Most probable loss of a pair at the similarity sought.
MISS = 1e-6
_MULTIPLIERS = np.random.Generator(np.random.PCG64(85)).integers(1, 1 << 62, K, dtype=np.uint64) * U64(2) + U64(1)
#: Nodes of a posting list's block, and of one in which stragglers meet the others.
_ROWS, _WIDE_ROWS = 512, 4096
#: Shingles, and members, of a block in the confirming step.
_WEIGHT, _MEMBERS = 200_000, 512


def agreeing(percent: int) -> int:
    """The most coordinates of K that a pair of ``percent`` similarity agrees in, except with probability up to MISS."""
    p, missed, t = percent / 100, 0.0, 0
    while t < K:
        missed += math.comb(K, t) * p**t * (1 - p) ** (K - t)
        if missed > MISS:
            break
        t += 1
    if not t or not 0 < percent <= 100:
        raise ValueError(f"{K} minima do not find pairs of {percent} percent similarity")
    return t


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); a text of fewer words is one shingle, one without words none."""
    for lo, hi, data, offsets in pieces(texts):
        words, _, _, first = word_hashes(data, offsets, lower=True)
        starts, at = window_starts(first, width)
        hashes = window_hashes(words, starts, width)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                own = hashes[at[i] : at[i + 1]].copy()
                own.sort()
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield lo + i, own[keep]
            elif b > a:
                short = words[a:b]
                yield lo + i, mix(np.array([(short * _MULTIPLIERS[: b - a]).sum() + U64(b - a)], np.uint64))
            else:
                yield lo + i, words[:0]


def _signed(width: int):
    def run(batches):
        for batch in batches:
            size, digest, signature = [], [], []
            for _, own in shingle_sets(batch.column(1), width):
                size.append(len(own))
                if not len(own):
                    digest.append(None)
                    signature.append(None)
                    continue
                digest.append(np.array([mix(own).sum(), mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum() ^ U64(len(own))], np.uint64).tobytes())
                low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(own), 4096):
                    np.minimum(low, (own[at : at + 4096, None] * _MULTIPLIERS).min(axis=0), out=low)
                signature.append(low.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "signature"],
            )

    return run


_KEY = ("grp", "block", "part")


def _grouped(batches, forest):
    """Applies ``forest`` to tables of whole groups; rows come with equal keys adjacent."""
    held: list[pa.Table] = []

    def keys(t: pa.Table) -> list[np.ndarray]:
        return [t.column(c).to_numpy() for c in _KEY]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        key = keys(table)
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        ready = None
        if held and any(k[0] != h[0] for k, h in zip(key, keys(held[0].slice(0, 1)), strict=True)):
            ready, held = pa.concat_tables(held + ([table.slice(0, cut)] if cut else [])), []
        elif cut:
            ready, held = pa.concat_tables([*held, table.slice(0, cut)]), []
        held.append(table.slice(cut))
        if ready is not None and (out := forest(ready.combine_chunks())) is not None:
            yield out
    if held and (out := forest(pa.concat_tables(held).combine_chunks())) is not None:
        yield out


def _tied(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch | None:
    """Spanning forest of links between rows, each row tied to the smallest id it reaches; rows are sorted by id inside a group."""
    label = block_components(len(ids), left, right)
    tied = np.flatnonzero(ids[label] != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["a", "b"]) if len(tied) else None


def _matches(least: int):
    """Of grouped nodes with signatures: a forest of those that agree in ``least`` coordinates.

    Rows with ``asks`` are stragglers, which meet the other rows of other components; without any, all meet.
    """

    def forest(table: pa.Table):
        n = table.num_rows
        ids, component, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "asks"))
        signature = np.asarray(table.column("signature").combine_chunks().flatten().to_numpy()).reshape(n, K)
        key = [table.column(c).to_numpy() for c in _KEY]
        begin = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
        until = np.append(begin[1:], n)
        left, right = [], []
        some = np.logical_or.reduceat(asks, begin)
        end = np.repeat(np.where(some, begin, until), until - begin)
        rows, d = np.arange(n), 1
        while True:
            rows = rows[rows + d < end[rows]]
            if not len(rows):
                break
            for at in range(0, len(rows), 16384):
                part = rows[at : at + 16384]
                hit = part[(signature[part] == signature[part + d]).sum(axis=1) >= least]
                left.append(hit)
                right.append(hit + d)
            d += 1
        for a, b in zip(begin[some], until[some], strict=True):
            home = a + np.flatnonzero(~asks[a:b])
            for row in a + np.flatnonzero(asks[a:b]):
                other = home[component[home] != component[row]]
                hit = other[(signature[other] == signature[row]).sum(axis=1) >= least]
                left.append(np.full(len(hit), row))
                right.append(hit)
        return _tied(ids, np.concatenate(left), np.concatenate(right)) if left else None

    return lambda batches: _grouped(batches, forest)


def _linked(members: DataFrame, nodes: DataFrame, match, most: str, wide: str, ws: Workspace, name: str) -> DataFrame:
    """Components (id, component) of the links that ``match`` finds inside the groups of ``members(grp, id, weight)``.

    ``nodes(id, ..)`` has what ``match`` reads.  ``most`` and ``wide`` are SQL for the number of blocks of a group of
    ``n`` rows and ``weight``, in the first deal and where stragglers meet the others.
    """
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where("n > 1")
    sizes = ws.save(sizes.select("grp", F.expr(f"cast({most} as int)").alias("blocks")), name + "-sizes")

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.join(nodes, "id").repartition(*_KEY).sortWithinPartitions(*_KEY, "id")
        return rows.mapInArrow(match, "a long, b long")

    # A member has another block in each of its groups, so that blocks of one hot group are connected through the others.
    block = F.expr("cast(pmod(xxhash64(id, grp), blocks) as int)")
    dealt = members.join(sizes, "grp").select("grp", block.alias("block"), F.lit(0).alias("part"), "id", F.lit(0).cast("long").alias("component"), F.lit(False).alias("asks"))
    first = ws.save(met(dealt).distinct(), name + "-forest")
    known = components(first, ws)

    hot = sizes.where("blocks > 1").select("grp")
    at = members.join(hot, "grp").join(known, "id", "left").select("grp", "id", "weight", F.coalesce("component", "id").alias("component"))
    parts = ws.save(at.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), name + "-parts")
    held = parts.groupBy("grp").agg(F.count("*").alias("m"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.struct("n", "weight")).alias("top")).where("m > 1")
    asked = held.select("grp", "main", F.expr(f"cast({wide} as int)").alias("blocks"), F.expr("n - top.n").alias("n"), F.expr("weight - top.weight").alias("weight"))
    asked = ws.save(asked.select("grp", "main", "blocks", F.expr(f"cast({wide} as int)").alias("asking")), name + "-asked")
    if asked.isEmpty():
        ws.drop(sizes, first, parts, asked)
        return known
    left = at.join(asked, "grp")
    here = F.expr("cast(pmod(xxhash64(id, 1), blocks) as int)")
    home = left.withColumn("part", F.explode(F.expr("sequence(0, asking - 1)"))).select("grp", here.alias("block"), "part", "id", "component", F.lit(False).alias("asks"))
    part = F.expr("cast(pmod(xxhash64(id, 2), asking) as int)")
    asks = left.where("component <> main").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("grp", "block", part.alias("part"), "id", "component", F.lit(True).alias("asks"))
    more = met(home.union(asks)).distinct()
    # A component's own links are known: its members need only its id.
    whole = components(ws.save(more.union(known.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))), name + "-more"), ws)
    ws.drop(sizes, first, parts, asked)
    return whole


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [own.view(np.int64) for _, own in shingle_sets(batch.column("text"), width)]
            keep = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep if c != "text"), pa.array(sets, pa.list_(pa.int64()))], names=[*(c for c in keep if c != "text"), "shingles"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections inside one bounded block."""
    n = len(sets)
    counts = np.zeros((n, n), np.float64)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), sizes)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    keep = often[column] > 1
    row, column = row[keep], shared[column[keep]]
    width = max(1, (1 << 22) // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        counts += dense @ dense.T
    counts[np.arange(n), np.arange(n)] = sizes
    return counts.astype(np.int64)


def _confirmed(percent: int):
    """Of grouped nodes with shingles: a forest of the exact links; stragglers as in :func:`_matches`."""

    def one(ids, component, asks, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        common = intersections(sets)
        linked = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
        if asks.any():
            linked &= (asks[:, None] != asks[None, :]) & (component[:, None] != component[None, :])
        return np.nonzero(linked)

    def forest(table: pa.Table):
        ids, component, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "asks"))
        column = table.column("shingles").combine_chunks()
        values, offsets = np.asarray(column.values.to_numpy()), np.asarray(column.offsets.to_numpy())
        key = [table.column(c).to_numpy() for c in _KEY]
        begin = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
        left, right = [], []
        for a, b in zip(begin, np.append(begin[1:], len(ids)), strict=True):
            x, y = one(ids[a:b], component[a:b], asks[a:b], [values[i:j] for i, j in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)])
            left.append(x + a)
            right.append(y + a)
        return _tied(ids, np.concatenate(left), np.concatenate(right))

    return lambda batches: _grouped(batches, forest)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(id column, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked where 100 * intersection >= percent * union of their shingle sets; a
    component's id is its smallest member.  Null and wordless texts have no shingles and no link.
    Rows that repeat an id count as one document with several texts, linked by their id.  Rows with
    a null id are returned unlinked, with a null component and kept.  Other columns are ignored.
    A ``percent`` that K minima cannot serve within MISS (under 36) is rejected.
    """
    spark, least = docs.sparkSession, agreeing(percent)
    ws = Workspace(spark)
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = ws.save(source.mapInArrow(_signed(width), "id long, n_shingles long, digest binary, signature array<long>"), "signed")
    nodes = ws.save(
        signed.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")),
        "nodes",
    )
    tokens = nodes.select("rep", F.explode("signature").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ranked")).where(F.size("ranked") >= least)
    posted = ws.save(ranked.select("rep", F.explode(F.expr(f"slice(ranked, 1, size(ranked) - {least - 1})").getField("token")).alias("token")), "posted")
    members = posted.select(F.col("token").alias("grp"), F.col("rep").alias("id"), F.lit(1).cast("long").alias("weight"))
    rows = "ceil(n / {})"
    grouped = _linked(members, nodes.select(F.col("rep").alias("id"), "signature"), _matches(least), rows.format(_ROWS), rows.format(_WIDE_ROWS), ws, "lists")

    members = ws.save(grouped.join(nodes.select(F.col("rep").alias("id"), F.col("n").alias("weight")), "id").select(F.col("component").alias("grp"), "id", "weight"), "members")
    sets = ws.save(source.join(members.select("id"), "id").mapInArrow(_sets(width), "id long, shingles array<long>"), "sets")
    blocks = f"ceil(greatest(weight / {_WEIGHT}, n / {_MEMBERS}))"
    final = _linked(members, sets, _confirmed(percent), blocks, blocks, ws, "sets")
    ws.drop(posted, grouped, members, sets)

    owner = nodes.select("digest", "rep").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("id", "n_shingles", "digest").join(owner, "digest", "left")
    joined = joined.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return joined.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
