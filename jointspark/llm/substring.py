"""Removal of repeated word spans by a compacted De Bruijn graph over token k-mers.

Every window of ``K`` words is an edge from its first K-1 words to its last.  An edge repeats if it
also starts in a document with a smaller id.  Reaching all repeated edges without shuffling all
edges takes three passes over the texts, which lie in one table bucketed by id so that a pass
shuffles only what joins it:

1. Content-defined chunks: paths of windows cut where the words themselves say so.  A chunk found in
   a smaller document is repeated as a whole, and the smallest one provides for all later copies,
   so from here on a copy's windows are neither looked up nor offered.
2. Minimisers: each remaining window names the least of its 5-word hashes.  A repeated window's
   minimiser occurs in two documents; others are dropped after an aggregation with map-side combine.
3. The windows left are aggregated to their least (document, position, check hash); a join brings
   these back.  A second hash at the source coordinates must agree, so a collision of the first one
   never removes words.

Edges and chunks are then links (document, position, windows, source, source position).  Links that advance
together through document and source are one nonbranching path, along which the sequence of words is the
same in both; :func:`_compacted` orders a path's links and aggregates them to one span.
The words that spans cover are removed, and :func:`repeated_spans` lists them.

A null text has no words; a row with a null id, or with fewer
than K words, keeps all of them; rows that share an id never remove one another's words, and each has spans of its
own text; repeated rows lose the same words.  An empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, shuffles_removed
from .words import _BASE, _INVERSE, U64, _power, mix, pieces, window_hashes, window_starts, word_hashes

K = 13
#: Words of the hashes that minimisers are taken from.
M = 5
#: A chunk ends, on average, after so many windows.
CHUNK = 64
#: Bytes of text of a bucket, from the size on at which the session's partitions are fewer.
BUCKET_BYTES = 32 << 20
_CHECK = U64(0xD6E8FEB86659FD93)


class _Paths:
    """Windows, chunks and minimisers of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words, _, _, self.first = word_hashes(data, offsets)
        self.starts, self.at = window_starts(self.first, K)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        self.position = self.starts - self.first[self.row] if len(self.starts) else self.starts

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and check hash of the chosen windows."""
        return window_hashes(self.words, self.starts[which], K), window_hashes(mix(self.words ^ _CHECK), self.starts[which], K)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window of every chunk, its hash and its check hash."""
        if not len(self.starts):
            return self.starts, self.words[:0], self.words[:0]
        cut = window_hashes(self.words, self.starts, 3) % U64(CHUNK) == 0
        cut[self.at[:-1][np.diff(self.at) > 0]] = True
        begin = np.flatnonzero(cut)
        last = np.append(begin[1:], len(cut)) - 1
        a, b = self.starts[begin], self.starts[last] + K

        def spans(words: np.ndarray) -> np.ndarray:
            total = np.concatenate([[U64(0)], np.cumsum(words * _power(_BASE, len(words)))])
            return mix((total[b] - total[a]) * _power(_INVERSE, len(words) + 1)[a] + (b - a).astype(np.uint64))

        return begin, spans(self.words), spans(mix(self.words ^ _CHECK))

    def minimisers(self) -> np.ndarray:
        """The least M-word hash of every window."""
        n = len(self.words) - M + 1
        if not len(self.starts):
            return self.words[:0]
        least = window_hashes(self.words, np.arange(n), M)
        for step in (1, 2, 4):
            least[:-step] = np.minimum(least[:-step], least[step:])
        return np.minimum(least[self.starts], least[self.starts + K - M - 7])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _listed(column, row: int) -> np.ndarray:
    value = column[row]
    return np.sort(np.array(value.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)) if value.is_valid else np.zeros(0, np.uint64)


def _slices(batch):
    for lo, hi, data, offsets in pieces(batch.column("text")):
        yield lo, hi, _Paths(data, offsets)


#: A window or chunk as it is looked up; ``key`` tells the texts of one id apart.
_LINK = ["hash", "id", "key", "position", "windows", "check"]
_LINKS = ", ".join(f"{c} long" for c in _LINK)


def _chunk_rows(batches):
    for batch in batches:
        ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
        for lo, _, paths in _slices(batch):
            begin, hashes, check = paths.chunks()
            row, size = lo + paths.row[begin], np.diff(np.append(begin, len(paths.starts)))
            yield pa.RecordBatch.from_arrays([_long(hashes), _long(ids[row]), _long(keys[row]), _long(paths.position[begin]), _long(size), _long(check)], names=_LINK)


def _fresh(batch, lo: int, hi: int, paths: _Paths) -> np.ndarray:
    """Whether each window lies in a chunk that no smaller document holds."""
    fresh = np.ones(len(paths.starts), bool)
    begin, hashes, _ = paths.chunks()
    end = np.append(begin[1:], len(fresh))
    column = batch.column("copied")
    bounds = np.searchsorted(paths.row[begin], np.arange(hi - lo + 1)) if len(begin) else np.zeros(hi - lo + 1, np.int64)
    for i in range(hi - lo):
        known = _listed(column, lo + i)
        if len(known) and bounds[i] < bounds[i + 1]:
            own = hashes[bounds[i] : bounds[i + 1]]
            hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            for j in np.flatnonzero(hit) + bounds[i]:
                fresh[begin[j] : end[j]] = False
    return fresh


def _anchor_rows(batches):
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for lo, hi, paths in _slices(batch):
            keep = np.flatnonzero(_fresh(batch, lo, hi, paths))
            least, row = paths.minimisers()[keep], paths.row[keep]
            if len(keep):
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
                yield pa.RecordBatch.from_arrays([_long(least[new]), _long(ids[lo + row[new]])], names=["hash", "id"])


def _window_rows(batches):
    for batch in batches:
        ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
        column = batch.column("anchors")
        for lo, hi, paths in _slices(batch):
            fresh, least = _fresh(batch, lo, hi, paths), paths.minimisers()
            for i in range(hi - lo):
                known = _listed(column, lo + i)
                a, b = paths.at[i], paths.at[i + 1]
                if len(known) and a < b:
                    own = least[a:b]
                    fresh[a:b] &= known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                else:
                    fresh[a:b] = False
            keep = np.flatnonzero(fresh)
            if len(keep):
                hashes, check = paths.windows(keep)
                row = lo + paths.row[keep]
                yield pa.RecordBatch.from_arrays([_long(hashes), _long(ids[row]), _long(keys[row]), _long(paths.position[keep]), _long(np.ones(len(keep))), _long(check)], names=_LINK)


def _repeats(rows: DataFrame) -> DataFrame:
    """Rows (hash, id, key, position, windows) whose hash also occurs under a smaller id, with their source's coordinates."""
    least = rows.groupBy("hash").agg(F.min(F.struct("id", "position", "check")).alias("least"), F.max("id").alias("most")).where("least.id < most").drop("most")
    found = rows.join(least, "hash").where("least.id < id and least.check = check")
    return found.select("hash", "id", "key", "position", "windows", F.col("least.id").alias("source"), F.col("least.position").alias("source_position"))


def _compacted(links: DataFrame) -> DataFrame:
    """(id, key, start, windows, source, source_start): one row for each maximal path of links that advance together."""
    path = ["id", "key", "source", "shift"]
    links = links.withColumn("shift", F.col("position") - F.col("source_position"))
    ordered = Window.partitionBy(*path).orderBy("position")
    behind = F.max(F.col("position") + F.col("windows")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = links.withColumn("_new", F.when(behind >= F.col("position"), 0).otherwise(1))
    marked = marked.withColumn("_path", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy(*path, "_path").agg(F.min("position").alias("start"), F.max(F.col("position") + F.col("windows")).alias("_end"), F.min("source_position").alias("source_start"))
    return spans.select("id", "key", "start", (F.col("_end") - F.col("start")).alias("windows"), "source", "source_start")


class _Search:
    """The bucketed texts and the links between repeated windows and chunks."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str):
        spark = docs.sparkSession
        self.ws = ws = Workspace(spark)
        source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key"))
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        name = f"texts_{uuid.uuid4().hex}"
        filled = source.where("id is not null")
        with shuffles_removed(spark):
            filled.repartition(n, "id").write.bucketBy(n, "id").sortBy("id").option("compression", "zstd").option("path", f"{ws.base}/texts").saveAsTable(name)
        atexit.register(_forgotten, spark, name)
        texts = spark.table(name)
        self.unnamed, self.texts = source.where("id is null"), texts

        chunks = ws.save(_repeats(texts.mapInArrow(_chunk_rows, _LINKS)), "chunks")
        copied = chunks.groupBy("id").agg(F.collect_set("hash").alias("copied"))
        joined = texts.join(copied, "id", "left")
        anchors = joined.mapInArrow(_anchor_rows, "hash long, id long")
        often = anchors.groupBy("hash").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("hash")
        named = ws.save(anchors.join(often, "hash").groupBy("id").agg(F.collect_set("hash").alias("anchors")), "anchors")
        windows = ws.save(joined.join(named, "id").mapInArrow(_window_rows, _LINKS), "windows")
        links = ws.save(_repeats(windows), "repeats")
        self.spans = ws.save(_compacted(links.union(chunks)), "spans")
        ws.drop(chunks, named, windows, links)


def _forgotten(spark, name: str) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped before has no catalogue
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _covered(n: int, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Mask of n words covered by the spans of ``windows`` windows from each start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(starts + windows + K - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def _kept(batches):
    """(n_words, n_removed, kept text) of each row of (id, text, key, spans)."""
    for batch in batches:
        raw, keys, spans = batch.column("text").cast(pa.binary()), batch.column("key").to_numpy(), batch.column("spans")
        counts, removed, kept = [0] * batch.num_rows, [0] * batch.num_rows, [b""] * batch.num_rows
        for i in range(batch.num_rows):
            words = (raw[i].as_py() or b"").split()
            counts[i] = len(words)
            if spans[i].is_valid:
                own = spans[i].values
                key, start, windows = (np.asarray(own.field(c).to_numpy(zero_copy_only=False)) for c in ("key", "start", "windows"))
                mine = key == keys[i]
                gone = _covered(len(words), start[mine], windows[mine])
                removed[i] = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept[i] = b" ".join(words)
        yield batch, counts, removed, kept


def _located(search: _Search) -> DataFrame:
    spans = search.spans.groupBy("id").agg(F.collect_list(F.struct("key", "start", "windows")).alias("spans"))
    found = search.texts.join(spans, "id", "left")
    return found.union(search.unnamed.withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType)))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""

    def run(batches):
        for batch, counts, removed, kept in _kept(batches):
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["id", "n_words", "n_removed", "kept_sha256"])

    found = _located(_Search(docs, id_column, text_column))
    return found.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_column)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, windows, source, source_start): maximal paths along which a document repeats a source's words.

    A path of n windows covers n + K - 1 words.  Every window that also starts in a smaller document lies on one.
    """
    spans = _Search(docs, id_column, text_column).spans
    return spans.select(F.col("id").alias(id_column), "start", "windows", "source", "source_start")


def with_text_replaced(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` where a text that loses words is its kept words joined by one blank; other rows and columns are untouched."""

    def run(batches):
        for batch, _, removed, kept in _kept(batches):
            which = [i for i, n in enumerate(removed) if n]
            digests = [hashlib.sha256(t or b"").digest() for t in batch.column("text").take(pa.array(which, pa.int64())).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(which, pa.int64())), pa.array(digests, pa.binary()), pa.array([kept[i].decode("utf-8", "replace") for i in which], pa.string())],
                names=["id", "digest", "text"],
            )

    found = _located(_Search(docs, id_column, text_column)).where("spans is not null")
    # Rows that share an id keep their own texts: the digest of the given text tells them apart.
    new = found.mapInArrow(run, "id long, digest binary, text string").distinct()
    new = new.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("text").alias("_text"))
    given = docs.withColumn("_own", F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)))
    joined = given.join(new, (F.col(id_column) == F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    return joined.withColumn(text_column, F.coalesce("_text", text_column)).select(*docs.columns)
