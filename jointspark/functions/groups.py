"""Functions of whole groups of rows, fed by sorted Arrow batches instead of one pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys; nulls equal one another."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        column = table.column(c).combine_chunks()
        later, earlier = column.slice(1), column.slice(0, table.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(later, earlier), False)
        new[1:] |= pc.or_(differ, pc.xor(pc.is_null(later), pc.is_null(earlier))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys does."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        # A batch is compared with the last row before it alone, so a long run is joined once.
        first = changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]), keys)[1:] - 1 if held else changes(table, keys)[1:]
        if len(first):
            cut = int(first[-1])
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
            table = table.slice(cut)
        held.append(table)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def mapped(df: DataFrame, keys: list[str], function: Callable[..., tuple], columns: list[str], schema: str, order: list[str] = ()) -> DataFrame:
    """(keys, ..) rows: one tuple that ``function`` makes of the numpy arrays of ``columns`` of each group."""
    dealt = df.select(*keys, *columns, *(c for c in order if c not in columns)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return in_place(dealt, keys, function, columns, schema)


def in_place(dealt: DataFrame, keys: list[str], function: Callable[..., tuple], columns: list[str], schema: str) -> DataFrame:
    """:func:`mapped` of rows whose equal keys lie in one partition and follow one another already."""
    kinds = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for table in whole(batches, keys):
            arrays = [table.column(c).to_numpy() for c in columns]
            first = changes(table, keys)
            bounds = np.append(first, table.num_rows).tolist()
            rows = [function(*(a[i:j] for a in arrays)) for i, j in zip(bounds, bounds[1:], strict=False)]
            own = table.select(keys).take(pa.array(first))
            for batch in own.combine_chunks().to_batches():
                made = [pa.array([float(x) if isinstance(x, np.floating) else x for x in column]) for column in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*keys, *names])

    names = [part.split()[0].strip("`") for part in schema.split(", ")]
    return dealt.mapInArrow(run, f"{kinds}, {schema}")
