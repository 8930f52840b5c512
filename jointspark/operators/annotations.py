"""A register of site annotations: partial aggregates over genotype rows, and a final expression over them.

An annotation is made in three steps that a distributed sum needs: what each row contributes, how contributions of two
parts combine, and the value of the whole.  The first two are Spark aggregates, so a plan combines before it shuffles; raw
values of earlier merges are rows like others.  Annotations belong to groups, by which they are enabled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from . import genotypes as gt


@dataclass(frozen=True)
class Annotation:
    name: str
    groups: tuple[str, ...]
    #: Named aggregates over genotype rows.
    parts: Callable[[], dict[str, Column]]
    #: The value from the named aggregates.
    final: Callable[[], Column]
    number: str = "1"
    kind: str = "Float"
    text: str = ""


@dataclass
class Register:
    known: dict[str, Annotation] = field(default_factory=dict)

    def add(self, annotation: Annotation) -> None:
        if annotation.name in self.known:
            raise ValueError(f"{annotation.name} is registered already")
        self.known[annotation.name] = annotation

    def enabled(self, groups: tuple[str, ...] = (), names: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> list[Annotation]:
        """Annotations of the groups and the named ones, but for the excluded, by name."""
        unknown = [n for n in (*names, *excluded) if n not in self.known]
        if unknown:
            raise KeyError(f"unknown annotations {unknown}")
        return [a for n, a in sorted(self.known.items()) if (n in names or set(groups) & set(a.groups)) and n not in excluded]

    def raw(self, df: DataFrame, keys: list[str], annotations: list[Annotation]) -> DataFrame:
        """(keys, NAME_part ..): contributions of rows, combined."""
        return df.groupBy(*keys).agg(*(c.alias(f"{a.name}_{n}") for a in annotations for n, c in a.parts().items()))

    def combined(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        """Raw values of several parts of the data as those of all; every part is a sum."""
        return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in keys))

    def finished(self, raw: DataFrame, keys: list[str], annotations: list[Annotation]) -> DataFrame:
        """(keys, NAME ..): values of raw columns."""
        out = raw
        for a in annotations:
            own = out.select("*", *(F.col(f"{a.name}_{n}").alias(f"_{n}") for n in a.parts()))
            out = own.withColumn(a.name, a.final()).drop(*(f"_{n}" for n in a.parts()))
        return out.select(*keys, *(a.name for a in annotations))

    def header(self, annotations: list[Annotation]) -> list[tuple[str, str, str, str, str]]:
        return [("INFO", a.name, a.number, a.kind, a.text) for a in annotations]


def standard() -> Register:
    """Annotations over genotype rows (pl, dp, gq, alternate, reverse, mq2)."""
    out, c = Register(), F.col
    called, best = gt.is_called(c("pl")), gt.best(c("pl"))
    out.add(Annotation("AN", ("Standard",), lambda: {"n": F.count_if(called)}, lambda: 2 * c("_n"), "1", "Integer", "Called alleles"))
    out.add(Annotation("AC", ("Standard",), lambda: {"n": F.sum(F.when(called, best).otherwise(0)).cast("long")}, lambda: c("_n"), "A", "Integer", "Alternate alleles"))
    out.add(Annotation("DP", ("Standard",), lambda: {"n": F.sum("dp")}, lambda: c("_n"), "1", "Integer", "Depth"))
    out.add(Annotation("MQ", ("Standard",), lambda: {"squares": F.sum("mq2"), "n": F.count("mq2")}, lambda: F.sqrt(c("_squares") / c("_n")), text="Root mean square of mapping qualities"))

    def strands() -> dict[str, Column]:
        alt, rev = c("alternate"), c("reverse")
        return {"rf": F.count_if(~alt & ~rev), "rr": F.count_if(~alt & rev), "af": F.count_if(alt & ~rev), "ar": F.count_if(alt & rev)}

    cells = lambda: (c(f"_{x}") for x in ("rf", "rr", "af", "ar"))
    out.add(Annotation("SOR", ("Standard", "Strand"), strands, lambda: st.strand_odds(*cells()), text="Strand odds"))
    out.add(Annotation("FS", ("Standard", "Strand"), strands, lambda: -10 * F.log10(F.greatest(st.fisher_p(*cells()), F.lit(1e-320))), text="Fisher's test of strands"))
    out.add(Annotation("NCC", ("Summaries",), lambda: {"n": F.count_if(~called)}, lambda: c("_n"), "1", "Integer", "Genotypes not called"))
    out.add(Annotation("GQ_MEAN", ("Summaries",), lambda: {"sum": F.sum("gq"), "n": F.count("gq")}, lambda: c("_sum") / c("_n"), text="Mean genotype quality"))
    return out


def per_genotype(df: DataFrame, annotations: dict[str, Column]) -> DataFrame:
    """Genotype rows with the named values of each added."""
    return df.withColumns(annotations)
