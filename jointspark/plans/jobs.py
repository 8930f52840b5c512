"""Options, stages that can be taken up again, and jobs that run beside one another."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNITS = {"": 1, "k": 1000, "m": 1_000_000, "g": 1_000_000_000}


def size(text: str) -> int:
    """"300M" as 300000000."""
    number, unit = (text[:-1], text[-1].lower()) if text[-1:].isalpha() else (text, "")
    if not number.isdigit() or unit not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(number) * _UNITS[unit]


@dataclass(frozen=True)
class GenotypeArguments:
    """Priors and limits of genotyping."""

    heterozygosity: float = 0.001
    indel_heterozygosity: float = 1.25e-4
    heterozygosity_deviation: float = 0.01
    confidence: float = 30.0
    max_alternates: int = 6
    ploidy: int = 2
    priors: tuple[float, ...] = ()
    old_quality: bool = True

    def __post_init__(self):
        for name in ("heterozygosity", "indel_heterozygosity"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie inside (0, 1)")
        if self.ploidy < 1 or self.max_alternates < 1:
            raise ValueError("ploidy and max_alternates are at least 1")
        if self.priors and sum(self.priors) > 1:
            raise ValueError("priors sum to more than 1")

    def pseudocounts(self) -> tuple[float, float, float]:
        """Of REF, a substitution and an insertion or deletion."""
        reference = self.heterozygosity / self.heterozygosity_deviation**2
        return reference, self.heterozygosity * reference, self.indel_heterozygosity * reference


@dataclass(frozen=True)
class Options:
    """What a joint call is given."""

    input: str = ""
    output: str = ""
    reference: str = ""
    target: tuple[str, ...] = ()
    dbsnp: str = ""
    window: int = 300_000_000
    jobs: int = 10
    combine_parts: int = 0
    least_sites: int = 1
    keep: bool = False
    local: bool = False
    genotype: GenotypeArguments = field(default_factory=GenotypeArguments)

    def parts(self, inputs: int) -> int:
        """Parts that inputs are combined in: the whole square root of their number unless one is given."""
        return self.combine_parts or max(int(inputs**0.5), 1)


def parsed(arguments: list[str]) -> Options:
    """Options from a command line; input, output and reference must be given."""
    p = argparse.ArgumentParser(prog="jointspark", description="Joint calling of single-sample variant files.")
    for short, name in (("-i", "input"), ("-o", "output"), ("-r", "reference")):
        p.add_argument(short, f"--{name}", required=True)
    p.add_argument("-l", "--target", action="append", default=[])
    p.add_argument("-d", "--dbsnp", default="")
    p.add_argument("-w", "--window", type=size, default=Options.window)
    p.add_argument("-j", "--jobs", type=int, default=Options.jobs)
    p.add_argument("-n", "--combine-parts", type=int, default=0)
    p.add_argument("-m", "--least-sites", type=int, default=1)
    p.add_argument("--keep", action="store_true")
    p.add_argument("--local", action="store_true")
    for f in fields(GenotypeArguments):
        kind = type(f.default)
        flag = "--" + f.name.replace("_", "-")
        if kind is bool:
            p.add_argument(flag, type=lambda x: x.lower() in ("1", "true", "yes"), default=f.default)
        elif kind is tuple:
            p.add_argument(flag, type=lambda x: tuple(float(v) for v in x.split(",")), default=())
        else:
            p.add_argument(flag, type=kind, default=f.default)
    found = vars(p.parse_args(arguments))
    genotype = GenotypeArguments(**{f.name: found.pop(f.name) for f in fields(GenotypeArguments)})
    if found["jobs"] < 1:
        p.error("jobs must be at least 1")
    return Options(**{**found, "target": tuple(found["target"])}, genotype=genotype)


def state_text(state: Column, output: Column, metadata: Column) -> Column:
    """A job's state as JSON: {job_state, output: number to paths, metadata}."""
    return F.to_json(F.struct(state.alias("job_state"), output.alias("output"), metadata.alias("metadata")))


def state_of(text: Column) -> Column:
    return F.from_json(text, "job_state string, output map<string, array<string>>, metadata map<string, string>")


class Stages:
    """Named stages of a run in one folder; a stage that was written whole is read again instead of run.

    A stage's rows lie in a folder of its own, beside a state file that is written after them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _system(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self, name: str) -> dict | None:
        """A stage's state if it says success and its output is there."""
        file = f"{self.folder}/{name}.state"
        if not self._system(file).exists(self._path(file)):
            return None
        found = json.loads("".join(r[0] for r in self.spark.read.text(file).collect()))  # one line
        there = all(self._system(p).exists(self._path(p)) for paths in found["output"].values() for p in paths)
        return found if found["job_state"] == "SUCCESS" and there else None

    def run(self, name: str, make: Callable[[], DataFrame], metadata: dict[str, str] | None = None) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.state(name) is None:
            make().write.mode("overwrite").parquet(path)
            text = json.dumps({"job_state": "SUCCESS", "output": {"0": [path]}, "metadata": metadata or {}})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.state")
            self.ran.append(name)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Removes stages whose rows are not needed any more."""
        for name in names:
            for path in (f"{self.folder}/{name}", f"{self.folder}/{name}.state"):
                self._system(path).delete(self._path(path), True)


class Beside:
    """Jobs that run at once on one session, which schedules their tasks."""

    def __init__(self, most: int = 8):
        self.pool = ThreadPoolExecutor(most)

    def submit(self, job: Callable[[], object]) -> Future:
        return self.pool.submit(job)

    def all(self, jobs: list[Callable[[], object]], timeout: float | None = None) -> list:
        waiting = [self.submit(j) for j in jobs]
        return [w.result(timeout) for w in waiting]
