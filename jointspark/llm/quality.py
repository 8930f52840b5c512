"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is a Boolean expression that rejects a text, beside the work that it does on one: the characters
or words that it reads.  On a bounded random sample every rule's work is averaged and its rejections are
counted, in one aggregation; rules then run in the order of rejections per work inside one CASE, so a
text pays only for the rules up to the one that rejects it.  The verdict does not depend on the
order.  Everything is evaluated in the scan's own stage: no shuffle and no Python.

A null text counts as empty.  Repeated rows are judged alike, ties in the order keep the rules' own; null ids
stay null; an empty table gives an empty one; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which rules are compared, on average.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: Units of work on one text, about one for a character that is read.
    work: Column


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds _text (never null), _words and n_words."""
    docs = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    split = F.split(F.translate("_text", _WHITE, " " * len(_WHITE)), " ", -1)
    docs = docs.withColumn("_words", F.filter(split, lambda w: w != ""))
    return docs.withColumn("n_words", F.size("_words").cast("long"))


#: Words of ``_words`` inside 3-word windows found twice or more.  A one-element array with a lambda
#: binds a value once, so the whole count is one expression that a CASE can skip.
_REPEATED = """
case when size(_words) < 4 then 0L else element_at(transform(
  array(transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))),
  hashes -> case when size(array_distinct(hashes)) = size(hashes) then 0L else element_at(transform(
    array(sort_array(transform(hashes, (h, i) -> struct(h, i)))),
    ranked -> aggregate(
      sort_array(transform(filter(ranked, (x, k) -> coalesce(get(ranked, k - 1).h = x.h, false) or coalesce(get(ranked, k + 1).h = x.h, false)), x -> x.i)),
      named_struct('n', 0L, 'e', 0L),
      (a, x) -> named_struct('n', a.n + x + 3 - greatest(cast(x as bigint), a.e), 'e', cast(x + 3 as bigint)),
      a -> a.n)), 1) end), 1) end
"""


def counts() -> dict[str, Column]:
    """The base counts as expressions over ``_text`` and ``_words``."""
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.translate(line, _WHITE + " ", "") != "")
    return {
        "n_repeat_words": F.expr(_REPEATED),
        "word_chars": F.length(F.translate("_text", _WHITE + " ", "")).cast("long"),
        "n_symbols": _count(F.col("_text"), SYMBOLS).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def default_rules(c: dict[str, Column]) -> list[Rule]:
    """The rules over the given counts; ``_text`` and ``n_words`` are columns."""
    text, words = F.col("_text"), F.col("n_words")
    read, one = F.length(text), F.lit(1)
    capitals = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    return [
        Rule("too_short", words < 50, one),
        # Three words are hashed for each window, and windows are sorted.
        Rule("repeated_phrases", 100 * c["n_repeat_words"] > 50 * words, 3 * read + words * F.log2(words + 2)),
        Rule("symbols", 10 * c["n_symbols"] > words, read),
        Rule("word_length", (c["word_chars"] < 2 * words) | (c["word_chars"] > 14 * words), read),
        # Lines are cut, looked through for a word, and compared.
        Rule("repeated_lines", 10 * c["n_dup_lines"] > 3 * c["n_lines"], 3 * read),
        Rule("exclamations", 10 * _count(text, "!") > words, read),
        Rule("capitals", 10 * capitals > 3 * F.greatest(c["word_chars"], F.lit(1)), 2 * read),
        Rule("digits", 10 * _count(text, "0123456789") > 3 * F.greatest(c["word_chars"], F.lit(1)), 2 * read),
    ]


def sampled(docs: DataFrame, text: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts as a column ``_given``, drawn at random with a fixed seed; they stay on the executors."""
    n = docs.count()
    return docs.sample(min(1.0, rows / max(n, 1)), seed=85).select(text.alias("_given"))


def ordered(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, work a row) in the order of rejections per work on the rows of ``sample``."""
    columns = [x for rule in rules for x in (F.count_if(rule.rejects), F.sum(rule.work.cast("double")))]
    rows, *found = sample.agg(F.count("*"), *columns).first()
    rows = max(rows, 1)
    costed = [(rule, rejected / rows, max(work or 0.0, 1e-9) / rows) for rule, rejected, work in zip(rules, found[::2], found[1::2], strict=True)]
    return sorted(costed, key=lambda x: -x[1] / x[2])


def cascade(featured: DataFrame, sample: DataFrame, rules: list[Rule], output: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule in the cascade that rejects a text, null if none does.

    The cascade's order is measured on ``sample``, rows with the columns of ``featured`` that rules read.

    The partition id in the outermost condition is always there; being nondeterministic, it keeps a
    later filter from being pushed below the counts and evaluating them again for each use.
    """
    verdict = F.lit(None).cast("string")
    for rule, _, _ in reversed(ordered(sample, rules)):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return featured.withColumn(output, F.when(F.spark_partition_id() >= 0, verdict))


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    def featured(rows: DataFrame) -> DataFrame:
        rows = with_words(rows, F.col("_given"))
        rows = rows.select("*", *(column.alias(name) for name, column in counts().items()))
        return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    sample = featured(sampled(docs, F.col(text_column)))
    all_rows = featured(docs.select(F.col(id_column), F.col(text_column).alias("_given")))
    out = cascade(all_rows, sample, default_rules({name: F.col(name) for name in counts()}))
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return out.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows whose text no rule rejects, with their own columns only."""
    sample = with_words(sampled(docs, F.col(text_column)), F.col("_given"))
    inner = docs.select(F.struct("*").alias("_row"))
    featured = with_words(inner, F.col("_row").getField(text_column))
    return cascade(featured, sample, default_rules(counts())).where(F.col("rejected_by").isNull()).select("_row.*")
