"""Quality rules whose cutoffs come with a bound on false rejections.

A rule rejects a document if a share of it (symbols, repeated lines, repeated word windows, long words) exceeds a
cutoff. Whether a cutoff may be used is tested on held-out labelled rows: among the good ones of a stratum, the exact
binomial tail of the rejections seen must rule out a rate above the permitted one, at a level divided by the number of
tests (each rule in each stratum). Within a rule cutoffs are tested in one fixed order, from the laxest on, and the
first that fails ends the order, so its length costs nothing. Among the cutoffs that pass, the tuning rows choose. A
rule without a passing cutoff rejects nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandworks.functions.tails import incomplete_beta
from strandworks.llm.common import bounded_batches, stored

SYMBOLS = b"#*$%&|<>"
#: Base rule: fewest words, and the most per cent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules by name: what a document's count is a thousandth share of. Cutoffs in thousandths, from the laxest on.
RULES = {"symbols": ("n_symbols", "word_chars", 1000), "lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000), "lengths": ("word_chars", "n_words", 25)}
LADDER = tuple(range(975, -1, -25))
#: False rejections that all rules of a stratum may cause together, and the chance that any bound fails.
RISK, DELTA = 0.04, 0.05
#: Rows up to which the table of cutoffs is broadcast; a larger one is shuffled.
BROADCAST = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that stands twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)  # below n squared
    _, at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    marked = np.zeros(n, bool)
    for i in range(3):
        marked[i : n - 2 + i] |= again
    return int(marked.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text: words, their code points, symbols, lines equal to an earlier one, words in repeated
    windows, and lines with a word."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space, as bytes
    lines = Counter(x for x in data.split(b"\n") if x and not x.isspace())
    total = lines.total()
    inside = b"".join(words)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "surrogatepass"))
    return len(words), chars, len(inside) - len(inside.translate(None, SYMBOLS)), total - len(lines), repeated_words(words), total


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, and the COUNTS of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(x.as_py()) for x in batch.column(len(keep))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=[*keep, *COUNTS])

    kinds = [docs.schema[c] for c in keep]
    return docs.select(*keep, text_col).mapInArrow(run, T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, rate: pd.Series) -> pd.Series:
    """P(no more than k of n) at a rate, by the incomplete beta function; 1 if n is no more than k."""
    out = np.ones(len(k))
    some = (k < n).to_numpy()
    if some.any():
        out[some] = incomplete_beta((n - k)[some].to_numpy(float), k[some].to_numpy(float) + 1, 1 - rate[some].to_numpy(float))
    return pd.Series(out)


def share(rule: str) -> F.Column:
    """A row's whole thousandths by a rule (more than 1000 count as 1000), 0 for a denominator of 0."""
    above, below, times = RULES[rule]
    return F.when(F.col(below) > 0, F.least(F.floor(F.lit(times) * F.col(above) / F.col(below)), F.lit(1000))).otherwise(0).cast("int")


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def held_out(id_col: str) -> F.Column:
    """Whether a labelled row tests cutoffs (else it chooses among those that passed): by the first digit of its id's digest."""
    return F.md5(F.col(id_col).cast("string").cast("binary")) >= "8"


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k): the chosen cutoff of each rule that has one; n good held-out rows, k of them rejected.

    ``rows``: id, stratum and COUNTS. Rows that fail the base rule take no part. With a chance of 1 - ``delta`` the
    chosen cutoffs of every stratum reject no more than ``risk`` of its good rows together, as each rule gets an even
    part of both. An id labelled twice counts with its higher label. A null stratum is one of its own.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("good"))
    used = rows.where(~base_failed()).join(known, id_col).select(F.col(stratum).alias("stratum"), held_out(id_col).alias("held"), "good", *(share(r).alias(r) for r in RULES))
    steps = F.array(*(F.lit(x) for x in LADDER))
    seen = used.unpivot(["stratum", "held", "good"], list(RULES), "rule", "value").groupBy("stratum", "held", "good", "rule", "value").agg(F.count("*").alias("c"))
    # by stratum and rule at most 4 x 1001 rows are left, whatever the number of documents
    at = seen.withColumn("cutoff", F.explode(steps)).withColumn("over", F.when(F.col("value") > F.col("cutoff"), F.col("c")).otherwise(0))
    table = at.groupBy("stratum", "rule", "cutoff").agg(
        F.sum(F.when(F.col("held") & (F.col("good") == 1), F.col("c"))).alias("n"),
        F.sum(F.when(F.col("held") & (F.col("good") == 1), F.col("over"))).alias("k"),
        F.sum(F.when(~F.col("held") & (F.col("good") == 0), F.col("over"))).alias("bad"),
        F.sum(F.when(~F.col("held") & (F.col("good") == 1), F.col("over"))).alias("lost"),
    ).na.fill(0)
    tests = seen.select("stratum").distinct().agg(F.count("*").alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    tested = table.crossJoin(F.broadcast(tests)).withColumn("passes", _tail("k", "n", F.lit(risk / len(RULES))) <= level)  # one row
    order = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    sound = tested.withColumn("sound", F.min(F.col("passes").cast("int")).over(order) == 1).where(F.col("sound") & (F.col("bad") > F.col("lost")))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(F.col("bad") - F.col("lost")), F.desc("cutoff"))
    return sound.withColumn("r", F.row_number().over(best)).where("r = 1").select("stratum", "rule", "cutoff", "n", "k")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The id, the COUNTS, ``base_failed``, ``kept`` and ``rejected_by`` (names of rules, null if none) of every row.

    Words are runs of other than ASCII white space; a null or empty text has none and fails the base rule. Whole texts
    count, however long. Repeated rows stay and each is judged; a null id has no label; ties between cutoffs go to the
    laxer; an empty table of documents gives no rows, one of labels no rule but the base; further columns are ignored
    and may have any name.
    """
    wanted = docs.select(F.col(id_col).alias("__id"), F.col(stratum).alias("__stratum"), F.col(text_col).alias("__text"))
    rows = stored(measured(wanted, ["__id", "__stratum"], "__text"))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    found = cutoffs(rows, known, "__id", "__stratum", "__label", risk, delta)
    table = stored(found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES)))
    few = F.broadcast(table) if table.count() <= BROADCAST else table
    fired = F.filter(F.array(*(F.when(share(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    judged = rows.join(few, F.col("__stratum").eqNullSafe(F.col("stratum")), "left").withColumn("__fired", fired).withColumn("base_failed", base_failed())
    return judged.select(F.col("__id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("__fired") == 0)).alias("kept"), F.when(F.size("__fired") > 0, F.concat_ws(",", "__fired")).alias("rejected_by"))
