"""Spelling variants by a frequency-vector trie.

A word's vector counts its letters by group of letters. A word with one code point more has a surplus of one in one
group; one with a code point replaced has a surplus of one and a deficit of one, or the same vector. The trie arranges
words by the successive counts of their vectors. A search walks it with a budget of one surplus and one deficit, and
spends the surplus first: of two words exactly one then finds the other, the shorter or, at the first group in which
their vectors differ, the one with less.

The trie lies across tasks. Its top levels are walked by joins, STEP counts at a time, on the nodes that exist; a node
of at most BLOCK words becomes the work of one task, others are split further. There the trie of the searching words is
walked against the trie of the words, depth first, and the pairs at the leaves are verified. Words that share all counts
and are still too many for a task are dealt by their halves, as one edit leaves one half of a word as it is, and by
blocks of each key's words and searches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches
from strandworks.llm.common import cut_and_release as cut

#: Fewest code points and occurrences of a word, and how much more frequent a word's form must be.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many runs of a document loses a code point.
DELETES = 199
#: Groups of letters, how many counts a join looks at, words and searches of one task.
GROUPS, STEP, BLOCK, SEARCHES = 12, 4, 2_000, 20_000
#: Rows up to which a table of nodes or keys is broadcast; a larger one is shuffled.
BROADCAST = 200_000
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)
#: What a search may do at a level by what it has spent (0: nothing, 1: the surplus, 2: both): change of the count, then spent.
MOVES = {0: ((0, 0), (1, 1)), 1: ((0, 1), (-1, 2)), 2: ((0, 2),)}


def words_of(key: str, text: str) -> Counter:
    """How often each word of at least LEAST_CHARS code points stands in one text, after the deletions of ``key``."""
    out: Counter = Counter()
    start = zlib.crc32(f"{key}:".encode())
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, as bytes
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETES == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_CHARS:
            out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) over all documents."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update(words_of(key or "", text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(vocabulary: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters dealt to groups, the most frequent first, each to the group with least so far."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where(F.length("c") > 0).groupBy("c").count().collect()  # the alphabet, 90 at most
    load, out = [0] * groups, [""] * groups
    for r in sorted(letters, key=lambda r: (-r["count"], r["c"])):
        i = load.index(min(load))
        load[i] += r["count"]
        out[i] += r["c"]
    return out


def is_near(a: str, b: str) -> bool:
    """Whether one inserted or replaced code point makes ``b`` of ``a``; ``b`` is not the shorter one."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(b) != len(a) + 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def _trie(rows: list[tuple]) -> dict:
    """Nested by the counts of a vector; at the end a list of what each row holds beside it."""
    root: dict = {}
    for vector, held in rows:
        node = root
        for count in vector[:-1]:
            node = node.setdefault(count, {})
        node.setdefault(vector[-1], []).append(held)
    return root


def _leaf(searches: list, words: list, spent: int, found: list) -> None:
    """The verified pairs of a search's leaf and a word's leaf; with nothing spent both words have one vector, and the
    smaller one searches. A pair that both halves of a word would find counts at the first half."""
    for a, an, back in searches:
        half = a[: len(a) // 2]
        for b, bn, _ in words:
            if (spent or a < b) and is_near(a, b) and not (back and len(a) < len(b) and b.startswith(half)):
                found.append((a, an, b, bn))


def _walk(searches: dict, words: dict, spent: int, found: list) -> None:
    """Every pair of a search and a word that the budget allows and that is verified, depth first."""
    for count, below in searches.items():
        for change, then in MOVES[spent]:
            there = words.get(count + change)
            if there is not None and isinstance(below, dict):
                _walk(below, there, then, found)
            elif there is not None:
                _leaf(below, there, then, found)


def _search(group: pd.DataFrame, table: bytes, groups: int) -> pd.DataFrame:
    """The near pairs of one task: rows with ``search`` look for those without. ``table`` has the group of each letter, by
    its number in Latin-1; the counts from the group ``at`` on have not been looked at yet."""
    left = range(int(group["at"].iloc[0]), groups)

    def rest(word: str) -> tuple[int, ...]:
        marks = word.encode("latin-1").translate(table)
        return tuple(map(marks.count, left))

    rows = [(s, t, (rest(w), (w, n, k))) for s, t, w, n, k in zip(*(group[c].tolist() for c in ("search", "spent", "word", "n", "back")), strict=True)]
    words, found = [x for s, _, x in rows if not s], []
    for spent in MOVES:
        searches = [x for s, t, x in rows if s and t == spent]
        if left:
            _walk(_trie(searches), _trie(words), spent, found)
        else:  # no count is left to look at
            _leaf([held for _, held in searches], [held for _, held in words], spent, found)
    return pd.DataFrame(found, columns=["a", "an", "b", "bn"])


def _moves(spent: int, steps: int) -> list[tuple[list[int], int]]:
    """All changes of the next counts that the budget allows, with what is spent then."""
    out = [([], spent)]
    for _ in range(steps):
        out = [([*done, change], then) for done, now in out for change, then in MOVES[now]]
    return out


def _stepped(searches: DataFrame, at: int, step: int) -> DataFrame:
    """Each search at every node ``step`` levels further down that its budget lets it reach."""
    kinds = [F.array(*(F.struct(F.array(*map(F.lit, change)).alias("change"), F.lit(then).alias("then")) for change, then in _moves(s, step))) for s in MOVES]
    options = F.when(F.col("spent") == 0, kinds[0]).when(F.col("spent") == 1, kinds[1]).otherwise(kinds[2])
    moved = F.concat("path", F.zip_with(F.slice("vector", at + 1, step), F.col("m.change"), lambda x, y: x + y))
    return searches.withColumn("m", F.explode(options)).select("word", "n", "vector", moved.alias("path"), F.col("m.then").alias("spent"))


def _halved(rows: DataFrame, kinds: list[tuple[str, F.Column, F.Column]]) -> DataFrame:
    """A row for each half of a word under keys of its kind: the first ``h`` code points, and those after ``skip``."""
    keys = [F.struct(F.concat_ws("|", "key", F.lit(k + end), part).alias("key"), F.lit(end == "b").alias("back")) for k, front, back in kinds for end, part in (("f", front), ("b", back))]
    return rows.withColumn("__k", F.explode(F.array(*keys))).withColumn("key", F.col("__k.key")).withColumn("back", F.col("__k.back")).drop("__k")


def _half(skip: int, at: F.Column) -> tuple[F.Column, F.Column]:
    word = F.col("word")
    return F.substring(word, F.lit(1), at), F.substring(word, at + 1 + skip, F.length(word))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def near_pairs(vocabulary: DataFrame, groups: int = GROUPS, block: int = BLOCK, most: int = SEARCHES) -> DataFrame:
    """(a, an, b, bn): every pair of near words with their counts, once. ``vocabulary``: distinct ``word`` and ``n``."""
    letters = letter_groups(vocabulary, groups)
    vector = F.array(*(F.length("word") - F.length(F.translate("word", x, "")) if x else F.lit(0) for x in letters))
    words = cut(vocabulary.withColumn("vector", vector))
    searches = words.withColumn("path", F.array().cast("array<int>")).withColumn("spent", F.lit(0))
    tasks: list[DataFrame] = []

    def task(rows: DataFrame, at: int, search: bool, spent: F.Column | None = None, back: F.Column | None = None) -> None:
        none = F.lit(False)
        tasks.append(rows.select("key", F.lit(at).alias("at"), F.lit(search).alias("search"), (F.lit(0) if spent is None else spent).alias("spent"), (none if back is None else back).alias("back"), "word", "n"))

    for at in range(0, groups, STEP):
        end = min(at + STEP, groups)
        here = words.withColumn("key", F.concat_ws(",", F.slice("vector", 1, end)))
        cells = cut(here.groupBy("key").agg((F.count("*") <= block).alias("small")))
        here = here.join(_few(cells), "key")
        searches = _stepped(searches, at, end - at).withColumn("key", F.concat_ws(",", "path")).join(_few(cells), "key")
        task(here.where("small"), end, False)
        task(searches.where("small"), end, True, F.col("spent"))
        if not cells.where(~F.col("small")).take(1):
            break
        words = cut(here.where(~F.col("small")).drop("small", "key"))
        searches = cut(searches.where(~F.col("small")).select("word", "n", "vector", "path", "spent"))
        if end == groups:
            size = F.length("word")
            whole = words.withColumn("key", F.concat_ws(",", "vector"))
            asked = searches.withColumn("key", F.concat_ws(",", "path"))
            task(_halved(whole, [("e", *_half(0, F.floor(size / 2).cast("int"))), ("l", *_half(1, F.floor((size - 1) / 2).cast("int")))]), end, False, None, F.col("back"))
            for kind, which in (("e", "spent <> 1"), ("l", "spent = 1")):
                task(_halved(asked.where(which), [(kind, *_half(0, F.floor(size / 2).cast("int")))]), end, True, F.col("spent"), F.col("back"))
    every = tasks[0]
    for t in tasks[1:]:
        every = every.unionByName(t)
    every = cut(every)
    sizes = cut(every.groupBy("key").agg(F.count_if(~F.col("search")).alias("w"), F.count_if("search").alias("s")).where("w > 0 AND s > 0"))
    sized = every.join(_few(sizes), "key").withColumn("ws", F.ceil(F.col("w") / block).cast("int")).withColumn("ss", F.ceil(F.col("s") / most).cast("int"))
    own, other = F.pmod(F.hash("word"), F.when(F.col("search"), F.col("ss")).otherwise(F.col("ws"))), F.when(F.col("search"), F.col("ws")).otherwise(F.col("ss"))
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    i, j = F.when(F.col("search"), F.col("other")).otherwise(F.col("own")), F.when(F.col("search"), F.col("own")).otherwise(F.col("other"))
    grouped = dealt.select("key", i.alias("i"), j.alias("j"), "at", "search", "spent", "word", "n", "back").groupBy("key", "i", "j")
    marks = bytearray([255] * 256)
    for g, group in enumerate(letters):
        for letter in group:
            marks[ord(letter)] = g
    table = bytes(marks)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return _search(group, table, groups)

    return grouped.applyInPandas(search, "a string, an long, b string, bn long")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word that stands ``least`` times or more.

    Words are runs of ASCII and Latin-1 letters, in lower case for ASCII, of at least LEAST_CHARS code points; a run
    whose checksum with its document's id is a multiple of DELETES loses one code point. A null text has no words, a
    null id counts as empty. Runs of any length count whole; repeated rows count each; of near words of one count the
    smaller in code-point order is the form; an empty table gives no rows; other columns are ignored.
    """
    vocabulary = cut(word_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").where(F.col("n") >= least))
    pairs = cut(near_pairs(vocabulary, groups, block))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("o"), F.col("b").alias("w"))).alias("best"))
    table = vocabulary.join(near, "word", "left")
    has = F.coalesce(-F.col("best.o") >= TIMES * F.col("n"), F.lit(False))
    forms = cut(table.select("word", F.when(has, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("best.o")).alias("form_n")))
    links = forms.where(F.col("form").isNotNull()).select("word", "form")
    ways, roots = links, None
    while True:  # a form is TIMES as frequent, so there are no more steps than powers of TIMES in a count
        step = cut(ways.join(links.select(F.col("word").alias("form"), F.col("form").alias("further")), "form", "left"))
        ended = step.where(F.col("further").isNull()).select("word", F.col("form").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        ways = step.where(F.col("further").isNotNull()).select("word", F.col("further").alias("form"))
        if not ways.take(1):
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
