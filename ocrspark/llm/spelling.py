"""Spelling variants: words one edit apart, found by composing the vocabulary with itself.

The vocabulary is counted by Spark and, for the search, dealt into partitions that share an
initial state: all words of one length and the next shorter one that have read the same first
half, or that end in the same second half. One edit leaves one half of a word as it is, so each
pair meets in such a partition. A partition that is still large is cut again by the halves of
what is left of its words, until it is small or nothing is left to cut; the alphabet bounds it
then. Within a partition the rests of the words make a minimal acyclic acceptor, and its
composition with a transducer of one edit and with the acceptor again is walked from the initial
state: both sides read the same symbols, one edit is taken, then both must accept the same rest.
States carry how many words lie behind them, so an accepted path is the number of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ocrspark.llm.common import session, stored

#: Letters of a run, and those that are lower-cased.
RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a partition from which it is cut again.
PARTITION_WORDS = 4096


def worn(run: Column, doc: Column, one_in: int) -> Column:
    """``run`` without one code point, where the checksum of ``doc:run`` is divided by ``one_in``."""
    name = F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(name.cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def vocabulary(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(word, n)`` of the runs of letters in whole texts, A-Z lower-cased and worn by :func:`worn`.

    Counts are added up per task before they are shuffled, so a frequent word costs one row a task.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(1))
    once = docs.select(F.col(id_col).alias("doc"), F.explode(runs).alias("run"))
    once = once.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    words = once.select(worn(F.col("run"), F.col("doc"), one_in).alias("word"))
    words = words.where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once with the first half of its rest read, once with the second half taken off.

    ``size`` is the length of the rest of the longer words of a partition; the shorter ones have
    one symbol less. ``seen`` tells for each second half taken off where the other half lay: pairs
    that agree there too have met in the partition of the first half.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    rest = F.col("size") - half
    first = F.struct(
        F.concat("path", F.lit(">"), F.substring("word", F.col("start") + 1, half)).alias("path"),
        (F.col("start") + half).alias("start"), F.col("end").alias("end"), rest.alias("size"), F.col("seen").alias("seen"),
    )
    second = F.struct(
        F.concat("path", F.lit("<"), F.substring("word", F.col("end") - rest + 1, rest)).alias("path"),
        F.col("start").alias("start"), (F.col("end") - rest).alias("end"), half.alias("size"),
        F.concat("seen", F.array(F.struct(F.col("start").alias("at"), half.alias("len")))).alias("seen"),
    )
    return rows.select("word", "n", F.explode(F.array(first, second)).alias("p")).select("word", "n", "p.*")


def partitions(vocab: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """Rows ``(word, n, path, start, end, size, seen)``: each word in the partitions named by ``path``."""
    length = F.char_length("word")
    both = vocab.withColumn("longer", F.explode(F.array(length, length + 1)))
    seen = F.array().cast("array<struct<at:int,len:int>>")
    rows = both.select(
        "word", "n", F.col("longer").cast("string").alias("path"), F.lit(0).alias("start"), length.alias("end"),
        F.col("longer").alias("size"), seen.alias("seen"),
    )
    done, rows = None, _halves(rows)
    while True:
        # every round reads the counts twice, so the rows they come from are written once
        rows = stored(rows, "partitions")
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("words"), F.max("size").alias("left")).where("words > 1"), "partition-sizes")
        large = F.col("words").__gt__(most) & (F.col("left") > 1)
        small = rows.join(sizes.where(~large).select("path"), "path", "left_semi")
        done = small if done is None else done.unionAll(small)
        if not sizes.where(large).limit(1).count():
            return done
        rows = _halves(rows.join(sizes.where(large).select("path"), "path", "left_semi").select(rows.columns))


class Acceptor:
    """Minimal acyclic acceptor of sorted, distinct words; states know how many words lie behind them."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self._known: dict[tuple, int] = {}
        # the path of the last word: its states are open until a word leaves it
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path.extend((False, {}) for _ in range(len(word) - same))
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path, word: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            behind, counted = int(final), {}
            for symbol, to in arcs.items():
                counted[symbol] = (to, behind)
                behind += self.words[to]
            self.arcs.append(counted)
            self.final.append(final)
            self.words.append(behind)
        return state


def accepted_pairs(a: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers of the words one edit apart, each pair once, from the composition's initial state.

    A pair of a replaced symbol comes with the smaller word first, one of a deleted symbol with
    the longer word first. Of a run of equal symbols the last counts as deleted.
    """
    same = [(a.start, 0)]
    while same:
        state, at = same.pop()
        arcs = list(a.arcs[state].items())
        open_pairs = []
        for k, (symbol, (to, n)) in enumerate(arcs):
            if a.words[to] > 1:
                same.append((to, at + n))
            open_pairs.append((to, state, at + n, at, symbol))
            for _, (other, m) in arcs[k + 1 :]:
                open_pairs.append((to, other, at + n, at + m, None))
        # after the edit both sides read the same symbols
        while open_pairs:
            p, q, i, j, barred = open_pairs.pop()
            if p == q:
                yield from ((i + t, j + t) for t in range(a.words[p]))
                continue
            if a.final[p] and a.final[q]:
                yield i, j
            here, there = a.arcs[p], a.arcs[q]
            for symbol in here if len(here) <= len(there) else there:
                if symbol != barred and symbol in here and symbol in there:
                    (u, n), (v, m) = here[symbol], there[symbol]
                    open_pairs.append((u, v, i + n, j + m, None))


def _near(batches):
    """Per word of a partition its near words there: how many, and the most frequent (the smallest of ties)."""
    for path in _by_path(batches):
        size, seen = path[0]["size"], path[0]["seen"]
        rests = sorted((r["word"][r["start"] : r["end"]], r["word"], r["n"]) for r in path)
        if len(rests) < 2:
            continue
        found: dict[str, list] = {}
        for i, j in accepted_pairs(Acceptor([r[0] for r in rests])):
            (x, u, n), (y, v, m) = rests[i], rests[j]
            if len(x) < size and len(y) < size:
                continue  # two words of the shorter length meet in a partition of their own
            if any(u[s["at"] : s["at"] + s["len"]] == v[s["at"] : s["at"] + s["len"]] for s in seen):
                continue
            for word, other, count in ((u, v, m), (v, u, n)):
                best = found.setdefault(word, [0, -count, other])
                best[0] += 1
                if (-count, other) < (best[1], best[2]):
                    best[1:] = [-count, other]
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.string()), pa.array([b[0] for b in found.values()], pa.int64()),
                    pa.array([{"m": b[1], "word": b[2]} for b in found.values()], pa.struct([("m", pa.int64()), ("word", pa.string())])),
                ], ["word", "n_near", "best"],
            )


def _by_path(batches) -> Iterator[list[dict]]:
    """Rows of one partition after the other, from batches sorted by ``path``."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["path"] != row["path"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def near_words(vocab: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """``(word, n_near, best)`` of all words with near words; ``best`` is ``(-n, word)`` of the most frequent."""
    dealt = partitions(vocab, most)
    tasks = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(tasks, "path").sortWithinPartitions("path").mapInArrow(
        _near, "word string, n_near bigint, best struct<m:bigint,word:string>"
    )
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, times: int = 2,
    most: int = PARTITION_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of the vocabulary.

    ``form`` is the near word (one code point inserted, deleted or replaced) with the largest
    count, the smallest in code-point order of ties, if it is at least ``times`` as frequent; else
    null. ``root`` follows forms to the last. Counts grow along a chain, so it ends, and roots are
    found by doubling steps.

    - Null, empty and wordless texts add nothing; texts are read whole, whatever their length.
    - Every row counts, repeated rows and rows that share an id too. A null id is the empty string
      in the checksum that decides which runs are worn.
    - No words give an empty result. Other columns are ignored, so their names cannot clash.
    """
    session(docs.sparkSession)
    if times < 2:
        raise ValueError("times must be at least 2, so that forms grow more frequent and end")
    vocab = stored(vocabulary(docs, least_length, least_count, one_in, id_col, text_col), "vocabulary")
    near = near_words(vocab, most)
    frequent = -F.col("best.m") >= times * F.col("n")
    words = stored(
        vocab.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"),
            F.when(frequent, -F.col("best.m")).alias("form_n"),
        ), "forms",
    )
    # only words with a form move; all others are their own roots
    steps = words.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        ), "roots")
        if not steps.where("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    return words.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
