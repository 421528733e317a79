"""Periodic runs of words: stretches that repeat a period at least four times.

A sparse dynamic program over diagonals. A diagonal is a lag q; its state is the number of words
up to the present one that equal the word q before them. Each word raises the diagonals of its
earlier occurrences, and a diagonal that is not raised ends: if its stretch is long enough, it is
emitted as a run at once.

All earlier occurrences of a frequent word would be quadratic. What keeps the program sparse is the
context: a level compares words together with the k - 1 words before them, and raises only the
diagonal of the nearest earlier occurrence of that context. For lags q with 2q - 1 <= k <= 3q this
loses nothing. Inside a run of smallest period q, two equal contexts less than q apart would give
the run a smaller period (Fine and Wilf), so the nearest occurrence lies exactly q back; and a run
of 4q words holds at least 3q - k + 1 such words. The levels grow by half each, so every word
raises O(log n) diagonals; words whose context does not repeat leave all later levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W

MIN_WORDS = 6
MIN_PERIODS = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

# Maps (doc_id, number of words) to the word that each place takes, or to None for the text as it is.
Rewrite = Callable[[int | None, int], "np.ndarray | None"]


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; starts count through all texts.

    ``words`` are 64-bit hashes of the words of several texts, text i has ``bounds[i]:bounds[i + 1]``.
    """
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    first, n = bounds[:-1][text], counts[text]
    prefix = W.word_prefix(words)
    at, below, found = np.arange(len(words)), 0, []
    while True:
        k = 3 * (below + 1)
        most = (k + 1) // 2
        at = at[(at - first[at] >= k - 1) & (n[at] >= max(MIN_WORDS, MIN_PERIODS * (below + 1)))]
        if len(at) < 2:
            break
        keys = W.context_hashes(prefix, at, k, text)
        order = np.argsort(keys, kind="stable")
        again = keys[order][1:] == keys[order][:-1]
        lag = np.zeros(len(at), dtype=np.int64)
        lag[order[1:]] = np.where(again, at[order][1:] - at[order][:-1], 0)
        # Diagonals: neighbouring words that raise the same lag.
        raised = (lag > below) & (lag <= most)
        place, q = at[raised], lag[raised]
        if len(place):
            new = np.ones(len(place), dtype=bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (q[1:] != q[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(place)) - 1
            q = q[begin]
            length = place[end] - place[begin] + k + q
            enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            found.append(np.stack([place[begin] - k + 1 - q, length, q])[:, enough])
        repeats = np.zeros(len(at), dtype=bool)
        repeats[order[1:]] = again
        repeats[order[:-1]] |= again
        at, below = at[repeats], most
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    runs = runs[:, np.lexsort((runs[2], runs[0]))]
    return runs[0], runs[1], runs[2]


def later_periods(runs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """True for the words that some run contains after its first period."""
    start, length, period = runs
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _run_rows(rewrite: Rewrite | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                ids = batch.column("doc_id").slice(part.first, len(part))
                words = part.words(W.NOT_SPACE)
                bounds = words.bounds
                takes, changed = np.arange(bounds[-1]), set()
                if rewrite is not None:
                    for i, (doc_id, n) in enumerate(zip(ids.to_pylist(), words.counts().tolist(), strict=True)):
                        own = rewrite(doc_id, n) if n else None
                        if own is not None:
                            takes[bounds[i] : bounds[i + 1]] = bounds[i] + own
                            changed.add(i)
                runs = find_runs(words.hashes()[takes], bounds)
                gone = later_periods(runs, len(takes))
                lost = np.add.reduceat(np.append(gone, False), bounds[:-1]) * (words.counts() > 0)
                collapsed = []
                for i in range(len(part)):
                    own = part.bytes_of(i).split()
                    if i in changed or lost[i]:
                        a, b = bounds[i], bounds[i + 1]
                        own = [own[w] for w in (takes[a:b][~gone[a:b]] - a).tolist()]
                    collapsed.append(b" ".join(own).decode())
                cut = np.searchsorted(runs[0], bounds)
                owner = np.repeat(np.arange(len(part)), np.diff(cut))
                rows = pa.StructArray.from_arrays([pa.array(runs[0] - bounds[owner]), pa.array(runs[1]), pa.array(runs[2])], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rows), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of ``docs`` (doc_id, text).

    ``runs`` are the (start, length, period) of all stretches of consecutive words with smallest
    period q and at least max(6, 4q) words that no neighbouring word extends, by start and period.
    ``collapsed`` is the text without the words that a run contains after its first period, joined
    by single spaces. A null, empty or blank text has no words and no runs. Repeated rows each give
    a row, a null doc_id stays null, an empty table gives an empty result, other columns are
    ignored. Texts are compared by 64-bit hashes of words and of runs of words within one text.
    ``rewrite`` replaces the words of chosen texts by other words of the same text beforehand.
    """
    W.bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_run_rows(rewrite), schema)


def echo(doc_id: int | None, n: int) -> np.ndarray | None:
    """One text in ten, by the checksum of its id, repeats a stretch of its own words to its end."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % period])


def _longest(field: str) -> Column:
    best = F.aggregate(
        F.col("runs"),
        F.element_at("runs", 1),
        lambda best, x: F.when(x["length"] > best["length"], x).otherwise(best),
    )
    return F.when(F.size("runs") > 0, best[field])


def run_report(docs: DataFrame) -> DataFrame:
    """The runs of echoed texts (see ``echo``; a null doc_id echoes nothing) with digests of runs and collapsed text."""
    found = periodic_runs(docs, echo)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "collapsed", *[_longest(f).alias(f) for f in ("start", "length", "period")])
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period",
        F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
