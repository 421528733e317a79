"""Quality rules as weak supervision: rules vote or abstain, and a posterior takes the place of all-must-pass.

1. Each document is measured once (words, symbols, repeated lines and words, letters, line ends),
   and each rule votes fine (1), bad (-1) or abstains (0).
2. Votes are counted by pattern over all documents that pass the base limits. Expectation-maximisation on the table of
   patterns estimates for each rule how often its vote is right on fine and on bad documents, and
   the share of fine documents. Abstaining says nothing, and no rule is taken to be worse than chance.
3. A document is kept if it passes the base limits and its posterior probability to be fine is at
   least one half.

Patterns are at most 3 to the number of rules; nothing else leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.store import saved

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
ROUNDS = 60
LEAST_FINE = 0.97
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("word_length", "symbols", "lettered", "repeated_lines", "repeated_words", "capitals", "doubled_marks", "line_ends", "common_words")

# Frequent words of some languages; a text that has none of them is not judged by this rule.
COMMON = (
    "the of and to in that is was for it with as on be at by are from or have "
    "der die und das von den mit ist des nicht ein eine zu auf als "
    "el la los que las una por con para su del es no "
    "le les et des une du dans qui par pour sur est pas au"
).split()

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = W._class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER, _LOWER = W._class((0x41, 0x5A)), W._class((0x61, 0x7A))
_MARK = W._class((0x21, 0x2D), (0x2F, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # ASCII punctuation but the full stop
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:;\"')]}"]] = True


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.sort(W.Slice(0, data, np.array([0, len(data)])).words(W.NOT_SPACE).hashes())


_COMMON = _word_hashes(COMMON)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _equal_to_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occurred before, and which occur more than once."""
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = again
    shared[order[1:]] = again
    shared[order[:-1]] |= again
    return later, shared


def repeated_words(hashes: np.ndarray, text: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """True for words inside a window of ``size`` words that its text holds twice or more."""
    ends = np.arange(size - 1, len(hashes))
    ends = ends[ends - bounds[:-1][text[ends]] >= size - 1]
    _, shared = _equal_to_earlier(W.context_hashes(W.word_prefix(hashes), ends, size, text))
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, ends[shared] - size + 1, 1)
    np.add.at(edge, ends[shared] + 1, -1)
    return np.cumsum(edge)[:-1] > 0


@dataclass
class Measured:
    """One entry per text of a slice."""

    base: dict[str, np.ndarray]
    lettered: np.ndarray
    upper: np.ndarray
    letters: np.ndarray
    doubled: np.ndarray
    lines: np.ndarray
    ended: np.ndarray
    common: np.ndarray


def measure(part: W.Slice) -> Measured:
    data, bounds = part.data, part.bounds
    words = part.words(W.NOT_SPACE)
    prefix = W.prefix_hash(data)
    hashes = words.hashes(prefix)
    n_words = words.counts()
    text = np.repeat(np.arange(len(part)), n_words)
    # Lines end at line feeds and at the end of the text; those without a word do not count.
    feeds = np.flatnonzero(data == 0x0A)
    line_end = np.sort(np.concatenate([feeds, bounds[1:]]))
    owner = np.repeat(np.arange(len(part)), np.diff(np.searchsorted(feeds, bounds)) + 1)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    head = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=bool)
    line_start[head] = bounds[owner[head]]
    first, last = np.searchsorted(words.starts, line_start), np.searchsorted(words.starts, line_end)
    full = last > first
    line_start, line_end, owner, last = line_start[full], line_end[full], owner[full], last[full]
    dup, _ = _equal_to_earlier(W.span_hash(prefix, line_start, line_end) ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))
    per_text = lambda flags, of: np.bincount(of[flags], minlength=len(part))
    last_byte = data[words.ends - 1] if len(text) else data[:0]
    doubled = np.zeros(len(text), dtype=bool)
    long_enough = words.ends - words.starts >= 2
    doubled[long_enough] = _MARK[last_byte[long_enough]] & (data[words.ends[long_enough] - 2] == last_byte[long_enough])
    letter_count = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    lettered = letter_count[words.ends] > letter_count[words.starts]
    at = np.minimum(np.searchsorted(_COMMON, hashes), len(_COMMON) - 1)
    base = {
        "n_words": n_words,
        "word_chars": _sums(W.NOT_SPACE[data] & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _sums(_SYMBOL[data], bounds),
        "n_dup_lines": per_text(dup, owner),
        "n_repeat_words": per_text(repeated_words(hashes, text, words.bounds), text),
    }
    upper, lower = _sums(_UPPER[data], bounds), _sums(_LOWER[data], bounds)
    return Measured(
        base, per_text(lettered, text), upper, upper + lower, per_text(doubled, text), np.bincount(owner, minlength=len(part)),
        per_text(_END[last_byte[last - 1]] if len(last) else full[full], owner), per_text(_COMMON[at] == hashes, text),
    )


def votes(m: Measured) -> np.ndarray:
    """Votes of :data:`RULES`, one row per text: 1 fine, -1 bad, 0 no opinion. Texts without words get none."""
    n = np.maximum(m.base["n_words"], 1)
    length = m.base["word_chars"] / n
    symbols, lettered = m.base["n_symbols"] / n, m.lettered / n
    lines, dup = m.lines, m.base["n_dup_lines"] / np.maximum(m.lines, 1)
    repeated, capitals = m.base["n_repeat_words"] / n, m.upper / np.maximum(m.letters, 1)
    doubled, ended, common = m.doubled / n, m.ended / np.maximum(lines, 1), m.common / n
    fine_bad = (
        ((length >= 3) & (length <= 10), (length < 2.5) | (length > 12)),
        (symbols <= 0.02, symbols > 0.1),
        (lettered >= 0.9, lettered < 0.8),
        ((lines >= 2) & (dup == 0), dup > 0.3),
        (repeated <= 0.03, repeated > 0.12),
        ((m.letters > 0) & (capitals <= 0.2), capitals > 0.5),
        (doubled <= 0.02, doubled > 0.1),
        (ended >= 0.6, (lines >= 5) & (ended < 0.1)),
        (common >= 0.1, common < 0),  # speaks for a text only
    )
    cast = np.stack([fine.astype(np.int8) - bad.astype(np.int8) for fine, bad in fine_bad], axis=1)
    return cast * (m.base["n_words"] > 0)[:, None]


@dataclass
class Accuracies:
    """Chance that a vote is right on fine and on bad documents, by rule, and the share of fine documents."""

    fine: np.ndarray
    bad: np.ndarray
    share: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability to be fine of each row of votes."""
        yes, no = patterns == 1, patterns == -1
        gain = yes @ np.log(self.fine / (1 - self.bad)) + no @ np.log((1 - self.fine) / self.bad)
        return 1 / (1 + np.exp(-np.clip(gain + np.log(self.share / (1 - self.share)), -50, 50)))


def fit_rules(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over patterns of votes and how many documents cast them.

    It starts from rules that are right in 98 of 100 votes on fine documents and in six of ten on bad
    ones. A few fictitious votes keep rules with few votes near that. Accuracies on fine documents
    stay between ``LEAST_FINE`` and 0.999: limits are set where fine documents rarely lie. On bad
    documents they may be as low as 0.02, as most rules know one kind of bad documents only, but
    never so low that a bad vote would speak for a document.
    """
    n_rules = patterns.shape[1]
    now = Accuracies(np.full(n_rules, 0.98), np.full(n_rules, 0.6), 0.9)
    yes, no = (patterns == 1).astype(float), (patterns == -1).astype(float)
    for _ in range(rounds if len(patterns) else 0):
        p = now.posterior(patterns)
        good, poor = p * counts, (1 - p) * counts
        fine = np.clip((good @ yes + 49) / (good @ (yes + no) + 50), LEAST_FINE, 0.999)
        bad = (poor @ no + 0.6) / (poor @ (yes + no) + 1)
        bad = np.clip(bad, np.maximum(0.02, 1.2 * (1 - fine)), 0.999)
        now = Accuracies(fine, bad, float(np.clip((good.sum() + 9) / (counts.sum() + 10), 0.01, 0.99)))
    return now


def _coded(cast: np.ndarray) -> np.ndarray:
    return (cast.astype(np.int64) + 1) @ 3 ** np.arange(cast.shape[1])


def _decoded(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1).astype(np.int8)


def _vote_rows(names: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("_text")):
                m = measure(part)
                carried = [batch.column(c).slice(part.first, len(part)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*carried, *[pa.array(m.base[c].astype(np.int64)) for c in MEASURES], pa.array(_coded(votes(m)))],
                    names=[*names, *MEASURES, "pattern"],
                )

    return run


def measured_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, the base measures and the coded pattern of votes of every row, written once."""
    W.bounded_batches(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(columns, names, strict=True)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = rows.select(*names).schema
    for c in (*MEASURES, "pattern"):
        schema = schema.add(c, "long")
    return saved(rows.mapInArrow(_vote_rows(names), schema), "measures")


def base_failed() -> Column:
    """The limits that no vote can outweigh: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def weigh_rules(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, the base measures, base_failed, p_fine, votes (by rule) and kept for every row of ``docs`` (text).

    A null or empty text has no words, fails the base limits and has no votes; its p_fine is the
    share of fine documents. Repeated rows each give a row, null ids are judged like others, and
    an empty table gives an empty result. Columns that are not asked for are left behind; names
    of ``columns`` may not be those of the results. Lines and windows are compared by 64-bit
    hashes within one text.
    """
    spark = docs.sparkSession
    rows = measured_documents(docs, columns)
    counted = rows.groupBy("pattern").agg(F.count_if(~base_failed()).alias("n")).toPandas().sort_values("pattern")
    codes = counted["pattern"].to_numpy(dtype=np.int64)
    fitted = fit_rules(_decoded(codes), counted["n"].to_numpy(dtype=float))
    known = [(int(c), float(p), [int(v) for v in cast]) for c, p, cast in zip(codes, fitted.posterior(_decoded(codes)), _decoded(codes), strict=True)]
    table = F.broadcast(spark.createDataFrame(known, "pattern long, p_fine double, cast array<int>"))  # at most 3 ** len(RULES) rows
    failed = base_failed()
    names = F.array(*[F.lit(r) for r in RULES])
    return rows.join(table, "pattern").select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], *MEASURES, failed.alias("base_failed"), "p_fine",
        F.map_from_arrays(names, "cast").alias("votes"), (~failed & (F.col("p_fine") >= 0.5)).alias("kept"),
    )


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, p_fine (to nine digits) and kept for every row."""
    return weigh_rules(docs).select("doc_id", *MEASURES, "base_failed", F.round("p_fine", 9).alias("p_fine"), "kept")
