"""Quality classifier from weak labels: junk and toxic documents.

1. Heuristic labellers vote on every document: 1 (bad), -1 (fine) or 0 (no opinion). Known
   labels, where a document has them, are one more labeller.
2. Votes are counted by pattern, over all documents. Expectation-maximisation on the table of
   patterns (at most 3 to the number of labellers) estimates how often each labeller casts each
   vote on bad and on fine documents, and the posterior label of every pattern.
3. A bounded sample of ``FIT_ROWS`` documents with posterior labels trains a linear scorer over
   hashed words, word beginnings and text statistics; it scores every whole document.

Word beginnings that mark toxic documents are learned from at most ``LABELLED_ROWS`` labelled rows.
Both bounds limit fitting only; votes, counts, the posterior and scores cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.store import saved, smallest_by_hash

FIT_ROWS = 12_000
LABELLED_ROWS = 20_000
STEM_BYTES = 5
STEM_MIN_DOCS = 4
STEM_MAX_FINE = 0.02
BITS = 18
EPOCHS = 120
BIAS = 0

INSULTS = (
    "asshole bastard bitch clown cretin disgusting dumb dumbass filth fool freak garbage idiot idiotic imbecile jerk "
    "loser moron moronic pathetic pig scum scumbag shithead stupid trash ugly vermin worthless"
).split()
JUNK_VOTES = ("symbols", "bars", "shouting", "repeats", "plain", "quality")
TOXIC_VOTES = ("insults", "stems", "toxic")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#$%&*!|<>{}[]\\^~=@_+"]] = True
_STEM_SALT, _STAT_SALT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return W.span_hash(W.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


_INSULT_HASHES = np.sort(np.array([_word_hash(w) for w in INSULTS], dtype=np.uint64))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


@dataclass
class Measures:
    """Texts of a slice: words, word beginnings and shares, one entry per text."""

    bounds: np.ndarray
    words: np.ndarray
    stems: np.ndarray  # 0 where a word is too short
    n_words: np.ndarray
    symbols: np.ndarray
    bars: np.ndarray
    upper: np.ndarray
    repeats: np.ndarray
    insults: np.ndarray
    stem_hits: np.ndarray


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(part: W.Slice, toxic_stems: np.ndarray) -> Measures:
    raw, lowered = part.data, part.lowered()
    spaced = lowered.words(W.NOT_SPACE)
    words = lowered.words(W.ALNUM)
    prefix = W.prefix_hash(lowered.data)
    tokens, h = spaced.hashes(prefix), words.hashes(prefix)
    stems = W.span_hash(prefix, words.starts, np.minimum(words.starts + STEM_BYTES, words.ends)) ^ _STEM_SALT
    stems[words.ends - words.starts < STEM_BYTES] = 0
    again = np.zeros(len(tokens), dtype=bool)
    again[1:] = tokens[1:] == tokens[:-1]
    bar = (spaced.ends - spaced.starts == 1) & (lowered.data[spaced.starts] == ord("|")) if len(tokens) else again
    letters = (raw >= 0x41) & (raw <= 0x5A)
    lower = (raw >= 0x61) & (raw <= 0x7A)
    n_bytes, n_tokens = np.maximum(np.diff(part.bounds), 1), np.maximum(spaced.counts(), 1)
    n_upper, n_lower = _sums(letters, part.bounds), _sums(lower, part.bounds)
    return Measures(
        words.bounds,
        h,
        stems,
        spaced.counts(),
        _sums(_SYMBOLS[raw], part.bounds) / n_bytes,
        _sums(bar, spaced.bounds) / n_tokens,
        n_upper / np.maximum(n_upper + n_lower, 1),
        _sums(again, spaced.bounds) / n_tokens,
        _sums(_member(h, _INSULT_HASHES), words.bounds),
        _sums(_member(stems, toxic_stems), words.bounds),
    )


def _ternary(bad: np.ndarray, fine: np.ndarray) -> np.ndarray:
    return bad.astype(np.int8) - (fine & ~bad).astype(np.int8)


def votes(m: Measures) -> dict[str, np.ndarray]:
    """Votes of the heuristic labellers: 1 bad, -1 fine, 0 no opinion.

    A text is junk of one kind or another, so what looks for one kind has no opinion on texts
    without it; that a text is fine is said by one labeller, which looks at all of them.
    """
    never = np.zeros(len(m.n_words), dtype=bool)
    return {
        "symbols": _ternary(m.symbols > 0.06, never),
        "bars": _ternary(m.bars > 0.2, never),
        "shouting": _ternary(m.upper > 0.5, never),
        "repeats": _ternary(m.repeats > 0.3, never),
        "plain": _ternary(never, (m.symbols < 0.02) & (m.bars < 0.02) & (m.upper < 0.2) & (m.repeats < 0.05)),
        "insults": _ternary(m.insults >= 2, m.insults == 0),
        "stems": _ternary(m.stem_hits >= 2, m.stem_hits < 2),
    }


def features(m: Measures) -> list[np.ndarray]:
    """Distinct hashed features of every text: words, word beginnings, bins of its statistics."""
    mask = np.uint64((1 << BITS) - 1)
    words, stems = (m.words & mask).astype(np.int32), (m.stems & mask).astype(np.int32)
    stats = [(10 * x).astype(np.int64) for x in (m.bars, m.upper, m.repeats)] + [(50 * m.symbols).astype(np.int64), np.minimum(m.insults, 3), np.minimum(m.stem_hits, 3)]
    keyed = [W.mix(x.astype(np.uint64) + np.uint64(1000 * (k + 1)) + _STAT_SALT) & mask for k, x in enumerate(stats)]
    keyed = np.array(keyed).astype(np.int32).T
    out = []
    for i in range(len(m.n_words)):
        a, b = m.bounds[i], m.bounds[i + 1]
        own = stems[a:b][m.stems[a:b] != 0]
        out.append(np.unique(np.concatenate([words[a:b], own, keyed[i], [BIAS]])).astype(np.int32))
    return out


def _vote_rows(stems_of) -> object:
    names = JUNK_VOTES[:-1] + TOXIC_VOTES[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stems_of.value
        for batch in batches:
            for part in W.slices(batch.column("text")):
                m = measure(part, known)
                cast = votes(m)
                ids = batch.column("doc_id").slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(cast[n].astype(np.int8)) for n in names]], names=["doc_id", *names])

    return run


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for part in W.slices(batch.column("text")):
            m = measure(part, np.zeros(0, dtype=np.uint64))
            own = [np.unique(m.stems[m.bounds[i] : m.bounds[i + 1]]) for i in range(len(part))]
            if own:
                flags = np.repeat(toxic[part.first : part.first + len(part)], [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(flags.astype(np.int64))], names=["stem", "toxic"])


def toxic_stems(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> np.ndarray:
    """Word beginnings that labelled toxic documents use and others do not (hashes, sorted)."""
    sample = smallest_by_hash(labels.where("doc_id is not null and toxic is not null"), limit, "doc_id")
    rows = docs.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("text", "toxic")
    counts = rows.mapInArrow(_stem_rows, "stem long, toxic long").groupBy("stem").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    marks = counts.where((F.col("stem") != 0) & (F.col("bad") >= STEM_MIN_DOCS) & (F.col("n") - F.col("bad") <= STEM_MAX_FINE * F.col("bad")))
    return np.sort(np.array([r[0] for r in marks.select("stem").collect()], dtype=np.int64).view(np.uint64))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows) and how many documents cast them.

    Returns the posterior of each pattern, the vote probabilities [class, labeller, vote + 1],
    and the share of bad documents. It starts from the votes of each pattern taken together.
    """
    n, m = patterns.shape
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    bad, fine = (patterns == 1).sum(axis=1), (patterns == -1).sum(axis=1)
    posterior = np.clip(np.where(bad > 0, 0.55 + 0.4 * bad / np.maximum(bad + fine, 1), 0.02), 0.02, 0.98)
    rates, prior = np.zeros((2, m, 3)), 0.5
    for _ in range(rounds if n else 0):
        prior = float(np.clip((posterior * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        for c, share in enumerate((1 - posterior, posterior)):
            cast = np.einsum("p,pmv->mv", share * counts, one_hot) + 0.5
            rates[c] = cast / cast.sum(axis=1, keepdims=True)
        score = [np.einsum("pmv,mv->p", one_hot, np.log(rates[c])) for c in (0, 1)]
        logit = np.log(prior / (1 - prior)) + score[1] - score[0]
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, prior


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic scorers of a bounded sample: full-batch Adagrad with soft thresholds."""
    own, goals = [], []
    for batch in batches:
        goals.append(np.stack([batch.column(c).to_numpy() for c in ("junk", "toxic")], axis=1))
        own += [np.frombuffer(x, dtype=np.int32) for x in batch.column("features").to_pylist()]
    if not own:
        return
    y, index = np.concatenate(goals), np.concatenate(own)
    starts = np.cumsum([0, *[len(x) for x in own]])[:-1]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    for task in (0, 1):
        w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        for _ in range(EPOCHS):
            z = np.add.reduceat(w[index], starts)
            gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, task]
            step = np.bincount(index, weights=gap[row], minlength=1 << BITS)
            seen += step * step
            rate = 0.3 / np.sqrt(seen)
            w -= rate * step
            keep_bias = w[BIAS]
            w = np.sign(w) * np.maximum(np.abs(w) - rate * 0.5, 0)
            w[BIAS] = keep_bias
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), task, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(w[used])], names=["task", "feature", "weight"])


def _feature_rows(stems_of) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stems_of.value
        for batch in batches:
            for part in W.slices(batch.column("text")):
                rows = [x.tobytes() for x in features(measure(part, known))]
                other = [batch.column(c).slice(part.first, len(part)) for c in ("junk", "toxic")]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *other], names=["features", "junk", "toxic"])

    return run


def _score_rows(model_of, names: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = model_of.value
        for batch in batches:
            for part in W.slices(batch.column("text")):
                m = measure(part, known)
                z = np.array([weights[:, x].sum(axis=1) for x in features(m)]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p[m.n_words == 0] = (1.0, 0.0)
                carried = [batch.column(c).slice(part.first, len(part)) for c in names]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(m.n_words), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*names, "n_words", "junk_score", "toxic_score"])

    return run


@dataclass
class Scorer:
    stems: np.ndarray
    weights: np.ndarray
    labellers: dict[str, tuple[tuple[str, ...], np.ndarray, float]]


def fit_scorer(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """Fit labellers on all documents and the scorer on a sample, as the module says."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    W.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    stems = toxic_stems(docs, known)
    stems_of = sc.broadcast(stems)
    names = JUNK_VOTES[:-1] + TOXIC_VOTES[:-1]
    cast = docs.mapInArrow(_vote_rows(stems_of), "doc_id long, " + ", ".join(f"{n} byte" for n in names))
    as_vote = lambda c, bad: F.when(F.col(c).isNull(), 0).when(F.col(c) == bad, 1).otherwise(-1).cast("byte")
    cast = cast.join(known, "doc_id", "left").withColumn("quality", as_vote("quality", 0)).withColumn("toxic", as_vote("toxic", 1))
    cast = saved(cast, "votes")
    labellers, out = {}, cast
    for kind, members in (("junk", JUNK_VOTES), ("toxic", TOXIC_VOTES)):
        counted = cast.groupBy(*members).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(list(members))
        patterns = counted[list(members)].to_numpy(dtype=np.int8).reshape(-1, len(members))
        posterior, rates, prior = fit_labellers(patterns, counted["n"].to_numpy(dtype=float))
        labellers[kind] = (members, rates, prior)
        rows = [(*map(int, p), float(x)) for p, x in zip(patterns, posterior, strict=True)]
        table = spark.createDataFrame(rows, ", ".join(f"{m} byte" for m in members) + f", p_{kind} double")
        out = out.join(F.broadcast(table), list(members))  # at most 3 ** len(members) rows
    goals = out.where("doc_id is not null").groupBy("doc_id").agg(F.max("p_junk").alias("junk"), F.max("p_toxic").alias("toxic"))
    goals = smallest_by_hash(goals, fit_rows, "doc_id")
    sample = docs.join(F.broadcast(goals), "doc_id").select("text", "junk", "toxic")
    rows = sample.mapInArrow(_feature_rows(stems_of), "features binary, junk double, toxic double")
    fitted = rows.orderBy(F.xxhash64("features"), "junk", "toxic").coalesce(1).mapInArrow(_train, "task int, feature int, weight double").collect()
    weights = np.zeros((2, 1 << BITS))
    for r in fitted:
        weights[r["task"], r["feature"]] = r["weight"]
    return Scorer(stems, weights, labellers)


def score(docs: DataFrame, scorer: Scorer, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, n_words, junk_score, toxic_score and kept for every row of ``docs``.

    A null text counts as an empty one; a text without words is junk. Repeated rows each give
    a row, null ids are scored like others, and an empty table gives an empty result.
    """
    W.bounded_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = rows.select(*names).schema.add("n_words", "long").add("junk_score", "double").add("toxic_score", "double")
    scored = rows.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast((scorer.stems, scorer.weights)), names), schema)
    scored = scored.withColumn("kept", (F.col("junk_score") < 0.5) & (F.col("toxic_score") < 0.5))
    return scored.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "n_words", "junk_score", "toxic_score", "kept")


def classify(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on ``docs`` and ``labels`` (doc_id, quality, toxic), then score every row of ``docs``."""
    return score(docs, fit_scorer(docs, labels), columns)
