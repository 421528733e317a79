"""The 22 named feature extractors: text (or trace, or embedding columns) to ``features``.

Dense extractors give ``ARRAY<DOUBLE>``, word-count ones ``STRUCT<indices, values>``.
``fit`` learns from benign rows; ``transform`` adds the column without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.functions import lexical, pooling, roles, tokens, traces
from vigilar.functions.keywords import CORE_KEYWORDS
from vigilar.functions.models import ModelHook, embed
from vigilar.operators.fingerprint import table_digest

SPARSE = "struct<indices: array<bigint>, values: array<double>>"
AE_CV_FEATURES = 20_000  # fixed value: vocabulary cap of word counts feeding the autoencoder


class Extractor:
    """Base: dense, text in one column. ``dim`` is known after ``fit`` (``None``: open vocabulary)."""

    name = ""
    observes_insider = False
    stateless = False

    def __init__(self, text: str = "full_query"):
        self.text = text

    def fit(self, rows: DataFrame) -> Extractor:
        return self

    def transform(self, rows: DataFrame, out: str = "features") -> DataFrame:
        raise NotImplementedError

    @property
    def dim(self) -> int | None:
        return len(self.feature_names())

    def feature_names(self) -> tuple[str, ...]:
        raise NotImplementedError

    def inputs(self, rows: DataFrame) -> list[str] | None:
        """Columns that the features depend on; ``None`` for all."""
        return [self.text]

    def state(self) -> dict:
        return {}

    def load_state(self, state: dict) -> Extractor:
        return self

    def table(self) -> DataFrame | None:
        """Learned state that grows with the training rows; saved next to the model as a table."""
        return None

    def load_table(self, table: DataFrame) -> Extractor:
        return self

    def state_fingerprint(self) -> str:
        """Digest of what was learned; part of every feature-store key."""
        table = self.table()
        learned = json.dumps(self.state(), sort_keys=True) + (table_digest(table) if table is not None else "")
        return hashlib.blake2b(learned.encode(), digest_size=16).hexdigest()


class LexicalExtractor(Extractor):
    name = "li"
    stateless = True

    def transform(self, rows, out="features"):
        return lexical.li_vector(rows, self.text, out)

    def feature_names(self):
        return lexical.LI_FEATURES


class TokenClassExtractor(Extractor):
    """Learns the punctuation runs of the training rows."""

    name = "loginov"

    def __init__(self, text="full_query", keywords=CORE_KEYWORDS):
        super().__init__(text)
        self.keywords = keywords
        self.runs: DataFrame | None = None

    def fit(self, rows):
        from vigilar.session import stable

        self.runs = stable(tokens.learn_special_runs(rows, self.text))
        return self

    def transform(self, rows, out="features"):
        if self.runs is None:
            raise RuntimeError("fit the extractor first")
        wide = tokens.loginov_columns(rows, self.runs, self.text, self.keywords)
        vector = F.array(*[F.col(n).cast("double") for n in tokens.LOGINOV_FEATURES])
        return wide.select(*rows.columns, vector.alias(out))

    def feature_names(self):
        return tokens.LOGINOV_FEATURES

    def table(self):
        return self.runs

    def load_table(self, table):
        self.runs = table
        return self


def _count_udf(index: dict[str, int], idf: list[float] | None):
    """Word list to sparse counts over a fixed vocabulary; with ``idf`` weighted and unit length."""

    def encode(words: pd.Series) -> pd.DataFrame:
        idx, val = [], []
        for ws in words:
            counts = Counter(index[w] for w in ws if w in index) if ws is not None else {}
            at = sorted(counts)
            v = np.asarray([counts[i] for i in at], dtype=float)
            if idf is not None and len(at):
                v = v * np.asarray([idf[i] for i in at])
                v = v / np.sqrt((v * v).sum())
            idx.append(at)
            val.append(v.tolist())
        return pd.DataFrame({"indices": idx, "values": val})

    return F.pandas_udf(encode, SPARSE)


def _prefixed(items: Column, prefix: str) -> Column:
    return F.transform(items, lambda w: F.concat(F.lit(prefix), w))


class WordCountExtractor(Extractor):
    """Word counts over a learned vocabulary.

    With ``max_features`` the vocabulary is an alphabetical list of that many words at
    most. Without a cap it is open-ended: it stays a table, words get hashed indices and
    the transform joins against it. ``closed`` indexes all words, for heads that need a width.
    """

    name = "cv"

    def __init__(self, text="full_query", max_features: int | None = None, closed: bool = False):
        super().__init__(text)
        self.max_features, self.closed = max_features, closed
        self.terms: list[str] | None = None
        self.vocab: DataFrame | None = None

    def _word_column(self) -> Column:
        return tokens.words(self.text)

    def fit(self, rows):
        from vigilar.session import stable

        vocab = self._vocabulary(rows)
        if self.max_features is not None or self.closed:
            self.terms = tokens.index_terms(vocab)
        else:
            self.vocab = stable(vocab.select("term"))
        return self

    def _vocabulary(self, rows: DataFrame) -> DataFrame:
        return tokens.vocabulary(self._counts(rows), self.max_features)

    def _counts(self, rows: DataFrame) -> DataFrame:
        return tokens.term_counts(rows, self.text)

    def transform(self, rows, out="features"):
        if self.terms is not None:
            encode = _count_udf({t: i for i, t in enumerate(self.terms)}, self._weights())
            return rows.withColumn(out, encode(self._word_column()))
        if self.vocab is None:
            raise RuntimeError("fit the extractor first")
        counts = self._counts(rows).join(self.vocab, "term", "left_semi")
        pair = F.struct(F.xxhash64("term").alias("i"), F.col("n").cast("double").alias("v"))
        packed = counts.groupBy("row_id").agg(F.array_sort(F.collect_list(pair)).alias("_p"))
        packed = packed.select(
            "row_id",
            F.struct(
                F.transform("_p", lambda p: p["i"]).alias("indices"), F.transform("_p", lambda p: p["v"]).alias("values")
            ).alias(out),
        )
        empty = F.from_json(F.lit('{"indices": [], "values": []}'), SPARSE)
        return rows.join(packed, "row_id", "left").withColumn(out, F.coalesce(out, empty))

    def _weights(self) -> list[float] | None:
        return None

    @property
    def dim(self):
        return None if self.terms is None else len(self.terms)

    def feature_names(self):
        return tuple(self.terms or ())

    def state(self):
        return {} if self.terms is None else {"terms": self.terms}

    def load_state(self, state):
        self.terms = state.get("terms")
        return self

    def table(self):
        return self.vocab

    def load_table(self, table):
        self.vocab = table
        return self


class TfidfExtractor(WordCountExtractor):
    name = "tfidf"

    def __init__(self, text="full_query", max_features: int = tokens.DEFAULT_TFIDF_FEATURES):
        super().__init__(text, max_features)
        self.idf: list[float] = []

    def fit(self, rows):
        counts = tokens.term_counts(rows, self.text)
        vocab = tokens.vocabulary(counts, self.max_features).collect()
        n_docs = rows.count()
        found = sorted((r["term"], r["df"]) for r in vocab)
        self.terms = [t for t, _ in found]
        self.idf = [float(np.log((1 + n_docs) / (1 + df)) + 1.0) for _, df in found]
        return self

    def _weights(self):
        return self.idf

    def state(self):
        return {"terms": self.terms, "idf": self.idf}

    def load_state(self, state):
        self.terms, self.idf = state["terms"], state["idf"]
        return self


class RoleViewExtractor(WordCountExtractor):
    """Counts over the three role views; every view has its own vocabulary."""

    name = "kakisim"

    def __init__(self, text="full_query", views=("T", "C", "E"), min_df: int = 1, max_features=None, keywords=CORE_KEYWORDS, closed: bool = False):
        super().__init__(text, max_features, closed)
        self.views, self.min_df, self.keywords = tuple(views), min_df, keywords

    def _counts(self, rows):
        counts = roles.view_term_counts(rows, self.views, self.text, self.keywords)
        return counts.select("row_id", F.concat("view", F.lit(":"), "term").alias("term"), "n")

    def _vocabulary(self, rows):
        found = roles.view_vocabulary(roles.view_term_counts(rows, self.views, self.text, self.keywords), self.min_df)
        if self.max_features is not None:
            place = F.row_number().over(Window.partitionBy("view").orderBy(F.col("tf").desc(), "term"))
            found = found.withColumn("_r", place).where(F.col("_r") <= self.max_features)
        return found.select(F.concat("view", F.lit(":"), "term").alias("term"))

    def transform(self, rows, out="features"):
        if self.terms is None:
            return super().transform(rows, out)
        viewed = roles.view_texts(roles.tagged_tokens(rows, self.text, self.keywords, "_tagged"), "_tagged")
        marked = [_prefixed(tokens.words(v), f"{v}:") for v in self.views]
        encode = _count_udf({t: i for i, t in enumerate(self.terms)}, None)
        return viewed.withColumn(out, encode(F.concat(*marked))).select(*rows.columns, out)


class TraceExtractor(Extractor):
    """Parser-trace features of one tag model, followed by the lexical ones."""

    observes_insider = True
    stateless = True

    def __init__(self, mode: str, text="full_query", keywords=CORE_KEYWORDS):
        super().__init__(text)
        traces.tag_names(mode)
        self.mode, self.keywords, self.name = mode, keywords, f"trace-{mode}"

    def inputs(self, rows):
        return None

    def transform(self, rows, out="features"):
        traced = traces.trace_vector(rows, self.mode, self.keywords, out="_trace")
        both = lexical.li_vector(traced, self.text, "_li")
        return both.withColumn(out, F.concat("_trace", "_li")).select(*rows.columns, out)

    def feature_names(self):
        return traces.trace_feature_names(self.mode) + lexical.LI_FEATURES


class EmbeddingExtractor(Extractor):
    """Takes a model's output columns and applies the model's pooling, or runs a caller's model.

    ``pool``: ``none`` and ``l2`` read the sentence vector column, ``first``, ``mean`` and
    ``suffix`` read token states (with a 0/1 mask column for the last two). With ``model``
    (a ``ModelHook``) the vectors come from the text by that model; ``width`` is then what it gives.
    """

    def __init__(self, name: str, width: int, pool: str = "none", vector="embedding", states="token_states", mask="mask", text="full_query", model: ModelHook | None = None):
        super().__init__(text)
        self.name, self.width, self.pool, self.model = name, width, pool, model
        self.vector, self.states, self.mask = vector, states, mask

    def inputs(self, rows):
        if self.model is not None:
            return [self.text]
        return [c for c in (self.vector, self.states, self.mask) if c in rows.columns]

    def transform(self, rows, out="features"):
        if self.model is not None:
            return rows.withColumn(out, embed(self.model, self.pool, self.text))
        if self.pool in ("none", "l2") or self.states not in rows.columns:
            value = F.col(self.vector).cast("array<double>")
            value = pooling.l2_normalize(value) if self.pool == "l2" else value
        elif self.pool == "first":
            value = pooling.first_token_pool(self.states)
        elif self.pool == "mean":
            value = pooling.masked_mean_pool(self.states, self.mask)
        else:
            value = pooling.suffix_mean_pool(self.states, F.aggregate(self.mask, F.lit(0), lambda a, m: a + m.cast("int")))
        return rows.withColumn(out, value)

    @property
    def dim(self):
        return self.width

    def fit(self, rows):
        if self.model is not None:
            first = self.transform(rows.limit(1)).select("features").first()
            self.width = self.width if first is None else len(first[0])
            return self
        first = rows.select(self.vector if self.vector in rows.columns else self.states).first()
        if first is not None and first[0]:
            self.width = len(first[0]) if self.vector in rows.columns else len(first[0][0])
        return self

    def feature_names(self):
        return tuple(f"e{i}" for i in range(self.width))

    def state(self):
        return {"width": self.width} if self.model is None else {"width": self.width, "model": self.model.name}

    def load_state(self, state):
        self.width = state["width"]
        return self


@dataclass(frozen=True)
class Entry:
    """Registry row: label, factory, whether features come from a pretrained model."""

    label: str
    make: Callable[..., Extractor]
    pretrained: bool = False
    observes_insider: bool = False
    slow: bool = False
    tags: tuple[str, ...] = field(default=())


def _emb(name: str, width: int, pool: str = "none") -> Callable[..., Extractor]:
    return lambda **kw: EmbeddingExtractor(name, width, pool, **kw)


def _trace(mode: str) -> Callable[..., Extractor]:
    return lambda **kw: TraceExtractor(mode, **kw)


# Names, labels, widths of the pretrained vectors and their pooling.
EXTRACTORS: dict[str, Entry] = {
    "li": Entry("Li", LexicalExtractor),
    "loginov": Entry("Loginov", TokenClassExtractor),
    "cv": Entry("CountVectorizer", WordCountExtractor),
    "tfidf": Entry("TF-IDF", TfidfExtractor),
    "kakisim": Entry("Kakisim", RoleViewExtractor),
    **{f"trace-{m}": Entry(f"Trace ({m})", _trace(m), observes_insider=True) for m in traces.MODES},
    "sbert": Entry("SecureBERT", _emb("sbert", 768), True),
    "sbert2": Entry("SecureBERT2", _emb("sbert2", 768, "first"), True),
    "roberta": Entry("RoBERTa-base", _emb("roberta", 768), True),
    "codebert": Entry("CodeBERT", _emb("codebert", 768), True),
    "modernbert": Entry("ModernBERT-base", _emb("modernbert", 768, "first"), True),
    "codet5": Entry("CodeT5+", _emb("codet5", 256), True),
    "flan-t5": Entry("Flan-T5-Small", _emb("flan-t5", 512, "mean"), True),
    "sentbert": Entry("SentenceBERT-mpnet", _emb("sentbert", 768), True),
    "qwen3-emb": Entry("Qwen3-Emb-0.6B", _emb("qwen3-emb", 1024, "l2"), True, slow=True),
    "llm2vec": Entry("LLM2Vec-Mistral-7B", _emb("llm2vec", 4096, "suffix"), True, slow=True),
}
SLOW_FRACTION = 1 / 5  # fixed value: share of rows a caller may evaluate the slow extractors on


def build_extractor(name: str, **options) -> Extractor:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown feature extractor {name!r}; known: {sorted(EXTRACTORS)}")
    return EXTRACTORS[name].make(**options)


def observes_insider(name: str) -> bool:
    """Whether the collector behind an extractor sees insider traffic; unknown names do not."""
    return name in EXTRACTORS and EXTRACTORS[name].observes_insider


def extractor_dimension(spark) -> DataFrame:
    """(extractor, label, pretrained, observes_insider, slow)."""
    rows = [(n, e.label, e.pretrained, e.observes_insider, e.slow) for n, e in EXTRACTORS.items()]
    return spark.createDataFrame(
        rows, "extractor string, label string, pretrained boolean, observes_insider boolean, slow boolean"
    )
