"""Near duplicates by word shingles: universal hash minima, banding, signature and set verification, star components.

1. A document's set is the set of its five-word shingles, hashed to 64 bits. Documents with
   equal sets (128-bit order-free digest) collapse to one node before anything else.
2. ``HASHES`` minima of the universal family a*x + b (mod 2^64, a odd) are cut into bands of
   ``ROWS``. At similarity 0.75 a pair shares no band with probability (1 - 0.75^5)^40, 2e-5.
3. Every bucket links its members to its smallest member. Signatures (one byte per minimum)
   must agree for at least ``AGREE`` of the hashes, nearly five standard errors below 0.75;
   the full sets then confirm or refute the link.
4. Buckets whose members are not yet in one component are searched in blocks of slots, so
   that no bucket is one task: members outside the bucket's main component are compared with
   all others of other components, by signature and then by set. A block gives at most one
   link for each member and component; what they join is joined by a second round of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.components import components
from vigilar.llm.store import saved

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
AGREE = 0.6
SLOT = 256

_rng = np.random.default_rng(4)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND_IDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def minima(values: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 512):
        part = values[at : at + 512]
        np.minimum(best, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=best)
    return best


def bands_of(minimum: np.ndarray) -> np.ndarray:
    folded = _BAND_IDS.copy()
    for row in minimum.reshape(BANDS, ROWS).T:
        folded = W.mix(folded ^ row)
    return folded.view(np.int64)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    for part in W.slices(column):
        hashes, bounds = W.shingle_hashes(part.lowered().words(W.NOT_SPACE), SHINGLE)
        for i in range(len(part)):
            yield part.first + i, np.unique(hashes[bounds[i] : bounds[i + 1]])


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values) if values else [], type=kind))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k1, k2, bands, sigs = [], [], [], [], []
        for _, own in _sets(batch.column("text")):
            n.append(len(own))
            k1.append(int(W.mix(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            k2.append(int(W.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            if len(own):
                least = minima(own)
                bands.append(bands_of(least))
                sigs.append((W.mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
            else:
                bands.append(np.zeros(0, dtype=np.int64))
                sigs.append(b"")
        if n:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(bands, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "_id", "n_shingles", "k1", "k2", "bands", "sig"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [own.tobytes() for _, own in _sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, pa.binary())], names=["node", "shingles"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sig_u", "sig_v"))
        good = (a == b).sum(axis=1) >= AGREE * HASHES
        yield batch.select(["u", "v"]).filter(pa.array(good))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        good = [
            similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
            for x, y in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True)
        ]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that are links, by their whole sets."""
    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u")), "u")
    joined = joined.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v")), "v")
    return joined.select("u", "v", "set_u", "set_v").mapInArrow(_confirmed, "u long, v long")


def _block_links(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a block of a bucket: at most one from each outside member to each other component."""
    table = pa.Table.from_batches(list(batches))
    node, label = (table.column(c).to_numpy() for c in ("node", "label"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    outside = table.column("outside").to_numpy(zero_copy_only=False)
    inside = np.flatnonzero(~outside)
    us, vs = [], []
    for x in np.flatnonzero(outside):
        other = inside[label[inside] != label[x]]
        fits = 100 * np.minimum(sizes[other], sizes[x]) >= PERCENT * np.maximum(sizes[other], sizes[x])
        other = other[fits]
        agree = (sig[other] == sig[x]).sum(axis=1)
        done: set[int] = set()
        for k in np.argsort(-agree, kind="stable"):
            if agree[k] < AGREE * HASHES:
                break
            y = other[k]
            if label[y] not in done and similar(sets[x], sets[y]):
                done.add(label[y])
                us.append(node[x])
                vs.append(node[y])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that span components, dealt into blocks of about SLOT x SLOT members."""
    known = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    known = saved(known, "members")
    by_label = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    state = by_label.groupBy("bucket").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"))
    # A bucket of two was settled by its one pair.
    state = state.where("parts > 1 and m > 2").select("bucket", "main", F.ceil(F.col("m") / SLOT).cast("int").alias("slots"), F.ceil((F.col("m") - F.col("n_main")) / SLOT).cast("int").alias("outs"))
    open_members = known.join(state, "bucket")
    slot = F.pmod(F.xxhash64("node", "bucket"), F.col("slots")).cast("int")
    inside = open_members.select("bucket", slot.alias("i"), F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("j"), "node", "label", F.lit(False).alias("outside"))
    out = open_members.where("label <> main")
    own = F.pmod(F.xxhash64("bucket", "node"), F.col("outs")).cast("int")
    out = out.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("i"), own.alias("j"), "node", "label", F.lit(True).alias("outside"))
    return inside.unionByName(out)


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    A null or blank text has an empty set and is linked with nothing. Rows that share a
    doc_id are one document. A null doc_id sorts last, its component_id may be null.
    An empty table gives an empty result; other columns are ignored.
    """
    W.bounded_batches(docs.sparkSession)
    docs = W.keyed(docs)
    kind = "doc_id long, _id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"
    rows = saved(docs.select("doc_id", "_id", "text").mapInArrow(_signatures, kind), "signatures")
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = saved(classes, "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "node")
    centers = members.groupBy("bucket").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top").drop("top")
    members = saved(members.join(centers, "bucket").select("bucket", "node", "u"), "buckets")
    nodes = members.select(F.col("node").alias("_id")).distinct()
    # One plan at all sizes: texts are dealt by id once, and not sorted.
    sets = docs.select("_id", "text").join(nodes.hint("shuffle_hash"), "_id", "leftsemi").mapInArrow(_set_rows, "node long, shingles binary")
    # One row a node, also where several texts have one doc_id.
    sets = saved(sets.groupBy("node").agg(F.max("shingles").alias("shingles")), "sets")
    sigs = classes.groupBy("node").agg(F.min("sig").alias("sig"))
    stars = members.where("node <> u").select("u", F.col("node").alias("v")).distinct()
    labels = components(_confirm(_agree(stars, sigs), sets))

    blocks = _open_blocks(members.select("bucket", "node"), labels).join(sigs.join(sets, "node"), "node")
    links = blocks.groupBy("bucket", "i", "j").applyInArrow(_block_links, "u long, v long").distinct()
    for end in ("u", "v"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    joined = components(links.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    joined = joined.select(F.col("node").alias("label"), F.col("component").alias("joined"))

    first = classes.select("k1", "k2", "node")
    labels = first.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("label"))
    labels = saved(labels.join(joined, "label", "left").select("k1", "k2", F.coalesce("joined", "label").alias("component")), "labels")
    out = rows.drop("bands", "sig").join(labels, ["k1", "k2"], "left")
    component = F.coalesce("component", "_id")
    component = F.when(component == W.MAX_ID, F.lit(None).cast("long")).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _agree(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    joined = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u")
    joined = joined.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
    return joined.select("u", "v", "sig_u", "sig_v").mapInArrow(_agreeing, "u long, v long")


# The same in plain SQL, by all pairs that share a shingle; for small tables of distinct doc_ids.
GROUPS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM d UNION SELECT e.v, reach.c FROM reach JOIN both_ways e ON e.u = reach.doc_id
), found AS (
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN n USING (doc_id)
"""
