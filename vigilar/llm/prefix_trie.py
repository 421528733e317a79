"""The trie of all prefixes of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from the head of another one and its own later turns. No rebuilt text
is made: what goes round are fingerprints and references (conversation, number of the turn).

1. Turns are dealt by ranges of (conversation, turn), so that a conversation of any length is cut
   over many tasks. Each range sums the fingerprints of its turns. Fingerprints form a monoid:
   (n, s) then (m, t) is (n + m, s + t * B^n), so sums of ranges compose to those of conversations.
2. The prefix of d rebuilt turns is the product of a head of the base conversation and a stretch of
   the own suffix, (P(i) - P(h)) * B^(shift) after the head: two numbers of 64 bits, computed from
   stored prefix sums.
3. Rows with equal fingerprints are a node. Every group is verified: its members' last turns,
   looked up through their references as 128-bit digests, must be one, and so must be the
   fingerprints of their parents. By induction over the depth, groups are equal sequences. If any
   group fails, all fingerprints are made anew with another seed.
4. Sums over subtrees need no walk. Each node belongs to its smallest member; what a conversation
   owns is a suffix of its path. A subtree is what its owner owns below the node, and all that its
   other members own.

Nodes with many members are aggregated before they are shuffled; parents with many children are
joined by a broadcast of at most ``HOT_SHARE`` rows, conversations of many turns in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilar.llm import words as W
from vigilar.llm.store import discard, saved

GROUP = 5
HEADS = 9
CHUNK = 65_536
HOT_SHARE = 4096
ENDS_BITS = 13
NODE = ["f1", "f2"]


@dataclass(frozen=True)
class Fingerprint:
    """A pair of polynomial fingerprints modulo 2 to the power ``bits``."""

    seed: int
    bits: int = 64

    def base(self, which: int) -> np.uint64:
        return W.mix(np.array([2 * self.seed + which + 1], dtype=np.uint64))[0] | np.uint64(1)

    def cut(self, x: np.ndarray) -> np.ndarray:
        return x & np.uint64((1 << self.bits) - 1)

    def codes(self, digest: np.ndarray, which: int) -> np.ndarray:
        return W.mix(digest ^ W.mix(np.array([101 + 2 * self.seed + which], dtype=np.uint64)))


FINGERPRINTS = tuple(Fingerprint(seed) for seed in range(8))


def _power(base: np.uint64, n: int) -> np.uint64:
    """``base`` to the n-th; negative powers by its inverse modulo 2^64."""
    return np.uint64(pow(int(base), n, 1 << 64))


def _power_of_each(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """``_power`` for an array of exponents of zero or more, by squaring."""
    out, square, left = np.ones(len(exponents), dtype=np.uint64), base, exponents.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= square
        square, left = _power(square, 2), left >> 1
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _sum_rows(fp: Fingerprint) -> object:
    """Numbers and prefix sums of the turns of every conversation inside one sorted range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            digest = W.column_bytes(batch.column("digest"))
            digest = digest[0][digest[1][0] : digest[1][-1]].reshape(-1, 16).view(np.uint64)
            head = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            segment = np.cumsum(np.bincount(head, minlength=n)) - 1
            number = np.arange(n) - head[segment]
            more = conv[0] == last
            out = []
            for which in (0, 1):
                base = fp.base(which)
                powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))
                total = np.cumsum(fp.codes(digest[:, which], which) * powers[number])
                before = np.concatenate([[np.uint64(0)], total])[head]
                total = total - before[segment]
                if more:
                    first = segment == 0
                    total[first] = total[first] * _power(base, count) + sums[which]
                out.append(fp.cut(total))
            if more:
                number[segment == 0] += count
            last, count, sums = conv[-1], int(number[-1]) + 1, [out[0][-1], out[1][-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(n, part)), pa.array(number), _long(digest[:, 0]), _long(digest[:, 1]), batch.column("bytes"), _long(out[0]), _long(out[1])],
                names=["conv_id", "part", "i", "d1", "d2", "bytes", "s1", "s2"],
            )

    return run


TURNS = "conv_id long, part long, i long, d1 long, d2 long, bytes long, s1 long, s2 long"


def _offset_rows(fp: Fingerprint, offsets: dict[tuple[int, int], tuple[int, int, int]]) -> object:
    """Puts the sums of earlier ranges before those of conversations that were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part = batch.column("conv_id").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
            number, sums = batch.column("i").to_numpy(zero_copy_only=False).copy(), [_unsigned(batch.column(c)).copy() for c in ("s1", "s2")]
            cuts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])])) if len(conv) else []
            for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True):
                found = offsets.get((int(conv[a]), int(part[a])))
                if found:
                    number[a:b] += found[0]
                    for which in (0, 1):
                        sums[which][a:b] = fp.cut(sums[which][a:b] * _power(fp.base(which), found[0]) + np.uint64(found[1 + which]))
            kept = {"i": pa.array(number), "s1": _long(sums[0]), "s2": _long(sums[1])}
            yield pa.RecordBatch.from_arrays([kept.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def numbered_turns(conversations: DataFrame, fp: Fingerprint) -> DataFrame:
    """Every turn with its number i in its conversation, digest, bytes of its text, and the
    fingerprint (s1, s2) of its conversation up to and including it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(content, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        # Equal rows may lie in several ranges.
        (F.monotonically_increasing_id() % 4096).cast("int").alias("salt"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "salt")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = saved(ranges.select("conv_id", "digest", "bytes").mapInArrow(_sum_rows(fp), TURNS), "turns")
    # Only the first and the last conversation of a range can be cut: at most two rows a range come to the driver.
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect()
    lows, highs = {}, {}
    for r in edges:
        lows.setdefault(r["low"], set()).add(r["part"])
        highs.setdefault(r["high"], set()).add(r["part"])
    cut = [c for c in lows if len(lows[c] | highs.get(c, set())) > 1]
    if not cut:
        return turns
    ids = turns.sparkSession.createDataFrame([(c,) for c in cut], "conv_id long")
    pieces = turns.join(F.broadcast(ids), "conv_id").groupBy("conv_id", "part")
    pieces = pieces.agg(F.count(F.lit(1)).alias("n"), F.max_by("s1", "i").alias("s1"), F.max_by("s2", "i").alias("s2")).collect()
    offsets, ahead = {}, {}
    for r in sorted(pieces, key=lambda r: (r["conv_id"], r["part"])):
        n, *sums = ahead.get(r["conv_id"], (0, 0, 0))
        offsets[r["conv_id"], r["part"]] = (n, *sums)
        new = [(sums[k] + (r[f"s{k + 1}"] % (1 << 64)) * int(_power(fp.base(k), n))) % (1 << fp.bits) for k in (0, 1)]
        ahead[r["conv_id"]] = (n + r["n"], *new)
    composed = saved(turns.mapInArrow(_offset_rows(fp, offsets), TURNS), "turns")
    discard(turns)
    return composed


def head_length(conv_id: Column | str, heads: int = HEADS) -> Column:
    """How many turns a rebuilt conversation takes from its base."""
    return F.crc32(F.col(conv_id).cast("string") if isinstance(conv_id, str) else conv_id.cast("string")) % heads


def _plans(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """One row per conversation: n own turns, h, the head it takes (at most heads - 1 turns), and the sums where its parts meet."""
    piece = F.struct("i", "d1", "d2", "bytes", "s1", "s2")
    first = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("i") < heads - 1, piece))).alias("head"))
    first = saved(first, "heads")
    base = first.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plans = first.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left").withColumn("h", head_length("conv_id", heads))
    plans = plans.withColumn("taken", F.coalesce(F.slice("base_head", F.lit(1), F.col("h").cast("int")), F.slice("head", 1, 0)))
    at = lambda array, n, field: F.coalesce(F.try_element_at(array, n.cast("int"))[field], F.lit(0).cast("long"))
    where = F.when(F.col("h") > 0, F.col("h")).otherwise(heads)
    taken = F.size("taken")
    last = F.when(taken > 0, taken).otherwise(heads)
    return plans.select(
        "conv_id", "n", "h", "base", "taken", taken.cast("long").alias("hb"),
        *[at("taken", last, f"s{k}").alias(f"b{k}") for k in (1, 2)], *[at("head", where, f"s{k}").alias(f"o{k}") for k in (1, 2)],
    )


ROWS = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, d1 long, d2 long, bytes long, is_end boolean, turn_conv long, turn_no long"


def _suffix_rows(fp: Fingerprint) -> object:
    """Fingerprints of own turns after the head of the base, and those of their parents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "i", "n", "h", "hb")}
            out = {}
            for k in (1, 2):
                base = fp.base(k - 1)
                power = _power_of_each(_power(base, -1), got["h"] - got["hb"])
                d, s, b, o = (_unsigned(batch.column(f"{c}{k}")) for c in "dsbo")
                # The last term of the sum, to take it away again for the parent.
                term = fp.codes(d, k - 1) * _power_of_each(base, got["i"])
                out[f"f{k}"] = fp.cut((s - o) * power + b)
                out[f"p{k}"] = fp.cut((s - term - o) * power + b)
            depth = got["hb"] + got["i"] - got["h"] + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(depth), *[_long(out[c]) for c in ("f1", "f2", "p1", "p2")], batch.column("d1"), batch.column("d2"),
                    batch.column("bytes"), pa.array(got["i"] == got["n"] - 1), batch.column("conv_id"), batch.column("i"),
                ],
                names=[c.split()[0] for c in ROWS.split(", ")],
            )

    return run


def _prefixes(turns: DataFrame, fp: Fingerprint, group: int, heads: int) -> DataFrame:
    """A row for every prefix of every rebuilt conversation, the empty one included."""
    plans = saved(_plans(turns, group, heads), "plans")
    zero = F.lit(0).cast("long")
    ends_here = F.col("n") <= F.col("h")

    def of_head(x: Column, k: Column) -> Column:
        before = lambda c: F.when(k > 0, F.try_element_at("taken", k)[c]).otherwise(zero)
        end = ends_here & (k + 1 == F.col("hb"))
        return F.struct(
            (k + 1).cast("long").alias("depth"), x["s1"].alias("f1"), x["s2"].alias("f2"), before("s1").alias("p1"), before("s2").alias("p2"),
            x["d1"].alias("d1"), x["d2"].alias("d2"), x["bytes"].alias("bytes"), end.alias("is_end"), F.col("base").alias("turn_conv"), x["i"].alias("turn_no"),
        )

    null = F.lit(None).cast("long")
    root = F.struct(
        *[zero.alias(c) for c in ("depth", "f1", "f2", "p1", "p2", "d1", "d2", "bytes")], (ends_here & (F.col("hb") == 0)).alias("is_end"), null.alias("turn_conv"), null.alias("turn_no")
    )
    upper = plans.select("conv_id", F.inline(F.concat(F.array(root), F.transform("taken", of_head))))
    own = turns.where(F.col("i") >= head_length("conv_id", heads)).withColumn("chunk", F.floor(F.col("i") / CHUNK)).drop("part")
    ahead = plans.where("n > h").select("conv_id", "n", "h", "hb", "b1", "b2", "o1", "o2", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    own = own.join(ahead, ["conv_id", "chunk"]).drop("chunk")
    return saved(upper.unionByName(own.mapInArrow(_suffix_rows(fp), ROWS)), "prefixes")


def _nodes(rows: DataFrame) -> DataFrame:
    """Groups of equal fingerprints, with what must be one in each of them."""
    same = ("depth", "p1", "p2", "d1", "d2")
    return rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        F.min_by("turn_conv", "conv_id").alias("turn_conv"), F.min_by("turn_no", "conv_id").alias("turn_no"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same],
    ).withColumn("verified", F.forall(F.array(*[F.col(c) == F.col(f"max_{c}") for c in same]), lambda x: x)).drop(*[f"max_{c}" for c in same])


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 over the ids of the conversations that end at a node, as a stream of joined pieces in order."""
    pieces = rows.where("is_end").groupBy(*NODE, F.shiftright("conv_id", ENDS_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        done: list[tuple[int, int, str]] = []

        def out() -> pa.RecordBatch:
            a, b, c = zip(*done, strict=True) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for f1, f2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (f1, f2) == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last:
                    done.append((*last, digest.hexdigest()))
                last, digest = (f1, f2), hashlib.sha256(ids.encode())
            yield out()
        if last:
            done.append((*last, digest.hexdigest()))
            yield out()

    return pieces.mapInArrow(run, "f1 long, f2 long, ends_sha256 string")


def _parents(nodes: DataFrame) -> DataFrame:
    """(f1, f2, parent): the owner of the parent of every node but the root."""
    children = nodes.where("depth > 0").select(*NODE, "p1", "p2")
    owners = nodes.where("n_children > 0").select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("owner").alias("parent"), "n_children")
    total = nodes.count()
    hot = owners.where(F.col("n_children") > max(10_000, total // HOT_SHARE)).drop("n_children")  # at most HOT_SHARE rows
    hot = F.broadcast(saved(hot, "hot"))
    few = children.join(hot, ["p1", "p2"], "leftanti").join(owners.drop("n_children"), ["p1", "p2"])
    return few.unionByName(children.join(hot, ["p1", "p2"])).select(*NODE, "parent")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, fingerprints: Sequence[Fingerprint] = FINGERPRINTS) -> DataFrame:
    """One row for every node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Conversation c is the first h turns of conversation c - c % group (all, if it has fewer; none, if it
    is absent) and its own turns after its first h, with h = crc32(decimal c) % heads.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and (turn_conv, turn_no): where the last turn is stored, by its place
    in its conversation.

    Turns are in the order of ``turn``, null first, ties in the order of a digest of role and text;
    a null role or text is an empty one; repeated rows are turns of their own. Turns without a
    conv_id belong to no conversation. Without conversations there is no root. Remainders of
    negative ids have the sign of the id, as in SQL. Other columns are ignored.
    """
    W.bounded_batches(conversations.sparkSession)
    for fp in fingerprints:
        turns = numbered_turns(conversations, fp)
        rows = _prefixes(turns, fp, group, heads)
        nodes = saved(_nodes(rows), "nodes")
        if not nodes.where("not verified").head(1):
            break
        discard(turns, rows, nodes)
    else:
        raise ValueError("fingerprints of different prefixes are equal under every seed")
    counts = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    counts = counts.select(F.col("p1").alias("f1"), F.col("p2").alias("f2"), "n_children")
    leaf, gain = F.col("n_children").isNull().cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes = nodes.drop("d1", "d2", "verified").join(counts, NODE, "left").withColumns({"leaves": leaf, "saved": gain})
    nodes = saved(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "chunk": F.floor(F.col("depth") / CHUNK)}), "tree")
    # What every conversation owns, in chunks of its path.
    owned = saved(nodes.groupBy("owner", "chunk").agg(F.min("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "owned")
    below = Window.partitionBy("owner").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = owned.select("owner", "chunk", F.sum("leaves").over(below).alias("more_leaves"), F.sum("saved").over(below).alias("more_saved")).where("more_leaves is not null")
    whole = owned.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / CHUNK))))
    above = rows.select("conv_id", "depth", *NODE, F.floor(F.col("depth") / CHUNK).alias("chunk")).join(whole, ["conv_id", "chunk"]).where("depth < top")
    others = above.groupBy(*NODE).agg(F.sum("leaves").alias("other_leaves"), F.sum("saved").alias("other_saved"))
    out = nodes.join(others, NODE, "left").join(_ends(rows), NODE, "left").join(_parents(nodes), NODE, "left").join(later, ["owner", "chunk"], "left")
    down = Window.partitionBy("owner", "chunk").orderBy(F.desc("depth"))
    total = lambda own, *more: (F.sum(own).over(down) + sum((F.coalesce(F.col(m), F.lit(0)) for m in more), F.lit(0))).cast("long")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        total("leaves", "more_leaves", "other_leaves").alias("n_leaves"), total("saved", "more_saved", "other_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "turn_conv", "turn_no",
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The nodes without their references."""
    return prefix_trie(conversations).drop("turn_conv", "turn_no")


# The same in plain SQL, for tables small enough for it: rebuilt conversations as lists, subtrees as pairs of nodes.
REPORT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id FROM t
), c AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))
  )) % 9 AS h FROM ids
), k AS (
  SELECT c.conv_id, h, (SELECT count(*) FROM t WHERE t.conv_id = c.conv_id - c.conv_id % 5 AND t.i < h) AS hb FROM c
), own AS (
  SELECT k.conv_id, t.i + 1 AS depth, r, x FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % 5 AND t.i < h
  UNION ALL
  SELECT k.conv_id, hb + t.i - h + 1, r, x FROM k JOIN t ON t.conv_id = k.conv_id AND t.i >= h
), p AS (
  SELECT conv_id, depth, strlen(x) AS bytes, md5(list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR) AS node FROM own
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM k
), q AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM p
), n AS (
  SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM q GROUP BY node
), f AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.node) AS n_children FROM n
), sub AS (
  SELECT DISTINCT a.node AS top, b.node FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), s AS (
  SELECT top AS node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM sub JOIN f USING (node) GROUP BY 1
)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN f u ON u.node = f.parent
"""
