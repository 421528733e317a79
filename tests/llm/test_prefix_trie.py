import hashlib
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import sentence, table
from vigilar.llm import prefix_trie as T

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The trie of whole rebuilt conversations, as nested prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = crc32(str(c).encode()) % 9
        rebuilt = own.get(int(c / 5) * 5, [])[:h] + own[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append((c, d == len(rebuilt)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[x] for x in children[node])
    return Counter(
        (m[0][0], len(node), members[node[:-1]][0][0] if node else None, len(m), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c, end in m if end).encode()).hexdigest())
        for node, m in members.items()
    )


def check(conversations, **options):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    found = T.prefix_trie(conversations, **options)
    got = found.collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    frame = T.trie_report(table(spark, folder, "conversations"))
    assert tuple(frame.columns) == COLUMNS
    got = Counter(map(tuple, frame.collect()))
    assert got == Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({T.REPORT_SQL})").fetchall())
    assert got == brute([tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()])


def conversations(spark):
    """Copies, shared heads, gaps, ties, nulls, bases that are missing or short, and turnless ones."""
    rows = []
    for c in range(60):
        kind = c % 7
        for t in range(2 + (5 * c) % 11):
            text = f"same {t}" if kind < 4 else sentence(100 * (c % 3) + t, 5)
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows = [r for r in rows if r[0] not in (5, 20)]  # bases that are absent
    rows += [(30, None, "user", "before all others"), (31, 2, "user", "a tie"), (31, 2, "user", "a tie"), (31, 2, "system", "another tie")]
    rows += [(40, 0, None, None), (41, 0, "", ""), (None, 0, "user", "of no conversation"), (None, None, None, None)]
    rows += [(1000 + c, t, "user", f"chain {min(t, c)}") for c in range(6) for t in range(40)]
    rows += [(-7, 0, "user", "below zero"), (-5, 0, "user", "base"), (2000, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "i", "n", "h", "owner", "f1", "s1", "part", "chunk"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame.repartition(5)


def test_special_cases(spark):
    got = check(conversations(spark))
    assert any(r["depth"] == 0 and r["n_children"] > 1 for r in got)
    assert check(conversations(spark).limit(0)) == []
    assert len(check(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))) == 0


def test_turnless_conversations_end_at_the_root(spark):
    ids = [c for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9 >= 1][:6]
    got = check(spark.createDataFrame([(c, 0, "user", "only turn") for c in ids], "conv_id long, turn long, role string, text string"))
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in got] == [(0, 6, 1)]


def test_references_lead_to_the_last_turn(spark):
    frame = conversations(spark)
    own = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, hashlib.sha256(f"{len(r['role'] or '')}:{r['role'] or ''}{r['text'] or ''}".encode()).hexdigest())):
        own[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    for r in T.prefix_trie(frame).where("depth > 0").collect():
        c, h = r["conv_id"], crc32(str(r["conv_id"]).encode()) % 9
        rebuilt = own.get(int(c / 5) * 5, [])[:h] + own[c][h:]
        assert own[r["turn_conv"]][r["turn_no"]] == rebuilt[r["depth"] - 1]


def test_conversations_cut_over_many_ranges(spark):
    """One conversation has nearly all turns, some of them equal, so ranges cut it; sums of ranges compose."""
    rows = [(10, t // 3, "user", f"turn {t % 50}") for t in range(3000)] + [(c, t, "user", f"turn {t % 50}") for c in range(11, 15) for t in range(30)]
    rows += [(3, None, "user", "equal") for _ in range(2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chunk = T.CHUNK
    T.CHUNK = 100
    try:
        parts = T.numbered_turns(frame, T.FINGERPRINTS[0]).groupBy("conv_id").agg(F.countDistinct("part").alias("k"), F.countDistinct("i").alias("i"), F.count("*").alias("n")).collect()
        assert max(r["k"] for r in parts) > 2 and all(r["i"] == r["n"] for r in parts)
        check(frame)
    finally:
        T.CHUNK = chunk
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collisions_are_found_and_fingerprints_made_anew(spark):
    frame = conversations(spark)
    narrow = T.Fingerprint(0, 3)
    assert T._nodes(T._prefixes(T.numbered_turns(frame, narrow), narrow, T.GROUP, T.HEADS)).where("not verified").count() > 0
    check(frame, fingerprints=(narrow, T.Fingerprint(1, 4), T.Fingerprint(2)))
    with pytest.raises(ValueError):
        T.prefix_trie(frame, fingerprints=(narrow,))


def test_hot_parents_and_ends_in_pieces(spark):
    """More children and ends than one piece holds, with small limits."""
    rows = [(c, t, "user", "first" if t == 0 else f"own {c % 97}") for c in range(0, 3000, 5) for t in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    bits = T.ENDS_BITS
    T.ENDS_BITS = 4
    try:
        check(frame)
    finally:
        T.ENDS_BITS = bits
