"""The conversation trie against a version by hand, and running sums."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import conversation_trie, queries
from textloom.llm.running import running_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, row string, part int"
BIG = 2**53 + 1 - (2**53 + 1) % 20


def by_hand(rows):
    own, built, members, kids, below = {}, {}, {}, {}, {}
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below[k] = [int(k not in kids), (len(members[k]) - 1) * words]
        for x in kids.get(k, []):
            below[k] = [i + j for i, j in zip(below[k], below[x], strict=True)]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    out = [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *below[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()]
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, conversation_trie.prefix_trie(df).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_version_by_hand(spark, seed):
    rng = random.Random(seed)
    ids = [*range(60), *(BIG + i for i in (0, 1, 3, 19)), 10**6 + 7]
    rows = [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "yes", "a b\tc", "n o d", "é"])) for c in ids for t in range(rng.choice([1, 2, 4, 9]))]
    rows += [rows[0], rows[0], (None, 1, "user", "nobody")]
    assert trie(spark, rows) == by_hand(rows)


def test_many_levels_long_conversations_and_many_members(spark):
    # a binary trie (each level's light child has half of the members), one of 3000 turns, and 3000 equal conversations
    rows = [(1000 + c, t, "u", f"{t} " * (c >> t & 1) + "w") for c in range(64) for t in range(6)]
    rows += [(1001, 6 + t, "u", f"long {t}") for t in range(3000)]
    rows += [(10_000 + c, t, "u", "same words") for c in range(3000) for t in range(2)]
    assert trie(spark, rows) == by_hand(rows)


def test_no_conversations(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []


def test_given_table_equals_version_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, queries.op13_conversation_trie(spark, folder).collect()), key=lambda r: r[:2]) == by_hand(map(tuple, rows))


def test_running_sums_of_groups_in_many_parts(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id") % 7).cast("long").alias("g"), F.col("id").alias("at"), (F.col("id") % 11).alias("v"), F.lit("x").alias("part"))
    got = running_sums(df.repartition(5), "g", [F.col("at").desc()], ["v"], "test")
    assert got.columns == df.columns
    want, sums = {}, {}
    for r in sorted(df.collect(), key=lambda r: -r["at"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        want[r["at"]] = sums[r["g"]]
    assert {r["at"]: r["v"] for r in got.collect()} == want
