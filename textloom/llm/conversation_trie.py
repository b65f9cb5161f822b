"""Conversations as a trie of their turns, with figures of each node's subtree by heavy-path decomposition.

A node is a distinct sequence of first turns. Its name is a sum of 128-bit hashes of (place, role, text) over its turns, so
that names of all prefixes are running sums. Subtree figures take no walk down or up the trie: each node's heavy child is the
one with most members; the nodes from a leaf up to the last light child above it are a path, found among the prefixes of the
leaf's smallest member; a path's figures are suffix sums along it. Paths go by level, the number of light children from the
root: those of the deepest level first, whose totals are attached to the parents of their heads, one level up. A light child
has at most half of its parent's members, so with n conversations there are at most log2(n) + 1 levels.

Running sums split groups of any size over tasks, so neither a conversation of very many turns nor a turn that very many
conversations share meets in one task. Only the SHA-256 of a node's members passes one task, as that hash has to be taken in
order; it streams over runs of 1024 ids.

Cases: turns are ordered by turn (null first), then by role, then by the SHA-256 of role and text; a null role or text is
empty; rows without conv_id belong to no conversation and are left out; repeated rows are turns each; other columns are
ignored, whatever their names; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import shared_path, stage
from textloom.llm.running import running_sums

#: Conversations of a group share the turns of its first; a conversation takes so many of them, less one, at most.
GROUP, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: 32-bit pieces of a turn's hash. Their sums over fewer than 2^31 turns are longs.
PIECES = ["s0", "s1", "s2", "s3"]
#: Ids that are joined to one string at a time.
RUN = 1024
KEY = ["depth", "a", "b"]


def read_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, words, row) of each turn, staged: texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    some = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return stage(some.withColumn("row", F.monotonically_increasing_id()), "turns")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, words) of turns."""
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("row")]
    return running_sums(turns.withColumn("place", F.lit(1).cast("long")), "conv_id", order, ["place"], "numbered", instead_of=turns).select("conv_id", "place", "digest", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, digest, words) where each conversation c starts with the first h turns of c - c % group, which
    replace its own first h; h is crc32(c) % heads. With them, all conversations (conv_id), those without turns too."""
    convs = turns.where("place = 1").select("conv_id").withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % heads, "base": F.col("conv_id") - F.col("conv_id") % group})
    first = turns.where(F.col("place") < heads).where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "base")
    known = first.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    convs = stage(convs.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    shared = convs.select("conv_id", "base", "h").join(first, "base").where("place <= h").select("conv_id", "place", "digest", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    return own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "words").unionByName(shared), convs.select("conv_id")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, words), staged, of each first part of each conversation: (depth, a, b) names it and
    (depth - 1, up_a, up_b) the part that is a turn shorter. Part 0 has no turn and no name above it."""
    own = F.sha2(F.concat_ws(":", F.col("place").cast("string"), F.hex("digest")), 256)
    pieces = {p: F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("long") for i, p in enumerate(PIECES)}
    rows = turns.withColumns(pieces)
    rows = rows.select("conv_id", F.col("place").alias("depth"), "words", *(F.col(p).alias("own_" + p) for p in PIECES), *PIECES)
    sums = running_sums(rows, "conv_id", [F.col("depth")], PIECES, "sums")

    def name(x: str, y: str, less: bool) -> Column:
        low = lambda s: (F.col(s) - F.col("own_" + s) if less else F.col(s)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(low(x), 32).bitwiseOR(low(y))

    names = {"a": name("s0", "s1", False), "b": name("s2", "s3", False), "up_a": name("s0", "s1", True), "up_b": name("s2", "s3", True)}
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"))
    return stage(sums.select("conv_id", "depth", *(c.alias(k) for k, c in names.items()), "words").unionByName(roots), "prefixes")


def nodes_of(parts: DataFrame) -> DataFrame:
    """The nodes, staged: KEY, conv_id, up_a, up_b, n_convs, words, parent_conv_id, n_children, and whether a node is light."""
    own = parts.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("up_a", "up_b", "words")))
    own = stage(own, "nodes")
    up = own.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.struct("n_convs", -F.col("conv_id")).alias("size"), F.struct("a", "b").alias("child"))
    heavy = up.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.max_by("child", "size").alias("heavy"))
    full = stage(own.join(heavy, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes", instead_of=own)
    parents = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("favoured"))
    out = full.join(parents, ["depth", "up_a", "up_b"], "left").withColumn("light", F.coalesce(F.struct("a", "b") != F.col("favoured"), F.lit(False)))
    return stage(out.drop("heavy", "favoured"), "nodes", instead_of=full)


def paths_of(parts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Each node with its path (the smallest member of the path's leaf), the path's level, and whether it is the head; and the
    deepest level. Written by level, so that a round reads its own."""
    leaves = nodes.where("n_children = 0").select("conv_id")
    along = parts.join(leaves, "conv_id", "left_semi").select("conv_id", *KEY)
    lit = along.join(nodes.where("light").select(*KEY), KEY).groupBy("conv_id").agg(F.max("depth").alias("head"), F.count(F.lit(1)).alias("level"))
    on = along.join(lit, "conv_id", "left").withColumns({"head": F.coalesce("head", F.lit(0)), "level": F.coalesce("level", F.lit(0))}).where("depth >= head")
    on = on.select(*KEY, F.col("conv_id").alias("path"), "level", (F.col("depth") == F.col("head")).alias("is_head"))
    values = nodes.select(*KEY, "up_a", "up_b", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    at = shared_path(parts.sparkSession, "paths")
    on.join(values, KEY).write.partitionBy("level").parquet(at)
    found = parts.sparkSession.read.schema("depth long, a long, b long, path long, is_head boolean, up_a long, up_b long, n_leaves long, saved_tokens long, level long").parquet(at)
    return found, found.agg(F.max("level")).first()[0] or 0


def subtree_sums(paths: DataFrame, deepest: int) -> DataFrame:
    """(KEY, n_leaves, saved_tokens) over each node's subtree: suffix sums along paths, level by level up."""
    figures, attached, done = ["n_leaves", "saved_tokens"], None, []
    for level in range(deepest, -1, -1):
        own = paths.where(F.col("level") == level).drop("level")
        if attached is not None:
            own = own.join(attached, KEY, "left").select(*(c for c in own.columns if c not in figures), *((F.col(v) + F.coalesce("more_" + v, F.lit(0))).alias(v) for v in figures))
        sums = running_sums(own, "path", [F.desc("depth")], figures, f"level-{level}")
        heads = sums.where("is_head").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), *figures)
        attached = heads.groupBy(*KEY).agg(*(F.sum(v).alias("more_" + v) for v in figures))
        done.append(sums.select(*KEY, *figures))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def end_digests(parts: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of nodes at which conversations end. Sorted runs of ids are joined to strings by many tasks; a task
    then hashes each node's strings in order, holding one batch of them."""
    ends = parts.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("end.*", "conv_id")
    size = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stage(ends, "ends").repartitionByRange(size, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    runs = runs.withColumn("run", F.shiftright(F.monotonically_increasing_id(), RUN.bit_length() - 1))
    runs = runs.groupBy(*KEY, "run").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select(*KEY, F.col("ids")[0].alias("first"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found = []
            for *own, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    found.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            yield rows_of(found)
        if state is not None:
            yield rows_of([(*key, state.hexdigest())])

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])

    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node; its members'
    smallest conv_id and its depth name it. heads=1 takes conversations as they are."""
    parts = prefixes(*rebuilt(numbered(read_turns(conversations)), group, heads))
    nodes = nodes_of(parts)
    paths, deepest = paths_of(parts, nodes)
    full = nodes.join(subtree_sums(paths, deepest), KEY).join(end_digests(parts), KEY, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
