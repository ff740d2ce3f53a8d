"""Operator 13: the trie of conversation prefixes, by prefix doubling.

A conversation is a sequence of turns. Level 0 names each distinct turn by a dense number. Level k names each block of 2^k turns that
begins at a multiple of 2^k by the pair of its halves' names, so there are as many rounds as the longest conversation has binary
digits. The prefix of d turns is the blocks of d's binary digits, from the highest: its name comes from the name of the prefix without
the lowest digit and the block of that digit, in one round for each number of digits. Prefixes of one depth and name are a node.

A node is known by its depth and its smallest member. The subtree's sums need no walk over the tree: a node's value stands in its
smallest member's row of that depth, and a subtree's sum is that of the values at its members' rows from that depth on, i.e.
of running sums from each conversation's end.

Names, nodes and conversations that hold a large share of all rows are dealt over tasks (common.dealt_join, operators.running).
Only hashes of the turns are shuffled, not their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import numbered_within, running
from .common import dealt_join, importable, written


def dense_names(rows: DataFrame, keys: list[str], name: str, carry: list[Column] | None = None) -> DataFrame:
    """keys, name, many (rows of that key) and the aggregates of carry, one row for each distinct key: name counts the keys from 0, over the partitions that hold them."""
    x = rows.groupBy(*keys).agg(F.count("*").alias("many"), *(carry or []))
    x = written(x.withColumn("__id", F.monotonically_increasing_id()), "names")
    at = F.shiftright("__id", 33)
    parts = x.groupBy(at.alias("__part")).agg(F.count("*").alias("__n"))  # as many rows as partitions
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(parts.select("__part", before.alias("__before"))), at == F.col("__part"))
    return x.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def _renamed(rows: DataFrame, keys: list[str], name: str, carry: list[Column] | None = None) -> DataFrame:
    """rows with name in place of the keys."""
    rows = written(rows, f"{name}-keys")
    names = written(dense_names(rows, keys, name, carry), f"{name}-names")
    return written(dealt_join(rows, names.drop("many"), keys, counts=names.select(*keys, "many")).drop(*keys), name)


def prefix_names(turns: DataFrame) -> DataFrame:
    """conv, depth, name of every prefix of at least one turn, of turns (conv, i from 0 without gaps, name0)."""
    block = turns.select("conv", F.col("i").alias("j"), F.col("name0").alias("name"))
    blocks = block.withColumn("level", F.lit(0))
    level, longest = 0, block.agg(F.max("j")).first()[0]
    while longest is not None and longest + 1 >= 2 << level:
        level += 1
        half = block.groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(F.col("j") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("j") % 2 == 1, F.col("name"))).alias("right"))
        block = _renamed(half.where("left IS NOT NULL AND right IS NOT NULL"), ["left", "right"], "name")
        blocks = blocks.unionByName(block.withColumn("level", F.lit(level)))
    # The block that ends the prefix of depth d is the one of d's lowest digit: of level l, with d = (j + 1) * 2^l and j even.
    last = blocks.where("j % 2 = 0").select("conv", F.expr("(j + 1) * shiftleft(1L, level)").alias("depth"), F.expr("j * shiftleft(1L, level)").alias("rest"), F.col("name").alias("block"))
    # j even says nothing of higher digits: the rest of the prefix is that of depth j * 2^l.
    last = written(last, "prefix-ends")
    done = last.where("rest = 0").select("conv", "depth", F.col("block").alias("name"))  # powers of two are blocks
    out, digits = done, 1
    while longest is not None and (2 << digits) - 1 <= longest + 1:
        digits += 1
        step = last.where(F.bit_count("depth") == digits).join(done.select("conv", F.col("depth").alias("rest"), F.col("name").alias("before")), ["conv", "rest"])
        done = _renamed(step.select("conv", "depth", F.col("depth").alias("__d"), "before", "block"), ["__d", "before", "block"], "name")
        out = out.unionByName(done)
    return written(out, "prefixes")


def _joiner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of a node that come one after the other in a batch, as one string."""
    for batch in batches:
        change = (batch["depth"].diff().ne(0) | batch["name"].diff().ne(0)).cumsum()
        runs = batch.assign(ids=batch["conv"].astype(str)).groupby(change, sort=False)
        yield runs.agg(depth=("depth", "first"), name=("name", "first"), first=("conv", "first"), ids=("ids", ",".join))


def _hasher(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's strings in turn, comma-joined; they come sorted by node and first id. A hash's state is all that is kept."""
    node, state = None, None
    for batch in batches:
        out = []
        for depth, name, ids in zip(batch["depth"], batch["name"], batch["ids"], strict=True):
            if (depth, name) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, name), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "name", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["depth", "name", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, name, ends_sha256 of each node that ends a conversation, of ends (depth, name, conv). The ids of one node lie in as many ranges as they fill and
    are joined there; the digest itself is one sequence by its nature: one task reads a node's strings one after the other and keeps nothing of them."""
    ids = ends.repartitionByRange("depth", "name", "conv").sortWithinPartitions("depth", "name", "conv")
    chunks = written(ids.select("depth", "name", "conv").mapInPandas(_joiner, "depth long, name long, first long, ids string"), "ends")
    return chunks.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInPandas(_hasher, "depth long, name long, ends_sha256 string")


def turns_in_order(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, i (from 0), key (a hash of role and text), chars (code points of the text). By turn, null first; equal turns by role, then by the text's SHA-256. Null roles and texts are empty. Rows without a conversation's id belong to none and are left out."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.sha2(text, 256)
    key = F.unhex(F.sha2(F.concat(role, F.lit("\n"), F.octet_length(role).cast("string"), F.lit("\n"), hashed), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), hashed.alias("hashed"), key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    placed = numbered_within(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "hashed"], "i")
    return placed.select("conv", (F.col("i") - 1).alias("i"), "key", "chars")


def rebuilt(turns: DataFrame, *, family: int = 100, most: int = 6) -> DataFrame:
    """conv, i, key, chars of every rebuilt conversation: the first h turns of conversation conv - conv % family, then conv's own after its first h; h = crc32(conv) % most. One row with i null for each conversation that is left without turns."""
    shared = F.crc32(F.col("conv").cast("string")) % most
    ids = turns.select("conv").distinct().withColumn("h", shared).withColumn("base", F.col("conv") - F.col("conv") % family)
    base = written(turns.where((F.col("conv") % family == 0) & (F.col("i") < most - 1)).select(F.col("conv").alias("base"), "i", "key", "chars"), "base-turns")
    heads = written(ids.join(base, "base").where("i < h").select("conv", "i", "key", "chars"), "heads")  # at most most - 1 rows a conversation
    taken = heads.groupBy("conv").agg(F.count("*").alias("taken"))
    own = written(turns.withColumn("h", shared).where("i >= h"), "own-turns")
    own = dealt_join(own, taken, "conv", "left").select("conv", (F.col("i") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("i"), "key", "chars")
    have = written(own.unionByName(heads), "rebuilt")
    without = ids.select("conv").join(have.where("i = 0").select("conv"), "conv", "left_anti")
    return have.unionByName(without.select("conv", F.lit(None).cast("long").alias("i"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars")))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of sequences (conv long, i from 0, key, chars; i null: a conversation without turns), from the textless root:
    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal conversations are members of the same nodes. A conversation of any length and a turn of any share of rows are dealt
    over tasks. No conversations give no rows, not even the root.
    """
    importable(sequences.sparkSession)
    sequences = written(sequences, "sequences")
    turns = sequences.where("i IS NOT NULL")
    named = _renamed(turns.select("conv", "i", "key", "chars"), ["key"], "name0")
    lengths = sequences.groupBy("conv").agg(F.coalesce(F.max("i") + 1, F.lit(0)).cast("long").alias("turns"))
    chars = named.select("conv", (F.col("i") + 1).alias("depth"), "chars")
    prefixes = prefix_names(named).join(chars, ["conv", "depth"])
    roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"))
    rows = written(prefixes.select("conv", "depth", "name", "chars").unionByName(roots), "trie-rows")
    nodes = written(rows.groupBy("depth", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")), "trie-nodes")
    up = nodes.select("depth", "name", "conv_id").join(rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("up")), ["conv_id", "depth"])
    up = written(up.select("depth", "name", (F.col("depth") - 1).alias("up_depth"), "up"), "trie-up")
    children = written(up.groupBy("up_depth", "up").agg(F.count("*").alias("many")), "trie-children")
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parents = dealt_join(up, parents, ["up_depth", "up"], counts=children).select("depth", "name", "parent_conv_id")
    nodes = nodes.join(children.select(F.col("up_depth").alias("depth"), F.col("up").alias("name"), F.col("many").alias("n_children")), ["depth", "name"], "left").fillna(0, ["n_children"])
    nodes = written(nodes.join(parents, ["depth", "name"], "left"), "trie-family")
    values = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    valued = rows.select("conv", "depth", "name").join(values, ["conv", "depth"], "left").fillna(0, ["saved", "leaf"])
    below = running(valued, ["conv"], [F.col("depth").desc()], {"saved_below": F.col("saved"), "leaves_below": F.col("leaf")})
    below = below.groupBy("depth", "name").agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"))
    last = written(lengths.select("conv", F.col("turns").alias("depth")), "trie-lengths")
    digests = ends_digest(rows.select("conv", "depth", "name").join(last, ["conv", "depth"]))
    out = nodes.join(below, ["depth", "name"]).join(digests, ["depth", "name"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, family: int = 100, most: int = 6) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text).

    Order, ties, nulls: see turns_in_order; repeated rows are turns of their own. Rebuilding: see rebuilt. A conversation that has
    no turns left is a member of the root alone. An empty table gives no rows. Other columns are not read.
    """
    return prefix_trie(rebuilt(turns_in_order(conversations), family=family, most=most))
