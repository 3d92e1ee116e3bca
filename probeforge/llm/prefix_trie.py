"""The trie of conversation prefixes, by prefix doubling: dense names of power-of-two blocks of turns.

Each different turn gets a dense name (0, 1, 2, ...); each different pair of neighbouring aligned blocks of 2**k turns gets the
name of a block of 2**(k+1) turns, in one join round for each k. The prefix of d turns is the run of aligned blocks that
the bits of d say, the largest first: its name is the array of at most log2(d) + 1 block names, and (d, name) is the node.
Turns enter by the SHA-256 of role and text, so no text is shuffled.

A node belongs to the smallest conversation in it. As a prefix grows it loses members only, so a conversation owns the nodes
from one depth on down to its end: a chain, hanging from a node of another chain. Sums over subtrees are sums over chains by
pointer doubling (again logarithmic rounds), and running sums inside a chain; no node is copied to all its ancestors.

The conversations that end at a node are digested in blocks of ids of ``BLOCK`` at most, whose texts a worker streams through
one SHA-256 in order: a node where a third of all conversations end is never collected.

Defined results: rows with a null conv_id take no part; turns are in the order of turn (null first), equal ones by digest;
null role or text is empty; equal rows are turns of their own; an empty table has no node, not even a root; a conversation
without turns is a member of the root. Columns other than the four named play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, staged

#: Conversation ids of one block of a node's digest, as a power of two.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
_ROW_BITS = 33  # of monotonically_increasing_id


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(conv_id, pos from 0, n_turns, digest, words) of each turn; with ``texts`` also role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    extra = [role.alias("role"), text.alias("text")] if texts else []
    plain = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), words.alias("words"), *extra).where("conv_id is not null")
    by = Window.partitionBy("conv_id")
    pos = F.row_number().over(by.orderBy(F.asc_nulls_first("turn"), "digest")).cast("long") - 1
    return plain.select("conv_id", pos.alias("pos"), F.count("*").over(by).alias("n_turns"), "digest", "words", *[c for c in ("role", "text") if texts])


def with_shared_openings(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt so that families share openings: as ``turns``, with a row of pos -1 for each conversation.

    Conversation c takes the first h turns of conversation c - c % family (all, if it has fewer; none, if it is absent),
    then its own turns after its first h, for h = crc32(c in decimal) % most.
    """
    given = [c for c in turns.columns if c not in ("conv_id", "pos", "n_turns")]
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    openings = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1))
    openings = openings.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", *given))).alias("heads"))  # most - 1 turns
    nothing = F.array().cast("array<struct<" + ",".join(f"{n}:{k}" for n, k in [("pos", "bigint"), *(x for x in turns.dtypes if x[0] in given)]) + ">>")
    joined = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(openings, "base", "left")
    joined = joined.withColumn("heads", F.slice(F.coalesce("heads", nothing), F.lit(1), F.col("h").cast("int"))).withColumn("n_heads", F.size("heads").cast("long"))
    own = F.struct((F.col("pos") - F.col("h") + F.col("n_heads")).alias("pos"), *given)
    root = F.struct(F.lit(-1).cast("long").alias("pos"), *[F.lit(None).cast(k).alias(n) for n, k in turns.dtypes if n in given])
    pieces = F.concat(F.when(F.col("pos") >= F.col("h"), F.array(own)).otherwise(nothing), F.when(F.col("pos") == 0, F.concat(F.array(root), "heads")).otherwise(nothing))
    n_turns = F.greatest(F.lit(0).cast("long"), F.col("n_turns") - F.col("h")) + F.col("n_heads")
    return joined.select("conv_id", n_turns.alias("n_turns"), F.explode(pieces).alias("p")).select("conv_id", "p.pos", "n_turns", *[f"p.{c}" for c in given])


def with_roots(turns: DataFrame) -> DataFrame:
    """``turns`` of numbered_turns with a row of pos -1 for each conversation, as prefix_trie takes them."""
    given = [(n, k) for n, k in turns.dtypes if n not in ("conv_id", "pos", "n_turns")]
    first = turns.where("pos = 0").select("conv_id", F.lit(-1).cast("long").alias("pos"), "n_turns", *[F.lit(None).cast(k).alias(n) for n, k in given])
    return turns.unionByName(first)


def dense_names(values: DataFrame) -> DataFrame:
    """``values`` (distinct rows) with name: 0, 1, 2, ... without gaps; only one number a partition comes to the driver."""
    rows = staged(values.withColumn("at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("at", _ROW_BITS).cast("int")
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    after = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, offset long"))
    named = rows.withColumn("part", part).join(after, "part")
    return named.select(*values.columns, (F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("name"))


def block_names(turns: DataFrame) -> list[DataFrame]:
    """For each k: (conv_id, q, n_turns, name) of the block of 2**k turns from q * 2**k on."""
    keyed = turns.where("pos >= 0").select("conv_id", F.col("pos").alias("q"), "n_turns", "digest")
    longest = keyed.agg(F.max("n_turns")).first()[0] or 0
    levels = []
    if longest:
        levels.append(staged(keyed.join(dense_names(keyed.select("digest").distinct()), "digest").drop("digest"), "blocks-0"))
    while longest >> len(levels):
        half = F.shiftright("q", 1)
        side = [F.max(F.when(F.col("q") % 2 == i, F.col("name"))).alias(c) for i, c in enumerate(("left_name", "right_name"))]
        pairs = levels[-1].groupBy("conv_id", half.alias("q")).agg(F.max("n_turns").alias("n_turns"), *side).where("left_name is not null and right_name is not null")
        names = dense_names(pairs.select("left_name", "right_name").distinct())
        levels.append(staged(pairs.join(names, ["left_name", "right_name"]).select("conv_id", "q", "n_turns", "name"), f"blocks-{len(levels)}"))
    return levels


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, words of the last turn, name: array of block names, largest block first) of each prefix."""
    rows = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_turns", "words", F.lit(None).cast("struct<k:int,name:bigint>").alias("block"))
    for k, level in enumerate(block_names(turns)):
        # a block from s on, s a multiple of 2**(k+1), is part of the prefixes of s + 2**k turns up to s + 2**(k+1) - 1
        start = F.col("q") * (1 << k)
        depths = F.sequence(start + (1 << k), F.least(F.col("n_turns"), start + (2 << k) - 1))
        block = F.struct(F.lit(-k).alias("k"), "name")
        rows = rows.unionByName(level.where("q % 2 = 0").select("conv_id", F.explode(depths).alias("depth"), "n_turns", F.lit(None).cast("long").alias("words"), block.alias("block")))
    found = rows.groupBy("conv_id", "depth").agg(F.max("n_turns").alias("n_turns"), F.max("words").alias("words"), F.sort_array(F.collect_list("block")).alias("blocks"))
    return found.select("conv_id", "depth", "n_turns", "words", F.col("blocks.name").alias("name"))


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, n_turns, words, node: smallest conv_id with this prefix, n_convs) of each prefix of each conversation."""
    names = staged(prefix_names(turns), "prefixes")
    deep = names.where("depth > 0")
    nodes = deep.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
    roots = names.where("depth = 0")
    least, number = roots.agg(F.min("conv_id"), F.count("*")).first()  # all conversations are in the root: no key of the join
    out = ("conv_id", "depth", "n_turns", "words", "node", "n_convs")
    return deep.join(nodes, ["depth", "name"]).select(*out).unionByName(roots.select(*out[:4], F.lit(least).cast("long").alias("node"), F.lit(number).cast("long").alias("n_convs")))


def _chain_sums(chains: DataFrame, first: int) -> DataFrame:
    """``chains`` (chain, parent, leaves, saved) with sums over all chains below; ``first`` is the chain without a parent."""
    now = staged(chains.select("chain", F.col("parent").alias("up"), "leaves", "saved"), "chains")
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        # the first chain has no parent: what hangs from it needs no look-up, which keeps the likeliest hot key out of the join
        far = now.where(F.col("up") != first).select("chain", "up").join(now.select(F.col("chain").alias("up"), F.col("up").alias("next_up")), "up").select("chain", "next_up")
        sums = now.join(below, "chain", "left").join(far, "chain", "left")
        add = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        now = staged(sums.select("chain", F.col("next_up").alias("up"), *add), "chains")
    return now.drop("up")


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from (node, depth, conv_id): SHA-256 of the ids in decimal, ascending, joined by commas."""
    lean_batches(ends.sparkSession)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = staged(ends.groupBy("node", "depth", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(ids.alias("ids")), "end-blocks")  # BLOCK ids at most
    number = blocks.groupBy("node", "depth").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = number.where("n = 1").select("node", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.join(number.where("n > 1").select("node", "depth"), ["node", "depth"]).select("node", "depth", "block", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if key == (node, depth):
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["node", "depth", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["node", "depth", "ends_sha256"])

    streamed = many.repartition("node", "depth").sortWithinPartitions("node", "depth", "block").mapInArrow(run, "node bigint, depth bigint, ends_sha256 string")
    return one.unionByName(streamed)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, pos, n_turns, digest, words; pos -1 once for each conversation).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = staged(turns.select("conv_id", "pos", "n_turns", "digest", "words"), "turns")
    placed = staged(prefix_nodes(turns), "placed")
    by = Window.partitionBy("conv_id").orderBy("depth")
    walk = placed.withColumn("parent", F.lag("node").over(by)).withColumn("own_child", F.coalesce(F.lead("node").over(by) == F.col("conv_id"), F.lit(False)))
    own = walk.where("node = conv_id").select("node", "depth", "parent", "n_convs", "own_child", (F.col("depth") == F.col("n_turns")).alias("last"), ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved"))
    own = staged(own, "own-nodes")
    heads = own.where("parent is null or parent <> node").select(F.col("node").alias("chain"), "parent", (F.col("depth") - 1).alias("at_depth"))
    first = turns.agg(F.min("conv_id")).first()[0]
    hung = heads.where("parent is not null").groupBy(F.col("parent").alias("node"), F.col("at_depth").alias("depth")).agg(F.count("*").alias("n"))
    leaf = own.where("last").join(hung, ["node", "depth"], "left_anti").select(F.col("node").alias("chain"), F.lit(1).cast("long").alias("leaves"))
    totals = own.groupBy(F.col("node").alias("chain")).agg(F.sum("saved").alias("saved")).join(leaf, "chain", "left").join(heads, "chain")
    sums = _chain_sums(totals.select("chain", "parent", F.coalesce("leaves", F.lit(0)).alias("leaves"), "saved"), first)
    hung = heads.where("parent is not null").join(sums, "chain").groupBy(F.col("parent").alias("node"), F.col("at_depth").alias("depth"))
    hung = hung.agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_below"))
    below = Window.partitionBy("node").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.join(hung, ["node", "depth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    leaves = F.coalesce("leaves", F.lit(0)) + (F.col("last") & (F.col("n") == 0)).cast("long")
    trie = own.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (F.col("own_child").cast("long") + F.col("n")).alias("n_children"),
        F.sum(leaves).over(below).alias("n_leaves"), F.sum(F.col("saved") + F.coalesce("saved_below", F.lit(0))).over(below).alias("saved_tokens"),
    )
    ends = end_digests(placed.where("depth = n_turns").select("node", "depth", "conv_id")).withColumnRenamed("node", "conv_id")
    return trie.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def with_last_turn(trie: DataFrame, turns: DataFrame) -> DataFrame:
    """``trie`` with role and text of each node's last turn, from ``turns`` with texts; the root has nulls."""
    last = turns.where("pos >= 0").select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    return trie.join(last, ["conv_id", "depth"], "left")
