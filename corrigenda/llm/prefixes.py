"""Prefix trie of conversations: blocks of turns are grouped by digests, turns only inside blocks that part.

A prefix is known by 128 bits: the exclusive or, over its turns, of two 64-bit hashes of the turn's digest
and place. Such a digest of a longer prefix follows from that of a shorter one, so that whole blocks are
chained by a running function, and a block's own turns from the block's rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrigenda.llm.common import cut, discard, scratch

#: Turns of a block.
BLOCK = 4
#: Conversations that share a base, and the turns that may come from it.
FAMILY, MOST_SHARED = 20, 4
#: Ids of ended conversations that are joined to one text at a time.
ID_RANGE = 1024
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _marks(digest: Column, pos: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place."""
    return F.xxhash64(digest, pos), F.xxhash64(pos, F.lit("second"), digest)


def ordered_turns(df: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words`` of every turn, numbered from 0 in each conversation.

    Null turns come first; turns with equal numbers are ordered by role and by a digest of the text.
    Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "digest", "words")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Turns after each conversation ``c`` has taken its first crc32(c) % 4 turns from conversation ``c - c % 20``."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = turns.where((F.col("pos") < MOST_SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("head")).select(F.col("conv_id").alias("base"), "head")
    first = turns.where("pos = 0").select("conv_id", shared.alias("h"), base.alias("base")).where("h > 0 and conv_id <> base").join(heads, "base", "left")
    first = first.select("conv_id", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos: bigint, digest: string, words: bigint>>)")), F.lit(1), F.col("h").cast("int")).alias("head"), "h")
    taken = first.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    own = turns.join(first.select("conv_id", "h", F.size("head").alias("n")), "conv_id", "left")
    own = own.where("h is null or pos >= h").select("conv_id", (F.col("pos") - F.coalesce("h", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("pos"), "digest", "words")
    return taken.unionByName(own)


def _by_xor(name: str, turns: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda z, t: z.bitwiseXOR(t[name]))


def _nodes(turns: DataFrame, all_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes below the root, ``depth, a, b, pa, pb, conv_id, n_convs, words, inner``, and the end of each conversation, ``conv_id, depth, a, b``.

    ``inner`` marks a node that has the members of the one above it.
    """
    a, b = _marks(F.col("digest"), F.col("pos"))
    marked = turns.select("conv_id", "pos", a.alias("a"), b.alias("b"), "words")
    blocks = marked.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("turns"))
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("xa", _by_xor("a", "turns")).withColumn("xb", _by_xor("b", "turns"))
    chained = blocks.withColumn("ea", F.expr("bit_xor(xa)").over(w)).withColumn("eb", F.expr("bit_xor(xb)").over(w))
    chained = chained.withColumn("pa", F.col("ea").bitwiseXOR(F.col("xa"))).withColumn("pb", F.col("eb").bitwiseXOR(F.col("xb")))
    chained = cut(chained.select("conv_id", "block", "turns", "pa", "pb", "ea", "eb", (F.col("block") * BLOCK + F.size("turns")).alias("depth")), "blocks")
    last = chained.groupBy("conv_id").agg(F.max_by(F.struct("depth", "ea", "eb"), "block").alias("e"))
    ends = all_ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("e.depth", F.lit(0)).alias("depth"), F.coalesce("e.ea", F.lit(0)).alias("a"), F.coalesce("e.eb", F.lit(0)).alias("b"))
    same = chained.groupBy("block", "pa", "pb", "ea", "eb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("turns").alias("turns"))
    same = cut(same, "block-groups")
    single = same.groupBy("block", "pa", "pb").agg(F.count("*").alias("n")).where("n = 1").select("block", "pa", "pb", F.lit(True).alias("single"))
    same = same.join(single, ["block", "pa", "pb"], "left")
    turn = F.expr("""transform(sequence(1, size(turns)), i -> named_struct('depth', turns[i - 1].pos + 1, 'words', turns[i - 1].words,
        'a', aggregate(slice(turns, 1, i), pa, (z, t) -> z ^ t.a), 'b', aggregate(slice(turns, 1, i), pb, (z, t) -> z ^ t.b),
        'pa', aggregate(slice(turns, 1, i - 1), pa, (z, t) -> z ^ t.a), 'pb', aggregate(slice(turns, 1, i - 1), pb, (z, t) -> z ^ t.b), 'later', i > 1))""")
    each = same.select("conv_id", "n_convs", "single", F.explode(turn).alias("t")).select("conv_id", "n_convs", "single", "t.*")
    whole = each.where("single").select("depth", "a", "b", "pa", "pb", "conv_id", "n_convs", "words", F.col("later").alias("inner"))
    parted = each.where("single is null").groupBy("depth", "a", "b", "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"))
    return whole.unionByName(parted.withColumn("inner", F.lit(False))), ends


def _digests(parts: DataFrame) -> DataFrame:
    """``conv_id, depth, sha``: the digest of each node's id texts, joined by commas in their order; a text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "depth", "ids"))):
                if (conv, depth) != now:
                    if h:
                        out.append((*now, h.hexdigest()))
                    now, h = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "sha"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "depth", "sha"])

    keys = ["conv_id", "depth"]
    return parts.repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "ids").mapInArrow(run, "conv_id bigint, depth bigint, sha string")


def _totals(paths: DataFrame) -> DataFrame:
    """``conv_id, leaves, saved`` summed over each path and all paths that hang from it, from ``paths(conv_id, up, leaves, saved)``.

    By doubling: after round i a path holds what lies fewer than 2^i paths below it, and knows the path 2^i above.
    """
    now = cut(paths, "paths")
    while not now.where("up is not null").isEmpty():
        up = now.where("up is not null")
        below = up.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        nxt = now.join(above, "up", "left").join(below, "conv_id", "left")
        before, now = now, cut(nxt.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "paths")
        discard(before)
    return now.select("conv_id", "leaves", "saved")


def conversation_trie(df: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``df(conv_id, turn, role, text)``.

    A null role or text is empty; a null turn comes first; turns with equal numbers (repeated rows too, which
    stay) are ordered by role and digest; rows without a conv_id are left out; further columns are ignored. An
    empty table gives no rows, not even a root.

    A node is known by its smallest member and its depth. The smallest member of a node is that of every deeper
    prefix of its own, so the nodes of one id form a path; sums over subtrees are sums along a path and over the
    paths that hang from it. The turns of one conversation are numbered in one task, in rows of a digest each.
    """
    with scratch(df.sparkSession) as written:
        turns = cut(ordered_turns(df), "turns")
        ids = turns.where("pos = 0").select("conv_id")
        nodes, ends = _nodes(rebuilt_turns(turns), ids)
        ends = cut(ends, "ends")
        root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        zero = F.lit(0).cast("long")
        nodes = nodes.unionByName(root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "conv_id", "n_convs", zero.alias("words"), F.lit(False).alias("inner")))
        nodes = cut(nodes, "nodes")
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent"))
        linked = nodes.where("not inner").join(above, ["depth", "pa", "pb"], "left").unionByName(nodes.where("inner").withColumn("parent", F.col("conv_id")))
        linked = cut(linked.select("conv_id", "depth", "a", "b", "n_convs", "parent", ((F.col("n_convs") - 1) * F.col("words")).alias("saves")), "linked")
        # paths: the nodes of one id, from the first below another id's node to the end of that conversation
        heads = linked.where("parent is null or parent <> conv_id").select("conv_id", F.col("parent").alias("up"), (F.col("depth") - 1).alias("at"))
        hung = heads.where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
        tails = ends.select("conv_id", "depth", F.lit(True).alias("tail"))
        rows = linked.join(hung, ["conv_id", "depth"], "left").join(tails, ["conv_id", "depth"], "left")
        children = F.coalesce("hung", F.lit(0)) + F.when(F.col("tail"), 0).otherwise(1)
        rows = cut(rows.select("conv_id", "depth", "a", "b", "n_convs", "parent", "saves", children.cast("long").alias("n_children")), "rows")
        per_path = rows.groupBy("conv_id").agg(F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("saves").alias("saved"))
        total = _totals(heads.select("conv_id", "up").join(per_path, "conv_id"))
        below = heads.where("up is not null").join(total, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        w = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("l", F.lit(0))
        summed = rows.join(below, ["conv_id", "depth"], "left").withColumn("n_leaves", F.sum(own).over(w)).withColumn("saved_tokens", F.sum(F.col("saves") + F.coalesce("s", F.lit(0))).over(w))
        part = F.floor(F.col("conv_id") / ID_RANGE)
        texts = ends.groupBy("depth", "a", "b", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
        named = texts.join(nodes.select("depth", "a", "b", "conv_id"), ["depth", "a", "b"]).select("conv_id", "depth", "part", "ids")
        out = summed.join(_digests(named), ["conv_id", "depth"], "left").select(
            "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256")
        )
        out = cut(out, "trie")
        written.pop()
    return out
