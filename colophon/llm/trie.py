"""Conversation prefix trie by whole-sequence collapse.

A node of depth ``d`` is a distinct sequence of the first ``d`` turns (role, text); its
members are the conversations that start with it.

1. A conversation's sequence has a key: its length and two exclusive-or sums of hashes
   of (depth, turn), 128 bits in all, on which the equality of sequences rests. Such
   sums need no order, so a huge conversation is summed by many tasks.
2. Conversations of one key collapse to a weighted sequence with the list of those that
   end there; from here on only the least conversation of each stands for it.
3. Prefixes of these, by running sums, are grouped to nodes. Sequences that are proper
   prefixes of others go by an anti-join on the parents' keys; those left are leaves.
4. Subtree sums need no descent. Let ``B`` be the bytes of a sequence. Every node belongs
   to its least sequence, which owns the end of its path from some byte ``f`` on. A
   subtree that begins at byte ``b`` has ``sum(weight * (B - b))`` bytes with repeats
   and ``sum(B - f) + f(least) - b`` without: both are sums over its sequences.

Turns are ordered by ``turn``, nulls first. Ties fall to the first 32 characters of role
and of text, then to their digests; equal rows are turns of their own. Null roles and
texts are empty. Rows without ``conv_id`` are no conversation. A conversation without
turns is a member of the root. An empty table gives no rows; other columns are ignored.
Texts of any length are hashed once, where they are read. End lists are hashed in
order as streams of joined chunks of ids, never gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import running
from colophon.llm.tables import counted, table, written
from colophon.operators.skew import MIN_HOT_ROWS, hot_keys, salted_left_join

GROUP, LONGEST = 5, 9
CHUNK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """Every turn's hashes and size with its ``place`` (from 1) in its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.substring(role, 1, 32).alias("role_head"),
        F.substring(text, 1, 32).alias("text_head"),
        F.concat(F.md5(role), F.md5(text)).alias("digest"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = ["conv_id", "turn", "role_head", "text_head", "digest"]
    rows = running.arranged(written(narrow, "trie-narrow"), order, "trie-sorted")
    rows = rows.select("conv_id", "part", "at", "t1", "t2", "size")
    parts = running.key_parts(rows, ["conv_id"], {"n": F.count(F.lit(1))})
    starts = running.before(parts, ["conv_id"], {"start": F.sum("n")}).drop("n")
    nth = rows.withColumn("nth", F.count(F.lit(1)).over(running.inside(["conv_id"])))
    place = F.coalesce("start", F.lit(0)) + F.col("nth")
    return written(
        nth.join(starts, ["conv_id", "part"]).select("conv_id", "part", "at", place.alias("place"), "t1", "t2", "size"),
        "trie-turns",
    )


def rebuilt(placed: DataFrame, group: int = GROUP, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first one of their group.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % group``, as far as it
    has them, and goes on with its own turns after its first ``h``, where ``h`` is
    ``crc32(c) % longest``. Returns its turns by ``depth``, and all ``conv_id``.
    """
    parts = running.key_parts(placed, ["conv_id"], {"n": F.count(F.lit(1))})
    sizes = written(parts.groupBy("conv_id").agg(F.sum("n").alias("n")), "trie-sizes")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(
        sizes.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % longest).alias("h"))
        .join(heads, "base", "left")
        .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))),
        "trie-convs",
    )
    shift = parts.select("conv_id", "part").join(convs.select("conv_id", "h", "m"), "conv_id")
    own = placed.join(shift, ["conv_id", "part"]).where(F.col("place") > F.col("h")).select(
        "conv_id", "part", "at", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "t1", "t2", "size"
    )
    first = placed.where(F.col("place") < longest).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "size")
    lent = convs.join(first, "base").where(F.col("place") <= F.col("h")).select(
        "conv_id", F.lit(-1).cast("long").alias("part"), F.col("place").alias("at"), F.col("place").alias("depth"), "t1", "t2", "size"
    )
    return own.unionByName(lent), convs.select("conv_id")


def plain(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are."""
    rows = placed.withColumnRenamed("place", "depth")
    return rows, rows.select("conv_id").distinct()


def _chunks(batches):
    """Joined ids of up to ``CHUNK`` rows of one sequence, from rows in order."""
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in ("length", "k1", "k2", "at", "conv_id")]
        rows, lo = list(zip(*cols[:3])), 0
        out = []
        while lo < len(rows):
            hi = lo + 1
            while hi < len(rows) and hi - lo < CHUNK and rows[hi] == rows[lo]:
                hi += 1
            out.append((*rows[lo], cols[3][lo], ",".join(map(str, cols[4][lo:hi]))))
            lo = hi
        if out:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in list(zip(*out))[:4]], pa.array([r[4] for r in out])],
                ["length", "k1", "k2", "at", "ids"],
            )


def _digests(batches):
    """The digest of each sequence's chunks, which come in order."""
    key, state = None, None
    for batch in batches:
        out = []
        for *now, ids in zip(*[batch.column(k).to_pylist() for k in ("length", "k1", "k2", "ids")]):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*_NODE, "ends_sha256"])


def _ends(keyed: DataFrame) -> DataFrame:
    """The digest of the ids, ascending and joined, of the conversations of each sequence."""
    keys = ["length", "k1", "k2"]
    rows = running.arranged(keyed.select(*keys, "conv_id"), [*keys, "conv_id"], "trie-ends")
    chunks = rows.select(*keys, "at", "conv_id").mapInArrow(_chunks, "length long, k1 long, k2 long, at long, ids string")
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(
        _digests, "depth long, p1 long, p2 long, ends_sha256 string"
    )


def _xor(*columns: Column) -> Column:
    out = F.coalesce(columns[0], F.lit(0).cast("long"))
    for c in columns[1:]:
        out = out.bitwiseXOR(F.coalesce(c, F.lit(0).cast("long")))
    return out


def trie(rows: DataFrame, convs: DataFrame, min_hot: int = MIN_HOT_ROWS) -> DataFrame:
    """A row per node. ``rows`` are turns by ``conv_id`` and ``depth`` (from 1), as made by
    ``rebuilt`` or ``plain``; ``convs`` names all conversations."""
    rows = written(
        rows.select(
            "conv_id", "part", "at", F.col("depth").cast("long").alias("depth"), "size",
            F.xxhash64("depth", "t1").alias("k1"), F.xxhash64("t2", "depth").alias("k2"),
        ),
        "trie-rows",
    )
    total = {"k1": F.bit_xor("k1"), "k2": F.bit_xor("k2"), "size": F.sum("size"), "n": F.count(F.lit(1))}
    parts = written(running.key_parts(rows, ["conv_id"], total), "trie-parts")
    whole = parts.groupBy("conv_id").agg(
        F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("size").alias("bytes"), F.sum("n").alias("length")
    )
    keyed = written(convs.join(whole, "conv_id", "left").na.fill(0), "trie-keyed")
    keys = ["length", "k1", "k2"]
    sequences = written(
        keyed.groupBy(*keys).agg(
            F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"), F.first("bytes").alias("bytes")
        ),
        "trie-sequences",
    )
    starts = running.before(
        parts, ["conv_id"], {"y1": F.bit_xor("k1"), "y2": F.bit_xor("k2"), "b": F.sum("size")}
    ).select(F.col("conv_id").alias("seq"), "part", "y1", "y2", "b")
    starts = written(starts.join(sequences.select("seq", "weight", "bytes"), "seq"), "trie-starts")

    window = running.inside(["seq"])
    ahead = (
        rows.withColumnRenamed("conv_id", "seq").join(starts, ["seq", "part"])
        .withColumn("p1", _xor(F.col("y1"), F.bit_xor("k1").over(window)))
        .withColumn("p2", _xor(F.col("y2"), F.bit_xor("k2").over(window)))
        .withColumn("through", F.coalesce("b", F.lit(0)) + F.sum("size").over(window))
    )
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    roots = sequences.select(
        "seq", F.lit(-2).cast("long").alias("part"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"),
        none.alias("up1"), none.alias("up2"), zero.alias("before"), "weight", "bytes",
    )
    prefixes = written(
        ahead.select(
            "seq", "part", "depth", "p1", "p2", _xor(F.col("p1"), F.col("k1")).alias("up1"),
            _xor(F.col("p2"), F.col("k2")).alias("up2"), (F.col("through") - F.col("size")).alias("before"), "weight", "bytes",
        ).unionByName(roots),
        "trie-prefixes",
    )
    parents = prefixes.where("depth > 0").select(
        (F.col("depth") - 1).alias("length"), F.col("up1").alias("k1"), F.col("up2").alias("k2")
    ).distinct()
    leaves = sequences.join(parents, keys, "left_anti").select("seq", F.lit(1).alias("leaf"))
    own = prefixes.groupBy(*_NODE).agg(F.min("seq").alias("seq"), F.min("before").alias("before"))
    own = own.groupBy("seq").agg(F.min("before").alias("own"))
    known = sequences.select("seq", "bytes").join(own, "seq", "left").join(leaves, "seq", "left").select(
        "seq", F.coalesce("own", "bytes").alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    places = starts.select("seq", "part").unionByName(roots.select("seq", "part"))
    nodes = (
        prefixes.join(places.join(known, "seq"), ["seq", "part"])
        .groupBy(*_NODE)
        .agg(
            F.min("seq").alias("conv_id"),
            F.first("up1").alias("up1"),
            F.first("up2").alias("up2"),
            F.min("before").alias("before"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("bytes")).alias("repeated"),
            F.sum(F.col("bytes") - F.col("own")).alias("single"),
            F.min_by("own", "seq").alias("least_own"),
        )
    )
    nodes, n = counted(nodes, "trie-nodes")
    children = written(
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2"))
        .agg(F.count(F.lit(1)).alias("n")),
        "trie-children",
    )
    up = ["above", "up1", "up2"]
    upward = [F.col(a).alias(b) for a, b in zip(_NODE, up)]
    named = salted_left_join(
        nodes.withColumn("above", F.col("depth") - 1),
        nodes.select(*upward, F.col("conv_id").alias("parent_conv_id")),
        up, hot_keys(children.select(*upward, "n"), n, min_hot), F.col("conv_id"),
    )
    saved = (
        F.col("repeated") - F.col("n_convs") * F.col("before")
        - F.col("single") - F.col("least_own") + F.col("before")
    )
    return (
        named.join(children.withColumnRenamed("n", "n_children"), _NODE, "left").join(_ends(keyed), _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))
