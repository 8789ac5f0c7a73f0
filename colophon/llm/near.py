"""MinHash near-dedup by fast similarity sketching, banding and exact checks.

Words are maximal runs without ASCII white space, A-Z lower-cased. The set of a
document has its distinct shingles of ``shingle`` words (five unless given); with fewer words the
whole sequence is the one shingle. Two documents are linked if
``100 * shared >= 80 * united``. Components are those of all links.

1. Every document gets a key of its whole set, a sketch and band hashes, map-only.
   Documents of equal sets are one node from then on (a grouped minimum).
2. Every node of a band bucket is compared with the least node of it. Each
   confirmed link joins two nodes; this merges large groups with a row per member.
3. Buckets that still hold several components are dealt in blocks of about
   ``BLOCK`` shingles. A block is held by one task, the members of the later blocks
   of its bucket stream past it. Of different components, pairs whose sketches agree
   in ``AGREE`` of the coordinates are confirmed on the full sets at once, and only
   links that join two components become rows: fewer than a group has members.
4. Candidates of step 2 are confirmed on the full sets by joins.

The first ``BANDED`` of ``SIZE`` coordinates, in bands of ``WIDTH``, miss a pair of
similarity 0.8 with probability 3e-6; ``AGREE`` of all coordinates lies 4.4 standard
deviations below 0.8.

Null or wordless texts have an empty set and are linked with nothing. Rows that
share a ``doc_id`` are one document of the graph. Rows without ``doc_id`` that
equal no row with one have a null component and are kept. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import sketch, words
from colophon.llm.components import components
from colophon.llm.tables import counted, documents_of, sized, table, written

SHINGLE = 5
SIZE, BANDED, WIDTH = 640, 160, 5
AGREE = 0.73
BLOCK, MEMBERS = 1 << 21, 4096
SHARED, UNITED = 100, 80


def shingle_sets(data, at, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    found = words.split(data, at, words.LOWER)
    count = np.diff(found.first)
    hashed, whole = words.grams(found, n)
    owner, hashed = found.doc[: len(hashed)][whole], hashed[whole]
    for m in range(1, n):  # texts of fewer words
        short = np.flatnonzero(count == m)
        if len(short):
            all_m, _ = words.grams(found, m)
            owner = np.concatenate([owner, short])
            hashed = np.concatenate([hashed, all_m[found.first[short]]])
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    keep = np.ones(len(hashed), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    owner, hashed = owner[keep], hashed[keep]
    return hashed, np.searchsorted(owner, np.arange(len(at)))


def _set_keys(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two independent 64-bit sums over each set."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for j in range(2):
        total = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(words.mix(hashed, 1000 + j), out=total[1:])
        out[:, j] = total[first[1:]] - total[first[:-1]]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as one binary value per row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    kind = pa.binary(width)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _lists(rows: np.ndarray) -> pa.Array:
    places = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(rows.ravel().view(np.int64)))


def _describe(shingle: int):
    def of(batches):
        for rows, data, at in words.slices(batches, words.STREAM_BYTES):
            hashed, first = shingle_sets(data, at, shingle)
            coordinates = sketch.sketches(hashed, first, SIZE)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(first)),
                    _binary(_set_keys(hashed, first)),
                    _lists(sketch.bands(coordinates[:, :BANDED], WIDTH)),
                    _binary(coordinates.astype(np.uint8)),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )

    return of


def _whole_sets(shingle: int):
    def of(batches):
        for rows, data, at in words.slices(batches, words.STREAM_BYTES):
            hashed, first = shingle_sets(data, at, shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    _binary(_set_keys(hashed, first)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashed.view(np.int64))),
                ],
                ["doc_id", "set_key", "shingles"],
            )

    return of


class _Group:
    """One block of a bucket, and the components that its links have joined so far."""

    def __init__(self):
        self.parts: list[list] = []
        self.parent: dict[int, int] = {}

    def root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            self.parent[label] = self.parent.get(up, up)
            label = up
        return label

    def add(self, member: list) -> None:
        self.parts.append(member)

    def close(self) -> None:
        """The block is complete: columns for all its members."""
        node, label, n, bands, sig, sets = zip(*self.parts)
        self.node, self.n = np.array(node), np.array(n)
        self.label = np.array([self.root(x) for x in label])
        self.bands, self.sig = np.stack(bands), np.stack(sig)
        self.sets, self.parts = list(sets), []

    def links(self, member: list, band: int, lo: int) -> Iterator[tuple[int, int]]:
        """Links of a member to those of the block from ``lo`` on that join two components."""
        node, label, n, bands, sig, own = member
        label = self.root(label)
        y = lo + np.flatnonzero(self.label[lo:] != label)
        y = y[SHARED * np.minimum(self.n[y], n) >= UNITED * np.maximum(self.n[y], n)]
        # a pair that shares several buckets is compared in the first of them only
        y = y[bands[(self.bands[y] == bands).argmax(axis=1)] == band]
        y = y[(self.sig[y] == sig).mean(axis=1) >= AGREE]
        if not len(y):
            return
        others = [self.sets[i] for i in y]
        size = np.array([len(x) for x in others])
        joined = np.concatenate(others)
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        shared = np.add.reduceat(own[place] == joined, np.cumsum(size) - size)
        for i in y[SHARED * shared >= UNITED * (size + len(own) - shared)].tolist():
            old = int(self.label[i])
            if old != label:
                yield int(self.node[i]), node
                self.parent[old] = label
                self.label[self.label == old] = label


def _linking(batches):
    """Links that join components, from rows sorted by bucket, block and ``later``."""
    group, key, closed, out = _Group(), None, False, []
    for batch in batches:
        band, block, later, node, label, n = (
            batch.column(k).to_numpy() for k in ("band", "block", "later", "node", "label", "n_shingles")
        )
        bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
        for r in range(batch.num_rows):
            if key != (band[r], block[r]):
                if key is not None and not closed:
                    out += _within(group, key[0])
                group, key, closed = _Group(), (band[r], block[r]), False
            sig = np.frombuffer(batch.column("sig")[r].as_buffer(), np.uint8).copy()
            shingles = batch.column("shingles")[r].values.to_numpy().copy()
            member = [int(node[r]), int(label[r]), int(n[r]), bands[r].copy(), sig, shingles]
            if not later[r]:
                group.add(member)
                continue
            if not closed:
                out += _within(group, key[0])
                closed = True
            out += group.links(member, key[0], 0)
        yield _pairs(out)
        out = []
    if key is not None and not closed:
        yield _pairs(_within(group, key[0]))


def _within(group: _Group, band: int) -> list[tuple[int, int]]:
    """Links between the members of a block."""
    members = group.parts
    group.close()
    return [link for i, member in enumerate(members) for link in group.links(member, band, i + 1)]


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _agree(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in ("sig_u", "sig_v"))
            keep = (a == b).mean(axis=1) >= AGREE
            yield batch.select(["u", "v"]).filter(pa.array(keep))


def _sets(docs: DataFrame, ids: DataFrame, name: str, shingle: int) -> DataFrame:
    """The full shingle sets of some documents, ``(doc_id, set_key, shingles)``."""
    ids, n = counted(ids, f"{name}-ids")
    few = sized(ids, n)
    sets = (
        docs.join(few, "doc_id", "left_semi").mapInArrow(_whole_sets(shingle), "doc_id long, set_key binary, shingles array<long>")
        .dropDuplicates(["doc_id", "set_key"])
    )
    return written(sets, f"{name}-sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, name: str, shingle: int) -> DataFrame:
    """The pairs that are links, checked on the full sets of both."""
    pairs = written(pairs.distinct(), f"{name}-pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), name, shingle)
    u = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    v = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.join(u, "u").join(v, "v")
        .select("u", "v", shared.alias("s"), (F.size("su") + F.size("sv")).alias("t"))
        .where(SHARED * F.col("s") >= UNITED * (F.col("t") - F.col("s")))
        .select("u", "v")
    )


def _open_links(texts: DataFrame, nodes: DataFrame, members: DataFrame, roots: DataFrame, shingle: int) -> DataFrame:
    """Links between the components of buckets that hold several, without those that join nothing.

    A member is held in the task of its own block and streams past those of the
    earlier blocks of its bucket.
    """
    labelled = members.join(roots, "node", "left").select(
        "band", "node", "set_key", "n_shingles", F.coalesce("root", "node").alias("label")
    )
    blocks = F.greatest(
        F.ceil(F.sum("n_shingles") / BLOCK), F.ceil(F.count(F.lit(1)) / MEMBERS)
    ).cast("int")
    open_bands = labelled.groupBy("band").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), blocks.alias("blocks")
    ).where("a <> b")
    still = written(labelled.join(open_bands.select("band", "blocks"), "band"), "near-open")
    sets = _sets(texts, still.select(F.col("node").alias("doc_id")).distinct(), "open", shingle)
    sorted_sets = sets.select(F.col("doc_id").alias("node"), "set_key", F.array_sort("shingles").alias("shingles"))
    whole = nodes.select("node", "set_key", "sig", "bands").join(sorted_sets, ["node", "set_key"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        still.withColumn("own", own).join(whole, ["node", "set_key"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own"))))
        .select("band", "block", (F.col("block") < F.col("own")).cast("int").alias("later"), "node", "label", "n_shingles", "sig", "bands", "shingles")
    )
    return dealt.repartition("band", "block").sortWithinPartitions("band", "block", "later").mapInArrow(
        _linking, "u long, v long"
    )


def described(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each document's set size, set key, band hashes and sketch bytes, map-only."""
    return documents_of(docs).mapInArrow(
        _describe(shingle), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"
    )


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Per row ``(doc_id, n_shingles, set_key)``, and ``(set_key, component_id)``."""
    texts = documents_of(docs)
    rows = written(described(docs, shingle), "near-rows")
    nodes = written(
        rows.where("n_shingles > 0").groupBy("set_key").agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sig").alias("sig"),
        ).where("node is not null"),
        "near-nodes",
    )
    slots = nodes.select("node", "set_key", "n_shingles", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(slots.join(shared.drop("n"), "band"), "near-members")

    stars = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    sig = nodes.select("node", "sig")
    agreeing = (
        stars.join(sig.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u")
        .join(sig.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
        .mapInArrow(_agree, "u long, v long")
    )
    links = written(_confirmed(texts, agreeing, "star", shingle), "near-links")
    roots = components(links)

    more = written(_open_links(texts, nodes, members, roots, shingle), "near-more")
    roots = components(links.unionByName(more))
    groups = nodes.join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "set_key"), groups


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per document."""
    rows, groups = near_groups(docs, shingle)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; repeated rows once."""
    kept = near_duplicates(docs, shingle).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
