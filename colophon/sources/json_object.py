"""One JSON object split at its entries by many tasks, however it is formatted.

Files are cut into blocks of bytes, anywhere. What a block does to a reader is a small
function: from the state at its begin (in a string? behind a backslash?) to the state at
its end and the change of depth. These functions compose, so the state at every block's
begin follows from groups of ``FAN`` blocks, then groups of groups, and back again: no
task sees more than ``FAN`` of them. Then each block gives the entries that begin in it,
and reads on to the end of its last one.

A file whose first byte that is no blank is not ``{`` goes on inside the object, as the
later part files of a written document do. The functions that run in tasks are nested so
that they travel by value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.text import absolute_path
from colophon.sources.files import TASK_BYTES, _store
from colophon.sources.shared import materialize

# Blocks are no longer than this; tables hold values below 2 GB.
BLOCK = 1 << 24
ENTRY = (1 << 31) - (1 << 20)
FAN = 1024

# A state's number: 2 if in a string, plus 1 if behind a backslash.
_EFFECT = "to array<int>, deeper array<long>"


def _structure():
    """``(bytes, state) -> (places of signs outside of strings, state at the end)``."""

    def structure(raw: bytes, state: int):
        import numpy as np

        data = np.frombuffer(raw, np.uint8)
        if state & 1:
            data = np.concatenate([np.frombuffer(b"\\", np.uint8), data])
        lead = state & 1
        slashes = np.flatnonzero(data == 92)
        fresh = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        first, past = slashes[fresh], slashes[np.append(fresh[1:], len(slashes)) - 1] + 1 if len(slashes) else slashes
        signs = np.zeros(256, bool)
        signs[list(b'"{}[],')] = True
        places = np.flatnonzero(signs[data])
        # an odd run of backslashes right before a sign escapes it
        run = np.searchsorted(past, places)
        touched = run < len(past)
        touched[touched] = past[run[touched]] == places[touched]
        escaped = np.zeros(len(places), bool)
        escaped[touched] = (past - first)[run[touched]] % 2 == 1
        quote = (data[places] == 34) & ~escaped
        quotes = np.cumsum(quote)
        outside = (quotes + (state >> 1)) % 2 == 0
        ends_odd = bool(len(past)) and past[-1] == len(data) and (past[-1] - first[-1]) % 2 == 1
        after = (int(quote.sum()) + (state >> 1)) % 2 * 2 + int(ends_odd)
        return places[outside & ~quote] - lead, after

    return structure


def _steps():
    def steps(raw: bytes, places):
        import numpy as np

        sign = np.frombuffer(raw, np.uint8)[places]
        up, down = (sign == 123) | (sign == 91), (sign == 125) | (sign == 93)
        return up.astype(np.int64) - down, sign

    return steps


def _effects(block: int):
    """A block's function, and the first byte that is no blank."""
    store_of, structure, steps = _store(), _structure(), _steps()

    def effects(batches):
        for batch in batches:
            for path, n in zip(*(batch.column(c).to_pylist() for c in ("file", "n"))):
                store, place, _ = store_of(path)
                with store.open_input_file(place) as f:
                    raw = f.read_at(min(block, f.size() - n * block), n * block)
                to, deeper = [], []
                for state in range(4):
                    places, after = structure(raw, state)
                    to.append(after)
                    deeper.append(int(steps(raw, places)[0].sum()))
                head = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] or None
                row = ([path], [n], [to], [deeper], [head])
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(row, kinds)], ["file", "n", "to", "deeper", "head"]
                )

    return effects


def _compose(fan: int):
    """The functions of up to ``fan`` neighbours as one."""

    def compose(table: pa.Table) -> pa.Table:
        rows = table.sort_by("n").to_pylist()
        to, deeper = [0, 1, 2, 3], [0, 0, 0, 0]
        for r in rows:
            deeper = [d + r["deeper"][s] for d, s in zip(deeper, to)]
            to = [r["to"][s] for s in to]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        row = ([rows[0]["file"]], [rows[0]["n"] // fan], [to], [deeper])
        return pa.table([pa.array(v, k) for v, k in zip(row, kinds)], ["file", "n", "to", "deeper"])

    return compose


def _deal():
    """The state and depth at the begin of each of some neighbours, from those of the first."""

    def deal(table: pa.Table) -> pa.Table:
        rows = table.sort_by("n").to_pylist()
        state, depth = rows[0]["state"], rows[0]["depth"]
        out = []
        for r in rows:
            out.append((r["file"], r["n"], state, depth))
            depth, state = depth + r["deeper"][state], r["to"][state]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "n", "state", "depth"])

    return deal


def _entries(block: int, most: int):
    store_of, structure, steps = _store(), _structure(), _steps()

    def level(raw, state, depth):
        places, after = structure(raw, state)
        step, sign = steps(raw, places)
        return places, step, sign, depth + step.cumsum(), after

    def finish(f, at, state, depth):
        """The bytes from ``at`` to the end of the entry, and whether it ends.

        At the end of the file that is not known, unless it ends inside of a value.
        """
        parts, size = [], 0
        while at < f.size():
            raw = f.read_at(min(block, f.size() - at), at)
            places, step, sign, depths, state = level(raw, state, depth)
            ends = places[((sign == 44) & (depths == 1)) | ((step < 0) & (depths == 0))]
            parts.append(raw if not len(ends) else raw[: ends[0]])
            size += len(parts[-1])
            if size > most:
                raise ValueError("an entry of more than 2 GB")
            if len(ends):
                return b"".join(parts), True
            depth, at = int(depths[-1]) if len(depths) else depth, at + len(raw)
        return b"".join(parts), None if depth == 1 and state == 0 else False

    def entries(batches):
        import numpy as np

        for batch in batches:
            for path, n, state, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "n", "state", "depth"))):
                store, place, _ = store_of(path)
                with store.open_input_file(place) as f:
                    raw = f.read_at(min(block, f.size() - n * block), n * block)
                    places, step, sign, depths, after = level(raw, state, depth)
                    starts = places[((sign == 44) | (sign == 123)) & (depths == 1) & (step >= 0)] + 1
                    ends = places[((sign == 44) & (depths == 1)) | ((step < 0) & (depths == 0))]
                    if n == 0 and depth == 1:  # the file goes on inside the object
                        starts = np.concatenate([[0], starts])
                    found = []
                    for lo, k in zip(starts.tolist(), np.searchsorted(ends, starts).tolist()):
                        if k < len(ends):
                            found.append((raw[lo : int(ends[k])], True))
                        else:
                            last = int(depths[-1]) if len(depths) else depth
                            more, done = finish(f, n * block + len(raw), after, last)
                            whole = raw[lo:] + more
                            found.append((whole, whole.rstrip().endswith(b"}") if done is None else done))
                values = [v for v, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array(values, pa.binary()), pa.array([d for _, d in found], pa.bool_())],
                    ["file", "value", "done"],
                )

    return entries


def object_entries(spark: SparkSession, path: str, block: int | None = None, fan: int = FAN) -> DataFrame:
    """The entries ``"key": value`` of JSON objects, ``(file, value, done)``.

    ``value`` has the entry's bytes. An entry that the end of its file cuts off is
    not ``done``. Blocks have at most ``spark.sql.files.maxPartitionBytes``.
    """
    if block is None:
        block = min(BLOCK, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    # names and sizes only: the contents are not read by this
    listed = spark.read.format("binaryFile").load(path).where("length > 0")
    files = listed.select(absolute_path(F.col("path")).alias("file"), "length")
    files, seen = materialize(files, "object-files", bytes=F.sum("length"), longest=F.max("length"))
    tasks = max((seen["bytes"] or 0) // TASK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block}"))).alias("n"))
    effects = blocks.repartition(tasks).mapInArrow(_effects(block), f"file string, n long, {_EFFECT}, head binary")
    effects, _ = materialize(effects, "object-blocks")
    levels, many = [effects.drop("head")], ((seen["longest"] or 1) - 1) // block + 1
    while many > 1:
        above = levels[-1].groupBy("file", F.expr(f"n div {fan}")).applyInArrow(_compose(fan), f"file string, n long, {_EFFECT}")
        levels.append(materialize(above, "object-groups")[0])
        many = (many - 1) // fan + 1
    heads = effects.where("head is not null").groupBy("file").agg(F.min_by("head", "n").alias("head"))
    known = heads.select(
        "file", F.lit(0).cast("long").alias("n"), F.lit(0).alias("state"),
        F.when(F.col("head") == F.lit(b"{"), 0).otherwise(1).cast("long").alias("depth"),
    )
    # from the groups of all blocks down to the blocks
    for below in reversed(levels[:-1]):
        group = known.withColumnRenamed("n", "g")
        known = (
            below.withColumn("g", F.expr(f"n div {fan}")).join(group, ["file", "g"])
            .groupBy("file", "g").applyInArrow(_deal(), "file string, n long, state int, depth long")
        )
    return known.repartition(tasks).mapInArrow(_entries(block, ENTRY), "file string, value binary, done boolean")
