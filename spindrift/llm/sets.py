"""Exact set-similarity join by set-relation skipping, and connected components.

Sets are arrays of 64-bit token hashes. Every set is sorted by one global token
order (rarest first) and sent to the lists of its prefix tokens. A list is kept
in blocks by (position, size); for a block the positional bound gives the range
of partner sizes that can still reach the threshold, so whole blocks are skipped
without looking at their entries. Inside a pair of blocks, sets that differ from
a leader in at most a few signature bits derive their answers from the leader's:
by the triangle inequality only the leader's near columns are looked at again.
Surviving pairs are verified exactly on the token arrays.

The token order comes from a count sketch of fixed size, so the driver never
holds more than SKETCH numbers, however large the vocabulary is. Any fixed order
gives the same result; the sketch only decides how selective prefixes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.components import components  # noqa: F401

#: Cells of the token-count sketch: the bound of what is collected and sent to tasks.
SKETCH = 1 << 16
#: Rows of one token list that are joined in one block pair; longer lists are split into block pairs.
LIST_BLOCK = 30_000
#: Signature bits by which a follower may differ from its leader.
FOLLOW_BITS = 2

WORD = r"[\p{L}\p{N}]+"


def words(text) -> F.Column:
    """Distinct runs of letters and digits in lower case; null text gives null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def token_hashes(text, salt: str = "") -> F.Column:
    """Distinct 64-bit hashes of the words of a text; ``salt`` keeps fields apart."""
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(F.lit(salt), w)))


def set_id(toks) -> F.Column:
    """64-bit id of a set of token hashes, independent of their order."""
    return F.xxhash64(F.array_sort(toks))


def _mix(h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = a.offsets.to_numpy()
    return a.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64), np.diff(off)


def _cells(h: np.ndarray) -> np.ndarray:
    return (_mix(h) & np.uint64(SKETCH - 1)).astype(np.int64)


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["cell", "n"])


def _collect_sketch(cells: DataFrame) -> np.ndarray:
    """At most SKETCH rows come to the driver."""
    out = np.zeros(SKETCH, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def token_sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all tokens of all sets by sketch cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_cells(_flat(b.column(0))[0]), minlength=SKETCH)
        yield _counted(total)

    return _collect_sketch(sets.select("toks").mapInArrow(count, "cell long, n long"))


def _prefix_rows(sid, flat, lens, df, t):
    """(token, set row, position) of every prefix token, and the set signatures."""
    row = np.repeat(np.arange(len(lens)), lens)
    order = np.lexsort((flat, df[_cells(flat)], row))
    flat, start = flat[order], np.cumsum(lens) - lens
    pos = np.arange(len(flat)) - np.repeat(start, lens)
    bit = (_mix(flat) >> np.uint64(40)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = bit < 64
    s1, s2 = np.zeros(len(lens), np.uint64), np.zeros(len(lens), np.uint64)
    np.bitwise_xor.at(s1, row[low], one[low])
    np.bitwise_xor.at(s2, row[~low], one[~low])
    keep = pos < np.repeat(lens - np.ceil(t * lens - 1e-9).astype(np.int64) + 1, lens)
    return flat[keep], row[keep], pos[keep], s1, s2


def _near(X, Y, bound):
    """Index pairs of signature rows within ``bound`` bits; X and Y are (k, 2) arrays."""
    if len(X) > 8:  # leaders first: a set that hardly differs from the one before follows it
        order = np.lexsort((X[:, 1], X[:, 0]))
        Z = X[order]
        step = np.bitwise_count(Z[1:] ^ Z[:-1]).sum(1, dtype=np.int64)
        lead = np.ones(len(X), bool)
        for k in np.flatnonzero(step <= FOLLOW_BITS) + 1:
            lead[k] = not lead[k - 1]
    else:
        order, Z, lead, step = np.arange(len(X)), X, np.ones(len(X), bool), np.zeros(0)
    L = np.flatnonzero(lead)
    d = np.bitwise_count(Z[L, None, 0] ^ Y[None, :, 0]).astype(np.int16)
    d += np.bitwise_count(Z[L, None, 1] ^ Y[None, :, 1])
    i, j = np.nonzero(d <= bound)
    out = [(order[L[i]], j)]
    at = np.cumsum(lead) - 1
    for k in np.flatnonzero(~lead):
        near = np.flatnonzero(d[at[k - 1]] <= bound + step[k - 1])
        near = near[np.bitwise_count(Z[k] ^ Y[near]).sum(1, dtype=np.int64) <= bound]
        out.append((np.full(len(near), order[k]), near))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _join_list(sid, size, pos, sig, side, t, both):
    """Candidate pairs of one token list. ``both``: the list is one block; else pairs run across its two sides."""
    a_out, b_out = [], []
    order = np.lexsort((sid, size, pos))
    sid, size, pos, sig, side = sid[order], size[order], pos[order], sig[order], side[order]
    ratio = t / (1 + t)

    def emit(i, j, X, Y):
        x, y = X[i], Y[j]
        keep = (size[y] < size[x]) | (sid[y] < sid[x])
        if not both:
            keep &= side[x] != side[y]
        x, y = x[keep], y[keep]
        dist = np.bitwise_count(sig[x] ^ sig[y]).sum(1, dtype=np.int64)
        keep = dist <= (size[x] + size[y]) - 2 * np.ceil(ratio * (size[x] + size[y]) - 1e-9)
        a_out.append(sid[x[keep]])
        b_out.append(sid[y[keep]])

    if len(sid) <= 192:
        idx = np.arange(len(sid))
        top = int(size.max())
        i, j = _near(sig, sig, int(2 * top * (1 - 2 * ratio) + 1e-9))
        x, y = idx[i], idx[j]
        keep = (size[y] <= size[x]) & (size[y] >= t * size[x] - 1e-9)
        emit(x[keep], y[keep], idx, idx)
    else:
        cuts = np.flatnonzero(np.diff(pos * 100_000 + size)) + 1
        starts = np.concatenate(([0], cuts, [len(sid)]))
        of = {}
        for p in np.unique(pos):
            of[p] = (np.searchsorted(pos, p), np.searchsorted(pos, p, "right"))
        for s, e in zip(starts[:-1], starts[1:]):
            n, i = int(size[s]), int(pos[s])
            for j, (ys, ye) in of.items():
                lo = t * n + (1 + t) * j - 1e-6  # y must still reach the overlap behind its position
                hi = min(n, (n - i) / ratio - n) + 1e-6  # and x behind its own
                if hi < lo:
                    continue
                y0 = ys + np.searchsorted(size[ys:ye], lo)
                y1 = ys + np.searchsorted(size[ys:ye], hi, "right")
                if y1 <= y0:
                    continue
                top = n + int(size[y1 - 1])
                bound = int(top * (1 - 2 * ratio) + 1e-9)
                Y = np.arange(y0, y1)
                rows = max(1, 2_000_000 // len(Y))
                for x0 in range(s, e, rows):
                    X = np.arange(x0, min(e, x0 + rows))
                    a, b = _near(sig[X], sig[Y], bound)
                    if len(a):
                        emit(a, b, X, Y)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def candidates(sets: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b), a < b, that may reach ``t``; no reaching pair is missing. sets: (sid, toks), distinct sids."""
    spark = sets.sparkSession
    df = spark.sparkContext.broadcast(token_sketch(sets))  # SKETCH numbers

    def count_prefixes(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            if b.num_rows:
                flat, lens = _flat(b.column(0))
                total += np.bincount(_cells(_prefix_rows(None, flat, lens, df.value, t)[0]), minlength=SKETCH)
        yield _counted(total)

    lists = _collect_sketch(sets.select("toks").mapInArrow(count_prefixes, "cell long, n long"))
    blocks = spark.sparkContext.broadcast(np.maximum(1, -(-lists // LIST_BLOCK)))  # an upper bound of each list's blocks

    def emit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sid = b.column(0).to_numpy(zero_copy_only=False)
            flat, lens = _flat(b.column(1))
            tok, row, pos, s1, s2 = _prefix_rows(sid, flat, lens, df.value, t)
            n = blocks.value[_cells(tok)]
            own = (_mix(sid[row] + 1) >> np.uint64(33)).astype(np.int64) % n
            rep = np.repeat(np.arange(len(tok)), n)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            cell = np.minimum(own[rep], other) * 100_000 + np.maximum(own[rep], other)
            r = row[rep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tok[rep]), pa.array(cell.astype(np.int32)), pa.array(sid[r]), pa.array(lens[r].astype(np.int32)), pa.array(pos[rep].astype(np.int32)),
                    pa.array(s1[r].view(np.int64)), pa.array(s2[r].view(np.int64)), pa.array(own[rep].astype(np.int32)),
                ],
                ["tok", "cell", "sid", "size", "pos", "s1", "s2", "own"],
            )

    def join(batches):
        held = []

        def done(parts):
            c = [np.concatenate([p[k] for p in parts]) for k in range(8)]
            edge = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1
            for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(c[0])]))):
                if e - s > 1:
                    one = int(c[1][s]) // 100_000 == int(c[1][s]) % 100_000
                    a, b = _join_list(c[2][s:e], c[3][s:e].astype(np.int64), c[4][s:e].astype(np.int64), np.stack([c[5][s:e], c[6][s:e]], 1).view(np.uint64), c[7][s:e], t, one)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            edge = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1
            if len(edge) == 0:
                if held and (held[-1][0][-1], held[-1][1][-1]) != (c[0][0], c[1][0]):
                    yield from done(held)
                    held = []
                held.append(c)
            else:
                yield from done([*held, [x[: edge[-1]] for x in c]])
                held = [[x[edge[-1] :] for x in c]]
        if held:
            yield from done(held)

    rows = sets.select("sid", "toks").mapInArrow(emit, "tok long, cell int, sid long, size int, pos int, s1 long, s2 long, own int")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "tok", "cell").sortWithinPartitions("tok", "cell").mapInArrow(join, "a long, b long").distinct()


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """All pairs (a, b, likeness) of distinct sets with Jaccard likeness >= t, verified on the token arrays.

    sets: (sid long, toks array<long>), one row per distinct set, best cut() before.
    Empty sets are like nothing.
    """
    sets = sets.filter(F.size("toks") > 0)
    pairs = candidates(sets, t)
    own = sets.select("sid", "toks")
    full = (
        pairs.join(own.select(F.col("sid").alias("a"), F.col("toks").alias("ta")), "a")
        .join(own.select(F.col("sid").alias("b"), F.col("toks").alias("tb")), "b")
        .withColumn("common", F.size(F.array_intersect("ta", "tb")))
    )
    like = F.col("common") / (F.size("ta") + F.size("tb") - F.col("common"))
    return full.withColumn("likeness", like).filter(F.col("likeness") >= t - 1e-12).select("a", "b", "likeness")
