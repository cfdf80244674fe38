"""Sequence scores that SQL can't say, as Arrow batch functions: common subsequence, difflib ratio, overlap merge, feature hashing."""

from __future__ import annotations

import difflib
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, row by row."""
    if not a or not b:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(b))}
    y = np.array([code[w] for w in b])
    prev = np.zeros(len(b) + 1, np.int64)
    for w in a:
        hit = y == code.get(w, -1)
        row = np.zeros_like(prev)
        row[1:] = np.maximum(prev[1:], np.where(hit, prev[:-1] + 1, 0))
        prev = np.maximum.accumulate(row)
    return int(prev[-1])


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """(id, rouge1, rouge2, rouge_l, meteor) of (id, prediction, reference): F1 of words and of word pairs, recall-weighted subsequence F, set overlap."""

    def score(frames):
        for pdf in frames:
            out = []
            for i, p, r in zip(pdf["id"], pdf["prediction"], pdf["reference"]):
                a, b = _TOKEN.findall(p.lower()), _TOKEN.findall(r.lower())
                common = sum((Counter(a) & Counter(b)).values())
                f1 = 2 * common / (len(a) + len(b)) if a or b else 1.0
                ta, tb = list(zip(a, a[1:])), list(zip(b, b[1:]))
                f2 = 2 * sum((Counter(ta) & Counter(tb)).values()) / (len(ta) + len(tb)) if ta or tb else float(a == b)
                n = lcs_length(a, b)
                x, y = (n / len(a), n / len(b)) if n else (0.0, 0.0)
                f = (1 + 1.44) * x * y / (y + 1.44 * x) if n else 0.0
                sa, sb = set(a), set(b)
                m = len(sa & sb)
                u, v = (m / len(sa), m / len(sb)) if m else (0.0, 0.0)
                out.append((i, round(f1, 6), round(f2, 6), round(f, 6), round(u * v / (0.9 * u + 0.1 * v), 6) if m else 0.0))
            yield pd.DataFrame(out, columns=["id", "rouge1", "rouge2", "rouge_l", "meteor"])

    return pairs.mapInPandas(score, "id string, rouge1 double, rouge2 double, rouge_l double, meteor double")


def sequence_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with a column ``ratio``: difflib's ratio of a to b, which is not symmetric.

    Its function counts as nondeterministic, else Spark runs it below earlier filters, on rows that they drop, and again behind them.
    """
    f = F.pandas_udf(lambda x, y: pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype=float), "double").asNondeterministic()
    return pairs.withColumn("ratio", f(F.col(a), F.col(b)))


#: Rows of a block of texts; two blocks meet in one task, in chunks of rows whose cost tables have TABLE bytes or so.
TEXT_BLOCK, CHUNK, TABLE = 8192, 4096, 1 << 24
#: Symbols of normalized texts (0 for none, letters, blank, digits, any other); places that a piece of a word has at most.
_SYMBOLS, _PIECE = 39, 10


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 38 of normalized texts, one row each and 0 behind their ends, and the lengths."""
    code = np.full(256, 38, np.uint8)
    code[97:123], code[32], code[48:58] = np.arange(1, 27), 27, np.arange(28, 38)
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), size.max()), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = code[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]
    return out, size


def _padded(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes with a blank before and behind every text; its places 0 to size lie between two symbols each."""
    out = np.zeros((len(codes), codes.shape[1] + 2 + _PIECE), np.uint8)
    out[:, 1 : codes.shape[1] + 1] = codes
    out[:, 0] = out[np.arange(len(codes)), size + 1] = 27
    return out


def _pieces(codes: np.ndarray, size: np.ndarray, centre: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place's word, cut into pieces, as (table, kind of each piece, first piece of each text).

    table: the bucket and two neighbours at each place of every kind, -1 behind its end. A kind is a piece's symbols,
    all of them, with the bucket of its place, counted from the text's middle in half places.
    """
    pad, place = _padded(codes, size), np.arange(codes.shape[1] + 1)
    word = np.maximum.accumulate(np.where(pad[:, : len(place)] == 27, place, 0), 1)
    row, at = np.nonzero((place <= size[:, None]) & ((place - word) % _PIECE == 0))
    many = np.where(np.append(row[1:], -1) == row, np.append(at[1:], 0), size[row] + 1) - at
    flat, base, bucket = pad.reshape(-1), row * pad.shape[1] + at, (2 * at - size[row] + centre) // width
    key = bucket.astype(np.uint64)
    for o in range(_PIECE + 1):
        key = key * np.uint64(_SYMBOLS) + np.where(o <= many, flat[base + o], 0).astype(np.uint64)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    base, many, bucket = base[first], many[first], bucket[first]
    two = [(bucket * _SYMBOLS + flat[base + o]) * _SYMBOLS + flat[base + o + 1] for o in range(_PIECE)]
    return np.stack([np.where(o < many, t, -1) for o, t in enumerate(two)], 1), kind, np.searchsorted(row, np.arange(len(codes) + 1))


def _present(codes: np.ndarray, size: np.ndarray, centre: int, width: int, least: float, rows: np.ndarray) -> np.ndarray:
    """1 where a text (column) has two neighbours of a bucket (row) at a place that a like text's may have gone to; the last row is all 1.

    Counted from the middles, neighbours that stay move by half the characters that differ, at most. rows: the row of every
    bucket and two neighbours, the last but one for those that nobody looks for.
    """
    pad, place = _padded(codes, size), np.arange(codes.shape[1] + 1)
    two = pad[:, : len(place)].astype(np.int64) * _SYMBOLS + pad[:, 1 : len(place) + 1]
    at = 2 * place - size[:, None] + centre
    reach = np.floor(size * 2 * (1 - least) / least + 1e-9).astype(np.int64)[:, None]
    low = np.maximum((at - reach - 2 * (_PIECE - 1)) // width, 0)
    high = np.where(place <= size[:, None], np.minimum((at + reach) // width, 2 * centre // width), -1)
    out, column = np.zeros((rows.max() + 2, len(codes)), np.uint8), np.broadcast_to(np.arange(len(codes))[:, None], two.shape)
    for o in range(int((high - low).max()) + 1):
        on = low + o <= high
        out.reshape(-1)[rows[((low + o) * _SYMBOLS**2 + two)[on]] * len(codes) + column[on]] = 1
    out[-1] = 1
    return out


def _few_missing(codes: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least: float):
    """Chunks of pairs (p, q), rows of left and right, of which q has enough of p's neighbours for a common subsequence of ``least`` of the mean length.

    Two neighbours are lost by a character that p alone has, one by a character that q alone has; q has all others, not
    far from their place. What a piece of a word lacks in every row q is counted once for all rows p that have it at that
    place. Rows come by size; where left is right, pairs come once, by its order.
    """
    centre = int(max(size[left].max(), size[right].max())) + 2
    width = max(32, -(-2 * centre // 50))  # a kind's key has room for 57 buckets
    need = np.ceil(least * np.arange(2 * centre) / 2 - 1e-9).astype(np.int64)
    kinds = np.uint8 if centre < 255 else np.uint16
    for x in range(0, len(left), CHUNK):
        i = left[x : x + CHUNK]
        table, kind, cut = _pieces(codes[i], size[i], centre, width)
        used = np.unique(table[table >= 0])
        rows = np.full((2 * centre // width + 1) * _SYMBOLS**2, len(used))
        rows[used] = np.arange(len(used))
        table = np.where(table < 0, len(used) + 1, rows[table])
        columns = min(CHUNK, max(256, TABLE // max(table.shape[0], len(used))))
        near = right[x:] if left is right else right
        near = near[(size[near] >= size[i].min() * least / (2 - least) - 1e-9) & (size[near] <= size[i].max() * (2 - least) / least + 1e-9)]
        for y in range(0, len(near), columns):
            j = near[y : y + columns]
            here = _present(codes[j], size[j], centre, width, least, rows)
            lacks = np.empty((len(table), len(j)), np.uint8)
            for z in range(0, len(table), 64):
                lacks[z : z + 64] = _PIECE - here[table[z : z + 64]].sum(1, dtype=np.uint8)
            most, found = {}, []
            for p in range(len(i)):
                if (n := int(size[i[p]])) not in most:
                    most[n] = np.clip(2 * n + size[j] - 3 * need[n + size[j]] + 1, 0, np.iinfo(kinds).max).astype(kinds)
                q = np.flatnonzero(lacks.take(kind[cut[p] : cut[p + 1]], 0).sum(0, dtype=kinds) < most[n])
                q = q[q > p - y] if left is right else q
                found.append((np.full(len(q), p), q))
            p, q = (np.concatenate(f) for f in zip(*found))
            yield i[p], j[q]


def _lcs_of_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows a of x and b of y, all pairs at once by bit vectors; 0 stands for no symbol."""
    width = -(-x.shape[1] // 64)
    rows, back = np.unique(a, return_inverse=True)
    own = np.zeros((len(rows), width * 64), np.uint8)
    own[:, : x.shape[1]] = x[rows]
    at = np.zeros((39, width, len(rows)), np.uint64)
    for c in range(1, 39):
        at[c] = np.packbits(own == c, axis=1, bitorder="little").view(np.uint64).T
    flat, place = at.reshape(-1), y[b].T.astype(np.int64) * (width * len(rows)) + back
    rest = np.full((width, len(a)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for p in place:
        carry = None
        for w in range(width):
            u = rest[w] & flat[p + w * len(rows)]
            s = rest[w] + u
            if width > 1:
                over = s < u
                if carry is not None:
                    s += carry
                    over |= s < carry
                carry = over.astype(np.uint64)
            rest[w] = s | (rest[w] & ~u)
    return width * 64 - np.bitwise_count(rest).sum(0, dtype=np.int64)


def _may_reach(codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False for pairs whose heads and tails alone miss too much for a common subsequence of ``least`` of the mean length.

    A symbol of the shorter text has its partner at most as many places further on as the longer text may lack partners, so
    its first symbols are looked for in a window at the longer text's head, its last ones at the tail; what both miss adds up.
    """
    short, long = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    need = np.ceil(least * (size[a] + size[b]) / 2 - 1e-9).astype(np.int64)
    window = 64 * max(1, round(float(size[a].mean()) / 170))
    first = min(window - int((size[long] - need).max()), int(size[short].min()) // 2)
    if first < 16 or codes.shape[1] < window:
        return np.ones(len(a), bool)
    ends = size[:, None] - 1 - np.arange(window)
    tails = np.where(ends >= 0, np.take_along_axis(codes, np.maximum(ends, 0), 1), 0)
    miss = first - _lcs_of_pairs(codes[:, :window], codes[:, :first], long, short)
    keep = miss <= size[short] - need
    at = np.flatnonzero(keep)
    keep[at] = miss[at] + first - _lcs_of_pairs(tails, tails[:, :first], long[at], short[at]) <= (size[short] - need)[at]
    return keep


def ratio_candidates(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of texts whose common subsequence lets difflib's ratio reach ``least``; none is missing.

    texts: (k string, text string), distinct k, no empty text. Texts are put in classes by the logarithm of their
    length, so that pairs lie in one class or two next to each other; classes are cut into blocks by hash, and every
    pair of blocks is compared on its own: neighbours that one text misses, then what heads and tails miss, then the
    common subsequence of what is left. Block pairs are spread by their number, as few rows hold much work.
    """
    widest = math.log((2 - least) / least) + 1e-9  # of the longer to the shorter length
    t = texts.withColumn("c", F.floor(F.log(F.length("text")) / widest).cast("int"))
    blocks = {r["c"]: -(-r["n"] // TEXT_BLOCK) for r in t.groupBy("c").agg(F.count("*").alias("n")).collect()}  # one row per class
    of = lambda c: F.coalesce(F.try_element_at(sizes, c), F.lit(0))
    sizes = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else F.expr("cast(map() as map<int,int>)")
    n, after, before = of(F.col("c")), of(F.col("c") + 1), of(F.col("c") - 1)
    t = t.withColumn("h", F.pmod(F.xxhash64("k"), n).cast("int"))
    upto = lambda m, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), lambda o: o < m), f)
    cell = lambda c, x, d, y: F.struct(c.alias("c"), x.cast("int").alias("x"), d.alias("d"), y.cast("int").alias("y"))
    c, h = F.col("c"), F.col("h")
    cells = F.concat(
        upto(n, lambda o: cell(c, F.least(h, o), c, F.greatest(h, o))),
        upto(after, lambda o: cell(c, h, c + 1, o)),
        upto(before, lambda o: cell(c - 1, o, c, h)),
    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k, text = pdf["k"].tolist(), pdf["text"].tolist()
        codes, size = _codes(text)
        one = (pdf["cc"].iloc[0], pdf["x"].iloc[0]) == (pdf["d"].iloc[0], pdf["y"].iloc[0])
        side = ((pdf["c"] == pdf["d"]) & (pdf["h"] == pdf["y"])).to_numpy()
        order = np.argsort(size, kind="stable")  # chunks of like length
        left, right = (order, order) if one else (order[~side[order]], order[side[order]])
        none, out, may = np.zeros(0, np.int64), [], []

        def settle(u, v):
            for x in range(0, len(u), 8192):
                p, q = u[x : x + 8192], v[x : x + 8192]
                near = 2.0 * _lcs_of_pairs(codes, codes, p, q) / (size[p] + size[q]) >= least
                out.append((np.minimum(p, q)[near], np.maximum(p, q)[near]))

        for p, q in _few_missing(codes, size, left, right, least) if len(left) and len(right) else ():
            by = np.argsort(np.abs(size[p] - size[q]), kind="stable")  # pairs with a like window
            p, q = p[by], q[by]
            for x in range(0, len(p), 8192):
                u, v = p[x : x + 8192], q[x : x + 8192]
                reach = _may_reach(codes, size, u, v, least)
                may.append((u[reach], v[reach]))
            if sum(len(u) for u, _ in may) >= 8192:
                settle(*(np.concatenate(z) for z in zip(*may)))
                may = []
        settle(*(np.concatenate([none, *z]) for z in zip((none, none), *may)))
        u, v = (np.concatenate([none, *z]) for z in zip((none, none), *out))
        k = np.array(k, object)
        return pd.DataFrame({"a": k[u], "b": k[v]})

    rows = t.select("k", "text", "c", "h", F.explode(cells).alias("cell")).select("k", "text", "c", "h", F.col("cell.c").alias("cc"), "cell.x", "cell.d", "cell.y")
    pairs = sum(m * (m + 1) // 2 + m * blocks.get(c + 1, 0) for c, m in blocks.items())
    parts = max(12, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs, 2000))
    return rows.repartition(parts, "cc", "x", "d", "y").groupBy("cc", "x", "d", "y").applyInPandas(join, "a string, b string")


def merge_overlaps(chunks: DataFrame, most: int = 9000) -> DataFrame:
    """(source, merged, used) of chunks (source, page, chunk_id, text): texts in order, repeated heads dropped, shared word runs joined once.

    Null pages sort as 0. Repeated heads go before the shuffle's sort; the fold then streams over
    sorted rows and keeps one source's text, at most ``most`` characters and the heads in it, so a
    source with most of all rows needs no more memory than another.
    """

    def fold(frames):
        source, out, used = None, "", 0
        for pdf in frames:
            done = []
            for s, text in zip(pdf["source"], pdf["text"]):
                if s != source:
                    if source is not None:
                        done.append((source, out[:most], used))
                    source, out, used = s, "", 0
                if len(out) >= most or not (t := " ".join((text or "").split())):
                    continue
                a, b = out.split()[-60:], t.split()
                for k in range(min(len(a), len(b)), 7, -1):
                    if a[-k:] == b[:k]:
                        t = " ".join(b[k:])
                        break
                out, used = (out + " " + t).strip(), used + 1
            if done:
                yield pd.DataFrame(done, columns=["source", "merged", "used"])
        if source is not None:
            yield pd.DataFrame([(source, out[:most], used)], columns=["source", "merged", "used"])

    c = chunks.filter(F.col("source").isNotNull()).select("source", F.coalesce("page", F.lit(0)).alias("page"), "chunk_id", "text")
    head = F.md5(F.left(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit(280)))
    first = c.groupBy("source", head.alias("head")).agg(F.min_by("text", F.struct("page", "chunk_id")).alias("text"), F.min(F.struct("page", "chunk_id")).alias("at"))
    parts = max(4, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return first.repartition(parts, "source").sortWithinPartitions("source", "at").select("source", "text").mapInPandas(fold, "source string, merged string, used long")


def hashed_features(texts: DataFrame, size: int = 2048) -> DataFrame:
    """(id, features map<int,double>) of (id, text): tokens 1, 2- and 3-grams 0.75, hashed by blake2b, with unit norm."""

    def one(text: str) -> dict[int, float]:
        w = _TOKEN.findall((text or "").lower())
        f: Counter = Counter()
        for n, weight in ((1, 1.0), (2, 0.75), (3, 0.75)):
            for k in range(len(w) - n + 1):
                f[int.from_bytes(hashlib.blake2b(" ".join(w[k : k + n]).encode(), digest_size=8).digest(), "little") % size] += weight
        norm = math.sqrt(sum(x * x for x in f.values())) or 1.0
        return {k: x / norm for k, x in sorted(f.items())}

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "features": [list(one(t).items()) for t in pdf["text"]]})

    out = texts.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, features array<struct<k:int,v:double>>")
    return out.select("id", F.map_from_entries("features").alias("features"))
