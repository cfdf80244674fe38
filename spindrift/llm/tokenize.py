"""Problem 8: encoding a whole corpus with a public byte-level BPE tokenizer, inside Spark.

The ranks are a literal: an array of small maps, piece of bytes to rank, that Spark's higher-order
functions look up. Words that are one piece are encoded in place. The distinct others are merged
once each, by folding the best-ranked merge over their byte arrays, and joined back by word.
Bytes travel as characters U+0000 to U+00FF, so pieces are strings and concatenation is merging.
The fold takes a word's square of steps, so runs of over LONG bytes are merged with a heap instead.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.runtime import cut, table

#: Maps in the literal; each then holds a few pieces, as map lookups are linear.
BUCKETS = 16_384
#: Copies of each encoded word over which a frequent word's rows are spread.
SALT = 8
#: Bytes of a word beyond which a heap merges it.
LONG = 128
#: Marks the keys of pieces that are bytes and not plain ASCII, so that they can't be taken for a text.
_BYTES = "\uffff"


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file; a parameter of encode()."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def java_pattern() -> str:
    """The tokenizer's own split pattern, with Unicode white space and without Python's possessive forms."""
    return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(maxsize=2)
def read_ranks(path: str) -> tuple[tuple[bytes, int], ...]:
    with open(path, "rb") as f:
        return tuple((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f) if a)


@lru_cache(maxsize=2)
def _rank_json(path: str) -> str:
    """The maps as JSON: a piece by its text, where it is one, and if it isn't ASCII by its bytes too."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in read_ranks(path):
        keys = [] if piece.isascii() else [_BYTES + piece.decode("latin-1")]
        try:
            keys.append(piece.decode("utf-8"))
        except UnicodeDecodeError:
            pass
        for key in keys:
            maps[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS][key] = rank  # Spark's own xxhash64
    return json.dumps(maps, ensure_ascii=True, separators=(",", ":"))


def _rank_map(path: str) -> F.Column:
    """The rank map as one foldable literal."""
    return F.from_json(F.lit(_rank_json(path)), F.lit("array<map<string,int>>"))


def _rank(ranks, key) -> F.Column:
    """Rank of a piece by its key, or null."""
    bucket = F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1))  # the digest modulo a power of two
    return F.try_element_at(F.element_at(ranks, (bucket + 1).cast("int")), key)


def _piece_rank(ranks, piece) -> F.Column:
    """Rank of a piece given as characters that stand for bytes."""
    return _rank(ranks, F.when(F.octet_length(piece) == F.length(piece), piece).otherwise(F.concat(F.lit(_BYTES), piece)))


def words(text) -> F.Column:
    return F.regexp_extract_all(text, F.lit(java_pattern()), F.lit(0))


def as_bytes(word) -> F.Column:
    """A word's UTF-8 bytes, each as one character."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def merge_word(ranks, piece) -> F.Column:
    """Ids of a word: starting from its bytes, merge the neighbours of lowest rank, once per step, until none is left.

    The fold carries every part with the rank of the pair that it forms with the next, so a step
    looks up the two pairs that it changes and no more.
    """
    n = F.length(piece)
    byte = lambda i: F.substring(piece, i, F.lit(1))
    part = lambda p, after: F.struct(_piece_rank(ranks, F.concat(p, after)).alias("r"), p.alias("p"))
    start = F.transform(F.sequence(F.lit(1), n), lambda i: part(byte(i), F.when(i < n, byte(i + 1))))

    def step(parts, _):
        def merged(at):
            ab = F.concat(F.get(parts, at - 1)["p"], F.get(parts, at)["p"])
            head = F.when(at > 1, F.concat(F.slice(parts, F.lit(1), at - 2), F.array(part(F.get(parts, at - 2)["p"], ab)))).otherwise(F.slice(parts, 1, 0))
            return F.concat(head, F.array(part(ab, F.get(parts, at + 1)["p"])), F.slice(parts, at + 2, F.size(parts)))

        ranked = F.transform(parts, lambda p: p["r"])
        at = F.array_position(ranked, F.array_min(ranked)).cast("int")
        # The place is bound by a transform over one element, else it would be looked for at every mention.
        return F.when(F.size(parts) < 2, parts).otherwise(F.get(F.transform(F.array(at), lambda a: F.when(a.isNull() | (a < 1), parts).otherwise(merged(a))), F.lit(0)))

    return F.transform(F.aggregate(F.sequence(F.lit(1), n), start, step), lambda x: _piece_rank(ranks, x["p"]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word as merge_word() gives them, by a heap of neighbours: n log n steps."""
    part = [word[k : k + 1] for k in range(len(word))]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap = [(r, k, part[k], part[k + 1]) for k in range(len(part) - 1) if (r := ranks.get(part[k] + part[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        n = after[k]
        if part[k] != a or n >= len(part) or part[n] != b or not a:
            continue  # one of the two was merged meanwhile
        part[k], part[n] = a + b, b""
        after[k] = after[n]
        if after[k] < len(part):
            before[after[k]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y < len(part) and (r := ranks.get(part[x] + part[y])) is not None:
                heapq.heappush(heap, (r, x, part[x], part[y]))
    return [ranks[p] for p in part if p]


def merge_words(words_: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct words: folded inside Spark up to LONG bytes, beyond that by merge_long()."""
    fits = F.octet_length("word") <= LONG
    short = words_.filter(fits).withColumn("ids", merge_word(_rank_map(path), as_bytes(F.col("word"))))
    known = words_.sparkSession.sparkContext.broadcast(dict(read_ranks(path)))  # the vocabulary, of fixed size

    def merge(frames):
        for pdf in frames:
            yield pd.DataFrame({"word": pdf["word"], "ids": [merge_long(w.encode(), known.value) for w in pdf["word"]]})

    return short.union(words_.filter(~fits).mapInPandas(merge, "word string, ids array<int>"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): ids of the whole text, without special tokens.

    Null and empty texts have an empty list; repeated rows count once.
    """
    path = path or ranks_path()
    ranks = _rank_map(path)
    docs = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    split = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    split = split.select("doc_id", "w", F.transform("w", lambda x: _rank(ranks, x)).alias("direct"))
    unknown = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.when(F.get("direct", i).isNull(), x).alias("word"))), lambda u: u["word"].isNotNull())
    base = cut(split.select("doc_id", "direct", unknown.alias("unknown")))
    asked = base.select("doc_id", F.inline("unknown"))
    distinct = merge_words(asked.select("word").distinct(), path)
    copies = distinct.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")
    merged = asked.withColumn("salt", salt).join(copies, ["word", "salt"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "ids")).alias("merged"))
    # The words between two merged ones are slices of the direct ids, so nothing but the merged ones is sorted.
    merged = merged.withColumn("merged", F.array_sort("merged"))
    m, n = F.col("merged"), F.size("merged")

    def stretch(k):
        lo = F.when(k > 0, F.get(m, k - 1)["pos"] + 1).otherwise(0)
        hi = F.when(k < n, F.get(m, k)["pos"]).otherwise(F.size("direct"))
        return F.concat(F.slice("direct", lo + 1, hi - lo), F.coalesce(F.get(m, k)["ids"], F.array().cast("array<int>")))

    ids = F.when(m.isNull(), F.col("direct")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n), stretch)))
    return base.select("doc_id", "direct").join(merged, "doc_id", "left").select("doc_id", ids.alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded documents (doc_id, ids): the concatenated bytes of all pieces."""
    by_id = {rank: piece for piece, rank in read_ranks(path or ranks_path())}
    pieces = [by_id[k].decode("latin-1") if k in by_id else "" for k in range(max(by_id) + 1)]
    block = 256  # an array of arrays, so that one lookup touches little
    table_ = [pieces[k : k + block] for k in range(0, len(pieces), block)]
    lit = F.from_json(F.lit(json.dumps(table_, separators=(",", ":"))), F.lit("array<array<string>>"))
    piece = lambda i: F.element_at(F.element_at(lit, (F.shiftright(i, 8) + 1).cast("int")), (i % block + 1).cast("int"))
    return encoded.select("doc_id", F.decode(F.encode(F.array_join(F.transform("ids", piece), ""), "ISO-8859-1"), "UTF-8").alias("text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, same): length of each encoding and whether decoding gives the text back; null counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("want")).dropDuplicates(["doc_id"])
    ids = cut(p8_ids(spark, sf_dir))
    back = decode(ids).join(ids.select("doc_id", F.size("ids").alias("tokens")), "doc_id")
    return docs.join(back, "doc_id").select("doc_id", "tokens", (F.col("want") == F.col("text")).alias("same"))
