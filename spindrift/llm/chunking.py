"""Problem 4: oversized items cut at natural boundaries, by content-defined chunking.

A rolling hash over the text puts landmarks where its low bits vanish. A cut goes to the natural
boundary nearest to the first landmark between a minimum and the maximum size, so an edit moves
only the cuts next to it; where there is no boundary the landmark itself is the cut.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.runtime import table

WINDOW = 24
#: Landmarks on average between the least and the largest size of a piece: few, so that pieces aren't all of the least size,
#: and enough that hardly any stretch is without one.
LANDMARKS = 4
#: Least share of the room that a piece fills.
LEAST = 0.4
_BASE = np.uint64(0x100000001B3)
#: Natural boundaries, strongest first: blank line, line, sentence, clause, word.
_BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n+", r"[.!?][\"'”’)\]]*\s+|[。！？।؟]\s*", r"[;:,،、，]\s*", r"\s+")]


def landmarks(text: str, bits: int) -> np.ndarray:
    """Positions after which the hash of the last WINDOW characters vanishes in ``bits`` bits: one in 2 ** bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):  # the polynomial hash of every window, all windows at once
        h = h * _BASE + codes[k : k + len(h)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) == 0) + WINDOW


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Cut positions such that every piece with its overlap to the left is within the limit."""
    n = len(text)
    if limit is None or limit <= 0 or n <= limit:
        return []
    overlap = max(0, min(overlap or 0, limit // 2))
    marks = landmarks(text, max(3, int(math.log2(max(8, limit * (1 - LEAST) / LANDMARKS)))))
    ends = [np.array([m.end() for m in p.finditer(text)], np.int64) for p in _BOUNDARIES]
    out, at = [], 0
    while n - at > limit - (overlap if at else 0):
        room = limit - (overlap if at else 0)
        lo, hi = at + max(1, int(room * LEAST)), at + room
        # Not so far that a rest smaller than the minimum follows, where that can be avoided.
        k = int(np.searchsorted(marks, lo))
        target = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        cut = None
        for e in ends:
            a, b = np.searchsorted(e, lo), np.searchsorted(e, hi, "right")
            if b > a:
                near = e[a:b]
                cut = int(near[np.argmin(np.abs(near - target))])
                break
        cut = cut or target
        while cut > lo and cut < n and (text[cut : cut + 1] and _joins(text[cut])):
            cut -= 1  # never between a letter and its combining marks
        out.append(cut)
        at = cut
    return out


def _joins(c: str) -> bool:
    return "̀" <= c <= "ͯ" or c in "‍️" or "ऀ" <= c <= "ॿ" and not c.isalpha() and not c.isspace() and not c.isdigit()


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece; neighbours share ``overlap`` characters; a text within the limit is one piece."""
    at = [0, *cuts(text, limit, overlap), len(text)]
    shared = max(0, min(overlap or 0, (limit or 0) // 2))
    return [(max(0, a - shared) if k else a, b) for k, (a, b) in enumerate(zip(at[:-1], at[1:]))]


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, chunk_id, page, modality, piece, pieces, start_at, end_at, text) of items.

    items: (source, chunk_id, page, modality, text), limits: (modality, max_chars, overlap_chars).
    Null texts give no piece, empty ones an empty piece; without a limit for the modality an item
    stays whole; repeated rows count once; very long texts are cut as a whole.
    """
    own = limits.select("modality", "max_chars", "overlap_chars").dropDuplicates(["modality"])
    rows = items.filter(F.col("text").isNotNull()).select("source", "chunk_id", "page", "modality", "text").dropDuplicates(["source", "chunk_id"])
    rows = rows.join(own, "modality", "left")

    def cut_all(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                limit = None if pd.isna(r.max_chars) else int(r.max_chars)
                got = pieces(r.text, limit, 0 if pd.isna(r.overlap_chars) else int(r.overlap_chars))
                out += [(r.source, r.chunk_id, None if pd.isna(r.page) else int(r.page), r.modality, k, len(got), a, b, r.text[a:b]) for k, (a, b) in enumerate(got)]
            frame = pd.DataFrame(out, columns=["source", "chunk_id", "page", "modality", "piece", "pieces", "start_at", "end_at", "text"])
            yield frame.astype({"page": "Int64"})

    return rows.mapInPandas(cut_all, "source string, chunk_id int, page int, modality string, piece int, pieces int, start_at int, end_at int, text string")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "split_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, chunk_id) of every chunk that had to be cut."""
    return _pieces(spark, sf_dir).filter("piece = 1").select("source", "chunk_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all chunks, within the limits, with source, page and chunk_id."""
    return _pieces(spark, sf_dir)
