"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared in lower case with every run of characters that aren't letters or digits as one space. An item of m such
characters is found in a document if some stretch of it is within k = floor(ERROR_RATE * m) edits. The item is split into
k + 1 pieces; k edits leave one of them untouched, so a document that holds the item holds a piece. All pieces are looked up at
once by one automaton, and only the stretches around piece hits are verified, by Myers' bit-parallel distance.

Items of fewer than MIN_CHARS characters have too few for edits: they are found exactly, from word bound to word bound. Items of fewer
than MIN_WORDS words and MIN_CHARS characters say nothing inside a text: they match only documents that equal them. Null or
empty items and documents match nothing. Items that are alike after normalising are one, under their smallest item_id. An empty benchmark
marks nothing, an empty table gives an empty result, repeated rows are marked each for itself, and a column named matches gives way.
The benchmark is worked on in blocks of at most BLOCK_CHARS characters about, each broadcast for one pass over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import map_texts

ERROR_RATE, MIN_CHARS, MIN_WORDS, BLOCK_CHARS = 0.08, 24, 3, 8_000_000
MATCHES = "array<struct<item_id:bigint,distance:int,at:int>>"
_PUNCTUATION = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _PUNCTUATION.sub(" ", (text or "").lower()).strip()


def myers(pattern: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end): the least edit distance of pattern to any stretch of text and where the first such stretch ends; distances above most may come out as most + 1."""
    masks = char_masks(pattern) if masks is None else masks
    m, n = len(pattern), len(text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        if score - (n - 1 - j) >= best:
            break
        up, down = up << 1, down << 1
        plus = full & (down | ~(xv | up))
        minus = up & xv
    return best, end


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    return dict(masks)


class Matcher:
    """Finds items (normalised text -> id) in normalised texts."""

    def __init__(self, items: dict[str, int], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        import ahocorasick

        short = {s: i for s, i in items.items() if s and len(s) < min_chars}
        self.whole = {s: i for s, i in short.items() if s.count(" ") < MIN_WORDS - 1}
        self.exact = [(s, i) for s, i in short.items() if s not in self.whole]
        self.items = [(s, i, int(len(s) * error_rate), {}) for s, i in items.items() if len(s) >= min_chars]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (s, _, k, _) in enumerate(self.items):
            for j in range(k + 1):
                a, b = len(s) * j // (k + 1), len(s) * (j + 1) // (k + 1)
                found[s[a:b]].append((at, a))
        for j, (s, _) in enumerate(self.exact):
            found[s].append((~j, 0))
        self.pieces = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if found:
            self.pieces.make_automaton()

    def match(self, text: str) -> list[dict]:
        out = []
        if text in self.whole:
            out.append({"item_id": self.whole[text], "distance": 0, "at": 0})
        if not self.items and not self.exact:
            return out
        starts: dict[int, set[int]] = defaultdict(set)
        exact: dict[int, int] = {}
        for end, (size, uses) in self.pieces.iter(text):
            for at, offset in uses:
                first = end + 1 - size - offset
                if at >= 0:
                    starts[at].add(first)
                elif (first == 0 or text[first - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                    exact.setdefault(~at, first)
        out += [{"item_id": self.exact[j][1], "distance": 0, "at": first} for j, first in exact.items()]
        for at, places in starts.items():
            item, name, k, masks = self.items[at]
            hit = self.verify(text, item, k, masks, sorted(places))
            if hit:
                out.append({"item_id": name, "distance": hit[0], "at": hit[1]})
        return out

    @staticmethod
    def verify(text: str, item: str, k: int, masks: dict[str, int], places: list[int]) -> tuple[int, int] | None:
        for p in places:
            if p >= 0 and text.startswith(item, p):
                return 0, p
        if not masks:
            masks.update(char_masks(item))
        best, low = (k + 1, -1), places[0]
        for this, after in zip(places, [*places[1:], None]):
            if after is not None and after - this <= k:
                continue
            first = max(0, low - k)
            distance, end = myers(item, text[first : this + len(item) + k], best[0] - 1, masks)
            if distance < best[0]:
                best = distance, max(0, first + end - len(item))
            low = after
        return best if best[0] <= k else None


def mark(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, keep_text: bool = True) -> DataFrame:
    """docs with `matches`: the benchmark items that each text holds, with distance and rough place."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    # Copies of an item are one row before anything is gathered.
    items = benchmark.where(F.length(text) > 0).groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    out = docs
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(text), F.lit(blocks)) == block).collect()
        alike: dict[str, int] = {}
        for item_id, raw in sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0])):
            alike.setdefault(normal(raw), item_id)
        shared = docs.sparkSession.sparkContext.broadcast(alike)

        def make(shared=shared):
            matcher = Matcher(shared.value, error_rate)
            return lambda texts: [pa.array([matcher.match(normal(t)) for t in texts.to_pylist()], _ARROW)]

        out = map_texts(out, make, f"__matches{block} {MATCHES}", keep_text=keep_text or block < blocks - 1)
    names = [f"__matches{b}" for b in range(blocks)]
    return out.withColumn("matches", F.concat(*names)).drop(*names)


_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("at", pa.int32())]))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance")


QUERIES = {"op2_decontamination": op2_decontamination}
