"""Language ID: prediction by partial matching over bytes.

For each language a context tree of orders 0 to 3 is counted on labelled texts. A symbol's code length follows from
the longest known context of up to three bytes: escapes (method C, with exclusion of the symbols that longer contexts
offered) lead to shorter contexts and at last to a uniform order -1. Statistics are frozen, so the code length of a byte is
a function of it and the three bytes before; the lengths of all known contexts are tabulated once for all languages, and
a whole text is scored by adding table entries. The language with the shortest total code wins, ties to the
smaller name.

The fit uses a bounded sample: per language SAMPLE_DOCS labelled documents (those with the smallest hash of doc_id)
of at most SAMPLE_BYTES each that have a doc_id, and MAX_CONTEXTS contexts of order 3. Scoring covers every byte of every text. Texts that are
null or have no letter (Unicode category L) get `und` with score 0; without any learned language so does everything. Repeated rows are scored
each for itself, an empty table gives an empty result, and columns named like a new one give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.bytes_util import pieces, sums
from docloom.llm.common import lean, lookup_join, map_texts, stored

SAMPLE_DOCS, SAMPLE_BYTES, MAX_CONTEXTS = 1000, 1 << 16, 40_000
#: Bytes of text that count as full evidence for a score near 1.
EVIDENCE = 48
UNKNOWN = "und"


@dataclass
class PpmModel:
    """languages; class of each byte (0: in no sample); table row of each three classes; bits by (row, class, language)."""

    languages: list[str]
    classes: np.ndarray
    rows: np.ndarray
    bits: np.ndarray

    @property
    def width(self) -> int:
        return self.bits.shape[1]

    def score(self, data: np.ndarray) -> np.ndarray:
        """Code length of data[3:] in each language, byte by byte."""
        c = self.classes[data]
        width = self.width
        row = self.rows[(c[:-3] * width + c[1:-2]) * width + c[2:-1]]
        return self.bits.reshape(-1, len(self.languages))[row * width + c[3:]]


def ppm_bits(counts: list[np.ndarray], parents: list[np.ndarray]) -> np.ndarray:
    """Code lengths by (context, class) of one language. counts: by order, longest first, and class; parents: for each
    context asked for, its row at every order, -1 where it has none."""
    n, width = len(parents[0]), counts[0].shape[1]
    prob, escape, shut = np.zeros((n, width)), np.ones(n), np.zeros((n, width), bool)
    for table, at in zip(counts, parents):
        own = np.where(shut | (at < 0)[:, None], 0, table[at])
        total, kinds = own.sum(axis=1), (own > 0).sum(axis=1)
        share = escape / np.maximum(total + kinds, 1)
        prob += own * share[:, None]
        escape = np.where(total > 0, kinds * share, escape)
        shut |= own > 0
    left = np.maximum(256 - shut.sum(axis=1), 1)
    return -np.log2(np.where(shut, prob, (escape / left)[:, None]))


def build_model(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
    """grams: language -> (four-byte windows as numbers, counts)."""
    languages = sorted(grams)
    seen = np.unique(np.concatenate([np.unique(w.astype(np.uint32).view(np.uint8)) for w, _ in grams.values()] + [np.array([10], np.uint8)]))
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    split = {k: ([classes[(w >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)], n) for k, (w, n) in grams.items()}
    keys = {k: ((b[0] * width + b[1]) * width + b[2], n) for k, (b, n) in split.items()}
    ids, inverse = np.unique(np.concatenate([x for x, _ in keys.values()]), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate([n for _, n in keys.values()]), len(ids))
    three = np.sort(ids[np.lexsort((ids, -weight))[:MAX_CONTEXTS]])
    pairs = np.unique(np.concatenate([b[1] * width + b[2] for b, _ in split.values()]))
    # Rows: order 3, then 2, then 1 (every class), then 0.
    two, one, zero = len(three), len(three) + len(pairs), len(three) + len(pairs) + width
    by_one = np.arange(one, zero)
    by_two = np.broadcast_to(by_one, (width, width)).reshape(-1).copy()
    by_two[pairs] = two + np.arange(len(pairs))
    by_three = np.broadcast_to(by_two, (width, width * width)).reshape(-1).astype(np.int32)
    by_three[three] = np.arange(len(three))
    none = np.full
    last = np.concatenate([three % width, pairs % width, np.arange(width), [-1]])
    mid = np.concatenate([np.searchsorted(pairs, three % (width * width)), np.arange(len(pairs)), none(width + 1, -1)])
    parents = [np.concatenate([np.arange(len(three)), none(zero + 1 - two, -1)]), mid, last, np.zeros(zero + 1, np.int64)]
    bits = np.empty((zero + 1, width, len(languages)), np.float32)
    for k, language in enumerate(languages):
        (b0, b1, b2, sym), n = split[language]
        tables = []
        for known, key in ((three, (b0 * width + b1) * width + b2), (pairs, b1 * width + b2), (np.arange(width), b2), (np.zeros(1, np.int64), b2 * 0)):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ok = known[at] == key
            tables.append(np.bincount(at[ok] * width + sym[ok], n[ok], len(known) * width).reshape(-1, width))
        for lo in range(0, zero + 1, 4096):
            bits[lo : lo + 4096, :, k] = ppm_bits(tables, [p[lo : lo + 4096] for p in parents])
    return PpmModel(languages, classes, by_three, bits)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel | None:
    """Context trees of the labelled rows for which usable holds; None if there are none."""
    named = docs.where(usable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & (F.octet_length(text_col) <= SAMPLE_BYTES))
    named = named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "tie")
    chosen = named.drop("text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).drop("k").distinct()
    slim = lookup_join(named, stored(chosen), ["id", "lang", "tie"], F.col("tie"))

    def tally(batches):
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for data, rows, starts, ends in pieces(batch.column(1)):
                x = data.astype(np.uint32)
                window = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
                owner = lang[rows]
                for name in dict.fromkeys(owner):
                    w, n = np.unique(np.concatenate([window[a - 3 : b - 3] for a, b, o in zip(starts, ends, owner) if o == name]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(w)), pa.array(w.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = slim.select("lang", "text").mapInArrow(lean(tally), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    return build_model({k: (g["gram"].to_numpy(), g["n"].to_numpy()) for k, g in found.sort_values(["lang", "gram"]).groupby("lang")})


def identify(df: DataFrame, model: PpmModel | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred, score (how far the best language is ahead, 0 to 1) and bits_per_byte (its code length)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        letter, m = regex.compile(r"\p{L}").search, shared.value

        def run(texts):
            plain = [t or "" for t in texts.to_pylist()]
            named = np.array([bool(m and letter(t)) for t in plain], bool)
            total = np.zeros((len(plain), len(m.languages) if m else 1))
            if m:
                for data, rows, starts, ends in pieces(texts):
                    np.add.at(total, rows, sums(m.score(data), starts - 3, ends - 3))
            n_bytes = np.maximum([len(t.encode()) for t in plain], 1)
            best, least = total.argmin(axis=1), total.min(axis=1)
            ahead = (total - least[:, None]) * np.minimum(1, EVIDENCE / n_bytes)[:, None]
            score = np.where(named, 1 / np.exp2(-ahead).sum(axis=1), 0.0)
            pred = [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, named)]
            return [pa.array(pred, pa.string()), pa.array(score), pa.array(least / n_bytes)]

        return run

    return map_texts(df, make, "lang_pred string, score double, bits_per_byte double", text_col, keep_text)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four folds; predicts every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, fold("doc_id", 4) != 2)
    held = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return identify(held, model, keep_text=False)


QUERIES = {"op9_language_id": op9_language_id}
