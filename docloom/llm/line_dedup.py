"""Line dedup: segment-partition edit join.

Lines are cut at line feeds, outer white space off. Two lines link if they are equal or within `edits(n)` edits, n the length of the
shorter: one edit for every PER_EDIT characters, TAU at most. Linked lines, directly or through others, make a class; of each class
only the first line stays, in order of doc_id (null last), hash of the row's text, and line number. Blank lines always stay. Null texts have no
lines. Rows with equal doc_id are separate rows, and so are repeated ones. An empty table gives an empty result; columns other than
doc_id and text aren't read.

Equal lines are one from the start. For the join a line of n characters is cut into edits(n) + 1 segments; as many edits leave one
of them whole, so a longer line within reach holds it as a substring, at one of the few places that length and segment
allow. Segments (with length and number) and such substrings are hashed, and meet in ranges of the hash, whose number grows with the
corpus: each batch of documents sends one packed array to each range, as a shuffle would, not a row for each key. Pairs that meet
are verified by a banded bit-parallel automaton.

A large bucket (a segment that very many lines hold) is dealt out in blocks, so that no task has all of its pairs: each block holds some
of the lines found there, and all that look for them. Pairs are compared if the counts of their characters allow it, those inside
a class too. Classes and numbers of links are exact, but for collisions of 63-bit hashes of lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, connected_components, drop_stored, id_filter, lean, lookup_join, numbered, passes, stored
from docloom.llm.words import mix, power_tables

#: Edits at most, characters for each, pairs of a bucket that are compared at once, cells of a bag of characters, and pairs of a block.
TAU, PER_EDIT, SMALL, BAG, BLOCK = 2, 10, 64, 24, 1 << 14
#: Characters that are hashed at once, and bytes of text for each range of the hash.
PIECE, RANGE_BYTES = 1 << 20, 1 << 24
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_CODE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else [x.strip() for x in text.split("\n")]


def edits(n):
    """Edits that a pair of lines may be apart, the shorter of n characters (a number or an array)."""
    return np.minimum(TAU, np.asarray(n) // PER_EDIT)


class Lines:
    """All lines of some texts: where they start in one array of characters, their lengths, names (0 if blank), and how many each text has."""

    def __init__(self, texts: list[str]):
        self.codes = codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        stop = np.flatnonzero(codes == 10)
        begin = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
        solid = np.flatnonzero(~(_SPACE[np.minimum(codes, 0x3000)] & (codes <= 0x3000)))
        first, last = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
        solid = np.append(solid, 0)
        blank = first == last
        self.starts = np.where(blank, begin, solid[first])
        self.sizes = np.where(blank, 0, solid[last - 1] + 1 - self.starts)
        up, self.down = power_tables(len(codes) + 1)
        weighted = (_CODE[codes & np.uint32(0xFFFF)] + (codes >> np.uint32(16)).astype(np.uint64)) * up[: len(codes)]
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        name = self.hashed(self.starts, self.sizes, self.sizes, 15).view(np.int64) & -2
        self.ids = np.where(blank, 0, np.where(name == 0, 2, name))
        self.counts = [t.count("\n") + 1 for t in texts]

    def hashed(self, starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, number: int) -> np.ndarray:
        """Hashes of stretches, with a length and a number."""
        salt = (n.astype(np.uint64) << np.uint64(4)) | np.uint64(number)
        return mix((self.total[starts + sizes] - self.total[starts]) * self.down[starts] + mix(salt))

    def spelled(self, k: int) -> str:
        return self.codes[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes().decode("utf-32-le", "surrogatepass")

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, names) under which the lines at `at` are found; names with the last bit set where they look for shorter lines there.

        A line of the same length that has a segment at the same place is found under its own hash, so nobody looks for that one.
        """
        starts, n, ids = self.starts[at], self.sizes[at], self.ids[at]
        keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for tau in range(1, TAU + 1):
            for less in range(tau + 1):
                some = np.flatnonzero(edits(n - less) == tau)
                size = n[some] - less
                for i in range(tau + 1):
                    place, length = segment(size, tau, i)
                    # i edits at most before the segment, tau - i after it.
                    for shift in range(max(-i, less - (tau - i)), min(i, less + tau - i) + 1):
                        keys.append(self.hashed(starts[some] + place + shift, length, size, i))
                        who.append(ids[some] | int(less != 0 or shift != 0))
        return np.concatenate(keys), np.concatenate(who)


def segment(n: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the i-th of tau + 1 segments of nearly equal length, the longer ones last."""
    short, longer = np.divmod(n, tau + 1)
    extra = i - (tau + 1 - longer)
    return i * short + np.maximum(extra, 0), short + (extra >= 0)


def groups(texts: list[str | None]):
    """Lists of texts, without null ones, of about PIECE characters."""
    some, size = [], 0
    for t in texts:
        if t is not None:
            some.append(t)
            size += len(t) + 1
            if size >= PIECE:
                yield some
                some, size = [], 0
    if some:
        yield some


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether a and b are within tau edits: one bit row for each number of edits, over a band of 2 tau + 1 diagonals."""
    if abs(len(a) - len(b)) > tau:
        return False
    k, most = 0, min(len(a), len(b))
    step = most
    while step:  # common prefix, by halving
        if a[k : k + step] == b[k : k + step]:
            k += step
            step = min(step, most - k)
        else:
            step //= 2
    a, b = a[k:], b[k:]
    k, most = 0, min(len(a), len(b))
    while k < most and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return max(len(a), len(b)) <= tau
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (i + tau)
    full = (1 << (2 * tau + 1)) - 1
    # Bit d of row e: a[:j - tau + d] comes to b[:j] with e edits.
    rows = [(1 << tau) << e for e in range(tau + 1)]
    for e in range(1, tau + 1):
        rows[e] |= rows[e - 1]
    for j, c in enumerate(b):
        same = (masks.get(c, 0) >> j) & full
        before, new = 0, 0
        for e, row in enumerate(rows):
            new = (row & same | before | before >> 1 | new << 1) & full if e else row & same
            before, rows[e] = row, new
        if not rows[-1]:
            return False
    at = len(a) - len(b) + tau
    return any(row >> at & 1 for row in rows)


_SURVEY = "doc_id long, tie long, ids array<long>, range int, keys binary, who binary"


def _survey(ranges: int):
    """Rows (doc_id, tie, names of its lines) and, packed by range of the hash, the keys of each batch's distinct lines."""

    def run(batches):
        names = [x.split()[0] for x in _SURVEY.split(", ")]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids, counts, keys, who = [np.zeros(0, np.int64)], [], [], []
            seen = np.zeros(0, np.int64)
            for some in groups(texts):
                lines = Lines(some)
                ids.append(lines.ids)
                counts += lines.counts
                fresh, at = np.unique(lines.ids, return_index=True)
                new = (lines.sizes[at] >= PER_EDIT) & ~np.isin(fresh, seen)
                seen = np.concatenate([seen, fresh[new]])
                found = lines.keys(at[new])
                keys.append(found[0]), who.append(found[1])
            left = iter(counts)
            ends = np.cumsum([0] + [0 if t is None else next(left) for t in texts])
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            if not len(seen):
                continue
            key, line = np.concatenate(keys), np.concatenate(who)
            place = (key % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
            order = np.argsort(place, kind="stable")
            key, line, place = key[order], line[order], place[order]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            k = len(spans)
            packed = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, line)]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array([int(place[a]) for a, _ in spans], pa.int32()), *packed], names)

    return run


_MET = "bucket long, a long, b long, held boolean"


def meet(table: pa.Table) -> pa.Table:
    """(bucket, a, b, held) of one range. bucket null: a pair to compare. Else a's place in a large bucket, for later."""
    key, who = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("keys", "<u8"), ("who", "<i8")))
    order = np.argsort(key)
    key, who = key[order], who[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    line = who & -2
    # Most buckets hold one line only.
    several = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
    keep = np.repeat(several, np.diff(np.append(starts, len(key))))
    key, who = key[keep], who[keep]
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])]) if len(key) else np.zeros(0, bool)
    key, who = key[new], who[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out: list[tuple[int | None, int, int, bool]] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
        some = who[a:b].tolist()
        held = [x for x in some if not x & 1]
        if not held:
            continue
        own = set(held)
        asking = [x - 1 for x in some if x & 1 and x - 1 not in own]
        if len(held) * (len(held) - 1) // 2 + len(held) * len(asking) <= SMALL:
            out += [(None, min(x, y), max(x, y), True) for i, x in enumerate(held) for y in [*held[i + 1 :], *asking]]
        else:
            bucket = int(key[a].view(np.int64))
            out += [(bucket, x, x, True) for x in held] + [(bucket, x, x, False) for x in asking]
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "a": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.int64()), "held": pa.array(cols[3], pa.bool_())})


def _spelled(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, bag: counts of its characters by code modulo BAG) of the lines named in ids, a stored table."""
    wanted = id_filter(ids)

    def spell(batches):
        for batch in batches:
            found: dict[int, str] = {}
            for some in groups(batch.column(0).to_pylist()):
                lines = Lines(some)
                fresh, at = np.unique(lines.ids, return_index=True)
                ok = (lines.sizes[at] >= PER_EDIT) & passes(wanted, fresh)
                found |= {name: lines.spelled(k) for name, k in zip(fresh[ok].tolist(), at[ok].tolist()) if name not in found}
            bags = [np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") % BAG, minlength=BAG).tolist() for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string()), pa.array(bags, pa.list_(pa.int32()))], ["id", "line", "bag"])

    made = rows.select("text").mapInArrow(lean(spell), "id long, line string, bag array<int>")
    return stored(made.join(ids.hint("shuffle_merge"), "id").dropDuplicates(["id"]))


def _links(rows: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs (a, b) of linked, different lines."""
    pairs = met.where("bucket is null").select("a", "b").distinct()
    big = met.where("bucket is not null").select("bucket", F.col("a").alias("id"), "held").distinct()
    lines = _spelled(rows, stored(met.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    if big.limit(1).count():
        sizes = big.groupBy("bucket").agg(F.count_if("held").alias("h"), F.count("*").alias("n"))
        sizes = stored(sizes.select("bucket", F.least(F.col("h"), F.ceil(F.col("h") * F.col("n") / BLOCK)).cast("int").alias("blocks")))
        big = lookup_join(big, sizes, ["bucket"], F.col("id")).join(lines.select("id", "bag").hint("shuffle_merge"), "id")
        held = big.where("held").select("bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("u"), F.col("bag").alias("bu"))
        asking = big.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("v"), F.col("bag").alias("bv"))
        # An edit changes the counts of characters by 2 at most.
        far = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
        inside = held.join(asking.hint("shuffle_merge"), ["bucket", "block"]).where((F.col("u") != F.col("v")) & (far <= 2 * TAU))
        pairs = pairs.unionAll(inside.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct()

    def check(batches):
        for batch in batches:
            ok = [within(x, y, int(edits(min(len(x), len(y))))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = stored(pairs).join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")).hint("shuffle_merge"), "a")
    both = both.join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")).hint("shuffle_merge"), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, tie (hash of its text), n_lines, kept (numbers, from 0, of the lines that stay), n_links (of its lines
    to other lines, all places counted) and classes (the class of each line, 0 if blank; a class is named by its smallest line)."""
    with bounded_batches(docs.sparkSession):
        return _kept_lines(docs)


def _kept_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, total // RANGE_BYTES)
    survey = stored(rows.mapInArrow(lean(_survey(ranges)), _SURVEY))
    met = stored(survey.where("range is not null").select("range", "keys", "who").groupBy("range").applyInArrow(meet, _MET))
    per_row = survey.where("range is null").select("doc_id", "tie", "ids")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    per_row = numbered(per_row, order, "seq")
    drop_stored(survey)
    links = _links(rows, met)
    parts = connected_components(links).select(F.col("node").alias("id"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    classes = stored(parts.join(degree.hint("shuffle_merge"), "id"))
    # A line's place as one number: rows in order, then lines.
    width = (per_row.agg(F.max(F.size("ids"))).first()[0] or 0) + 1
    place = lambda no: F.col("seq") * F.lit(width).cast("long") + no
    occur = per_row.select("seq", F.posexplode("ids").alias("no", "id")).select("id", place(F.col("no")).alias("place"))
    first = occur.where("id <> 0").groupBy("id").agg(F.min("place").alias("place")).join(classes.select("id", "component").hint("shuffle_merge"), "id", "left")
    alone = first.where("component is null").select("place")
    of_class = first.where("component is not null").groupBy("component").agg(F.min("place").alias("place")).select("place")
    stay = alone.unionAll(of_class).unionAll(occur.where("id = 0").select("place"))
    stay = stay.groupBy(F.expr(f"place div {width}").alias("seq")).agg(F.sort_array(F.collect_list((F.col("place") % width).cast("int"))).alias("kept"))

    wanted = id_filter(classes.select("id"))

    def linked(batches):
        for batch in batches:
            lists = batch.column(1)
            ids = np.asarray(lists.flatten())
            sizes = np.diff(np.asarray(lists.offsets))
            seq = np.repeat(batch.column(0).to_numpy(), sizes)
            no = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok = passes(wanted, ids) & (ids != 0)
            yield pa.RecordBatch.from_arrays([pa.array(seq[ok]), pa.array(no[ok].astype(np.int32)), pa.array(ids[ok])], ["seq", "no", "id"])

    near = lookup_join(per_row.select("seq", "ids").mapInArrow(lean(linked), "seq long, no int, id long"), classes, ["id"], F.struct("seq", "no"))
    near = near.groupBy("seq").agg(F.sum("k").alias("n_links"), F.map_from_entries(F.collect_list(F.struct("no", "component"))).alias("other"))
    out = per_row.join(stay.hint("shuffle_merge"), "seq", "left").join(near.hint("shuffle_merge"), "seq", "left")
    named = F.transform("ids", lambda x, i: F.coalesce(F.try_element_at("other", i), x))
    return out.select(
        "doc_id", "tie", F.size("ids").cast("long").alias("n_lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("other").isNull(), F.col("ids")).otherwise(named).alias("classes"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with each text reduced to its kept lines, without outer white space. Rows alike in doc_id and text are told apart by their other columns."""
    twin = Window.partitionBy("__id", "__tie")
    kept = kept_lines(docs).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "kept")
    kept = kept.withColumn("__k", F.row_number().over(twin.orderBy(F.desc(F.size("kept"))))).withColumnsRenamed({"__id": "__id2", "__tie": "__tie2", "__k": "__k2", "kept": "__kept"})
    mine = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__tie": F.xxhash64("text")})
    mine = mine.withColumn("__k", F.row_number().over(twin.orderBy(F.xxhash64(*docs.columns))))
    same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__tie") == F.col("__tie2")) & (F.col("__k") == F.col("__k2"))
    lines = F.transform(F.col("__kept"), lambda i: F.regexp_replace(F.get(F.split("text", "\n"), i), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    joined = mine.join(stored(kept).hint("shuffle_merge"), same, "left")
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(lines, "\n"))).select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document how many lines it has, keeps and loses as near copies of earlier lines, their links to other lines and their classes."""
    kept = kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.size("kept").cast("long")
    return kept.select("doc_id", "n_lines", n.alias("n_kept"), (F.col("n_lines") - n).alias("n_dropped"), "n_links", "classes", F.crc32(F.array_join(F.col("kept").cast("array<string>"), ",").cast("binary")).alias("kept_crc32"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
