"""N-gram Jaccard join over a token-group matrix.

Two texts link when their sets of word shingles have a Jaccard similarity of at least num / den. The join is exact but for hashing:
shingles, and sets of them (`set_id`), are known by 64-bit hashes.

1. Documents with equal sets become one class, named by the set's hash; copies are never paired.
2. Each class keeps its prefix: the first n - ceil(t n) + 1 shingles in one global order. Linked sets share a shingle of
   their prefixes, and in fact most of them (`need`). The order puts shingles that very many documents share last; which ones is
   only a matter of speed, so a bounded list of those seen repeatedly in one task serves.
3. Leaders: in every bucket of a prefix shingle and a band of sizes, all members are compared with the smallest one. Links partition
   the classes into groups of similar documents, however large, with a number of comparisons that is linear in the bucket.
   Where a bucket then still holds several groups, they meet one more leader, another one in each bucket.
   Components that still are apart form a group with the largest one whose leader their prefixes resemble, linked or not.
4. Token-group matrix: each group, in chunks of about CHUNK members, stores the union of its members' prefixes, as (token, group) rows
   too. A class meets the chunks that hold larger components there, at a token that leaves room for all the others they need; the number
   of its tokens in a chunk's union then bounds its overlap with any member, and only chunks that reach the bound are opened: about CHUNK
   classes at a time are compared with all members of a chunk at once, so that pairs of similar texts never become rows.

Pairs inside a component found by leaders need no comparison, since component_id can't change by them. A comparison with a leader first
bounds the overlap by the two prefixes, then intersects the whole sets.

Null or empty texts have no shingles and link with nothing. Rows with equal doc_id are one node for link(), which all their texts
belong to; groups() tells their texts apart. Rows with a null doc_id get their n_shingles and a null component from link().
Repeated rows come back as often as they are there. An empty table gives an empty result. Of other columns none is read, so their
names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, connected_components, drop_stored, id_filter, lean, lookup_join, passes, stored
from docloom.llm.words import mix, shingle_sets

#: Shingles at most that the global order puts last, members of a group's chunk.
COMMON, CHUNK = 200_000, 64
#: Shingles of a block that are compared at once.
COLUMNS = 1 << 14
#: Shingles that a task of the survey looks through for repeated ones at once.
HELD = 1 << 20


def set_id(shingles: np.ndarray) -> int:
    """The name of a set of shingles."""
    return int(mix(shingles).sum(dtype=np.uint64).view(np.int64))


def text_sets(width: int):
    """For map_texts: n_shingles and set_id of each text."""

    def work(texts):
        sets = shingle_sets(texts.to_pylist(), width)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())]

    return lambda: work


def _survey(width: int):
    """(doc_id, n, a: the set's name) of each document; then, of kind 1, (a: shingle, n: documents) seen in two or more."""

    def run(batches):
        names = ["kind", "doc_id", "n", "a"]
        kept: list[np.ndarray] = []
        held = 0
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], names)
            kept += sets
            held += sum(map(len, sets))
            if held > HELD:
                yield from repeated(kept, names)
                kept, held = [], 0
        if kept:
            yield from repeated(kept, names)

    def repeated(kept, names):
        seen, times = np.unique(np.concatenate(kept), return_counts=True)
        seen, times = seen[times > 1], times[times > 1]
        for at in range(0, len(seen), 100_000):
            s, t = seen[at : at + 100_000].view(np.int64), times[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(s), np.int32)), pa.nulls(len(s), pa.int64()), pa.array(t.astype(np.int64)), pa.array(s)], names)

    return run


def _prefixes(width: int, num: int, den: int, shared):
    def run(batches):
        common = shared.value
        for batch in batches:
            n, rows, ids, seen = [], [], [], set()
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                name = set_id(s)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                length = len(s) - -(-num * len(s) // den) + 1
                first = s[:length]
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    late = common[at] == s
                    first = np.concatenate([s[~late], s[late]])[:length]
                ids.append(name), n.append(len(s)), rows.append(first.view(np.int64))
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["rep", "n", "prefix"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of left with each of right, in bounded memory for sets of any size."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)))
    sides = []
    for sets, flat in ((left, a), (right, b)):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order]))
    for lo in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - lo)
        parts = []
        for (row, at), sets in zip(sides, (left, right)):
            i, j = np.searchsorted(at, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[i:j], at[i:j] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


class JaccardJoin:
    """The join of one documents table; link() gives its result."""

    def __init__(self, docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.width, self.num, self.den = width, num, den

    def need(self, a: str, b: str) -> str:
        """SQL for the least number of shared prefix shingles of linked sets of a and b shingles."""
        n, d = self.num, self.den
        rest = f"greatest(({n} * {a} + {d - 1}) div {d}, ({n} * {b} + {d - 1}) div {d}) - 1"
        return f"greatest(1, ({n} * ({a} + {b}) + {n + d - 1}) div {n + d} - ({rest}))"

    def least_need(self, a: str, low: str, high: str) -> str:
        """SQL for the least need(a, b) over all b from low to high.

        Up to a it grows with b, so low decides. From there it falls by num^2 / (den (num + den)) a step, but for the roundings, which
        can put it above an inner one by 1: only sizes so near to high that the fall is less than 1 can be below high.
        """
        n, d = self.num, self.den
        near = range(1, -(-d * (n + d) // (n * n)))
        return f"least({', '.join(self.need(a, b) for b in (low, high, *(f'greatest({low}, {high} - {k})' for k in near)))})"

    def fits(self, a: str, b: str) -> str:
        return f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})"

    def token_sets(self, ids: DataFrame) -> DataFrame:
        """(rep, tokens: its set as bytes) of the classes of a stored table of distinct names (doc_id), stored."""
        width = self.width
        wanted = id_filter(ids)

        def sets(batches):
            for batch in batches:
                found = {set_id(s): s for s in shingle_sets(batch.column(0).to_pylist(), width)}
                names = np.array(list(found), np.int64)
                some = names[passes(wanted, names)].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([found[k].tobytes() for k in some], pa.binary())], ["rep", "tokens"])

        made = self.docs.select("text").mapInArrow(lean(sets), "rep long, tokens binary")
        table = stored(made.join(ids.select(F.col("doc_id").alias("rep")).hint("shuffle_merge"), "rep").dropDuplicates(["rep"]))
        if wanted is not None:
            wanted.destroy()
        return table

    def compare(self, pairs: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of distinct pairs (a, b) those whose prefixes allow a link, and the linked ones."""
        left = prefixes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        right = prefixes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        both = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b")
        near = both.where(self.fits("na", "nb")).where(F.size(F.array_intersect("pa", "pb")) >= F.expr(self.need("na", "nb")))
        near = stored(near.select("a", "b"))
        sides = [near.select(F.col(c).alias("doc_id")).distinct() for c in ("a", "b")]
        ids = stored(sides[0].unionAll(sides[1]).distinct())
        num, den = self.num, self.den
        table = self.token_sets(ids)

        # A leader's set goes once to each task that holds some of its classes; a leader of more than CHUNK classes has several such tasks.
        many = stored(near.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("pieces")).where("pieces > 1"))
        dealt = lookup_join(near, many, ["a"], F.col("b"), "left").withColumn("piece", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).cast("int")).select("a", "piece", "b")
        led = dealt.join(table.select(F.col("rep").alias("b"), "tokens").hint("shuffle_merge"), "b").select("a", "piece", "b", "tokens")
        # The table is read once for each side, which keeps their columns apart.
        again = table.sparkSession.read.schema(table.schema).parquet(table.stored_at)
        heads = dealt.select("a", "piece").distinct().join(again.select(F.col("rep").alias("a"), "tokens").hint("shuffle_merge"), "a").select("a", "piece", F.lit(None).cast("long").alias("b"), "tokens")
        beside = led.unionByName(heads).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())

        def check(batches):
            head = None
            for batch in batches:
                ok = []
                for b, tokens in zip(batch.column(2), batch.column(3)):
                    x = np.frombuffer(tokens.as_buffer(), np.uint64)
                    if not b.is_valid:
                        head = x.copy()
                        ok.append(False)
                        continue
                    common = len(np.intersect1d(head, x, assume_unique=True))
                    ok.append(den * common >= num * (len(head) + len(x) - common))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        links = stored(beside.mapInArrow(lean(check), "a long, b long").distinct())
        drop_stored(many)
        for used in (ids, table):
            drop_stored(used)
        return near, links

    def compare_blocks(self, opened: DataFrame, members: DataFrame) -> DataFrame:
        """The linked pairs (a, b) of classes (rep) and members of the chunks (g, gc) they open, each asked from its lesser component.

        The askers of a chunk come in blocks of about CHUNK, each of which meets a copy of the chunk in one task.
        """
        num, den = self.num, self.den
        pieces = stored(opened.groupBy("g", "gc").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("pieces")))
        chunks = members.select("rep", F.col("grp").alias("g"), F.col("chunk").alias("gc"), "component", "size")
        inside = stored(chunks.join(pieces.hint("shuffle_merge"), ["g", "gc"]))
        ids = stored(opened.select("rep").unionAll(inside.select("rep")).distinct().select(F.col("rep").alias("doc_id")))
        table = self.token_sets(ids)
        asks = lookup_join(opened, pieces, ["g", "gc"], F.col("rep")).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
        copies = inside.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        # The table is read once for each side, which keeps their columns apart.
        again = table.sparkSession.read.schema(table.schema).parquet(table.stored_at)
        sides = [x.select("g", "gc", "piece", "rep", "component", "size").join(t.hint("shuffle_merge"), "rep") for x, t in ((asks, table), (copies, again))]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = [], []
            if left.num_rows and right.num_rows:
                rep, size, component, sets = [], [], [], []
                for t in (left, right):
                    rep.append(t["rep"].to_numpy()), size.append(t["size"].to_numpy()), component.append(t["component"].to_numpy())
                    sets.append([np.frombuffer(v.as_buffer(), np.uint64) for v in t["tokens"]])
                common = overlaps(*sets)
                n = [np.array([len(v) for v in some]) for some in sets]
                ok = den * common >= num * (n[0][:, None] + n[1] - common)
                ok &= (size[0][:, None] < size[1]) | ((size[0][:, None] == size[1]) & (component[0][:, None] < component[1]))
                x, y = np.nonzero(ok)
                a, b = rep[0][x], rep[1][y]
            return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        key = ["g", "gc", "piece"]
        links = stored(sides[0].groupBy(key).cogroup(sides[1].groupBy(key)).applyInArrow(meet, "a long, b long").distinct())
        for used in (pieces, inside, ids, table):
            drop_stored(used)
        return links

    @staticmethod
    def _members(prefixes: DataFrame, parts: DataFrame, near: DataFrame) -> DataFrame:
        """prefixes with the component of each class and its size, its group (grp) and its chunk of that, stored.

        near: pairs (leader, class) of similar prefixes; they bring a component into the group of the largest one that leads it.
        """
        named = prefixes.join(parts.select(F.col("node").alias("rep"), "component").hint("shuffle_merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        big = parts.groupBy("component").agg(F.count("*").alias("size"))
        sized = lookup_join(named, stored(big), ["component"], F.col("rep"), "left").withColumn("size", F.coalesce("size", F.lit(1)))
        sized = stored(sized.select("rep", "n", "prefix", "component", "size"))
        of = sized.select("rep", "component", "size")
        leaders = stored(of.join(near.select(F.col("a").alias("rep")).distinct().hint("shuffle_merge"), "rep", "left_semi"))
        led = lookup_join(near, leaders.select(F.col("rep").alias("a"), F.struct("size", "component").alias("top")), ["a"], F.col("b"))
        led = led.groupBy("b").agg(F.max("top").alias("top")).join(of.withColumnRenamed("rep", "b").hint("shuffle_merge"), "b")
        moved = stored(led.where("top > struct(size, component)").groupBy("component").agg(F.max("top").getField("component").alias("grp")))
        grouped = lookup_join(sized, moved, ["component"], F.col("rep"), "left").withColumn("grp", F.coalesce("grp", "component"))
        sizes = stored(grouped.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1"))
        chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("k", F.lit(1)) / CHUNK)).cast("int")
        out = stored(lookup_join(grouped, sizes, ["grp"], F.col("rep"), "left").withColumn("chunk", chunk).drop("k"))
        for used in (sized, leaders, moved, sizes):
            drop_stored(used)
        return out

    @staticmethod
    def _stars(parts: DataFrame) -> DataFrame:
        """Components found so far as edges: a star each, so that later links settle in few rounds."""
        return parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    @staticmethod
    def _open(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n, set_id) of every row, stored, and (set_id, component) of all sets that link with another; a component is its smallest set_id."""
        with bounded_batches(self.docs.sparkSession, 1000, 1):
            return self._groups()

    def _groups(self) -> tuple[DataFrame, DataFrame]:
        spark = self.docs.sparkSession
        survey = stored(self.docs.mapInArrow(lean(_survey(self.width)), "kind int, doc_id long, n long, a long"))
        per_doc = survey.where("kind = 0").select("doc_id", "n", F.col("a").alias("set_id"))
        often = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("k"))
        least = 16
        sizes = often.where(f"k >= {least}").groupBy(F.floor(F.log2("k")).cast("int").alias("l")).agg(F.count("*").alias("n")).collect()
        total = 0
        for l, n in sorted((tuple(r) for r in sizes), reverse=True):
            total += n
            if total > COMMON:
                least = max(least, 2 ** (l + 1))
                break
        # COMMON rows of 8 bytes at most, by the sizes just counted.
        common = often.where(f"k >= {least}").select("a").toPandas()["a"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))

        made = self.docs.select("text").mapInArrow(lean(_prefixes(self.width, self.num, self.den, shared)), "rep long, n long, prefix array<long>")
        prefixes = stored(made.dropDuplicates(["rep"]))

        tokens = prefixes.select("rep", "n", F.explode("prefix").alias("token"))
        band = F.floor(F.log("n") / float(-np.log(self.num / self.den))).cast("int")
        banded = tokens.select("token", band.alias("band"), "rep")
        lead = banded.groupBy("token", "band").agg(F.count("*").alias("k"), F.min("rep").alias("a")).where("k > 1").drop("k")
        pairs = banded.join(lead.hint("shuffle_merge"), ["token", "band"]).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        near, links = self.compare(pairs, prefixes)
        parts = stored(connected_components(links))

        members = self._members(prefixes, parts, near)
        # The first shared shingle of a linked pair has all the others it needs after it in both prefixes: its slack.
        rows = members.select("rep", "n", "component", "size", "grp", "chunk", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
        rows = rows.withColumn("slack", F.col("p") - F.col("pos")).drop("p", "pos")
        # Far fewer than the prefixes hold: tokens that several components share.
        rows = stored(rows.join(self._open(rows).hint("shuffle_merge"), "token"))
        if not rows.limit(1).count():
            # No shingle is left to two components, so no link between them is.
            for used in (prefixes, members, rows, links):
                drop_stored(used)
            return per_doc, parts.select(F.col("node").alias("set_id"), "component")
        # A second leader, another one in each bucket: whatever links with it needn't meet the groups.
        second = rows.withColumn("band", band).groupBy("token", "band").agg(F.min_by("rep", F.xxhash64("token", "rep")).alias("a"), F.min_by("component", F.xxhash64("token", "rep")).alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
        second = second.where("x <> y").select("token", "band", "a", "c")
        pairs = rows.withColumn("band", band).join(second.hint("shuffle_merge"), ["token", "band"]).where("component <> c").select("a", F.col("rep").alias("b")).distinct()
        nearer, again = self.compare(pairs, prefixes)
        near = near.unionAll(nearer)
        if again.limit(1).count():
            parts = stored(connected_components(self._stars(parts).unionAll(again)))
        if nearer.limit(1).count():
            drop_stored(members)
            members = self._members(prefixes, parts, near)
            rows = rows.drop("component", "size", "grp", "chunk").join(members.select("rep", "component", "size", "grp", "chunk").hint("shuffle_merge"), "rep")
            rows = stored(rows.join(self._open(rows).hint("shuffle_merge"), "token"))
        # Of a pair the class of the lesser component, by size and then name, asks.
        top = F.max(F.struct("size", "component"))
        matrix = rows.groupBy("token", F.col("grp").alias("g"), F.col("chunk").alias("gc")).agg(F.max("slack").alias("room"), F.min("n").alias("lo"), F.max("n").alias("hi"), top.alias("top"))
        low = f"greatest(lo, ({self.num} * n + {self.den - 1}) div {self.den})"
        high = f"least(hi, ({self.den} * n) div {self.num})"
        least = self.least_need("n", low, high)
        asked = rows.select("token", "rep", "n", "slack", "component", "size").join(matrix.hint("shuffle_merge"), "token")
        asked = asked.where("struct(size, component) < top")
        asked = asked.where(f"{self.num} * lo <= {self.den} * n and {self.num} * n <= {self.den} * hi and least(slack, room) >= {least}")
        met = asked.select("rep", "component", "size", "g", "gc").distinct()
        unions = members.groupBy(F.col("grp").alias("g"), F.col("chunk").alias("gc")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("union"))
        # A class carries its short prefix to the group; the union stays where it was made.
        met = met.join(prefixes.hint("shuffle_merge"), "rep").join(unions.hint("shuffle_merge"), ["g", "gc"])
        opened = stored(met.where(f"size(array_intersect(prefix, union)) >= {least}").select("rep", "component", "size", "g", "gc"))
        late = self.compare_blocks(opened, members)
        final = parts
        if late.limit(1).count():
            final = stored(connected_components(self._stars(parts).unionAll(late)))
        for used in (prefixes, members, rows, links, late):
            drop_stored(used)
        return per_doc, final.select(F.col("node").alias("set_id"), "component")

    def link(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        per_doc, parts = self.groups()
        mine = per_doc.where("n > 0 and doc_id is not null")
        sets = mine.groupBy("set_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        sets = stored(sets.join(parts.hint("shuffle_merge"), "set_id", "left"))
        # Sets of one doc_id belong together, whatever their components.
        several = stored(mine.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y"))
        repeated = several.limit(1).count() > 0
        if repeated:
            ties = mine.join(several.hint("shuffle_merge"), "doc_id").select(F.col("x").alias("a"), F.col("set_id").alias("b"))
            stars = sets.where("component is not null").select(F.col("component").alias("a"), F.col("set_id").alias("b"))
            joined = connected_components(ties.unionAll(stars)).select(F.col("node").alias("set_id"), "component")
            sets = stored(sets.drop("component").join(joined.hint("shuffle_merge"), "set_id", "left"))
        # A set of one document and no link needs no lookup. The others' names are spread, since a third of all rows may share one.
        sets = sets.where("low <> high or component is not null").withColumn("component", F.coalesce("component", "set_id"))
        least = stored(sets.groupBy("component").agg(F.min("low").alias("component_id")))
        named = stored(lookup_join(sets.select("set_id", "component"), least, ["component"], F.col("set_id")).select("set_id", "component_id"))
        out = lookup_join(per_doc, named, ["set_id"], F.xxhash64("doc_id"), "left")
        if repeated:
            # A row without words takes the component of its doc_id's other rows.
            whole = out.join(several.select("doc_id").hint("shuffle_merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c"))
            out = out.join(whole.hint("shuffle_merge"), "doc_id", "left").withColumn("component_id", F.coalesce("c", "component_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9."""
    return JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100).link()


ORACLE_SQL = {
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
}
QUERIES = {"op6_jaccard": op6_jaccard}
