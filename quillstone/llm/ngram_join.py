"""N-gram Jaccard self-join by vertical partitioning.

All shingles stand in one global order: those in few documents first, by their document count, then the hot ones. The order
is cut into fragments, and every set with it:

1. Records. A document becomes its number of shingles and its class (two hashes of its set, 128 bits together: equal sets
   are one class, so copies are never paired). Hot shingles are found on the way: each chunk of a task reports those that
   are many of its own, and the sums that pass 1 / HOT of all shingles are hot. At most HOT can, so their table may be
   broadcast at any size of the input.
2. Counts. Each task packs the other shingles of its classes by ranges of hashes, whose number follows the number of
   shingles; a range counts its own and answers those held twice or more. What is held once can't be shared. A class thus
   gets its set in the global order, cut into three fragments: rare, frequent and hot shingles.
3. Candidates. Two linked sets share one of the first n - ceil(0.75 n) + 1 shingles of both (prefix). The lists of rare
   shingles have under FREQUENT members, and all their pairs that pass the length and positional filters are candidates.
   The lists of the others give stars only: each member with a few members of the list.
4. Overlaps. Each fragment counts its partial overlap of a pair, and the partial overlaps are summed per pair. Pairs with
   Jaccard similarity of 0.75 or more are links; links form components.
5. What stars miss. Lists that hold several components give stars around other and more members, then the pairs between
   different components: lists are cut by length class (linked sets are in the same or the next) and in blocks of BLOCK
   members, so no task meets more than a block of a list. Pairs inside a component can't change it and aren't made.

So no link between different sets is lost, and no group is expanded into its pairs.

Defined cases: null text is the empty text; a text without words has no shingles, links with nothing and is its own
component; repeated rows each give a row; an empty table gives an empty one; ids must be integers, null ids come out as
their own component (null). Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Workspace
from quillstone.llm.shingles import SIZE, shingles

NUMERATOR, DENOMINATOR = 3, 4  # similarity of 0.75
FREQUENT = 8
#: Most hot shingles; their table of 12 bytes each is broadcast. A chunk reports what is MANY / HOT of its shingles or more.
HOT, MANY = 1 << 20, 4
#: Fragments of a set along the global order.
PARTS = ("rare", "frequent", "hot")
#: Centres of the stars in each round before all remaining pairs are made; few while much is apart, more for stragglers.
STARS = (2, 8, 32, 128)
#: Shingles that a task holds before it packs them; shingles of a range of hashes, and of a task that counts ranges.
HELD, RANGE, DEALT = 1_000_000, 1 << 20, 1 << 20
#: Bytes of a shingle that are sent beside its range; counts above MOST_TIMES are one place of the order, where hashes decide.
LOW, MOST_TIMES = 7, 65535
#: Ways a hot list is dealt, and members of a block when all remaining pairs are made.
SALTS, BLOCK = 8, 1024


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def least_overlap(n: Column, m: Column) -> Column:
    """Shared shingles that sets of n and m need."""
    return F.ceil(NUMERATOR * (n + m) / (NUMERATOR + DENOMINATOR))


def _tidy(df: DataFrame) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more; results don't depend on it."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def class_of(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; the second tells different sets with the same first apart."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def records(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: id, n, cid and check of each document (null cid without shingles); key and times of many-times shingles of a chunk."""
    ddl = "id bigint, n bigint, cid bigint, check bigint, key bigint, times bigint"

    def batch_of(*columns: list | np.ndarray | None) -> pa.RecordBatch:
        length = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(length, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=["id", "n", "cid", "check", "key", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def many() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, ceil(MANY * total / HOT))
            return batch_of(None, None, None, None, keys[often].view(np.int64), n[often])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, cid, check = [], [], []
                for text in part.column(1):
                    own = shingles(text.as_py(), size)
                    first, second = class_of(own) if len(own) else (None, None)
                    n.append(len(own))
                    cid.append(first)
                    check.append(second)
                    if first is not None and first not in seen:
                        seen.add(first)
                        held.append(own)
                        total += len(own)
                    if total >= HELD:
                        yield many()
                        held, total = [], 0
                yield batch_of(part.column(0), n, cid, check, None, None)
        if held:
            yield many()

    return docs.select("id", "text").mapInArrow(run, ddl)


class Hot:
    """The hot shingles: sorted keys, and the place of each among them in the global order."""

    def __init__(self, keys: np.ndarray, times: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.place = keys[order], np.empty(len(keys), np.uint32)
        self.place[np.lexsort((self.keys, times[order]))] = np.arange(len(keys), dtype=np.uint32)

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other shingles, and the hot ones in the global order."""
        if not len(self.keys):
            return own, own[:0]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hot = self.keys[at] == own
        return own[~hot], own[hot][np.argsort(self.place[at[hot]])]


def hot_shingles(found: DataFrame, total: int) -> Hot:
    """Those whose reported times pass total / HOT, of which there are HOT at most, as all times sum to `total` at most."""
    border = max(FREQUENT, total / HOT)
    table = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= border).toArrow()
    return Hot(table.column("key").to_numpy(), table.column("times").to_numpy())


def sets_of(docs: DataFrame, hot: Hot, renamed: frozenset[int], total: int, size: int) -> DataFrame:
    """cid, n, before, prefix and the three fragments of each class whose prefix holds a shingle that others have too.

    before: shingles that are only in this class, first in the global order; prefix: how many after them are in the prefix.
    renamed: first hashes that different sets share; their classes go by the second.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / DEALT))
    bits = max(8, ceil(log2(parts)) + 2, ceil(log2(max(1, total / RANGE))))  # 8: so a range and the low LOW bytes make a key

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles by range of hashes, with the number in its chunk of the class that has them; and a row of classes for each chunk."""
        own_hot, task = shared.value, TaskContext.get().partitionId()
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        total = chunks = 0

        def packed() -> pa.RecordBatch:
            keys = np.concatenate([x[2] for x in held])
            refs = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x[2]) for x in held])
            order = np.argsort(keys)
            keys, refs = keys[order], refs[order]
            ranges = keys >> np.uint64(64 - bits)
            edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
            used = ranges[edges[:-1]].astype(np.int64)
            chunk = (task << 32) + chunks
            classes = np.array([[x[0] for x in held], [x[1] for x in held], [len(x[3]) for x in held]], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*used, (task * 0x9E3779B1 + chunks * 0x85EBCA77) % (1 << bits)], pa.int32()),  # the row of classes goes anywhere
                    pa.array([chunk] * (len(used) + 1), pa.int64()),
                    pa.array([*(_low(keys[a:b]) for a, b in zip(edges, edges[1:])), np.concatenate([x[3] for x in held]).tobytes()], pa.binary()),
                    pa.array([*(refs[a:b].tobytes() for a, b in zip(edges, edges[1:])), None], pa.binary()),
                    pa.array([*([None] * len(used)), classes.tobytes()], pa.binary()),
                ],
                names=["range", "chunk", "keys", "refs", "classes"],
            )

        for batch in batches:
            for text in batch.column(0):
                own = shingles(text.as_py(), size)
                if not len(own):
                    continue
                cid, check = class_of(own)
                cid = check if cid in renamed else cid
                if cid in seen:  # one copy of a class for each task
                    continue
                seen.add(cid)
                held.append((cid, len(own), *own_hot.split(own)))
                total += len(own)
                if total >= HELD or len(held) == 1 << 16:
                    yield packed()
                    held, total, chunks = [], 0, chunks + 1
        if held:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per range: the shingles that are held twice or more, with their counts, back to their chunks."""
        for of, rows in _groups(batches):
            given = [r for r in rows if r["classes"] is None]
            out = [(r["chunk"], r["keys"], None, None, r["classes"]) for r in rows if r["classes"] is not None]
            if given:
                own = [_whole(r["keys"], of, bits) for r in given]
                keys = np.concatenate(own)
                order = np.argsort(keys, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
                n = np.empty(len(keys), np.uint32)
                n[order] = np.repeat(np.diff(edges), np.diff(edges))
                at = 0
                for r, k in zip(given, own):
                    times = n[at : at + len(k)]
                    at += len(k)
                    if (more := times > 1).any():
                        out.append((r["chunk"], k[more].tobytes(), np.frombuffer(r["refs"], np.uint16)[more].tobytes(), np.minimum(times[more], MOST_TIMES).astype(np.uint16).tobytes(), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], names=["chunk", "keys", "refs", "times", "classes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk: the sets of its classes in the global order."""
        for _, rows in _groups(batches):
            base = next(r for r in rows if r["classes"] is not None)
            cid, n, hots = np.frombuffer(base["classes"], np.int64).reshape(3, -1)
            hot_keys, hot_at = np.frombuffer(base["keys"], np.int64), np.concatenate(([0], np.cumsum(hots)))
            given = [r for r in rows if r["classes"] is None]
            keys, refs, times = (np.concatenate([np.frombuffer(r[name], kind) for r in given] or [np.zeros(0, kind)]) for name, kind in (("keys", np.uint64), ("refs", np.uint16), ("times", np.uint16)))
            order = np.lexsort((keys, times, refs))
            keys, refs, times = keys[order].view(np.int64), refs[order], times[order]
            edges = np.searchsorted(refs, np.arange(len(cid) + 1))
            rares = edges[:-1] + np.add.reduceat(np.append(times < FREQUENT, False).astype(np.int64), edges[:-1]) * (np.diff(edges) > 0)
            out = []
            for k in range(len(cid)):
                own = keys[edges[k] : edges[k + 1]]
                before = int(n[k] - len(own) - hots[k])
                if (prefix := prefix_length(int(n[k])) - before) > 0:
                    out.append((cid[k], n[k], before, prefix, keys[edges[k] : rares[k]], keys[rares[k] : edges[k + 1]], hot_keys[hot_at[k] : hot_at[k + 1]]))
            for at in range(0, len(out), 1024):
                columns = list(zip(*out[at : at + 1024]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[4:])], names=["cid", "n", "before", "prefix", *PARTS])

    packed_rows = docs.select("text").mapInArrow(pack, "range int, chunk bigint, keys binary, refs binary, classes binary").repartition(parts, "range").sortWithinPartitions("range")
    counted = packed_rows.mapInArrow(count, "chunk bigint, keys binary, refs binary, times binary, classes binary").repartition(parts, "chunk").sortWithinPartitions("chunk")
    gathered = counted.mapInArrow(gather, "cid bigint, n bigint, before bigint, prefix bigint, " + ", ".join(f"{p} array<bigint>" for p in PARTS))
    return gathered.dropDuplicates(["cid"])  # a class may be in several chunks


def _low(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]).tobytes()


def _whole(low: bytes, of: int, bits: int) -> np.ndarray:
    """Keys from their low bytes and their range."""
    parts = np.zeros((len(low) // LOW, 8), np.uint8)
    parts[:, :LOW] = np.frombuffer(low, np.uint8).reshape(-1, LOW)
    return parts.reshape(-1).view("<u8") | np.uint64(of << (64 - bits))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with the same first column, of batches sorted by it; one run is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            of = next(iter(row.values()))
            if rows and of != key:
                yield key, rows
                rows = []
            key = of
            rows.append(row)
    if rows:
        yield key, rows


def may_link(x: Column, y: Column) -> Column:
    """Length and positional filters of two structs of (cid, n, at) that share a shingle."""
    n, m = x["n"], y["n"]
    most = 1 + F.least(n - 1 - x["at"], m - 1 - y["at"])
    return (NUMERATOR * F.greatest(n, m) <= DENOMINATOR * F.least(n, m)) & (most >= least_overlap(n, m))


def pair_of(x: Column, y: Column) -> Column:
    """a < b and their sizes from two structs of (cid, n, at)."""
    a, b = F.least(x, y), F.greatest(x, y)  # structs compare by cid first
    return F.struct(a["cid"].alias("a"), b["cid"].alias("b"), a["n"].alias("n"), b["n"].alias("m"))


def rare_pairs(sets: DataFrame) -> DataFrame:
    """Candidates that share a rare prefix shingle. A list has under FREQUENT members."""
    each = sets.where("size(rare) > 0").select("cid", "n", "before", F.posexplode(F.expr("slice(rare, 1, cast(prefix AS int))")).alias("k", "token"))
    lists = each.groupBy("token").agg(F.collect_list(F.struct("cid", "n", (F.col("before") + F.col("k")).alias("at"))).alias("xs")).where("size(xs) > 1")

    def later(x: Column) -> Column:
        return F.transform(F.filter("xs", lambda y: (x["cid"] < y["cid"]) & may_link(x, y)), lambda y: pair_of(x, y))

    return lists.select(F.explode(F.flatten(F.transform("xs", later))).alias("pair")).select("pair.*").distinct()


def lists_of(sets: DataFrame) -> DataFrame:
    """The members (token, x = struct of cid, n, at; hot) of the lists of frequent and hot prefix shingles."""
    more = sets.where("prefix > size(rare) AND size(frequent) + size(hot) > 0")
    each = more.select("cid", "n", (F.col("before") + F.size("rare")).alias("before"), F.size("frequent").alias("frequents"), F.posexplode(F.expr("slice(concat(frequent, hot), 1, cast(prefix - size(rare) AS int))")).alias("k", "token"))
    return each.select("token", F.struct("cid", "n", (F.col("before") + F.col("k")).alias("at")).alias("x"), (F.col("k") >= F.col("frequents")).alias("hot"))


def met(lists: DataFrame, short: DataFrame, how: str = "inner") -> DataFrame:
    """lists joined with a short table (token, hot, ...) on token; the members of a hot list are dealt SALTS ways."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("x.cid"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return lists.withColumn("salt", salt).join(short.withColumn("salt", salts).drop("hot"), ["token", "salt"], how).drop("salt")


def open_lists(lists: DataFrame) -> DataFrame:
    """The lists (token, x, hot, label) that hold more than one component."""
    several = lists.groupBy("token", "hot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token", "hot")
    return met(lists, several, "left_semi")


def stars(lists: DataFrame, centres: int, salt: int) -> DataFrame:
    """Candidates: each member of a list (token, x, hot, label) with `centres` members picked by a hash.

    Members fall into `centres` classes by the hash, and the least of each class is a centre; it is an aggregate, so a
    long list shrinks in each task before the shuffle.
    """
    place = F.xxhash64("x.cid", F.lit(salt))
    picked = lists.groupBy("token", "hot", F.pmod(place, F.lit(centres)).alias("kind")).agg(F.min(F.struct(place.alias("place"), "x", "label")).alias("centre"))
    picked = picked.select("token", "hot", F.col("centre.x").alias("y"), F.col("centre.label").alias("other"))
    made = met(lists, picked).where((F.col("label") != F.col("other")) & may_link(F.col("x"), F.col("y")))
    return made.select(pair_of(F.col("x"), F.col("y")).alias("pair")).select("pair.*").distinct()


def across(lists: DataFrame) -> DataFrame:
    """Candidates: all pairs of a list's members in different components. Work is dealt by list, length class and block."""
    sized = lists.withColumn("long", F.floor(F.log("x.n") / float(np.log(DENOMINATOR / NUMERATOR + 0.005))).cast("int"))
    blocks = sized.groupBy("token", "hot", "long").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return met(rows.withColumnRenamed("long", "of"), blocks).where("long = of").drop("of")

    left = in_blocks(sized).withColumn("block", F.pmod(F.xxhash64("x.cid", F.lit("block")), F.col("blocks")).cast("int")).select("token", "long", "block", "x", "label")
    # a member meets the blocks of its own length class and of the one below
    right = sized.select("token", "hot", F.col("x"), F.col("label").alias("other"), F.col("long").alias("own"), F.explode(F.array("long", F.col("long") - 1)).alias("long"))
    right = in_blocks(right).select("token", "long", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("y"), "other", "own")
    made = left.join(right, ["token", "long", "block"]).where(((F.col("own") > F.col("long")) | (F.col("label") < F.col("other"))) & (F.col("label") != F.col("other")) & may_link(F.col("x"), F.col("y")))
    return made.select(pair_of(F.col("x"), F.col("y")).alias("pair")).select("pair.*").distinct()


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a and b of the pairs that link: partial overlaps of each fragment, summed per pair."""
    cut = sets.select("cid", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(p).alias("tokens")) for k, p in enumerate(PARTS)))).alias("x")).select("cid", "x.*").where("size(tokens) > 0")
    left = cut.select(F.col("cid").alias("a"), "part", F.col("tokens").alias("left"))
    right = cut.select(F.col("cid").alias("b"), "part", F.col("tokens").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n", "m", F.size(F.array_intersect("left", "right")).cast("long").alias("partial"))
    summed = partial.groupBy("a", "b", "n", "m").agg(F.sum("partial").alias("shared"))
    return summed.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("n") + F.col("m") - F.col("shared"))).select("a", "b")


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """cid and label (the least cid of its component) of the vertices of edges (a, b): least neighbour, then label of label.

    Labels only fall, so the rounds end; taking the label of the label halves the way to the least each time.
    """
    size = edges.count()
    both = space.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges", 2 * size)
    labels = space.keep(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0", 2 * size)
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("cid").alias("b"), "label"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "cid").select("cid", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jumped = lower.join(labels.select(F.col("cid").alias("of"), F.col("label").alias("far")), F.col("label") == F.col("of")).select("cid", F.least("label", "far").alias("label"), "old")
        new = space.keep(jumped, f"{name}-{k}", 2 * size)
        space.drop(f"{name}-{k - 1}")
        labels = new.select("cid", "label")
        if new.where("label <> old").isEmpty():
            space.drop(f"{name}-edges")
            return labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links, itself included) of each row of docs."""
    space = Workspace(docs.sparkSession, "ngram-join")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = space.keep(records(docs, size), "records")
    rows = found.where("n IS NOT NULL").select("id", "n", "cid", "check")
    total, documents = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = hot_shingles(found, total)
    # first hashes of different sets: about 3 among 10^10 documents
    renamed = frozenset(r["cid"] for r in rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("cid").collect())
    if renamed:
        rows = rows.withColumn("cid", F.when(F.col("cid").isin(*renamed), F.col("check")).otherwise(F.col("cid")))
    sets = space.keep(sets_of(docs, hot, renamed, total, size), "sets")
    _tidy(docs)
    rare, lists = space.keep(rare_pairs(sets), "rare"), space.keep(lists_of(sets), "lists")

    labels, members, labelled = None, lists.count(), 0
    for k in range(len(STARS) + 1):
        if labels is None:
            named = lists.withColumn("label", F.col("x.cid"))
        else:
            named = lists.join(labels.withColumnRenamed("cid", "of"), F.col("x.cid") == F.col("of"), "left").select("token", "x", "hot", F.coalesce("label", "x.cid").alias("label"))
            named = space.keep(open_lists(named), f"open-{k}", members)
            members = named.count()
            if named.isEmpty():
                break
        made = stars(named, STARS[k], k) if k < len(STARS) else across(named)
        pairs = space.keep(made.unionByName(rare).distinct() if k == 0 else made, f"pairs-{k}")
        linked = space.keep(links(pairs, sets), f"links-{k}", pairs.count())
        labelled += 2 * linked.count()
        space.drop(f"pairs-{k}")
        if linked.isEmpty():
            if labels is None:
                labels = linked.select(F.col("a").alias("cid"), F.col("a").alias("label"))
            continue
        if labels is None:
            labels = space.keep(components(linked, space, f"graph-{k}"), f"labels-{k}", labelled)
            continue

        def label_of(side: str) -> DataFrame:
            return labels.select(F.col("cid").alias(side), F.col("label").alias(f"l{side}"))

        contracted = linked.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
        merged = components(contracted, space, f"graph-{k}").select(F.col("cid").alias("of"), F.col("label").alias("to"))
        moved = labels.join(merged, F.col("label") == F.col("of"), "left").select("cid", F.coalesce("to", "label").alias("label"))
        # a label that is a vertex of the contracted graph stands for itself too
        labels = space.keep(moved.unionByName(merged.select(F.col("of").alias("cid"), F.col("to").alias("label"))).groupBy("cid").agg(F.min("label").alias("label")), f"labels-{k}", labelled)
    space.drop("sets", "lists", "rare")
    classes = rows.where("cid IS NOT NULL AND id IS NOT NULL").groupBy("cid").agg(F.min("id").alias("id"))
    # written before they meet: a join of plain shuffles is one that adaptive execution splits where a component is large
    named = space.keep(classes.join(labels, "cid", "left").select("cid", "id", F.coalesce("label", "cid").alias("label")), "named", documents)
    least = space.keep(named.groupBy("label").agg(F.min("id").alias("component_id")), "least", documents)
    by_class = space.keep(named.join(least, "label").select("cid", "component_id"), "by-class", documents)
    out = rows.select("id", "n", "cid").join(by_class, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
