"""Near-duplicate classes from bottom-k sketches of one hash function.

1. Every document becomes its set of word shingles, as 64-bit hashes; a sketch keeps
   the ``k`` smallest.  Documents with equal sets form one class; only classes go on.
2. Inverted lists: the key of a list is a run of consecutive retained values.  Two
   sets with Jaccard similarity of at least 0.85 differ in at most 15 % of their
   union, so (pigeonhole) full sets always share a run of 3 (of 4 from 28 shingles
   on); for sketches of 64 values the chance that a linked pair shares no run
   of 4 is below 1e-7.  For thresholds down to 0.80 the same holds of runs of 2 (4 to 6
   shingles) and 3 (from 6 on), see :func:`run_lengths`.
3. One aggregate per list counts its members and picks a leader; lists of several
   classes are joined with it, and each member is paired with the leader (not all pairs).  The
   bottom-k of the union of both sketches filters: values there that one set lacks are certain, and
   a pair with more of them than its sizes allow goes.  The similarity estimated from it orders the rest: likely pairs are
   verified first, on full sets, streamed past the set of their leader, and then those of the unlikely ones that join different components.
4. Confirmed links give components.  Lists that then still hold several components may
   hide links that no leader saw.  Their members are compared on full sets in blocks that Spark
   spreads over tasks, either list by list or by groups of overlapping lists, whichever takes
   fewer comparisons; only sets whose sizes allow a link meet, and only links between components become rows.

Texts are not shuffled but for those of candidates; the ids of candidates are broadcast up to
:data:`FEW` and joined by a shuffle beyond.  Tables that no later step reads are deleted.

Defined results: null texts and texts without words have an empty set and are linked
with nothing; null ids are never links (a row with a null id belongs to the class of its copies that have
ids); repeated rows agree; rows that share an id but not a text are documents of their own; an empty table gives
an empty result; texts of any length count whole; ties in sizes and hashes change nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import components, sized, spent, written

K = 64
#: Ids that are broadcast at most (8 bytes each) to pick candidates out of all rows.
FEW = 4_000_000
#: Members that meet their leader in one stretch of rows.
STRETCH = 256
#: How far the estimate of a likely pair may lie below the threshold.
SLACK = 0.25


def run_lengths(percent: int) -> list[tuple[int, int, float]]:
    """(length of a run, least set size, set size to stop before) of the lists for a threshold.

    A union of u has d = floor(u * (100 - percent) / 100) values at most that are not common, which leave a run of
    r if u - d > (r - 1) * (d + 1).  At 80 % this holds of r = 3 from u = 6 on and of r = 2 for u = 5; smaller sets are
    equal or not linked.  A set of 5 meets sets of up to 6.  Of 64 values in a row, each common with chance
    0.8, none three together: below 1e-7.
    """
    if percent < 80:
        raise ValueError("the run lengths hold for similarities of 0.80 and more")
    return [(3, 6, 32), (4, 28, float("inf"))] if percent >= 85 else [(2, 4, 7), (3, 6, float("inf"))]


class _Hashes(dict):
    """64-bit hash of a word, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` consecutive values; a shorter sequence is one run."""
    if not len(h):
        return h
    width = min(width, len(h))
    n, x = len(h) - width + 1, np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return x


def shingle_set(text: bytes | None, width: int = 3) -> np.ndarray:
    """Sorted distinct signed hashes of the word shingles of a UTF-8 text."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(_runs(h, width).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _over_texts(docs: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """``make(texts) -> columns`` over batches of texts, beside doc_id and the hash of the text."""

    def run(batches, make=make):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                cols = {"doc_id": batch.column(0), "content": batch.column(1), **make(texts)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, content long, {schema}")


def _name(shingles: np.ndarray) -> int:
    """The first of the two hashes of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def named_sets(texts: DataFrame, width: int) -> DataFrame:
    """(cid, shingles): the full sets of ``texts`` (cid, s1, text), once for each class."""

    def run(batches):
        for batch in batches:
            found = [(cid, s) for cid, s1, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()) if _name(s := shingle_set(t, width)) == s1]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), _lists([s for _, s in found])], ["cid", "shingles"])

    return texts.mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def with_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, k: int = K) -> DataFrame:
    """(doc_id, content, n_shingles, s1, s2, sketch): hash of the text, set size, two hashes of the set, its ``k`` smallest values."""

    def make(texts):
        sets = [shingle_set(t, width) for t in texts]
        raw = [s.tobytes() for s in sets]
        return {
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "s1": pa.array([_name(s) for s in sets], pa.int64()),
            "s2": pa.array(np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)),
            "sketch": _lists([s[:k] for s in sets]),
        }

    return _over_texts(docs, id_col, text_col, make, "n_shingles long, s1 long, s2 long, sketch array<long>")


def list_keys(sketches: DataFrame, percent: int = 85) -> DataFrame:
    """(key, cid) for each run of consecutive values of the sketches (cid, n_shingles, sketch)."""
    runs = run_lengths(percent)

    def run(batches):
        for batch in batches:
            cids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out_cids, out_keys = [], []
            for cid, n, x in zip(cids, sizes, batch.column(2)):
                h = np.asarray(x.values).view(np.uint64)
                for r, least, stop in runs:
                    if least <= n < stop:
                        out_keys.append(np.unique(_runs(h, r).view(np.int64)))
                        out_cids.append(np.full(len(out_keys[-1]), cid))
            if out_keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys)), pa.array(np.concatenate(out_cids))], ["key", "cid"])

    return sketches.select("cid", "n_shingles", "sketch").where(F.col("n_shingles") >= runs[0][1]).mapInArrow(run, "key long, cid long")


def led_lists(lists: DataFrame) -> DataFrame:
    """(key, cid, leader) of the lists (key, cid) with several members.

    One of four orders of the classes picks the leader, so that a group meets a few leaders and not one for each list.
    """
    mask = F.xxhash64(F.col("key").bitwiseAND(F.lit(3)))
    heads = lists.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("cid").bitwiseXOR(mask)).alias("m")).where("n > 1")
    return lists.join(heads.select("key", F.col("m").bitwiseXOR(mask).alias("leader")), "key")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (written) marked for a broadcast if it has no more than :data:`FEW` / 8 rows, as one of its keys may hold most rows of the other side."""
    return F.broadcast(df) if df.count() <= FEW // 8 else df


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (one column, written): a broadcast of up to :data:`FEW` ids, else a shuffle."""
    wanted = ids.toDF(column).distinct()
    return df.join(F.broadcast(wanted) if ids.count() <= FEW else wanted, column, "left_semi")


def estimated(pairs: DataFrame, sketches: DataFrame, k: int, n: int, percent: int = 85) -> DataFrame:
    """(x, y, likely): those of the ``n`` pairs (x, y) that can reach the threshold by the k smallest values of the union of both sketches.

    Of sizes a and b, sets that are linked differ in (a + b) * (100 - percent) / (100 + percent) values at most; of a value among the
    k smallest of the union it is certain whether both have it.  ``likely`` marks pairs whose estimated similarity is near the threshold.
    """
    sx = sketches.select(F.col("cid").alias("x"), F.col("sketch").alias("kx"), F.col("n_shingles").alias("nx"))
    sy = sketches.select(F.col("cid").alias("y"), F.col("sketch").alias("ky"), F.col("n_shingles").alias("ny"))
    both = sized(pairs.join(sx, "x"), n, 5_000).join(sy, "y").where((100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx")))
    both = both.select("x", "y", "kx", "ky", (F.col("nx") + F.col("ny")).alias("sizes"), F.slice(F.sort_array(F.array_union("kx", "ky")), 1, k).alias("low"))
    hits = F.size(F.array_intersect(F.array_intersect("low", "kx"), "ky"))
    both = both.select("x", "y", "sizes", F.size("low").alias("n"), hits.alias("hits"))
    possible = both.where((100 + percent) * (F.col("n") - F.col("hits")) <= (100 - percent) * F.col("sizes"))
    return sized(possible.select("x", "y", (F.col("hits") >= (percent / 100 - SLACK) * F.col("n")).alias("likely")), n, 5_000)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold; ``texts`` (cid, s1, text) has those of both sides.

    The rows of a leader y and of a stretch of its members follow each other, the leader first, so a task
    holds one set at a time.
    """
    stretches = pairs.groupBy("y").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("stretches"))
    members = pairs.join(stretches, "y").select(F.col("x").alias("cid"), F.col("y").alias("leader"), F.pmod(F.xxhash64("x"), "stretches").cast("int").alias("stretch"), F.lit(1).alias("role"))
    leaders = stretches.select(F.col("y").alias("cid"), F.col("y").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"), F.lit(0).alias("role"))
    rows = members.union(leaders).join(texts, "cid")
    rows = rows.repartition("leader", "stretch").sortWithinPartitions("leader", "stretch", "role").select("leader", "role", "cid", "s1", "text")

    def run(batches):
        head, own = None, None
        for batch in batches:
            found = []
            for leader, role, cid, s1, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).cast(pa.binary()).to_pylist()):
                s = shingle_set(text, width)
                if _name(s) != s1:  # another text under the same id
                    continue
                if role == 0:
                    head, own = leader, s
                elif head == leader:
                    same = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * same >= percent * (len(own) + len(s) - same):
                        found.append((cid, leader))
            x, y = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return rows.mapInArrow(run, "x long, y long")


#: Classes and shingles on each side of one block of comparisons, and shingles multiplied at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1_000_000, 4096


def _groups(open_: DataFrame) -> DataFrame:
    """(g, cid, c, n_shingles): classes to compare with each other, from the open lists (key, cid, leader, c, n_shingles).

    A group is all lists that are connected by members (similar sets share many lists); where these are more than a
    block of classes and going list by list takes fewer comparisons, a group is a list.
    """
    n = open_.count()
    family = components(open_.select(F.col("cid").alias("a"), F.col("leader").alias("b"))).withColumnsRenamed({"node": "cid", "component": "f"})
    rows = written(sized(open_.drop("leader").join(family, "cid"), n), "families")
    square = lambda by: rows.groupBy("f", by).agg(F.count("*").alias("n"))
    # a group costs as much as some ten thousand comparisons by itself
    by_list = square("key").groupBy("f").agg(F.sum(F.pow(F.col("n") + 100.0, F.lit(2.0))).alias("lists"))
    by_family = square("cid").groupBy("f").agg((F.count("*").cast("double") * F.count("*")).alias("whole"))
    apart = by_list.join(by_family, "f").where((F.col("whole") > BLOCK * BLOCK) & (F.col("lists") < F.col("whole")))
    apart = written(apart.select("f", F.lit(True).alias("by_list")), "apart")
    marked = rows.join(_small(apart), "f", "left").withColumn("by_list", F.coalesce("by_list", F.lit(False)))
    out = marked.select(F.when(F.col("by_list"), F.col("key")).otherwise(F.col("f")).alias("g"), "by_list", "cid", "c", "n_shingles").distinct()
    out = written(sized(out, n), "groups")
    spent(rows, apart)
    return out


def between_components(open_: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (x, y) between different components of the open lists (key, cid, leader, c, n_shingles).

    All classes of a group but those of its largest component ask all others of a size that allows a link, in blocks of
    :data:`BLOCK` by :data:`BLOCK` full sets.  Sizes are dealt into classes of which only neighbours can be linked.
    """
    groups = _groups(open_)
    parts = groups.groupBy("g", "by_list", "c").agg(F.count("*").alias("size"))
    largest = written(parts.groupBy("g", "by_list").agg(F.max_by("c", F.struct("size", "c")).alias("largest")), "largest")
    band = F.floor(F.log("n_shingles") / float(np.log(100 / percent))).cast("int")
    rows = groups.join(_small(largest), ["g", "by_list"]).select("g", "by_list", "cid", "c", "n_shingles", band.alias("band"), (F.col("c") != F.col("largest")).alias("open"))
    asked = rows.select("g", "by_list", "cid", "c", "n_shingles", "open", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("cell"), "band")
    asked = written(asked, "asked")
    asks = F.col("open") & (F.col("cell") == F.col("band"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    chunks = F.greatest(F.ceil(F.count_if(asks) / BLOCK), F.ceil(F.sum(F.when(asks, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    cells = asked.groupBy("g", "by_list", "cell").agg(blocks.alias("blocks"), chunks.alias("chunks"))
    cells = written(cells.where("chunks > 0"), "cells")
    placed, hashed = asked.join(_small(cells), ["g", "by_list", "cell"]), F.xxhash64("cid")
    cell = ["g", "by_list", "cell"]
    asking = placed.where(asks).select(*cell, F.pmod(hashed, "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "cid", "c")
    other = placed.select(*cell, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(hashed, "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "cid", "c")
    sets = written(named_sets(texts, width), "sets")
    both = asking.unionByName(other).join(sets, "cid")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return linked_between(pdf, percent)

    links = written(both.groupBy(*cell, "chunk", "block").applyInPandas(compare, "x long, y long"), "links")
    spent(groups, largest, asked, cells, sets)
    return links


def linked_between(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the rows that ask and the others, of different components, by exact Jaccard similarity."""
    a, b = pdf[pdf.asks], pdf[~pdf.asks]
    flat = [np.asarray(s) for s in (*a.shingles, *b.shingles)]
    sizes = np.array([len(s) for s in flat])
    _, column, counts = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    # a shingle of one document adds nothing to an intersection
    shared = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(flat)), sizes)
    keep = counts[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        cells = np.zeros((len(flat), COLUMNS), np.float32)
        cells[row[lo:hi], column[lo:hi] - first] = 1
        both += cells[: len(a)] @ cells[len(a) :].T
    union = sizes[: len(a), None] + sizes[None, len(a) :] - both
    ok = (100 * both >= percent * union) & (a.c.to_numpy()[:, None] != b.c.to_numpy()[None, :])
    i, j = np.nonzero(ok)
    # one link of a class with each component that it meets is enough
    out = pd.DataFrame({"x": a.cid.to_numpy()[i], "y": b.cid.to_numpy()[j], "c": b.c.to_numpy()[j]})
    return out.drop_duplicates(["x", "c"])[["x", "y"]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 3, k: int = K) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, n_same (rows with the same set), content (xxhash64 of the text).

    ``percent`` is the least Jaccard similarity of a link, in percent (80 or more).
    """
    every = written(with_sketches(docs, id_col, text_col, width, k), "sketches")
    n = every.count()
    classes = every.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same"))
    # numbers of classes hold once they are written
    classes = written(sized(classes, n, 10_000).withColumn("cid", F.monotonically_increasing_id()), "classes")
    named = classes.where("rep is not null").select("cid", F.col("rep").alias("doc_id"), "s1", "s2")
    sketches = every.join(named, ["doc_id", "s1", "s2"]).select("cid", "n_shingles", "sketch").dropDuplicates(["cid"])
    sketches = written(sized(sketches, n, 5_000), "class-sketches")
    members = written(sized(led_lists(list_keys(sketches, percent)), k * n, 100_000), "lists")
    m = members.count()
    ids = written(sized(members.select("cid").distinct(), m), "ids")
    few = written(_only(sketches, "cid", ids), "few-sketches")
    spent(sketches)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def texts(cids: DataFrame) -> DataFrame:
        """(cid, s1, text) of classes; a text under the id of a class but of another set has another s1."""
        own = written(_only(named, "cid", cids).select("doc_id", "cid", "s1"), "named")
        own_ids = written(own.select("doc_id").distinct(), "ids")
        return _only(rows, "doc_id", own_ids).join(own, "doc_id").select("cid", "s1", "text")

    pairs = written(sized(members.where("cid <> leader").select(F.col("cid").alias("x"), F.col("leader").alias("y")).distinct(), m), "pairs")
    possible = written(estimated(pairs, few, k, pairs.count(), percent), "possible")

    def linked(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (x, y) that full sets confirm."""
        sides = written(pairs.select("x").union(pairs.select("y")).distinct(), "ids")
        links = written(confirmed(pairs, texts(sides), percent, width), "links")
        spent(sides)
        return links.select(F.col("x").alias("a"), F.col("y").alias("b"))

    comps = components(linked(possible.where("likely").select("x", "y")))
    # unlikely pairs count as well, but where both sides are in one component by now they say nothing new
    cx, cy = comps.toDF("x", "cx"), comps.toDF("y", "cy")
    apart = possible.where("not likely").join(cx, "x", "left").join(cy, "y", "left").where(F.coalesce("cx", "x") != F.coalesce("cy", "y"))
    apart = written(apart.select("x", "y"), "unlikely")
    if apart.take(1):
        stars = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = components(stars.union(linked(apart)))

    # lists that hold several components by now
    label = members.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "leader", F.coalesce("component", "cid").alias("c"))
    label = written(sized(label, m), "labels")
    split = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key")
    open_ = label.join(split, "key", "left_semi").join(few.select("cid", "n_shingles"), "cid")
    open_ = written(sized(open_, m), "open")
    spent(members, ids, few, pairs, possible, apart, label)
    if open_.take(1):
        cids = written(sized(open_.select("cid").distinct(), m), "ids")
        more = between_components(open_, texts(cids), percent, width)
        if more.take(1):
            stars = comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = components(stars.union(more.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    spent(open_)

    # a component is named by the smallest id of its classes
    named = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = named.join(smallest, "component").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n_shingles").alias("n"), "smallest", "n_same")
    out = every.select("doc_id", "content", "n_shingles", "s1", "s2").join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") == F.col("n")), "left")
    component = F.coalesce("smallest", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"), "content")
