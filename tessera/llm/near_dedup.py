"""Near duplicates by a chosen-path set similarity join, and their components.

A document's set holds its distinct ``shingle``-word runs. Documents with equal
sets are one node of the join. In each of ``trees`` independent trees a document
walks down by the minwise token of its set under that level's hash: documents
of Jaccard similarity s take the same branch with probability s. A tree node of
at most ``leaf`` documents is compared exhaustively; larger ones branch again,
down to ``LEVELS``; what is larger still is compared exhaustively too: it is cut
into blocks of ``BLOCK`` shingles, and each two blocks make a cell, so every two
documents of the node meet in one. A pair at the threshold t ends up
together in a tree of depth d with probability t**d. There are so many trees that
all miss it with a probability of ``MISSED`` at most even where every one of them
has the greatest depth: 10 at 0.85, 14 at 0.8.

Comparing a leaf takes two rounds. First every document meets the leader of its
likes (b-bit sketches tell who is worth a comparison); links are confirmed on
full sets and give components. Then each pair of the leaf that is still in
different components is compared. Pairs within a component need no further link.
A cell that still has several components counts the intersections of its full
sets as matrix products and returns at most one link a document, so the rows
made stay linear in the documents of large groups; only arithmetic doesn't.

Components are found by minimum labels with pointer jumping, round by round in
the shared folder; nothing of the documents' size reaches the driver.

Defined results: documents without words have set size 0 and stand alone; rows
with a null id stand alone (component null, kept); rows that share an id are one
document of the graph, whatever their texts: what one of them is linked to, all are;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEVELS, LEAF = 4, 48
#: Shingles of a block, about: two blocks of a node that is over-full at the last level are compared at once.
BLOCK = 1 << 20
#: The most that the chance of missing a pair at the threshold may be.
MISSED = 1e-3
#: Of the sketch's bytes, the share that must agree for a comparison. At 0.85 it is 6 deviations below the mean.
WORTH = 0.5


def trees_for(percent: int) -> int:
    """The least number of trees that miss a pair at the threshold with ``MISSED`` at most, at the greatest depth."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - (min(percent, 99) / 100) ** LEVELS)))


def _salts(trees: int) -> np.ndarray:
    return common.mix(np.arange(1, trees * LEVELS + 1, dtype=np.uint64) * common.MIX_A) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = common.Words([t.lower() for t in texts])
    runs = common.sequence_hashes(words.hashes, shingle)
    out = []
    for lo, hi in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if hi - lo >= shingle:
            out.append(np.unique(runs[lo : hi - shingle + 1]))
        elif hi > lo:
            out.append(common.sequence_hashes(words.hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def tokens_of(values: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The minwise token of a set for every tree and level, 32 bits each."""
    best = np.full(len(salts), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1 << 13):
        best = np.minimum(best, (values[at : at + (1 << 13), None] * salts[None, :]).min(axis=0))
    return (common.mix(best) >> np.uint64(32)).astype(np.uint32)


def _facts(docs: DataFrame, shingle: int, trees: int) -> DataFrame:
    salts = _salts(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                sets = shingle_sets(common.byte_texts(part.column(1)), shingle)
                with np.errstate(over="ignore"):
                    one = [int(s.sum(dtype=np.uint64)) for s in sets]
                    two = [int(common.mix(s ^ common.MIX_B).sum(dtype=np.uint64)) for s in sets]
                toks = [tokens_of(s, salts).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(one, dtype=np.uint64).view(np.int64)), pa.array(np.array(two, dtype=np.uint64).view(np.int64)), pa.array(toks, pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.map_arrow, run, "doc_id long, n_shingles long, s1 long, s2 long, tokens binary")


def _with_tree_paths(reps: DataFrame, trees: int) -> DataFrame:
    """``rep, tree, node, tokens`` at the first level of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, trees, LEVELS)
            n = len(raw)
            tree = np.tile(np.arange(trees, dtype=np.int32), n)
            node = common.mix(raw[:, :, 0].ravel().astype(np.uint64) + (tree.astype(np.uint64) << np.uint64(32)) + np.uint64(1 << 48))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), trees)), pa.array(tree), pa.array(node.view(np.int64))], names=["rep", "tree", "node"])

    return reps.select("rep", "tokens").transform(common.map_arrow, run, "rep long, tree int, node long")


def _next_level(rows: DataFrame, level: int, trees: int) -> DataFrame:
    """The child of each row's node that its document chooses at ``level``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = np.asarray(batch.column(1))
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint32).reshape(-1, trees, LEVELS)
            token = raw[np.arange(len(tree)), tree, level].astype(np.uint64)
            node = common.mix(np.asarray(batch.column(2)).view(np.uint64) ^ common.mix(token + np.uint64(level << 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64))], names=["rep", "tree", "node"])

    return rows.select("rep", "tree", "node", "tokens").transform(common.map_arrow, run, "rep long, tree int, node long")


def _cells(large: DataFrame, block: int) -> DataFrame:
    """``node, rep`` of cells in which each two members of an over-full node ``node, rep, n_shingles`` meet."""
    blocks = large.groupBy("node").agg(F.ceil(F.sum("n_shingles") / block).alias("blocks"))
    own = large.join(blocks.hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node", "rep"), "blocks"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> own or blocks = 1")
    return other.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep")


def _leaves(reps: DataFrame, leaf: int, trees: int, block: int) -> DataFrame:
    """Members ``node, rep, cell`` of leaves with at least two, and of cells."""
    spark = reps.sparkSession
    rows = _with_tree_paths(reps, trees)
    members = None
    for level in range(LEVELS):
        rows = common.save(rows, f"level{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        shared = common.save(rows.join(sizes.where("n > 1").hint("merge"), "node"), f"shared{level}")
        common.remove(spark, rows)
        small = shared.where(F.col("n") <= leaf).select("node", "rep", F.lit(False).alias("cell"))
        members = small if members is None else members.unionByName(small)
        large = shared.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            members = members.unionByName(_cells(large.join(reps.select("rep", "n_shingles"), "rep"), block).withColumn("cell", F.lit(True)))
        else:
            rows = _next_level(large.join(reps.select("rep", "tokens"), "rep"), level + 1, trees)
    return members


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=-1) >= WORTH


def _leaders(leaves: DataFrame) -> DataFrame:
    """``a, b``: each leaf document with the first one before it that it may resemble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0).to_pylist():
                ids = [m["rep"] for m in group]
                sk = np.frombuffer(b"".join(m["tokens"] for m in group), dtype=np.uint32).reshape(len(ids), -1)
                lead: list[int] = []
                for i in range(len(ids)):
                    near = np.flatnonzero(_alike(sk[lead], sk[i])) if lead else []
                    if len(near):
                        a.append(ids[lead[int(near[0])]])
                        b.append(ids[i])
                    else:
                        lead.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return leaves.select("group").transform(common.map_arrow, run, "a long, b long").distinct()


def _open_pairs(leaves: DataFrame) -> DataFrame:
    """``a, b``: the pairs of a leaf that are in different components and may resemble each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                ids = np.array([m["rep"] for m in group], dtype=np.int64)
                of = np.array([m["component"] for m in group], dtype=np.int64)
                sk = np.frombuffer(b"".join(m["tokens"] for m in group), dtype=np.uint32).reshape(len(ids), -1)
                i, j = np.triu_indices(len(ids), 1)
                ok = of[i] != of[j]
                i, j = i[ok], j[ok]
                ok = _alike(sk[i], sk[j])
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    return leaves.select("group").transform(common.map_arrow, run, "a long, b long").distinct()


def links_of(sets: list[np.ndarray], of: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of pairs at the threshold, as few as join all components ``of`` the sets that such pairs join."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = many[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(np.bincount(column))]) if len(column) else np.zeros(1, dtype=np.int64)
    up = {int(c): int(c) for c in of}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        both = np.zeros((hi - lo, n), dtype=np.float32)
        for c in range(0, len(ends) - 1, 1024):
            d = min(len(ends) - 1, c + 1024)
            who, what = owner[ends[c] : ends[d]], column[ends[c] : ends[d]] - c
            rows = np.unique(who)
            mine = rows[(rows >= lo) & (rows < hi)]
            if len(mine):
                part = np.zeros((len(rows), d - c), dtype=np.float32)
                part[np.searchsorted(rows, who), what] = 1
                both[np.ix_(mine - lo, rows)] += part[np.searchsorted(rows, mine)] @ part.T
        whole = both.astype(np.int64)
        near = (100 * whole >= percent * (sizes[lo:hi, None] + sizes[None, :] - whole)) & (of[lo:hi, None] != of[None, :])
        for i, j in zip(*np.nonzero(np.triu(near, lo + 1)), strict=True):
            x, y = top(int(of[lo + i])), top(int(of[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((lo + int(i), int(j)))
    return out


def _cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links on full sets between the components of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                rows = group.values
                ids, of = (np.asarray(rows.field(c)) for c in ("rep", "component"))
                pairs = links_of([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.field("values")], of, percent)
                a, b = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return cells.select("group").transform(common.map_arrow, run, "a long, b long").distinct()


#: Node ids from here on stand for further sets of an id that represents several.
STAND_IN = 1 << 62


def _nodes(reps: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``reps`` with a node id ``rep`` of its own for each set, and links between the sets of one id (None: no id has several)."""
    sets = ("s1", "s2", "n_shingles")
    ids = usable.groupBy("doc_id").agg(F.min(F.struct(*sets)).alias("lo"), F.max(F.struct(*sets)).alias("hi")).where("lo <> hi").select("doc_id")
    ids = common.save(ids, "ids")
    if ids.isEmpty():
        return reps.withColumn("rep", F.col("first")), None
    clash = reps.groupBy("first").agg(F.min(F.struct(*sets)).alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "lo")
    stand_in = F.lit(STAND_IN) + F.pmod(F.xxhash64(*sets), F.lit(STAND_IN))
    nodes = reps.join(clash.hint("merge"), "first", "left").withColumn("rep", F.when(F.col("lo").isNull() | (F.col("lo") == F.struct(*sets)), F.col("first")).otherwise(stand_in)).drop("lo")
    nodes = common.save(nodes, "nodes")
    # An id of several sets joins their nodes and, as its own row's label is asked for, itself.
    own = usable.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", *sets).distinct().join(nodes.select(*sets, "rep"), [*sets])
    return nodes, own.where("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``rep, s1, values`` of the wanted nodes ``rep, first, s1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_size(batch):
                sets = shingle_sets(common.byte_texts(part.column(2)), shingle)
                with np.errstate(over="ignore"):
                    right = [int(s.sum(dtype=np.uint64).astype(np.int64)) == w for s, w in zip(sets, part.column(1).to_pylist(), strict=True)]
                keep = [i for i, r in enumerate(right) if r]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["rep", "values"])

    rows = common.with_members(docs.select(F.col("doc_id").cast("long").alias("first"), "text").where("first is not null"), "first", wanted).join(wanted.hint("merge"), "first")
    return rows.select("rep", "s1", "text").transform(common.map_arrow, run, "rep long, values binary").dropDuplicates(["rep"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    right = sets.select(F.col("rep").alias("b"), F.col("values").alias("vb"))
    left = sets.select(F.col("rep").alias("a"), F.col("values").alias("va"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "va", "vb").transform(common.map_arrow, run, "a long, b long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``rep, component`` of every end of ``links(a, b)``: the smallest id that it reaches.

    ``labels``: components found before with some of the links.
    """
    spark = links.sparkSession
    both = common.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    now = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m")).select("rep", F.least("rep", "m").alias("component"))
    if labels is not None:
        now = now.unionByName(labels).groupBy("rep").agg(F.min("component").alias("component"))
    now = common.save(now, "labels")
    while True:
        near = both.join(now.select(F.col("rep").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("near"))
        least = now.join(near, "rep", "left").select("rep", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("c"))
        least = common.save(least, "least")
        jump = least.select(F.col("rep").alias("c"), F.col("c").alias("up"))
        # The label that a label's own document has; a component found before also pulls its former label along.
        pull = least.where("c < was").groupBy(F.col("was").alias("rep")).agg(F.min("c").alias("pull"))
        new = least.join(jump.hint("merge"), "c", "left").join(pull, "rep", "left").select("rep", F.least("c", F.coalesce("up", "c"), F.coalesce("pull", "c")).alias("component"), "was")
        new = common.save(new, "labels")
        changed = new.where("component <> was").limit(1).count()
        common.remove(spark, now, least)
        now = new.select("rep", "component")
        if not changed:
            common.remove(spark, both)
            return now


def find(docs: DataFrame, *, shingle: int = 3, percent: int = 85, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = common.columns_of(docs, "doc_id", "text")
    trees = trees_for(percent)
    facts = common.save(_facts(docs, shingle, trees), "facts")
    usable = facts.where("doc_id is not null and n_shingles > 0")
    reps, twins = _nodes(common.save(usable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first"), F.min("tokens").alias("tokens")), "reps"), usable)
    members = _leaves(reps.select("rep", "tokens", "n_shingles"), leaf, trees, block)
    members = common.save(members.join(reps.select("rep", "tokens"), "rep"), "members")
    grouped = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rep", "tokens"))).alias("group"))
    first = common.save(_leaders(grouped).where("a <> b"), "pairs")
    ends = first.select(F.col("a").alias("rep")).unionByName(first.select(F.col("b").alias("rep"))).distinct()
    sets = common.save(_sets_of(docs, reps.select("rep", "first", "s1").join(ends, "rep", "left_semi"), shingle), "sets")
    links = _confirm(first, sets, percent)
    links = common.save(links if twins is None else links.unionByName(twins), "confirmed")
    found = components(links)
    label = members.join(found, "rep", "left").select("node", "cell", "rep", "tokens", F.coalesce("component", "rep").alias("component"))
    several = label.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
    mixed = label.where("not cell").groupBy("node").agg(F.collect_list(F.struct("rep", "component", "tokens")).alias("group"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    second = common.save(_open_pairs(mixed).join(first, ["a", "b"], "left_anti"), "open")
    cells = common.save(label.where("cell").select("node", "rep", "component").join(several.hint("merge"), "node"), "cells")
    # The second round's documents whose sets the first one had no need of.
    others = common.save(second.select(F.col("a").alias("rep")).unionByName(second.select(F.col("b").alias("rep"))).unionByName(cells.select("rep")).distinct().join(ends, "rep", "left_anti"), "others")
    more_sets = common.save(_sets_of(docs, reps.select("rep", "first", "s1").join(others, "rep", "left_semi"), shingle), "sets") if not others.isEmpty() else None
    every = sets if more_sets is None else sets.unionByName(more_sets)
    more = _confirm(second, every, percent)
    if not cells.isEmpty():
        groups = cells.join(every.hint("merge"), "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "component", "values")).alias("group"))
        more = more.unionByName(_cell_links(groups, percent))
    more = common.save(more, "confirmed")
    if not more.isEmpty():
        found = components(links.unionByName(more), found)
    of = reps.select("s1", "s2", "n_shingles", "rep").join(found, "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    common.remove(spark, members, first, every, second, cells, others, more)
    out = facts.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("s1")).alias("s1"), "s2").join(of, ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def clean(docs: DataFrame, **how) -> DataFrame:
    """One document of each component of ``docs``, all columns."""
    gone = find(docs, **how).where("not kept").select(F.col("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")


def brute_force(rows: list[tuple[int | None, str | None]], shingle: int = 3, percent: int = 85) -> list[tuple[int | None, int, int | None, bool]]:
    """The same by comparing all pairs, for tests."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    up: dict = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where: dict = {}
    for k, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(k)
    pairs = {(i, j) for ks in where.values() for i in ks for j in ks if i < j}
    for i, j in pairs:
        if rows[i][0] is not None and rows[j][0] is not None:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(rows[i][0]), top(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else top(i), i is None or top(i) == i) for (i, _), s in zip(rows, sets, strict=True)]
