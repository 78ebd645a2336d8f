"""Linking of similar things without all pairs: buckets, hubs, verification and components.

A node stands for all equal things. Nodes meet in buckets by keys drawn from their sketches. A bucket is compared with its
smallest node only, and what a sketch can't rule out is verified on the things themselves, grouped by hub in groups of
bounded size. Where a bucket still holds several components, its blocks are compared by sketches, so that no link is lost to
the choice of the smallest; the pairs that sketches can't rule out are kept as a forest and not one by one. A tree of the
forest is a family; within it all pairs of different components are tested exactly, block by block, and again only a forest
of the links leaves a task. Components are found by contraction. Each step is written to the shared folder; nothing is
collected to the driver.
"""

from __future__ import annotations

from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, narrow_batches, scratch, texts_of

#: Members of one block where a bucket or a family is compared within itself, and of one group where a hub is verified.
BLOCK, SPOKES = 512, 256
#: Rows of the broadcast filter by which texts are found, at most (8 MB).
FILTER_BUCKETS = 1 << 20


class Kind(Protocol):
    """What is linked. A sketch is a row of ``width`` numbers of ``dtype``; ``n`` is a node's size."""

    dtype: str
    width: int

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """64-bit bucket keys, a row for each sketch."""

    def ragged_keys(self, n: np.ndarray, sketches: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """In place of keys() where nodes have tokens: places of the nodes, and a key for each."""

    def possible(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether the sizes alone allow a link."""

    def likely(self, na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated similarity, and whether a link can't be ruled out."""

    def close(self, na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matrix: whether a link of each of the first with each of the second can't be ruled out."""

    def links(self, left: list[bytes], right: list[bytes], open_pair) -> list[tuple[int, int]]:
        """Exact links between payloads, as pairs of places; a pair needs no test if ``open_pair(i, j)`` is false. Once a
        link is found, ``open_pair.join(i, j)`` says so."""

    def payloads(self, texts: list[str], wanted: list[list[tuple[int, int]]]) -> list[list[bytes | None]]:
        """For each text what is verified of the things with the wanted fingerprints; None if it has no such thing."""

    def linked(self, hub: bytes, other: bytes) -> bool:
        """The exact test."""


def _matrix(kind: Kind, column) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind.dtype).reshape(-1, kind.width)


def _bucket_rows(kind: Kind, batch: pa.RecordBatch):
    sketches, nodes = _matrix(kind, batch.column("sketch").to_pylist()), batch.column("node").to_numpy(zero_copy_only=False)
    if "tokens" in batch.schema.names:
        places, keys = kind.ragged_keys(batch.column("n").to_numpy(zero_copy_only=False), sketches, batch.column("tokens").to_pylist())
        nodes = nodes[places]
    else:
        keys = kind.keys(sketches)
        nodes = np.repeat(nodes, keys.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _likely(kind: Kind, batch: pa.RecordBatch):
    a, b = (_matrix(kind, batch.column(c).to_pylist()) for c in ("sa", "sb"))
    na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
    est, ok = kind.likely(na, a, nb, b)
    ok &= kind.possible(na, nb)
    keep = pa.array(ok)
    yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est[ok].astype(float))], ["a", "b", "est"])


class Roots:
    """Union-find over the numbers below ``n``."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Unites both; whether they were apart."""
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def flat(self) -> np.ndarray:
        """The root of each."""
        up = np.array(self.up, np.int64)
        while not np.array_equal(far := up[up], up):
            up = far
        return up


class _Forest:
    """Union-find over labels; ``__call__`` asks whether two rows are still apart, ``join`` unites them."""

    def __init__(self, left, right):
        self.left, self.right, self.up = left, right, {}

    def _root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def __call__(self, i: int, j: int) -> bool:
        return self._root(self.left[i]) != self._root(self.right[j])

    def join(self, i: int, j: int) -> bool:
        a, b = self._root(self.left[i]), self._root(self.right[j])
        self.up[max(a, b)] = min(a, b)
        return a != b


def _close_pairs(kind: Kind, rows: pd.DataFrame) -> list[tuple[int, int]]:
    """A forest of the pairs of one group that lie in different components and may be linked: side 0 against side 1, or
    side 0 against itself if there is no side 1. Nodes, not components, are united, so every such pair ends in one tree."""
    side = rows["side"].to_numpy()
    left = rows[side == 0]
    right = rows[side == 1] if side.any() else left
    close = kind.close(left["n"].to_numpy(), _matrix(kind, left["sketch"]), right["n"].to_numpy(), _matrix(kind, right["sketch"]))
    close &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
    if not close.any():
        return []
    ids_a, ids_b = left["node"].tolist(), right["node"].tolist()
    forest = _Forest(ids_a, ids_b)
    return [(ids_a[i], ids_b[j]) for i, j in zip(*np.nonzero(close)) if forest.join(i, j)]


def _close_forests(kind: Kind, batches):
    """The forests of groups (key, x, y) that come one after the other; a group may go on in the next batch."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        at = pdf[["key", "x", "y"]].to_numpy()
        starts = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1)
        rest = pdf.iloc[starts[-1] :]
        found = [p for i, j in zip(starts, starts[1:]) if j - i > 1 for p in _close_pairs(kind, pdf.iloc[i:j])]
        if found:
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    if rest is not None and len(rest) > 1:
        yield pd.DataFrame(_close_pairs(kind, rest), columns=["a", "b"], dtype="int64")


def _exact_forest(kind: Kind, key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a family that unite components, as a forest."""
    pdf = pdf.drop_duplicates(["side", "node"])
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    out = []
    if len(left) and len(right):
        ids_a, ids_b = left["node"].tolist(), right["node"].tolist()
        forest = _Forest(left["comp"].tolist(), right["comp"].tolist())
        out = [(ids_a[i], ids_b[j]) for i, j in kind.links(left["payload"].tolist(), right["payload"].tolist(), forest)]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _spokes(kind: Kind, fields: list, batch: pa.RecordBatch):
    items = batch.column("items").to_pylist()
    wanted = [[(x["f1"], x["f2"]) for x in own] for own in items]
    rows = []
    for own, found in zip(items, kind.payloads(texts_of(batch), wanted)):
        for x, data in zip(own, found):
            if data is not None:
                rows += [(*g.values(), x["node"], data) for g in x["groups"]]
    columns = list(zip(*rows)) or [[] for _ in fields]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _verified(kind: Kind, key, pdf: pd.DataFrame) -> pd.DataFrame:
    hub = pdf.loc[pdf["node"] == key[0], "payload"]
    found = []
    if len(hub):
        found = [n for n, p in zip(pdf["node"], pdf["payload"]) if n != key[0] and kind.linked(hub.iloc[0], p)]
    found = list(dict.fromkeys(found))
    return pd.DataFrame({"a": pd.Series(found, dtype="int64"), "b": pd.Series([key[0]] * len(found), dtype="int64")})


_NODE = [("node", pa.int64()), ("payload", pa.binary())]


def _payloads(kind: Kind, docs: DataFrame, nodes: DataFrame, groups: DataFrame, fields: list, schema: str) -> DataFrame:
    """Rows of the groups' fields, node and payload. ``groups``: node and an array of structs of those fields."""
    items = groups.join(nodes.select("node", "doc", "f1", "f2"), "node").groupBy("doc").agg(F.collect_list(F.struct("node", "f1", "f2", "groups")).alias("items"))
    items = cut(items, "wanted")
    # only texts whose id falls into a wanted bucket are dealt out: the filter has FILTER_BUCKETS rows at most, so it is
    # broadcast whatever the data, and what it lets through beyond the wanted is left to the join
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS)).alias("_bucket")
    wanted = items.select(bucket("doc")).distinct()
    near = docs.select("doc_id", "text", bucket("doc_id")).join(F.broadcast(wanted), "_bucket", "left_semi")
    rows = near.join(items, near["doc_id"].eqNullSafe(items["doc"])).select("text", "items")
    return map_batches(rows, partial(_spokes, kind, fields + _NODE), f"{schema}, node long, payload binary")


def verify(kind: Kind, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked. Pairs are grouped by b, the hub; a hub of many is split."""
    size = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("spokes"))
    size = cut(size.select("b", F.ceil(F.col("spokes") / SPOKES).cast("int").alias("n_parts")), "hubs")
    spokes = pairs.join(size, "b").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "n_parts").cast("int").alias("part"))
    hubs = size.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    groups = spokes.unionByName(hubs).groupBy("node").agg(F.collect_list(F.struct("hub", "part")).alias("groups"))
    payloads = _payloads(kind, docs, nodes, groups, [("hub", pa.int64()), ("part", pa.int32())], "hub long, part int")
    return cut(payloads.groupBy("hub", "part").applyInPandas(partial(_verified, kind), "a long, b long"), "links")


def _families(kind: Kind, docs: DataFrame, nodes: DataFrame, families: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between components within the families (node, comp of the family), as forests. In each family the blocks of
    all nodes outside its most frequent component meet the blocks of all nodes."""
    member = families.withColumnRenamed("comp", "family").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    member = cut(member, "families")
    of_comp = member.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    size = of_comp.groupBy("family").agg(F.sum("n").alias("all"), F.max("n").alias("main_n"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    size = size.filter(F.col("all") > F.col("main_n")).select("family", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("ys"), F.ceil((F.col("all") - F.col("main_n")) / BLOCK).cast("int").alias("xs"))
    rows = member.join(cut(size, "sizes"), "family")
    here = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda side, x, y: F.struct(F.col("family"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"), F.col("comp"))
    right = F.transform(every("xs"), lambda x: group(1, x, here("ys")))
    left = F.when(F.col("comp") != F.col("main"), F.transform(every("ys"), lambda y: group(0, here("xs"), y))).otherwise(F.slice(F.transform(every("ys"), lambda y: group(0, here("xs"), y)), 1, 0))
    groups = rows.select("node", F.concat(right, left).alias("groups"))
    fields = [("family", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("comp", pa.int64())]
    payloads = _payloads(kind, docs, nodes, groups, fields, "family long, x int, y int, side int, comp long")
    return cut(payloads.groupBy("family", "x", "y").applyInPandas(partial(_exact_forest, kind), "a long, b long"), "links")


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    joined = pairs.join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _forest(kind: Kind, bands: DataFrame, buckets: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame | None:
    """A forest of the pairs that share a bucket of three or more but no component and may be linked (None: no such bucket).
    Buckets of two have been compared already."""
    labelled = bands.join(buckets.filter("members > 2").select("key", "members"), "key").join(comps, "node", "left")
    labelled = cut(labelled.withColumn("comp", F.coalesce("comp", "node")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.first("members").alias("m"))
    mixed = cut(mixed.filter("low <> high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "mixed")
    if mixed.isEmpty():
        return None
    rows = labelled.drop("members").join(mixed, "key").join(nodes.select("node", "n", "sketch"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # block x meets block y for x <= y; within x = y a block meets itself, so its rows come once
    last = F.col("blocks") - 1
    places = F.concat(F.transform(F.sequence(own, last), lambda y: F.struct(own.alias("x"), y.alias("y"), F.lit(0).alias("side"))), F.when(own > 0, F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0))), lambda x: F.struct(x.alias("x"), own.alias("y"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<x:int,y:int,side:int>>")))
    placed = rows.select("key", F.explode(places).alias("p"), "node", "n", "comp", "sketch").select("key", "p.*", "node", "n", "comp", "sketch")
    # dealt by key and sorted, many small groups share a task without a call for each
    dealt = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "node")
    found = dealt.mapInPandas(partial(_close_forests, kind), "a long, b long")
    return cut(found.distinct(), "forest")


def link(kind: Kind, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) of every node that is linked with another; comp is the smallest node of its component.

    ``docs``: doc_id and text. ``nodes``: node, n, sketch, tokens if keys are drawn from them, and by which doc (a doc_id) and fingerprint (f1, f2) the thing is
    found in a text; read more than once, so it should be a cut. The result is a cut; all others made here are deleted.
    """
    narrow_batches(nodes.sparkSession)
    with scratch(nodes.sparkSession) as keep:
        return keep(_link(kind, docs, nodes))


def _link(kind: Kind, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    bands = cut(map_batches(nodes.select("node", "sketch", *(c for c in ("n", "tokens") if "tokens" in nodes.columns)), partial(_bucket_rows, kind), "key long, node long"), "bands")
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = cut(buckets, "buckets")
    star = bands.join(buckets.select("key", "pivot"), "key").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    small = nodes.select("node", "n", "sketch")
    sized = cut(star, "star").join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")
    likely = cut(map_batches(sized, partial(_likely, kind), "a long, b long, est double"), "likely")
    tested = cut(likely.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")), "best")
    links = verify(kind, docs, nodes, tested)
    comps = components(links)

    rest = cut(apart(likely.select("a", "b").join(tested, ["a", "b"], "left_anti"), comps).select("a", "b"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verify(kind, docs, nodes, rest))
        comps = components(links)
    forest = _forest(kind, bands, buckets, nodes, comps)
    if forest is not None and not forest.isEmpty():
        links = links.unionByName(_families(kind, docs, nodes, components(forest), comps))
        comps = components(links)
    return comps


def _doubled(hooks: DataFrame) -> DataFrame:
    """Each label's hook followed once more, and whether that moved it."""
    far = hooks.toDF("to", "far")
    return hooks.join(far, "to", "left").select("label", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the ends of links (a, b): comp is the smallest node that can be reached.

    Each round hooks every label to the smallest label next to it, follows the hooks to their end by doubling, and
    contracts the links to labels; rounds grow with the logarithm of the size.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    comps, edges = cut(ends.withColumn("comp", F.col("node")), "comps"), links
    while True:
        edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return comps
        hooks = cut(edges.groupBy("a").agg(F.min("b").alias("b")).toDF("label", "to"), "hooks")
        while True:  # twice the doubling for each write: most chains end within four hooks
            hooks = cut(_doubled(_doubled(hooks).select("label", "to")), "hooks")
            done = hooks.filter("moved").isEmpty()
            hooks = hooks.select("label", "to")
            if done:
                break
        comps = cut(comps.join(hooks.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")
        edges = edges.join(hooks.toDF("a", "ta"), "a", "left").join(hooks.toDF("b", "tb"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))


def united(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components when ``links`` (a, b) are added to those that ``comps`` come from; only labels are linked again. Both are cuts."""
    ends = links.join(comps.toDF("a", "ca"), "a", "left").join(comps.toDF("b", "cb"), "b", "left")
    labels = cut(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct(), "labels")
    if labels.isEmpty():
        return comps
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(comps, "node", "left_anti")
    every = comps.unionByName(ends.withColumn("comp", F.col("node")))
    to = components(labels).toDF("comp", "to")
    return cut(every.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")
