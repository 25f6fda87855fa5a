"""Exact Jaccard join of word-shingle sets as a metric-space join.

d(x, y) = 1 - |x & y| / |x | y| is a metric.  Between unrelated documents it is close to 1 whatever the pivot, so
Voronoi cells of whole documents would replicate nearly everything.  The space is therefore cut recursively first, into
the subspaces in which a pivot does tell documents apart, and into Voronoi regions of documents after that:

1. *Recursive subspaces.*  A binary tree splits the shingles by the bits of their hash; x_v is x within node v.  A linked
   pair has d <= t on the whole, and |x \\ y| + |y \\ x| and |x | y| are sums over children, so some child again has
   d <= t, down to a node whose union has so few shingles (``small``: t * small < 1) that d <= t means x_v = y_v.  In
   such a node the pivots are the projections themselves: a document lies at distance 0 from its own, and the
   triangle-inequality window of radius t reaches no other, so it is replicated once for each of its nodes:
   all v with 1 <= |x_v| <= small whose parent has at least ceil((1 - t) * (small + 1)) shingles of x.
2. *Elimination.*  A link leaves all but |x|*t/(1-t) of x's leaves untouched.  A document with fewer shared leaves than
   that has no partner and leaves.
3. *Voronoi regions.*  Every key's members go to the region of its smallest member, the pivot (each document once per
   region, whatever the number of shared keys).  Both ends of a link share a key, so they meet in its region.
4. *In a region* documents are compared with pivots in turn; |d(x, p) - d(y, p)| <= t, and the ratio of sizes, leave few
   to compare with the next.  Documents already in one component need not be compared with each other.
5. *Large regions* (over ``region_rows``) are split: all members meet the pivot in salted chunks; those within t are
   linked to it.  Members beyond t ("far") meet every chunk whose distances from the pivot are within t of theirs, and
   members within t of the pivot need not meet each other.
6. *Components* of the links by repeated smallest-label contraction, each round written to the shared folder.

Equal sets are one class throughout, named by a 64-bit sum over their mixed shingles.

Defined results: null and empty texts have no shingles, are linked with nothing and stand alone; a text of fewer than
``k`` words is one shingle; every row has its row in the result, also where rows repeat a ``doc_id``; a component's id
is the smallest ``doc_id`` of its rows (null ids are passed over; null if it has no other)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import blocks, drop_ids, forget, id_text, looked_up, on_workers, prefilter, saved, small_batches
from costlens.llm.words import distinct_by_doc, mix, shingles_of, words_of

_U = np.uint64
#: Documents of a region that one task takes whole; larger ones are split.
REGION_ROWS = 4000
#: Leaves of a range, about, and ranges at most (a range is sorted by Spark, which spills, and read as a stream).
RANGE_ROWS, MOST_RANGES = 500_000, 20_000


def small_union(percent: int) -> int:
    """Largest union in which a pair at ``percent`` similarity or more must be equal."""
    return math.ceil(Fraction(100, 100 - percent)) - 1


def leaves(value: np.ndarray, doc: np.ndarray, small: int, parent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, first of its disjoint leaves?) of the tree nodes that the documents are replicated to.

    ``value`` distinct and sorted within ``doc``.  A key is the sum of the node's mixed shingles, so it depends on the
    projection alone.  The third array marks nodes that no other of the document's nodes contains."""
    keys, docs, tops = [], [], []
    spread = mix(value + _U(0x51ED27))
    size_before = np.full(len(value), np.iinfo(np.int64).max)
    top_before = np.zeros(len(value), bool)
    for depth in range(65):
        if not len(value):
            break
        node = value >> _U(64 - depth) if depth else np.zeros(len(value), np.uint64)
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(value)))
        was, covered = size_before[first], top_before[first]
        out = (size <= small) & ((was >= parent) | (depth == 0)) & (size != was)
        if out.any():
            total = np.add.reduceat(spread, first)[out]
            keys.append(mix(total ^ size[out].astype(np.uint64)))
            docs.append(doc[first[out]])
            tops.append(~covered[out])
        leaf = size <= small
        go = np.repeat(size >= parent, size)
        size_before = np.repeat(size, size)[go]
        top_before = np.repeat(covered | leaf, size)[go]
        value, doc, spread = value[go], doc[go], spread[go]
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.astype(bool)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(tops)


def set_names(value: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, name) of every document's set."""
    size, name = np.bincount(doc, minlength=n), np.zeros(n, np.uint64)
    if len(value):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        name[doc[first]] = mix(np.add.reduceat(mix(value + _U(0xA5A5)), first))
    return size, name.view(np.int64)


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts: (value, index of the text), sorted by text and value."""
    value, doc, _ = shingles_of(words_of(column), k)
    return distinct_by_doc(value, doc)


def _named(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for block in blocks(batches):
            size, name = set_names(*sets_of(block.column("text"), k), block.num_rows)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(size, pa.int64()), pa.array(name)], names=["doc_id", "n", "set"]
            )

    return run


def _leaf_rows(k: int, small: int, parent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            value, doc = sets_of(block.column("text"), k)
            _, name = set_names(value, doc, block.num_rows)
            key, at, top = leaves(value, doc, small, parent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(name[at]), pa.array(top)], names=["key", "set", "top"]
            )

    return run


def _met_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves (key, set, top) in order: those of keys that another set of this range holds too, once each, with the range's
    smallest set of the key as ``pivot``; all of the range's first and last key, which may go on in the next ranges.  For
    these two there is one more row, with the smallest and ``last`` set that the range has of them."""

    def rows(key, name, top, pivot, last=None) -> pa.RecordBatch:
        end = pa.nulls(len(key), pa.int64()) if last is None else pa.array(last, pa.int64())
        cols = [pa.array(key, pa.int64()), pa.array(name, pa.int64()), pa.array(top, pa.bool_()), pa.array(pivot, pa.int64()), end]
        return pa.RecordBatch.from_arrays(cols, names=["key", "set", "top", "pivot", "last"])

    key, name, top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # the row before, if any
    begins, pivot_before, first_key, first_pivot, first_last = True, 0, None, 0, 0
    for batch in batches:
        more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "set", "top")]
        key, name, top = np.concatenate([key, more[0]]), np.concatenate([name, more[1]]), np.concatenate([top, more[2]])
        if not len(key):
            continue
        if first_key is None:
            first_key, first_pivot = int(key[0]), int(name[0])
            pivot_before = first_pivot
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        key, name, top = key[new], name[new], top[new]
        start = np.concatenate([[begins], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        pivot = np.where((at == 0) & (not begins), pivot_before, name[at])
        # a key's first set counts once a second one follows; the last row waits for the next batch
        goes = np.append(start[:-1] & (~start[1:] | (key[:-1] == first_key)), False)
        goes[1:] |= ~start[1:]
        if goes.any():
            yield rows(key[goes], name[goes], top[goes], pivot[goes])
        own = np.flatnonzero(key == first_key)
        if len(own):
            first_last = int(name[own[-1]])
        begins, pivot_before = bool(start[-1]), int(pivot[-1])
        key, name, top = key[-1:], name[-1:], top[-1:]
    if first_key is None:
        return
    if begins:
        yield rows(key, name, top, [pivot_before])
    yield rows(key, [pivot_before], [False], [pivot_before], name)
    if first_key != key[0]:
        yield rows([first_key], [first_pivot], [False], [first_pivot], [first_last])


MET = "key long, set long, top boolean, pivot long, last long"


def met_leaves(leaf: DataFrame) -> DataFrame:
    """Leaves (key, set, top) whose key several sets hold, once each, with the key's smallest set as ``pivot``.

    One shuffle by ranges of (key, set), at every size and for keys of any number of sets: a key that spans ranges is
    put together from one row a range, so the frame broadcast for it has two rows a range at most."""
    ranges = min(MOST_RANGES, max(1, math.ceil(leaf.count() / RANGE_ROWS)))
    ordered = leaf.select("key", "set", "top").repartitionByRange(ranges, "key", "set").sortWithinPartitions("key", "set")
    rows = saved(ordered.mapInArrow(_met_in_order, MET), "jaccard-ranges")
    edges = rows.filter("last is not null").groupBy("key").agg(F.min("set").alias("_first"), F.max("last").alias("_last"))
    rows = rows.filter("last is null").join(F.broadcast(edges), "key", "left").filter("_first is null or _first <> _last")
    return rows.select("key", "set", "top", F.coalesce("_first", "pivot").alias("pivot"))


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            value, doc = sets_of(block.column("text"), k)
            _, name = set_names(value, doc, block.num_rows)
            cuts = np.searchsorted(doc, np.arange(block.num_rows + 1)).tolist()
            items = [value[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(items, pa.binary())], names=["set", "items"])

    return run


class Pairs:
    """Exact joins between documents held in memory: sets as one flat array."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.sets, self.percent = sets, percent

    def shared(self, items: np.ndarray, others: np.ndarray) -> np.ndarray:
        """|items & y| for y in ``others`` (their indices; no set is empty), about a million shingles at a time."""
        cuts = np.flatnonzero(np.diff(np.cumsum(self.size[others]) >> 20)) + 1
        out = []
        for part in np.split(others, cuts):
            size = self.size[part]
            total = np.cumsum(size)
            flat = self.flat[np.repeat(self.first[part] - (total - size), size) + np.arange(total[-1])]
            hit = items[np.minimum(np.searchsorted(items, flat), len(items) - 1)] == flat
            out.append(np.add.reduceat(hit.astype(np.int64), total - size))
        return np.concatenate(out)

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those whose size alone does not rule a link out."""
        low, high = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
        return others[100 * low >= self.percent * high]

    def linked(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(link?, similarity) of document i with ``others``, exactly."""
        both = self.shared(self.sets[i], others)
        union = self.size[i] + self.size[others] - both
        return 100 * both >= self.percent * union, both / union


def join_region(sets: list[np.ndarray], percent: int, active: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of one region.  Every member is a pivot in turn; triangle-inequality windows over
    the earlier pivots rule pairs out.  ``active``: pairs without an active member need no comparison; ``label``: members
    of one label are known to be connected."""
    n, t = len(sets), (100 - percent) / 100 + 1e-9
    work = Pairs(sets, percent)
    comp = np.arange(n) if label is None else label.copy()
    active = np.ones(n, bool) if active is None else active
    links: list[tuple[int, int]] = []
    known: list[np.ndarray] = []  # similarity rows of a few pivots, NaN where not computed
    order = np.concatenate([np.flatnonzero(active), np.flatnonzero(~active)])
    done = np.zeros(n, bool)
    for i in order.tolist():
        if not active[i]:
            break
        done[i] = True
        others = np.flatnonzero((comp != comp[i]) & ~(done & active))
        if not len(others):
            continue
        others = work.candidates(i, others)
        for row in known:
            if len(others) and not math.isnan(row[i]):
                gap = np.abs(row[others] - row[i])
                others = others[~(gap > t)]
        if not len(others):
            continue
        near, similar = work.linked(i, others)
        if len(known) < 16 and len(others) > 8:
            row = np.full(n, np.nan)
            row[others], row[i] = similar, 1.0
            known.append(row)
        for j in others[near].tolist():
            if comp[i] != comp[j]:
                links.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return links


def _read_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _regions(percent: int):
    """Sorted rows (region, set, items, active): joins one region after the other as their rows stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        now, ids, sets, active = None, [], [], []

        def close() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            return [(ids[i], ids[j]) for i, j in join_region(sets, percent, np.array(active))]

        for batch in batches:
            out: list[tuple[int, int]] = []
            cols = [batch.column(c).to_pylist() for c in ("region", "set", "active")]
            for region, name, act, items in zip(*cols, _read_sets(batch.column("items")), strict=True):
                if region != now:
                    out += close()
                    now, ids, sets, active = region, [], [], []
                ids.append(name)
                sets.append(items)
                active.append(act)
            if out:
                yield _links(out)
        if out := close():
            yield _links(out)

    return run


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links within regions that each fit a task: ``rows`` has region, set, items, active."""
    dealt = rows.select("region", "set", "items", "active").repartition("region").sortWithinPartitions("region", "set")
    return dealt.mapInArrow(_regions(percent), LINKS)


def _to_pivot(percent: int):
    """Rows with their region's pivot set: similarity with it, exactly, and whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims, near = [], []
            for x, p in zip(_read_sets(batch.column("items")), _read_sets(batch.column("pivot")), strict=True):
                both = len(np.intersect1d(x, p, assume_unique=True))
                union = len(x) + len(p) - both
                sims.append(both / union)
                near.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("region"), batch.column("centre"), batch.column("set"), batch.column("items"), pa.array(sims, pa.float64()), pa.array(near, pa.bool_())],
                names=["region", "centre", "set", "items", "sim", "near"],
            )

    return run


def region_links(members: DataFrame, percent: int, region_rows: int = REGION_ROWS) -> DataFrame:
    """Links within regions.  ``members``: region, set, items, one row a set and region."""
    sizes = members.groupBy("region").agg(F.count("*").alias("rows"), F.min("set").alias("centre"))
    large = saved(sizes.filter(F.col("rows") > region_rows).select("region", "centre"), "jaccard-large")
    if large.isEmpty():
        return _joined(members.withColumn("active", F.lit(True)), percent)
    rest = members.join(large, "region", "left_anti").withColumn("active", F.lit(True))
    return _joined(rest, percent).unionByName(large_links(members.join(large, "region"), percent, region_rows))


def large_links(members: DataFrame, percent: int, region_rows: int) -> DataFrame:
    """Links within regions too large for one task (point 5 above): a far chunk meets the chunks, far or near, whose
    distances from the pivot are within t of its own.  A cell holds at most two chunks."""
    pivots = members.filter("set = centre").select("region", F.col("items").alias("pivot"))
    salts = max(2, members.sparkSession.sparkContext.defaultParallelism)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(salts)).cast("int"))
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = salted.join(spread, ["region", "salt"]).select("region", "centre", "set", "items", "pivot")
    met = saved(met.mapInArrow(_to_pivot(percent), "region long, centre long, set long, items binary, sim double, near boolean"), "jaccard-met")
    star = met.filter("near and set <> centre").select(F.col("centre").alias("a"), F.col("set").alias("b"))
    t = (100 - percent) / 100 + 1e-9
    far = met.filter("not near")
    # members near the pivot matter only where some far member is within t of them
    reach = far.groupBy("region").agg((F.max("sim") + t).alias("high"))
    both = far.unionByName(met.filter("near").join(reach, "region").filter("sim <= high").drop("high"))
    per = max(1, region_rows // 2)
    # chunks are ranges of the distance; equal distances are dealt over several chunks by a hash
    ranks = both.groupBy("region", "near", F.floor(F.col("sim") * 64).alias("ring")).agg(F.count("*").alias("rows"))
    parts = both.withColumn("ring", F.floor(F.col("sim") * 64)).join(ranks, ["region", "near", "ring"])
    chunk = F.pmod(F.xxhash64("set"), F.ceil(F.col("rows") / per).cast("long"))
    parts = saved(parts.withColumn("chunk", F.concat_ws(":", "ring", chunk)).drop("rows", "ring"), "jaccard-parts")
    box = parts.groupBy("region", "near", "chunk").agg(F.min("sim").alias("low"), F.max("sim").alias("high"))
    box = saved(box, "jaccard-chunks")
    a, b = box.filter("not near").alias("a"), box.alias("b")
    meets = (
        (F.col("a.region") == F.col("b.region"))
        & (F.col("a.low") <= F.col("b.high") + t)
        & (F.col("b.low") <= F.col("a.high") + t)
        & (F.col("b.near") | (F.col("a.chunk") <= F.col("b.chunk")))
    )
    cells = a.join(b, meets).select("a.region", F.col("a.chunk").alias("ca"), "b.near", F.col("b.chunk").alias("cb"))
    cells = saved(cells.withColumn("cell", F.xxhash64("region", "ca", "near", "cb")), "jaccard-cells")
    first = cells.select("region", "cell", F.lit(False).alias("near"), F.col("ca").alias("chunk"))
    second = cells.filter("near or ca <> cb").select("region", "cell", "near", F.col("cb").alias("chunk"))
    dealt = parts.join(first.unionByName(second), ["region", "near", "chunk"])
    dealt = dealt.select(F.col("cell").alias("region"), "set", "items", (~F.col("near")).alias("active"))
    return star.unionByName(_joined(dealt, percent))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of a link: the smallest node reachable.

    Alternating stars: every larger neighbour is hung on a node's smallest one, then every smaller one; a few rounds,
    logarithmic in the longest path, each written to the shared folder."""
    ends = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, before = saved(ends.distinct(), "cc-edges"), None
    check = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    while (now := tuple(edges.agg(*check).first())) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.filter("a <> b").distinct(), "cc-large")  # a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter("m <> b").select(F.col("m").alias("a"), "b")
        edges = saved(hung.unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    tree = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return tree.unionByName(edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component")))


def candidate_regions(texts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """region, set: where the sets meet (points 1 to 3 above)."""
    small = small_union(percent)
    parent = math.ceil(Fraction(percent * (small + 1), 100))
    leaf = saved(texts.mapInArrow(_leaf_rows(k, small, parent), "key long, set long, top boolean"), "jaccard-leaves")
    met = saved(met_leaves(leaf), "jaccard-met-leaves")
    # copies write a set's leaves several times, so its own are counted by one copy's rows
    total = leaf.filter("top").groupBy("set").agg(F.count("*").alias("leaves"))
    held = met.groupBy("set").agg(F.count_if("top").alias("held"))
    # of x's disjoint leaves at most floor(n * t / (1 - t)) are touched by a linked partner's differences
    touched = F.floor(F.col("n") * (100 - percent) / F.lit(percent))
    enough = held.join(classes, "set").join(total, "set").filter(F.col("held") >= F.col("leaves") / F.col("copies") - touched)
    met = met.join(enough.select("set"), "set", "left_semi").groupBy("pivot", "set").agg(F.count("*").alias("keys"))
    met = saved(met.select(F.col("pivot").alias("region"), "set"), "jaccard-regions")
    alone = met.groupBy("region").agg(F.count("*").alias("rows")).filter("rows > 1")
    return met.join(alone.select("region"), "region", "left_semi")


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, region_rows: int = REGION_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: components of the links with
    100 * |x & y| >= percent * |x | y| between sets of ``k``-word shingles."""
    if not 50 < percent < 100:
        raise ValueError("percent must be between 51 and 99")
    spark = docs.sparkSession
    small_batches(spark)
    on_workers(spark)
    texts = id_text(docs)
    rows = saved(texts.mapInArrow(_named(k), "doc_id long, n long, set long"), "jaccard-sets")
    classes = rows.filter("n > 0").groupBy("set").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    classes = saved(classes, "jaccard-classes")
    regions = saved(candidate_regions(texts, classes, k, percent), "jaccard-wanted")
    wanted = saved(classes.join(regions, "set", "left_semi").select("doc_id"), "jaccard-texts")
    sets = prefilter(texts, wanted).mapInArrow(_set_rows(k), "set long, items binary")
    sets = saved(sets.join(regions, "set", "left_semi").groupBy("set").agg(F.min("items").alias("items")), "jaccard-items")
    members = saved(regions.join(sets, "set").select("region", "set", "items"), "jaccard-members")
    labels = components(saved(region_links(members, percent, region_rows), "jaccard-links"))
    # classes learn their component's id, then rows their class's; large components and classes are spread
    root = F.coalesce("component", "set").alias("root")
    named = classes.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "n", "doc_id", "copies", root)
    named = saved(named, "jaccard-roots")
    smallest = saved(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")), "jaccard-components")
    table = looked_up(named.select("set", "copies", "root"), smallest, "root", "classes", F.col("set"))
    table = saved(table.select("set", "copies", "component_id"), "jaccard-found")
    out = looked_up(rows.filter("n > 0"), table, "set", "copies", F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Stage form: of every component the document with the smallest id stays, with all its columns.  An id stays if any
    of its rows does; rows without id stay."""
    found = ngram_components(docs, k, percent).filter("doc_id is not null")
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    gone = found.groupBy("doc_id").agg(stays.alias("stays")).filter("stays = 0").select("doc_id")
    return drop_ids(docs, saved(gone, "jaccard-gone"))


def oracle(k: int, percent: int) -> str:
    """DuckDB SQL of ``ngram_components``: shingle sets, the link test on every pair that shares a shingle, reachability."""
    space = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END)) AS s
  FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT rep, n, unnest(s) AS shingle FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= {percent} * (na + nb - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.a = c.rep
"""
