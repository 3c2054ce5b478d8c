"""Near-duplicate documents: MinHash signatures joined coordinate by coordinate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm import words as W
from fieldglass.llm.shared import components, lookup, renamed, written

#: Words of a shingle.
WIDTH = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Coordinates of a signature, and how many have to agree for a pair to be confirmed on its full sets. A pair at the
#: least similarity agrees in Binomial(64, 0.75): fewer than 31 with a probability of about 1e-5; at 0.85, 1e-11.
COORDINATES = 64
MATCHES = 31
#: Nodes of a block of a cluster, and shingles whose incidence is multiplied at once.
BLOCK, BLOCK_COLUMNS = 64, 4096
#: Sizes of sets within a class differ by less than this factor.
SIZE_STEP = 1.1

_XOR, _TIMES = W.constants(COORDINATES, 11), W.constants(COORDINATES, 12)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words has its whole sequence as one."""
    data, at = W.texts(column)
    for i, j in W.chunks(at):
        h, _, _, row = W.word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        shingles, first = W.windows(h, width, 5), row.tolist()
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield W.windows(h[a:b], b - a, 100 + b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the upper 32 bits of the least value of its permutation."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 512):
        least = np.minimum(least, (((shingles[k : k + 512, None] ^ _XOR) * _TIMES)).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits for the whole set; equal sets, and only those, are taken as equal by it."""
    sums = [int(W.mix(shingles ^ np.uint64(c)).sum()) & (2**64 - 1) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return b"".join(x.to_bytes(8, "little") for x in sums)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n, key, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for shingles in shingle_sets(batch.column(1)):
                n.append(len(shingles))
                keys.append(set_key(shingles))
                sigs.append(signature(shingles))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int32)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), sig],
                ["doc_id", "n", "key", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sig array<int>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> key, shingles, for the confirmation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>")


def matches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are near enough."""
    small = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILARITY
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.filter(small).select("a", "b").join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(shared * 100 >= (F.size("s_a") + F.size("s_b") - shared) * SIMILARITY).select("a", "b")


def _open(homed: DataFrame, total: int) -> DataFrame:
    """The posting lists (post, node, home) that have nodes of several components, with the largest of those, main."""
    per_home = homed.groupBy("post", "home").agg(F.count("*").alias("w"))
    lists = per_home.groupBy("post").agg(F.max(F.struct("w", "home")).alias("top"), F.count("*").alias("homes"),
        F.sum("w").alias("w")).filter("homes > 1")
    return lookup(homed, written(lists.select("post", F.col("top.home").alias("main"), "w"), "lists"), "post", "w", total, "inner")


def _shared_with_strangers(members: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: those of members (node, home) that can still have a link to another home, by counts of their shingles.

    A link's intersection has SIMILARITY percent of either size at least, and no more elements than of a node's shingles
    stand in other homes. So texts that differ from all others in too many shingles of their own are ruled out one by one,
    not in pairs. The same is then asked of those left for each class of the other's size, as for sizes n and m a link's
    intersection has SIMILARITY / (100 + SIMILARITY) * (n + m) elements at least.
    """
    homes = members.join(nodes.select("node", "n"), "node")
    each = sets.join(homes, "node").select("node", "n", "home", F.explode("shingles").alias("shingle"))
    ends = [F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("w")]
    shared = written(each.groupBy("shingle").agg(*ends).filter("low <> high").select("shingle", "w"), "shared_shingles")
    total = shared.agg(F.sum("w")).first()[0] or 0
    known = lookup(each, shared, "shingle", "w", total, "inner").groupBy("node", "n").agg(F.count("*").alias("known"))
    some = written(known.filter(F.col("known") * 100 >= F.col("n") * SIMILARITY).select("node"), "strangers")
    size = F.floor(F.log("n") / math.log(SIZE_STEP))
    steps = math.ceil(math.log(100 / SIMILARITY) / math.log(SIZE_STEP))
    each = sets.join(homes.join(some, "node"), "node").select("node", "n", "home", size.alias("size"), F.explode("shingles").alias("shingle"))
    # Of each shingle the classes it stands in, a hundred or so at most, with the ends of their homes.
    by_size = each.groupBy("shingle", "size").agg(*ends).groupBy("shingle")
    classes = by_size.agg(F.collect_list(F.struct("size", "low", "high")).alias("classes"), F.sum("w").alias("w"))
    several = (F.size("classes") > 1) | (F.get("classes", F.lit(0))["low"] != F.get("classes", F.lit(0))["high"])
    listed = written(classes.filter(several), "classes")
    met = lookup(each, listed, "shingle", "w", listed.agg(F.sum("w")).first()[0] or 0, "inner")
    offsets = range(-steps, steps + 1)
    elsewhere = lambda c: (c["low"] != F.col("home")) | (c["high"] != F.col("home"))
    stands = lambda r: F.exists("classes", lambda c: (c["size"] == F.col("size") + r) & elsewhere(c))
    known = met.groupBy("node", "n", "size").agg(*(F.count_if(stands(r)).alias(f"known{i}") for i, r in enumerate(offsets)))
    least = lambda r: F.greatest(F.pow(F.lit(SIZE_STEP), F.col("size") + r) - 1e-6, F.col("n") * SIMILARITY / 100)
    enough = [F.col(f"known{i}") * (100 + SIMILARITY) >= SIMILARITY * (F.col("n") + least(r)) - 1e-3 for i, r in enumerate(offsets)]
    return known.filter(reduce(lambda x, y: x | y, enough)).select("node")


def _linked_in_block(table: pa.Table) -> pa.Table:
    """Rows (cluster, low, high, node, home, block, sig, shingles) of a pair of blocks -> edges (a, b) of a star for each component that
    the links between nodes of different homes make. Pairs whose signatures collide in MATCHES coordinates are confirmed on
    their full sets; the intersections of all of these at once are products of their incidence matrix."""
    node, home, block = (table.column(c).to_numpy() for c in ("node", "home", "block"))
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), COORDINATES)
    near = np.zeros((len(node), len(node)), np.int16)
    for k in range(COORDINATES):
        near += sig[:, k, None] == sig[None, :, k]
    near = (near >= MATCHES) & (home[:, None] != home[None, :])
    if len(np.unique(block)) > 1:
        near &= block[:, None] != block[None, :]
    some = np.flatnonzero(near.any(axis=1))
    node, near = node[some], near[np.ix_(some, some)]
    column = table.column("shingles").combine_chunks().take(pa.array(some))
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(ends)
    _, number, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    order = np.cumsum(times > 1) - 1
    row, kept = np.repeat(np.arange(len(node)), sizes), times[number] > 1
    row, col = row[kept], order[number[kept]]
    shared = np.zeros((len(node), len(node)), np.float64)
    for k in range(0, int(col.max()) + 1 if len(col) else 0, BLOCK_COLUMNS):
        here = (col >= k) & (col < k + BLOCK_COLUMNS)
        part = np.zeros((len(node), BLOCK_COLUMNS), np.float32)
        part[row[here], col[here] - k] = 1
        shared += part @ part.T
    near &= 100 * shared >= SIMILARITY * (sizes[:, None] + sizes[None, :] - shared)
    least = np.arange(len(node))
    while True:
        # Each node takes the least label around it; labels settle when no link joins two.
        low = np.minimum(least, np.where(near, least[None, :], len(node)).min(axis=1, initial=len(node)))
        if (low == least).all():
            break
        least = low[low]
    found = np.flatnonzero(least != np.arange(len(node)))
    return pa.table({"a": pa.array(node[least[found]], pa.int64()), "b": pa.array(node[found], pa.int64())})


def _links_within(left: DataFrame, sets: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between components, enough of them to join what is linked.

    Lists that have nodes in common make a cluster. Its nodes are dealt to blocks of about BLOCK, those of the largest home
    to blocks of their own, which needn't be compared with each other. Each other pair of blocks is compared in one call;
    so a call's rows are bounded however large a cluster is, and no pair is a row.
    """
    heads = left.groupBy("post").agg(F.min("node").alias("a"), F.count("*").alias("w"))
    edges = lookup(left.select("post", F.col("node").alias("b")), written(heads, "heads"), "post", "w", total, "inner").select("a", "b")
    members = written(left.select("node", "home").distinct().join(components(edges), "node"), "members")
    per_home = members.groupBy("component", "home").agg(F.count("*").alias("w"))
    top = F.max(F.struct("w", "home")).alias("top")
    clusters = per_home.groupBy("component").agg(top, F.sum("w").alias("w")).select(
        "component", "w", F.col("top.home").alias("main"), F.ceil(F.col("top.w") / BLOCK).alias("mains"),
        F.ceil((F.col("w") - F.col("top.w")) / BLOCK).alias("others")
    )
    is_main = F.col("home") == F.col("main")
    dealt = lookup(members, written(clusters, "clusters"), "component", "w", total, "inner").withColumn(
        "block", F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    )
    met = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    full = dealt.filter("others > 0").join(sets, "node").join(nodes.select("node", "sig"), "node")
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    rows = spread.select(F.col("component").alias("cluster"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "node", "home", "block", "sig", "shingles")
    return rows.groupBy("cluster", "low", "high").applyInArrow(_linked_in_block, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every input row: doc_id, n_shingles, component_id, kept.

    Rows whose sets are equal are one node. A node is posted under each pair of coordinate and value of its signature;
    pairs that only one node has are dropped, and nodes with fewer than MATCHES pairs left have no partner (skip). Of
    the others only the rarest are posted: two nodes that agree in MATCHES coordinates share one of the rarest
    s - MATCHES + 1 of either's s (prefix). Collisions are counted on the signatures of the pairs that meet there, and
    pairs with MATCHES of them are confirmed on the full sets.

    No posting list is expanded into all its pairs. First each node meets only the heads of its lists, the nodes whose posts
    are most common, and of those the one it agrees with most; that joins most groups. Then lists that still have nodes of
    several components are compared in blocks, which finds whatever link is missing between components; nodes that have
    too few shingles in common with other components to be linked are ruled out before, by counts. In a block, pairs that
    collide in MATCHES coordinates are confirmed on the full sets.

    component_id is the least non-null id reachable; kept is doc_id = component_id. Rows without words are linked with
    nothing; their component_id is their own id, as with rows of a null id that are linked with no other. Repeated ids
    stay separate nodes unless their texts are linked. Other columns are ignored; an empty table gives an empty result.
    """
    rows = renamed(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    signed = written(signatures(rows), "signatures")
    total = signed.count()
    nodes = written(
        signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.count("*").alias("rows"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    value = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long") + F.lit(1 << 31)
    posted = nodes.select("node", F.posexplode("sig")).select("node", value.alias("post"))
    shared = written(posted.groupBy("post").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    n_shared = shared.agg(F.sum("df")).first()[0] or 0
    own_posts = lookup(posted, shared.withColumn("w", F.col("df")), "post", "w", n_shared,
        "inner").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "post"))).alias("posts")).filter(F.size("posts") >= MATCHES)
    common = F.aggregate("posts", F.lit(0).cast("long"), lambda total, p: total + p["df"])
    rarest = F.slice("posts", F.lit(1), F.size("posts") - (MATCHES - 1))
    prefix = written(own_posts.select("node", common.alias("common"), F.explode(rarest).alias("p")).select("node", "common", "p.post"), "prefix")
    n_posts = prefix.count()
    grouped = None
    if n_posts:
        sig = nodes.select("node", "n", "sig")
        side = lambda x: sig.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

        def counted(pairs: DataFrame) -> DataFrame:
            return (
                pairs.join(side("a"), "a").join(side("b"), "b").withColumn("agree",
                matches(F.col("sig_a"), F.col("sig_b"))).filter(F.col("agree") >= MATCHES)
                .select("a", "b", "n_a", "n_b", "agree")
            )

        met = prefix.select("node").distinct()
        wanted = nodes.join(met, "node").select("node", "key", F.col("doc_id").alias("_id"))
        texts = rows.join(wanted.select("_id").distinct(), rows["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
        sets = written(full_sets(texts).dropDuplicates(["key"]).join(wanted, "key").select("node", "shingles"), "sets", "lz4")

        heads = prefix.groupBy("post").agg(F.max(F.struct("common", "node"))["node"].alias("a"), F.count("*").alias("w")).filter("w > 1")
        stars = lookup(prefix.select("post", F.col("node").alias("b")), written(heads, "heads"), "post", "w", n_posts, "inner").filter("a <> b").select("a",
            "b").distinct()
        best = counted(stars).groupBy("b").agg(F.max(F.struct("agree", "a", "n_a", "n_b")).alias("m")).select("m.a", "b", "m.n_a", "m.n_b")
        links = written(_linked(best, sets), "links")
        homes = components(links)

        homed = written(prefix.join(homes, "node", "left").select("post", "node", F.coalesce("component", "node").alias("home")), "homed")
        open_ = written(_open(homed, n_posts), "open")
        strangers = written(_shared_with_strangers(open_.select("node", "home").distinct(), sets, nodes), "strangers")
        left = written(_open(open_.drop("main").join(strangers, "node"), n_posts), "left")
        grouped = components(links.union(_links_within(left, sets, nodes, n_posts)))
    if grouped is not None:
        placed = nodes.select("key", "node", "doc_id").join(grouped, "node")
        least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("w"))
        homes = lookup(placed, written(least, "least"), "component", "w", total, "inner").select("key", "component_id")
        nodes = nodes.join(homes, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        nodes = nodes.withColumn("component_id", F.col("doc_id"))
    classes = written(nodes.select("key", "component_id", "rows"), "classes")
    out = lookup(signed.select("doc_id", "n", "key"), classes, "key", "rows", total)
    home = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), home.alias("component_id"), F.col("doc_id").eqNullSafe(home).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose id is their component's; rows of the same id stay or go together."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("all"), F.col(id_col).cast("long").alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("all.*")
