"""Near-duplicate join: texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Texts with equal sets are one class; its text with the smallest doc_id stands for it, so a group of copies
   costs as much as one text.
2. Banded MinHash LSH proposes candidates: ``TREES`` bands ("trees"), in each of which texts with the same values
   ("prefix") share a node. A band has at most ``DEPTH`` values, as many as still find a pair at the threshold with
   probability ``RECALL`` (``prefix_length``); that follows from the threshold alone, not from the data, so no tries
   are built or shortened. Of nodes that hold the same texts one is kept.
3. Candidates are verified exactly on their whole sets. A node with many texts is divided into tiles, and every
   pair of tiles is a group of its own; pairs are compared within a group by matrix products and never written
   out: what leaves a group is a count of links and a tree of edges for each text. A pair that shares several nodes
   is counted in the first trie only.
4. The edges' connected components are the groups of near duplicates.

Words are runs of ASCII letters, digits and characters beyond ASCII, without case. A text of fewer than ``WORDS`` words has
one n-gram, all its words; a text without words resembles nothing. Rows without an id take no part: no class, no
links. Rows of one id are one document, also with different texts: they are in one class, and its links are those of
all its different texts together. Links are counted between rows, so a repeated row is a link, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.components import components
from edgelog.llm.shared import kept, mix, shingle_sets, slices, texts_of

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
TILE = 256

_U64 = np.uint64
_SEEDS = np.random.default_rng(99).integers(1, 1 << 63, (TREES * DEPTH, 2), dtype=np.uint64) | _U64(1)


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened step by step, with which a pair at the threshold meets often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _set_keys(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Two 64-bit sums for each set, as 16 bytes; equal sets have equal ones."""
    ends = np.cumsum(counts)
    out = np.zeros((len(counts), 2), _U64)
    for k, seed in enumerate((_U64(0x1234567), _U64(0x89ABCDEF))):
        total = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(hashes ^ seed), dtype=_U64)])
        out[:, k] = total[ends] - total[ends - counts]
    data = out.astype(">u8").tobytes()
    return [data[16 * i : 16 * i + 16] for i in range(len(counts))]


def _prefixes(hashes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each set (none is empty) a hash of the first ``length`` MinHash values of each trie."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), TREES), _U64)
    for tree in range(TREES):
        for k in range(length):
            a, b = _SEEDS[tree * DEPTH + k]
            out[:, tree] = mix(out[:, tree] * _U64(31) + np.minimum.reduceat((hashes ^ b) * a, starts))
    return out.view(np.int64)


SIGNED = "doc_id bigint, digest bigint, keys binary, prefixes array<bigint>"


def _sign(docs: DataFrame, words: int, length: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, counts = shingle_sets(batch.column("text"), words)
            some = counts > 0
            if not some.any():
                continue
            keys = [k for k, own in zip(_set_keys(hashes, counts), some.tolist()) if own]
            prefixes = pa.FixedSizeListArray.from_arrays(
                pa.array(_prefixes(hashes, counts[some], length).ravel()), TREES
            ).cast(pa.list_(pa.int64()))
            columns = [batch.column(c).filter(pa.array(some)) for c in ("doc_id", "digest")]
            columns += [pa.array(keys, pa.binary()), prefixes]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "keys", "prefixes"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(sign, SIGNED)


def _candidates(classes: DataFrame) -> DataFrame:
    """keys and nodes: the trie nodes (tree, prefix, texts in it) that a class shares with others, one of equal ones."""
    tries = classes.select("keys", F.posexplode("prefixes").alias("tree", "prefix"))
    nodes = tries.groupBy("tree", "prefix").agg(
        F.count("*").alias("texts"), F.sum(F.xxhash64("keys") % 1_000_000_007).alias("who"), F.bit_xor(F.xxhash64("keys")).alias("whose")
    )
    nodes = nodes.where("texts > 1").groupBy("texts", "who", "whose").agg(F.min(F.struct("tree", "prefix")).alias("node"))
    nodes = nodes.select("node.tree", "node.prefix", "texts")
    shared = tries.join(nodes, ["tree", "prefix"])
    return shared.groupBy("keys").agg(F.collect_list(F.struct("tree", "prefix", "texts")).alias("nodes"))


TILED = "node binary, side int, keys binary, copies bigint, members binary, prefixes binary"


def _tiles(texts: DataFrame, words: int) -> DataFrame:
    """Each candidate's set, once for every group of two tiles that its tile is in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "side", "keys", "copies", "members", "prefixes"]
        types = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for batch in slices(batches):
            hashes, counts = shingle_sets(batch.column("text"), words)
            found = _set_keys(hashes, counts)
            ends = np.cumsum(counts)
            columns = (batch.column(c).to_pylist() for c in ("keys", "copies", "prefixes", "nodes"))
            rows = []
            for i, (keys, copies, prefixes, nodes) in enumerate(zip(*columns)):
                if found[i] != keys:
                    continue  # another text of this id, with an equal digest
                members = hashes[ends[i] - counts[i] : ends[i]].tobytes()
                packed = np.array(prefixes, np.int64).tobytes()
                for node in nodes:
                    tiles = -(-node["texts"] // TILE)
                    own = int(mix(np.frombuffer(keys[:8], ">u8").astype(_U64))[0] % _U64(tiles))
                    for other in range(tiles):
                        pair = (node["tree"], node["prefix"], min(own, other), max(own, other))
                        rows.append((np.array(pair, np.int64).tobytes(), own, keys, copies, members, packed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts.mapInArrow(deal, TILED)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1  # what one set has alone is in no overlap
    column = np.cumsum(often) - 1
    at = np.flatnonzero(often[inverse])
    column, owner = column[inverse[at]], owner[at]
    shared, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for first in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        shared += block @ block.T
    return shared


def _compare(rows: list[tuple], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """keys, links, root of the texts of a group that have links; the links of each pair are counted in one group."""
    tree, _, tile_a, tile_b = np.frombuffer(rows[0][0], np.int64).tolist()
    unique = {r[2]: r for r in rows}
    rows = [unique[keys] for keys in sorted(unique)]
    sets = [np.frombuffer(r[4], _U64) for r in rows]
    sizes, side = np.array([len(s) for s in sets]), np.array([r[1] for r in rows])
    overlap = _overlaps(sets)
    near = overlap >= threshold * (sizes[:, None] + sizes[None, :] - overlap) - 1e-6
    np.fill_diagonal(near, False)
    if tile_a != tile_b:
        near &= side[:, None] != side[None, :]
    if not near.any():
        return []
    prefixes = np.array([np.frombuffer(r[5], np.int64) for r in rows])
    first = near.copy()
    for earlier in range(tree):
        first &= prefixes[:, None, earlier] != prefixes[None, :, earlier]
    copies = np.array([r[3] for r in rows], np.int64)
    links = first @ copies
    root = np.arange(len(rows))
    while True:  # smallest index reached, until nothing changes
        least = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return [
        (rows[i][2], int(links[i]), rows[root[i]][2]) for i in np.flatnonzero(near.any(axis=1)).tolist()
    ]


def _verify(tiles: DataFrame, threshold: float) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
            columns = zip(*found) if found else [()] * 3
            types = (pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["keys", "links", "root"])

        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    found += _compare(group, threshold)
                    group = []
                group.append(row)
            yield packed(found)
        if group:
            yield packed(_compare(group, threshold))

    tiles = tiles.repartition("node").sortWithinPartitions("node")
    return tiles.mapInArrow(verify, "keys binary, links bigint, root binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group of near duplicates), copy_of (smallest doc_id with the same set)
    and n_links (documents with a similarity of at least ``threshold``, without itself) for every row with an id."""
    docs = texts_of(docs).withColumn("digest", F.xxhash64("text"))
    signed = kept(_sign(docs, words, prefix_length(threshold)))
    classes = signed.groupBy("keys").agg(
        F.min(F.struct("doc_id", "digest")).alias("rep"),
        F.count("*").alias("copies"),
        F.first("prefixes").alias("prefixes"),  # the same in all rows of a class
    )
    classes = kept(classes.select("keys", "rep.*", "copies", "prefixes"))
    candidates = classes.join(_candidates(classes), "keys")
    texts = docs.join(candidates.hint("shuffle_hash"), ["doc_id", "digest"])
    links = kept(_verify(_tiles(texts, words), threshold))
    counted = links.groupBy("keys").agg(F.sum("links").alias("links"))

    # An id with several different texts unites their classes and has the links of all of them.
    several = signed.groupBy("doc_id").agg(F.min("keys").alias("first"), F.max("keys").alias("last")).where("first != last")
    several = kept(signed.select("doc_id", "keys").join(several.select("doc_id", "first"), "doc_id").distinct())
    edges = links.select(F.col("keys").alias("a"), F.col("root").alias("b"))
    groups = components(edges.unionByName(several.select(F.col("keys").alias("a"), F.col("first").alias("b"))))
    members = groups.select(F.col("a").alias("keys"), F.col("b").alias("root"))
    members = members.unionByName(groups.select(F.col("b").alias("keys"), F.col("b").alias("root")).distinct())
    members = members.join(classes.select("keys", "doc_id"), "keys")
    named = members.join(members.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("keys", "class_id")
    known = classes.select("keys", "doc_id", "copies").join(counted, "keys", "left").join(named, "keys", "left").select(
        "keys",
        F.col("doc_id").alias("copy_of"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    together = several.join(known.select("keys", "n_links"), "keys").groupBy("doc_id").agg(F.sum("n_links").alias("all_links"))
    found = signed.select("doc_id", "keys").join(known, "keys").join(together, "doc_id", "left")
    found = found.select("doc_id", "class_id", "copy_of", F.coalesce("all_links", "n_links").alias("n_links"))
    # Rows without words: alone, unless another row of their id has a class.
    ids = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    has_words = F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    alone = docs.where(F.col("doc_id").isNotNull() & ~has_words).select("doc_id").join(ids, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
    )
    return found.unionByName(alone)


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with all their columns, without those whose group of near duplicates has a smaller doc_id.

    Rows without an id stay; rows of one id stay or go together.
    """
    found = near_duplicates(docs, words, threshold)
    others = found.where("class_id != doc_id").select(F.col("doc_id").alias("_llm_other")).distinct()
    return docs.join(others, docs["doc_id"].cast("bigint") == others["_llm_other"], "left_anti")
