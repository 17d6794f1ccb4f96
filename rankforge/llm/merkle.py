"""A Merkle manifest: each row a leaf, a tree of 16 for each source, and one over the sources.

Leaves are hashed where they are read and numbered inside their source by a range exchange with counts, so a source of any size is
spread over all tasks. Aligned blocks of 4096 leaves are then independent: ``Traversal`` walks one by fractal traversal (for each level
the existing subtree under the present leaf, and the desired one that comes next and grows by a leaf at each step), and hands out one
authentication path after the other. Block roots are the leaves of the tree above, which is built in the same way until
a block holds all; its paths return to their blocks as one row in front of a block's leaves.

Defined results: nulls hash as ``-``; rows of one source are in the order of id (nulls first), then leaf, so repeated rows are leaves of
their own with equal paths' parts; a source of one row has its leaf as its subroot, a table of one source its subroot as the root; an
empty table gives an empty result; other columns don't enter the leaves, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._base import stored

#: Fixed value of the format: nodes of a run.
WIDTH = 16
#: Levels of an aligned block.
BLOCK_LEVELS = 3
BLOCK = WIDTH**BLOCK_LEVELS
_SMALL_ROWS = 100_000
_PATH = "array<struct<before:string,after:string>>"


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, ``:`` and the value, or ``-`` for null."""
    each = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(each, columns)), 256)


def node_hash(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


class Growing:
    """A subtree that grows by one leaf at a time: for each level the run of nodes that isn't full yet. ``height`` 0 is a run of leaves."""

    def __init__(self, height: int):
        self.runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def add(self, leaf: bytes) -> None:
        self.runs[0].append(leaf)
        for level in range(len(self.runs) - 1):
            if len(self.runs[level]) < WIDTH:
                break
            self.runs[level + 1].append(node_hash(self.runs[level]))
            self.runs[level] = []

    def finish(self) -> list[bytes]:
        """The top run, runs that a block's end left short included."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self.runs[level + 1].append(node_hash(self.runs[level]))
        return self.runs[-1]


class Traversal:
    """Authentication paths of a block's leaves, one after the other, and its root.

    ``existing[j]`` is the run of level j that holds the present leaf's ancestor; ``desired[j]`` the next one, which takes one leaf at
    each step and so is complete when the present one ends. Memory: the block's leaves and two runs a level, with what grows in them.
    """

    def __init__(self, leaves: list[bytes], levels: int):
        self.leaves, self.levels = leaves, levels
        self.existing: list[list[bytes]] = []
        for j in range(levels):
            first = Growing(j)
            for leaf in leaves[: WIDTH ** (j + 1)]:
                first.add(leaf)
            self.existing.append(first.finish())
        self.root = node_hash(self.existing[-1]) if levels else leaves[0]

    def __iter__(self):
        """For each leaf its path: what stands before and after it in its run, level by level."""
        n, levels, existing = len(self.leaves), self.levels, self.existing
        desired = [Growing(j) for j in range(levels)]
        split = lambda run, at: (b"".join(run[:at]), b"".join(run[at + 1 :]))
        path = [split(run, 0) for run in existing]
        for i in range(n):
            yield path
            if i + 1 == n:
                return
            for j in range(levels):
                size = WIDTH ** (j + 1)
                if (ahead := i + size) < n:
                    desired[j].add(self.leaves[ahead])
                if (i + 1) % size == 0:
                    existing[j], desired[j] = desired[j].finish(), Growing(j)
            path = [split(existing[j], (i + 1) // WIDTH**j % WIDTH) if (i + 1) % WIDTH**j == 0 else path[j] for j in range(levels)]


def block_levels(n: int, block: int) -> int:
    """A block that isn't alone has all levels; one that is ends where one node is left."""
    if block:
        return BLOCK_LEVELS
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` (stored) with ``_pos``, 0.. inside each ``group`` in ``order``: numbers inside range partitions, moved on by the counts of those before."""
    spread = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order, F.monotonically_increasing_id()).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    spread = stored(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = spread.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_least")).alias("_move")), "counts")
    small = F.broadcast(counts) if counts.count() <= _SMALL_ROWS else counts
    joined = spread.join(small, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_move")).alias("_pos"))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_pos")


def _runs(frames):
    """Consecutive rows of one block as ``(rows as lists of columns)``, across batches."""
    held, key = None, None
    for batch in frames:
        data = [c.to_pylist() for c in batch.columns]
        groups, blocks = data[0], data[1]
        at = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or groups[i] != groups[at] or blocks[i] != blocks[at]:
                part = [c[at:i] for c in data]
                if held is not None and key == (groups[at], blocks[at]):
                    held = [h + p for h, p in zip(held, part)]
                else:
                    if held is not None:
                        yield held
                    held, key = part, (groups[at], blocks[at])
                at = i
    if held is not None:
        yield held


def _block_roots(nodes: DataFrame) -> DataFrame:
    """``_group, _pos`` (the block) and ``_node`` (its root)."""
    rows = nodes.select("_group", F.floor(F.col("_pos") / BLOCK).alias("_block"), "_pos", "_node")
    kind = nodes.schema["_group"].dataType

    def run(frames):
        made = []
        for group, block, _, node in _runs(frames):
            top = Growing(block_levels(len(node), block[0]))
            for leaf in node:
                top.add(leaf.encode())
            made.append((group[0], block[0], top.finish()[0].decode()))
            if len(made) >= 1024:
                yield _batch(made, kind)
                made = []
        if made:
            yield _batch(made, kind)

    def _batch(made, kind):
        group, block, node = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(group, to_arrow_type(kind)), pa.array(block, pa.int64()), pa.array(node, pa.string())], ["_group", "_pos", "_node"])

    return _by_block(rows).mapInArrow(run, f"_group {kind.simpleString()}, _pos long, _node string")


def above_blocks(nodes: DataFrame) -> DataFrame:
    """For each block of ``nodes(_group, _pos, _node)``: ``_group, _block, _above`` (the path of its root, empty where it is alone) and ``_root`` of the group, stored."""
    blocks = stored(_block_roots(nodes), "blocks")
    if blocks.where(F.col("_pos") > 0).isEmpty():
        return blocks.select("_group", F.col("_pos").alias("_block"), F.array().cast(_PATH).alias("_above"), F.col("_node").alias("_root"))
    upper = above_blocks(blocks)
    made = paths(blocks, upper)
    return stored(made.select("_group", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), "_root"), "above")


def paths(nodes: DataFrame, upper: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_group, _pos, _node, keep..., _path, _root``: each node's path through its block, then that of its block, in one exchange."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    rows = nodes.select("_group", F.floor(F.col("_pos") / BLOCK).alias("_block"), "_pos", "_node", *keep, F.lit(None).cast(_PATH).alias("_above"), F.lit(None).cast("string").alias("_root"))
    heads = upper.select("_group", "_block", F.lit(-1).cast("long").alias("_pos"), F.lit("").alias("_node"), *[F.lit(None).cast(kinds[c]).alias(c) for c in keep], "_above", "_root")
    both = _by_block(rows.unionByName(heads))
    out = [("_group", kinds["_group"]), ("_pos", "long"), ("_node", "string"), *[(c, kinds[c]) for c in keep], ("_path", _PATH), ("_root", "string")]
    types = [both.schema[n].dataType for n in ("_group", "_pos", "_node", *keep, "_above", "_root")]

    def run(frames):
        arrow = [to_arrow_type(t) for t in types]
        for group, block, pos, node, *rest in _runs(frames):
            *kept, above, root = rest
            assert pos[0] == -1 and len(node) > 1
            over = list(above[0])
            walk = iter(Traversal([x.encode() for x in node[1:]], block_levels(len(node) - 1, block[0])))
            for at in range(1, len(node), 256):
                size = min(256, len(node) - at)
                path = [[{"before": b.decode(), "after": a.decode()} for b, a in p] + over for p in islice(walk, size)]
                columns = [group[at : at + size], pos[at : at + size], node[at : at + size], *[c[at : at + size] for c in kept], path, [root[0]] * size]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], [n for n, _ in out])

    return both.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in out))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), source: str = "source", id_col: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, source, position, leaf, subroot, root, path`` of every row, and what ``extra`` makes of it.

    ``path`` has, from the leaf up to the root, what stands before and after the node in its run: with ``node = sha256(before || node ||
    after)`` at each step the root comes out.
    """
    extra = extra or {}
    carried = {f"_k{i}": c for i, c in enumerate(extra.values())}
    leaves = stored(docs.select(F.col(source).alias("_group"), F.col(id_col).alias("_id"), leaf_hash(*map(F.col, columns)).alias("_node"), *[c.alias(n) for n, c in carried.items()]), "leaves")
    nodes = stored(numbered(leaves, "_group", [F.col("_id").asc_nulls_first(), F.col("_node").asc()]), "nodes")
    within = stored(above_blocks(nodes), "within")
    tops = within.where("_block = 0").select(F.lit(0).alias("_top"), F.col("_group").alias("_source"), F.col("_root").alias("_node"))
    tops = stored(numbered(stored(tops, "subroots"), "_top", [F.col("_source").asc_nulls_first()]).withColumnRenamed("_top", "_group"), "tops")
    over = stored(paths(tops, above_blocks(tops), ("_source",)).select("_source", F.col("_path").alias("_over"), F.col("_root").alias("_top_root"), F.col("_node").alias("_subroot")), "over")
    few = F.broadcast(over) if over.count() <= _SMALL_ROWS // 10 else over
    joined = within.join(few, F.col("_group").eqNullSafe(F.col("_source")))
    ends = F.struct(F.col("_subroot").alias("subroot"), F.col("_top_root").alias("root"))
    upper = joined.select("_group", "_block", F.concat("_above", "_over").alias("_above"), F.concat(ends.subroot, ends.root).alias("_root"))
    made = paths(nodes, upper, ("_id", *carried))
    named = [F.col(n).alias(name) for n, name in zip(carried, extra)]
    roots = [F.substring("_root", 1, 64).alias("subroot"), F.substring("_root", 65, 64).alias("root")]
    return made.select(F.col("_id").alias(id_col), F.col("_group").alias(source), F.col("_pos").alias("position"), F.col("_node").alias("leaf"), *roots, F.col("_path").alias("path"), *named)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by a path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step.before, node, step.after), 256))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Paths as SHA-256, and which rows still verify after the text's A-Z of every fifth (by CRC-32 of its id) was lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    changed = F.when(hit, leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    made = manifest(docs, extra={"_tampered": changed})
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), ""), 256)
    made = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("_tampered", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
