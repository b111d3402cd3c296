"""Merkle manifest of a dataset, with a witness for every row.

Each row is a leaf. The leaves of a source in order of their ids make a tree of WIDTH-ary
runs, whose root is the source's subroot; the subroots in order of the sources make another
tree, whose root stands for the dataset.

Witnesses grow by appending. A task streams the leaves of an aligned block (WIDTH ** levels
positions) into an ``Appender``. A new leaf joins the open run of the lowest level with an
empty witness. When a run has all its members, every leaf below one of them gets the run's other members
as the next step of its witness, and the run's digest joins the open run one level higher.
What a block ends with, its root, is appended in the same way to a tree of block roots, in
another distributed pass, as often as a source needs; a source's last root is appended to the
tree of sources. On the way back a block's root hands its own witness to the leaves below.

Only ids and digests are shuffled; texts are read once and hashed where they are. A task
holds one block. A source of any size spreads over many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.llm.common import small_batches, written
from foliant.llm.ranks import ranked

WIDTH = 16
#: Levels of a block; a task holds WIDTH ** LEVELS leaves with their witnesses.
LEVELS = 3

_NODE = "tree string, pos long, n long, digest binary"
_HEAD = "upper array<binary>, subroot binary, root binary"
_LEAF = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class Appender:
    """One aligned block: appended digests, open runs, and the witness of each digest so far.

    A witness is a list with two texts a level: the digests left and right of one's own, in hex.
    ``alone`` says that the block is its whole tree, which ends as soon as one node remains.
    """

    def __init__(self, width: int, levels: int, alone: bool):
        self.width, self.levels, self.alone = width, levels, alone
        self.open: list[list[tuple[bytes, int]]] = [[] for _ in range(levels + 1)]
        self.made = [0] * (levels + 1)
        self.witnesses: list[list[bytes]] = []

    def append(self, value: bytes) -> None:
        self.witnesses.append([])
        self._join(0, value, len(self.witnesses) - 1)

    def _join(self, level: int, value: bytes, first: int) -> None:
        self.open[level].append((value, first))
        self.made[level] += 1
        if level < self.levels and len(self.open[level]) == self.width:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.open[level]
        self.open[level] = []
        texts = [value.hex().encode() for value, _ in run]
        ends = [first for _, first in run[1:]] + [len(self.witnesses)]  # lower runs are complete or empty
        for k, (_, first) in enumerate(run):
            step = (b"".join(texts[:k]), b"".join(texts[k + 1:]))
            for leaf in range(first, ends[k]):
                self.witnesses[leaf].extend(step)
        self._join(level + 1, digest(b"".join(texts)), run[0][1])

    def root(self) -> bytes:
        """Close all open runs and return the block's root."""
        for level in range(self.levels):
            if self.open[level] and not (self.alone and self.made[level] == 1):
                self._complete(level)
        return next(run[0][0] for run in self.open if run)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, levels: int) -> Iterator[tuple[tuple, Appender, list[dict]]]:
    """(tree, block), its appender and its rows, from rows sorted by tree, block and position."""
    size, at, grown, rows = width ** levels, None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["tree"], row["block"])
            if key != at:
                if rows:
                    yield at, grown, rows
                at, grown, rows = key, None, []
            if row["pos"] >= 0:
                grown = grown or Appender(width, levels, row["n"] <= size)
                grown.append(row["digest"])
            rows.append(row)
    if rows:
        yield at, grown, rows


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes and their blocks' heads (position -1), dealt by block and sorted."""
    block = F.when(F.col("pos") >= 0, F.floor(F.col("pos") / size)).otherwise(F.col("block"))
    return nodes.withColumn("block", block.cast("long")).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _climb(nodes: DataFrame, width: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of blocks of those, ... until each tree has one."""
    size = width ** levels

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), grown, rows in _blocks(batches, width, levels):
            yield pa.RecordBatch.from_pylist([{"tree": tree, "pos": block, "n": -(-rows[0]["n"] // size), "digest": grown.root()}], schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
    tables = [nodes]
    while len(tables) == 1 or tables[-1].agg(F.max("n")).head()[0] not in (None, 1):
        lower = tables[-1].select("tree", "pos", "n", "digest", F.lit(None).cast("long").alias("block"))
        tables.append(written(_in_blocks(lower, size).mapInArrow(roots, _NODE)))
    return tables


def _with_heads(nodes: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """Nodes and the heads of their blocks: a head goes before its block's nodes, so that its witness travels once."""
    return _in_blocks(nodes.withColumn("block", F.lit(None).cast("long")).unionByName(heads.withColumns({"block": F.col("pos"), "pos": F.lit(-1).cast("long")}), allowMissingColumns=True), size)


def _descend(tables: list[DataFrame], heads: DataFrame, width: int, levels: int) -> DataFrame:
    """Heads (tree, pos, upper, subroot, root) of the blocks of ``tables[0]``, from those of the trees' last roots."""
    size = width ** levels

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), grown, rows in _blocks(batches, width, levels):
            head = rows[0]
            grown.root()
            out = [{"tree": tree, "pos": row["pos"], "upper": own + head["upper"], "subroot": head["subroot"], "root": head["root"]} for row, own in zip(rows[1:], grown.witnesses, strict=True)]
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[k:k + 256], schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("upper", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])
    for nodes in reversed(tables[1:-1]):
        heads = _with_heads(nodes.select("tree", "pos", "n", "digest"), heads, size).mapInArrow(handed, f"tree string, pos long, {_HEAD}")
    return heads


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, tampered``: every row's digest, and where the id's CRC is divisible by 5 that with the text in lower case (A-Z)."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[part(F.col(f"`{c}`")) for c in ("doc_id", "source", "lang", "n_chars")], part(text)).cast("binary"), 256))

    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(text).alias("leaf"), F.when(hit, leaf(lower)).alias("tampered"))


def manifest(docs: DataFrame, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """Every row's ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; digests in hex.

    ``folded_root`` is what the row's witness makes of its leaf, or of the tampered one where
    there is one; ``verified`` says whether that is the root.

    A null source is a source of its own, the first. Null ids come first in their source and
    are never tampered with. Rows that repeat an id follow by their leaf; equal rows have
    equal leaves, each with a place and a witness of its own. Empty and null texts differ.
    A row that is alone in its source is its subroot, and a source that is alone makes the root; a
    witness may be empty. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    size = width ** levels
    rows = written(leaves(docs).withColumnsRenamed({"source": "tree", "leaf": "digest"}))
    rows = written(ranked(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]))
    sources = _climb(rows, width, levels)

    last = sources[-1].select(F.col("tree").alias("source"), F.col("digest").alias("digest"), F.lit("").alias("tree"))
    subroots = written(ranked(last, "tree", [F.col("source").asc_nulls_first()]))
    above = _climb(subroots, width, levels)
    heads = above[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<binary>").alias("upper"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    heads = _descend(above, heads, width, levels)

    def of_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grown, found in _blocks(batches, width, levels):
            head = found[0]
            grown.root()
            out = [{"tree": row["source"], "pos": 0, "upper": own + head["upper"], "subroot": row["digest"], "root": head["root"]} for row, own in zip(found[1:], grown.witnesses, strict=True)]
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[k:k + 256], of_source)

    of_source = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("upper", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])
    heads = _with_heads(subroots, heads, size).mapInArrow(of_sources, f"tree string, pos long, {_HEAD}")
    heads = _descend(sources, heads, width, levels)

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grown, found in _blocks(batches, width, levels):
            head = found[0]
            upper, root = head["upper"], head["root"]
            grown.root()
            tail, out = b"".join(upper), []
            for row, own in zip(found[1:], grown.witnesses, strict=True):
                value = row["tampered"] or row["digest"]
                for k in range(0, len(own), 2):
                    value = digest(own[k] + value.hex().encode() + own[k + 1])
                for k in range(0, len(upper), 2):
                    value = digest(upper[k] + value.hex().encode() + upper[k + 1])
                out.append((row["doc_id"], row["digest"].hex(), head["subroot"].hex(), root.hex(), digest(b"".join(own) + tail).hex(), value.hex(), value == root))
            columns = [pa.array(c) if k else pa.array(c, id_type) for k, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    id_spark = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(id_spark)
    return _with_heads(rows, heads, size).mapInArrow(proved, _LEAF.format(id=id_spark.simpleString()))
