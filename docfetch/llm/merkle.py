"""Merkle manifest of a dataset, its upper proofs exchanged in a butterfly.

A row's leaf is the hash of its columns. Leaves of a part (a language) ascend by id; every
``fanout`` consecutive nodes become one until one is left, the part's subroot; the
subroots, ordered by part, become the root in the same way.

Leaves are numbered by a range sort and the counts of its partitions, and cut into aligned
blocks of ``fanout ** levels`` leaves. A block hashes its own tree, once. Then blocks
exchange: in round r a block swaps its node with the blocks that agree with it on every
digit (base ``fanout``) of the block number but digit r. Each group has ``fanout`` members
at most; all of them hash the same parent and keep the others' nodes as their proof of that
level. So after the last round every block holds its whole upper proof, and no proof ever
travels down a tree. A subtree that is not full has blocks stand in for the missing ones.
Parts exchange their subroots alike.

A proof is the siblings of each level from the leaf up, with the place of the node among
them; ``folded_root`` is recomputed from the (perhaps tampered) leaf and that proof alone.

Defined cases: a null column is hashed as ``-``, an empty text as ``0:``; null ids come
first, rows with one id are ordered by their leaves (which of two equal rows comes first
changes nothing); the null part comes before all others and is not the empty text; a row
without an id is never tampered with; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfetch.llm.chunks import small_batches, stored
from docfetch.llm.native import lower_ascii

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGESTS = "uncompressed"      # tables of digests do not compress
PATH = "array<struct<at:int,others:array<string>>>"
RESULT = ("doc_id long, part string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hash of the columns, each with its length (``-`` for null)."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                             for c in text)), 256)


def manifest(docs: DataFrame, fanout: int = 8, levels: int = 3, columns: Sequence[str] = COLUMNS,
             id_col: str = "doc_id", part_col: str = "lang", tamper: dict[str, Column] | None = None,
             tampered: Column | None = None) -> DataFrame:
    """Per row: leaf, subroot, root, proof_sha256, and what its proof makes of its row
    after tampering: folded_root and verified. Where ``tampered`` holds, the columns named
    in ``tamper`` are replaced before the leaf is hashed again."""
    if fanout < 2 or levels < 1:
        raise ValueError("a node has two children at least and a block one level")
    small_batches(docs.sparkSession)
    leaf = leaf_of([F.col(c) for c in columns])
    again = leaf_of([(tamper or {}).get(c, F.col(c)) for c in columns])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(part_col).cast("string").alias("part"),
                                F.unhex(leaf).alias("leaf"), F.unhex(F.when(hit, again)).alias("other")), "leaves", DIGESTS)
    blocks = stored(_blocks(leaves, fanout, fanout ** levels, levels), "merkle_blocks", DIGESTS)
    nodes = _exchanged(blocks.select("part", "block", "n_blocks", "node", F.array().cast(PATH).alias("path")), fanout)

    # one row per part: the parts are ranked and exchange their subroots
    parts = nodes.where("block = 0").select("part", "node")
    ranked = parts.select(F.lit(None).cast("string").alias("part"), F.col("part").alias("name"), "node",
                          (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("block"),
                          F.count(F.lit(1)).over(Window.partitionBy()).alias("n_blocks"),
                          F.array().cast(PATH).alias("path"))
    ranked = stored(ranked, "subroots")
    tops = _exchanged(ranked.drop("name"), fanout).join(ranked.select("block", "name", F.col("node").alias("subroot")), "block")
    tops = tops.select("name", "subroot", F.col("node").alias("root"), F.col("path").alias("top"))
    paths = nodes.select(F.col("part").alias("of"), F.col("block").alias("at"), "path")
    upper = paths.join(tops, F.col("of").eqNullSafe(F.col("name"))).drop("name")
    whole = blocks.join(upper, (F.col("block") == F.col("at")) & F.col("part").eqNullSafe(F.col("of")))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _proofs(batch.slice(i, 1).to_pylist()[0], fanout, levels)

    return whole.drop("of", "at", "node").mapInArrow(prove, RESULT)


def lower_cased() -> tuple[dict[str, Column], Column]:
    """Lower-cased text (A-Z) wherever 3 divides crc32 of the decimal id."""
    return ({"text": lower_ascii(F.col("text"))},
            F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


# --- blocks ------------------------------------------------------------------------

def _blocks(leaves: DataFrame, fanout: int, size: int, levels: int) -> DataFrame:
    """A row per block of leaves: ids, leaves and tampered leaves in order, and its node."""
    order = ["part", "id", "leaf", "row"]           # the row number splits a run of equal rows
    ordered = stored(leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
                     .sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()),
                     "ordered_leaves", DIGESTS)
    ordered = ordered.withColumn("task", F.shiftright("at", 33))
    # a row per (task of the sort, part): where the task's leaves of the part begin
    runs = ordered.groupBy("task", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("task").alias("of_task"), F.col("part").alias("of_part"), "first",
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                       F.sum("n").over(Window.partitionBy("part")).alias("total"))
    placed = (ordered.join(runs, (F.col("task") == F.col("of_task")) & F.col("part").eqNullSafe(F.col("of_part")))
              .select("part", "id", "leaf", "other", (F.col("before") + F.col("at") - F.col("first")).alias("place"),
                      F.expr(f"(total + {size - 1}) div {size}").alias("n_blocks"))
              .withColumn("block", F.expr(f"place div {size}")))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        hexes = [x.hex() for x in table["leaf"].to_pylist()]
        lone = table["n_blocks"][0].as_py() == 1
        node = _levels(hexes, fanout, None if lone else levels)[-1][0]
        others = [x if x is not None else b"" for x in table["other"].to_pylist()]
        return pa.table({"part": table["part"].slice(0, 1), "block": table["block"].slice(0, 1),
                         "n_blocks": table["n_blocks"].slice(0, 1), "node": pa.array([node]),
                         "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
                         "leaves": pa.array([table["leaf"].to_pylist()], pa.list_(pa.binary())),
                         "others": pa.array([others], pa.list_(pa.binary()))})

    return placed.groupBy("part", "block").applyInArrow(
        build, "part string, block long, n_blocks long, node string, ids array<long>, leaves array<binary>, others array<binary>")


def _levels(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The nodes of each level, from the leaves up: so many levels, or up to one node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _proofs(row: dict, fanout: int, levels: int) -> pa.RecordBatch:
    hexes = [x.hex() for x in row["leaves"]]
    tree = _levels(hexes, fanout, None if row["n_blocks"] == 1 else levels)
    upper = [(step["at"], step["others"]) for step in row["path"] + row["top"]]
    shared = "".join("".join(others) for _, others in upper)
    proofs, folded = [], []
    for i, (leaf, other) in enumerate(zip(hexes, row["others"])):
        steps, at = [], i
        for level in tree[:-1]:
            run = at - at % fanout
            steps.append((at - run, level[run:at] + level[at + 1:run + fanout]))
            at //= fanout
        proofs.append(digest(["".join("".join(others) for _, others in steps), shared]))
        node = other.hex() or leaf
        for at, others in steps + upper:
            node = digest([*others[:at], node, *others[at:]])
        folded.append(node)
    n = len(hexes)
    return pa.RecordBatch.from_arrays(
        [pa.array(row["ids"], pa.int64()), *(pa.array(x, pa.string()) for x in (
            [row["part"]] * n, hexes, [row["subroot"]] * n, [row["root"]] * n, proofs, folded)),
         pa.array([x == row["root"] for x in folded])],
        names=[c.split()[0] for c in RESULT.split(", ")])


# --- the exchange ------------------------------------------------------------------

def _exchanged(nodes: DataFrame, fanout: int) -> DataFrame:
    """(part, block, n_blocks, node, path) after all rounds: the part's top node and the
    siblings of each round. ``n_blocks`` blocks of a part are numbered from 0."""
    most = nodes.agg(F.max("n_blocks")).first()[0] or 0
    span = 1
    while span < most:
        nodes = _round(nodes, fanout, span)
        span *= fanout
    return nodes


def _round(nodes: DataFrame, fanout: int, span: int) -> DataFrame:
    """Blocks whose nodes cover ``span`` blocks each swap them in groups of ``fanout``."""
    swaps = F.col("n_blocks") > span                # else the part has one node already
    tree, low = F.expr(f"block div {span}"), F.col("block") % span
    # the blocks of a tree that is not full also speak for its missing ones, in turn
    blocks = F.least(F.lit(span), F.col("n_blocks") - tree * span)
    slots = F.when(swaps & (tree % fanout != 0), F.sequence(low, F.lit(span - 1).cast("long"), blocks)).otherwise(F.array(low))
    said = (nodes.select("*", swaps.alias("swaps"), tree.alias("tree"), low.alias("low"), slots.alias("slots"))
            .select("*", F.explode("slots").alias("slot"))
            .select("part", F.when(F.col("swaps"), F.expr(f"tree div {fanout}")).otherwise(F.col("block")).alias("parent"),
                    F.when(F.col("swaps"), F.col("slot")).otherwise(-1).alias("slot"),
                    F.struct("tree", "node", (F.col("slot") == F.col("low")).alias("own"), "block", "n_blocks", "swaps",
                             "path").alias("x")))
    heard = said.groupBy("part", "parent", "slot").agg(F.array_sort(F.collect_list("x")).alias("run"))
    nodes_of = lambda run: F.transform(run, lambda x: x["node"])
    before = F.size(F.filter("run", lambda y: y["tree"] < F.col("x.tree")))
    others = F.filter("run", lambda y: y["tree"] != F.col("x.tree"))
    step = F.struct(before.cast("int").alias("at"), nodes_of(others).alias("others"))
    return (heard.select("part", "run", F.explode(F.filter("run", lambda x: x["own"])).alias("x"))
            .select("part", "x.block", "x.n_blocks",
                    F.when(F.col("x.swaps"), F.sha2(F.array_join(nodes_of(F.col("run")), ""), 256))
                    .otherwise(F.col("x.node")).alias("node"),
                    F.when(F.col("x.swaps"), F.concat("x.path", F.array(step))).otherwise(F.col("x.path")).alias("path")))
