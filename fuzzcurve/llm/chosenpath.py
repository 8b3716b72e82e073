"""Operator 13: near-duplicates by a chosen-path set similarity join.

Documents are sets of distinct ``k``-word shingles (A-Z lower-cased). Two link
when ``100 * intersection >= percent * union``; of each component the smallest
id is kept.

1. One pass reduces a document to its set's size, a fingerprint of 128 bits and
   ``COORDINATES`` minwise tokens. Documents with one set are one class; only
   their smallest id goes on.
2. A tree starts with all documents in one node. A node chooses, by its own
   hash, one of the coordinates, and with a chance of ``100 / percent - 1``
   a second one; a document goes down to the child that its minwise token at
   a chosen coordinate names. So a document has ``(100 / percent) ** depth``
   paths, and two documents at the threshold still meet in one node on
   average, however deep; less similar ones are soon apart. The first
   ``FIRST`` levels are walked at once, since a path needs only the document.
3. Nodes of one document go; nodes whose documents are known to be connected
   go. In a node of up to ``SMALL`` documents every pair is compared, exactly,
   on full sets; equal nodes of several paths and trees are compared once. In
   a larger one every document is compared with the node's lead, a few at a
   time; if that does not connect the node, it branches further, down to
   ``DEEPEST``. There, blocks of the documents outside a node's largest
   connected part are compared with all its blocks, so nothing is capped.
   Full sets are made once, of documents that share a node with another.
4. Trees are independent. ``trees_for`` tells how many give a pair that just
   links the chance ``recall`` to meet even in a deepest node. The first
   ``EARLY`` trees connect nearly everything, so that the nodes of the others
   are mostly settled before they are compared.

What links is always right, since links are confirmed on full sets; a link may
be missed with a probability of at most ``1 - recall``, far less where a node
above the deepest level is small, or where several paths of links lead from
one document to the other. Choices are hashes, so results don't vary.

Null, empty and white texts have no set and link with nothing; a text of fewer
than ``k`` words is one shingle. Documents without an id come back as their
own (null) component, kept. Rows that share an id and differ in text are
separate sets of one document; repeated rows come back as often. Very long
texts are whole. Other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import jaccard
from .common import drop_tables, id_text, mapped, read, steps, write_table
from .graph import components
from .jaccard import _sets, shingles
from .text import U, mix

COORDINATES = 128
FIRST, DEEPEST = 4, 10
EARLY = 3
#: Documents of a node that are compared with each other in one task.
SMALL = 24
#: Documents of a block of a larger one; two blocks are compared in one task.
BLOCK = 64
#: Distinct tokens that one step of a comparison holds for each document.
COLUMNS = 1 << 16
_ODD = mix(np.arange(COORDINATES, dtype=U), 60) | U(1)


def survival(percent: int, depth: int) -> float:
    """The chance that two sets at the threshold share a node of this depth in one tree."""
    agree, second = percent / 100, 100 / percent - 1
    none = 0.0
    for _ in range(depth):
        none = (1 - agree + agree * none) * (1 - agree * second + agree * second * none)
    return 1 - none


def trees_for(recall: float, percent: int, depth: int = DEEPEST) -> int:
    """So many independent trees bring the chance of a meeting to ``recall``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - survival(percent, depth)))))


def _signatures(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2, tokens): each set's size, fingerprint and minwise tokens (16 bits of each)."""

    def run(batches):
        for b in batches:
            for at, data, offsets in steps(b.column(1)):
                h, first = shingles(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                marks = [np.zeros(len(n), U) for _ in range(2)]
                tokens = np.zeros((len(n), COORDINATES), np.uint16)
                if len(full):
                    for seed, mark in enumerate(marks):
                        mark[full] = np.add.reduceat(mix(h, 111 + seed), first[full])
                    for j, odd in enumerate(_ODD):
                        tokens[full, j] = (mix(np.minimum.reduceat(h * odd, first[full]), j) >> U(48)).astype(np.uint16)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * COORDINATES), len(n), [None, pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n.astype(np.int64)), *(pa.array(m.view(np.int64)) for m in marks), raw], ["doc_id", "n", "s1", "s2", "tokens"])

    return mapped(texts, run, "doc_id long, n long, s1 long, s2 long, tokens binary")


def descend(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The children (node, row) of documents in nodes, one level down."""
    choice = mix(node, 71)
    one = (choice % U(COORDINATES)).astype(np.int64)
    two = (one + 1 + (mix(node, 72) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    branch = (choice >> U(11)).astype(np.float64) < (100 / percent - 1) * 2.0**53
    node, row, at = np.append(node, node[branch]), np.append(row, row[branch]), np.append(one, two[branch])
    return mix(node ^ mix((at.astype(U) << U(16)) | tokens[row, at].astype(U), 73)), row


def _walk(rows: DataFrame, levels: int, percent: int, trees: int | None = None) -> DataFrame:
    """(node, doc_id) ``levels`` further down, from the column ``node`` of ``rows`` (doc_id, tokens, node), or with ``tree`` from the roots of so many trees."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            tokens = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in b.column(1)), np.uint16).reshape(-1, COORDINATES)
            for tree in [None] if trees is None else range(trees):
                row = np.arange(b.num_rows)
                node = b.column(2).to_numpy().view(U) if tree is None else np.repeat(mix(np.array([tree], U), 70), len(row))
                for _ in range(levels):
                    node, row = descend(node, row, tokens, percent)
                own = [pa.array(node.view(np.int64)), ids.take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(own, ["node", "doc_id"]) if tree is None else pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(row), tree, np.int32))], ["node", "doc_id", "tree"])

    return mapped(rows, run, "node long, doc_id long" + (", tree int" if trees else ""))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of some sorted sets share, a bounded number of tokens at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    tokens, who = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    place = np.cumsum(np.append(0, tokens[1:] != tokens[:-1]))
    many = np.bincount(place)
    keep = many[place] > 1
    place, who = place[keep], who[keep]
    place = np.cumsum(np.append(0, place[1:] != place[:-1])) if len(place) else place
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, z = np.searchsorted(place, (low, low + COLUMNS))
        has = np.zeros((n, min(COLUMNS, int(place[-1]) + 1 - low)), np.float32)
        has[who[a:z], place[a:z] - low] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _compare(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the documents of each cell (cell, doc_id, part) that are not yet in one part; enough to connect all that link."""

    def links(ids, parts, sets):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        size = np.array([len(s) for s in sets])
        both = _common(sets)
        a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (both > 0))
        out = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(parts[i]), find(parts[j])
            if x != y:
                root[x] = y
                out.append((ids[i], ids[j]))
        return out

    def run(batches):
        last, ids, parts, own, out = None, [], [], [], []
        for b in batches:
            for cell, part, doc, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if cell != last:
                    if len(set(parts)) > 1:
                        out += links(ids, parts, own)
                    last, ids, parts, own = cell, [], [], []
                ids.append(doc)
                parts.append(part)
                own.append(np.frombuffer(tokens.as_buffer(), U).copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out = []
        if len(set(parts)) > 1 and (out := links(ids, parts, own)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(sets, "doc_id").select("cell", "part", "doc_id", "tokens")
    return write_table(mapped(rows.repartition(parts, "cell").sortWithinPartitions("cell", "doc_id"), run, "a long, b long"), "found")


def _shared(nodes: DataFrame) -> DataFrame:
    """``nodes`` of several documents; most have one."""
    return nodes.join(nodes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), "node")


def _open_nodes(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``nodes`` (node, doc_id) with ``part`` and the node's number of documents ``c``, where more than one part is left."""
    own = nodes.join(parts, "doc_id", "left").select("node", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    sizes = own.groupBy("node").agg(F.count("*").alias("c"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("node", "c")
    return write_table(own.join(sizes, "node"), "nodes")


def _small_cells(open_nodes: DataFrame) -> DataFrame:
    """The sets of documents of small nodes, each once."""
    leaf = open_nodes.where(F.col("c") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part"))).alias("x"))
    return leaf.select("x").distinct().select(F.xxhash64("x.doc_id", F.lit(0)).alias("cell"), F.explode("x").alias("y")).select("cell", "y.doc_id", "y.part")


def _lead_cells(large: DataFrame) -> DataFrame:
    """Every document with the lead (the least by hash) of each large node that it is in, in blocks."""
    lead = large.groupBy("node").agg(F.min_by(F.struct("doc_id", "part"), F.struct(F.xxhash64("doc_id"), "doc_id")).alias("lead"))
    asked = large.join(lead, "node").where("doc_id <> lead.doc_id").select(F.col("lead.doc_id").alias("lead"), F.col("lead.part").alias("lead_part"), "doc_id", "part").distinct()
    blocks = asked.groupBy("lead", "lead_part").agg(F.ceil(F.count("*") / (SMALL - 1)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int")
    own = asked.join(blocks.drop("lead_part"), "lead").select(F.xxhash64("lead", block, F.lit(1)).alias("cell"), "doc_id", "part")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    heads = blocks.select("lead", "lead_part", every).select(F.xxhash64("lead", "b", F.lit(1)).alias("cell"), F.col("lead").alias("doc_id"), F.col("lead_part").alias("part"))
    return own.unionByName(heads)


def _block_cells(large: DataFrame) -> DataFrame:
    """Blocks of the documents outside a node's largest part, each with every block of the node.

    Where many nodes have the same largest part, its documents and those
    outside it are gathered from all of them and compared once, if that makes
    fewer rows.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    made = lambda v, u: v * blocks(u) + u * (blocks(v) + blocks(u))
    sizes = large.groupBy("node", "part").agg(F.count("*").alias("m"))
    nodes = sizes.groupBy("node").agg(F.max_by("part", F.struct("m", -F.col("part"))).alias("most"), F.max("m").alias("v"), (F.sum("m") - F.max("m")).alias("u"))
    own = large.join(nodes, "node").withColumn("outer", F.col("part") != F.col("most"))
    people = own.select("most", "doc_id", "part", "outer").distinct()
    together = people.groupBy("most").agg(F.count_if(~F.col("outer")).alias("all_v"), F.count_if("outer").alias("all_u"))
    apart = nodes.groupBy("most").agg(F.sum(made(F.col("v"), F.col("u"))).alias("apart"))
    choice = together.join(apart, "most").select("most", "all_v", "all_u", (made(F.col("all_v"), F.col("all_u")) < F.col("apart")).alias("joint"))
    one = own.join(choice.where("not joint").select("most"), "most").select("node", "doc_id", "part", "outer", blocks(F.col("v")).alias("inner"), blocks(F.col("u")).alias("rest"))
    many = people.join(choice.where("joint"), "most").select(F.xxhash64("most", F.lit(3)).alias("node"), "doc_id", "part", "outer", blocks(F.col("all_v")).alias("inner"), blocks(F.col("all_u")).alias("rest"))
    block = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col(n)).cast("int")
    rows = one.unionByName(many).withColumn("i", F.when(F.col("outer"), F.col("inner") + block("rest")).otherwise(block("inner")))
    last = F.col("inner") + F.col("rest") - 1
    others = F.when(F.col("outer"), F.sequence(F.lit(0), last)).otherwise(F.sequence(F.col("inner"), last))
    pairs = rows.select("node", "doc_id", "part", "i", F.explode(others).alias("j"))
    return pairs.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j"), F.lit(2)).alias("cell"), "doc_id", "part")


def _parts(links: list[DataFrame]) -> DataFrame:
    """(doc_id, component) of the documents that are linked so far."""
    found = _union(links)
    ends = found.selectExpr("a AS id", "a AS component") if found.isEmpty() else components(found)
    return write_table(ends.withColumnRenamed("id", "doc_id"), "parts")


def _connect(sigs: DataFrame, nodes: DataFrame, sets: DataFrame, links: list[DataFrame], parts: DataFrame, percent: int, again: bool) -> None:
    """Find links in ``nodes`` (node, doc_id) of the first level, and below those that are large; they are added to ``links``.

    ``parts`` tells what is connected already; ``again`` has it worked out
    anew before large nodes branch.
    """
    own = _open_nodes(nodes, parts)
    large = own.where(F.col("c") > SMALL)
    cells = write_table(_small_cells(own).unionByName(_lead_cells(large)), "cells")
    links.append(_compare(cells, sets, percent))
    if not large.isEmpty():
        now = _parts(links) if again else parts
        left = _open_nodes(large.select("node", "doc_id"), now)
        deeper = write_table(_walk(left.select("node", "doc_id").join(sigs, "doc_id").select("doc_id", "tokens", "node"), DEEPEST - FIRST, percent), "deeper")
        last = _open_nodes(_shared(deeper), now)
        final = write_table(_small_cells(last).unionByName(_block_cells(last.where(F.col("c") > SMALL))), "cells")
        links.append(_compare(final, sets, percent))
        drop_tables(left, deeper, last, final, *([now] if again else []))
    drop_tables(own, cells)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, recall: float = 0.999) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    texts = id_text(docs)
    known = texts.where("doc_id is not null")
    found = write_table(_signatures(texts, k), "signatures")
    full = F.col("n") > 0
    # copies: only classes of several rows are joined back
    classes = found.where(full & F.col("doc_id").isNotNull()).groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = write_table(classes, "classes")
    rows = found.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "s1", "s2", F.when(full, F.coalesce("rep", "doc_id")).alias("rep"))
    rows = write_table(rows, "rows")
    # rows of one id are one document of several sets: they link through the id
    several = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"), F.count("*").alias("c"))
    several = rows.join(several.where("c > 1"), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    # a set of a class that another row stands for is not walked
    away = rows.where("rep <> doc_id").select("doc_id", "n", "s1", "s2")
    sigs = found.where(full & F.col("doc_id").isNotNull()).join(away, ["doc_id", "n", "s1", "s2"], "left_anti").select("doc_id", "tokens").dropDuplicates(["doc_id", "tokens"])
    sigs = write_table(sigs, "walkers")
    drop_tables(found, classes)
    links: list[DataFrame] = [write_table(several, "links")]
    trees = trees_for(recall, percent)
    nodes = write_table(_shared(_walk(sigs, FIRST, percent, trees)), "first")
    sets = write_table(_sets(known, nodes.select("doc_id").distinct(), k), "sets")
    for again, own in ((True, F.col("tree") < EARLY), (False, F.col("tree") >= EARLY)):
        parts = _parts(links)
        _connect(sigs, nodes.where(own).select("node", "doc_id"), sets, links, parts, percent, again)
        drop_tables(parts)
    drop_tables(nodes, sets)
    ends = components(_union(links))
    drop_tables(sigs, *links)
    out = rows.join(ends.withColumnRenamed("id", "rep"), "rep", "left")
    least = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"))


def op13_chosenpath(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: The same links as in operator 2, at another threshold.
ORACLE = jaccard.ORACLE.replace("100 * c >= 80 *", "100 * c >= 85 *").replace("c.m AS component_id\n", "c.m AS component_id, d.doc_id = c.m AS kept\n")
