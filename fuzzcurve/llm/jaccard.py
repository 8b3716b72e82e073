"""Operator 2: n-gram Jaccard join through a token-group matrix.

Documents are sets of distinct ``k``-word shingles (A-Z lower-cased). Two
link when ``100 * intersection >= percent * union``; the result names the
component of each document.

1. One pass gives each document's set size, an exact fingerprint of the set,
   a few min-hashes and, for all documents together, a merged sketch of the
   tokens that decide (see 3). Documents with one set are one class; only
   their smallest id goes on.
2. Similar documents are partitioned into groups. Those that share a band of
   min-hashes are compared with the band's most central document (the one in
   the largest bands). Then those of a large band that are not yet in the
   component of most of the band are compared with ``PANEL`` members of it,
   picked by hash, so that a family whose members link only in part still
   becomes few groups. What links, exactly, is one group; a group of
   thousands costs a bounded number of comparisons a document, not one a pair.
3. The token-group matrix: a token row lists the groups whose union has the
   token. It holds, for each document, the prefix of its tokens that decides
   (``prefix_length`` tokens of a common order), by how often a sample has
   them, commonest tokens last; tokens that the sketch has once are in one
   document only and left out. The row of a token that very many documents
   have is dealt in cells: a block of its documents asks a block of its
   groups, so no task holds such a row. Linked sets of ``n`` and ``m`` tokens
   share at least ``common_tokens``; the first ``first_shared`` of these lie
   so near the start of both that few others can come before them. A query
   document's overlap with a group is bounded by the rows at such places that
   it shares with the group's union; only what can still qualify is opened,
   and only across groups, since inside one all is linked already.
4. A group is opened in chunks of ``CHUNK`` members: a query meets the whole
   chunk at once, as one row, and its exact overlap with every member comes
   from the chunk's token lists. Links and groups together give the
   components. No link is lost: 2 only saves work in 3 and 4.

Null and empty texts have no set and link with nothing; a text of fewer than
``k`` words is one shingle. Documents without an id are left out of the
links and come back as their own (null) component. Rows that share an id and
differ in text are separate documents of one component; repeated rows come
back as often. Very long texts are whole: one that is longer than a step of
work is a step of its own. An empty table gives an empty result. Only the
columns ``doc_id`` and ``text`` are looked at, so others cannot clash.
Shingles are compared by 64-bit hashes within a pair, whole sets by their size
and 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import sketch
from .common import batch, drop_tables, id_text, mapped, read, signed, steps, write_table
from .graph import components
from .text import U, mix, windows, word_hashes, words

BANDS = 8
#: Tokens are ordered by the power of two that their count in one of ``SAMPLE`` documents reaches.
SAMPLE = 16
#: From this power on (some 4096 documents) the row of a token is dealt in cells of about ``BLOCK`` documents and groups.
HOT = 8
BLOCK = 4096
#: Questions that a task makes at once.
QUESTIONS = 250_000
COMMON_BITS = 24
#: A prefix has an ``n // MORE`` tokens more than it must: longer prefixes, sharper bounds.
MORE = 40
#: Members of a group that are opened together, and queries that meet them in one task.
CHUNK, ASKERS = 64, 2048
#: Bands of so many documents have a panel, of about so many members.
LARGE, PANEL = 8, 64


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each begins."""
    w = words(data, offsets)
    h = word_hashes(data, w, lower=True)
    first, out = windows(w, h, k)
    doc = w.doc[first]
    n = np.diff(w.first)
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        whole = np.zeros(len(short), U)
        for j in range(k - 1):
            has = n[short] > j
            whole[has] = mix(whole[has] ^ h[w.first[short[has]] + j], j)
        out, doc = np.concatenate([out, whole]), np.concatenate([doc, short])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(offsets)))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(n * percent / 100) tokens can all miss a partner; at least one more decides."""
    return n + (-n * percent // 100) + np.maximum(1, n // MORE)


def common_tokens(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that two linked sets of these sizes have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


def first_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """So many of the tokens that two sets share, the first in the common order, are asked for: each lies in both prefixes."""
    return np.maximum(1, np.minimum(n, m) // MORE)


def _level_salt(level: int) -> int:
    return (level - 1) * 0x5851F42D4C957F2D % 2**63


def _common(texts: DataFrame, k: int) -> np.ndarray:
    """Bitmap of (token, level) up to the power of two that its count in the sample reaches.

    It only orders tokens and deals their rows; any content keeps the join exact.
    """

    def run(batches):
        for b in batches:
            for _, data, offsets in steps(b.column(0)):
                h, _ = shingles(data, offsets, k)
                yield batch(token=signed(h))

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    tokens = mapped(sample, run, "token long").groupBy("token").count().where("count > 1")
    tokens = tokens.select("token", F.floor(F.log2("count")).cast("int").alias("top"))
    salts = F.array(*[F.lit(_level_salt(level)) for level in range(1, 33)])
    keys = tokens.select("token", F.explode(F.slice(salts, F.lit(1), F.col("top"))).alias("salt")).select(F.col("token").bitwiseXOR(F.col("salt")).alias("key"))
    return sketch.key_bitmap(keys, "key", COMMON_BITS, hashed=True)


def levels(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The power of two that each token's count in the sample reaches; 0 if it is not repeated there."""
    out, live = np.zeros(len(h), np.int8), np.arange(len(h))
    for level in range(1, 33):
        live = live[sketch.in_bitmap(bitmap, sketch.hash_places(h[live] ^ U(_level_salt(level)), COMMON_BITS))]
        if not len(live):
            break
        out[live] = level
    return out


def _deciding(common: np.ndarray, h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each set's prefix, their set and level."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    level = levels(common, h)
    order = np.argsort(doc << 6 | level, kind="stable")
    place = np.arange(len(h)) - first[doc]
    inside = place < prefix_length(n, percent)[doc]
    order = order[inside]
    return h[order], doc[order], level[order], place[inside]


SIGNATURES = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def _signatures(texts: DataFrame, k: int, percent: int, common, bits: int) -> DataFrame:
    """SIGNATURES for each row, and the slices of a sketch of all deciding tokens (see ``sketch.merged``) in rows of their own."""

    def run(batches):
        counter = sketch.Counter(bits)
        names = ["doc_id", "n", "s1", "s2", "bands", "slice", "once", "more"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]

        def rows(own, sent):
            size = len((own or sent)[0])
            empty = lambda at: [pa.nulls(size, t) for t in kinds[at]]
            return pa.RecordBatch.from_arrays([*(own or empty(slice(0, 5))), *(sent or empty(slice(5, 8)))], names)

        for b in batches:
            for at, data, offsets in steps(b.column(1)):
                h, first = shingles(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                begin = first[full]
                if not len(full):
                    a = c = np.zeros(0, U)
                    bands = np.zeros((0, BANDS), U)
                else:
                    a, c = (np.add.reduceat(mix(h, seed), begin) for seed in (101, 102))
                    least = [np.minimum.reduceat(mix(h, j), begin) for j in range(2 * BANDS)]
                    bands = np.stack([mix(least[2 * j] ^ mix(least[2 * j + 1], j), j) for j in range(BANDS)], 1)
                out = [np.zeros(len(n), np.int64) for _ in range(2)]
                for x, got in zip(out, (a, c)):
                    x[full] = signed(got)
                of = np.zeros((len(n), BANDS), np.int64)
                of[full] = bands.view(np.int64)
                yield rows([b.column(0).slice(at, len(n)), pa.array(n.astype(np.int64)), *map(pa.array, out), pa.FixedSizeListArray.from_arrays(pa.array(of.ravel()), BANDS).cast(pa.list_(pa.int64()))], None)
                if sent := counter.add(_deciding(common.value, h, first, percent)[0]):
                    yield rows(None, sketch.slice_rows(sent))
        if sent := counter.close():
            yield rows(None, sketch.slice_rows(sent))

    return mapped(texts, run, SIGNATURES + ", slice int, once binary, more binary")


def _sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ``ids``: the whole sorted set, as packed 64-bit integers."""
    bitmap = texts.sparkSession.sparkContext.broadcast(sketch.key_bitmap(ids, "doc_id"))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(sketch.in_bitmap(bitmap.value, b.column(2).to_numpy())))
            for at, data, offsets in steps(b.column(1)):
                h, first = shingles(data, offsets, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(offsets) - 1), pa.array([h[a:z].tobytes() for a, z in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "tokens"])

    return mapped(texts.select("doc_id", "text", sketch.bitmap_places("doc_id")), run, "doc_id long, tokens binary")


class Chunk:
    """The token lists of some members of a group: from each token to the members that have it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids), np.array([len(s) for s in sets])
        tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.who = tokens[order], who[order]

    def best(self, doc: int, tokens: np.ndarray, percent: int) -> int | None:
        """The member that links closest to the set, if any does; a document doesn't link to itself."""
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        many = high - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(self.who[at], minlength=len(self.ids))
        union = len(tokens) + self.sizes - both
        ok = (100 * both >= percent * union) & (both > 0) & (self.ids != doc)
        return int(self.ids[np.argmax(np.where(ok, both / np.maximum(union, 1), -1.0))]) if ok.any() else None


def _links(sets: DataFrame, asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each question (q, grp) of ``asked`` and each chunk of the group a link of ``q`` to a member, if there is one.

    ``members`` has (grp, doc_id, size). A group of many members is dealt in
    chunks and its queries in blocks, so no task holds all of either.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = asked.groupBy("grp").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("blocks"))
    opened = write_table(members.join(blocks, "grp").select("grp", "doc_id", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"), "blocks"), "opened")
    heads = opened.groupBy("grp").agg(F.max("chunks").alias("chunks"), F.max("blocks").alias("blocks"))
    held = opened.select("grp", own("doc_id", "chunks").alias("chunk"), every("blocks").alias("block"), F.lit(0).alias("side"), "doc_id")
    queries = asked.join(heads, "grp").select("grp", every("chunks").alias("chunk"), own("q", "blocks").alias("block"), F.lit(1).alias("side"), F.col("q").alias("doc_id"))
    rows = held.unionByName(queries).join(sets, "doc_id")

    def run(batches):
        last, ids, raw, chunk = None, [], [], None
        for b in batches:
            out = []
            for grp, part, block, side, doc, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                if (grp, part, block) != last:
                    last, ids, raw, chunk = (grp, part, block), [], [], None
                tokens = np.frombuffer(tokens.as_buffer(), np.uint64)
                if side == 0:
                    ids.append(doc)
                    raw.append(tokens.copy())
                elif ids:
                    chunk = chunk or Chunk(ids, raw)
                    if (found := chunk.best(doc, tokens, percent)) is not None:
                        out.append((doc, found))
            if out:
                yield batch(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([x for _, x in out], pa.int64()))

    dealt = rows.repartition(parts, "grp", "chunk", "block").sortWithinPartitions("grp", "chunk", "block", "side").select("grp", "chunk", "block", "side", "doc_id", "tokens")
    out = write_table(mapped(dealt, run, "a long, b long"), "found")
    drop_tables(opened)
    return out


def _matrix(members: DataFrame, texts: DataFrame, k: int, percent: int, common, repeated: np.ndarray) -> DataFrame:
    """Rows (token, i, j, side, grp, size, doc_id, n, place): the deciding tokens of each document with their place in it, its group and the group's size.

    Side 2 both asks and is asked. For a token of many documents, in each
    cell (i, j) one block of them asks (side 0) and one block of groups is
    asked (side 1), so that every document meets every group once.
    """
    spark = texts.sparkSession.sparkContext
    wanted, repeated = spark.broadcast(sketch.key_bitmap(members, "doc_id", 26)), spark.broadcast(repeated)

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(sketch.in_bitmap(wanted.value, b.column(2).to_numpy())))
            for at, data, offsets in steps(b.column(1)):
                h, first = shingles(data, offsets, k)
                n = np.diff(first)
                h, doc, level, place = _deciding(common.value, h, first, percent)
                keep = sketch.estimated_repeated(repeated.value, h)
                h, doc, level, place = h[keep], doc[keep], level[keep], place[keep]
                cells = np.where(level >= HOT, -(-(SAMPLE << np.minimum(level, 40).astype(np.int64)) * 2 // BLOCK), 1)
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x)) for x in (signed(h), cells.astype(np.int32), place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n.astype(np.int32)), *lists], ["doc_id", "n", "tokens", "cells", "places"])

    own = mapped(texts.select("doc_id", "text", sketch.bitmap_places("doc_id", 26)), run, "doc_id long, n int, tokens array<long>, cells array<int>, places array<int>").where("size(tokens) > 0")
    rows = own.join(members.select("doc_id", "grp", "size"), "doc_id").select("grp", "size", "doc_id", "n", F.explode(F.arrays_zip("tokens", "cells", "places")).alias("x"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("x.cells")).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), F.col("x.cells") - 1)
    dealt = F.when(F.col("x.cells") == 1, F.array(cell(F.lit(0), F.lit(0), 2))).otherwise(F.concat(F.transform(every, lambda j: cell(block("doc_id"), j, 0)), F.transform(every, lambda i: cell(i, block("grp"), 1))))
    return rows.select(F.col("x.tokens").alias("token"), F.explode(dealt).alias("at"), "grp", "size", "doc_id", "n", F.col("x.places").alias("place")).select("token", "at.*", "grp", "size", "doc_id", "n", "place")


def _asked(matrix: DataFrame, percent: int) -> DataFrame:
    """Questions (q, grp, size): query documents and the other groups whose union they share enough rows with.

    Of two groups the smaller one asks, in every row alike (ties by id), so a
    row of many documents in few groups gives few questions, not all pairs.
    """

    def cell_questions(side, grp, size, doc, n, place):
        """Each document that asks, asks the groups (in order of size, then id) that come after its own."""
        asked = np.flatnonzero(side > 0)
        asked = asked[np.lexsort((grp[asked], size[asked]))]
        if not len(asked):
            return
        group, many = grp[asked], size[asked]
        heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (many[1:] != many[:-1])))
        low, high, near = np.minimum.reduceat(n[asked], heads), np.maximum.reduceat(n[asked], heads), np.minimum.reduceat(place[asked], heads)
        group, many = group[heads], many[heads]
        asks = np.flatnonzero(side != 1)
        grp, size, doc, n, place = grp[asks], size[asks], doc[asks], n[asks], place[asks]
        at = np.lexsort((np.append(group, grp), np.append(many, size)))
        after = np.empty(len(at), np.int64)
        after[at] = np.cumsum(at < len(group))  # groups up to each place of the common order
        mine = after[len(group) :]
        step = max(1, QUESTIONS // len(group))
        for i in range(0, len(doc), step):
            u, g = np.nonzero(np.arange(len(group))[None, :] >= mine[i : i + step, None])
            u += i
            # sizes of members that can link, and how far from the start a row may stand (one more on the group's side, for rounding)
            least, most = np.maximum(low[g], -(-percent * n[u] // 100)), np.minimum(high[g], 100 * n[u] // percent)
            extra = first_shared(n[u], most)
            ok = (least <= most) & (group[g] != grp[u])
            ok &= (place[u] < n[u] - common_tokens(n[u], least, percent) + extra) & (near[g] <= most - common_tokens(n[u], most, percent) + extra)
            u, g = u[ok], g[ok]
            if len(u):
                yield doc[u], group[g], many[g], first_shared(n[u], least[ok])

    def send(out):
        q, grp, size, need = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((need, grp, q))
        q, grp, size, need = q[order], grp[order], size[order], need[order]
        cut = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (grp[1:] != grp[:-1])))
        return batch(q=q[cut], grp=grp[cut], size=size[cut], need=need[cut], hits=np.diff(np.append(cut, len(q))))

    def cells(batches):
        """The columns side, grp, size, doc_id, n and place of one cell of one token after another."""
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(9)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            cut = np.append(np.flatnonzero(new), len(new))
            held, grp = [x[cut[-2] :] for x in cols], cols[4]
            for a, z in zip(cut[:-2], cut[1:-1]):
                if z - a > 1 and (grp[a:z] != grp[a]).any():
                    yield [x[a:z] for x in cols[3:]]
        if held is not None:
            yield held[3:]

    def scan(batches):
        out, count = [], 0
        for side, grp, size, doc, n, place in cells(batches):
            for x in cell_questions(side, grp, size, doc, n.astype(np.int64), place):
                out.append(x)
                count += len(x[0])
                if count > 500_000:
                    yield send(out)
                    out, count = [], 0
        if count:
            yield send(out)

    parts = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = matrix.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j").select("token", "i", "j", "side", "grp", "size", "doc_id", "n", "place")
    asked = mapped(rows, scan, "q long, grp long, size long, need long, hits long")
    return asked.groupBy("q", "grp").agg(F.sum("hits").alias("hits"), F.min("need").alias("need"), F.max("size").alias("size")).where("hits >= need").select("q", "grp", "size")


def _grouped(known: DataFrame, reps: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found through bands of min-hashes, and the components (id, component) that they make."""
    band = reps.select("doc_id", "n", F.posexplode("bands").alias("j", "band"))
    size = band.groupBy("j", "band").agg(F.count("*").alias("c")).where("c > 1")
    band = write_table(band.join(size, ["j", "band"]), "bands")
    sets = write_table(_sets(known, band.select("doc_id").distinct(), k), "sets")
    central = band.groupBy("doc_id").agg(F.sum("c").alias("central"))
    lead = band.join(central, "doc_id").groupBy("j", "band").agg(F.max_by(F.struct("doc_id", "n"), F.struct("central", -F.col("doc_id"))).alias("x")).select("j", "band", F.col("x.doc_id").alias("grp"), F.col("x.n").alias("m"))
    near = band.join(lead, ["j", "band"]).where(f"grp <> doc_id and 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.col("doc_id").alias("q"), "grp").distinct()
    near = write_table(near, "near")
    stars = _links(sets, near, near.select("grp", F.col("grp").alias("doc_id"), F.lit(1).alias("size")).distinct(), percent)
    drop_tables(near)
    grouped = components(stars)

    large = band.where(F.col("c") >= LARGE).join(grouped.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    large = write_table(large.select("doc_id", "c", F.xxhash64("j", "band").alias("grp"), F.coalesce("component", "doc_id").alias("component")), "large")
    parts = large.groupBy("grp", "component").agg(F.count("*").alias("m"))
    most = parts.groupBy("grp").agg(F.max_by("component", F.struct("m", -F.col("component"))).alias("most"), F.count("*").alias("p")).where("p > 1")
    most = write_table(most, "most")  # so that a join with a hot band can be split
    asked = large.join(most, "grp").where("component <> most").groupBy("doc_id").agg(F.max_by("grp", F.struct("c", "grp")).alias("grp")).select(F.col("doc_id").alias("q"), "grp")
    asked = write_table(asked, "asked")
    panel = large.where(F.pmod(F.xxhash64("doc_id", "grp"), F.col("c")) < PANEL).select("grp", "doc_id", F.lit(1).alias("size"))
    more = _links(sets, asked, panel, percent)
    links = write_table(stars.unionByName(more), "links")
    drop_tables(band, sets, large, most, asked, stars, more)
    return links, write_table(components(links), "groups")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession.sparkContext
    texts = id_text(docs)
    known = texts.where("doc_id is not null")
    common = spark.broadcast(_common(texts, k))
    bits = sketch.bits_for(sketch.text_bytes(texts) // 24)
    found = write_table(_signatures(texts, k, percent, common, bits), "signatures")
    repeated = sketch.merged(found.where("slice is not null").select("slice", "once", "more"), bits)
    rows = found.where("slice is null").select("doc_id", "n", "s1", "s2", "bands")

    # copies: only classes of several rows are joined back
    full = F.col("n") > 0
    classes = rows.where(full & F.col("doc_id").isNotNull()).groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = write_table(classes, "classes")
    rows = rows.join(classes, ["n", "s1", "s2"], "left")
    rows = write_table(rows.select("doc_id", "n", "bands", F.when(full, F.coalesce("rep", "doc_id")).alias("rep")), "rows")
    reps = write_table(rows.where("rep = doc_id").select("doc_id", "n", "bands").dropDuplicates(["doc_id"]), "reps")
    drop_tables(found, classes)
    # rows of one id are one document of several texts: they link through the id
    several = rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"), F.count("*").alias("c"))
    several = rows.join(several.where("c > 1"), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()

    links, grouped = _grouped(known, reps, k, percent)
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    placed = grouped.join(sizes, "component").select(F.col("id").alias("doc_id"), "component", "size")
    members = reps.select("doc_id", "n").join(placed, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    members = write_table(members, "members")
    asked = write_table(_asked(_matrix(members, known, k, percent, common, repeated), percent), "asked")
    ids = asked.select(F.col("q").alias("doc_id")).union(members.join(asked.select("grp").distinct(), "grp", "left_semi").select("doc_id")).distinct()
    more = _links(_sets(known, ids, k), asked, members.select("grp", "doc_id", "size"), percent)
    ends = components(links.unionByName(more).unionByName(several))
    drop_tables(reps, members, asked, links, grouped, more)
    out = rows.join(ends.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)
), nb AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, nb.b FROM r JOIN nb ON r.b = nb.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""
