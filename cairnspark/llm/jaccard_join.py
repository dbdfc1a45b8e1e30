"""Operator 7, n-gram Jaccard join by a blocked sparse product of documents and n-grams.

1. Document frequencies.  Blocks send their shingles' hashes by hash range and
   learn how many documents have each.  A shingle of one document can't
   contribute to a link, and a text with too many of those has none.
2. Prefixes.  With shingles in order of frequency, two texts that link share one
   among the first n - ceil(t n) + 1 of each, t being the least similarity; the
   first that they share bounds their overlap by its places in both.  The rest
   of the product need not be formed.
3. Product.  Equal sets are one node.  Blocks of bounded size hold rows of the
   incidence matrix of nodes and shingles, as sorted indices, and some columns
   of its transpose; overlap counts are accumulated over slices of the
   shingles, and after each slice pairs that can't reach the bound of their
   sizes are discarded.  Columns are, at first, one node of every shingle's list,
   mostly the same for all lists of a group; then, of lists that still hold
   separate parts, three more, others for each list.  Each has then been compared
   with its whole list.  What is left of lists that even so hold separate parts is
   multiplied out: of two nodes the smaller is a column.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange, kernel
from .shared import buckets_for, kept, whole_texts

#: Links: 100 * intersection >= LINK * union.
LINK = 85
WIDTH = 4
#: Shingles of the rows that a block of the product holds; columns that it takes at once.
BLOCK_SHINGLES, COLUMNS = 1 << 20, 128
#: Slices of the shingles, after each of which pairs are discarded.
SLICES = 4
#: Documents of a shingle for each part of its list, so that a shingle of very many is no hot key.
LIST_PART = 1024
#: Shares of the rows of one key, each of which is told by itself what the key stands for.
SHARES = 64
#: Columns of each list in the second round.
MORE = 3
_LOW = np.uint64(16)


class Shingles:
    """The distinct shingle hashes of a block's documents, each document's in order; and the block's own distinct ones."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        words = kernel.Words(data, offsets, lower=True)
        h = words.hashes()
        grams, bounds = kernel.gram_hashes(h, words.first, width)
        counts = words.counts
        doc = np.repeat(np.arange(len(counts)), np.diff(bounds))
        for k in range(1, width):  # a text of fewer words is one shingle
            short = np.flatnonzero(counts == k)
            if len(short):
                x = np.full(len(short), k, np.uint64)
                for j in range(k):
                    x = kernel.mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + h[words.first[short] + j])
                grams, doc = np.concatenate([grams, x]), np.concatenate([doc, short])
        order = np.lexsort([grams, doc])
        grams, doc = grams[order], doc[order]
        new = kernel.first_of_equal(grams) | kernel.first_of_equal(doc)
        self.hash, self.doc = grams[new], doc[new]
        self.bounds = np.searchsorted(self.doc, np.arange(len(counts) + 1))
        # Frequencies and overlaps go by 48 bits, whose sets are sent and compared.
        self.low = self.hash >> _LOW
        order = np.argsort(self.low)
        new = kernel.first_of_equal(self.low[order])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.distinct = self.low[order][new]
        self.times = np.diff(np.append(at, len(order)))
        self.mark = kernel.mark_of(self.distinct)


def _frequencies(rows: DataFrame, buckets: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, block, payload) of answers: places of shingles that several documents have, and in how many; and the blocks' texts."""
    edges = np.array([(k << 48) // buckets for k in range(1, buckets)], np.uint64)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, data, offsets in exchange._blocks(batches, exchange.BLOCK_BYTES):
            s = Shingles(data, offsets, width)
            cut = np.concatenate([[0], np.searchsorted(s.distinct, edges), [len(s.distinct)]])
            full = np.flatnonzero(np.diff(cut))
            payload = [exchange.pack(kernel.put_sorted(s.distinct[cut[k] : cut[k + 1]]), kernel.put_varints(s.times[cut[k] : cut[k + 1]]), s.mark) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number)), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [exchange.unpack(b) for b in table["payload"].to_pylist()]
        h = [kernel.get_sorted(p[0]) for p in parts]
        cut = np.cumsum([0, *(len(x) for x in h)])
        h = np.concatenate(h)
        times = np.concatenate([kernel.get_varints(p[1]) for p in parts])
        order = np.argsort(h)
        new = kernel.first_of_equal(h[order])
        total = np.empty(len(h), np.int64)
        total[order] = np.add.reduceat(times[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        payload = []
        for i, j, (_, _, mark) in zip(cut[:-1], cut[1:], parts, strict=True):
            several = np.flatnonzero(total[i:j] > 1)
            payload.append(mark + struct.pack("<q", int(j - i)) + exchange.pack(kernel.put_varints(np.diff(several, prepend=0)), kernel.put_varints(total[i:j][several])))
        return pa.table({"bucket": pa.array(np.full(len(parts), key[0].as_py(), np.int32)), "block": table["block"], "payload": pa.array(payload, pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, data, offsets in exchange._blocks(batches, exchange.BLOCK_BYTES):
            payload = exchange.pack(data.tobytes(), np.diff(offsets).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), kernel.binary([payload])], ["bucket", "block", "ids", "payload"])

    answered = rows.mapInArrow(hashes, "bucket int, block long, payload binary").groupBy("bucket").applyInArrow(count, "bucket int, block long, payload binary")
    return answered, rows.mapInArrow(texts, "bucket int, block long, ids array<long>, payload binary")


def _sets(rows: DataFrame, buckets: int, width: int, link: int) -> DataFrame:
    """(id, n, node, prefix, shared): every document, and for those that may link, their node and shingles.

    ``node`` stands for the set; ``prefix``: the shingles of the prefix that
    others have too, with their documents and their places in the whole order;
    ``shared``: all such shingles, packed.
    """
    entry = pa.list_(pa.struct([("shingle", pa.int64()), ("df", pa.int64()), ("place", pa.int32())]))

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        blobs = table["payload"].to_pylist()
        text, size = exchange.unpack(blobs[order[0]])
        s = Shingles(np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(size, "<i8"))]), width)
        times, at = np.ones(len(s.distinct), np.int64), 0
        for k in order[1:]:
            (n,) = struct.unpack_from("<q", blobs[k], 8)
            if blobs[k][:8] != s.mark:
                raise RuntimeError("a block's shingles differ between two readings of the input; checkpoint the input first")
            places, found = exchange.unpack(blobs[k][16:])
            times[at + np.cumsum(kernel.get_varints(places))] = kernel.get_varints(found)
            at += n
        if at != len(s.distinct):
            raise RuntimeError("answers to a block's shingles are missing")
        frequency = times[s.group]
        n = np.diff(s.bounds)
        several = np.concatenate([[0], np.cumsum(frequency > 1)])
        held = several[s.bounds[1:]] - several[s.bounds[:-1]]
        need = -(-link * n // 100)
        first = n - need + 1 - (n - held)  # of the prefix, those that several documents have
        node, prefix, shared = [], [], []
        for d in range(len(n)):
            if not n[d] or held[d] < need[d]:
                node.append(None), prefix.append(None), shared.append(None)
                continue
            i, j = s.bounds[d], s.bounds[d + 1]
            f, low = frequency[i:j], s.low[i:j]
            both = np.flatnonzero(f > 1)
            rare = both[np.lexsort([low[both], f[both]])[: first[d]]]
            whole = kernel.mix(s.hash[i:j])
            node.append(int((np.add.reduce(whole) ^ kernel.mix(np.array([n[d]], np.uint64))[0]).astype(np.int64)))
            alone = int(n[d] - held[d])  # shingles of no other document come first in the order
            prefix.append([{"shingle": int(x), "df": int(y), "place": alone + k + 1} for k, (x, y) in enumerate(zip(low[rare], f[rare], strict=True))])
            shared.append(kernel.put_sorted(np.sort(low[both])))
        ids = table["ids"][int(order[0])].values
        return pa.table({"id": ids, "n": n.astype(np.int64), "node": pa.array(node, pa.int64()), "prefix": pa.array(prefix, entry), "shared": pa.array(shared, pa.binary())})

    answered, stored = _frequencies(rows, buckets, width)
    return stored.unionByName(answered, allowMissingColumns=True).groupBy("block").applyInArrow(finish, "id long, n long, node long, prefix array<struct<shingle: long, df: long, place: int>>, shared binary")


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides may be as large as the corpus, and which is planned as such: the driver holds none of it."""
    return left.join(right.hint("merge"), on, how)


def _told(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with what a table, of one row a key, says of their key, or null.

    A key of very many rows is no hot key: rows are shared out by ``by``, and the
    table answers once to each share that there is.
    """
    held = rows.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SHARES)).cast("int"))
    answers = _join(held.select(key, "share").distinct(), table, key)
    return _join(held, answers, [key, "share"], "left").drop("share")


def _up(parents: DataFrame, id_name: str) -> DataFrame:
    return parents.select(F.col("id").alias(id_name), F.col("root").alias("top"))


def _parents(edges: DataFrame) -> DataFrame:
    """(id, root): each larger end's smallest neighbour, or that one's."""
    parent = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    return _join(parent, _up(parent, "root"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all ids that aren't the root of their part; edges are pairs (a, b).

    Each id takes its smallest neighbour as parent, parents are followed once,
    and the edges between what is then left are treated alike until none is.
    One table is written per round; rounds grow with the logarithm of a part whose
    ids are in random order, as hashes are; a path in order of its ids loses two a round.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return kept(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())

    levels = [ordered(edges)]
    while not levels[-1].isEmpty():
        left, parents = levels[-1], _parents(levels[-1])
        for end in ("a", "b"):
            left = _join(left, _up(parents, end), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        levels.append(ordered(left))
    total = kept(_parents(levels.pop()))
    for level in reversed(levels):
        parents = _parents(level)
        # An id that hung below another may have been a root again in a later round; it is named once.
        later = total.join(parents.select("id").hint("merge"), "id", "left_anti")
        total = kept(_join(parents, _up(total, "root"), "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(later))
    return total


def _fits(n: str, m: str, place: str, other: str, link: int) -> Column:
    """The sizes allow a link, and so do the places in both orders of the first shingle that both have."""
    least = F.ceil((F.col(n) + F.col(m)) * link / (100 + link))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * link) & (F.least(F.col(n) - F.col(place), F.col(m) - F.col(other)) + 1 >= least)


class Rows:
    """Rows of the incidence matrix in order: the shingles of each as ascending numbers, and where the slices of each begin."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.hash = np.concatenate([*sets, np.zeros(0, np.uint64)])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        # Hashes are uniform, so slices of their space are slices of any set.
        at = (self.hash >> np.uint64(46)).astype(np.int64) * SLICES >> 2
        doc = np.repeat(np.arange(len(sets)), self.size)
        self.cut = np.searchsorted(doc * SLICES + at, np.arange(len(sets) * SLICES + 1))

    def numbered(self, distinct: np.ndarray) -> np.ndarray:
        """Each shingle's place among distinct ones, or the number of those where it is none of them."""
        at = np.searchsorted(distinct, self.hash)
        return np.where(np.append(distinct, np.uint64(0))[at] == self.hash, at, len(distinct))


def product(rows: Rows, n_rows: np.ndarray, columns: Rows, n_columns: np.ndarray, wanted: Callable[[int], np.ndarray], link: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each column the rows that link with it, among those that ``wanted`` names.

    A column is spread over the block's distinct shingles; its products with all
    wanted rows are sums of that over the rows' indices, slice by slice.
    """
    distinct = np.unique(columns.hash)
    index = rows.numbered(distinct)
    at = columns.numbered(distinct)
    flag = np.zeros(len(distinct) + 1, np.int8)
    for c in range(len(columns.size)):
        left = wanted(c)
        low, high = np.minimum(n_rows[left], n_columns[c]), np.maximum(n_rows[left], n_columns[c])
        left = left[100 * low >= link * high]
        if not len(left):
            continue
        own = at[columns.first[c] : columns.first[c + 1]]
        flag[own] = 1
        need = -(-link * (n_rows[left] + n_columns[c]) // (100 + link))
        overlap = np.zeros(len(left), np.int64)
        for k in range(SLICES):
            i, j = rows.cut[left * SLICES + k], rows.cut[left * SLICES + k + 1]
            size = j - i
            bounds = np.concatenate([[0], np.cumsum(size)])
            hit = np.concatenate([[0], np.cumsum(flag[index[np.repeat(i - bounds[:-1], size) + np.arange(bounds[-1])]], dtype=np.int64)])
            overlap += hit[bounds[1:]] - hit[bounds[:-1]]
            rest = np.minimum(rows.first[left + 1] - j, columns.first[c + 1] - columns.cut[c * SLICES + k + 1])
            on = overlap + rest >= need
            left, need, overlap = left[on], need[on], overlap[on]
            if not len(left):
                break
        flag[own] = 0
        if len(left):
            yield c, left


def _linked_pairs(found: Iterator[tuple[int, np.ndarray]], rows: np.ndarray, columns: np.ndarray) -> pa.Table:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c, r in found:
        a.append(rows[r])
        b.append(np.full(len(r), columns[c]))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _sets_of(table: pa.Table) -> Rows:
    return Rows([kernel.get_sorted(b) for b in table["shared"].to_pylist()])


def _against_pivots(pairs: DataFrame, nodes: DataFrame, link: int) -> DataFrame:
    """The pairs (node, n, pivot, df) that link, as (a, b): a block is rows of a bounded number of shingles and their columns, the pivots."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_SHINGLES))
    # A pivot of very many rows is a column of several parts; pivots of few rows share a block.
    parts = F.ceil(F.col("df") * F.col("n") / BLOCK_SHINGLES).cast("int")
    held = pairs.select(F.pmod(F.xxhash64("pivot"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "pivot")
    rows = _join(held.groupBy("block", "part", "node").agg(F.collect_list("pivot").alias("pivots")), nodes.select("node", "n", "shared"), "node")
    columns = _join(held.select("block", "part", F.col("pivot").alias("node")).distinct(), nodes.select("node", "n", "shared"), "node")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = table["pivots"].combine_chunks()
        is_row = asked.is_valid().to_numpy(zero_copy_only=False)
        rows, columns = table.filter(pa.array(is_row)), table.filter(pa.array(~is_row))
        if not rows.num_rows or not columns.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        lists = rows["pivots"].combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        column = lists.flatten().to_numpy()
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        names = columns["node"].to_numpy()
        i, j = np.searchsorted(column, names, "left"), np.searchsorted(column, names, "right")
        found = product(_sets_of(rows), rows["n"].to_numpy(), _sets_of(columns), columns["n"].to_numpy(), lambda c: row[i[c] : j[c]], link)
        return _linked_pairs(found, rows["node"].to_numpy(), names)

    both = rows.unionByName(columns, allowMissingColumns=True)
    return both.groupBy("block", "part").applyInArrow(run, "a long, b long")


def _parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, part)."""
    found = components(edges)
    return kept(_join(nodes.select("node"), found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("part")))


def _open(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The entries of lists that hold several parts, with their node's part and their list's largest."""
    held = _join(lists, parts, "node")
    counted = held.groupBy("shingle", "salt", "part").agg(F.count("*").alias("k")).groupBy("shingle", "part").agg(F.sum("k").alias("k"))
    main = counted.groupBy("shingle").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("shingle", "main")
    return _join(held, _join(lists.select("shingle", "salt").distinct(), main, "shingle"), ["shingle", "salt"])


def _rest(nodes: DataFrame, held: DataFrame, link: int) -> DataFrame:
    """Links (a, b) between the parts of open lists: every pair of a list's nodes of different parts whose sizes and places allow a link.

    The smaller node is the column, dealt by size step; rows are nodes of the
    same step and of the next.  Columns of a list's largest part meet only rows
    of others.  Lists are cut into blocks of bounded rows and columns, short
    ones share a block.
    """
    large = F.col("part") == F.col("main")
    # The smaller of two nodes that link has the first shingle that they share so early.
    short = F.col("n") - F.col("place") + 1 >= F.ceil(2 * link * F.col("n") / (100 + link))
    kept_columns = ("shingle", "salt", "node", "part", "n", "place")
    column = held.where(short).select(*kept_columns, "step", F.when(large, "main").otherwise("rest").alias("side"), F.lit(True).alias("few"))
    row = held.select(*kept_columns, F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), F.explode(F.when(large, F.array(F.lit("rest"))).otherwise(F.array(F.lit("rest"), F.lit("main")))).alias("side"), F.lit(False).alias("few"))
    every = row.unionByName(column)
    keys = ["shingle", "step", "side"]
    size = every.groupBy(*keys, "salt").agg(F.sum(F.when(~F.col("few"), F.col("n"))).alias("weight"), F.count_if("few").alias("columns")).groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("columns").alias("columns")).where("columns > 0 and weight > 0")
    cut = kept(size.select(*keys, "weight", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("i_all"), F.ceil(F.col("columns") / COLUMNS).cast("int").alias("j_all")))
    blocks = max(1, -(-int(cut.agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES))
    every = _join(every, _join(cut.drop("weight"), held.select("shingle", "salt").distinct(), "shingle"), [*keys, "salt"])
    place = F.xxhash64("node")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = every.where(~F.col("few")).select("*", F.pmod(place, "i_all").cast("int").alias("i"), other("j_all").alias("j"))
    columns = every.where("few").select("*", other("i_all").alias("i"), F.pmod(place, "j_all").cast("int").alias("j"))
    list_key = F.xxhash64(*keys)
    placed = rows.unionByName(columns).select(F.pmod(list_key, F.lit(blocks)).cast("int").alias("block"), "i", "j", list_key.alias("list"), "few", "node", "part", "n", "place")
    # A node's set is sent once to a block, whatever its lists there.
    entry = F.collect_list(F.struct("list", "few", "place"))
    full = _join(placed.groupBy("block", "i", "j", "node", "part", "n").agg(entry.alias("entries")), nodes.select("node", "shared"), "node")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        entries = table["entries"].combine_chunks()
        of = np.repeat(np.arange(table.num_rows), entries.value_lengths().to_numpy())
        flat = entries.flatten()
        name, few, place = flat.field("list").to_numpy(), flat.field("few").to_numpy(zero_copy_only=False), flat.field("place").to_numpy()
        node, part, n = (table[c].to_numpy() for c in ("node", "part", "n"))
        sets = _sets_of(table)
        r = np.flatnonzero(~few)
        r = r[np.argsort(name[r], kind="stable")]
        first, last = (np.searchsorted(name[r], name, side) for side in ("left", "right"))
        asked = np.flatnonzero(few)
        asked = asked[np.argsort(of[asked], kind="stable")]
        begin = np.searchsorted(of[asked], np.arange(table.num_rows + 1))

        joined = np.unique(part, return_inverse=True)[1]

        def wanted(c: int) -> np.ndarray:
            out = [np.zeros(0, np.int64)]
            for e in asked[begin[c] : begin[c + 1]]:
                met = r[first[e] : last[e]]
                x = of[met]
                need = -(-link * (n[x] + n[c]) // (100 + link))
                larger = (n[x] > n[c]) | ((n[x] == n[c]) & (node[x] != node[c]))
                out.append(x[larger & (joined[x] != joined[c]) & (np.minimum(n[x] - place[met], n[c] - place[e]) + 1 >= need)])
            return np.unique(np.concatenate(out))

        def forest() -> Iterator[tuple[int, np.ndarray]]:
            """One link for each part that a column joins to its own; the next columns don't look for links within it."""
            for c, left in product(sets, n, sets, n, wanted, link):
                parts, first = np.unique(joined[left], return_index=True)
                joined[np.isin(joined, parts)] = joined[c]
                yield c, left[first]

        return _linked_pairs(forest(), node, node)

    return full.groupBy("block", "i", "j").applyInArrow(run, "a long, b long")


def linked(docs: DataFrame, *, width: int = WIDTH, link: int = LINK, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Links join sets of ``width``-word shingles with a Jaccard similarity of
    ``link`` % or more; ``component_id`` is the smallest id that links reach.  A
    text of fewer words is one shingle; one without words, or null, has none
    and links with nothing.  Rows with equal ids are rows of their own, and
    linked as their texts are.  A null id is never the smallest: a part of
    null ids only has a null component.  Further columns are ignored; empty
    tables give no rows.
    """
    buckets = buckets or buckets_for(docs)
    rows = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = kept(_sets(rows, buckets, width, link))
    may = sets.where(F.col("node").isNotNull())
    nodes = kept(may.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared")))
    # Lists of two nodes or more; sizes in steps of the link's ratio; long lists in parts, the same for all nodes of a shingle.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / link))).cast("int")
    entries = nodes.select("node", "n", step.alias("step"), F.explode("prefix").alias("p")).select("node", "n", "step", "p.shingle", "p.place", "p.df", F.ceil(F.col("p.df") / LIST_PART).cast("int").alias("salts"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    several = entries.groupBy("shingle", "salts", "salt").count().where("salts > 1 or count > 1").select("shingle", "salt")
    lists = kept(_join(entries, several, ["shingle", "salt"]))

    def met(held: DataFrame, pivots: DataFrame) -> DataFrame:
        """Pairs of a list's nodes and the pivots (shingle, salts, node, n, place) whose sizes and places allow a link; of other parts only, if pivots have their ``own``."""
        own = [c for c in pivots.columns if c == "own"]
        every = pivots.select("shingle", *own, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("place").alias("other"))
        found = _join(held, every, ["shingle", "salt"]).where((F.col("node") != F.col("pivot")) & _fits("n", "m", "place", "other", link))
        found = found.where("part <> own") if own else found
        return found.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), F.struct("pivot", "node", "n").alias("x"), "df")

    def best() -> DataFrame:
        least = lists.groupBy("shingle", "salts", "salt").agg(F.min(F.struct("node", "n", "place")).alias("x")).groupBy("shingle", "salts").agg(F.min("x").alias("x"))
        return least.select("shingle", "salts", "x.node", "x.n", "x.place")

    def multiplied(found: DataFrame) -> DataFrame:
        pairs = kept(found.groupBy("a", "b").agg(F.min("x").alias("x"), F.max("df").alias("df")).select("x.node", "x.n", "x.pivot", "df"))
        return kept(_against_pivots(pairs, nodes, link))

    def without(held: DataFrame, pivots: DataFrame) -> DataFrame:
        """Lists less the nodes that have been compared with all of them."""
        return held.join(pivots.select("shingle", "node").hint("merge"), ["shingle", "node"], "left_anti")

    first = kept(best())
    edges = multiplied(met(lists, first))
    parts = _parts(nodes, edges)
    held = kept(_open(without(lists, first), parts))
    if not held.isEmpty():
        place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("node", "shingle"), "node"))
        few = held.withColumn("_k", place("shingle", "salt")).where(F.col("_k") <= MORE).withColumn("_k", place("shingle")).where(F.col("_k") <= MORE)
        few = kept(few.select("shingle", "salts", "node", "n", "place", F.col("part").alias("own")))
        more = multiplied(met(held, few))
        if not more.isEmpty():
            edges = edges.unionByName(more)
            parts = _parts(nodes, edges)
        held = kept(_open(without(held.drop("part", "main"), few), parts))
        more = kept(_rest(nodes, held, link)) if not held.isEmpty() else held.limit(0)
        if not more.isEmpty():
            parts = _parts(nodes, edges.unionByName(more))
    sized = _join(nodes.select("node", "first"), parts, "node")
    smallest = sized.groupBy("part").agg(F.min("first").alias("component"), F.count("*").alias("k")).where("k > 1").drop("k")
    named = _told(sized, smallest, "part", "node").select("node", F.coalesce("component", "first").alias("component"))
    grouped = _told(may.select("id", "n", "node"), named, "node", "id")
    # A text that can't link needs no answer.
    alone = sets.where(F.col("node").isNull()).select("id", "n", F.col("id").alias("component"))
    return grouped.select("id", "n", "component").unionByName(alone).toDF(id_col, "n_shingles", "component_id")
