"""Ranked lexical search by dual-tree descent over items and documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import RangeHash, byte_class, byte_values, lists, mix, text_slices, word_bounds
from .common import Scratch, cut, take
from .vectors import flat, parts, ranges

#: Bytes of item texts that are asked together; their terms and weights are what tasks hold of the items.
BLOCK_BYTES = 1 << 20
#: Documents of one tree, of a leaf, and children of a node.
TREE_ROWS = 4_096
LEAF_ROWS = 4
FAN = 8
#: Directions along which similar documents of a tree come together, and the passes that adjust them.
DIRECTIONS = 16
PASSES = 2
#: Items that a node of the item tree joins, and cells (terms times items) that one item tree may have.
ITEM_FAN = 4
CELLS = 1 << 22

_TERM = byte_class(lambda b: b >= 128 or chr(b).isalnum())
_LAST = np.iinfo(np.int64).max


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every term: a maximal run of ASCII letters, digits and non-ASCII, A-Z lower-cased."""
    s, e, row = word_bounds(data, offsets, _TERM)
    if not len(s):
        return np.zeros(0, np.uint64), row
    return mix(RangeHash(data, byte_values(fold_case=True))(s, e)), row


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``k`` best documents as ``(item_id, rank, doc_id, score)``.

    Terms are runs of ASCII letters, digits and non-ASCII characters of whole texts, A-Z lower-cased.  With N documents
    that hold a term, L terms in them, df documents holding a term, and a document's n terms with tf of this one,
    a term weighs ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``, a document has ``m = 10 + (90 n N) div L``, and its
    score sums ``w * ((10**9 tf) div (1000 tf + 8 m))`` over the item's distinct terms.  Documents without a score above 0
    are never returned; equal scores go by ascending document id.

    One pass over the texts leaves each document's length and its counts of the items' terms; N, L and df come
    from these.  A task then takes documents in trees of ``TREE_ROWS`` whose nodes hold the largest contribution of
    every term among similar documents, and the items in trees whose nodes hold the weights of all their terms.  The products
    of two nodes' maxima bound every score between them; where the bound is below the weakest kth score of the node's
    items, the whole batch is skipped.  What is left is scored exactly, and the tasks' best are merged.

    Items are the stated query set and are taken in blocks of about ``block_bytes`` of text, each with its own pass.
    64-bit hashes stand for terms.  Null and empty texts have no terms; items without terms have no rows.  Every
    document row counts and is ranked by itself, repeated ones too; an item (id and text) that repeats is answered
    once, items that share an id but not the text are answered apart.  Ids of documents count as 64-bit integers, null
    ids stay and come last among equal scores.  Empty tables give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = take(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    asked = take(items, id=item_id_col, text=item_text_col).distinct()
    kind = asked.schema["id"].dataType
    with Scratch(spark) as scratch:
        size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = parts(size, block_bytes)
        placed = asked.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
        found = None
        for block in range(blocks):
            # a block's size is bounded: block_bytes, or its one longest item
            own = placed.where(F.col("block") == block).select("id", "text").toArrow()
            hits = scratch.put(_block(texts, own, k, scratch, block), f"hits{block}").withColumn("block", F.lit(block))
            names = spark.createDataFrame(pa.table({"item": pa.array(range(len(own)), pa.int32()), "item_id": own.column("id")}))
            names = names.select("item", F.col("item_id").cast(kind).alias("item_id"))
            best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
            found = ranked if found is None else found.unionByName(ranked)
        return cut(found)


def _block(texts: DataFrame, own: pa.Table, k: int, scratch: Scratch, block: int) -> DataFrame:
    """Every task's best documents of a block's items."""
    spark = texts.sparkSession
    hashes: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(own.column("text")):
        h, row = terms_of(data, offsets)
        hashes += [np.unique(h[row == r]) for r in range(len(offsets) - 1)]
    words = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    vocabulary = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        bits = np.zeros(1 << 20, bool)
        bits[known >> np.uint64(44)] = True
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                h, row = terms_of(data, offsets)
                n = np.bincount(row, minlength=hi - lo)
                some = np.flatnonzero(bits[h >> np.uint64(44)]) if len(known) else np.zeros(0, np.int64)
                at = np.searchsorted(known, h[some])
                at[at == len(known)] = 0
                some, at = (x[known[at] == h[some]] for x in (some, at)) if len(some) else (some, at)
                pair, tf = np.unique(row[some] * max(len(known), 1) + at, return_counts=True)
                of, term = np.divmod(pair, max(len(known), 1))
                per = np.bincount(of, minlength=hi - lo)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(lo, hi - lo), "n": pa.array(n, pa.int64()),
                                                  "terms": lists(term, per, pa.int32()), "tfs": lists(tf, per, pa.int32())})

    counted = scratch.put(texts.mapInArrow(count, "id long, n long, terms array<int>, tfs array<int>"), f"counted{block}")
    total = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            df += np.bincount(flat(batch.column("terms"))[0].astype(np.int64), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "df": pa.array(df[some])})

    # at most one row for every term of the block
    table = counted.select("terms").mapInArrow(holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words), np.int64)
    df[table.column("term").to_numpy()] = table.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    shared = spark.sparkContext.broadcast(([np.searchsorted(words, h) for h in hashes], weight))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        works = [Best(tree, k) for tree in item_trees(terms, weight)]
        for batch in batches:
            for lo in range(0, len(batch), TREE_ROWS):
                docs = Documents(batch.slice(lo, TREE_ROWS), n_docs, n_terms, weight)
                for work in works:
                    work.add(docs.tree(work.items.terms))
        for work in works:
            yield from work.rows()

    return counted.where(F.size("terms") > 0).mapInArrow(best, "item int, doc_id long, score long")


def _heights(n: int, leaf: int, fan: int) -> list[int]:
    """Members of a node of each level, from the lowest level up to the root's."""
    out = [leaf]
    while out[-1] < n:
        out.append(out[-1] * fan)
    return out


class ItemTree:
    """Items in a tree: level 0 is the items, a node of a level joins ``ITEM_FAN`` neighbours of the one below.

    ``tables[l]`` has a row for every term of the items and a column for every node, with the term's weight where any
    item of the node has it."""

    def __init__(self, items: np.ndarray, terms: list[np.ndarray], weight: np.ndarray):
        self.items = items
        self.terms = np.unique(np.concatenate(terms))
        table = np.zeros((len(self.terms), len(items)), np.int64)
        for i, t in enumerate(terms):
            table[np.searchsorted(self.terms, t), i] = weight[t]
        self.tables = [table]
        while self.tables[-1].shape[1] > 1:
            below = self.tables[-1]
            self.tables.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], ITEM_FAN), axis=1))


def item_trees(terms: list[np.ndarray], weight: np.ndarray) -> list[ItemTree]:
    """Trees of bounded size over the items with terms, ordered so that neighbours share heavy terms."""
    heavy = [t[np.argsort(-weight[t], kind="stable")[:3]].tolist() for t in terms]
    order = sorted((i for i, t in enumerate(terms) if len(t)), key=lambda i: (heavy[i], i))
    trees, at = [], 0
    while at < len(order):
        n = size = 0
        while at + n < len(order) and (not n or (size + len(terms[order[at + n]])) * (n + 1) <= CELLS):
            size += len(terms[order[at + n]])
            n += 1
        own = order[at:at + n]
        trees.append(ItemTree(np.array(own), [terms[i] for i in own], weight))
        at += n
    return trees


class Documents:
    """Contributions ``(10**9 tf) div (1000 tf + 8 m)`` of documents' terms, similar documents next to each other."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int, weight: np.ndarray):
        terms, counts = flat(batch.column("terms"))
        tf = flat(batch.column("tfs"))[0].astype(np.int64)
        terms = terms.astype(np.int64)
        m = np.array([10 + (90 * int(x) * n_docs) // max(n_terms, 1) for x in batch.column("n").to_numpy()], np.int64)
        row = np.repeat(np.arange(len(batch)), counts)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        order = self._order(row, terms, (part * weight[terms]).astype(np.float64), m, len(weight))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        spot = np.lexsort((terms, place[row]))
        self.ids = batch.column("id").fill_null(_LAST).to_numpy()[order]
        self.row, self.term, self.part, self.wide = place[row][spot], terms[spot], part[spot], len(weight)

    @staticmethod
    def _order(row: np.ndarray, term: np.ndarray, strength: np.ndarray, m: np.ndarray, wide: int) -> np.ndarray:
        """Documents by the direction that they agree with most, then by their strongest term.  Directions begin as
        evenly placed documents and move to the sum of those that agree with them."""
        n = len(m)
        lead = np.zeros(n, np.int64)
        by = np.lexsort((strength, row))
        last = np.flatnonzero(np.append(row[by][1:] != row[by][:-1], True)) if len(by) else by
        lead[row[by][last]] = term[by][last]
        order = np.lexsort((m, lead))
        if n <= DIRECTIONS * LEAF_ROWS:
            return order
        value = strength / np.sqrt(np.maximum(np.bincount(row, strength**2, n), 1))[row]
        chosen = order[np.linspace(0, n - 1, DIRECTIONS).astype(np.int64)]
        among = np.full(n, -1)
        among[chosen] = np.arange(DIRECTIONS)
        first = np.searchsorted(row, np.arange(n))
        for _ in range(PASSES):
            some = among[row] >= 0
            sums = np.bincount(term[some] * DIRECTIONS + among[row[some]], value[some], wide * DIRECTIONS).reshape(wide, DIRECTIONS)
            sums /= np.maximum(np.sqrt((sums**2).sum(axis=0)), 1e-9)
            among = np.argmax(np.add.reduceat(sums[term] * value[:, None], first, axis=0), axis=1)
        return np.lexsort((m, lead, among))

    def tree(self, terms: np.ndarray) -> DocumentTree:
        """Their tree over some of the terms."""
        known = np.full(self.wide, -1)
        known[terms] = np.arange(len(terms))
        column = known[self.term]
        some = column >= 0
        return DocumentTree(self.ids, self.row[some], column[some], self.part[some], len(terms))


class DocumentTree:
    """``levels[0]`` are documents, a node of level 1 joins ``LEAF_ROWS`` neighbours, one of higher levels ``FAN`` nodes.
    A level holds (first entry of each node, terms, values): the largest contribution of every term among a node's
    documents."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, part: np.ndarray, wide: int):
        self.ids = ids
        self.levels = []
        self.fans = [1]
        node, value, size = row, part, len(ids)
        self._put(node, term, value, size)
        for width in _heights(size, LEAF_ROWS, FAN):
            fan = width if width == LEAF_ROWS else FAN
            self.fans.append(fan)
            key = (node // fan) * wide + term
            size = -(-size // fan)
            by = np.argsort(key, kind="stable")
            key, value = key[by], value[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            key, value = key[first], np.maximum.reduceat(value, first) if len(first) else value
            node, term = np.divmod(key, wide)
            self._put(node, term, value, size)

    def _put(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, size: int) -> None:
        self.levels.append((np.searchsorted(node, np.arange(size + 1)), term, value))

    def below(self, level: int, node: int) -> np.ndarray:
        """The nodes of the next level down that a node joins."""
        fan = self.fans[level]
        return np.arange(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0]) - 1))

    def products(self, level: int, nodes: np.ndarray, table: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums of products of neighbouring nodes' values (rows) and weights of item nodes: bounds, or scores of
        documents and items.  In 64-bit whole numbers."""
        begin, term, value = self.levels[level]
        a, b = begin[nodes[0]], begin[nodes[-1] + 1]
        out = np.zeros((len(nodes), len(columns)), np.int64)
        full = begin[nodes] < begin[nodes + 1]
        if a < b:
            weights = table[term[a:b]] if len(columns) == table.shape[1] else table[term[a:b][:, None], columns]
            out[full] = np.add.reduceat(weights * value[a:b, None], begin[nodes[full]] - a, axis=0)
        return out


class Best:
    """The best documents of every item so far, and the descent of an item tree and document trees."""

    def __init__(self, items: ItemTree, k: int):
        self.items, self.k = items, k
        n = len(items.items)
        self.scores = np.zeros((n, k), np.int64)
        self.ids = np.full((n, k), _LAST, np.int64)
        #: by level: the lowest kth score among a node's items, 0 while one has fewer results
        self.weakest = [np.zeros(t.shape[1], np.int64) for t in items.tables]

    def add(self, docs: DocumentTree) -> None:
        self._descend(docs, len(docs.levels) - 1, 0, len(self.items.tables) - 1, np.zeros(1, np.int64))

    def _descend(self, docs: DocumentTree, level: int, node: int, high: int, items: np.ndarray) -> None:
        """One document node of a level and the item nodes that it may have results for: both go a level down, pairs of
        children whose bound is below the weakest kth score are skipped."""
        if high:
            last = self.items.tables[high - 1].shape[1]
            items = ranges(items * ITEM_FAN, np.minimum(ITEM_FAN, last - items * ITEM_FAN))
            high -= 1
        # documents are scored against items alone
        if level == 1 and high:
            self._descend(docs, level, node, high, items)
            return
        nodes = docs.below(level, node)
        bound = docs.products(level - 1, nodes, self.items.tables[high], items)
        if level == 1:
            self._keep(docs.ids[nodes], items, bound)
            return
        for i in np.argsort(-bound.max(axis=1, initial=0), kind="stable"):
            # an equal score may still win by its id
            alive = (bound[i] >= self.weakest[high][items]) & (bound[i] > 0)
            if alive.any():
                self._descend(docs, level - 1, int(nodes[i]), high, items[alive])

    def _keep(self, ids: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        for c in np.flatnonzero(((scores >= self.weakest[0][items]) & (scores > 0)).any(axis=0)):
            item = items[c]
            some = scores[:, c] > 0
            score = np.concatenate([self.scores[item], scores[some, c]])
            name = np.concatenate([self.ids[item], ids[some]])
            first = np.lexsort((name, -score))[:self.k]
            self.scores[item], self.ids[item] = score[first], name[first]
            if score[first[-1]] != self.weakest[0][item]:
                self.weakest[0][item] = score[first[-1]]
                for high in range(1, len(self.weakest)):
                    item //= ITEM_FAN
                    self.weakest[high][item] = self.weakest[high - 1][item * ITEM_FAN:(item + 1) * ITEM_FAN].min()

    def rows(self) -> Iterator[pa.RecordBatch]:
        item, place = np.nonzero(self.scores > 0)
        if len(item):
            ids = self.ids[item, place]
            yield pa.RecordBatch.from_pydict({"item": pa.array(self.items.items[item], pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=ids == _LAST),
                                              "score": pa.array(self.scores[item, place])})
