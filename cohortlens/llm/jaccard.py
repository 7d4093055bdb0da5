"""Jaccard join over word n-grams by grouped prefixes, and the classes that its links make.

A document is the set of its n-gram hashes.  Under any one order of all n-grams, two sets of high similarity share a
member of their prefixes; with rare n-grams first, prefixes of unrelated documents have nothing in common.  Sets
with equal prefixes and size are one group; only groups are paired, their members are expanded and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import RangeHash, byte_class, byte_values, lists, mix, text_slices, word_bounds
from .common import Scratch, cut, same_row, shuffle_width, take, text_key
from .graph import components

#: Everything but space, tab, LF, VT, FF and CR, as UTF-8 bytes.
WORD = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
#: Share of the hash range that the first screen looks at, and the rows of a screened chunk.
SAMPLE = 0.35
CHUNK_ROWS = 60_000
#: Words of 64 bits in a set's parity bitmap.
BITS = 32
_KINDS = "b" + " long, b".join(map(str, range(BITS))) + " long"


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct word n-grams of each text, sorted by row and hash.  A text with fewer words, but
    any, has its whole word sequence as the one member."""
    s, e, row = word_bounds(data, offsets, WORD)
    if not len(s):
        return row, np.zeros(0, np.uint64)
    h = mix(RangeHash(data, byte_values(fold_case=True))(s, e))
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    step = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(words)]
    k = len(h) - words + 1
    if k > 0:
        grams = np.zeros(k, np.uint64)
        for j in range(words):
            grams += h[j:j + k] * step[j]
        whole = np.flatnonzero(row[:k] == row[words - 1:])
        rows, hashes = row[whole], mix(grams[whole])
    else:
        rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        # sequences of other lengths than n can't equal n-grams: the length is part of the hash
        values = [mix(np.array([sum(int(h[first[r] + j]) * int(step[j]) for j in range(counts[r])) + 7919 * int(counts[r]) & (1 << 64) - 1], np.uint64))[0] for r in short]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, np.array(values, np.uint64)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def _spare(n, percent: int):
    """Members that a set of n may have outside another it is similar to."""
    return n * (100 - percent) // 100


# -- first screen: sets most of whose n-grams are in no other set go -------------------------------------------------

def _screen(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(ref) of documents that can have a partner.

    Of the n-grams in the lowest ``SAMPLE`` of the hash range, a set may lack at most its spare members in a partner,
    so all others occur in another document.  N-grams are dealt as packed hashes, once per chunk of documents, to
    ranges of the hash space; ranges answer chunks how many of each document's occur again.  An answer that is too
    high (equal 32-bit remainders) only lets a document through."""
    width = shuffle_width(rows)
    limit = int(SAMPLE * (1 << 64))
    per = limit // width + 1
    fields = {"part": pa.int32(), "chunk": pa.int64(), "place": pa.binary(), "hash": pa.binary(), "nobody": pa.binary(),
              "refs": pa.binary(), "shared": pa.binary(), "sampled": pa.binary(), "size": pa.binary()}
    schema = "part int, chunk long, place binary, hash binary, nobody binary, refs binary, shared binary, sampled binary, size binary"

    def records(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(fields.values())], names=list(fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        chunk = 0
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                yield pack(batch.slice(at, CHUNK_ROWS), task + chunk)
                chunk += 1

    def pack(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
        refs = batch.column("ref").to_numpy()
        all_rows, all_hashes, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)], np.zeros(len(refs), np.int64)
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            row, h = gram_sets(data, offsets, words)
            sizes[lo:hi] = np.bincount(row, minlength=hi - lo)
            low = h < np.uint64(limit)
            all_rows.append((row[low] + lo).astype(np.uint16))
            all_hashes.append(h[low])
        row, h = np.concatenate(all_rows), np.concatenate(all_hashes)
        sampled = np.bincount(row, minlength=len(refs))
        order = np.argsort(h)
        row, h = row[order], h[order]
        first, last = np.ones(len(h), bool), np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        last[:-1] = first[1:]
        twice = ~(first & last)
        local = np.bincount(row[twice], minlength=len(refs))
        # what occurs twice in the chunk goes once, for no document
        row, h, nobody = row[first], h[first], twice[first]
        part = (h // np.uint64(per)).astype(np.int64)
        bounds = np.searchsorted(part, np.arange(width + 1))
        small = h.astype(np.uint32)
        out = [(int(p), chunk, row[a:b].tobytes(), small[a:b].tobytes(), np.packbits(nobody[a:b]).tobytes(), b"", b"", b"", b"")
               for p, a, b in zip(range(width), bounds[:-1], bounds[1:], strict=True) if a < b]
        out.append((chunk % width, chunk, b"", b"", b"", refs.tobytes(), local.tobytes(), sampled.tobytes(), sizes.tobytes()))
        return records(out)

    def answer(table: pa.Table) -> pa.Table:
        """Per chunk: documents (by place) with the number of their n-grams that occur again; chunks' own rows pass."""
        found = table.to_pylist()
        out = [tuple(r[k] for k in fields) for r in found if r["refs"]]
        dealt = [r for r in found if r["hash"]]
        hashes = [np.frombuffer(r["hash"], np.uint32) for r in dealt]
        if dealt:
            flat = np.concatenate(hashes)
            nobody = np.concatenate([np.unpackbits(np.frombuffer(r["nobody"], np.uint8), count=len(h)) for r, h in zip(dealt, hashes, strict=True)]).astype(bool)
            order = np.argsort(flat, kind="stable")
            equal = flat[order][1:] == flat[order][:-1]
            again = np.empty(len(flat), bool)
            again[order] = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
            again &= ~nobody
            at = 0
            for r, h in zip(dealt, hashes, strict=True):
                place = np.frombuffer(r["place"], np.uint16)[again[at:at + len(h)]]
                at += len(h)
                documents, counts = np.unique(place, return_counts=True)
                if len(documents):
                    out.append((r["part"], r["chunk"], documents.tobytes(), b"", b"", b"", counts.astype(np.int64).tobytes(), b"", b""))
        return pa.Table.from_batches([records(out)])

    def gather(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        own = next(r for r in found if r["refs"])
        refs = np.frombuffer(own["refs"], np.int64)
        shared = np.frombuffer(own["shared"], np.int64).copy()
        for r in found:
            if r["place"]:
                shared[np.frombuffer(r["place"], np.uint16)] += np.frombuffer(r["shared"], np.int64)
        size = np.frombuffer(own["size"], np.int64)
        stays = (size > 0) & (np.frombuffer(own["sampled"], np.int64) - shared <= _spare(size, percent))
        return pa.table({"ref": refs[stays]})

    packed = rows.select("ref", "text").mapInArrow(work, schema)
    return packed.groupBy("part").applyInArrow(answer, schema).groupBy("chunk").applyInArrow(gather, "ref long").distinct()


# -- sets of the documents that are left -------------------------------------------------------------------------

def _sets(rows: DataFrame, kind: str, words: int) -> DataFrame:
    """Size and fingerprint of every document's set; members and a parity bitmap where ``wanted``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_all = batch.column("wanted").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                n = hi - lo
                row, h = gram_sets(data, offsets, words)
                size = np.bincount(row, minlength=n)
                sums = np.zeros((2, n), np.uint64)
                np.add.at(sums[0], row, h)
                np.add.at(sums[1], row, mix(h + np.uint64(0x632BE59BD9B4E019)))
                wanted = wanted_all[lo:hi].astype(bool)
                mine = wanted[row]
                # every member flips one bit of its set's bitmap
                flips = np.zeros(n * BITS, np.uint64)
                np.bitwise_xor.at(flips, row[mine] * BITS + (h[mine] >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64),
                                  np.uint64(1) << (h[mine] >> np.uint64(40) & np.uint64(63)))
                bitmap = flips.reshape(n, BITS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, n), batch.column("key").slice(lo, n), pa.array(size, pa.int64()), pa.array(mix(sums[0]).view(np.int64)),
                     pa.array(mix(sums[1]).view(np.int64)), pa.array(wanted), lists(h[mine].view(np.int64), np.where(wanted, size, 0), pa.int64())]
                    + [pa.array(np.ascontiguousarray(bitmap[:, k])) for k in range(BITS)],
                    names=["id", "key", "size", "one", "two", "wanted", "grams"] + [f"b{k}" for k in range(BITS)])

    return rows.select("id", "key", "text", "wanted").mapInArrow(
        work, f"id {kind}, key long, size long, one long, two long, wanted boolean, grams array<long>, {_KINDS}")


def _prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, size, ahead, prefix): prefixes under the order by document frequency, then hash, without the n-grams of
    one set alone, of which ``ahead`` come first."""
    members = nodes.select("node", "size", F.explode("grams").alias("gram"))
    frequent = members.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    known = (members.join(frequent, "gram").groupBy("node", "size")
             .agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("known")))
    # the n-grams that are left out come first in the order
    ahead = F.col("size") - F.size("known")
    rest = F.floor(F.col("size") * (100 - percent) / 100) + 1 - ahead
    return (known.withColumn("rest", rest.cast("int")).where("rest > 0")
            .select("node", "size", ahead.cast("int").alias("ahead"), F.transform(F.slice("known", 1, F.col("rest")), lambda x: x["gram"]).alias("prefix")))


def _sizes(a: str, b: str, percent: int) -> Column:
    """What two sets' sizes allow, and the places of a shared n-gram in their orders: similar sets share one that
    has no more n-grams ahead of it than either may lack, which depends on both sizes."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    overlap = F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))
    return ((F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))
            & (F.col(f"{a}.ahead") <= x - overlap) & (F.col(f"{b}.ahead") <= y - overlap))


def _close(a: str, b: str, percent: int) -> Column:
    """What two sets' sizes and bitmaps allow: the difference of the sets is at least that of their parities."""
    apart = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITS)), F.lit(0))
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    return _sizes(a, b, percent) & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * both)


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar, by their members."""
    grams = nodes.select("node", "size", "grams")
    joined = (pairs.join(grams.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("grams").alias("ga")), "a")
              .join(grams.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("grams").alias("gb")), "b"))
    both = F.size(F.array_intersect("ga", "gb"))
    return joined.where(F.lit(100) * both >= F.lit(percent) * (F.col("sa") + F.col("sb") - both)).select("a", "b")


def _entries(labelled: DataFrame) -> DataFrame:
    """(gram, node, label, size, ahead): prefix members with the number of n-grams ahead of them in their set."""
    exploded = labelled.select(F.posexplode("prefix").alias("at", "gram"), "node", "label", "size", "ahead")
    return exploded.withColumn("ahead", F.col("ahead") + F.col("at")).drop("at")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _hub_pairs(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Every entry with one other of its n-gram, in its size class or the one below: another one for every n-gram and
    turn, so that a large class of similar documents hangs together although its pairs aren't enumerated."""
    sized = entries.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    hubs = (sized.groupBy("gram", "class")
            .agg(F.min_by(F.struct("size", "node", "ahead", "label"), F.xxhash64("gram", "node", F.lit(turn))).alias("hub"))
            .select("gram", "class", "hub.*"))
    near = sized.select("*", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("of")).drop("class").withColumnRenamed("of", "class")
    return (hubs.alias("h").join(near.alias("p"), (F.col("h.gram") == F.col("p.gram")) & (F.col("h.class") == F.col("p.class"))
                                 & (F.col("h.label") != F.col("p.label")) & _sizes("h", "p", percent))
            .select(*_pair("h", "p")))


def _cross_pairs(entries: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """All pairs of different classes that share an entry's n-gram and can be similar.

    Only n-grams of more than one class are looked at: a document outside an n-gram's largest class meets all others
    of other classes."""
    counted = entries.groupBy("gram", "label").agg(F.count("*").alias("n"))
    split = (counted.groupBy("gram").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"))
             .where("labels > 1").select("gram", F.col("most.label").alias("major")))
    bits = nodes.select("node", *[f"b{k}" for k in range(BITS)])
    mixed = scratch.put(entries.join(split, "gram").join(bits, "node"), name)
    x, y = mixed.where("label != major").alias("x"), mixed.alias("y")
    return (x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label"))
                   & ((F.col("y.label") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))) & _close("x", "y", percent))
            .select(*_pair("x", "y")))


def _links(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(node, label): classes of the sets that are linked, labelled by their lowest node.

    Sets with equal prefix and size are a group; groups are paired through their heads and expanded to members with
    their head.  Every round verifies pairs of different classes and merges the classes they link; the last two
    rounds (by an eighth of the n-grams, then by the rest) look at all pairs of different classes, so no link between
    classes is lost."""
    prefixed = scratch.put(_prefixes(nodes, percent), "prefixes")
    grouped = scratch.put(prefixed.join(prefixed.groupBy("size", "prefix").agg(F.min("node").alias("head")), ["size", "prefix"])
                          .select("node", "head", "size", "ahead", "prefix").withColumn("label", F.col("node")), "groups")

    def merged(labelled: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        links = scratch.put(_verify(pairs.distinct(), nodes, percent), f"links_{name}")
        label = labelled.select("node", "label")
        joined = (links.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
                  .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
                  .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        # the classes themselves are the nodes of these links
        to = components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
        return scratch.put(labelled.join(to, "label", "left").select("node", "size", "ahead", "prefix", F.coalesce("to", "label").alias("label")), f"labelled_{name}")

    inside = grouped.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    heads = _hub_pairs(_entries(grouped.where("node = head")), percent, 0)
    labelled = merged(grouped.drop("head"), inside.unionByName(heads), "heads")
    labelled = merged(labelled, _hub_pairs(_entries(labelled), percent, 1), "hubs")
    for name, share in (("eighth", "pmod(gram, 8) = 0"), ("rest", "pmod(gram, 8) != 0")):
        entries = scratch.put(_entries(labelled).where(share), f"entries_{name}")
        labelled = merged(labelled, _cross_pairs(entries, nodes, scratch, f"mixed_{name}", percent), name)
    return labelled.select("node", "label")


def classes(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, size, component)`` per input row: the size of its set of word n-grams and the smallest id that is
    reachable by links; ``key`` is ``common.text_key`` of the text.  The result is checkpointed.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.  Two rows link when
    100 * intersection >= percent * union of their sets.  Null and empty texts, and texts without words, have empty
    sets and link with nothing.  Repeated rows link with each other; rows of one id with other texts are judged by
    their texts.  Null ids never name a component that has another id (their own component is then null).  Other
    columns are not read.  N-grams are compared by 64-bit hashes, whole sets by 128 bits.
    """
    return _classes(docs, words, percent, id_col, text_col).drop("label")


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``classes`` and ``label``, which tells classes apart where rows of several repeat an id or have none; it is null
    for rows that the screen found alone."""
    if not 50 <= percent <= 100 or words < 1:
        raise ValueError("percent must be 50 to 100, words at least 1")
    rows = take(docs, id=id_col, text=text_col).withColumn("key", text_key(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("ref", F.xxhash64("id", "key"))
    with Scratch(docs.sparkSession) as scratch:
        left = scratch.put(_screen(rows, words, percent), "left")
        marked = (rows.alias("d").join(left.withColumn("wanted", F.lit(True)).alias("l").hint("shuffle_hash"), F.col("d.ref") == F.col("l.ref"), "left")
                  .select("d.id", "d.key", "d.text", F.coalesce("wanted", F.lit(False)).alias("wanted")))
        sets = scratch.put(_sets(marked, kind, words), "sets")
        bits = [f"b{k}" for k in range(BITS)]
        nodes = scratch.put(sets.where("wanted").groupBy("one", "two").agg(F.first(F.struct("size", "grams", *bits)).alias("x"))
                            .select("one", "two", "x.*").withColumn("node", F.monotonically_increasing_id()), "nodes")
        label = _links(nodes, scratch, percent)
        named = nodes.select("one", "two", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = sets.where("wanted").groupBy("one", "two").agg(F.min("id").alias("id"))
        by_set = named.join(lowest, ["one", "two"])
        by_label = by_set.groupBy("label").agg(F.min("id").alias("component"))
        of_set = by_set.join(by_label, "label").select("one", "two", "component", "label", F.lit(True).alias("found"))
        out = sets.select("id", "key", "size", "one", "two", "wanted").join(of_set, ["one", "two"], "left")
        return cut(out.select("id", "key", "size", F.when(F.col("wanted") & F.col("found"), F.col("component")).otherwise(F.col("id")).alias("component"),
                              F.when(F.col("wanted"), F.col("label")).alias("label")))


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which exactly one of each class stays: the one with the smallest
    id, null ids last, and among texts of one id the one with the smallest ``text_key`` (of rows that repeat id and
    text, any one).  Rows with empty sets all stay."""
    names = docs.columns
    found = _classes(docs, words, percent, id_col, text_col)
    placed = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    placed = placed.withColumns({"id": F.col(f"_c{names.index(id_col)}"), "key": text_key(F.col(f"_c{names.index(text_col)}"))})
    linked = F.col("label").isNotNull() & (F.col("size") > 0)
    # one (id, text) of each class; the table has one row per id and text, so it alone tells which rows stay
    counted = found.groupBy("label", "id", "key").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    first = counted.where(linked).groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n", "size")).alias("row"))
    counted = cut(first.select("row.id", "row.key", "row.n", "row.size").unionByName(counted.where(~linked).select("id", "key", "n", "size")))
    stay = placed.alias("d").join(counted.select("id", "key").alias("s").hint("shuffle_hash"), same_row("d", "s"), "left_semi")
    repeated = cut(counted.where("n > 1 AND size > 0").select("id", "key"))
    if not repeated.isEmpty():
        again = stay.alias("d").join(repeated.alias("s"), same_row("d", "s"), "left_semi").dropDuplicates(["id", "key"])
        stay = stay.alias("d").join(repeated.alias("s"), same_row("d", "s"), "left_anti").unionByName(again)
    return stay.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)
