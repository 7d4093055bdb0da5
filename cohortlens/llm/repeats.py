"""Removal of long byte strings that occur more than once, by suffix arrays of text pieces.

Every window of ``size`` bytes picks the byte string of ``gram`` bytes in it with the lowest hash (the first of equal
ones): its anchor.  Equal windows have equal anchors at equal places, so all that can match meets under one anchor,
and an anchor that occurs once has no repeated window.  Consecutive windows with one anchor make a piece of text.
Equal pieces that follow each other, as in blank or ruled text, where every period has an anchor of its own, are one
row with its number of copies.  Pieces are first shuffled as hashes only; equal pieces are collapsed; anchors with
different pieces get a suffix array of their pieces (by Lyndon groups, see ``suffixes``), whose common prefixes tell the
repeated windows.

Anchors with very many different pieces are dealt out further: their windows are cut into narrow bands that share
most of their bytes, and bands into single windows, so that no group grows with the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import RangeHash, byte_values, lists, mix, runs, text_slices
from .common import Scratch, cut, same_row, shuffle_width, take, text_key
from .suffixes import common_prefixes, suffix_order

#: Bytes of a symbol in the suffix arrays.
BLOCK = 8
#: Symbols that are sorted at a time, in whole groups.
SORT_SYMBOLS = 1 << 19
#: Different pieces beyond which a group is dealt out further, and the windows of a band.
GROUP_PIECES = 256
BAND = 16
#: Windows of a text that are cut into pieces at a time.
CHUNK = 1 << 22
_PLACE_BITS = np.uint64(28)


def windowed_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima from both ends of blocks."""
    n = len(v)
    pad = -n % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def cut_pieces(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start, end, anchor place (within the row), anchor hash, content hash, copies and their common end of all
    pieces, with equal neighbours as one.  A longer text is alone in its slice and taken in chunks that share no window."""
    chunked = len(offsets) == 2 and len(data) > CHUNK + size
    for a in range(0, len(data) - size + 1, CHUNK) if chunked else (0,):
        part = data[a:a + CHUNK + size - 1] if chunked else data
        got = _pieces_in(part, np.array([0, len(part)]) if chunked else offsets, size, gram)
        if got is None:
            continue
        row, low, high, at, anchor, content = got
        same = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(row)) - 1
        yield row[first], low[first] + a, high[first] + a, at[first] + a, anchor[first], content[first], last - first + 1, high[last] + a


def _pieces_in(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """Row, start, end, anchor place (within the row), anchor hash and content hash of pieces."""
    n = len(data)
    if n < size:
        return None
    ranged = RangeHash(data, byte_values())
    h = mix(ranged.every(gram))
    # hash first, place last: the first of equal hashes is the lowest
    v = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    anchor = (windowed_min(v, size - gram + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    # windows that lie in one row
    length = np.diff(offsets)
    valid = np.zeros(n - size + 2, np.int8)
    fits = length >= size
    np.add.at(valid, offsets[:-1][fits], 1)
    np.add.at(valid, offsets[1:][fits] - size + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    fresh = np.concatenate(([True], anchor[1:] != anchor[:-1])) | np.concatenate(([True], ~valid[:-1]))
    at_row = offsets[:-1][fits]
    fresh[at_row] = True
    low = np.flatnonzero(fresh & valid)
    if not len(low):
        return None
    edge = np.flatnonzero(fresh | ~valid)
    after = np.searchsorted(edge, low, side="right")
    high = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], len(valid)) - 1 + size
    at = anchor[low]
    content = mix(ranged(low, high) + np.uint64(0xD6E8FEB86659FD93) * (at - low).astype(np.uint64)
                  + np.uint64(0xA0761D6478BD642F) * (high - low).astype(np.uint64))
    row = np.searchsorted(offsets, low, side="right") - 1
    base = offsets[row]
    return row, low - base, high - base, at - base, h[at].view(np.int64), content.view(np.int64)


def repeated_windows(pieces: list[bytes], leads: list[int], counts: list[int], size: int) -> list[np.ndarray]:
    """For each piece, which windows (by start) occur again in a piece of the list, or in another copy of itself.

    ``leads`` are the anchors' places in the pieces; only windows at equal places from the anchor can be equal, so
    all pieces are laid out with blocks of equal places.  One suffix array over the blocks of all pieces, each
    ended by a symbol of its own, orders all block-aligned suffixes; a window that starts inside a block is equal
    to another if their rests are neighbours with a long enough common prefix and the bytes before agree."""
    m = len(pieces)
    length = np.array([len(p) for p in pieces], np.int64)
    front = -np.array(leads, np.int64) % BLOCK  # unused bytes of the first block
    blocks = -(-(front + length) // BLOCK)
    start_block = np.concatenate(([0], np.cumsum(blocks + 1)[:-1]))
    n = int((blocks + 1).sum())
    laid = np.zeros(n * BLOCK, np.uint8)
    first = start_block * BLOCK + front
    total = int(length.sum())
    into = np.arange(total) + np.repeat(first - (np.cumsum(length) - length), length)
    laid[into] = np.frombuffer(b"".join(pieces), np.uint8)
    big = laid.view(">u8").astype(np.uint64)
    # ends of pieces are the lowest symbols, each once, the last piece's the very lowest
    ends = start_block + blocks
    real = np.ones(n, bool)
    real[ends] = False
    _, rank = np.unique(big[real], return_inverse=True)
    symbols = np.empty(n, np.int64)
    symbols[real] = rank + m
    symbols[ends] = np.arange(m - 1, -1, -1)
    order = suffix_order(symbols)
    shared = common_prefixes(symbols, order, size // BLOCK + 1) * BLOCK
    # bytes of the first different block that still agree
    a, b = order[:-1] + shared[1:] // BLOCK, order[1:] + shared[1:] // BLOCK
    fine = (a < n) & (b < n)
    differ = np.where(fine, big[np.minimum(a, n - 1)] ^ big[np.minimum(b, n - 1)], np.uint64(1 << 63))
    fine &= real[np.minimum(a, n - 1)] & real[np.minimum(b, n - 1)]
    same = np.zeros(n - 1, np.int64)
    for k in range(1, BLOCK):
        same += (differ >> np.uint64(64 - 8 * k)) == 0
    shared[1:] += np.where(fine, same, 0)
    # windows by the part of them that stands before a block boundary
    piece_of = np.repeat(np.arange(m), blocks + 1)
    windows = length - size + 1
    window_at = np.concatenate(([0], np.cumsum(windows)))
    again = np.zeros(int(window_at[-1]), bool)
    suffix_piece = piece_of[order]
    for d in range(BLOCK):
        start = order * BLOCK - d - first[suffix_piece]  # window start within its piece
        usable = np.flatnonzero((start >= 0) & (start < windows[suffix_piece]))
        kind = np.cumsum(shared < size - d)[usable]
        where = order[usable]
        if d:
            before = big[np.maximum(where - 1, 0)] & np.uint64((1 << (8 * d)) - 1)
            by = np.lexsort((before, kind))
            equal = (kind[by][1:] == kind[by][:-1]) & (before[by][1:] == before[by][:-1])
        else:
            by = np.arange(len(usable))
            equal = kind[1:] == kind[:-1]
        twice = np.zeros(len(usable), bool)
        if len(usable) > 1:
            hit = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
            twice[by] = hit
        chosen = usable[twice]
        again[window_at[suffix_piece[chosen]] + start[chosen]] = True
    out = []
    for i in range(m):
        mine = again[window_at[i]:window_at[i + 1]]
        out.append(np.ones(len(mine), bool) if counts[i] > 1 else mine)
    return out


def _pieces_of(rows: DataFrame, kind: str, size: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                for row, low, high, at, anchor, content, copies, reach in cut_pieces(data, offsets, size, gram):
                    picked = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(content), batch.column("id").slice(lo, hi - lo).take(picked), batch.column("key").slice(lo, hi - lo).take(picked),
                         pa.array(low, pa.int64()), pa.array((high - low).astype(np.int32)), pa.array((at - low).astype(np.int32)),
                         pa.array(copies, pa.int64()), pa.array((reach - low), pa.int64())],
                        names=["anchor", "piece", "id", "key", "low", "length", "lead", "copies", "reach"])

    return rows.mapInArrow(work, f"anchor long, piece long, id {kind}, key long, low long, length int, lead int, copies long, reach long")


def _bands(texts: DataFrame, size: int, band: int) -> DataFrame:
    """Pieces cut into bands of windows: what all windows of a band share becomes part of the group's key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_values()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "piece", "n", "lead", "bytes", "of_anchor", "of_piece", "skip")}
            for x in batch.to_pylist():
                data = np.frombuffer(x["bytes"], np.uint8)
                ranged = RangeHash(data, table)
                windows = len(data) - size + 1
                q0, q1 = (0 - x["lead"]) // band, (windows - 1 - x["lead"]) // band
                for q in range(q0, q1 + 1):
                    low, high = max(0, x["lead"] + q * band), min(windows, x["lead"] + (q + 1) * band)
                    core = x["lead"] + (q + 1) * band - 1, x["lead"] + q * band + size
                    seed = np.array([x["anchor"], q], np.int64).view(np.uint64)
                    group = mix(ranged(np.array([core[0]]), np.array([core[1]])) + mix(seed)[:1] + mix(seed[1:] + np.uint64(band)))
                    lead = x["lead"] + q * band - low
                    content = mix(ranged(np.array([low]), np.array([high + size - 1])) + np.uint64((high - low) * 4096 + lead + 4096))
                    for k, v in (("anchor", int(group.view(np.int64)[0])), ("piece", int(content.view(np.int64)[0])), ("n", x["n"]), ("lead", lead),
                                 ("bytes", x["bytes"][low:high + size - 1]), ("of_anchor", x["anchor"]), ("of_piece", x["piece"]), ("skip", low)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["anchor"], pa.int64()), pa.array(out["piece"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["lead"], pa.int32()),
                 pa.array(out["bytes"], pa.binary()), pa.array(out["of_anchor"], pa.int64()), pa.array(out["of_piece"], pa.int64()), pa.array(out["skip"], pa.int32())],
                names=list(out))

    return texts.select("anchor", "piece", "n", "lead", "bytes").mapInArrow(
        work, "anchor long, piece long, n long, lead int, bytes binary, of_anchor long, of_piece long, skip int")


def _resolve(texts: DataFrame, size: int) -> DataFrame:
    """(anchor, piece, spans): repeated windows of pieces as flat [first, end) pairs, from suffix arrays of whole
    anchors.  ``texts`` has every different piece of an anchor once."""
    dealt = texts.select("anchor", "piece", "n", "lead", "bytes").repartition(4 * shuffle_width(texts), "anchor").sortWithinPartitions("anchor")

    def sort(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        found = repeated_windows(t["bytes"].to_pylist(), t["lead"].to_pylist(), t["n"].to_pylist(), size)
        flat, sizes = [], []
        for mask in found:
            s, e = runs(mask)
            flat.append(np.stack([s, e], axis=1).ravel())
            sizes.append(2 * len(s))
        return pa.RecordBatch.from_arrays(
            [pa.array(t["anchor"].to_numpy()), pa.array(t["piece"].to_numpy()), lists(np.concatenate(flat), np.array(sizes), pa.int32())],
            names=["anchor", "piece", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        symbols = 0
        for batch in batches:
            while len(batch):
                # whole groups only: the last anchor of what is held may go on in the next batch
                anchors = batch.column("anchor").to_numpy()
                weight = np.cumsum([len(x) // BLOCK + 2 for x in batch.column("bytes").to_pylist()])
                upto = int(np.searchsorted(weight, SORT_SYMBOLS - symbols)) + 1
                if upto >= len(batch):
                    held.append(batch)
                    symbols += int(weight[-1])
                    break
                last = anchors[upto - 1]
                after = upto + int(np.searchsorted(anchors[upto:] != last, True))
                held.append(batch.slice(0, after))
                symbols += int(weight[after - 1])
                batch = batch.slice(after)
                if len(batch):
                    yield sort(held)
                    held, symbols = [], 0
        if held:
            yield sort(held)

    return dealt.mapInArrow(work, "anchor long, piece long, spans array<int>")


def _groups(pieces: DataFrame, weight) -> DataFrame:
    """Anchors that occur more than once, with whether their pieces differ."""
    return (pieces.groupBy("anchor").agg(F.sum(weight).alias("total"), F.min("piece").alias("a"), F.max("piece").alias("b"))
            .where("total > 1").select("anchor", (F.col("a") != F.col("b")).alias("differ")))


def _decide(texts: DataFrame, scratch: Scratch, size: int, bands: tuple[int, ...], level: int = 0) -> DataFrame:
    """(anchor, piece, spans) for the different pieces of anchors; crowded anchors go on in bands."""
    kinds = texts.groupBy("anchor").agg(F.count("*").alias("kinds"))
    # written, so that a join's both sides are plain shuffles, which Spark can split where one anchor is hot
    crowded = scratch.put(kinds.where(F.col("kinds") > GROUP_PIECES).select("anchor"), f"crowded{level}")
    calm = _resolve(texts.join(crowded, "anchor", "left_anti"), size)
    if not bands or crowded.isEmpty():
        # of single windows no anchor is crowded: its pieces are all equal
        return calm
    cut_up = scratch.put(_bands(texts.join(crowded, "anchor"), size, bands[0]), f"bands{level}")
    groups = scratch.put(_groups(cut_up, F.col("n")), f"groups{level}")
    shared = scratch.put(cut_up.join(groups, "anchor"), f"shared{level}")
    alike = shared.where("NOT differ").select("of_anchor", "of_piece", F.array("skip", F.col("skip") + F.length("bytes") - size + 1).alias("spans"))
    different = shared.where("differ").groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    below = _decide(scratch.put(different, f"different{level}"), scratch, size, bands[1:], level + 1)
    found = (shared.where("differ").select("anchor", "piece", "of_anchor", "of_piece", "skip").join(below.where(F.size("spans") > 0), ["anchor", "piece"])
             .select("of_anchor", "of_piece", F.transform("spans", lambda s: s + F.col("skip")).alias("spans")))
    merged = (alike.unionByName(found).groupBy(F.col("of_anchor").alias("anchor"), F.col("of_piece").alias("piece"))
              .agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return calm.unionByName(merged)


def repeated_spans(docs: DataFrame, *, size: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, spans)``: for documents with repeated windows, their byte ranges as a flat array of [start, end)
    pairs (they may overlap), where ``key`` is ``common.text_key`` of the text.  The result is checkpointed."""
    if not 8 <= gram <= size:
        raise ValueError("gram must be between 8 and size")
    rows = take(docs, id=id_col, text=text_col).withColumn("key", text_key(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        pieces = scratch.put(_pieces_of(rows, kind, size, gram), "pieces")
        groups = scratch.put(_groups(pieces, F.col("copies")), "groups")
        shared = scratch.put(pieces.join(groups, "anchor"), "shared")
        different = (shared.where("differ").groupBy("anchor", "piece")
                     .agg(F.sum("copies").alias("n"), F.min(F.struct("id", "key", "low", "length", "lead")).alias("one")))
        wanted = (different.groupBy(F.col("one.id").alias("id"), F.col("one.key").alias("key"))
                  .agg(F.collect_list(F.struct("anchor", "piece", "n", "one.low", "one.length", "one.lead")).alias("wanted")))
        texts = scratch.put(_texts(rows, wanted), "texts")
        decided = _decide(texts, scratch, size, (BAND, 1))
        # pieces of anchors whose pieces are all equal, and pieces that follow themselves
        alike = shared.where("NOT differ OR copies > 1").select("id", "key", F.array("low", F.col("low") + F.col("reach")).alias("spans"))
        # windows [first, end) of a piece are bytes [first, end + size - 1)
        in_text = F.transform("spans", lambda s, i: s + F.col("low") + F.when(i % 2 == 1, F.lit(size - 1)).otherwise(F.lit(0)))
        found = (shared.where("differ AND copies = 1").select("anchor", "piece", "id", "key", "low")
                 .join(decided.where(F.size("spans") > 0), ["anchor", "piece"]).select("id", "key", in_text.alias("spans")))
        return cut(alike.unionByName(found).groupBy("id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of wanted pieces: (anchor, piece, n, lead, bytes)."""
    joined = rows.alias("d").join(wanted.alias("w").hint("shuffle_hash"), same_row("d", "w"))
    raw = F.col("d.text").cast("binary")
    cut_out = F.transform("w.wanted", lambda w: F.struct(
        w["anchor"].alias("anchor"), w["piece"].alias("piece"), w["n"].alias("n"), w["lead"].alias("lead"),
        F.substring(raw, (w["low"] + 1).cast("int"), w["length"]).alias("bytes")))
    return joined.select(F.inline(cut_out))


def remove_repeats(docs: DataFrame, *, size: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kept, n_bytes, n_removed, n_spans)``: every text's bytes without those that lie in a string of
    ``size`` bytes that starts anywhere else too, in this or another row; one row per input row.

    Texts are taken as UTF-8 bytes and judged as they come in; matches don't cross rows, overlaps count.  ``kept``
    is binary, as a cut may fall inside a character.  Null and empty texts have no bytes, texts shorter than
    ``size`` lose none.  Repeated rows repeat each other.  Null ids stay; other columns aren't read; a table
    without rows gives none.  Long texts are cut into pieces chunk by chunk, without a limit of length.
    """
    rows = take(docs, id=id_col, text=text_col).withColumn("key", text_key(F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_spans(docs, size=size, gram=gram, id_col=id_col, text_col=text_col)
    joined = rows.alias("d").join(spans.alias("s").hint("shuffle_hash"), same_row("d", "s"), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                kept, removed, n_spans = [], [], []
                for i in range(hi - lo):
                    raw = data[offsets[i]:offsets[i + 1]]
                    mine = spans[lo + i].as_py()
                    if not mine:
                        kept.append(raw.tobytes())
                        removed.append(0)
                        n_spans.append(0)
                        continue
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, mine[::2], 1)
                    np.add.at(depth, mine[1::2], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    kept.append(raw[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    n_spans.append(len(runs(gone)[0]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(kept, pa.binary()), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = joined.select("d.id", "d.text", "s.spans").mapInArrow(work, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumnRenamed("id", id_col)
