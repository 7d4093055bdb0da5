"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .arrays import lists, text_slices
from .common import take

BLANK = "▁"
#: Stands for a literal U+2581 of a text while it is encoded; it can't occur in valid UTF-8.
LITERAL_BLANK = "\udc81"
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 4_000_000
#: Words whose best segmentation is kept in a task; beyond it they are forgotten and found anew.
CACHE = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores by id, bounded by ``MAX_PIECES``; ``byte_ids`` holds the ids of the 256 byte pieces, or
    is empty; ``fixed`` are ids that texts can't produce (unknown, control, unused)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    fixed: frozenset[int]
    unknown: int


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a model file, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError("the vocabulary is too large to send to every executor")
    by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in range(n)), tuple(model.get_score(i) for i in range(n)),
        tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (),
        frozenset(i for i in range(n) if model.is_unknown(i) or model.is_control(i) or model.is_unused(i)), model.unk_id())


class Encoder:
    """Best segmentation of texts: the sequence of pieces with the highest sum of scores.

    A blank is put before the text and blanks become U+2581; nothing else is changed.  On equal sums the longer
    last piece wins.  A character that is no piece of its own may be passed over at ``UNKNOWN_PENALTY`` below the
    lowest score; it then stands as its UTF-8 bytes (as the unknown piece without byte pieces)."""

    def __init__(self, v: Vocabulary):
        self.v = v
        usual = [i for i in range(len(v.pieces)) if i not in v.fixed and i not in set(v.byte_ids)]
        self.automaton = ahocorasick.Automaton()
        for i in usual:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self.automaton.make_automaton()
        self.single = frozenset(v.pieces[i] for i in usual if len(v.pieces[i]) == 1)
        self.penalty = min((v.scores[i] for i in usual), default=0.0) - UNKNOWN_PENALTY
        # no piece goes on past the end of a word, so words are segmented one by one
        self.by_word = not any(BLANK in v.pieces[i].lstrip(BLANK) for i in usual)
        # neighbours inside a piece; between others no piece reaches across, so segmentation falls apart there
        self.inner = frozenset(p[k:k + 2] for p in (v.pieces[i] for i in usual) for k in range(len(p) - 1))
        self.known: dict[str, bytes] = {}

    def segment(self, s: str) -> list[int]:
        """Ids of the best segmentation of escaped text, in one pass over the automaton's matches."""
        n = len(s)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        odd = [p for p, c in enumerate(s) if c not in self.single]
        at, end_odd = 0, len(odd)
        for end, (size, score, piece) in self.automaton.iter(s):
            while at < end_odd and odd[at] < end:  # unknown characters that end before this match
                self._pass(best, back, odd[at])
                at += 1
            start = end + 1 - size
            b = best[start]
            if b is None:
                continue
            total = b + score
            old = best[end + 1]
            if old is None or total > old:
                best[end + 1] = total
                back[end + 1] = (start, piece)
            if at < end_odd and odd[at] == end:
                self._pass(best, back, odd[at])
        while at < end_odd:
            self._pass(best, back, odd[at])
            at += 1
        out, p = [], n
        while p:
            p, piece = back[p]
            out.append(piece)
        out.reverse()
        if -1 in out:
            return self._bytes(s, out)
        return out

    def _pass(self, best, back, p: int) -> None:
        if best[p] is not None and (best[p + 1] is None or best[p] + self.penalty > best[p + 1]):
            best[p + 1] = best[p] + self.penalty
            back[p + 1] = (p, -1)

    def _bytes(self, s: str, path: list[int]) -> list[int]:
        out, at = [], 0
        for piece in path:
            if piece >= 0:
                out.append(piece)
                at += len(self.v.pieces[piece])
                continue
            c = BLANK if s[at] == LITERAL_BLANK else s[at]
            out.extend([self.v.byte_ids[b] for b in c.encode()] if self.v.byte_ids else [self.v.unknown])
            at += 1
        return out

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        if not text:
            return b""
        s = BLANK + text.replace(BLANK, LITERAL_BLANK).replace(" ", BLANK)
        if not self.by_word:
            return np.array(self.segment(s), np.int32).tobytes()
        return b"".join([self.known.get(w) or self._word(w) for w in words(s)])

    def _word(self, w: str) -> bytes:
        """A word that isn't known: its parts between uncrossable neighbours."""
        known, inner = self.known, self.inner
        if len(known) >= CACHE:
            known.clear()
        cuts = [k for k in range(1, len(w)) if w[k - 1:k + 1] not in inner]
        if cuts:
            got = b"".join([known.get(p) or self._part(p) for p in (w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)]))])
        else:
            got = self._part(w)
        if len(w) <= 64:
            known[w] = got
        return got

    def _part(self, p: str) -> bytes:
        got = pack(f"{len(ids := self.segment(p))}i", *ids)
        if len(p) <= 64:
            self.known[p] = got
        return got


def words(s: str) -> list[str]:
    """Cut escaped text before every U+2581 that follows another character."""
    parts = s.split(BLANK)
    out, blanks = [], 0
    for i, part in enumerate(parts):
        if i:
            blanks += 1
        if part:
            out.append(BLANK * blanks + part)
            blanks = 0
    if blanks:
        out.append(BLANK * blanks)
    return out


class Decoder:
    """Bytes of id sequences: pieces with blanks for U+2581, byte pieces as bytes, without the leading blank."""

    def __init__(self, v: Vocabulary):
        by_id = [p.replace(BLANK, " ").encode() for p in v.pieces]
        for i in v.fixed:
            by_id[i] = b""
        by_id[v.unknown] = " ⁇ ".encode()
        for b, i in enumerate(v.byte_ids):
            by_id[i] = bytes([b])
        self.size = np.array([len(b) for b in by_id], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of consecutive id sequences."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total, dtype=np.int32 if total < 2**31 else np.int64)
        source -= np.repeat((ends - size - self.start[ids]).astype(source.dtype), size)
        data = self.pool[source]
        row_ends = np.concatenate(([0], ends))[np.cumsum(counts)]
        offsets = np.concatenate(([0], row_ends))
        # the blank put before each text goes
        first = offsets[:-1][counts > 0]
        first = first[(first < total)]
        first = first[data[first] == 32]
        keep = np.ones(total, bool)
        keep[first] = False
        gone = np.concatenate(([0], np.cumsum(~keep)))
        return data[keep], offsets - gone[offsets]


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, n_pieces, n_byte_pieces, round_trip)`` of every whole text, one row per input row.

    ``round_trip`` tells whether decoding the ids gives the text's bytes again.  Null and empty texts have no
    pieces and come back as empty; repeated rows give repeated results; null ids stay; other columns aren't read.
    """
    rows = take(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder, decoder = Encoder(v), Decoder(v)
        is_byte = np.zeros(len(v.pieces) + 1, np.int64)
        is_byte[list(v.byte_ids)] = 1
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                raw = data.tobytes()
                blobs = [encoder.encode(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                counts = np.array([len(b) // 4 for b in blobs], np.int64)
                ids = np.frombuffer(b"".join(blobs), np.int32)
                back, back_at = decoder.decode(ids, counts)
                if len(back) == len(data) and (back_at == offsets).all() and (back == data).all():
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([back[a:b].tobytes() == raw[c:d] for a, b, c, d in zip(back_at[:-1], back_at[1:], offsets[:-1], offsets[1:], strict=True)])
                row = np.repeat(np.arange(hi - lo), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), lists(ids, counts, pa.int32()), pa.array(counts, pa.int64()),
                     pa.array(np.bincount(row, weights=is_byte[ids], minlength=hi - lo).astype(np.int64)), pa.array(same)],
                    names=["id", "ids", "n_pieces", "n_byte_pieces", "round_trip"])

    out = rows.mapInArrow(work, f"id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of id sequences; null or empty sequences give empty texts; null members are left out; ids
    outside the vocabulary raise; bytes that aren't UTF-8 become U+FFFD."""
    rows = take(encoded, id=id_col, ids=ids_col)
    kind = rows.schema["id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            each = [np.array([x for x in ids or [] if x is not None], np.int64) for ids in batch.column("ids").to_pylist()]
            if not each:
                continue
            flat = np.concatenate(each)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(decoder.size)):
                raise ValueError("an id is not in the vocabulary")
            data, at = decoder.decode(flat, np.array([len(x) for x in each], np.int64))
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(work, f"id {kind}, text string").withColumnRenamed("id", id_col)
