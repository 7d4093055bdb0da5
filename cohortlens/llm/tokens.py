"""Token counts by offset-mapped attribution: a document is encoded once, its token spans are joined to sections by
interval search, and a token over a boundary is allocated by a stated rule."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take

#: How the ranks' makers cut texts before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (Unicode's property) in runs so long that matching the pattern would exhaust the stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
MAX_VOCABULARY_BYTES = 64 << 20
RULES = ("first", "last", "majority")


def read_ranks(path: str) -> bytes:
    """A rank file as bytes, read on the driver and sent along; refused beyond ``MAX_VOCABULARY_BYTES``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to every executor")
    return raw


class Tokenizer:
    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        """End of every token in the text's bytes.

        The pattern takes a run of white space but for its last character as one piece, or the whole run at the end of
        the text.  Long runs are cut out by that rule and merged as the pieces they are; what stands between them is
        encoded as usual, so the tokens are the same."""
        tokens, at = [], 0
        for run in LONG_SPACE.finditer(text):
            tokens += self.encoding.encode_ordinary(text[at:run.start()])
            at = run.end() - (run.end() < len(text))
            tokens += self.encoding._encode_single_piece(text[run.start():at])
        tokens += self.encoding.encode_ordinary(text[at:])
        return np.cumsum(self.size[np.array(tokens, np.int64)])


def allocate(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary.

    Tokens [start, end) are in order; sections [low, high) are sorted and don't overlap.  A token that touches
    one section belongs to it.  One that touches more goes to the ``first``, to the ``last``, or to the one with
    most of its characters (``majority``; the earlier one on a tie)."""
    if not len(low):
        return np.full(len(start), -1), np.zeros(len(start), bool)
    first = np.searchsorted(high, start, side="right")
    last = np.searchsorted(low, end, side="left") - 1
    owner = np.where(first <= last, first, -1)
    # a boundary inside the token: other sections, or text of no section
    inside = (owner >= 0) & (low[np.minimum(first, len(low) - 1)] <= start) & (high[np.minimum(first, len(low) - 1)] >= end)
    crossing = (owner >= 0) & ~inside
    if rule == "last":
        owner = np.where(owner >= 0, last, -1)
    elif rule == "majority":
        for t in np.flatnonzero(first < last):
            parts = range(first[t], last[t] + 1)
            owner[t] = max(parts, key=lambda i: (min(end[t], high[i]) - max(start[t], low[i]), -i))
    return owner, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of lines, each with its LF."""
    low, at = [], 0
    for line in text.split("\n"):
        low.append(at)
        at += len(line) + 1
    low = np.array(low, np.int64)
    high = np.append(low[1:], len(text))
    keep = high > low
    return low[keep], high[keep]


def count_tokens(docs: DataFrame, ranks: bytes, *, id_col: str = "doc_id", text_col: str = "text",
                 sections_col: str | None = None, rule: str = "majority") -> DataFrame:
    """Tokens per section: ``(id, section, start, end, n_tokens, n_crossing, doc_tokens)``.

    Sections are the lines of the text (each with its LF), or the character spans in ``sections_col``, an array of
    structs with ``start`` and ``end`` (sorted here; they must not overlap).  Every document is encoded whole and
    once; token spans are mapped to characters (a token inside a character counts as on that character) and
    located among the sections by binary search; tokens over a boundary follow ``rule`` (see ``allocate``).

    One row per section, numbered from 0 in order, and a row with a null section for tokens in no section, which
    stands also for null and empty texts (zero tokens).  Repeated rows give repeated results; null ids are kept;
    other columns are not read; null sections count as none.  Memory is bounded by the longest document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = {"id": id_col, "text": text_col} | ({"sections": sections_col} if sections_col else {})
    rows = take(docs, **columns)
    kind = rows.schema["id"].dataType.simpleString()
    if sections_col:
        rows = rows.withColumn("sections", F.transform("sections", lambda s: F.struct(
            s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            texts = batch.column("text")
            given = batch.column("sections").to_pylist() if sections_col else None
            at, done = 0, 0
            parts: list[tuple[np.ndarray, ...]] = []
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                if given is None:
                    low, high = line_sections(text)
                else:
                    spans = sorted((s["start"], s["end"]) for s in given[i] or [] if s and s["start"] is not None and s["end"] is not None)
                    low, high = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
                ends = tokenizer.byte_ends(text)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                if len(text) and not text.isascii():
                    raw = np.frombuffer(text.encode(), np.uint8)
                    chars = np.cumsum((raw & 0xC0) != 0x80)
                    ends, starts = chars[ends - 1], chars[starts] - 1
                owner, crossing = allocate(starts, ends, low, high, rule)
                k = len(low)
                tokens = np.bincount(owner + 1, minlength=k + 1)
                crossed = np.bincount(owner + 1, weights=crossing, minlength=k + 1).astype(np.int64)
                if not tokens[0] and k:  # no row for tokens outside all sections
                    part = (np.arange(k), low, high, tokens[1:], crossed[1:])
                else:
                    part = (np.arange(-1, k), np.append(-1, low), np.append(-1, high), tokens, crossed)
                parts.append((np.full(len(part[0]), i), *part, np.full(len(part[0]), len(ends))))
                done += len(part[0])
                if done >= 200_000 or i == len(batch) - 1:
                    row, section, low, high, tokens, crossed, total = map(np.concatenate, zip(*parts, strict=True))
                    none = section < 0
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row)), pa.array(section, pa.int32(), mask=none), pa.array(low, pa.int64(), mask=none),
                         pa.array(high, pa.int64(), mask=none), pa.array(tokens, pa.int64()), pa.array(crossed, pa.int64()), pa.array(total, pa.int64())],
                        names=["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])
                    parts, done = [], 0

    out = rows.mapInArrow(work, f"id {kind}, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)
