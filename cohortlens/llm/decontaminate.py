"""Benchmark decontamination: training words are streamed through a generalised suffix automaton of the normalised
test items, longest matching lengths are tracked, and spans or documents beyond limits are removed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import RangeHash, byte_class, byte_values, mix, runs, text_slices, upper_to_lower, word_bounds
from .common import Scratch, cut, take, text_key
from .vectors import parts

#: Digits, letters and everything beyond ASCII, as UTF-8 bytes.
WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Items of so many bytes make a block with an automaton of its own.
BLOCK_BYTES = 8 << 20
_FOLD = upper_to_lower()


def item_words(text: str | None) -> list[bytes]:
    """Normalised words of one item."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    s, e, _ = word_bounds(raw, np.array([0, len(raw)]), WORD)
    low = _FOLD[raw].tobytes()
    return [low[a:b] for a, b in zip(s, e, strict=True)]


@dataclass
class Automaton:
    """Generalised suffix automaton over the words of items.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window.  ``whole``
    has for a state the items whose window it holds; ``short`` the same for items shorter than a window, by length.
    Of the states on a state's suffix path, ``held`` is the one that holds its last window (-1: it is shorter), and
    ``nearest`` the first, itself included, with short items (0: none).
    """

    window: int
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    words: dict[bytes, int] = field(default_factory=dict)
    whole: dict[int, set[str | None]] = field(default_factory=dict)
    short: dict[int, dict[int, set[str | None]]] = field(default_factory=dict)
    held: list[int] = field(default_factory=list)
    nearest: list[int] = field(default_factory=list)
    least: int = 0

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    @classmethod
    def of(cls, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        self = cls(window)
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # a suffix link leads to a shorter state, so one pass by length settles what lies above every state
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.held = [-1] * len(self.length)
        for state in by_length:
            above = self.held[self.link[state]]
            self.held[state] = above if above >= 0 else state if self.length[state] >= window else -1
        for name, codes in coded:
            state, least = 0, min(window, len(codes))
            self.least = min(self.least or least, least)
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    self.whole.setdefault(self.held[state], set()).add(name)
            if len(codes) < window:
                # the state that the whole item leads to holds it
                self.short.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        self.nearest = [0] * len(self.length)
        for state in by_length:
            self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]
        return self

    def stream(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str | None]]:
        """Longest matching length that ends at each word, words hit by an occurring window, and items found."""
        n = len(words)
        matched, cover, found = np.zeros(n, np.int64), np.zeros(n + 1, np.int64), set()
        state = size = 0
        for i, word in enumerate(words):
            c = self.words.get(word)
            if c is None:
                state = size = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            matched[i] = size
            if size < self.least:
                continue
            if size >= self.window:
                found |= self.whole.get(self.held[state], set())
                cover[i + 1 - self.window] += 1
                cover[i + 1] -= 1
            s = self.nearest[state]
            while s:  # fewer steps than a window has words
                for k, names in self.short[s].items():
                    if k <= size:
                        found |= names
                        cover[i + 1 - k] += 1
                        cover[i + 1] -= 1
                s = self.nearest[self.link[s]]
        return matched, np.cumsum(cover[:-1]) > 0, found


class Screen:
    """Finds the runs of a text's words where a window can occur: every word, and every pair of neighbours, must
    occur among the items.  What it lets through is streamed through the automaton; hashes decide nothing."""

    BITS = 22

    def __init__(self, items: list[list[bytes]], least: int):
        self.least = least
        table = byte_values(fold_case=True)
        raw = np.frombuffer(b" ".join(b" ".join(w) for w in items), np.uint8)
        counts = np.array([len(w) for w in items], np.int64)
        s, e, _ = word_bounds(raw, np.array([0, len(raw)]), WORD)
        h = mix(RangeHash(raw, table)(s, e)) if len(s) else np.zeros(0, np.uint64)
        inner = np.ones(max(len(h) - 1, 0), bool)
        inner[np.cumsum(counts)[:-1][np.cumsum(counts)[:-1] < len(h)] - 1] = False
        self.table = table
        self.one, self.two = self._bits(h), self._bits(self.pair(h[:-1], h[1:])[inner])

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * np.uint64(0x9FB21C651E98DF25) + b)

    def _bits(self, h: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << self.BITS, bool)
        bits[h >> np.uint64(64 - self.BITS)] = True
        return bits

    def candidates(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of candidate runs."""
        h = mix(RangeHash(data, self.table)(s, e))
        shift = np.uint64(64 - self.BITS)
        known = self.one[h >> shift]
        if self.least <= 1:
            joined = known[:-1] & known[1:] & (row[:-1] == row[1:])
        else:
            both = np.flatnonzero(known[:-1] & known[1:] & (row[:-1] == row[1:]))
            joined = np.zeros(max(len(h) - 1, 0), bool)
            joined[both] = self.two[self.pair(h[both], h[both + 1]) >> shift]
        # a run of k joined neighbours is a run of k + 1 words
        linked = np.concatenate(([False], joined))
        first = np.flatnonzero(known & ~linked)
        last = np.flatnonzero(known & ~np.concatenate((joined, [False])))
        enough = last - first + 1 >= self.least
        return first[enough], last[enough] + 1


Block = list[tuple[str | None, list[bytes]]]


def _numbered(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Different items with the number of their block, and the number of blocks.  Blocks are dealt by hash and hold about
    ``limit`` bytes of text, or their one longest item."""
    once = items.distinct()
    blocks = parts(once.agg(F.sum(F.octet_length("text"))).first()[0] or 0, limit)
    return once.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), blocks


def _block(numbered: DataFrame, block: int) -> Block:
    """Names and words of one block's items, the only ones that the driver holds."""
    own = numbered.where(F.col("block") == block).select("id", "text").toArrow()
    return [(name, item_words(text)) for name, text in zip(own.column("id").to_pylist(), own.column("text").to_pylist(), strict=True)]


def find(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of whole documents that lie in an occurrence of an item's window.

    Returns ``(id, n_words, n_hit, n_items, items, longest, spans)`` per input row: ``items`` are the sorted ids (as
    text) of items with occurring windows, ``longest`` the longest match with items in words (0 if shorter than
    any window), ``spans`` the byte ranges from the first to the last word of maximal runs of hit words.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  The items are the stated
    query set: they are taken in blocks of ``block_bytes``, each with an automaton that is sent to the executors;
    documents pass each block.  Of several blocks one is held at a time, and that work runs when ``find`` is called.  Null and empty texts have no words and no hits; items with a null id hit words like
    others but are not among ``items``; items without words have no windows; repeated rows give equal results; rows of one id with other texts are kept
    apart; null ids stay; other columns are not read.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = take(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    asked = take(items, id=item_id_col, text=item_text_col).select(F.col("id").cast("string").alias("id"), "text")
    schema = f"id {kind}, n_words long, longest long, items array<string>, words array<int>, spans array<long>"
    keyed = rows.withColumn("key", text_key(F.col("text")))

    def against(block: Block, source: DataFrame, only_hits: bool):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scan(shared.value, window)
            for batch in batches:
                for lo, hi, data, offsets in text_slices(batch.column("text")):
                    out = {"id": batch.column("id").slice(lo, hi - lo)} | scan.records(data, offsets)
                    if "key" in batch.schema.names:
                        out["key"] = batch.column("key").slice(lo, hi - lo)
                    got = pa.RecordBatch.from_pydict(out)
                    yield got.filter(pc.greater(pc.list_value_length(got.column("words")), 0)) if only_hits else got

        return shared, source.mapInArrow(work, schema + ", key long" * ("key" in source.columns))

    numbered, blocks = _numbered(asked, block_bytes)
    if blocks == 1:
        return _named(against(_block(numbered, 0), rows, False)[1], id_col)
    with Scratch(spark) as scratch:
        # beyond one block: every document passes every block, only hits are shuffled
        numbered = scratch.put(numbered, "items")
        for block in range(blocks):
            shared, found = against(_block(numbered, block), keyed, True)
            found = found.withColumn("block", F.lit(block))
            found.write.mode("append").parquet(f"{scratch.path}/hits")
            shared.destroy()
        hits = spark.read.schema(found.schema).parquet(f"{scratch.path}/hits")
        # equal rows of one id are one row for each block
        hits = hits.groupBy("id", "key", "block").agg(*[F.first(c).alias(c) for c in ("longest", "items", "words", "spans")])
        base = against([], keyed, False)[1].select("id", "key", "n_words")
        merged = hits.groupBy("id", "key").agg(
            F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(
                "words", F.filter("spans", lambda _, i: i % 2 == 0).alias("start"), F.filter("spans", lambda _, i: i % 2 == 1).alias("end")))))).alias("hit"))
        none = F.array()
        found = (base.alias("b").join(merged.alias("m"), F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.key") == F.col("m.key")), "left")
                 .select("b.id", "n_words", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
                         F.coalesce("items", none.cast("array<string>")).alias("items"),
                         F.coalesce("hit.words", none.cast("array<int>")).alias("words"),
                         F.coalesce(F.flatten(F.transform("hit", lambda h: F.array(h["start"], h["end"]))), none.cast("array<bigint>")).alias("spans")))
        return cut(_named(found, id_col))


def _named(found: DataFrame, id_col: str) -> DataFrame:
    """The columns of ``find``; spans hold the byte range of every hit word, neighbours among the words make one range."""
    bounds = F.arrays_zip("words", F.filter("spans", lambda _, i: i % 2 == 0).alias("start"), F.filter("spans", lambda _, i: i % 2 == 1).alias("end"))
    ranges = F.aggregate(bounds, F.array().cast("array<struct<start:bigint,end:bigint,word:int>>"), lambda done, w: F.when(
        F.get(done, F.size(done) - 1)["word"] == w["words"] - 1,
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), w["end"].alias("end"), w["words"].alias("word")))))
        .otherwise(F.concat(done, F.array(F.struct(w["start"].alias("start"), w["end"].alias("end"), w["words"].alias("word"))))),
        lambda done: F.transform(done, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))))
    return found.select(F.col("id").alias(id_col), "n_words", F.size("words").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "longest",
                        ranges.alias("spans"))


class Scan:
    """One block of items against slices of texts."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]], window: int):
        self.automaton = Automaton.of(block, window)
        self.screen = Screen([w for _, w in block if w], self.automaton.least)

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """Words of each row; then per candidate run: row, first word within the row, hit words (positions and
        byte bounds), longest match and items."""
        s, e, row = word_bounds(data, offsets, WORD)
        n = len(offsets) - 1
        counts = np.bincount(row, minlength=n)
        first_word = np.concatenate(([0], np.cumsum(counts)))
        found = []
        if len(s) and self.automaton.least:
            for a, b in zip(*self.screen.candidates(data, s, e, row), strict=True):
                low = _FOLD[data[s[a]:e[b - 1]]].tobytes()
                at = s[a]
                matched, hit, items = self.automaton.stream([low[x - at:y - at] for x, y in zip(s[a:b], e[a:b], strict=True)])
                if hit.any():
                    w = np.flatnonzero(hit) + a
                    found.append((int(row[a]), w - first_word[row[a]], s[w], e[w], int(matched.max()), items))
        return counts, found

    def records(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        counts, found = self.hits(data, offsets)
        n = len(counts)
        items: list[set[str | None]] = [set() for _ in range(n)]
        words: list[list[int]] = [[] for _ in range(n)]
        spans: list[list[int]] = [[] for _ in range(n)]
        longest = np.zeros(n, np.int64)
        for row, at, start, end, most, names in found:
            items[row] |= names
            words[row].extend(at.tolist())
            spans[row].extend((np.stack([start, end], axis=1).ravel() - offsets[row]).tolist())
            longest[row] = max(longest[row], most)
        return {"n_words": pa.array(counts, pa.int64()), "longest": pa.array(longest), "items": pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())),
                "words": pa.array(words, pa.list_(pa.int32())), "spans": pa.array(spans, pa.list_(pa.int64()))}

    def clean(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """Texts without their hit spans (None where nothing is hit), cut words and words of each text.

        What is left is streamed again until no window occurs across a cut."""
        counts, found = self.hits(data, offsets)
        out: list[bytes | None] = [None] * len(counts)
        hit = np.zeros(len(counts), np.int64)
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        for row, at, start, end, _, _ in found:
            cuts.setdefault(row, []).extend(zip(at.tolist(), (start - offsets[row]).tolist(), (end - offsets[row]).tolist(), strict=True))
        for row, words in cuts.items():
            text = data[offsets[row]:offsets[row + 1]]
            while words:
                hit[row] += len(words)
                text = _without(text, words)
                _, again = self.hits(text, np.array([0, len(text)]))
                words = [w for _, at, start, end, _, _ in again for w in zip(at.tolist(), start.tolist(), end.tolist(), strict=True)]
            out[row] = text.tobytes()
        return out, hit, counts


def _without(text: np.ndarray, words: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """The text without hit words (position, first and end byte) and what stands between neighbours among them."""
    keep = np.ones(len(text), bool)
    last = None
    for at, start, end in sorted(words):
        keep[(last[1] if last and last[0] == at - 1 else start):end] = False
        last = (at, end)
    return text[keep]


def remove(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, without contaminated spans: maximal runs of hit words (with what
    stands between them) are cut from the text, and what is left is searched again until no window occurs across a
    cut.  A row whose cut words are more than ``max_coverage`` of its words is dropped.  Rows without hits, null and
    empty texts stay as they are.

    All items judge one text: the result doesn't depend on ``block_bytes``.  One block of items works on rows where
    they are.  Of several blocks, the hits of all are collected before a text is cut; cut texts pass all blocks again.
    That work runs when ``remove`` is called, one block at a time, and the cut texts are checkpointed."""
    names = docs.columns
    at = names.index(text_col)
    current = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    asked = take(items, id=item_id_col, text=item_text_col).select(F.col("id").cast("string").alias("id"), "text")
    numbered, blocks = _numbered(asked, block_bytes)
    if blocks > 1:
        key = F.sha2(F.col(f"_c{at}").cast("binary"), 256)
        changed = _cut_texts(current.select(key.alias("key"), F.col(f"_c{at}").alias("text")), numbered, blocks, window, max_coverage)
        joined = current.withColumn("_key", key).join(changed, F.col("_key") == F.col("key"), "left").where("key IS NULL OR NOT dropped")
        return joined.select(*[F.coalesce("text", c).alias(c) if c == f"_c{at}" else F.col(c) for c in current.columns]).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(_block(numbered, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(shared.value, window)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts, hit, counts = scan.clean(data, offsets)
                if hit.any():
                    old = part.column(at).to_pylist()
                    new = pa.array([o if t is None else t.decode() for o, t in zip(old, texts, strict=True)], part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), new).filter(pa.array(hit <= max_coverage * counts))
                yield part

    return current.mapInArrow(work, current.schema).toDF(*names)


def _cut_texts(texts: DataFrame, numbered: DataFrame, blocks: int, window: int, max_coverage: float) -> DataFrame:
    """``(key, text, dropped)`` of the texts with hits, one row per key: what is left of each, and whether more than
    ``max_coverage`` of its words were cut.  Equal texts have one key; only texts with hits are shuffled."""
    spark = texts.sparkSession
    kept = "key string, text string, n_words long, n_cut long"

    def search(block: Block, number: int, source: DataFrame):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scan(shared.value, window)
            for batch in batches:
                for lo, hi, data, offsets in text_slices(batch.column("text")):
                    part, got = batch.slice(lo, hi - lo), scan.records(data, offsets)
                    n_words = pc.coalesce(part.column("n_words"), got["n_words"])  # of the text as it came in
                    found = pa.RecordBatch.from_arrays(
                        [part.column("key"), part.column("text"), n_words, part.column("n_cut"), pa.array([number] * len(part), pa.int32()), got["words"], got["spans"]],
                        names=["key", "text", "n_words", "n_cut", "block", "words", "spans"])
                    yield found.filter(pc.greater(pc.list_value_length(got["words"]), 0))

        return shared, source.mapInArrow(work, kept + ", block int, words array<int>, spans array<long>")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cut_words = [], []
            for row in batch.to_pylist():
                words = set(zip(row["words"], row["spans"][::2], row["spans"][1::2], strict=True))
                out.append(_without(np.frombuffer(row["text"].encode(), np.uint8), words).tobytes().decode())
                cut_words.append(row["n_cut"] + len(words))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string()), batch.column("n_words"), pa.array(cut_words, pa.int64())],
                                             names=["key", "text", "n_words", "n_cut"])

    with Scratch(spark) as scratch:
        stored = scratch.put(numbered, "items")
        todo = texts.select("key", "text", F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_cut"))
        rounds = []
        while True:
            path = f"{scratch.path}/hits-{len(rounds)}"
            for number in range(blocks):
                shared, hits = search(_block(stored, number), number, todo)
                hits.write.mode("append").parquet(path)
                shared.destroy()
            hits = spark.read.schema(hits.schema).parquet(path)
            same = ["text", "n_words", "n_cut"]
            one = hits.groupBy("key", "block").agg(*[F.first(c).alias(c) for c in (*same, "words", "spans")])
            whole = one.groupBy("key").agg(*[F.first(c).alias(c) for c in same], *[F.flatten(F.collect_list(c)).alias(c) for c in ("words", "spans")])
            shorter = scratch.put(whole.mapInArrow(shorten, kept), f"cut-{len(rounds)}")
            rounds.append(shorter.withColumn("round", F.lit(len(rounds))))
            if shorter.isEmpty():
                break
            todo = shorter.where(F.col("n_cut") <= max_coverage * F.col("n_words"))
        every = rounds[0]
        for more in rounds[1:]:
            every = every.unionByName(more)
        last = every.groupBy("key").agg(F.max_by(F.struct("text", (F.col("n_cut") > max_coverage * F.col("n_words")).alias("dropped")), "round").alias("last"))
        return cut(last.select("key", "last.text", "last.dropped"))
