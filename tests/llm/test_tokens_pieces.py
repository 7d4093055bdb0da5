import os
import random
import re

import numpy as np
import pytest
import sentencepiece
from helpers import AWKWARD, got, order, table

from cohortlens.llm import pieces, tokens

TOKENIZERS = os.environ.get("COHORTLENS_TOKENIZERS", "/opt/tokenizers")
RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary files here")


def attribute(text, spans, ends, rule):
    """Token by token over character sets."""
    raw, counts, crossing, nowhere = text.encode(), [0] * len(spans), [0] * len(spans), 0
    at_char, k = [], -1
    for b in raw:
        k += (b & 0xC0) != 0x80
        at_char.append(k)
    start = 0
    for end in ends:
        chars = set(at_char[start:end])
        shares = [len(chars & set(range(a, b))) for a, b in spans]
        touched = [i for i, s in enumerate(shares) if s]
        if not touched:
            nowhere += 1
        else:
            i = {"first": touched[0], "last": touched[-1], "majority": max(touched, key=lambda i: (shares[i], -i))}[rule]
            counts[i] += 1
            crossing[i if rule == "last" else i] += shares[touched[0]] < len(chars)
        start = end
    return counts, crossing, nowhere


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_lines_and_given_sections(spark, rule):
    raw = tokens.read_ranks(RANKS)
    tokenizer = tokens.Tokenizer(raw)
    rows = [r for r in AWKWARD if len(r[1] or "") < 1000] + [(9, "a\n\n\n  b\n"), (10, "日本語テキスト\nです")]
    df = tokens.count_tokens(table(spark, rows), raw, rule=rule)
    want = []
    for i, text in rows:
        text = text or ""
        spans, at = [], 0
        for line in text.split("\n"):
            end = min(at + len(line) + 1, len(text))
            spans += [(at, end)] if end > at else []
            at = end
        ends = tokenizer.byte_ends(text).tolist()
        counts, _, nowhere = attribute(text, spans, ends, rule)
        want += [(i, k, n, len(ends)) for k, n in enumerate(counts)] + ([(i, None, nowhere, len(ends))] if nowhere or not spans else [])
    assert got(df, "doc_id", "section", "n_tokens", "doc_tokens") == order(want)

    text = "Title words here. Body of the text, unbelievably long."
    given = [(1, text, [(0, 9), (9, 20), (25, 40)]), (2, text, None), (3, None, [(0, 5)]), (4, "", []), (5, text, [(30, 33), (2, 4)])]
    docs = spark.createDataFrame(given, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    df = tokens.count_tokens(docs, raw, sections_col="parts", rule=rule)
    want = []
    for i, t, spans in given:
        spans, t = sorted(spans or []), t or ""
        ends = tokenizer.byte_ends(t).tolist()
        counts, crossing, nowhere = attribute(t, spans, ends, rule)
        want += [(i, k, n, c) for k, (n, c) in enumerate(zip(counts, crossing, strict=True))]
        want += [(i, None, nowhere)] if nowhere or not spans else []
    assert [r[:4] if r[1] is not None else r[:3] for r in got(df, "doc_id", "section", "n_tokens", "n_crossing")] == order(want)


def test_token_counts_without_rows_and_bad_rule(spark):
    raw = tokens.read_ranks(RANKS)
    assert tokens.count_tokens(table(spark).limit(0), raw).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(table(spark), raw, rule="half")
    long = got(tokens.count_tokens(table(spark, [(7, AWKWARD[10][1])]), raw), "section", "n_tokens", "doc_tokens")
    assert len(long) == 1 and long[0][1] == long[0][2]


def small_vocabulary():
    names = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bab", "c", "▁▁"]
    scores = [0.0, -2.0, -1.0, -1.5, -1.75, -2.25, -3.0, -2.5, -4.0, -4.25, -1.0, -2.0]
    names += [f"<0x{b:02X}>" for b in range(256)]
    return pieces.Vocabulary(tuple(names), tuple(scores + [0.0] * 256), tuple(range(12, 268)), frozenset({0}), 0)


def best_score(v, s, penalty):
    usual = {p: v.scores[i] for i, p in enumerate(v.pieces) if i not in v.fixed and i not in v.byte_ids}
    best = [0.0] + [float("-inf")] * len(s)
    for end in range(1, len(s) + 1):
        for p, x in usual.items():
            if end >= len(p) and s[end - len(p):end] == p:
                best[end] = max(best[end], best[end - len(p)] + x)
        if s[end - 1] not in usual:
            best[end] = max(best[end], best[end - 1] + penalty)
    return best[-1]


def test_viterbi_is_optimal_and_exactly_invertible():
    v, random_ = small_vocabulary(), random.Random(5)
    encoder, decoder = pieces.Encoder(v), pieces.Decoder(v)
    for _ in range(1500):
        text = "".join(random_.choice("aabb c▁é") for _ in range(random_.randint(0, 14)))
        ids = np.frombuffer(encoder.encode(text), np.int32)
        data, _ = decoder.decode(ids, np.array([len(ids)]))
        assert data.tobytes().decode() == text
        if text:
            s = pieces.BLANK + text.replace(pieces.BLANK, "?").replace(" ", pieces.BLANK)
            odd = sum(c in "?é" for c in s)
            score = sum(v.scores[i] for i in ids if i < 12) + odd * encoder.penalty
            assert score == pytest.approx(best_score(v, s, encoder.penalty))


def varint(raw, i):
    value = shift = 0
    while True:
        b = raw[i]
        value |= (b & 127) << shift
        shift, i = shift + 7, i + 1
        if b < 128:
            return value, i


def as_unigram(raw):
    """The model file with its kind set to unigram: field 3 of the trainer settings, which are field 2."""
    out, i = bytearray(raw), 0
    while i < len(raw):
        tag, i = varint(raw, i)
        size, i = varint(raw, i)
        if tag >> 3 == 2:
            j = i
            while j < i + size:
                tag, at = varint(raw, j)
                if tag == 3 << 3:
                    out[at] = 1
                    return bytes(out)
                value, after = varint(raw, at)
                j = {0: after, 2: after + value, 5: at + 4, 1: at + 8}[tag & 7]
        i += size


def test_segmentation_scores_as_well_as_the_public_library():
    v = pieces.read_vocabulary(MODEL)
    encoder = pieces.Encoder(v)
    with open(MODEL, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(f.read()))
    for text in ("Hello world", "The  quick brown fox, jumps over the lazy dog.", "naïve café über", "a" * 50, "internationalization of things"):
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert sum(v.scores[i] for i in ids) == pytest.approx(sum(v.scores[i] for i in library.encode(text)), rel=1e-6)
        assert library.decode(ids) == text


def test_encode_and_decode_tables(spark):
    v = pieces.read_vocabulary(MODEL)
    encoded = pieces.encode_pieces(table(spark), v)
    assert all(r["round_trip"] for r in encoded.collect())
    decoded = pieces.decode_pieces(encoded, v)
    assert got(decoded, "doc_id", "text") == order([(i, t or "") for i, t in AWKWARD])
    counts = {(r["doc_id"], r["n_pieces"]) for r in encoded.collect()}
    assert (3, 0) in counts and (4, 0) in counts
    assert pieces.encode_pieces(table(spark).limit(0), v).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, v.byte_ids[255]])], "doc_id long, ids array<int>")
    assert got(pieces.decode_pieces(odd, v), "doc_id", "text") == [(1, ""), (2, ""), (3, "�")]


def test_long_white_space_gives_the_same_tokens(monkeypatch):
    tokenizer = tokens.Tokenizer(tokens.read_ranks(RANKS))
    rng = random.Random(4)
    texts = ["".join(rng.choice([" ", "\n", "\t", "　", "\x85", "\x1f", " a", "B", "'s", "1", "é", "!"]) * rng.choice([1, 1, 2, 7]) for _ in range(40)) for _ in range(300)]
    plain = [np.cumsum(tokenizer.size[np.array(tokenizer.encoding.encode_ordinary(t), np.int64)]).tolist() for t in texts]
    monkeypatch.setattr(tokens, "LONG_SPACE", re.compile(tokens.LONG_SPACE.pattern.replace("4096", "2")))
    assert [tokenizer.byte_ends(t).tolist() for t in texts] == plain


@pytest.mark.parametrize("unit", [" ", "\n", " \n\t　"])
@pytest.mark.parametrize(("head", "tail"), [("", ""), ("a", "b"), ("", " 7"), ("x\n", "")])
def test_five_million_white_characters(unit, head, tail):
    """The tokens of a long run repeat those of a shorter one that the pattern can take."""
    tokenizer = tokens.Tokenizer(tokens.read_ranks(RANKS))
    long, short = (tokenizer.byte_ends(head + unit * (n // len(unit)) + tail) for n in (5_000_000, 4_000))
    sizes, few = np.diff(long, prepend=0), np.diff(short, prepend=0)
    assert long[-1] == len((head + unit * (5_000_000 // len(unit)) + tail).encode())
    assert sizes[:20].tolist() == few[:20].tolist() and set(sizes[:-20]) <= set(few)
    assert len(sizes) == pytest.approx(len(few) * 1250, rel=0.02)


def test_long_white_space_through_spark(spark):
    rows = [(1, " " * 1_000_000), (2, "a" + "\t" * 1_000_000 + "b"), (3, "c d")]
    df = tokens.count_tokens(table(spark, rows), tokens.read_ranks(RANKS))
    tokenizer = tokens.Tokenizer(tokens.read_ranks(RANKS))
    assert got(df, "doc_id", "doc_tokens") == [(i, len(tokenizer.byte_ends(t))) for i, t in rows]
