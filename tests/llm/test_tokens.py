import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwell.llm import bpe, packing, token_count
from maskwell.llm.queries import tokenizer_path

RANKS, JSON = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json")
ODD = ["a", "s", "t", "'", "re", "'s", "'ll", "'ve", " ", "  ", "\n", "\t", "1", "!", "é", "²", " ", "　", "中", "😀", "'d", "l", "́", "\x85", "\x1c", "X", "<|endoftext|>", "<|endof", "text|>"]
TEXTS = [None, "", " ", "it's  what they'll\n\nsay ", "ab" * 400, "é" * 300, "x " * 500 + "'" * 7, "<|endoftext|>a<|endoftext|>", "word"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}), Tokenizer.from_file(JSON)


def frame(spark, texts):
    rows = [(i if i != 3 else None, t, t, 5, "x") for i, t in enumerate([*texts, texts[-1]])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int, ids string")


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_equal_both_libraries(library, text):
    ranks, json_enc = bpe.encoder(RANKS), bpe.json_encoder(JSON)
    raw = ranks.encode_batch([text])[0]
    assert ids_of(raw) == library[0].encode_ordinary(text)
    assert ranks.decode(raw) == text.encode()
    assert ids_of(json_enc.encode_batch([text])[0]) == library[1].encode(text, add_special_tokens=False).ids


def test_long_pieces_and_offsets(library):
    rnd = random.Random(5)
    for text in ("a" * 5000, "".join(rnd.choice("abcdefgh") for _ in range(20000)), " " * 3000 + "x", "ß" * 2000):
        assert ids_of(bpe.encoder(RANKS).encode_batch([text])[0]) == library[0].encode_ordinary(text)
    for token, a, b in bpe.encoder(RANKS).offsets("né, it's"):
        assert bpe.encoder(RANKS).tokens[token] == "né, it's".encode()[a:b]


def test_the_monoid_is_associative_and_small():
    _, _, times, *_ = bpe._tables()
    n = len(times)
    assert n < 64
    assert all(times[times[a, b], c] == times[a, times[b, c]] for a in range(n) for b in range(n) for c in range(n))


def test_encode_documents(spark, library):
    got = bpe.encode_documents(frame(spark, TEXTS), RANKS, keep_ids=True).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        if i != 3:
            want = library[0].encode_ordinary(t or "")
            assert by[i].n_tokens == len(want) and by[i].ids == want
            assert by[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, TEXTS).limit(0), RANKS).count() == 0
    back = bpe.decode_documents(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), RANKS)
    assert sorted(map(repr, (r.text for r in back.collect()))) == sorted(map(repr, [t or "" for t in [*TEXTS, TEXTS[-1]]]))


@pytest.mark.parametrize("chunk,overlap", [(7, 4), (20, 8), (13, 1), (64, 16)])
def test_spliced_counts(library, chunk, overlap):
    rnd, enc = random.Random(chunk), bpe.json_encoder(JSON)
    for _ in range(400):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80)))
        assert token_count.count_spliced(enc, text, chunk, overlap) == len(library[1].encode(text, add_special_tokens=False).ids)


def test_count_tokens(spark, library, monkeypatch):
    texts = [*TEXTS, "a" * 70_000, "ab cd " * 30_000]
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, texts), JSON).collect()}
    for i, t in enumerate(texts):
        if i != 3:
            n = len(library[1].encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_count.count_tokens(frame(spark, texts).limit(0), JSON).count() == 0


def test_packing(spark, library):
    rnd = random.Random(2)
    texts = [*TEXTS, *(" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 3000))) for _ in range(60))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack_documents(df, JSON).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert len(pieces) == len(texts)
    total = 0
    for i, t in enumerate(texts):
        ids = [*library[1].encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and own[0].length == (len(ids) - 1) % 2048 + 1
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= 1.15 * total / 2048 + 1
    assert packing.pack_documents(df.limit(0), JSON).count() == 0


def test_the_fullest_bin_closes_first():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_counts_take_a_time_in_proportion_to_one_word(library):
    import time

    enc = bpe.json_encoder(JSON)
    for text in ("ab" * 30_000, "中" * 70_000, " " * 100_000 + "x", "word " * 20_000 + "x" * 90_000 + " end"):
        assert token_count.count_spliced(enc, text) == len(library[1].encode(text, add_special_tokens=False).ids)
    begin = time.time()
    for text in ("ab" * 2_000_000, "中文" * 700_000, " " * 4_000_000, "0123456789abcdef" * 250_000):
        assert token_count.count_spliced(enc, text) > 0
    assert time.time() - begin < 90


def test_the_table_of_pieces_is_exact_when_it_is_full(library):
    rnd, enc = random.Random(3), bpe.BytePairEncoder(RANKS)
    enc.table.most = 500
    for _ in range(20):
        text = " ".join("".join(rnd.choice("abé\x00'") for _ in range(rnd.randint(1, 20))) for _ in range(300))
        assert ids_of(enc.encode_batch([text])[0]) == library[0].encode_ordinary(text)
