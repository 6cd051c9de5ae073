"""Encoding, counting and packing against the libraries."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelcast.llm import bpe, packing, token_counts

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [
    (None, None), (1, None), (2, ""), (3, "it's  <|endoftext|> x'll\x1c\x85 y \u00a0\u3000z 中文 😀 ՘ 1²½"), (4, "a" * 9000), (5, " \n" * 3000), (6, "ab " * 900 + "'" * 700 + " re're" * 300),
    (6, "ab " * 900 + "'" * 700 + " re're" * 300), (7, "é'll 12 ²³ œ— " * 400), (8, "   " * 900 + "xyz"), (9, "The quick brown fox. " * 500), (10, "<|endoftext|>" * 5), (11, "\r\n\t mixed\n\n\n lines  "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in TEXTS], "doc_id long, text string, n_tokens string, k long").repartition(3)


def rows(df, *cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (500, 40), (97, 11)])
def test_encode(docs, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in TEXTS:
        ids = np.array(lib.encode_ordinary(t or ""), np.uint32).tobytes()
        want.append((str(i), str(len(ids) // 4), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.encode(docs, MULTI, chunk, overlap), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_only_chunks_of_a_failed_zone_stay_together(spark):
    """A long pre-token or strange characters in the middle leave the rest cut; made-up texts are as the library has them."""
    words, odd = "some plain words 12, ", "\u0600\U0001e900"
    texts = [words * 40 + "a" * 90 + words * 40, words * 40 + odd * 20 + words * 40, "\u4e2d" * 300 + words * 20, words * 20 + "\u4e2d" * 300, odd + words * 60, "'" * 99 + words * 60]
    g = np.random.default_rng(5)
    texts += ["".join(g.choice(list("a b'  1\n,re\u00e9\u4e2d") + [odd, "  \n\t", "'re", "x" * 25], 400)) for _ in range(60)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MULTI, 100, 20).collect()}
    for i, t in enumerate(texts):
        ids = np.array(lib.encode_ordinary(t), np.uint32).tobytes()
        assert (got[i].ids_sha256, got[i].decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert all(got[i].n_pieces >= 10 for i in (0, 1, 4, 5)) and got[2].n_pieces >= 3 and got[3].n_pieces >= 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    path = P.path(name)
    if name.endswith(".json"):
        n = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for _, t in TEXTS], add_special_tokens=False)]
    else:
        import sentencepiece

        n = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for _, t in TEXTS])]
    want = sorted((str(i), str(len((t or "").encode())), str(k), str(k > 1024)) for (i, t), k in zip(TEXTS, n))
    assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_cache_limits_do_not_change_counts():
    from panelcast.llm.pretokens import coder

    one = coder(JSON).library._core_bpe.encode_single_piece
    lengths = token_counts.Lengths(token_counts.packed({w: len(one(w)) for w in (b" the", " é".encode(), b" zzqx")}), one, cache=2)
    words = [" alpha", " zzqx", " qqww", " é", " the", " wwqq"] * 3
    assert [lengths[w] for w in words] == [len(coder(JSON).library.encode_ordinary(w)) for w in words]


def test_tier_one_holds_the_most_frequent(spark):
    d = spark.createDataFrame([(i, "often often often seldom " + " rare" * (i == 3)) for i in range(40)] + [(None, None), (1, "")], "doc_id long, text string")
    blob, ends, lengths = token_counts.frequent_table(d, JSON, tier1=2)
    # twice in each text with a blank before it; the first word has none
    assert blob.startswith(b" often") and len(ends) == 8 and len(lengths) == 2
    assert token_counts.frequent_table(d.where("false"), JSON) == (b"", b"", b"")
    assert token_counts.frequent_table(d.where("text is null"), JSON) == (b"", b"", b"")


def test_pack(docs, spark):
    lib = Tokenizer.from_file(JSON)
    got = packing.pack(docs.where("doc_id is not null and doc_id != 6"), JSON).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t in TEXTS:
        if i is None or i == 6:
            continue
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048


def test_differencing():
    assert packing.difference([], 3) == []
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    g = np.random.default_rng(3)
    for k in (1, 2, 7, 40):
        sizes = g.integers(1, 500, 4 * k).tolist()
        w = packing.difference(sizes, k)
        assert sorted(i for x in w for i in x) == list(range(len(sizes))) and len(w) <= k
    sizes = [1100] * 10
    w = packing.windows_of(sizes)
    assert len(w) == 10  # two do not fit, so the count rises from 6


@pytest.mark.parametrize("tasks", [1, 32, 211])
def test_padding_is_small(spark, tasks):
    """Whatever the number of tasks that cut the texts."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(tasks)
    n = defaultdict(int)
    for r in packing.pack(d, JSON).collect():
        n[r.sequence_id] += r.length
    assert sum(n.values()) / (2048 * len(n)) > 0.99


def test_pack_repeated_and_null(docs, spark):
    """Rows of null doc_id and repeated rows are packed like others, each on its own."""
    lib, want, got, seen = Tokenizer.from_file(JSON), defaultdict(int), defaultdict(int), defaultdict(list)
    for i, t in TEXTS:
        want[i] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    for r in packing.pack(docs, JSON).collect():
        got[r.doc_id] += r.length
        seen[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for w in seen.values():
        ends = [0, *(a + n for a, n in sorted(w))]
        assert [a for a, _ in sorted(w)] == ends[:-1] and ends[-1] <= 2048


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, MULTI).count() == token_counts.count_tokens(none, JSON).count() == packing.pack(none, JSON).count() == 0
