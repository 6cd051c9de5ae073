"""Token counts by a two-tier look-up on the map side; no pre-token is ever shuffled.

Tier one is a broadcast table of the lengths of the corpus's most frequent pre-tokens. They are counted in an even sample of
``sample`` documents, drawn over all of the table, in one task; ``tier1`` pre-tokens of at most ``LONGEST`` bytes are kept, so the
table has a fixed bound. It travels compactly (one blob, the ends and the lengths) and each worker unpacks it into a hash table.
Tier two is each worker's bounded cache: a pre-token that is not in tier one is encoded once by the library's merges and its
length kept. The sample decides speed only; counts are exact and cover all rows.

Defined results: null text is empty; an empty text has 0 tokens; a null doc_id stays null; further columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices
from .pretokens import CACHE, coder, is_byte_level, splitter

#: Documents sampled for tier one, bytes of a text that the sample may hold, entries of tier one, and bytes of an entry.
SAMPLE, MOST, TIER1, LONGEST = 4_000, 1 << 16, 50_000, 64
_OUT = "doc_id long,n_bytes long,n_tokens long,over_limit boolean"


Table = tuple[bytes, bytes, bytes]


def packed(lengths: dict[bytes, int]) -> Table:
    """Pre-tokens and their lengths as (UTF-8 blob, ends as unsigned 32-bit numbers, lengths as bytes)."""
    return b"".join(lengths), np.cumsum([len(w) for w in lengths]).astype(np.uint32).tobytes(), bytes(lengths.values())


def frequent_table(docs: DataFrame, path: str, sample: int = SAMPLE, tier1: int = TIER1) -> Table:
    """The lengths of the most frequent pre-tokens of an even sample of about ``sample`` documents."""
    rows = docs.count()
    if not rows:
        return packed({})
    some = docs.select("text").sample(min(1.0, sample / rows), 1).where(F.octet_length("text") <= MOST)

    def count(batches):
        seen: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if pattern := splitter(t):
                    seen.update(pattern.findall(t))
        one = coder(path).library._core_bpe.encode_single_piece
        kept = [w for w in (w.encode() for w, _ in seen.most_common(tier1)) if len(w) <= LONGEST]
        yield batch(arrow_schema("blob binary,ends binary,lengths binary"), [[x] for x in packed({w: len(one(w)) for w in kept})])

    # texts of the bounded sample meet in one task; pre-tokens are never shuffled
    found = some.repartition(1).mapInArrow(count, "blob binary, ends binary, lengths binary").first()
    return tuple(map(bytes, found)) if found else packed({})


class Lengths(dict):
    """Pre-token to number of tokens: tier one, then what this worker met."""

    def __init__(self, table: Table, encode, cache: int = CACHE):
        blob, ends = table[0], np.frombuffer(table[1], np.uint32).tolist()
        self._tier1 = {blob[a:b].decode(): n for a, b, n in zip([0, *ends], ends, table[2], strict=False)}
        self._encode, self._most = encode, cache + len(self._tier1)
        super().__init__(self._tier1)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self._most:
            self.clear()
            self.update(self._tier1)
        self[piece] = n = len(self._encode(piece.encode()))
        return n


@lru_cache(maxsize=2)
def _lengths(path: str, table: Table) -> Lengths:
    return Lengths(table, coder(path).library._core_bpe.encode_single_piece)


def _library(path: str):
    """Counts by the library itself, for vocabularies that are not byte-level."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each whole text."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(frequent_table(docs, path)) if path.endswith(".json") and is_byte_level(path) else None
    out = arrow_schema(_OUT)

    def count(batches):
        if table is None:
            counts = _library(path)
        else:
            c, lengths = coder(path), _lengths(path, table.value)

            def plain(text):
                pattern = splitter(text)
                return len(c.library.encode_ordinary(text)) if pattern is None else sum(map(lengths.__getitem__, pattern.findall(text)))

            def one(text):
                if not any(s in text for s in c.special):
                    return plain(text)
                return sum(1 if x in c.special else plain(x) for x in c._parts.split(text) if x)

            counts = lambda texts: [one(t) for t in texts]
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = counts(texts)
            yield batch(out, [b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n]])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, _OUT)
