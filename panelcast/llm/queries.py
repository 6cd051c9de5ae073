"""The registered queries of this subpackage and, where SQL can express them, their SQL.

Each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import jaccard_join, name_join, prefix_trie, quality_classifier, quality_rules, secrets, sharding, toxicity, url_filter, vector_search
from .bpe import encode
from .common import read
from .packing import pack
from .token_counts import count_tokens


def op1_byte_bpe(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_nearest(spark, sf_dir):
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_quality_rules(spark, sf_dir):
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir, "documents"))


def op11_name_join(spark, sf_dir):
    return name_join.count_matches(read(spark, sf_dir, "clients"), read(spark, sf_dir, "vendors"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.digest(read(spark, sf_dir, "conversations"))


def op13_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_url_filter, op3_packing, op4_toxicity, op5_token_counts, op6_quality_classifier, op7_nearest, op8_quality_rules, op9_jaccard_join, op10_secrets, op11_name_join, op12_prefix_trie, op13_sharding)}
ORACLES: dict[str, str] = {"op2_url_filter": url_filter.oracle_sql(), "op9_jaccard_join": jaccard_join.oracle_sql(), "op10_secrets": secrets.oracle_sql()}
ORACLES |= {"op11_name_join": name_join.oracle_sql(), "op12_prefix_trie": prefix_trie.oracle_sql(), "op13_sharding": sharding.oracle_sql()}
