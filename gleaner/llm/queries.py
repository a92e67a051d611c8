"""The operator queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import bpe_codec, exact_dedup, html_extract, language_id, mixing, ngram_join, packing, pii, suffix_dedup, token_align, url_filter, vector_dedup
from .common import table


def tokenizer_files():
    """Files and split pattern of the tokenizer that packing is measured in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark, sf_dir):
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_files())


def op4_pii(spark, sf_dir):
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark, sf_dir):
    _, ranks, pattern = tokenizer_files()
    encoded = bpe_codec.encode_texts(table(spark, sf_dir, "documents"), (ranks, pattern))
    return bpe_codec.digests(bpe_codec.decode_ids(encoded, ranks))


def op12_token_align(spark, sf_dir):
    import public_tokenizers

    return token_align.align(table(spark, sf_dir, "documents"), tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_vector_dedup, op3_packing, op4_pii, op5_html_extract, op6_language_id, op7_mixing, op8_exact_dedup, op9_url_filter, op10_ngram_join, op11_bpe_codec, op12_token_align)}


def oracle_sql():
    return {"op2_vector_dedup": vector_dedup.SQL, "op4_pii": pii.SQL, "op7_mixing": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL, "op9_url_filter": url_filter.SQL, "op10_ngram_join": ngram_join.SQL}
