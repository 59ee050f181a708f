"""Queries of this subpackage and their SQL, by name."""

from . import host_reputation, license_join, line_chunks, norm_topk, piece_encode, quality_ledger, quote_linking, retrieval_packing, simhash_bitslice, token_alignment, toxicity_nbsvm, warc_store

MODULES = (quote_linking, quality_ledger, warc_store, toxicity_nbsvm, piece_encode, retrieval_packing, host_reputation, norm_topk, line_chunks, simhash_bitslice, token_alignment, license_join)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
