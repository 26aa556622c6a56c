"""The registered queries of this subpackage and their SQL."""

from . import bpe, chat, embed_dedup, exact_dedup, lm, merkle, mixing, pii, quality, secret_scan, sharding, simhash, whitening

MODULES = (sharding, exact_dedup, mixing, chat, pii, secret_scan, bpe, quality, simhash, embed_dedup, merkle, whitening, lm)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
