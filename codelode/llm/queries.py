"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, fill_middle, jaccard, manifest, mixing, mtree, repeats, sharding, syncmers, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_syncmer_fingerprints": syncmers.op1,
    "op2_warc_archives": warc.op2,
    "op3_mixture": mixing.op3,
    "op4_hypergeometric_shards": sharding.op4,
    "op5_bpe_transducer": bpe.op5,
    "op6_toxicity": toxicity.op6,
    "op7_jaccard_groups": jaccard.op7,
    "op8_url_rules": url_filter.op8,
    "op9_token_counts": token_counts.op9,
    "op10_mtree_top_k": mtree.op10,
    "op11_fixed_block_repeats": repeats.op11,
    "op12_fill_in_middle": fill_middle.op12,
    "op13_merkle_manifest": manifest.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": warc.ORACLE,
    "op8_url_rules": url_filter.ORACLE,
    "op10_mtree_top_k": mtree.ORACLE,
    "op11_fixed_block_repeats": repeats.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
