"""The contract queries and their SQL twins, where SQL can express them."""

from . import dedup, html, infill, lm, media, ordermin, packing, pieces, quality, setjoin, sharding, tokencounts, trie

QUERIES = {
    f.__name__: f
    for f in (
        lm.op1_lm_score, media.op2_jpeg_media, tokencounts.op3_token_rollup, quality.op4_fm_quality, html.op5_html_main_text,
        pieces.op6_piece_codec, setjoin.op7_ngram_jaccard, dedup.op8_exact_dedup, packing.op9_best_fit, sharding.op10_vector_shards,
        ordermin.op11_order_minhash, infill.op12_infill, trie.op13_prefix_trie,
    )
}
ORACLES = tokencounts.ORACLES | dedup.ORACLES | setjoin.ORACLES | infill.ORACLES | trie.ORACLES
