"""Operators that prepare training data."""

from . import divergence, licenses, lines, mixing, ngram_join, packing, periodic, pieces, secrets, toxicity, vectors, vptree, warc

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_toxicity_crf": toxicity.op2_toxicity_crf,
    "op3_embedding_range_join": vectors.op3_embedding_range_join,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_warc_salvage": warc.op5_warc_salvage,
    "op6_license_patience": licenses.op6_license_patience,
    "op7_vptree_ann": vptree.op7_vptree_ann,
    "op8_secret_ownership": secrets.op8_secret_ownership,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_mixture_packing": packing.op10_mixture_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_piece_encoding": pieces.op12_piece_encoding,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES = {
    "op1_source_mixing": mixing.OP1_SQL,
    "op3_embedding_range_join": vectors.OP3_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op5_warc_salvage": warc.OP5_SQL,
    "op7_vptree_ann": vptree.OP7_SQL,
    "op8_secret_ownership": secrets.OP8_SQL,
    "op9_ngram_jaccard": ngram_join.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_periodic_runs": periodic.OP13_SQL,
}
