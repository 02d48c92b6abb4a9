"""The queries opN_<name> of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from jobloom.llm import bpe, fingerprint, jaccard_join, licenses, lm, mixing, packing, quality, repeats, shards, spelling, tokenfiles, vectors

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1,
    "op2_quality_rules": quality.op2,
    "op3_sharding": shards.op3,
    "op4_fingerprints": fingerprint.op4,
    "op5_kneser_ney": lm.op5,
    "op6_repeats": repeats.op6,
    "op7_bpe": bpe.op7,
    "op8_mixing": mixing.op8,
    "op9_licenses": licenses.op9,
    "op10_token_files": tokenfiles.op10,
    "op11_vector_codes": vectors.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_packing": packing.op13,
}
SQL = {
    "op2_quality_rules": quality.SQL,
    "op8_mixing": mixing.SQL,
    "op11_vector_codes": vectors.SQL,
    "op12_spelling_variants": spelling.SQL,
}
