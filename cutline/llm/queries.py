"""The operators of this package as registered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, collocations, fingerprints, jaccard, language, licences, media, mixing, quality, repeats, secrets, toxicity, variants

QUERIES = {
    "op1_media": media.op1_media,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_licences": licences.op3_licences,
    "op4_mix": mixing.op4_mix,
    "op5_quality": quality.op5_quality,
    "op6_repeats": repeats.op6_repeats,
    "op7_bpe": bpe.op7_bpe,
    "op8_language": language.op8_language,
    "op9_secrets": secrets.op9_secrets,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_variants": variants.op11_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_collocations": collocations.op13_collocations,
}

#: DuckDB SQL for the same rows. The other operators are tested against brute force in tests/llm.
SQL = {
    "op3_licences": licences.OP3_SQL,
    "op4_mix": mixing.OP4_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
