"""The queries of this subpackage, and SQL for those that SQL can express."""

import corpus_pipeline
from packlens.llm import bpe, dedup, fingerprint, jaccard, langid, licenses, lines, packing, pii, substrings

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": langid.op1,
    "op2_bpe_round_trip": bpe.op2,
    "op3_personal_data": pii.op3,
    "op4_line_dedup": lines.op4,
    "op5_packing": packing.op5,
    "op6_jaccard_join": jaccard.op6,
    "op7_exact_dedup": dedup.op7,
    "op8_license_scan": licenses.op8,
    "op9_fingerprints": fingerprint.op9,
    "op10_substring_dedup": substrings.op10,
}
SQL = {"op6_jaccard_join": jaccard.OP6_SQL, "op7_exact_dedup": dedup.OP7_SQL, "op10_substring_dedup": substrings.OP10_SQL}
