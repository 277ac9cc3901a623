"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

import corpus_pipeline
from weftline.llm import decontaminate, htmltext, language, licences, matroska, neardup, packing, quality, repeats, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_matroska_media": matroska.op1_matroska_media,
    "op2_licence_digests": licences.op2_licence_digests,
    "op3_language_id": language.op3_language_id,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_warc_normaliser": warc.op5_warc_normaliser,
    "op6_host_suffix_array": htmltext.op6_host_suffix_array,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_minhash_neardup": neardup.op8_minhash_neardup,
    "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_licence_digests": licences.oracle_sql(),
    "op5_warc_normaliser": warc.ORACLE_SQL,
}
