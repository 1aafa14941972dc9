"""Queries of the training-data operators and their SQL, where SQL can express them."""

from tallyforge.llm import op01_ngram_join as op01
from tallyforge.llm import op02_mixing as op02
from tallyforge.llm import op03_quality as op03
from tallyforge.llm import op04_line_dedup as op04
from tallyforge.llm import op05_licenses as op05
from tallyforge.llm import op06_fingerprints as op06
from tallyforge.llm import op07_pii as op07
from tallyforge.llm import op08_html as op08
from tallyforge.llm import op09_warc as op09
from tallyforge.llm import op10_decontaminate as op10

QUERIES = {
    "op1_ngram_jaccard_join": op01.op1_ngram_jaccard_join,
    "op2_source_mixing": op02.op2_source_mixing,
    "op3_quality_classifier": op03.op3_quality_classifier,
    "op4_line_dedup": op04.op4_line_dedup,
    "op5_license_scan": op05.op5_license_scan,
    "op6_order_minhash": op06.op6_order_minhash,
    "op7_pii_spans": op07.op7_pii_spans,
    "op8_html_main_text": op08.op8_html_main_text,
    "op9_warc_roundtrip": op09.op9_warc_roundtrip,
    "op10_benchmark_decontamination": op10.op10_benchmark_decontamination,
}

SQL = {
    "op1_ngram_jaccard_join": op01.SQL,
    "op4_line_dedup": op04.SQL,
    "op5_license_scan": op05.SQL,
    "op9_warc_roundtrip": op09.SQL,
}
