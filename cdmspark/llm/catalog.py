"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_extract import op5_html_extraction
from .mixing import OP7_SQL, op7_mixing
from .order_minhash import op10_order_minhash
from .periodic_runs import op13_periodic_runs
from .pieces import op4_sentencepiece
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op9_quality
from .simhash import op2_simhash
from .token_files import op8_token_files
from .token_counts import op11_token_counts
from .toxicity import op1_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extraction": op5_html_extraction,
    "op6_warc": op6_warc,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_order_minhash": op10_order_minhash,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_exact_dedup": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op12_prefix_trie": OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
