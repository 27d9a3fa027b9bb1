"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from loomwire.llm import licenses, lines, minhash, mixing, negatives, neighbors, packing, quality, shards, token_files, tool_calls, warc, whitening

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_shards": shards.op2_shards,
    "op3_tool_calls": tool_calls.op3_tool_calls,
    "op4_quality": quality.op4_quality,
    "op5_neighbors": neighbors.op5_neighbors,
    "op6_minhash": minhash.op6_minhash,
    "op7_lines": lines.op7_lines,
    "op8_packing": packing.op8_packing,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_negatives": negatives.op11_negatives,
    "op12_tokens": token_files.op12_tokens,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op1_licenses": licenses.OP1_SQL, "op3_tool_calls": tool_calls.OP3_SQL, "op4_quality": quality.OP4_SQL, "op6_minhash": minhash.OP6_SQL,
    "op9_warc": warc.OP9_SQL, "op11_negatives": negatives.OP11_SQL,
}
