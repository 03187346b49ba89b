"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from .fingerprints import op9_fingerprints
from .jaccard import OP7_SQL, op7_jaccard_join
from .lm import op6_lm_scores
from .merkle import OP12_SQL, op12_merkle
from .packing import op5_packing
from .pieces import op3_sentencepiece
from .quality import op8_quality
from .sharding import op4_sharding
from .substrings import OP2_SQL, op2_substrings
from .topk import OP1_SQL, op1_topk
from .toxicity import op10_toxicity
from .variants import OP11_SQL, op11_spelling
from .warc import OP13_SQL, op13_warc

ROOT = str(Path(__file__).resolve().parents[2])


def _ready(query: Callable) -> Callable:
    """Let Python workers import this package wherever the session was started."""

    @wraps(query)
    def run(spark, sf_dir):
        places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in places:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, places)])
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    named = {"op1_topk": op1_topk, "op2_substrings": op2_substrings, "op3_sentencepiece": op3_sentencepiece, "op4_sharding": op4_sharding, "op5_packing": op5_packing, "op6_lm_scores": op6_lm_scores, "op7_jaccard_join": op7_jaccard_join, "op8_quality": op8_quality, "op9_fingerprints": op9_fingerprints, "op10_toxicity": op10_toxicity, "op11_spelling": op11_spelling, "op12_merkle": op12_merkle, "op13_warc": op13_warc}
    import corpus_pipeline

    named["pipeline"] = corpus_pipeline.run
    return {name: _ready(query) for name, query in named.items()}


def oracles() -> dict:
    return {"op1_topk": OP1_SQL, "op2_substrings": OP2_SQL, "op7_jaccard_join": OP7_SQL, "op11_spelling": OP11_SQL, "op12_merkle": OP12_SQL, "op13_warc": OP13_SQL}
