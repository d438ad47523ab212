"""Numbered queries against their DuckDB twins."""

import pytest

from barloom.llm.oracle import ORACLES
from barloom.llm.queries import QUERIES
from tests.compare import DATA, connect, differences

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_twin(spark, name):
    ours = QUERIES[name](spark, str(DATA / SF)).toPandas()
    assert differences(ours, connect(SF).execute(ORACLES[name]).df()) is None


def test_contract_columns(spark):
    """Names and types that the queries' contracts fix, on the smallest tables."""
    fixed = {
        "op1_rans_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op2_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op3_best_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op4_url_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op6_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op7_robust_outliers": {
            "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
        },
        "op9_katz_backoff": {
            "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
            "base_score": "double", "score": "double",
        },
        "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op11_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
        "op12_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op13_heap_centroids": {
            "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string",
        },
    }
    for name, columns in fixed.items():
        found = dict(QUERIES[name](spark, str(DATA / SF)).dtypes)
        assert columns.items() <= found.items(), name
