"""Queries of the numbered operators, by the names under which the driver runs them."""

from __future__ import annotations

from lodegraph.llm.codes import ORACLE as CODES, op11_codes
from lodegraph.llm.decontaminate import op4_decontamination
from lodegraph.llm.fingerprint import op7_fingerprint
from lodegraph.llm.merkle import ORACLE as MERKLE, op13_merkle
from lodegraph.llm.mixing import op3_mixing
from lodegraph.llm.ngram_join import op5_ngram_join
from lodegraph.llm.passages import op9_passages
from lodegraph.llm.pii import op6_pii
from lodegraph.llm.quality import op8_quality
from lodegraph.llm.secrets import op10_secrets
from lodegraph.llm.sharding import op2_sharding
from lodegraph.llm.token_ids import op12_token_ids
from lodegraph.llm.toxicity import op1_toxicity

_QUERIES = (op1_toxicity, op2_sharding, op3_mixing, op4_decontamination, op5_ngram_join, op6_pii, op7_fingerprint, op8_quality, op9_passages, op10_secrets, op11_codes, op12_token_ids, op13_merkle)

#: DuckDB SQL of the queries that SQL can express.
_ORACLES: dict[str, str] = {"op11_codes": CODES, "op13_merkle": MERKLE}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
