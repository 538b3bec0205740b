"""All registered queries of this folder."""

from affinium.llm import chat, decontaminate, divergence, exact, language, language_model, minhash, packing, rabit, secrets, sharding, toxicity, whitening  # noqa: F401
from affinium.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
