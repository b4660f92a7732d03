"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from wastelens.llm import (alignment, decontaminate, exact_dedup, html_text, language, merkle, mixture, personal, quality_rules, secrets,
                           sharding, simhash, token_binary)

MODULES = [mixture, html_text, language, exact_dedup, personal, simhash, sharding, decontaminate, token_binary, secrets, merkle, alignment, quality_rules]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
