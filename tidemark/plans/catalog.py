"""All queries of the event-study engine and their ANSI-SQL counterparts."""

from tidemark.plans import q_bars, q_clean, q_features, q_inference, q_models, q_more, q_parts, q_sources, q_strategies, q_streams  # noqa: F401
from tidemark.plans.registry import LATE, ORACLES, QUERIES

for _name, _text in LATE.items():
    ORACLES[_name] = _text()

__all__ = ["ORACLES", "QUERIES"]
