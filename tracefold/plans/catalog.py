"""Import every query module so the registry is complete."""

from tracefold.plans import q_traces, q_steps, q_text, q_curation, q_sources, q_grammar, q_inventory, q_streaming  # noqa: F401
from tracefold.plans.registry import REGISTRY  # noqa: F401
