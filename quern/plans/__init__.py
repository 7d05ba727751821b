"""Registered queries over the driver's tables."""

from . import audit_plans, claim_plans, cue_plans, data_plans, frame_plans, graph_plans, journal_plans, lineage_plans, score_plans, stream_plans, text_plans, trust_plans, typed_frame_plans, verify_plans  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
