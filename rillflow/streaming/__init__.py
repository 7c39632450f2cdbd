"""Structured Streaming: the batch operators inside ``foreachBatch``."""

from rillflow.streaming.ingest import Ingest
from rillflow.streaming.courier import Courier, Policy, Target
from rillflow.streaming.deliver import Delivery
from rillflow.streaming.windows import activity_by_hour, first_versions

__all__ = ["Courier", "Delivery", "Ingest", "Policy", "Target", "activity_by_hour", "first_versions"]
