"""Plan shapes shared by the operators: split ordered scans, bounded top-k, fan-out."""

from rillflow.plans.scan import CHUNK, previous_value, trailing_count
from rillflow.plans.topk import top_per_key
from rillflow.plans.fanout import fan_out

__all__ = ["CHUNK", "fan_out", "previous_value", "top_per_key", "trailing_count"]
