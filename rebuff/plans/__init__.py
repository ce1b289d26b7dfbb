"""All registered queries."""
import importlib

from rebuff.plans.registry import ORACLES, QUERIES

for _m in ("panel_queries", "population_queries", "event_queries", "inference_queries", "trajectory_queries", "leadlag_queries", "bridge_queries", "contract_queries", "streaming_queries"):
    importlib.import_module(f"rebuff.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
