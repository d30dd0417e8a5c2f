"""Raw snapshots, connectors, and the ingestion plan."""

from .connectors import FetchRequest, Connector, connector_for, list_connectors, plan_for
from .rawzone import RawZone, Snapshot

__all__ = ["Connector", "FetchRequest", "RawZone", "Snapshot", "connector_for", "list_connectors", "plan_for"]
