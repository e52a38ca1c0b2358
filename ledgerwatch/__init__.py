"""ledgerwatch: financial-crime, credit and liquidity analytics as Spark jobs."""

from ledgerwatch.session import build_session
from ledgerwatch.plans.workspace import Workspace

__all__ = ["Workspace", "build_session"]
