"""Quality-control metrics of instrument runs, merged and summarised with Spark."""

from runledger.config import LedgerConfig, Metric, default_config
from runledger.ledger import Ledger
from runledger.session import build_session

__all__ = ["Ledger", "LedgerConfig", "Metric", "build_session", "default_config"]
