"""The registered queries by topic. Importing this package fills the registry."""

from shelfmine.plans.suites import (  # noqa: F401
    conversations,
    library,
    parsing,
    retrieval,
    telemetry,
)
