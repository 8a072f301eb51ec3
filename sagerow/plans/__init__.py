"""Named queries over the driver tables (import registers them)."""

from . import analytics, bpe, corpus, curation, evaluation, streams, tasks, text  # noqa: F401
from .registry import ORACLES, OPERATORS, QUERIES, UNSTATED  # noqa: F401
