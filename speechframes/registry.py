"""The registered queries of the speech-session operators and their DuckDB equivalents."""

from __future__ import annotations

from speechframes.plans import crops, ordering, streams, timed

QUERIES = timed.QUERIES | streams.QUERIES | ordering.QUERIES | crops.QUERIES
ORACLES = timed.ORACLES | streams.ORACLES | ordering.ORACLES | crops.ORACLES
FLAGSHIP = timed.speaker_segments
