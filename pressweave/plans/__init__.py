"""Query plans by theme; importing this package registers them all."""

from . import clusters, feeds, grouping, ingest, places, queues, readers, reading, selection, stories, streams, sync, texts, upkeep, world  # noqa: F401
