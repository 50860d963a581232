"""All registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from tessera.plans import chunks, code, corpus, events, index, lifecycle, memory, patterns, readers, reasoning, rules, search, selection, sessions, stores, streams

_ALL = {**search.QUERIES, **lifecycle.QUERIES, **events.QUERIES, **corpus.QUERIES, **sessions.QUERIES, **selection.QUERIES, **streams.QUERIES, **reasoning.QUERIES, **readers.QUERIES, **rules.QUERIES, **memory.QUERIES, **index.QUERIES, **stores.QUERIES, **patterns.QUERIES, **chunks.QUERIES, **code.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
