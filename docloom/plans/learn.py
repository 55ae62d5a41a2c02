"""Nightly vocabulary learner for all tenants in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from docloom.operators import lexicon as L


@dataclass
class Learned:
    quoted: DataFrame
    gaps: DataFrame
    pairs: DataFrame
    new_documents: DataFrame
    kept_events: DataFrame
    pruned: DataFrame


def learn(queries: DataFrame, chunks: DataFrame, docs: DataFrame, lexicon: DataFrame, events: DataFrame, since: Column,
          as_of: Column, max_pairs: int | None = None) -> Learned:
    pairs = L.refinement_pairs(queries, since, max_pairs)
    kept, pruned = L.prune_events(events, as_of)
    return Learned(L.mine_quoted(queries, lexicon, since), L.mine_gaps(chunks, queries, lexicon, since), pairs,
                   L.new_documents(pairs, queries, chunks, docs), kept, pruned)
