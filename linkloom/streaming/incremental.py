"""Incremental linking with Structured Streaming.

Documents link statelessly against a snapshot, batch by batch; coreference over
conversations keeps each one's antecedent stack as keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import lexicons as lx
from ..operators.coref import RESOLVED, Stack, fold_stream
from ..plans.linking import Options, link

#: Antecedents that a stack keeps a conversation; those further back are out of sentence reach in practice.
STATE = "idx array<int>, kind array<string>, sentence array<int>, entity array<string>, named array<boolean>"


def link_stream(docs: DataFrame, entities: DataFrame, out: str, checkpoint: str, options: Options | None = None):
    """Start a query that appends the links of streamed docs(doc_id, text) to the folder ``out``; a batch that is run
    again overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        done = link(df, entities, None, options or Options(allow_ner_fallback=True))
        done.links.drop("candidates").write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coref_stream(mentions: DataFrame, threshold: float = lx.COREF_THRESHOLD, max_gap: int = lx.MAX_SENTENCE_GAP) -> DataFrame:
    """Streamed mentions (doc_id, idx, mention, mention_type, sentence_index, role, entity_id) resolved against the stack
    of their document. Sentences further back than max_gap leave the state, but for the two last names."""

    def run(key: tuple, it: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        stack = Stack(threshold, max_gap, [(int(i), k, int(s), e, bool(n)) for i, k, s, e, n in held])
        yield from fold_stream(it, stack)
        last = max((h[2] for h in stack.held), default=0)
        names = [h for h in stack.held if h[4]][-2:]
        keep = [h for h in stack.held if last - h[2] <= max_gap or h in names]
        state.update(tuple(map(list, zip(*keep, strict=True))) if keep else ([], [], [], [], []))

    return mentions.groupBy("doc_id").applyInPandasWithState(run, RESOLVED, STATE, "append", GroupStateTimeout.NoTimeout)
