"""notelake: retrieval, hygiene, synchronisation and digests of note corpora on Spark, and tools for training corpora."""

from notelake.api import build_index, corpus, embed_with, get, hashing_embedder, provider_of, resolve, search, semantic_search
from notelake.functions.schedule import next_tick, next_tick_of, run_on_schedule
from notelake.operators.digest import insights, markdown, summary, top_insights
from notelake.operators.hygiene import conflicts, consolidate, drift, migration_plan, stale_references, tag_plan, tag_proposals, unknown_topics
from notelake.operators.retrieval import Weights, blend, confidence_resolve, evaluate, render, tool_gate, topic_gate, topk
from notelake.operators.sync import merge_text, pull_plan, push_plan, replay, restore
from notelake.sources.corpus import load, load_golden, load_mapping, load_vocabulary, scan
from notelake.sources.state import Store
from notelake.streaming.watch import debounce, session_counts, streak_alerts

__all__ = """
    Store Weights blend build_index confidence_resolve conflicts consolidate corpus debounce drift embed_with evaluate get hashing_embedder insights load
    load_golden load_mapping load_vocabulary markdown merge_text migration_plan next_tick next_tick_of provider_of pull_plan push_plan render replay resolve
    restore run_on_schedule scan search semantic_search session_counts stale_references streak_alerts summary tag_plan tag_proposals tool_gate top_insights
    topic_gate topk unknown_topics
""".split()
