"""Edge-list sources and sinks."""

from .edge_lists import append_runs, co_occurrence, followed, load_method, order_chain, read_csr, read_edges, read_weighted_edges, transition_degrees, user_transitions, write_edges, write_results, write_table

__all__ = ["append_runs", "co_occurrence", "followed", "load_method", "order_chain", "read_csr", "read_edges", "read_weighted_edges", "transition_degrees", "user_transitions", "write_edges", "write_results", "write_table"]
