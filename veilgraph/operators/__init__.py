"""Graph operators over edges(u, v) with u < v and vertices(id)."""
