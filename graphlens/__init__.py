"""Analytics over large, versioned dependency graphs held as DataFrames.

A graph is three tables: nodes(node, props, labels), node_metrics(node, metric, value) and
edges(src, dst, kind, tag, type_key, edge_name, branch, edge_ord).
"""
