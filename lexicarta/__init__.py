"""lexicarta: labelled-text corpus analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames keyed by a stable id
(``doc_id`` unless stated otherwise).  Work is expressed with built-in
Spark SQL expressions so Catalyst can prune, push down and code-generate
it; Python only appears inside Arrow-batched scoring (``operators.scoring``)
and on the driver for bounded model state (weights, parameters).
"""

__version__ = "0.1.0"
