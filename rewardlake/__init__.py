"""rewardlake: Spark-native analytics over recorded code-generation runs.

Every public function is either ``DataFrame -> DataFrame`` or
``Column -> Column`` so that Catalyst sees the whole plan.  Sub-packages:

* ``sources``   – table loaders, derived fixture views, file sources and sinks
* ``functions`` – Column-level text, patch and feedback expressions
* ``operators`` – relational operators (scoring, reports, joins, windows, ...)
* ``plans``     – the registered ``q_*`` queries and their DuckDB oracles
* ``streaming`` – Structured Streaming versions of the incremental operators

plus ``constants`` (values that must equal the producing code), ``session``
(local sessions, the shared checkpoint folder, cluster sizing) and
``shipping`` (worker-side functions pickled by value).
"""

__version__ = "0.1.0"
