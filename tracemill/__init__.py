"""Spark-native record linkage and trace analytics.

The package is split into ``sources`` (scans, adapters, sinks), ``functions``
(column expressions), ``operators`` (DataFrame to DataFrame),
and ``streaming``.  ``llm`` is an optional subpackage with operators
for language-model training data; nothing else in the library imports it.
"""

__version__ = "0.1.0"
