"""Shrinking and cleaning large tables of JSON payloads and crawled pages with Spark."""

import sys

from pyspark import cloudpickle

# Workers get the helper functions with the task, they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from slim.functions.sql import register_functions  # noqa: E402
from slim.operators.leaves import leaves, parse_payloads, payload_leaves, spread  # noqa: E402
from slim.operators.markup import to_markdown  # noqa: E402
from slim.operators.paths import Any, Descend, Index, Key, Slice, Where, collapse_matches, select_path  # noqa: E402
from slim.operators.select import Css, css_query, select_elements  # noqa: E402
from slim.plans.optimize import evaluate_corpus, optimize_payloads  # noqa: E402
from slim.session import configure  # noqa: E402

__all__ = [
    "Any", "Css", "Descend", "Index", "Key", "Slice", "Where", "collapse_matches", "configure", "css_query",
    "evaluate_corpus", "leaves", "optimize_payloads", "parse_payloads", "payload_leaves", "register_functions",
    "select_elements", "select_path", "spread", "to_markdown",
]
