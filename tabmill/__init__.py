"""tabmill: the full path of a tabular study as Spark DataFrame / SQL work.

Sub-packages:

* ``sources``   - token-stream text scan, record regrouping, numeric casts,
                  Parquet snapshots and CSV export.
* ``functions`` - column-expression helpers (string / date / number
                  formatting, chi-square and normal tail probabilities).
* ``operators`` - table operators: frame algebra, profiling, association
                  tests, distribution tests, nearest-neighbour joins,
                  imputation, evaluation and MLlib model search.
* ``plans``     - stand-in inputs built from the driver tables and the
                  registry of named queries with their SQL oracles.

The studied project has no streams, so there is no streaming package.
"""

from tabmill.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
