"""prioscope: support-ticket priority auditing as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function built from native
column expressions, so chains compose with ``df.transform(...)`` and Catalyst sees
one plan end to end.
"""

from prioscope.lexicon import APP, BASELINE, CORE, FULL, Lexicon, preset  # noqa: F401
from prioscope.session import checkpoint_root, get_session  # noqa: F401
