"""All registered queries of the series part."""

from tidemill.plans import features, files, modelling, models, quality, streams, trading, training  # noqa: F401  they register theirs
from tidemill.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
