"""Named queries.  Importing this package registers all of them."""

from churnscope.plans.catalog import (  # noqa: F401
    business_queries,
    chart_queries,
    io_queries,
    quality_queries,
    segment_queries,
    sketch_queries,
    stats_queries,
    survival_queries,
    table_queries,
)
