"""growthspark: creator-growth analytics as Spark DataFrame transformations.

Layout
------
functions/  pure Column expressions (row-local, stream-safe), distribution
            functions, one-pass statistics helpers
sources/    readers, writers, catalog, test-table projections (fixtures)
operators/  quality checks, cleaning, windows, weekly aggregation, features,
            Gram-statistics models, validation, KPIs, diagnostics, scoring
plans/      composed pipelines (clean -> features -> model -> evaluation)
streaming/  the row-local operators on ``readStream`` and a watermarked
            weekly aggregation
"""

__version__ = "0.1.0"
