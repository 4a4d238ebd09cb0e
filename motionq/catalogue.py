"""All core queries with their SQL twins."""

from motionq.plans import files, geometry, grids, hierarchy, histograms, motion, search, sketches, stores, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _plan in (search, hierarchy, histograms, sketches, motion, stores, grids, geometry, files, streams):
    QUERIES.update(_plan.query.queries)
    SQL.update(_plan.query.sql)
