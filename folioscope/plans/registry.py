"""All registered queries: name -> function(spark, sf_dir), and name -> SQL over the same tables."""

from __future__ import annotations

from folioscope.functions import charsets, scalars
from folioscope.operators import aggregates, drawings, formats, gates, ink, joins, layout, ordered, projections, reference, reports
from folioscope.plans import catalog
from folioscope.sources import corpus, markup, pictures, properties, reports as report_files
from folioscope.streaming import delivery, merge

MODULES = (reference, scalars, markup, corpus, pictures, projections, gates, joins, aggregates, ordered, reports, delivery, drawings, ink, properties, merge, layout, charsets, formats, report_files)
QUERIES = dict(catalog.QUERIES)
ORACLE = dict(catalog.ORACLE)
