"""DataFrame operators: normalise, de-identify, judge, curate, enrich, audit."""
