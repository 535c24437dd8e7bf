"""Sources and sinks: recordings to tables, reports to files."""

from spindrift.sources.recordings import chunks, catalog, geometry_csv, ground_truth, mda, read_mda_bytes  # noqa: F401
from spindrift.sources.reports import canonical_json, digest, union_rows, write_report  # noqa: F401
from spindrift.sources.synthetic import synthetic_recording  # noqa: F401
