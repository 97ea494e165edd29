"""seclog — security-log analytics on Spark DataFrames.

Main entry points (all return lazy DataFrames):

* ``analyze_logs(logs)`` — chunk → rule filter → clusters → run summary (E1)
* ``extract_iocs_job(logs)`` — indicators per whole text (E2)
* ``index_kb(files, existing)`` — knowledge-base indexing (E4)
* ``read_logs`` / ``admit_logs`` / ``logs_from_files`` — file intake
* ``stream_logs`` — the same analysis over a file stream
"""

from .plans.analyze import analyze_logs, extract_iocs_job, index_kb
from .sources.logs import admit_logs, logs_from_files, read_logs
from .streaming.intake import stream_cluster_windows, stream_logs

__all__ = [
    "analyze_logs",
    "extract_iocs_job",
    "index_kb",
    "read_logs",
    "admit_logs",
    "logs_from_files",
    "stream_logs",
    "stream_cluster_windows",
]
