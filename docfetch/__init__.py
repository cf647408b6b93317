"""docfetch: bulk document acquisition with a queryable catalog, on Spark.

Entry points (DataFrame in, DataFrame out unless noted):

* sources: ``read_manifest_csv``, ``read_manifest_xlsx``, ``list_stored_files``,
  ``read_catalog``, ``export_csv``, ``save_table`` / ``read_latest``
* preparation: ``slice_rows``, ``map_columns``, ``validate_rows``, ``reject_duplicates``
* planning and fetching: ``plan_fetch``, ``fetch_documents``, ``run_manifest``
* catalog: ``upsert``, ``query_catalog``, ``resolve_delivery``
* runs: ``outcome_counts``, ``running_counts``, ``run_report``
* streaming: ``ingest_stream``, ``live_counts``
"""

from docfetch.operators.browse import query_catalog, resolve_delivery  # noqa: F401
from docfetch.operators.catalog import upsert  # noqa: F401
from docfetch.operators.fetch import fetch_documents  # noqa: F401
from docfetch.operators.prepare import map_columns, reject_duplicates, slice_rows, validate_rows  # noqa: F401
from docfetch.operators.runs import outcome_counts, run_report, running_counts  # noqa: F401
from docfetch.plans.fetch_plan import plan_fetch  # noqa: F401
from docfetch.plans.run import run_manifest  # noqa: F401
from docfetch.session import get_session  # noqa: F401
from docfetch.sources.manifest import read_manifest_csv, read_manifest_xlsx  # noqa: F401
from docfetch.sources.tables import (  # noqa: F401
    export_csv,
    list_stored_files,
    read_catalog,
    read_latest,
    save_table,
)
from docfetch.streaming.ingest import ingest_stream, live_counts  # noqa: F401
