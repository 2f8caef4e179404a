from .cohort_io import CohortSpec, read_cohort_csv, site_cohort, site_map  # noqa: F401
from .results_io import (read_run_results, table_fingerprint, with_setting_from_path, wrapped_long,  # noqa: F401
                         write_results)
