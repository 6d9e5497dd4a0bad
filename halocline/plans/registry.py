"""Every registered query of the library and its DuckDB SQL."""

from halocline.plans import cleaning, fields, files, incremental, linking, more, places, profiles, registered, rest, rollups, science, snapshots, spatial, streams, tracks  # noqa: F401  each files its queries
from halocline.plans.book import COVERS, ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "vessel_match"
