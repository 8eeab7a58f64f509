"""Table schemas. Numbers are decimals at rest and doubles in every computation."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_text, _int, _long, _time = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

STAGE_PROFILES = _struct(
    id=_long,
    pcs_url=_text,
    race_name=_text,
    season=_int,
    stage_number=_text,
    stage_type=_text,
    distance_km=T.DecimalType(6, 2),
    vertical_meters=_int,
    profile_score=_int,
    profile_icon=_text,
    nb_climbs=_int,
    raw_json=_text,
    victory_type=_text,
    winner_group_size=_int,
    fetched_at=_time,
    created_at=_time,
    updated_at=_time,
)

STAGE_CLIMBS = _struct(
    stage_id=_long,
    climb_order=_int,
    climb_name=_text,
    climb_url=_text,
    category=_text,
    length_km=T.DecimalType(5, 2),
    steepness_pct=T.DecimalType(4, 2),
    top_elevation_m=_int,
    km_before_finish=T.DecimalType(5, 2),
)

STAGE_RESULTS = _struct(
    stage_id=_long,
    rank=_int,
    rider_name=_text,
    rider_url=_text,
    team_name=_text,
    status=_text,
    finish_time_seconds=_int,
    gap_seconds=_int,
)

RACE_STARTLISTS = _struct(
    race_slug=_text,
    season=_int,
    race_name=_text,
    rider_name=_text,
    rider_url=_text,
    team_name=_text,
    team_url=_text,
    nationality=_text,
    rider_number=_int,
    fetched_at=_time,
)

RAW_PAGES = _struct(id=_long, url=_text, html=_text, html_sha256=_text, fetched_at=_time)

#: The last kept fetch of each URL: what a new fetch is compared with, without reading the log.
PAGE_STATE = _struct(url=_text, id=_long, fetched_at=_time, html_sha256=_text)

SYNC_FAILURES = _struct(source=_text, url=_text, reason=_text, occurred_at=_time)

#: What a run did: fetches that could be read and failures, by source.
SYNC_RUNS = _struct(run=_text, source=_text, batch=_text, ok=_long, failed=_long, finished_at=_time)

TABLES = {
    "stage_profiles": STAGE_PROFILES,
    "stage_climbs": STAGE_CLIMBS,
    "stage_results": STAGE_RESULTS,
    "race_startlists": RACE_STARTLISTS,
    "raw_pages": RAW_PAGES,
    "page_state": PAGE_STATE,
    "sync_failures": SYNC_FAILURES,
    "sync_runs": SYNC_RUNS,
}
