"""Table changes as functions (current, incoming) -> next.

Nothing is changed in place: the caller writes the result as the next version of the table. Keys
are unique on both sides after ``last_wins`` / ``first_wins``, so the joins on them cannot explode.
Sides with a row a page or stage are merged, not broadcast by the size of the files they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagekin.plans.skew import row_number_within


def _pick(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    # A limit of one row per key is applied before the shuffle, so a frequent key stays small.
    ranked = rows.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_no") == 1).drop("_no")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return _pick(rows, keys, F.col(position).asc())


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return _pick(rows, keys, F.col(position).desc())


def _as(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Columns and types of ``table``."""
    return rows.select(*[F.col(field.name).cast(field.dataType) for field in table.schema])


def _take(name: str, source: str) -> Column:
    return F.col(f"{source}.{name}")


def upsert_profiles(
    current: DataFrame, incoming: DataFrame, now: Column | None = None, arrival: str | None = None,
    highest: int | None = None,
) -> DataFrame:
    """Insert or replace on ``pcs_url``.

    Every data column is overwritten, null included; id and created_at stay; fetched_at and
    updated_at become ``now``. New ids continue after ``highest``, by default the highest one in
    ``current``, in order of ``arrival``.
    """
    now = F.current_timestamp() if now is None else now
    kept = {"id", "created_at"}
    stamped = {"fetched_at", "updated_at"}
    data = [c for c in current.columns if c not in kept | stamped | {"pcs_url"}]
    rows = last_wins(incoming, ["pcs_url"], arrival) if arrival else incoming
    for name in data:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(current.schema[name].dataType))

    new = rows.join(current.select("pcs_url").hint("merge"), "pcs_url", "left_anti")
    order = F.col(arrival) if arrival else F.xxhash64("pcs_url")
    numbered = row_number_within(new.select("pcs_url", order.alias("_order")), [], ["_order", "pcs_url"], "_no")
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar() if highest is None else F.lit(highest)
    new_ids = numbered.select("pcs_url", (top + F.col("_no")).alias("_new_id"))

    touched = F.col("n.pcs_url").isNotNull()
    joined = (
        current.alias("c")
        .join(rows.join(new_ids.hint("merge"), "pcs_url", "left").alias("n"), F.col("c.pcs_url") == F.col("n.pcs_url"), "full_outer")
    )

    def value(name: str) -> Column:
        if name == "pcs_url":
            return F.coalesce(_take(name, "c"), _take(name, "n"))
        if name == "id":
            return F.coalesce(_take(name, "c"), F.col("n._new_id"))
        if name == "created_at":
            return F.coalesce(_take(name, "c"), now)
        if name in stamped:
            return F.when(touched, now).otherwise(_take(name, "c"))
        return F.when(touched, _take(name, "n")).otherwise(_take(name, "c"))

    return joined.select(*[value(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])


def upsert_climbs(
    current: DataFrame,
    incoming: DataFrame,
    touched: DataFrame,
    overwrite: tuple[str, ...] = ("climb_name", "climb_url", "category"),
) -> DataFrame:
    """Upsert on (stage_id, climb_order), then drop climbs beyond the new course.

    Only ``overwrite`` columns are taken from the incoming rows, so enrichment survives. Every
    stage of ``touched`` (stage_id) is cut to its highest incoming order; with no incoming climbs
    it loses all of them.
    """
    keys = ["stage_id", "climb_order"]
    last = incoming.groupBy("stage_id").agg(F.max("climb_order").alias("_last"))
    cut = touched.select("stage_id").distinct().join(last.hint("merge"), "stage_id", "left").select(
        "stage_id", F.coalesce("_last", F.lit(0)).alias("_last")
    )
    alive = (
        current.join(cut.hint("merge"), "stage_id", "left")
        .filter(F.col("_last").isNull() | (F.col("climb_order") <= F.col("_last")))
        .drop("_last")
    )
    test = (F.col("c.stage_id") == F.col("n.stage_id")) & (F.col("c.climb_order") == F.col("n.climb_order"))
    joined = alive.alias("c").join(incoming.alias("n"), test, "full_outer")

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(_take(name, "c"), _take(name, "n"))
        if name in overwrite and name in incoming.columns:
            return F.when(F.col("n.stage_id").isNotNull(), _take(name, "n")).otherwise(_take(name, "c"))
        return _take(name, "c")

    return joined.select(*[value(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])


def replace_children(
    current: DataFrame, incoming: DataFrame, touched: DataFrame, position: str,
    parent: str = "stage_id", unique: str = "rank",
) -> DataFrame:
    """New children for every touched parent; null keys are dropped, the first row per key wins."""
    fresh = first_wins(incoming.filter(F.col(unique).isNotNull()), [parent, unique], position)
    rest = current.join(touched.select(parent).distinct().hint("merge"), parent, "left_anti")
    return rest.unionByName(_as(fresh, current))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Adds the rows whose key is not there yet; the first incoming row per key wins."""
    fresh = first_wins(incoming, keys, position).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(_as(fresh, current))


def replace_slices(
    current: DataFrame, incoming: DataFrame, touched: DataFrame, position: str,
    slice_keys: tuple[str, ...] = ("race_slug", "season"), unique: str = "rider_url",
) -> DataFrame:
    """Replaces whole (race, season) slices; a touched slice without incoming rows ends empty."""
    slices = list(slice_keys)
    rest = current.join(touched.select(*slices).distinct(), slices, "left_anti")
    fresh = first_wins(incoming, [*slices, unique], position)
    return rest.unionByName(_as(fresh, current))


def append(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return current.unionByName(_as(incoming, current))


def drop_orphans(children: DataFrame, parents: DataFrame, key: str = "stage_id", parent_key: str = "id") -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str = "stage_id", parent_key: str = "id") -> DataFrame:
    """Children that break the reference to their parent."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a uniqueness rule, with their row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
