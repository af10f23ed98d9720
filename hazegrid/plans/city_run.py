"""The whole chain: feeds -> panel -> field -> hotspots -> verdicts -> queue -> documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazegrid.functions.geo import Grid
from hazegrid.operators import (
    advisory, attribution, audit, clean, exposure, forecast, hotspots, ledger, memo, panel, priority, wards,
)
from hazegrid.operators.spatial import city_cells, stamp_cell
from hazegrid.plans.stages import Stage, Tables, run_stages
from hazegrid.session import materialise


def run(
    feeds: dict[str, DataFrame],
    issued_at: str,
    grid: Grid = Grid(),
    teams: int = 4,
    budget: int = 10,
    store: Callable[..., DataFrame] = materialise,
    **limits: int | None,
) -> dict[str, DataFrame]:
    """Run every stage for all cities at once and return the published tables; the first error ends the run.

    ``feeds`` holds cities (bounding boxes), polygons, stations, weather, satellite, fires,
    osm, reports and status. ``store`` persists a stage that later stages read more than
    once; the default writes it to the shared folder, panel and field by city and date.
    ``limits`` are those of ``stages``.
    """
    tables = dict(feeds)
    for stage in stages(issued_at, grid, teams, budget, store, **limits):
        tables |= stage.run(tables)
    published = [n for s in stages(issued_at) for n in s.gives if n not in ("qc_stations", "landuse", "clean_reports")]
    return {n: tables[n] for n in published}


def run_reported(
    spark: SparkSession, feeds: dict[str, DataFrame], issued_at: str, published: str, only: str | None = None, grid: Grid = Grid(),
    teams: int = 4, budget: int = 10, **limits: int | None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, report): the stages under ``run_stages``, all or one, with failures kept to their stage."""
    return run_stages(spark, stages(issued_at, grid, teams, budget, **limits), feeds, published, only)


def stages(
    issued_at: str, grid: Grid = Grid(), teams: int = 4, budget: int = 10, store: Callable[..., DataFrame] = materialise,
    top_cells: int | None = None, candidates: int | None = None, blind: int | None = None,
) -> list[Stage]:
    """The chain as stages, over all zones, sites and blind spots.

    Only if asked, the zones of ``top_cells`` cells are attributed, by ``candidates`` sites each, and ``blind`` blind spots listed.
    """

    def ground(t: Tables) -> Tables:
        cells = store(city_cells(t["cities"], grid))
        return {
            "cells": cells,
            "wards": store(wards.wards_from_polygons(cells, t["polygons"])),
            "qc_stations": store(clean.qc_station_readings(stamp_cell(t["stations"], grid))),
            "landuse": store(panel.landuse_features(cells, t["osm"])),
        }

    def features(t: Tables) -> Tables:
        base = panel.build_panel(
            t["cells"], t["qc_stations"], t["weather"], t["satellite"], t["fires"], t["osm"], t["wards"], t["landuse"]
        )
        return {"panel": store(base, "city", "date")}

    def exposed(t: Tables) -> Tables:
        models, baseline = exposure.fit_field(store(exposure.labelled(t["panel"])))
        return {"field": store(exposure.predict_field(models, t["panel"], baseline), "city")}

    def detected(t: Tables) -> Tables:
        return {"hotspots": store(hotspots.detect(t["panel"], t["field"], t["osm"], t["wards"], grid=grid))}

    def attributed(t: Tables) -> Tables:
        named_wards = clean.canonicalise_ward(t["reports"], t["wards"]).drop("ward_fixed")
        reports = store(clean.resolve_ward_from_location(named_wards, t["wards"], grid).drop("located"))
        named = attribution.attribute(t["hotspots"], t["panel"], t["field"], t["osm"], reports, top_cells, grid, candidates)
        return {"clean_reports": reports, "attributions": store(named)}

    def ahead(t: Tables) -> Tables:
        train = store(forecast.pooled(store(exposure.labelled(t["panel"]))))
        models, cols = forecast.fit_forecast(train)
        hat = store(forecast.forecast_field(t["panel"], t["field"], models, cols))
        return {"forecast": hat, "ward_forecast": forecast.ward_forecast(hat, t["wards"])}

    def queued(t: Tables) -> Tables:
        queue = store(priority.actions(t["hotspots"], t["attributions"], t["landuse"], grid))
        return {"actions": queue, "dispatch": priority.dispatch(queue, t["hotspots"], teams, budget, grid)}

    def written(t: Tables) -> Tables:
        rules = memo.rules_table(t["actions"].sparkSession)
        return {"memos": store(memo.memos(t["actions"], t["attributions"], rules, issued_at))}

    def advised(t: Tables) -> Tables:
        told = advisory.ward_inputs(t["wards"], t["forecast"], t["field"], t["landuse"])
        return {"advisories": advisory.advisory_texts(advisory.ward_advisory(told))}

    def entered(t: Tables) -> Tables:
        status = ledger.latest_status(t["status"])
        return {"ledger": ledger.ledger(t["actions"], t["hotspots"], t["memos"], status, t["forecast"])}

    def audited(t: Tables) -> Tables:
        return {
            "blind_spots": audit.blind_spots(t["field"], t["qc_stations"], t["wards"], blind),
            "sensor_flags": audit.sensor_flags(t["field"], t["qc_stations"], t["wards"]),
        }

    return [
        Stage("ground", ("cities", "polygons", "stations", "osm"), ("cells", "wards", "qc_stations", "landuse"), ground),
        Stage("panel", ("cells", "qc_stations", "weather", "satellite", "fires", "osm", "wards", "landuse"), ("panel",), features),
        Stage("exposure", ("panel",), ("field",), exposed),
        Stage("detection", ("panel", "field", "osm", "wards"), ("hotspots",), detected),
        Stage("attribution", ("hotspots", "panel", "field", "osm", "reports", "wards"), ("clean_reports", "attributions"), attributed),
        Stage("forecast", ("panel", "field", "wards"), ("forecast", "ward_forecast"), ahead),
        Stage("prioritisation", ("hotspots", "attributions", "landuse"), ("actions", "dispatch"), queued),
        Stage("memo", ("actions", "attributions"), ("memos",), written),
        Stage("advisory", ("wards", "forecast", "field", "landuse"), ("advisories",), advised),
        Stage("ledger", ("actions", "hotspots", "memos", "status", "forecast"), ("ledger",), entered),
        Stage("audit", ("field", "qc_stations", "wards"), ("blind_spots", "sensor_flags"), audited),
    ]
