"""Trip plans for many areas at once: eligibility, pools, timed tours, the pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.grouped import grouped_map
from ..operators.numbering import top_per_key

c = F.col

POOL_SIZE = 60
BUDGETS = (30, 60, 120)
TOLERANCE = 1.15
STREET_FACTOR = 1.3
WALK_KMH = 4.6
MIN_STOPS, MAX_STOPS, MAX_SEEDS = 3, 5, 8


def refusal(include_lots: bool = False) -> Column:
    """Why a stop cannot be on a walk, NULL when it can; first reason wins.

    Uses lat, lng, distance, access, geocode_precision and lot_access.
    """
    lot = F.lit(None).cast("string") if include_lots else c("lot_access")
    located = c("lat").isNotNull() & c("lng").isNotNull() & ~((c("lat") == 0) & (c("lng") == 0))
    return (
        F.when(~located, "no_position")
        .when(~c("distance").isin(0, 1), "not_a_route_stop")
        .when(c("access") == "closed", "closed")
        .when(
            c("geocode_precision").isNotNull()
            & ~c("geocode_precision").isin("point", "building", "street"),
            "not_a_spot",
        )
        .when(lot == "view_only", "studio_lot_no_entry")
        .when(lot == "ticketed", "studio_lot_needs_booking")
    )


def pools(areas: DataFrame, stops: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """The ``size`` nearest stops of every area within its radius.

    ``areas``: area_id, a_lat, a_lng, radius_m.
    """
    near = spatial.within_radius(areas, stops, c("radius_m"), 5000.0, spatial.great_circle())
    return top_per_key(near, ["area_id"], [c("metres"), c("stop_id")], size)


TOUR_ROW = (
    "area_id long, budget int, stops string, stop_count int, minutes int, "
    "start_km double, confirmed int"
)


def timed_tours(pooled: DataFrame) -> DataFrame:
    """Candidate walks per area and budget from its pool of at most 60 stops.

    ``pooled``: area_id, a_lat, a_lng, stop_id, lat, lng, routable. Up to eight
    seeds nearest the centre; from each, nearest-neighbour walks of three to five
    stops; those within the budget (15 % slack) remain.
    """
    import numpy as np
    import pandas as pd

    def km(lat1, lng1, lat2, lng2):
        h = (
            np.sin((lat2 - lat1) / 2) ** 2
            + np.cos(lat1) * np.cos(lat2) * np.sin((lng2 - lng1) / 2) ** 2
        )
        return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    def tours(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stop_id").reset_index(drop=True)
        lat, lng = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lng"].to_numpy())
        n, ids = len(pdf), pdf["stop_id"].tolist()
        names = TOUR_ROW.replace(",", "").split()[::2]
        if n < MIN_STOPS:
            return pd.DataFrame(columns=names)
        home = km(np.radians(pdf["a_lat"][0]), np.radians(pdf["a_lng"][0]), lat, lng)
        between = km(lat[:, None], lng[:, None], lat[None, :], lng[None, :])
        found = {}
        for seed in np.argsort(home, kind="stable")[:MAX_SEEDS]:
            path, left = [int(seed)], [i for i in range(n) if i != seed]
            while left and len(path) < MAX_STOPS:
                path.append(left.pop(int(np.argmin(between[path[-1], left]))))
            for count in range(MIN_STOPS, len(path) + 1):
                part = path[:count]
                length = sum(between[a, b] for a, b in zip(part, part[1:]))
                minutes = max(1, int(np.ceil(length * STREET_FACTOR * 60 / WALK_KMH)))
                confirmed = int(pdf["routable"].to_numpy()[part].sum())
                found.setdefault(
                    "|".join(ids[i] for i in part), (count, minutes, float(home[seed]), confirmed)
                )
        rows = [
            (pdf["area_id"][0], budget, key, *values)
            for budget in BUDGETS
            for key, values in found.items()
            if values[1] <= budget * TOLERANCE
        ]
        return pd.DataFrame(rows, columns=names)

    return grouped_map(pooled, "area_id", tours, TOUR_ROW)


def pick_tours(tours: DataFrame) -> DataFrame:
    """One walk per area and budget: most stops, longest, most confirmed, then by ids."""
    order = F.struct(-c("stop_count"), -c("minutes"), -c("confirmed"), c("stops"))
    return tours.groupBy("area_id", "budget").agg(
        F.min_by(F.struct("stops", "stop_count", "minutes", "confirmed"), order).alias("_t")
    ).select("area_id", "budget", "_t.*")
