"""Price histograms of neighbourhoods: numpy inside tasks, on tiles of bounded size that Spark deals out.

A tile is some places and the histograms of some places around them. Whether two places are neighbours is a matrix of
zeros and ones, the histograms are another, and their product adds up the neighbours' histograms of every place at once.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuelspark.functions.geo import EARTH_KM

# the helpers travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EARTH = EARTH_KM  # by value, too
CELLS = 4_000_000  # numbers of one matrix
TILE_SCHEMA = "lat double, lng double, fuel string, cents array<bigint>, n array<bigint>"
STATISTICS = {"n": T.LongType(), "s": T.LongType(), "ss": T.DoubleType(), "lo": T.LongType(), "hi": T.LongType(), "q1": T.DoubleType(), "q3": T.DoubleType()}


def rounded_km(lat: np.ndarray, lng: np.ndarray, lat_b: np.ndarray, lng_b: np.ndarray) -> np.ndarray:
    """Great-circle distances of all places (rows) to all others (columns), to 2 decimals."""
    y = np.sin(np.radians(lat_b[None, :] - lat[:, None]) / 2)
    x = np.sin(np.radians(lng_b[None, :] - lng[:, None]) / 2)
    a = y * y + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lat_b))[None, :] * x * x
    return np.floor(2 * EARTH * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a)) * 100.0 + 0.5) / 100.0


def tile_histograms(places: pd.DataFrame, bins: pd.DataFrame, radius_km: float) -> pd.DataFrame:
    """For each place (lat, lng) and fuel the histogram of the bins (lat, lng, fuel, cents, n) within the radius."""
    rows: dict[str, list] = {c: [] for c in ("lat", "lng", "fuel", "cents", "n")}
    if len(places) and len(bins):
        fuel, fuels = pd.factorize(bins["fuel"])
        kinds, column = np.unique(np.rec.fromarrays([fuel.astype("int64"), bins["cents"].to_numpy("int64")], names="f,c"), return_inverse=True)
        edges = np.searchsorted(kinds["f"], np.arange(len(fuels) + 1))
        there, place = np.unique(bins["lat"].to_numpy("float64") + 1j * bins["lng"].to_numpy("float64"), return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, column, count = place[order], column[order], bins["n"].to_numpy("float64")[order]
        size = len(kinds)
        most = max(1, min(1000, CELLS // size))
        for first in range(0, len(places), most):
            lat, lng = (places[c].to_numpy("float64")[first:first + most] for c in ("lat", "lng"))
            total = np.zeros((len(lat), size))
            for low in range(0, len(there), most):
                some = there[low:low + most]
                begin, end = np.searchsorted(place, [low, low + most])
                held = np.bincount((place[begin:end] - low) * size + column[begin:end], count[begin:end], len(some) * size)
                near = rounded_km(lat, lng, some.real, some.imag) <= radius_km
                total += near.astype("float64") @ held.reshape(len(some), size)
            for k, sums in enumerate(total):
                for f, name in enumerate(fuels):
                    hit = np.flatnonzero(sums[edges[f]:edges[f + 1]]) + edges[f]
                    if len(hit):
                        for c, v in zip(rows, (lat[k], lng[k], name, kinds["c"][hit], sums[hit].astype("int64"))):
                            rows[c].append(v)
    return pd.DataFrame(rows)


def others_of(cents: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, sum, sum of squares, least, greatest and quartiles of a histogram in parts without one record of each own value."""
    values, at = np.unique(cents, return_inverse=True)
    counts = np.bincount(at, n).astype("int64")
    ends = np.cumsum(counts)
    mine = np.searchsorted(values, own)
    left = ends[-1] - 1

    def ranked(k: np.ndarray) -> np.ndarray:  # the record left out is the last one of its value
        k = np.clip(k + (k >= ends[mine] - 1), 0, ends[-1] - 1)
        return values[np.searchsorted(ends, k, side="right")]

    def quantile(share: float) -> np.ndarray:
        position = share * max(left - 1, 0)
        low, high = np.floor(position), np.ceil(position)
        a, b = (ranked(np.full(len(own), int(k))) for k in (low, high))
        return np.where(a == b, a.astype("float64"), (high - position) * a + (position - low) * b)

    own = own.astype("int64")
    squares = (values * values).astype("float64") @ counts
    return (np.full(len(own), left), values @ counts - own, squares - (own * own).astype("float64"),
            ranked(np.zeros(len(own), "int64")), ranked(np.full(len(own), max(left - 1, 0))), quantile(0.25), quantile(0.75))


@F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in STATISTICS.items()]))
def statistics_of_others(cents: pd.Series, n: pd.Series, own: pd.Series) -> pd.DataFrame:
    rows = [others_of(np.asarray(c, "int64"), np.asarray(w, "int64"), np.asarray(o, "int64")) for c, w, o in zip(cents, n, own)]
    return pd.DataFrame(rows, columns=list(STATISTICS))
