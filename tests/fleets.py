"""Small fleets and plain-Python counterparts for the tests."""

import datetime as dt
import math
import random
import statistics

CYCLE_DDL = (
    "battery_id string, cycle_index int, cycle_start_time timestamp_ntz, ambient_temperature double, "
    "capacity_ah double, discharge_duration_s double, voltage_min double, voltage_mean double, "
    "current_mean double, temp_max double, temp_mean double, charge_duration_s double, "
    "charge_current_end double, charge_temp_max double, charge_temp_mean double")
START = dt.datetime(2020, 1, 1)


def cycle_rows(sizes, seed=5, index=lambda i: i + 1):
    """Noisy linear fade, one row every six hours; ``sizes`` maps unit to row count."""
    draw = random.Random(seed)
    rows = []
    for unit, n in sizes.items():
        for i in range(n):
            capacity = 1.86 - 0.56 * i / max(n - 1, 1) + draw.gauss(0, 0.005)
            rows.append((unit, index(i), START + dt.timedelta(hours=6 * i), 24.0, capacity,
                         3600 - 10.0 * i, 2.5 + draw.random() / 10, 3.5, -2.0, 35 + draw.random(), 30.0,
                         10000.0 + i, 0.02, 27 + draw.random(), 25.0))
    return rows


def cycles(spark, sizes, **options):
    return spark.createDataFrame(cycle_rows(sizes, **options), CYCLE_DDL)


def expected_features(rows):
    """Per unit in order: soh, lag, rolling mean, rolling std, slope of the previous five."""
    out = {}
    by_unit = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        by_unit.setdefault(row[0], []).append(row)
    for unit, own in by_unit.items():
        soh = [r[4] / 2.0 for r in own]
        for i, row in enumerate(own):
            past = soh[max(0, i - 5):i]
            slope = None
            if len(past) == 5:
                centre = statistics.fmean(past)
                slope = sum((x - 2) * (y - centre) for x, y in enumerate(past)) / 10
            out[unit, row[1]] = {
                "soh": soh[i], "soh_prev": soh[i - 1] if i else None,
                "soh_roll_mean": statistics.fmean(past) if len(past) >= 2 else None,
                "soh_roll_std": statistics.stdev(past) if len(past) >= 2 else None,
                "fade_rate": slope,
                "voltage_min_prev": own[i - 1][6] if i else None,
                "time_since_prev_cycle_h": (row[2] - own[i - 1][2]).total_seconds() / 3600 if i else None,
            }
    return out


def close(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def quantile(values, p):
    ordered = sorted(values)
    position = p * (len(ordered) - 1)
    low, high = math.floor(position), math.ceil(position)
    if low == high:
        return ordered[low]
    return (high - position) * ordered[low] + (position - low) * ordered[high]


def psi(reference, current, probabilities):
    edges = sorted({quantile(reference, p) for p in probabilities})
    if len(edges) >= 3:
        inner = edges[1:-1]
    else:
        band = max(abs(edges[0]), 1.0) * 1e-6
        inner = [edges[0] - band, edges[0] + band]
    place = lambda x: sum(x >= e for e in inner)
    total = 0.0
    for b in range(len(inner) + 1):
        a = max(sum(place(x) == b for x in reference) / len(reference), 1e-4)
        c = max(sum(place(x) == b for x in current) / len(current), 1e-4)
        total += (c - a) * math.log(c / a)
    return total
