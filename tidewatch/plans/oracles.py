"""The named queries in SQL for DuckDB, written apart from the operators: spells by differences of row numbers, joins
without buckets, tables rebuilt from the inputs. Queries that SQL cannot express have no entry."""

from __future__ import annotations

import re

from ..config import INTENSITY, SENSITIVITY_SETS, SPELL_DAYS, WEIGHTS
from . import stats_sql

_CASE = {0: "SAFE", 1: "CHRONIC", 2: "UNSTABLE", 3: "CRITICAL"}


def _category(key: str) -> str:
    return f"(['SAFE','CHRONIC','UNSTABLE','CRITICAL'])[({key}) % 4 + 1]"


def _pool(source: str, hf: str, key: str, pct: str, scenario: str, synthetic: int) -> str:
    return f"""SELECT 'hf_' || {hf} AS hf_id, 'payam_' || ({key} % 7) AS hf_payam, {_category(key)} AS hf_category,
      4.0::DOUBLE + ({key} % 11)::DOUBLE / 10 AS latitude, 30.0::DOUBLE + ({key} % 13)::DOUBLE / 10 AS longitude,
      CASE WHEN {key} % 2 = 0 THEN 40 ELSE 60 END AS buffer_pixels, date, (near IS NOT NULL)::INTEGER AS occurrence,
      CASE WHEN near IS NOT NULL THEN {pct} ELSE 0.0::DOUBLE END AS pct_flooded,
      CASE WHEN near IS NOT NULL THEN near * 90.0::DOUBLE WHEN {key} % 2 = 0 THEN 2545.5::DOUBLE ELSE 3818.0::DOUBLE END AS min_distance,
      dayofyear(date)::INTEGER AS day_of_year, year(date)::INTEGER AS year, {scenario}::INTEGER AS scenario_id, {synthetic} AS is_synthetic FROM {source}"""


def _step(value: str, limits) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {loss}::DOUBLE" for t, loss in sorted(limits, reverse=True)) + " ELSE 0.0::DOUBLE END"


def _spells(pool: str, key: str) -> dict[str, str]:
    """CTEs of labelled and merged days of a pool, whose series are told apart by `key`."""
    p = f"PARTITION BY {key}"
    return {
        f"{pool}_n": f"SELECT *, row_number() OVER ({p} ORDER BY date) - row_number() OVER ({p}, occurrence ORDER BY date) AS isle FROM {pool}",
        f"{pool}_s": f"SELECT {key}, isle, min(date) AS start_date, max(date) AS end_date, count(*)::INTEGER AS duration, avg(pct_flooded) AS mean_pct_flooded, min(min_distance) AS min_distance, min_by(hf_category, date) AS hf_category, row_number() OVER ({p} ORDER BY min(date))::INTEGER - 1 AS spell_id FROM {pool}_n WHERE occurrence = 1 GROUP BY {key}, isle",
        f"{pool}_m": f"SELECT *, sum(new) OVER ({p} ORDER BY start_date) AS grp FROM (SELECT *, CASE WHEN start_date - lag(end_date) OVER ({p} ORDER BY start_date) - 1 <= 4 THEN 0 ELSE 1 END AS new FROM {pool}_s)",
        f"{pool}_g": f"SELECT {key}, grp, min(start_date) AS a, max(end_date) AS b, min(spell_id) AS merged_spell_id, (max(end_date) - min(start_date) + 1)::INTEGER AS merged_duration FROM {pool}_m GROUP BY {key}, grp",
        f"{pool}_l": f"SELECT n.*, coalesce(s.spell_id, -1) AS spell_id, coalesce(s.duration, 0) AS spell_duration, s.mean_pct_flooded, coalesce(g.merged_spell_id, -1) AS merged_spell_id, coalesce(g.merged_duration, 0) AS merged_duration FROM {pool}_n n LEFT JOIN {pool}_s s ON {' AND '.join(f'n.{k} = s.{k}' for k in key.split(', '))} AND n.isle = s.isle AND n.occurrence = 1 LEFT JOIN {pool}_g g ON {' AND '.join(f'n.{k} = g.{k}' for k in key.split(', '))} AND n.date BETWEEN g.a AND g.b",
    }


def _loss(days: str, weights=WEIGHTS, active=(1, 1, 1, 1), spell=SPELL_DAYS, intensity=INTENSITY) -> str:
    rules = [_step("spell_duration", spell), _step("mean_pct_flooded * spell_duration", intensity), "CASE WHEN min_distance < 500 THEN 0.5::DOUBLE WHEN min_distance < 1200 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END", _step("merged_duration", spell)]
    cols = ", ".join(f"CASE WHEN spell_id >= 0 AND {a} = 1 THEN {r} ELSE 0.0::DOUBLE END AS r{i + 1}_loss" for i, (r, a) in enumerate(zip(rules, active, strict=True)))
    score = " + ".join(f"{w}::DOUBLE * r{i + 1}_loss" for i, w in enumerate(weights))
    mult = "CASE hf_category WHEN 'CHRONIC' THEN 1.2::DOUBLE WHEN 'UNSTABLE' THEN 1.4::DOUBLE WHEN 'CRITICAL' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END"
    return f"SELECT *, least(greatest(({score}) / {sum(weights)}::DOUBLE * r5_mult, 0.0::DOUBLE), 1.0::DOUBLE) AS combined_loss FROM (SELECT *, {cols}, {mult} AS r5_mult FROM {days})"


def _stats(scored: str, key: str) -> str:
    return f"""SELECT {key}, min_by(hf_category, date) AS hf_category, sum(occurrence)::INTEGER AS days_flooded, avg(combined_loss) AS annual_mean_loss, max(combined_loss) AS annual_max_loss,
      count(*) FILTER (combined_loss >= 0.5)::INTEGER AS days_loss_gt50, count(*) FILTER (combined_loss >= 0.75)::INTEGER AS days_loss_gt75, count(*) FILTER (combined_loss >= 0.999)::INTEGER AS days_loss_100,
      count(DISTINCT spell_id) FILTER (spell_duration >= 15)::INTEGER AS n_spells_15plus FROM {scored} GROUP BY {key}"""


def _q(c: str, q: float) -> str:
    return f"quantile_cont(({c})::DOUBLE, {q})"


_BANDS = ("flood_frequency", "flood_duration", "valid_obs", "max_consecutive")
_PIX = "year, row_, col_"

CTE: dict[str, str] = {
    "k": "SELECT greatest(1, count(*) // 100)::INTEGER AS k FROM supplier",
    "sup": "SELECT s_suppkey, (s_nationkey + 25 * (s_suppkey % k))::INTEGER AS hk FROM supplier, k",
    "obs_wet": "SELECT hk, l_shipdate::DATE AS date, sum(l_quantity) AS q, min(l_partkey % 30) AS near FROM lineitem JOIN sup ON l_suppkey = s_suppkey GROUP BY ALL",
    "obs_days": "SELECT hk, unnest(generate_series(DATE '1995-01-02', DATE '2001-11-04', INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT hk FROM sup)",
    "obs_join": "SELECT * FROM obs_days LEFT JOIN obs_wet USING (hk, date)",
    "obs": _pool("obs_join", "hk", "hk", "least(1.0::DOUBLE, q / 100)", "-1", 0),
    "typ": "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS scenario FROM (SELECT DISTINCT event_type FROM events)",
    "syn_wet": "SELECT user_id, event_type, ts::DATE AS date, round(sum(value), 4) AS q, min(event_id % 30) AS near FROM events GROUP BY ALL",
    "syn_days": "SELECT user_id, event_type, scenario, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT user_id FROM events), typ",
    "syn_join": "SELECT * FROM syn_days LEFT JOIN syn_wet USING (user_id, event_type, date)",
    "syn": _pool("syn_join", "user_id", "user_id", "least(1.0::DOUBLE, q / 200)", "scenario", 1),
    **_spells("obs", "hf_id, year"),
    **_spells("syn", "hf_id, scenario_id"),
    "all_n": "SELECT *, row_number() OVER (PARTITION BY hf_id ORDER BY date) - row_number() OVER (PARTITION BY hf_id, occurrence ORDER BY date) AS isle FROM obs",
    "all_s": "SELECT hf_id, isle, min(date) AS start_date, count(*)::INTEGER AS length, row_number() OVER (PARTITION BY hf_id ORDER BY min(date))::INTEGER - 1 AS spell_id FROM all_n WHERE occurrence = 1 GROUP BY hf_id, isle",
    "obs_c": _loss("obs_l"),
    "syn_c": _loss("syn_l"),
    "obs_st": _stats("obs_c", "hf_id, year"),
    "syn_st": _stats("syn_c", "hf_id, scenario_id"),
    "obs_mon": "SELECT o.hf_id, o.year, m.month, coalesce(avg(c.combined_loss), 0.0) AS loss FROM (SELECT DISTINCT hf_id, year FROM obs) o CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS month) m LEFT JOIN obs_c c ON c.hf_id = o.hf_id AND c.year = o.year AND month(c.date) = m.month GROUP BY ALL",
    "pix": "SELECT (DATE '2012-11-01' + (i - 1)::INTEGER * 10)::DATE AS map_date, (vec_id // 25)::INTEGER AS row_, (vec_id % 25)::INTEGER AS col_, CASE WHEN vec_id // 25 = 0 OR vec_id % 25 = 0 THEN 1 WHEN e > 0 THEN 200 WHEN e < -0.106::DOUBLE THEN CASE WHEN (i - 1) % 2 = 0 THEN 30 ELSE 50 END ELSE 17 END AS code FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "bin": "SELECT map_date, row_, col_, CASE WHEN code = 200 THEN 1 WHEN code IN (30, 50) THEN NULL ELSE 0 END::SMALLINT AS value FROM pix",
    "binx": "SELECT *, year(map_date)::INTEGER AS year, CASE WHEN month(map_date) >= 11 OR month(map_date) <= 4 THEN 'dry' ELSE 'wet' END AS season, (year(map_date) + (month(map_date) >= 11)::INTEGER)::INTEGER AS season_year FROM bin",
    # held streaks: a flood is in a new island if a clear map, or more than two missing ones, lie between it and the flood before
    "hold_f": "SELECT *, row_number() OVER w AS pos, count(*) FILTER (value = 0) OVER w AS clear, count(*) FILTER (value IS NULL) OVER w AS missing FROM binx WINDOW w AS (PARTITION BY year, row_, col_ ORDER BY map_date)",
    "hold_i": "SELECT *, sum(CASE WHEN pc IS NULL OR clear > pc OR missing - pm > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY year, row_, col_ ORDER BY map_date) AS isle FROM (SELECT *, lag(clear) OVER v AS pc, lag(missing) OVER v AS pm FROM hold_f WHERE value = 1 WINDOW v AS (PARTITION BY year, row_, col_ ORDER BY map_date))",
    "hold": "SELECT year, row_, col_, max(n)::INTEGER AS run FROM (SELECT year, row_, col_, isle, count(*) AS n FROM hold_i GROUP BY ALL) GROUP BY ALL",
    "haz": "SELECT year, row_, col_, sum(value)::DOUBLE / nullif(count(value), 0) AS flood_frequency, sum(value)::INTEGER AS flood_duration, nullif(count(value), 0)::INTEGER AS valid_obs, CASE WHEN count(value) > 0 THEN coalesce(max(run), 0) END::INTEGER AS max_consecutive FROM binx LEFT JOIN hold USING (year, row_, col_) GROUP BY ALL",
    "long": " UNION ALL ".join(f"SELECT year, row_, col_, '{b}' AS band, {b}::DOUBLE AS value FROM haz WHERE flood_frequency IS NOT NULL" for b in _BANDS),
    "longall": " UNION ALL ".join(f"SELECT year, row_, col_, '{b}' AS band, {b}::DOUBLE AS value FROM haz" for b in _BANDS),
    "yearly": "SELECT band, year, avg(value) AS m, stddev_pop(value) AS s, avg((value = 0)::INTEGER) AS z, count(*) AS n FROM long GROUP BY ALL",
    # tolerant runs: breakers are clear maps and every (gap+1)-th missing map in a row
    "tol_a": "SELECT *, count(value) OVER (PARTITION BY season_year, season, row_, col_ ORDER BY map_date) AS seen FROM binx",
    "tol_b": "SELECT *, CASE WHEN value = 0 OR value IS NULL AND count(*) FILTER (value IS NULL) OVER (PARTITION BY season_year, season, row_, col_, seen ORDER BY map_date) % 6 = 0 THEN 1 ELSE 0 END AS brk FROM tol_a",
    "tol_c": "SELECT *, sum(brk) OVER (PARTITION BY season_year, season, row_, col_ ORDER BY map_date) AS grp FROM tol_b",
    "tol": "SELECT season_year, season, row_, col_, max(n)::INTEGER AS run FROM (SELECT season_year, season, row_, col_, grp, count(*) FILTER (brk = 0) AS n FROM tol_c GROUP BY ALL) GROUP BY ALL",
    "seas2": "SELECT season_year, season, row_, col_, coalesce(sum(value), 0)::INTEGER AS flooded, count(value)::INTEGER AS valid, CASE WHEN count(value) > 0 THEN max(run) END::INTEGER AS max_run FROM binx JOIN tol USING (season_year, season, row_, col_) GROUP BY ALL",
    "pers": "SELECT row_, col_, count(*) FILTER (flood_frequency > 0)::INTEGER AS persistence, count(*) FILTER (flood_frequency > 0) * 100.0::DOUBLE / (SELECT count(DISTINCT year) FROM haz) AS persistence_pct, least(CASE WHEN avg(flood_duration) > 0 THEN stddev_pop(flood_duration) / avg(flood_duration) ELSE 0.0 END, 5.0)::DOUBLE AS cv, count(flood_frequency) AS valid_years FROM haz GROUP BY ALL",
    "zones": "SELECT *, CASE WHEN cv < 0.3 AND persistence <= 2 THEN 1 WHEN cv < 0.3 THEN 2 WHEN persistence > 2 THEN 3 ELSE 4 END AS zone FROM pers",
    "fac": "SELECT 'county_' || (s_nationkey % 5) AS county_code, 'payam_' || s_nationkey AS payam_code, s_name || ([' PHCC', ' HOSPITAL', ' PHCU'])[s_suppkey % 3 + 1] AS hf_id, 30.0::DOUBLE + ((s_suppkey * 7) % 30)::DOUBLE / 100 AS longitude, 5.0::DOUBLE - ((s_suppkey * 3) % 24)::DOUBLE / 100 AS latitude, CASE WHEN s_suppkey % 10 = 9 THEN ' Not Functional ' WHEN s_suppkey % 10 = 8 THEN NULL ELSE 'Functional' END AS functional_status FROM supplier",
    "facv": "SELECT * FROM fac WHERE functional_status IS NOT NULL AND lower(trim(functional_status)) <> 'not functional' AND county_code IS NOT NULL AND payam_code IS NOT NULL AND hf_id IS NOT NULL",
    "facd": "SELECT * FROM facv QUALIFY row_number() OVER (PARTITION BY longitude, latitude ORDER BY hf_id) = 1",
    "placed": "SELECT *, CASE WHEN b THEN 'PHCC' ELSE 'PHCU' END AS hf_type, CASE WHEN b THEN 60 ELSE 40 END AS buffer_pixels, CASE WHEN b THEN 30 ELSE 20 END AS half, round_even((latitude - 5.0) * 0.01 / (0.01 * -0.01), 0)::INTEGER AS r, round_even((longitude - 30.0) * -0.01 / (0.01 * -0.01), 0)::INTEGER AS c, h.h FROM (SELECT *, contains(upper(hf_id), 'PHCC') OR contains(upper(hf_id), 'HOSPITAL') AS b FROM facd), (SELECT max(vec_id) // 25 + 1 AS h FROM embeddings) h",
    "near": "SELECT hf_id, map_date, row_, col_, value, r, c, half, h, buffer_pixels FROM placed JOIN bin ON row_ >= r - half AND row_ < r + half AND col_ >= c - half AND col_ < c + half WHERE r >= 0 AND r < h AND c >= 0 AND c < 25",
    "bufm": "SELECT hf_id, map_date AS date, (count(*) FILTER (value = 1) > 0)::INTEGER AS binary, CASE WHEN count(value) > 0 THEN count(*) FILTER (value = 1) * 100.0::DOUBLE / count(value) ELSE 0.0 END AS pct_pixels, min(CASE WHEN value = 1 THEN sqrt((row_ - r) ** 2 + (col_ - c) ** 2) * 90 END) AS distance_m, max(4 * half * half) - count(value) AS n_no_data, count(value) AS n_valid_pixels, max(4 * half * half)::BIGINT AS total_pixels_buffer, count(value) * 100.0::DOUBLE / max(4 * half * half) AS pct_valid_data, true AS inside_aoi, bool_or(r - half < 0 OR c - half < 0 OR r + half > h OR c + half > 25) AS buffer_partial FROM near GROUP BY ALL",
    "firsts": "SELECT year(map_date)::INTEGER AS year, min(map_date) AS map_date FROM pix GROUP BY 1",
    "cover": "SELECT hf_id, f.year, EXISTS (SELECT 1 FROM pix p WHERE p.map_date = f.map_date AND p.row_ = r AND p.col_ = c) AS covered FROM placed, firsts f",
    "ann": "SELECT hf_id, year, min_by(hf_category, date) AS hf_category, sum(occurrence)::INTEGER AS flood_days, avg(occurrence) AS flood_freq, coalesce(avg(pct_flooded) FILTER (occurrence = 1), 0.0) AS mean_pct, max(spell_duration)::INTEGER AS max_spell, (max(spell_id) + 1)::INTEGER AS n_spells, CASE WHEN max(spell_id) >= 0 THEN sum(occurrence)::DOUBLE / (max(spell_id) + 1) ELSE 0.0 END AS mean_spell, CASE WHEN year > 1998 THEN 'post' ELSE 'pre' END AS period FROM obs_l GROUP BY hf_id, year",
    "tests": "SELECT hf_id, min_by(hf_category, year) AS hf_category, count(*) FILTER (period = 'pre') AS n_pre, count(*) FILTER (period = 'post') AS n_post, avg(flood_freq) FILTER (period = 'pre') AS mean_pre, avg(flood_freq) FILTER (period = 'post') AS mean_post FROM ann GROUP BY hf_id HAVING count(*) FILTER (period = 'pre') >= 2 AND count(*) FILTER (period = 'post') >= 2",
    "wins": "SELECT a.hf_id, sum(CASE WHEN a.flood_freq > b.flood_freq THEN 1.0 WHEN a.flood_freq = b.flood_freq THEN 0.5 ELSE 0.0 END)::DOUBLE AS u_stat FROM ann a JOIN ann b ON a.hf_id = b.hf_id AND a.period = 'pre' AND b.period = 'post' GROUP BY 1",
    "pct": f"SELECT {', '.join(f'{_q(c, q)} AS {n}_p{round(q * 100):02d}' for n, c, qs in (('dur', 'duration', (0.5, 0.75, 0.9, 0.95, 0.99)), ('int', 'mean_pct_flooded * duration', (0.5, 0.75, 0.9, 0.95, 0.99)), ('dist', 'min_distance', (0.05, 0.1, 0.25, 0.5))) for q in qs)} FROM obs_s",
    "rank_": "SELECT hf_category, round(annual_mean_loss, 9) AS loss FROM syn_st",
    "ranked": "SELECT *, rank() OVER (ORDER BY loss) + (count(*) OVER (PARTITION BY loss) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY loss) AS c FROM rank_",
    "sums": "SELECT hf_category, count(*)::DOUBLE AS n, sum(rk)::DOUBLE AS rs, (SELECT count(*)::DOUBLE FROM ranked) AS total, (SELECT sum(c * c - 1)::DOUBLE FROM ranked) AS ties FROM ranked GROUP BY hf_category",
    "scm": "SELECT scenario_id, avg(w)::DOUBLE AS annual_days, sum(w)::DOUBLE / sum(n) AS flood_freq, coalesce(sum(p) / nullif(sum(w), 0) * 100, 0.0) AS mean_pct_wet FROM (SELECT scenario_id, hf_id, sum(occurrence) AS w, count(*) AS n, sum(pct_flooded) FILTER (occurrence = 1) AS p FROM syn GROUP BY ALL) GROUP BY 1",
    "scm5": "SELECT scm.*, coalesce((SELECT avg((duration >= 5)::INTEGER) FROM syn_s s WHERE s.scenario_id = scm.scenario_id), 0.0)::DOUBLE AS p_spell_ge5 FROM scm",
    "drw": "SELECT * FROM (SELECT 'kappa' AS param, (vec_id % 2)::INTEGER AS chain, (vec_id // 2)::INTEGER AS draw, '0' AS idx, abs(embedding[1]::DOUBLE) AS value FROM embeddings)" + "".join(f" UNION ALL SELECT '{p}', (vec_id % 2)::INTEGER, (vec_id // 2)::INTEGER, 'hf_{i}', embedding[{o + i}]::DOUBLE FROM embeddings" for p, o in (("t_break", 2), ("delta", 33)) for i in range(31)) + " UNION ALL SELECT 'phi', (vec_id % 2)::INTEGER, (vec_id // 2)::INTEGER, '0', abs(embedding[64]::DOUBLE) FROM embeddings",
    "lags": "SELECT *, lag(occurrence) OVER (PARTITION BY hf_id ORDER BY date) AS o_lag, lag(pct_flooded) OVER (PARTITION BY hf_id ORDER BY date) AS p_lag FROM obs",
    "cov": "SELECT *, cos(2 * pi() * day_of_year / 365) AS cos_t, sin(2 * pi() * day_of_year / 365) AS sin_t, (year - 1995)::DOUBLE / 6 AS t_year, least(greatest(pct_flooded, 1e-6), 1 - 1e-6) AS p_clipped, greatest(min_distance, 1e-3) / CASE WHEN buffer_pixels = 40 THEN 2545.5 ELSE 3818.0 END AS d_scaled FROM lags",
    "trend": "SELECT hf_category, year, median(days_flooded / 365.0::DOUBLE) AS flood_freq_med, median(annual_mean_loss) AS mean_loss_med, median(days_loss_gt50::DOUBLE) AS days_gt50_med, median(days_loss_gt75::DOUBLE) AS days_gt75_med FROM obs_st GROUP BY ALL",
}


def _sql(body: str) -> str:
    """The body after the CTEs that it needs, in order of definition; floating results rounded."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTE:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTE[name])
    ctes = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in CTE.items() if n in need)
    return f"WITH {ctes} {body}" if ctes else body


def _r(*names: str, **exprs: str) -> str:
    return ", ".join([*(f"six(({n})) AS {n.split('.')[-1]}" for n in names), *(f"six(({e})) AS {n}" for n, e in exprs.items())])


_ROWCOL = "row_ AS row, col_ AS col"
_TYPE = "CASE WHEN contains(upper(hf_id), 'PHCC') OR contains(upper(hf_id), 'HOSPITAL') THEN"
_STATS = ", ".join(["count(v) AS count", _r(mean="avg(v)", std="stddev_pop(v)", min="min(v)", max="max(v)", median="median(v)", q25=_q("v", 0.25), q75=_q("v", 0.75)), "count(*) FILTER (value = 0) AS zeros", _r(zeros_pct="count(*) FILTER (value = 0) * 100.0 / count(*)")])
_COUNTS = "days_flooded, days_loss_gt50, days_loss_gt75, days_loss_100, n_spells_15plus, hf_category"


def _hist(source: str, v: str, low: float, high: float, bins: int, key: str = "") -> str:
    k, w = f"{key}, " if key else "", (high - low) / bins
    part = f"PARTITION BY {key}" if key else ""
    return f"SELECT {k}bin, {_r(bin_start=f'bin * {w!r}::DOUBLE + {low}')}, n, {_r(density=f'n / (sum(n) OVER ({part}) * {w!r}::DOUBLE)')} FROM (SELECT {k}least(floor(({v} - {low}) / {w!r}::DOUBLE), {bins - 1})::INTEGER AS bin, count(*) AS n FROM {source} WHERE {v} >= {low} AND {v} <= {high} GROUP BY ALL)"


def _suggest() -> str:
    rows = [("spell_days", f"round_even(dur_p{p}, 0)", loss) for p, loss in zip((50, 75, 90, 95, 99), (0.1, 0.25, 0.5, 0.75, 1.0), strict=True)]
    rows += [("intensity", f"round_even(int_p{p}, 2)", loss) for p, loss in zip((75, 90, 95, 99), (0.1, 0.25, 0.5, 0.8), strict=True)]
    rows += [("distance_critical_m", "round_even(dist_p25, 1)", 0.5), ("distance_moderate_m", "round_even(dist_p50, 1)", 0.25)]
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, six(({e}))::DOUBLE AS threshold, {loss}::DOUBLE AS loss FROM pct" for r, e, loss in rows)


_BODIES: dict[str, str] = {
    "binarize": f"SELECT map_date, {_ROWCOL}, value::DOUBLE AS value FROM bin",
    "aoi_bbox": "SELECT min(row_) AS row_min, max(row_) AS row_max, min(col_) AS col_min, max(col_) AS col_max FROM pix WHERE code <> 1 AND map_date = (SELECT min(map_date) FROM pix)",
    "aoi_crop": "SELECT map_date, row_ - r0 AS row, col_ - c0 AS col, code FROM pix, (SELECT min(row_) AS r0, max(row_) AS r1, min(col_) AS c0, max(col_) AS c1 FROM pix WHERE code <> 1 AND map_date = (SELECT min(map_date) FROM pix)) WHERE row_ BETWEEN r0 AND r1 AND col_ BETWEEN c0 AND c1",
    "invalid_code_maps": "SELECT DISTINCT map_date, code FROM pix WHERE code NOT IN (1, 30, 50, 200)",
    "season_label": "SELECT map_date, season, season_year, count(*) AS pixels FROM binx GROUP BY ALL",
    "map_catalog": "SELECT *, CASE WHEN month(map_date) >= 11 OR month(map_date) <= 4 THEN 'dry' ELSE 'wet' END AS season, year(map_date)::INTEGER AS year, (year(map_date) + (month(map_date) >= 11)::INTEGER)::INTEGER AS season_year FROM (SELECT DISTINCT map_date, CASE WHEN day(map_date) % 5 = 0 THEN 'scene_' || strftime(map_date, '%Y%m%d') ELSE 'flood_e' || strftime(map_date, '%Y%m%d') || '_v1.tif' END AS file_name, CASE WHEN day(map_date) % 5 <> 0 THEN map_date END AS strict_date FROM pix)",
    "tile_unpack": f"SELECT map_date, {_ROWCOL}, code FROM pix",
    "window_scan": "SELECT row_ // 5 AS \"window\", row_ AS row, count(*) AS pixels, count(*) FILTER (code = 200) AS flooded FROM pix GROUP BY ALL",
    "hazard_annual": f"SELECT year, {_ROWCOL}, {_r(flood_frequency='avg(value)')}, coalesce(sum(value), 0)::INTEGER AS flood_duration FROM binx GROUP BY year, row_, col_",
    "hazard_seasonal": f"SELECT season_year, season, {_ROWCOL}, {_r(flood_frequency='avg(value)')}, coalesce(sum(value), 0)::INTEGER AS flood_duration FROM binx GROUP BY season_year, season, row_, col_",
    "hazard_annual_3": f"SELECT year, {_ROWCOL}, {_r('flood_frequency')}, flood_duration, valid_obs, max_consecutive FROM haz",
    "hazard_seasonal_2": f"SELECT season_year, season, {_ROWCOL}, flooded, valid, max_run FROM seas2",
    "hazard_annual_2": f"SELECT season_year AS year, {_ROWCOL}, {_r(flood_frequency='sum(flooded)::DOUBLE / nullif(sum(valid), 0)')}, CASE WHEN sum(valid) > 0 THEN sum(flooded) END::INTEGER AS flood_duration, nullif(sum(valid), 0)::INTEGER AS valid_obs, CASE WHEN sum(valid) > 0 THEN max(max_run) END::INTEGER AS max_consecutive FROM seas2 GROUP BY season_year, row_, col_",
    "raster_stats": f"SELECT year, band, {_STATS} FROM (SELECT *, value AS v FROM long) GROUP BY ALL",
    "raster_stats_flooded": f"SELECT year, band, {_STATS} FROM (SELECT *, CASE WHEN value > 0 THEN value END AS v FROM long) GROUP BY ALL",
    "flood_extent": "SELECT year, count(*) FILTER (flood_frequency > 0) AS flooded_pixels, count(flood_frequency) AS valid_pixels FROM haz GROUP BY 1",
    "pixel_consistency": f"SELECT band, {_ROWCOL}, {_r(mean='avg(value)', std='stddev_pop(value)', cv='stddev_pop(value) / (avg(value) + 1e-10)', range='max(value) - min(value)')}, bool_and(value IS NOT NULL) AS all_valid FROM longall GROUP BY band, row_, col_",
    "band_correlation": "SELECT year, pair, six((r)) AS r, six((avg(r) OVER (PARTITION BY pair))) AS mean_r FROM ("
    + " UNION ALL ".join(f"SELECT year, '{a}:{b}' AS pair, CASE WHEN isnan(corr({a}::DOUBLE, {b}::DOUBLE)) THEN NULL ELSE corr({a}::DOUBLE, {b}::DOUBLE) END AS r FROM haz WHERE flood_frequency IS NOT NULL GROUP BY year" for i, a in enumerate(_BANDS) for b in _BANDS[i + 1 :])
    + ")",
    "year_correlation": "SELECT year_1, year_2, band, pixels, six((r)) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT a.year AS year_1, b.year AS year_2, '{b}' AS band, count(*) AS pixels, CASE WHEN min(a.{b}) < max(a.{b}) AND min(b.{b}) < max(b.{b}) THEN corr(a.{b}::DOUBLE, b.{b}::DOUBLE) END AS r FROM haz a JOIN haz b ON a.row_ = b.row_ AND a.col_ = b.col_ AND a.year < b.year WHERE a.flood_frequency IS NOT NULL AND b.flood_frequency IS NOT NULL GROUP BY ALL"
        for b in _BANDS
    )
    + ")",
    "raster_quality": f"SELECT year, count(*) AS total, count(flood_frequency) AS valid, {_r(coverage_pct='count(flood_frequency) * 100.0 / count(*)')}, count(*) FILTER (valid_obs > o) AS count_over_observed, count(*) FILTER (flood_duration > flood_frequency * o + 1e-5) AS duration_over_frequency, count(*) FILTER (max_consecutive > flood_duration + 1e-5) AS consecutive_over_duration, count(*) FILTER (flood_frequency = 0 AND (flood_duration > 0 OR max_consecutive > 0)) AS zero_frequency_conflicts, {_r(completeness_pct='avg(valid_obs) * 100.0 / max(o)')} FROM haz JOIN (SELECT year, count(DISTINCT map_date) - 1 AS o FROM binx GROUP BY 1) USING (year) GROUP BY year",
    "persistence": f"SELECT {_ROWCOL}, persistence, {_r('persistence_pct', 'cv')}, valid_years FROM pers",
    "zone_class": f"SELECT {_ROWCOL}, zone, (['SAFE','CHRONIC','UNSTABLE','CRITICAL'])[zone] AS zone_name FROM zones",
    "zone_shares": f"SELECT zone, (['SAFE','CHRONIC','UNSTABLE','CRITICAL'])[zone] AS zone_name, count(*) AS pixels, {_r(share='count(*)::DOUBLE / sum(count(*)) OVER ()')} FROM (SELECT CASE WHEN cv < 0.3 AND persistence <= 2 THEN 1 WHEN cv < 0.3 THEN 2 WHEN persistence >= 2 THEN 3 ELSE 4 END AS zone FROM pers) GROUP BY zone",
    "monte_carlo_inputs": f"SELECT band, {_r(mean_of_means='avg(m)', std_of_means='stddev_pop(m)', mean_of_stds='avg(s)', std_of_stds='stddev_pop(s)', zero_probability='avg(z)')}, sum(n)::BIGINT AS \"values\" FROM yearly GROUP BY band",
    "lag1_autocorrelation": f"SELECT band, {_r(autocorrelation='CASE WHEN isnan(corr(m, p)) THEN NULL ELSE corr(m, p) END')}, count(p) AS pairs FROM (SELECT *, lag(m) OVER (PARTITION BY band ORDER BY year) AS p FROM yearly) GROUP BY band",
    "zero_share_pivot": "SELECT year, " + ", ".join(f"six((max(z) FILTER (band = '{b}') * 100)) AS zero_{b}" for b in _BANDS) + " FROM yearly GROUP BY year",
    "freq_hist": _hist("haz", "flood_frequency", 0.0, 1.0, 20, "year"),
    "stratified_sample": f"SELECT year, {_ROWCOL}, band, {_r('value')}, stratum FROM (SELECT *, CASE WHEN value = 0 THEN 'zero' ELSE 'positive' END AS stratum FROM long) QUALIFY row_number() OVER (PARTITION BY year, band, stratum ORDER BY md5(row_ || '#' || col_ || '#42'), row_, col_) <= CASE WHEN stratum = 'zero' THEN 1500 ELSE 3500 END",
    "cap_sample": f"SELECT year, {_ROWCOL}, {_r('flood_frequency')}, flood_duration, valid_obs, max_consecutive FROM haz WHERE flood_frequency IS NOT NULL QUALIFY row_number() OVER (ORDER BY md5(year || '#' || row_ || '#' || col_ || '#42')) <= 3000",
    "systematic_sample": f"SELECT {_ROWCOL}, persistence, i // s AS sample_no FROM (SELECT *, row_number() OVER (ORDER BY row_, col_) - 1 AS i, greatest(count(*) OVER () // 1500, 1) AS s FROM pers) WHERE i % s = 0 AND i // s < 1500",
    "variogram": f"SELECT bin, {_r(semivariance='avg(half)')}, count(*) AS pairs, {_r(center='(bin + 0.5) * any_value(far) / 12')} FROM (SELECT *, floor(dist / (far / 12))::INTEGER AS bin FROM (SELECT *, (SELECT quantile_cont(dist, 0.6) FROM prs) AS far FROM prs)) WHERE bin < 12 GROUP BY bin HAVING count(*) > 5",
    "valid_facilities": f"SELECT county_code, payam_code, hf_id, {_r('longitude', 'latitude')}, functional_status FROM facv",
    "facility_type_buffer": f"SELECT hf_id, {_TYPE} 'PHCC' ELSE 'PHCU' END AS hf_type, {_TYPE} 60 ELSE 40 END AS buffer_pixels, {_TYPE} 5400.0::DOUBLE ELSE 3600.0::DOUBLE END AS buffer_meters FROM fac",
    "coordinate_dedup": f"SELECT hf_id, {_r('longitude', 'latitude')} FROM fac QUALIFY row_number() OVER (PARTITION BY fac.longitude, fac.latitude ORDER BY hf_id) = 1",
    "shared_coordinates": f"SELECT {_r('f.longitude', 'f.latitude')}, n AS facilities, hf_id FROM fac f JOIN (SELECT longitude, latitude, count(*) AS n FROM fac GROUP BY ALL HAVING count(*) > 1) g ON f.longitude = g.longitude AND f.latitude = g.latitude",
    "coord_to_pixel": "SELECT hf_id, r AS row, c AS col, r >= 0 AND r < h AND c >= 0 AND c < 25 AS inside, greatest(r - half, 0)::INTEGER AS row_from, least(r + half, h)::INTEGER AS row_to, greatest(c - half, 0)::INTEGER AS col_from, least(c + half, 25)::INTEGER AS col_to FROM placed",
    "facility_pixel_point_lookup": "SELECT hf_id, year, flood_duration, max_consecutive FROM placed JOIN haz ON row_ = r AND col_ = c",
    "facility_pixel_band_join": "SELECT hf_id, count(*) AS pairs, count(*) FILTER (value = 1) AS wet FROM near GROUP BY 1",
    "required_columns": " UNION ALL ".join(f"SELECT '{c}' AS column_name, true AS present, count(*) AS n_rows, count({c}) AS n_filled FROM obs" for c in ("hf_id", "date", "occurrence", "pct_flooded", "min_distance"))
    + " UNION ALL SELECT 'spell_id', false, count(*), 0::BIGINT FROM obs",
    "buffer_metrics": f"SELECT hf_id, date, \"binary\", {_r('pct_pixels', 'distance_m', 'pct_valid_data')}, n_no_data, n_valid_pixels, total_pixels_buffer, inside_aoi, buffer_partial FROM bufm",
    "hf_year_series": "SELECT hf_id, hf_type, buffer_pixels, year(date)::INTEGER AS year, count(*)::INTEGER AS n_days, sum(\"binary\")::INTEGER AS total_flooded_days, '[' || string_agg(\"binary\", ',' ORDER BY date) || ']' AS series_binary, '[' || string_agg(n_no_data, ',' ORDER BY date) || ']' AS series_no_data_count FROM bufm JOIN placed USING (hf_id) GROUP BY ALL",
    "explode_series": f"SELECT hf_id, date, \"binary\" AS occurrence, {_r(pct_flooded='round(pct_pixels, 2) / 100', min_distance='CASE WHEN \"binary\" = 0 THEN CASE WHEN buffer_pixels = 40 THEN 2545.5::DOUBLE ELSE 3818.0::DOUBLE END ELSE round(distance_m, 2) END')}, dayofyear(date)::INTEGER AS day_of_year, year(date)::INTEGER AS year FROM bufm JOIN placed USING (hf_id)",
    "aoi_coverage": "SELECT hf_id, year, covered FROM cover",
    "facilities_outside": "SELECT hf_id, r AS row, c AS col FROM placed WHERE NOT EXISTS (SELECT 1 FROM pix WHERE row_ = r AND col_ = c)",
    "extraction_counters": "SELECT count(*) AS processed, count(*) FILTER (covered) AS inside, count(*) FILTER (NOT covered) AS outside, (SELECT count(*) FROM bufm WHERE n_valid_pixels = 0) AS no_data_days FROM cover",
    "facility_persistence": f"SELECT hf_id, count(*) AS pixels, {_r(persistence='avg(persistence)', persistence_pct='avg(persistence_pct)')} FROM placed JOIN pers ON row_ >= r - half AND row_ < r + half AND col_ >= c - half AND col_ < c + half WHERE r >= 0 AND r < h AND c >= 0 AND c < 25 GROUP BY 1",
    "facility_zone": f"SELECT hf_id, pixels, {_r('persistence', 'cv')}, zone, (['SAFE','CHRONIC','UNSTABLE','CRITICAL'])[zone] AS zone_name FROM (SELECT hf_id, count(*) AS pixels, avg(persistence) AS persistence, avg(cv) AS cv, round_even(avg(zone), 0)::INTEGER AS zone FROM placed JOIN zones ON row_ >= r - half AND row_ < r + half AND col_ >= c - half AND col_ < c + half WHERE r >= 0 AND r < h AND c >= 0 AND c < 25 GROUP BY 1)",
    "annual_metrics": f"SELECT hf_id, year, hf_category, flood_days, {_r('flood_freq', 'mean_pct', 'mean_spell')}, max_spell, n_spells, period FROM ann",
    "annual_summary": f"SELECT year, {_r(mean='avg(flood_freq)', std='stddev_samp(flood_freq)', q05=_q('flood_freq', 0.05), q95=_q('flood_freq', 0.95))}, count(*) AS facilities FROM ann GROUP BY year",
    "pre_post_test": f"SELECT hf_id, hf_category, n_pre, n_post, {_r('mean_pre', 'mean_post', 'u_stat', delta='mean_post - mean_pre')} FROM tests JOIN wins USING (hf_id)",
    "classify_by_delta": "SELECT hf_id, hf_category AS cat_original, CASE reason WHEN 'safe_emerged_high' THEN 'UNSTABLE' WHEN 'critical_now_persistent' THEN 'UNSTABLE' WHEN 'safe_emerged_mid' THEN 'CHRONIC' WHEN 'safe_emerged_low' THEN 'CHRONIC' ELSE hf_category END AS cat_new, change_type, n_post AS n_years_post, reason IN ('safe_emerged_high', 'critical_now_persistent', 'safe_emerged_mid', 'safe_emerged_low') AS reclassified, reason FROM (SELECT *, CASE WHEN n_post < 3 THEN 'uncertain_few_years' WHEN hf_category = 'SAFE' AND change_type = 'SAFE_CHANGED' AND mean_post > 0.6 THEN 'safe_emerged_high' WHEN hf_category = 'SAFE' AND change_type = 'SAFE_CHANGED' AND mean_post > 0.5 THEN 'safe_emerged_mid' WHEN change_type = 'SAFE_EMERGED' THEN 'safe_emerged_low' WHEN hf_category = 'CRITICAL' AND change_type = 'INCREASED' AND mean_post > 0.5 THEN 'critical_now_persistent' ELSE 'no_change' END AS reason FROM (SELECT *, CASE WHEN hf_category = 'SAFE' THEN CASE WHEN sig THEN 'SAFE_CHANGED' WHEN mean_post >= 0.55 THEN 'SAFE_EMERGED' ELSE 'SAFE_CONFIRMED' END WHEN sig AND delta > 0.55 THEN 'INCREASED' WHEN sig AND delta < -0.55 THEN 'DECREASED' WHEN NOT sig AND mean_post < 0.55 THEN 'STABLE_LOW' WHEN NOT sig THEN 'STABLE' ELSE 'MARGINAL' END AS change_type FROM (SELECT *, mean_post - mean_pre AS delta, abs(round(mean_post - mean_pre, 9)) >= 0.02 AS sig FROM tests)))",
    "label_spells": "SELECT hf_id, date, spell_id, spell_duration FROM obs_l",
    "merge_spells": "SELECT hf_id, scenario_id, date, merged_spell_id, merged_duration FROM syn_l",
    "spell_table": f"SELECT hf_id, year, spell_id, start_date, end_date, duration, {_r('mean_pct_flooded', 'min_distance', intensity_idx='mean_pct_flooded * duration')}, hf_category FROM obs_s",
    "spell_lengths": "SELECT hf_id, spell_id, length FROM all_s",
    "max_streak_hold": "SELECT row_ AS row, col_ AS col, CASE WHEN any_value(n) > 0 THEN coalesce(max(k), 0) END::INTEGER AS max_consecutive FROM (SELECT row_, col_, count(value) AS n FROM bin GROUP BY ALL) LEFT JOIN (SELECT row_, col_, isle, count(*) AS k FROM (SELECT *, sum(CASE WHEN pc IS NULL OR clear > pc OR missing - pm > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY row_, col_ ORDER BY map_date) AS isle FROM (SELECT *, lag(clear) OVER v AS pc, lag(missing) OVER v AS pm FROM (SELECT *, count(*) FILTER (value = 0) OVER w AS clear, count(*) FILTER (value IS NULL) OVER w AS missing FROM bin WINDOW w AS (PARTITION BY row_, col_ ORDER BY map_date)) WHERE value = 1 WINDOW v AS (PARTITION BY row_, col_ ORDER BY map_date))) GROUP BY ALL) USING (row_, col_) GROUP BY row_, col_",
    "max_run_tolerant": "SELECT row_ AS row, col_ AS col, CASE WHEN any_value(n) > 0 THEN max(k) END::INTEGER AS max_run FROM (SELECT row_, col_, count(value) AS n FROM bin GROUP BY ALL) JOIN (SELECT row_, col_, grp, count(*) FILTER (brk = 0) AS k FROM (SELECT *, sum(brk) OVER (PARTITION BY row_, col_ ORDER BY map_date) AS grp FROM (SELECT *, CASE WHEN value = 0 OR value IS NULL AND count(*) FILTER (value IS NULL) OVER (PARTITION BY row_, col_, seen ORDER BY map_date) % 4 = 0 THEN 1 ELSE 0 END AS brk FROM (SELECT *, count(value) OVER (PARTITION BY row_, col_ ORDER BY map_date) AS seen FROM bin))) GROUP BY ALL) USING (row_, col_) GROUP BY row_, col_",
    "step_loss_table": f"SELECT spell_duration, {_step('spell_duration', SPELL_DAYS)} AS loss, count(*) AS days FROM obs_l WHERE spell_id >= 0 GROUP BY ALL",
    "combined_loss": f"SELECT hf_id, date, {_r('r1_loss', 'r2_loss', 'r3_loss', 'r4_loss', 'r5_mult', 'combined_loss')} FROM obs_c",
    "combined_loss_inactive": f"SELECT hf_id, scenario_id, date, {_r('combined_loss')} FROM ({_loss('syn_l', (0.5, 0.2, 0.2, 0.1), (1, 0, 1, 1))})",
    "scenario_annual_stats": f"SELECT hf_id, scenario_id, {_COUNTS}, {_r('annual_mean_loss', 'annual_max_loss')} FROM syn_st",
    "observed_year_stats": f"SELECT hf_id, year, {_COUNTS}, {_r('annual_mean_loss', 'annual_max_loss')} FROM obs_st",
    "monthly_loss": f"SELECT hf_id, year, month, {_r('loss')} FROM obs_mon",
    "facility_ranking": f"SELECT hf_id, hf_category, {_r('loss_p50', 'loss_p05', 'loss_p95', 'days_gt50', 'days_gt75', 'p_total')}, row_number() OVER (ORDER BY round(rk.loss_p50, 9) DESC, hf_id)::INTEGER AS rank FROM rk",
    "top_facilities": "SELECT row_number() OVER (ORDER BY round(rk.loss_p50, 9) DESC, hf_id)::INTEGER AS rank, hf_id FROM rk QUALIFY rank <= 30",
    "exceedance_table": "SELECT hf_id, hf_category, " + ", ".join(f"six((avg((annual_mean_loss >= {t})::INTEGER))) AS p_exceed_{round(t * 100)}pct" for t in (0.1, 0.25, 0.5, 0.75, 1.0)) + " FROM syn_st GROUP BY ALL",
    "category_describe": f"SELECT hf_category, count(*) AS n, {_r(median='median(annual_mean_loss)', mean='avg(annual_mean_loss)', p25=_q('annual_mean_loss', 0.25), p75=_q('annual_mean_loss', 0.75), p95=_q('annual_mean_loss', 0.95))} FROM syn_st GROUP BY 1",
    "kruskal_wallis": f"SELECT {_r(h_stat='(12 / (max(total) * (max(total) + 1)) * sum(rs * rs / n) - 3 * (max(total) + 1)) / (1 - max(ties) / (max(total) ** 3 - max(total)))')}, count(*) - 1 AS df FROM sums",
    "dunn_test": "SELECT a.hf_category AS group_1, b.hf_category AS group_2, six((round((a.rs / a.n - b.rs / b.n) / sqrt((a.total * (a.total + 1) / 12 - a.ties / (12 * (a.total - 1))) * (1 / a.n + 1 / b.n)), 3))) AS z_stat FROM sums a JOIN sums b ON a.hf_category < b.hf_category",
    "seasonal_risk": f"SELECT hf_category, month, {_r('median', 'p05', 'p95')}, first_value(month) OVER (PARTITION BY hf_category ORDER BY round(x.median, 9) DESC, month)::INTEGER AS peak_month FROM (SELECT hf_category, month, median(loss) AS median, {_q('loss', 0.05)} AS p05, {_q('loss', 0.95)} AS p95 FROM obs_mon JOIN obs_st USING (hf_id, year) GROUP BY ALL) x",
    "temporal_trend": f"SELECT hf_category, year, {_r('flood_freq_med', 'mean_loss_med', 'days_gt50_med', 'days_gt75_med')} FROM trend",
    "kendall_trend": f"SELECT hf_category, n, {_r(tau='s / sqrt(p * (p - t))')}, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM (SELECT a.hf_category, sum(sign(round(b.flood_freq_med, 9) - round(a.flood_freq_med, 9)))::DOUBLE AS s, count(*)::DOUBLE AS p, count(*) FILTER (round(b.flood_freq_med, 9) = round(a.flood_freq_med, 9)) AS t FROM trend a JOIN trend b ON a.hf_category = b.hf_category AND a.year < b.year GROUP BY 1) JOIN (SELECT hf_category, count(*) AS n FROM trend GROUP BY 1 HAVING count(*) >= 4) USING (hf_category)",
    "trend_regression": f"SELECT hf_category, {_r(slope='regr_slope(days_flooded::DOUBLE, year)', intercept='regr_intercept(days_flooded::DOUBLE, year)', r_squared='regr_r2(days_flooded::DOUBLE, year)')}, count(*) AS n FROM obs_st GROUP BY 1",
    "r1_sensitivity": " UNION ALL ".join(f"SELECT '{label}' AS label, hf_category, six((median(l))) AS median_loss FROM (SELECT hf_id, scenario_id, hf_category, avg(CASE WHEN spell_id >= 0 THEN {_step('spell_duration', limits)} ELSE 0.0 END) AS l FROM syn_l GROUP BY ALL) GROUP BY hf_category" for label, limits in SENSITIVITY_SETS.items()),
    "category_backfill": "SELECT hf_id, hf_category, count(*) AS days FROM syn GROUP BY ALL",
    "spell_percentiles": "SELECT six((COLUMNS(*))) FROM pct",
    "spell_quantiles_by_category": f"SELECT hf_category, {_r(dur_p75=_q('duration', 0.75), dur_p90=_q('duration', 0.9), dur_p95=_q('duration', 0.95))} FROM obs_s GROUP BY 1",
    "annual_severe_spells": "SELECT hf_id, year(start_date)::INTEGER AS year, count(*) AS n_severe FROM obs_s WHERE duration >= 6 GROUP BY ALL",
    "suggest_thresholds": _suggest(),
    "empirical_thresholds": "SELECT "
    + ", ".join(f"six(((SELECT {_q(c, q)} FROM syn_s))) AS {n}_p{round(q * 100)}" for n, c, qs in (("dur", "duration", (0.5, 0.75, 0.9, 0.95, 0.99)), ("int", "mean_pct_flooded * duration", (0.75, 0.9, 0.95, 0.99))) for q in qs)
    + ", "
    + ", ".join(f"six(((SELECT {_q('min_distance', q)} FROM syn WHERE occurrence = 1))) AS dist_p{round(q * 100)}" for q in (0.1, 0.25, 0.5)),
    "ks_two_sample": f"SELECT {_r(d_stat='max(abs(fa - fb))')}, max(na)::BIGINT AS n_1, max(nb)::BIGINT AS n_2 FROM (SELECT v, (SELECT avg((duration <= v)::INTEGER) FROM obs_s WHERE hf_category = 'SAFE') AS fa, (SELECT avg((duration <= v)::INTEGER) FROM obs_s WHERE hf_category = 'CRITICAL') AS fb, (SELECT count(*) FROM obs_s WHERE hf_category = 'SAFE') AS na, (SELECT count(*) FROM obs_s WHERE hf_category = 'CRITICAL') AS nb FROM (SELECT DISTINCT duration AS v FROM obs_s))",
    "boxplot_stats": f"SELECT hf_category, {_r('q1', 'median', 'q3')}, min(duration) FILTER (w) AS low, max(duration) FILTER (w) AS high, count(*) FILTER (NOT w) AS outliers FROM (SELECT *, duration BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS w FROM obs_s JOIN (SELECT hf_category, {_q('duration', 0.25)} AS q1, {_q('duration', 0.5)} AS median, {_q('duration', 0.75)} AS q3 FROM obs_s GROUP BY 1) USING (hf_category)) x GROUP BY hf_category, x.q1, x.median, x.q3",
    "lag_features": f"SELECT hf_id, date, o_lag, {_r('p_lag')} FROM lags WHERE o_lag IS NOT NULL",
    "seasonal_covariates": f"SELECT hf_id, date, {_r('cos_t', 'sin_t', 't_year', 'p_clipped', 'd_scaled')} FROM cov",
    "category_index": "SELECT hf_category, CASE hf_category WHEN 'CHRONIC' THEN 1 WHEN 'UNSTABLE' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE 0 END AS category_idx, count(*) AS n FROM obs GROUP BY ALL",
    "facility_index": "SELECT hf_id, row_number() OVER (ORDER BY hf_id)::INTEGER - 1 AS facility_idx FROM (SELECT DISTINCT hf_id FROM obs)",
    "facility_metadata": f"SELECT hf_id, {_r(latitude='min_by(latitude, date)', longitude='min_by(longitude, date)')}, min_by(buffer_pixels, date) AS buffer_pixels, min_by(hf_payam, date) AS hf_payam, max_by(occurrence, date) AS last_o, {_r(last_p='max_by(pct_flooded, date)')}, max(date) AS last_date FROM obs GROUP BY 1",
    "t_year_of": "SELECT 2005 AS target_year, round(least(greatest((2005 - min(year))::DOUBLE / greatest(max(year) - min(year), 1), 0.0), 2.0), 6) AS t_year FROM obs",
    "union_pool": "SELECT is_synthetic, scenario_id, hf_category, count(*) AS days, sum(occurrence)::BIGINT AS wet FROM (SELECT is_synthetic, scenario_id, hf_category, occurrence FROM obs UNION ALL SELECT is_synthetic, scenario_id, NULL, occurrence FROM syn) GROUP BY ALL",
    "flood_probability": f"SELECT hf_id, date, {_r('transition', p_flood='1 / (1 + exp(-(-0.5 + effect + beta_cat + 2.0 * o_lag + 0.4 * cos_t - 0.3 * sin_t + (delta + gamma_cat) * transition)))', expected_pct='e', shape_a='least(greatest(e * 6, 0.1), 100)', shape_b='least(greatest((1 - e) * 6, 0.1), 100)', expected_log_distance='least(greatest(2.0 + effect - 0.5 * ln(1 + p_lag * 100) + delta_d * transition, -5), 5)')} FROM (SELECT *, 1 / (1 + exp(-(-1.0 + effect + 0.8 * p_lag + 0.2 * cos_t - 0.1 * sin_t + delta_p * transition))) AS e FROM (SELECT *, 1 / (1 + exp(-3.0 * (t_year - t_break))) AS transition FROM (SELECT *, (n % 5) / 10.0::DOUBLE AS effect, (n % 3) / 4.0::DOUBLE AS t_break, (n % 7) / 8.0::DOUBLE - 0.4::DOUBLE AS delta, (n % 4) / 6.0::DOUBLE AS delta_p, (n % 6) / 9.0::DOUBLE AS delta_d, c * 0.2::DOUBLE AS beta_cat, c * 0.1::DOUBLE - 0.1::DOUBLE AS gamma_cat FROM (SELECT *, length(hf_id) * 7 + ascii(right(hf_id, 1)) AS n, CASE hf_category WHEN 'SAFE' THEN 0 WHEN 'CHRONIC' THEN 1 WHEN 'UNSTABLE' THEN 2 ELSE 3 END AS c FROM cov WHERE o_lag IS NOT NULL))))",
    "monthly_frequency": f"SELECT month(date)::INTEGER AS month, {_r(freq='avg(occurrence)')} FROM obs GROUP BY 1",
    "monthly_frequency_syn": f"SELECT month, {_r(**{f'q{round(q * 100):02d}': _q('f', q) for q in (0.5, 0.05, 0.25, 0.75, 0.95)})} FROM (SELECT scenario_id, month(date)::INTEGER AS month, avg(occurrence) AS f FROM syn GROUP BY ALL) GROUP BY 1",
    "spell_exceedance": f"SELECT k, {_r(median='median(p)', p05=_q('p', 0.05), p95=_q('p', 0.95))} FROM (SELECT scenario_id, k, avg((duration >= k)::INTEGER) AS p FROM syn_s, (SELECT unnest(range(1, 31))::INTEGER AS k) GROUP BY ALL) GROUP BY k",
    "spell_length_hist": _hist("all_s", "length", 0.0, 60.0, 30),
    "pct_hist": _hist("(SELECT pct_flooded * 100 AS x FROM obs WHERE occurrence = 1)", "x", 0.0, 100.0, 25),
    "facility_mean_frequency": f"SELECT hf_id, {_r('observed', 'synthetic')} FROM (SELECT hf_id, avg(occurrence) AS observed FROM obs GROUP BY 1) JOIN (SELECT hf_id, median(m) AS synthetic FROM (SELECT hf_id, scenario_id, avg(occurrence) AS m FROM syn GROUP BY ALL) GROUP BY 1) USING (hf_id)",
    "scenario_metrics": f"SELECT scenario_id, {_r('annual_days', 'flood_freq', 'p_spell_ge5', 'mean_pct_wet')} FROM scm5",
    "credible_interval": f"SELECT hf_id, {_r('median', 'q05', 'q95', ci_width='q95 - q05')}, obs_days FROM (SELECT hf_id, median(n::DOUBLE) AS median, {_q('n', 0.05)} AS q05, {_q('n', 0.95)} AS q95 FROM (SELECT hf_id, scenario_id, sum(occurrence) AS n FROM syn GROUP BY ALL) GROUP BY 1) x LEFT JOIN (SELECT hf_id, sum(occurrence)::DOUBLE AS obs_days FROM obs WHERE year = (SELECT max(year) FROM obs) GROUP BY 1) USING (hf_id)",
    "uncertainty_summary": " UNION ALL ".join(f"SELECT '{m}' AS metric, {_r(mean=f'avg({m})', std=f'stddev_pop({m})', p5=_q(m, 0.05), p50=f'median({m})', p95=_q(m, 0.95), width=f'{_q(m, 0.95)} - {_q(m, 0.05)}', cv_pct=f'stddev_pop({m}) / nullif(avg({m}), 0) * 100')} FROM scm5" for m in ("annual_days", "flood_freq", "p_spell_ge5", "mean_pct_wet")),
    "breakpoint_sensitivity": f"SELECT t_year, {_r(mean='avg(m)', p05=_q('m', 0.05), p95=_q('m', 0.95))} FROM (SELECT b.chain, b.draw, t_year, avg(e.value / (1 + exp(-k.value * (t_year - b.value)))) AS m FROM drw b JOIN drw e ON e.param = 'delta' AND b.param = 't_break' AND b.chain = e.chain AND b.draw = e.draw AND b.idx = e.idx JOIN drw k ON k.param = 'kappa' AND k.chain = b.chain AND k.draw = b.draw CROSS JOIN (SELECT unnest([0.8, 0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3])::DOUBLE AS t_year) GROUP BY ALL) GROUP BY t_year",
    "posterior_summary": f"SELECT param, idx, {_r('mean', 'sd', hdi_low='w.lo', hdi_high='w.hi')} FROM (SELECT param, idx, avg(value) AS mean, stddev_samp(value) AS sd FROM drw GROUP BY ALL) x JOIN (SELECT param, idx, value AS lo, hi, row_number() OVER (PARTITION BY param, idx ORDER BY hi - value, value) AS o FROM (SELECT *, first_value(value) OVER (PARTITION BY param, idx ORDER BY i ROWS BETWEEN 0 FOLLOWING AND 0 FOLLOWING) AS me, (SELECT value FROM srt s2 WHERE s2.param = s1.param AND s2.idx = s1.idx AND s2.i = s1.i + floor(s1.n * 0.9)::BIGINT) AS hi FROM srt s1) WHERE hi IS NOT NULL) w USING (param, idx) WHERE w.o = 1",
    "split_rhat": f"SELECT param, idx, {_r(rhat='sqrt(((k - 1)::DOUBLE / k * w + b) / w)')} FROM (SELECT param, idx, var_samp(m) AS b, avg(v) AS w, max(k) AS k FROM (SELECT param, idx, chain, i <= n // 2 AS part, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY param, idx, chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY param, idx, chain) AS n FROM drw) WHERE i <= n // 2 OR i > n - n // 2 GROUP BY ALL) GROUP BY ALL)",
    "subsample_stability": f"SELECT size, {_r(width_annual_days='avg(a)', width_mean_pct='avg(p)')} FROM (SELECT size, rep, {_q('days', 0.95)} - {_q('days', 0.05)} AS a, {_q('pct', 0.95)} - {_q('pct', 0.05)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY size, rep ORDER BY md5(hf_id || '#' || rep || '#' || size || '#42')) AS n FROM (SELECT hf_id, sum(occurrence)::DOUBLE AS days, round(avg(pct_flooded), 9) AS pct FROM syn GROUP BY 1), (SELECT unnest(range(1, 201)) AS rep), (SELECT unnest(range(5, 51, 5))::INTEGER AS size)) WHERE n <= size GROUP BY ALL) GROUP BY size",
}
CTE["rk"] = f"SELECT hf_id, hf_category, median(annual_mean_loss) AS loss_p50, {_q('annual_mean_loss', 0.05)} AS loss_p05, {_q('annual_mean_loss', 0.95)} AS loss_p95, median(days_loss_gt50::DOUBLE) AS days_gt50, median(days_loss_gt75::DOUBLE) AS days_gt75, avg((days_loss_100 > 0)::INTEGER) AS p_total FROM syn_st GROUP BY ALL"
CTE["pts"] = "SELECT row_, col_, cv, i // s AS no FROM (SELECT *, row_number() OVER (ORDER BY row_, col_) - 1 AS i, greatest(count(*) OVER () // 1500, 1) AS s FROM pers) WHERE i % s = 0 AND i // s < 1500"
CTE["prs"] = "SELECT sqrt((a.row_ - b.row_) ** 2 + (a.col_ - b.col_) ** 2)::DOUBLE AS dist, (a.cv - b.cv) ** 2 / 2 AS half FROM pts a JOIN pts b ON a.no < b.no"
CTE["srt"] = "SELECT *, row_number() OVER (PARTITION BY param, idx ORDER BY value) AS i, count(*) OVER (PARTITION BY param, idx) AS n FROM drw"


def _simpson(f: str, low: str, high: str, n: int = 2000) -> str:
    """The integral of f (of x) from low to high."""
    x = f"({low}) + (({high}) - ({low})) * i / {n}"
    return f"((({high}) - ({low})) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f.replace('@', x)}))))"


def _normal_p(z: str) -> str:
    """Two-sided tail of the normal distribution, 0 beyond nine deviations."""
    inside = _simpson("exp(-(@) * (@) / 2)", "0.0::DOUBLE", f"least(abs({z}), 9.0::DOUBLE)")
    return f"greatest(0.0::DOUBLE, 1 - 2 / sqrt(2 * pi()) * {inside})"


def _t_p(t: str, df: str) -> str:
    inside = _simpson(f"pow(cos(@), ({df}) - 1)", "0.0::DOUBLE", f"atan(abs({t}) / sqrt({df}))")
    return f"greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) * {inside})"


def _stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def _regression_p(source: str, group: str, x: str, y: str) -> str:
    inner = f"SELECT {group}, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r_squared, count(*) AS n FROM {source} GROUP BY {group}"
    return f"SELECT *, CASE WHEN n > 2 AND r_squared < 1 THEN {_t_p('sqrt(r_squared * (n - 2) / (1 - r_squared))', 'n - 2')} END AS p FROM ({inner})"


def _calibrated() -> str:
    """The loss under thresholds taken from the spells' own percentiles, one row of them in cal."""
    step = lambda v, names: "CASE " + " ".join(f"WHEN {v} >= {n} THEN {x}::DOUBLE" for n, x in names) + " ELSE 0.0::DOUBLE END"
    spell = [(f"d{p}", x) for p, x in ((99, 1.0), (95, 0.75), (90, 0.5), (75, 0.25), (50, 0.1))]
    rules = [step("spell_duration", spell), step("mean_pct_flooded * spell_duration", [(f"i{p}", x) for p, x in ((99, 0.8), (95, 0.5), (90, 0.25), (75, 0.1))]), "CASE WHEN min_distance < near1 THEN 0.5::DOUBLE WHEN min_distance < near2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END", step("merged_duration", spell)]
    score = " + ".join(f"{w}::DOUBLE * CASE WHEN spell_id >= 0 THEN {r} ELSE 0.0::DOUBLE END" for w, r in zip(WEIGHTS, rules, strict=True))
    mult = "CASE hf_category WHEN 'CHRONIC' THEN 1.2::DOUBLE WHEN 'UNSTABLE' THEN 1.4::DOUBLE WHEN 'CRITICAL' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END"
    return f"SELECT hf_id, year, least(greatest(({score}) / {sum(WEIGHTS)}::DOUBLE * {mult}, 0.0::DOUBLE), 1.0::DOUBLE) AS combined_loss FROM obs_l, cal"


_NEW = "CASE reason WHEN 'safe_emerged_high' THEN 'UNSTABLE' WHEN 'critical_now_persistent' THEN 'UNSTABLE' WHEN 'safe_emerged_mid' THEN 'CHRONIC' WHEN 'safe_emerged_low' THEN 'CHRONIC' ELSE hf_category END"
_KS = "SELECT max(abs(fa - fb)) AS d_stat, max(na)::BIGINT AS n_1, max(nb)::BIGINT AS n_2 FROM (SELECT v, (SELECT avg((duration <= v)::INTEGER) FROM obs_s WHERE hf_category = 'SAFE') AS fa, (SELECT avg((duration <= v)::INTEGER) FROM obs_s WHERE hf_category = 'CRITICAL') AS fb, (SELECT count(*) FROM obs_s WHERE hf_category = 'SAFE') AS na, (SELECT count(*) FROM obs_s WHERE hf_category = 'CRITICAL') AS nb FROM (SELECT DISTINCT duration AS v FROM obs_s))"

# rank tests: the exact distribution of U by all ways to choose the ranks of the first group, else the normal one
CTE["mw_sizes"] = "SELECT DISTINCT n_pre AS n, n_post AS m FROM tests"
CTE["mw_u"] = "SELECT n, m, list_sum(list_transform(range(0, n + m), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n * (n + 1) / 2 AS u FROM (SELECT n, m, unnest(range(0, (1::BIGINT << (n + m)::INTEGER))) AS mask FROM mw_sizes) WHERE bit_count(mask) = n"
CTE["mw_ties"] = "SELECT hf_id, sum(c * (c * c - 1))::DOUBLE AS ties FROM (SELECT hf_id, flood_freq, count(*) AS c FROM ann GROUP BY ALL) GROUP BY hf_id"
CTE["mw_z"] = "SELECT tests.*, mean_post - mean_pre AS delta, u_stat, ties, n_pre * n_post / 12.0 * ((n_pre + n_post + 1) - ties / ((n_pre + n_post) * (n_pre + n_post - 1))) AS var FROM tests JOIN wins USING (hf_id) JOIN mw_ties USING (hf_id)"
CTE["mw_p"] = f"SELECT *, CASE WHEN ties = 0 AND least(n_pre, n_post) <= 8 THEN least(1.0::DOUBLE, 2.0 * (SELECT count(*) FROM mw_u WHERE n = n_pre AND m = n_post AND u >= ceil(greatest(u_stat, n_pre * n_post - u_stat))) / (SELECT count(*) FROM mw_u WHERE n = n_pre AND m = n_post)) WHEN var <= 0 THEN 1.0::DOUBLE ELSE {_normal_p('greatest(0.0::DOUBLE, abs(u_stat - n_pre * n_post / 2.0) - 0.5) / sqrt(var)')} END AS pval FROM mw_z"
CTE["recl_c"] = "SELECT *, CASE WHEN hf_category = 'SAFE' THEN CASE WHEN sig THEN 'SAFE_CHANGED' WHEN mean_post >= 0.1 THEN 'SAFE_EMERGED' ELSE 'SAFE_CONFIRMED' END WHEN sig AND delta > 0.1 THEN 'INCREASED' WHEN sig AND delta < -0.1 THEN 'DECREASED' WHEN NOT sig AND mean_post < 0.1 THEN 'STABLE_LOW' WHEN NOT sig THEN 'STABLE' ELSE 'MARGINAL' END AS change_type FROM (SELECT *, pval < 0.05 AS sig FROM mw_p)"
CTE["recl_r"] = "SELECT *, CASE WHEN n_post < 3 THEN 'uncertain_few_years' WHEN hf_category = 'SAFE' AND change_type = 'SAFE_CHANGED' AND mean_post > 0.4 THEN 'safe_emerged_high' WHEN hf_category = 'SAFE' AND change_type = 'SAFE_CHANGED' AND mean_post > 0.1 THEN 'safe_emerged_mid' WHEN hf_category = 'SAFE' AND change_type = 'SAFE_EMERGED' THEN 'safe_emerged_low' WHEN hf_category = 'CRITICAL' AND change_type = 'INCREASED' AND mean_post > 0.5 THEN 'critical_now_persistent' ELSE 'no_change' END AS reason FROM recl_c"
CTE["recl"] = f"SELECT hf_id, hf_category AS cat_original, {_NEW} AS cat_new, mean_pre, mean_post, delta, pval, change_type, n_post AS n_years_post, {_NEW} <> hf_category AS reclassified, reason FROM recl_r"
CTE["dunn"] = f"SELECT *, {_normal_p('z')} AS p_raw FROM (SELECT a.hf_category AS group_1, b.hf_category AS group_2, (a.rs / a.n - b.rs / b.n) / sqrt((a.total * (a.total + 1) / 12 - a.ties / (12 * (a.total - 1))) * (1 / a.n + 1 / b.n)) AS z FROM sums a JOIN sums b ON a.hf_category < b.hf_category)"
CTE["kru"] = "SELECT (12 / (max(total) * (max(total) + 1)) * sum(rs * rs / n) - 3 * (max(total) + 1)) / (1 - max(ties) / (max(total) ** 3 - max(total))) AS h_stat, count(*) - 1 AS df FROM sums"
CTE["cal"] = "SELECT round_even(dur_p50, 0) AS d50, round_even(dur_p75, 0) AS d75, round_even(dur_p90, 0) AS d90, round_even(dur_p95, 0) AS d95, round_even(dur_p99, 0) AS d99, round_even(int_p75, 2) AS i75, round_even(int_p90, 2) AS i90, round_even(int_p95, 2) AS i95, round_even(int_p99, 2) AS i99, round_even(dist_p25, 1) AS near1, round_even(dist_p50, 1) AS near2 FROM pct"
CTE["kdt"] = "SELECT hf_category, year, round(mean_loss_med, 9) AS v FROM trend"
CTE["kds"] = "SELECT a.hf_category, sum(sign(b.v - a.v))::DOUBLE AS s, count(*)::DOUBLE AS pairs, count(*) FILTER (b.v = a.v) AS t FROM kdt a JOIN kdt b ON a.hf_category = b.hf_category AND a.year < b.year GROUP BY 1"
CTE["kdn"] = "SELECT hf_category, sum(c)::BIGINT AS n, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS tied FROM (SELECT hf_category, v, count(*) AS c FROM kdt GROUP BY ALL) GROUP BY 1 HAVING sum(c) >= 4"
# a permutation is a number in the factorial system, and the sum of its digits its inversions
CTE["perm"] = "SELECT n, inversions, count(*) AS ways FROM (SELECT n, list_sum(list_transform(range(1, n), lambda i: (code // factorial(i::INTEGER)::BIGINT) % (i + 1))) AS inversions FROM (SELECT n, unnest(range(0, factorial(n::INTEGER)::BIGINT)) AS code FROM (SELECT DISTINCT n FROM kdn WHERE tied = 0))) GROUP BY ALL"
CTE["kend"] = f"SELECT hf_category, n, s / sqrt(pairs * (pairs - t)) AS tau, CASE WHEN tied > 0 THEN {_normal_p('s / sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18)')} WHEN s = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(ways) FROM perm WHERE perm.n = kdn.n AND inversions <= (pairs - abs(s)) / 2) / factorial(kdn.n::INTEGER)::DOUBLE) END AS p FROM kds JOIN kdn USING (hf_category)"
CTE["ks2"] = _KS
CTE["bandlines"] = _regression_p("yearly", "band", "year", "m")
CTE["floodlines"] = _regression_p("(SELECT hf_category, year, days_flooded::DOUBLE AS y FROM obs_st)", "hf_category", "year", "y")
CTE["frq"] = "SELECT flood_frequency AS x, count(*) AS c FROM haz WHERE flood_frequency > 0 GROUP BY 1"
CTE["lgn"] = "SELECT stddev_pop(ln(flood_frequency)) AS a, exp(avg(ln(flood_frequency))) AS b, count(*) AS n FROM haz WHERE flood_frequency > 0"
CTE["lgd"] = f"SELECT *, CASE WHEN z > 0 THEN 1 - p / 2 ELSE p / 2 END AS f FROM (SELECT *, {_normal_p('z')} AS p FROM (SELECT x, c, a, b, n, ln(x / b) / a AS z, sum(c) OVER (ORDER BY x) AS upto FROM frq, lgn))"
CTE["frq_b"] = "SELECT '' AS g, x, c, true AS bounded FROM frq"
CTE |= stats_sql.fits("all", "frq_b")
CTE["samp"] = f"SELECT * FROM (SELECT *, CASE WHEN value = 0 THEN 'zero' ELSE 'positive' END AS stratum FROM long) QUALIFY row_number() OVER (PARTITION BY year, band, stratum ORDER BY md5(row_ || '#' || col_ || '#42'), row_, col_) <= CASE WHEN stratum = 'zero' THEN 1500 ELSE 3500 END"
CTE["samp_b"] = "SELECT band AS g, value AS x, count(*) AS c, band = 'flood_frequency' AS bounded FROM samp WHERE value > 0 GROUP BY ALL"
CTE |= stats_sql.fits("own", "samp_b")
CTE["ks_at"] = "SELECT v, sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b FROM (SELECT round(mean_pct, 9) AS v, count(*) FILTER (period = 'pre') AS a, count(*) FILTER (period = 'post') AS b FROM ann WHERE hf_category = 'SAFE' GROUP BY 1)"
CTE["ks_pre"] = "SELECT max(abs(a / n_1 - b / n_2)) AS d_stat, n_1, n_2 FROM (SELECT a, b, max(a) OVER ()::BIGINT AS n_1, max(b) OVER ()::BIGINT AS n_2 FROM ks_at) WHERE n_1 > 5 AND n_2 > 5 GROUP BY ALL"
CTE |= stats_sql.diagnosis("drw")
CTE["hfy"] = "SELECT hf_id, hf_type, buffer_pixels, year(date)::INTEGER AS year, count(*)::INTEGER AS n_days, sum(\"binary\")::INTEGER AS total_flooded_days, '[' || string_agg(\"binary\", ',' ORDER BY date) || ']' AS series_binary, '[' || string_agg(n_no_data, ',' ORDER BY date) || ']' AS series_no_data_count FROM bufm JOIN placed USING (hf_id) GROUP BY ALL"
CTE["patch"] = "SELECT hf_id, round_even(avg(zone), 0)::INTEGER AS zone FROM placed JOIN zones ON row_ >= r - half AND row_ < r + half AND col_ >= c - half AND col_ < c + half WHERE r >= 0 AND r < h AND c >= 0 AND c < 25 GROUP BY 1"
CTE["evw"] = "SELECT DISTINCT 'hf_' || user_id AS hf_id, ts::DATE AS day FROM events"
CTE["evs"] = "SELECT *, sum(CASE WHEN before IS NULL OR day - before > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY hf_id ORDER BY day) AS grp FROM (SELECT *, lag(day) OVER (PARTITION BY hf_id ORDER BY day) AS before FROM evw)"
# held streaks over the whole series of a pixel
CTE["hold_w"] = "SELECT row_, col_, isle, count(*) AS k FROM (SELECT *, sum(CASE WHEN pc IS NULL OR clear > pc OR missing - pm > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY row_, col_ ORDER BY map_date) AS isle FROM (SELECT *, lag(clear) OVER v AS pc, lag(missing) OVER v AS pm FROM (SELECT *, count(*) FILTER (value = 0) OVER w AS clear, count(*) FILTER (value IS NULL) OVER w AS missing FROM bin WINDOW w AS (PARTITION BY row_, col_ ORDER BY map_date)) WHERE value = 1 WINDOW v AS (PARTITION BY row_, col_ ORDER BY map_date))) GROUP BY ALL"

CTE["hold_all"] = "SELECT row_, col_, count(value) AS valid_obs, coalesce(sum(value), 0)::BIGINT AS flood_duration, max(map_date) FILTER (value = 1) AS last_flood FROM bin GROUP BY ALL"
CTE["hold_after"] = "SELECT a.row_, a.col_, count(*) FILTER (value = 0) AS clear, count(*) FILTER (value IS NULL AND map_date IS NOT NULL) AS missing FROM hold_all a LEFT JOIN bin b ON a.row_ = b.row_ AND a.col_ = b.col_ AND b.map_date > a.last_flood GROUP BY ALL"
CTE["hold_now"] = "SELECT a.*, clear, missing, coalesce(k, 0) AS k, coalesce(most, 0)::BIGINT AS max_consecutive FROM hold_all a JOIN hold_after USING (row_, col_) LEFT JOIN (SELECT row_, col_, arg_max(k, isle) AS k, max(k) AS most FROM hold_w GROUP BY ALL) USING (row_, col_)"


_PCT = [f"{n}_p{round(q * 100):02d}" for n, qs in (("dur", (0.5, 0.75, 0.9, 0.95, 0.99)), ("int", (0.5, 0.75, 0.9, 0.95, 0.99)), ("dist", (0.05, 0.1, 0.25, 0.5))) for q in qs]
_PCT_NAMES, _PCT_VALUES = ", ".join(f"'{n}'" for n in _PCT), ", ".join(f"six(({n}))" for n in _PCT)


def _results() -> str:
    """Every value of the result tables: their names, the rows' keys, the columns."""
    stats = ["days_flooded", "annual_mean_loss", "annual_max_loss", "days_loss_gt50", "days_loss_gt75", "days_loss_100", "n_spells_15plus"]
    tables = {
        "scenario_stats": (_BODIES["scenario_annual_stats"], "hf_id || '|' || scenario_id", stats),
        "observed_stats": (_BODIES["observed_year_stats"], "hf_id || '|' || year", stats),
        "ranking": (_BODIES["facility_ranking"], "hf_id || '|' || hf_category", ["loss_p50", "loss_p05", "loss_p95", "days_gt50", "days_gt75", "p_total", "rank"]),
        "exceedance": (_BODIES["exceedance_table"], "hf_id || '|' || hf_category", [f"p_exceed_{t}pct" for t in (10, 25, 50, 75, 100)]),
        "categories": (_BODIES["category_describe"], "hf_category", ["n", "median", "mean", "p25", "p75", "p95"]),
        "seasons": (_BODIES["seasonal_risk"], "hf_category || '|' || month", ["median", "p05", "p95", "peak_month"]),
    }
    one = lambda name, body, key, columns: f"SELECT '{name}' AS name, {key} AS key, unnest([{', '.join(repr(c) for c in columns)}]) AS metric, unnest([{', '.join(f'x.{c}::DOUBLE' for c in columns)}]) AS value FROM ({body}) x"
    return " UNION ALL ".join(one(n, *t) for n, t in tables.items())


def _sum_of(pool: str, part: str) -> str:
    return f"SELECT hf_id, count(*) AS days, sum(occurrence)::BIGINT AS wet, {_r(pct='sum(pct_flooded)', nearest='min(min_distance)')}, '{part}' AS part FROM {pool} GROUP BY hf_id"


_META = "SELECT '{\"records\":' || (SELECT count(*) FROM hfy) || ',\"facilities\":' || (SELECT count(DISTINCT hf_id) FROM hfy) || ',\"years\":[' || (SELECT string_agg(year, ',' ORDER BY year) FROM (SELECT DISTINCT year FROM hfy)) || '],\"buffers\":[' || (SELECT string_agg(buffer_pixels, ',' ORDER BY buffer_pixels) FROM (SELECT DISTINCT buffer_pixels FROM hfy)) || '],\"types\":{' || (SELECT string_agg('\"' || hf_type || '\":' || n, ',' ORDER BY hf_type) FROM (SELECT hf_type, count(DISTINCT hf_id) AS n FROM hfy GROUP BY 1)) || '}}' AS metadata"

_BODIES.update({
    "pixel_window_scan": "SELECT row_ AS row, count(*) AS pixels, count(*) FILTER (code = 200) AS flooded FROM pix WHERE row_ < 10 GROUP BY 1",
    "facility_csv_scan": f"SELECT county_code, payam_code, hf_id, {_r('longitude', 'latitude')}, trim(functional_status) AS functional_status FROM fac",
    "pool_arrays_scan": "SELECT hf_id, year, n_days, series_binary, total_flooded_days FROM hfy",
    "pool_csv_scan": f"SELECT hf_id, date, occurrence, {_r('pct_flooded', 'min_distance')}, year FROM obs",
    "pool_by_facility_scan": "SELECT 'PHCC_a_b_' || hf_id AS hf_key, 'PHCC a/b ' || hf_id AS hf_id, count(*) AS days, sum(occurrence)::BIGINT AS wet FROM obs GROUP BY ALL",
    "draws_scan": f"SELECT param, idx, chain, count(*) AS n, {_r(low='min(value)', high='max(value)')} FROM drw GROUP BY ALL",
    "observed_synthetic_split": f"{_sum_of('obs', 'observed')} UNION ALL {_sum_of('syn', 'synthetic')}",
    "new_maps_written": "SELECT map_date, count(*) AS pixels, sum(code)::BIGINT AS codes, CASE WHEN year(map_date) = 2012 THEN 1 ELSE 2 END AS call FROM pix GROUP BY map_date",
    "hazard_written": f"SELECT year, {_ROWCOL}, {_r(flood_frequency='coalesce(flood_frequency, -9999)')}, {', '.join(f'coalesce({b}, -9999)::INTEGER AS {b}' for b in _BANDS[1:])}, {_r(flood_frequency_masked='flood_frequency')}, {', '.join(f'{b} AS {b}_masked' for b in _BANDS[1:])} FROM haz",
    "review_list": "SELECT strftime(map_date, '%Y-%m-%d') || ' [' || string_agg(code, ',' ORDER BY code) || ']' AS line FROM (SELECT DISTINCT map_date, code FROM pix WHERE code NOT IN (1, 200)) GROUP BY map_date",
    "year_summary_csv": "SELECT hf_id, hf_type, year, n_days, total_flooded_days FROM hfy",
    "pool_metadata": _META,
    "pool_metadata_document": _META,
    "pool_arrays_export": "SELECT hf_id, year, series_no_data_count FROM hfy",
    "results_written": _results(),
    "calibration_report": f"{_suggest()} UNION ALL SELECT unnest([{_PCT_NAMES}]), unnest([{_PCT_VALUES}]), NULL::DOUBLE FROM pct",
    "facility_zone_join": "SELECT hf_id, year, total_flooded_days, zone, (['SAFE','CHRONIC','UNSTABLE','CRITICAL'])[zone] AS zone_name FROM hfy JOIN patch USING (hf_id)",
    "post_year_counts": "SELECT hf_id, hf_category, CASE WHEN hf_category = 'SAFE' THEN 0 ELSE count(*) FILTER (period = 'post') END::INTEGER AS n_years_post FROM ann GROUP BY hf_id, hf_category",
    "scenario_grid": "SELECT hf_id, s::INTEGER AS scenario_id, 365::BIGINT AS days, DATE '2026-01-01' AS first_date, DATE '2026-12-31' AS last_date, (365 * 366 / 2)::BIGINT AS day_sum FROM (SELECT DISTINCT hf_id FROM obs), (SELECT unnest(range(0, 50)) AS s)",
    "kruskal_wallis_p": f"SELECT {_r('h_stat')}, df, {_r(p='CASE df WHEN 1 THEN ' + _normal_p('sqrt(h_stat)') + ' WHEN 2 THEN exp(-h_stat / 2) WHEN 3 THEN ' + _normal_p('sqrt(h_stat)') + ' + sqrt(2 * h_stat / pi()) * exp(-h_stat / 2) END')} FROM kru",
    "dunn_test_p": f"SELECT group_1, group_2, {_r(z_stat='round(z, 3)', p_raw='p_raw', p_bonf='b')}, {_stars('b')} AS sig FROM (SELECT *, least(p_raw * count(*) OVER (), 1.0::DOUBLE) AS b FROM dunn)",
    "mann_whitney_pre_post": f"SELECT hf_id, hf_category, n_pre, n_post, {_r('mean_pre', 'mean_post', 'delta', 'u_stat', 'pval')}, pval < 0.05 AS significant FROM mw_p",
    "reclassify": f"SELECT hf_id, cat_original, cat_new, {_r('mean_pre', 'mean_post', 'delta', 'pval')}, change_type, n_years_post, reclassified, reason FROM recl",
    "movement_counts": f"SELECT cat_original, cat_new, n, {_r(share='n / sum(n) OVER (PARTITION BY cat_original)')} FROM (SELECT cat_original, cat_new, count(*) AS n FROM recl GROUP BY ALL)",
    "reclassified_pool": "SELECT cat_new AS hf_category, count(*) AS days, sum(occurrence)::BIGINT AS wet FROM obs JOIN recl USING (hf_id) GROUP BY cat_new",
    "calibrated_loss": f"SELECT hf_id, year, {_r(annual_mean_loss='avg(combined_loss)', annual_max_loss='max(combined_loss)')} FROM ({_calibrated()}) GROUP BY ALL",
    "trend_regression_p": f"SELECT hf_category, {_r('slope', 'intercept', 'r_squared')}, n, {_r('p')}, p < 0.05 AS significant FROM floodlines",
    "trend_by_band": f"SELECT band, {_r('slope', 'intercept', 'r_squared', p_value='p')}, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS trend, n AS years FROM bandlines",
    "band_trend_p": f"SELECT band, {_r('slope', 'r_squared', 'p')}, n FROM bandlines",
    "fit_lognormal": f"SELECT 'lognorm' AS distribution, {_r('a', 'b', ks='max(greatest(upto / n - f, f - (upto - c) / n))')} FROM lgd GROUP BY lgd.a, lgd.b",
    "fit_positive_distribution": f"SELECT distribution, {_r('a', 'b', 'ks')}, row_number() OVER (ORDER BY all_ks.ks, distribution) = 1 AS chosen FROM all_ks",
    "fit_by_band": f"SELECT g AS band, distribution, {_r('a', 'b', 'ks')}, row_number() OVER (PARTITION BY g ORDER BY own_ks.ks, distribution) = 1 AS chosen FROM own_ks",
    "ks_two_sample_exact": f"SELECT {_r('d_stat')}, n_1, n_2, {_r(p=stats_sql.two_sample_p('d_stat'))} FROM ks_pre",
    "rhat_ess": f"SELECT param, idx, {_r('rhat', 'ess')}, flagged FROM dia_out",
    "ks_two_sample_p": f"SELECT {_r('d_stat')}, n_1, n_2, {_r(p='CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x))))) END')} FROM (SELECT *, (sqrt(en) + 0.12 + 0.11 / sqrt(en)) * d_stat AS x FROM (SELECT *, n_1 * n_2 / (n_1 + n_2)::DOUBLE AS en FROM ks2)) WHERE n_1 > 5 AND n_2 > 5",
    "kendall_trend_loss": f"SELECT hf_category, n, {_r('tau', 'p')}, CASE WHEN tau > 0 THEN 'increasing' WHEN tau < 0 THEN 'decreasing' ELSE 'flat' END AS direction, {_stars('p')} AS sig FROM kend",
    "session_spells_stream": "SELECT hf_id, min(day) AS start_date, max(day) AS end_date, (max(day) - min(day) + 1)::INTEGER AS length, count(*) AS wet_days FROM evs GROUP BY hf_id, grp",
    "incremental_streak_stream": "SELECT row_ AS row, col_ AS col, valid_obs, flood_duration, CASE WHEN clear = 0 AND missing <= 2 THEN k ELSE 0 END::BIGINT AS streak, max_consecutive FROM hold_now",
    "pool_pruned_scan": f"SELECT 'hf_' || hk AS hf_id, hf_category AS category, count(*) AS days, sum(occurrence)::BIGINT AS wet, {_r(pct='sum(pct_flooded)')} FROM (SELECT replace(hf_id, 'hf_', '') AS hk, * FROM obs) WHERE hf_category = 'CRITICAL' GROUP BY ALL",
    "hazard_years_scan": f"SELECT year, {_ROWCOL}, {_r('flood_frequency')}, valid_obs, observed_days, {_r(valid_share='valid_obs / observed_days')} FROM haz JOIN (SELECT year(map_date)::INTEGER AS year, count(DISTINCT map_date) AS observed_days FROM pix GROUP BY 1) USING (year) WHERE year >= 2013",
})

#: Results with dates, which are given as text.
_DATES = {
    **dict.fromkeys(("binarize", "aoi_crop", "invalid_code_maps", "season_label", "tile_unpack"), ("map_date",)),
    **dict.fromkeys(("buffer_metrics", "explode_series", "label_spells", "merge_spells", "combined_loss", "combined_loss_inactive", "lag_features", "seasonal_covariates", "flood_probability"), ("date",)),
    "map_catalog": ("map_date", "strict_date"),
    "spell_table": ("start_date", "end_date"),
    "facility_metadata": ("last_date",),
    "pool_csv_scan": ("date",),
    "new_maps_written": ("map_date",),
    "scenario_grid": ("first_date", "last_date"),
    "session_spells_stream": ("start_date", "end_date"),
}


def _six(sql: str) -> str:
    """six((x)) spelled out: x at six places after ten, both half to even, which is the same arithmetic in any engine."""
    while (at := sql.find("six((")) >= 0:
        depth, end = 2, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = f"({sql[at + 5 : end - 2]})::DOUBLE"
        sql = f"{sql[:at]}CASE WHEN abs({x}) < 5e-7 THEN 0.0::DOUBLE ELSE round_even(round_even({x} * 1e10, 0) / 1e10 * 1e6, 0) / 1e6 END{sql[end:]}"
    return sql


def _texts(name: str, body: str) -> str:
    dates = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in _DATES.get(name, ()))
    return f"SELECT * REPLACE ({dates}) FROM ({body})" if dates else body


ORACLES: dict[str, str] = {name: _six(_sql(_texts(name, body))) for name, body in _BODIES.items()}
