"""SQL of the iterative statistics, written apart from the operators: Newton steps as list_reduce over plain counts, series
by lgamma term by term, lattice paths row by row, chains of draws by self-joins over all lags."""

from __future__ import annotations


def psi(x: str) -> str:
    s = f"(({x}) + 25)"
    return f"(ln{s} - 0.5 / {s} - 1 / (12 * pow({s}, 2)) + 1 / (120 * pow({s}, 4)) - 1 / (252 * pow({s}, 6)) - list_sum(list_transform(range(0, 25), lambda pj: 1 / (({x}) + pj))))"


def psi1(x: str) -> str:
    s = f"(({x}) + 25)"
    return f"(1 / {s} + 1 / (2 * pow({s}, 2)) + 1 / (6 * pow({s}, 3)) - 1 / (30 * pow({s}, 5)) + 1 / (42 * pow({s}, 7)) + list_sum(list_transform(range(0, 25), lambda pj: 1 / pow(({x}) + pj, 2))))"


def lower_gamma(a: str, x: str) -> str:
    terms = f"ceil(greatest({x} - {a}, 0) + 12 * sqrt({x}) + 60)::INTEGER"
    return f"least(1.0::DOUBLE, list_sum(list_transform(range(0, {terms}), lambda gn: exp(({a} + gn) * ln({x}) - {x} - lgamma({a} + gn + 1)))))"


def phi(z: str) -> str:
    """Distribution function of the normal; its lower tail beyond one deviation and a half by the fraction, so that it stays exact."""
    return f"CASE WHEN abs({z}) < 1e-12 THEN 0.5::DOUBLE WHEN {z} > 0 THEN 1 - {scaled_tail('abs(' + z + ')')} * exp(-({z}) * ({z}) / 2) ELSE {scaled_tail('abs(' + z + ')')} * exp(-({z}) * ({z}) / 2) END"


def scaled_tail(w: str) -> str:
    """exp(w^2 / 2) times the upper tail of the normal at w > 0."""
    fraction = f"1 / (sqrt(2 * pi()) * list_reduce(list_transform(range(0, 200), lambda ek: (200 - ek)::DOUBLE), lambda ef, ek: {w} + ek / ef, {w}::DOUBLE))"
    return f"CASE WHEN {w} > 1.5 THEN {fraction} ELSE exp(({w}) * ({w}) / 2) * (1 - {lower_gamma('0.5::DOUBLE', '((' + w + ') * (' + w + ') / 2)')}) / 2 END"


def lower_beta(a: str, b: str, x: str) -> str:
    def side(a: str, b: str, x: str) -> str:
        terms = f"least(20000, ceil(45 / -ln({x}) + 12 * sqrt({a} + {b}) + 60))::INTEGER"
        return f"list_sum(list_transform(range(0, {terms}), lambda bn: exp(lgamma({a} + {b} + bn) - lgamma({b}) - lgamma({a} + bn + 1) + ({a} + bn) * ln({x}) + {b} * ln(1 - ({x})))))"

    return f"CASE WHEN {x} >= 1 THEN 1.0::DOUBLE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {side(b, a, f'(1 - {x})')} ELSE {side(a, b, x)} END"


def fits(p: str, counts: str) -> dict[str, str]:
    """CTEs p_fit (g, n, distribution, a, b) and p_ks (g, distribution, a, b, ks) from a table g, x, c, bounded."""
    gamma = f"list_reduce(list_transform(range(0, 40), lambda i: i::DOUBLE), lambda k, i: greatest(k / 2, k - (ln(k) - {psi('k')} - gap) / (1 / k - {psi1('k')})), (0.5 / gap)::DOUBLE)"
    s = {e: f"list_sum(list_transform(range(1, len(xs) + 1), lambda j: cs[j] * pow(xs[j] / m, k){e}))" for e in ("", " * ln(xs[j] / m)", " * pow(ln(xs[j] / m), 2)")}
    s0, s1, s2 = s.values()
    weibull = f"list_reduce(list_transform(range(0, 40), lambda i: i::DOUBLE), lambda k, i: greatest(k / 2, k - ({s1} / {s0} - 1 / k - (l - ln(m))) / ({s2} / {s0} - pow({s1} / {s0}, 2) + 1 / (k * k))), (1.2 / sl)::DOUBLE)"
    a, b = "ab[1]", "ab[2]"
    both = f"{psi1(f'({a} + {b})')}"
    g, h = f"({psi(a)} - {psi(f'({a} + {b})')} - l)", f"({psi(b)} - {psi(f'({a} + {b})')} - l1)"
    det = f"({psi1(a)} * {psi1(b)} - {both} * ({psi1(a)} + {psi1(b)}))"
    beta = f"list_reduce(list_transform(range(0, 60), lambda i: [0.0::DOUBLE, 0.0::DOUBLE]), lambda ab, i: [greatest({a} / 2, {a} - ({g} * ({psi1(b)} - {both}) + {both} * {h}) / {det}), greatest({b} / 2, {b} - ({h} * ({psi1(a)} - {both}) + {both} * {g}) / {det})], [greatest(m * (m * (1 - m) / v - 1), 0.01)::DOUBLE, greatest((1 - m) * (m * (1 - m) / v - 1), 0.01)::DOUBLE])"
    near = "(sqrt(b / x) * (x / a - 1))"
    cdf = f"""CASE distribution WHEN 'gamma' THEN {lower_gamma('a', '(x / b)')} WHEN 'lognorm' THEN {phi('(ln(x / b) / a)')} WHEN 'weibull_min' THEN 1 - exp(-pow(x / b, a))
      WHEN 'beta' THEN {lower_beta('a', 'b', 'least(x, 1.0::DOUBLE)')} ELSE {phi(near)} + exp(-pow({near}, 2) / 2) * {scaled_tail('(sqrt(b / x) * (x / a + 1))')} END"""
    return {
        f"{p}_sum": f"SELECT g, bool_or(bounded) AS bounded, sum(c)::DOUBLE AS n, sum(x * c) / sum(c) AS m, sum(ln(x) * c) / sum(c) AS l, sum(c / x) / sum(c) AS inv, sum(ln(1 - x) * c) FILTER (x < 1) / sum(c) FILTER (x < 1) AS l1, list(x ORDER BY x) AS xs, list(c ORDER BY x) AS cs FROM (SELECT g, x::DOUBLE AS x, c::DOUBLE AS c, bounded FROM {counts}) GROUP BY g HAVING sum(c) > 100",
        f"{p}_mom": f"SELECT *, ln(m) - l AS gap, sqrt(list_sum(list_transform(range(1, len(xs) + 1), lambda j: cs[j] * pow(ln(xs[j]) - l, 2))) / n) AS sl, list_sum(list_transform(range(1, len(xs) + 1), lambda j: cs[j] * pow(xs[j] - m, 2))) / n AS v FROM {p}_sum WHERE len(xs) > 1",
        f"{p}_par": f"SELECT *, {gamma} AS gk, {weibull} AS wk, CASE WHEN bounded AND l1 IS NOT NULL AND m < 1 THEN {beta} END AS ab FROM {p}_mom",
        f"{p}_fit": f"SELECT g, n, unnest(['gamma', 'lognorm', 'invgauss', 'weibull_min', 'beta']) AS distribution, unnest([gk, sl, m, wk, ab[1]]) AS a, unnest([m / gk, exp(l), 1 / (inv - 1 / m), m * pow(list_sum(list_transform(range(1, len(xs) + 1), lambda j: cs[j] * pow(xs[j] / m, wk))) / n, 1 / wk), ab[2]]) AS b FROM {p}_par",
        f"{p}_ks": f"SELECT g, distribution, a, b, max(greatest(upto / n - f, f - (upto - c) / n)) AS ks FROM (SELECT g, n, distribution, a, b, upto, c, {cdf} AS f FROM (SELECT g, x::DOUBLE AS x, c::DOUBLE AS c, sum(c) OVER (PARTITION BY g ORDER BY x)::DOUBLE AS upto FROM {counts}) JOIN {p}_fit USING (g) WHERE a IS NOT NULL) GROUP BY ALL",
    }


def path_p(d: str) -> str:
    """Chance that the largest distance of two samples of n_1 and n_2 values is so large: the lattice paths from (0, 0) to
    (n_1, n_2) that stay where |i n_2 - j n_1| is smaller, over all paths; row i of counts comes from row i - 1."""
    inside = f"abs(pi_ * n_2 - (pj_ - 1) * n_1) < round({d} * n_1 * n_2)"
    # where a row is inside is one run of places, so a place gets all of the row before from the run's first place on
    row = f"list_transform(range(1, n_2 + 2), lambda pj_: CASE WHEN {inside} THEN list_sum(list_transform(range(1, pj_ + 1), lambda pk_: CASE WHEN {inside.replace('pj_', 'pk_')} THEN pr_[pk_] ELSE 0 END)) ELSE 0 END)"
    first = f"list_transform(range(1, n_2 + 2), lambda pj_: CASE WHEN (pj_ - 1) * n_1 < round({d} * n_1 * n_2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    # the rows' numbers travel as lists of one, as the row does
    steps = "list_transform(range(1, n_1 + 1), lambda pi_: [pi_::DOUBLE])"
    rows = f"list_reduce({steps}, lambda pr_, ps_: {row.replace('pi_', 'ps_[1]')}, {first})"
    ways = "exp(lgamma(n_1 + n_2 + 1) - lgamma(n_1 + 1) - lgamma(n_2 + 1))"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ({rows})[n_2 + 1] / {ways}))"


def two_sample_p(d: str) -> str:
    """The paths for up to 250,000 pairs of values, one of each sample, as in stats.two_sample_p; the limit's tail beyond."""
    en = "(n_1 * n_2 / (n_1 + n_2)::DOUBLE)"
    x = f"((sqrt({en}) + 0.12 + 0.11 / sqrt({en})) * {d})"
    terms = f"list_transform(range(1, 101), lambda lk_: CASE WHEN lk_ % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * lk_ * lk_ * {x} * {x}))"
    limit = f"CASE WHEN {x} < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum({terms}))) END"
    return f"CASE WHEN n_1 * n_2 <= 250000 THEN {path_p(d)} ELSE {limit} END"


def normal_quantile(p: str) -> str:
    """z with phi(z) = p by halving, for p up to one half and mirrored beyond."""
    low = f"least({p}, 1 - ({p}))"
    half = f"list_reduce(list_transform(range(0, 60), lambda qi: [0.0::DOUBLE, 0.0::DOUBLE]), lambda qz, qi: CASE WHEN {phi('((qz[1] + qz[2]) / 2)')} < {low} THEN [(qz[1] + qz[2]) / 2, qz[2]] ELSE [qz[1], (qz[1] + qz[2]) / 2] END, [-9.0::DOUBLE, 0.0::DOUBLE])"
    return f"CASE WHEN {p} > 0.5 THEN -1 ELSE 1 END * list_sum({half}) / 2"


def diagnosis(draws: str) -> dict[str, str]:
    """CTEs up to dia_out (param, idx, rhat, ess, flagged) from a table param, idx, chain, draw, value."""
    return {
        "dia_n": f"SELECT *, row_number() OVER (PARTITION BY param, idx, chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY param, idx, chain) AS len FROM {draws} WHERE value IS NOT NULL",
        "dia_h": "SELECT *, min(len) OVER (PARTITION BY param, idx) // 2 AS n FROM dia_n",
        "dia_p": "SELECT param, idx, chain * 2 + CASE WHEN i <= n THEN 0 ELSE 1 END AS part, CASE WHEN i <= n THEN i ELSE i - (len - n) END AS i, n, value FROM dia_h WHERE n > 1 AND (i <= n OR i > len - n)",
        "dia_r": "SELECT *, rank() OVER (PARTITION BY param, idx ORDER BY value) + (count(*) OVER (PARTITION BY param, idx, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY param, idx) AS s FROM dia_p",
        "dia_q": f"SELECT r, s, {normal_quantile('((r - 0.375) / (s + 0.25))')} AS z FROM (SELECT DISTINCT r, s FROM dia_r)",
        "dia_z": "SELECT param, idx, part, i, n, s, z FROM dia_r JOIN dia_q USING (r, s)",
        "dia_m": "SELECT param, idx, part, n, s, avg(z) AS m, var_samp(z) AS v FROM dia_z GROUP BY ALL",
        "dia_w": "SELECT param, idx, n, s, count(*) AS parts, avg(v) AS w, (n - 1)::DOUBLE / n * avg(v) + var_samp(m) AS var FROM dia_m GROUP BY param, idx, n, s HAVING avg(v) > 0 OR var_samp(m) > 0",
        "dia_c": "SELECT param, idx, part, i, z - m AS c FROM dia_z JOIN dia_m USING (param, idx, part)",
        "dia_l": "SELECT x.param, x.idx, y.i - x.i AS t, sum(x.c * y.c) AS ac FROM dia_c x JOIN dia_c y ON x.param = y.param AND x.idx = y.idx AND x.part = y.part AND y.i >= x.i GROUP BY ALL",
        "dia_o": "SELECT param, idx, t, n, s, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE 1 - (w - ac / n / parts) / var END AS rho FROM dia_l JOIN dia_w USING (param, idx)",
        "dia_g": "SELECT param, idx, t // 2 AS k, sum(rho) AS pair FROM dia_o WHERE t < n - (n % 2) GROUP BY ALL",
        "dia_k": "SELECT param, idx, min(pair) OVER (PARTITION BY param, idx ORDER BY k) AS least FROM dia_g",
        "dia_e": "SELECT param, idx, coalesce(sum(least) FILTER (least >= 0), 0.0) AS total FROM dia_k GROUP BY ALL",
        "dia_f": "SELECT param, idx, sqrt(var / w) AS rhat, s / greatest(-1 + 2 * total, 1 / log10(s)) AS ess FROM dia_w JOIN dia_e USING (param, idx)",
        "dia_out": "SELECT param, idx, rhat, ess, coalesce(rhat > 1.05 OR ess < 400, false) AS flagged FROM (SELECT DISTINCT param, idx FROM dia_n) LEFT JOIN dia_f USING (param, idx)",
    }
