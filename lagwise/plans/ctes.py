"""SQL for the same things as the adapter and the shared steps, as common table expressions that name what they build on."""

from __future__ import annotations

import re

from lagwise.functions.special import CENTRE, SIDES
from lagwise.plans.adapter import CLASSES, ITERATIONS, LAG_MAX, LAG_MIN, MIN_RUN, MIN_YEARS, OFFSET, SEED, THRESHOLD, WINDOW

_CLASS = "CASE " + " ".join(f"WHEN abs(peak) >= {lo} AND abs(peak) < {'1e300' if hi == float('inf') else hi} THEN '{k}'" for k, (lo, hi) in CLASSES.items()) + " ELSE 'none' END"
_HALF = WINDOW // 2


def fixed(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10**digits} + {OFFSET}) / {float(10**digits)}"


def normal_quantile(p: str) -> str:
    """The standard normal quantile of p, for p from about 1e-11 to 1 less that."""
    def ratio(parts: tuple, x: str) -> str:
        over = []
        for terms in parts:
            out = repr(terms[0])
            for c in terms[1:]:
                out = f"({out} * {x} + {c!r})"
            over.append(out)
        return f"{over[0]} / {over[1]}"

    q = f"(({p})::DOUBLE - 0.5::DOUBLE)"
    tail = f"(sqrt(-ln(least(({p})::DOUBLE, 1 - ({p})::DOUBLE))) - 1.6::DOUBLE)"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(CENTRE, f'(0.180625::DOUBLE - {q} * {q})')} ELSE sign({q}) * {ratio(SIDES, tail)} END"


def filled(keys: str, source: str) -> str:
    """Rows of source for every key and month, missing ones with null."""
    return f"""SELECT k.*, c.t, c.t // 12 AS year, c.t % 12 + 1 AS month, s.value FROM (SELECT DISTINCT {keys} FROM {source}) k CROSS JOIN cal c
        LEFT JOIN {source} s ON c.t = s.t AND {' AND '.join(f'k.{x} = s.{x}' for x in keys.split(', '))}"""


def standardised(source: str, keys: str) -> str:
    """Anomalies against the moving climatology, standardised."""
    return f"""SELECT {keys}, t, year, month, CASE WHEN n >= {MIN_YEARS} AND sd > 1e-6 * whole THEN (value - m) / sd END AS value FROM (
        SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, stddev_pop(value) OVER (PARTITION BY {keys}) AS whole
        FROM {source} WINDOW w AS (PARTITION BY {keys}, month ORDER BY year RANGE BETWEEN {_HALF} PRECEDING AND {WINDOW - _HALF - 1} FOLLOWING))"""


def hinge(source: str, keys: str, knot: float, iterations: int, seed: int, evaluate_at: float) -> str:
    """The hinge fit over (keys, item, x, y) without nulls, and its bootstrap, by normal equations."""
    terms = ("1.0::DOUBLE", "x", f"greatest(x - {knot}, 0)", f"least(x + {knot}, 0)")
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = lambda weight: ", ".join(f"sum({weight} * {terms[i]} * {terms[j]}) AS a{i}{j}" for i, j in pairs)
    right = lambda weight: ", ".join(f"sum({weight} * {terms[i]} * y) AS b{i}" for i in range(4))

    def solved(rows: str, carried: str) -> str:
        """Elimination of one term after another from the sums a and b, and substitution back; null where a pivot vanishes."""
        rows = f"SELECT *, {', '.join(f'a{i}{i} AS d{i}' for i in range(4))} FROM ({rows})"
        for k in range(4):
            f = {i: f"a{k}{i} / CASE WHEN a{k}{k} > 1e-10 * d{k} THEN a{k}{k} END" for i in range(k + 1, 4)}
            out = [f"a{i}{j} - {f[i]} * a{k}{j} AS a{i}{j}" if i > k else f"a{i}{j}" for i, j in pairs] + [f"b{i} - {f[i]} * b{k} AS b{i}" if i > k else f"b{i}" for i in range(4)]
            rows = f"SELECT {carried}, d0, d1, d2, d3, {', '.join(out)} FROM ({rows})"
        pivot = lambda k: f"CASE WHEN a{k}{k} > 1e-10 * d{k} THEN a{k}{k} END"
        back = [f"(b{k}{''.join(f' - a{k}{j} * h{j}' for j in range(k + 1, 4))}) / {pivot(k)} AS h{k}" for k in (3, 2, 1, 0)]
        return f"SELECT {carried}, {', '.join(back)} FROM ({rows})"

    cover = f"SELECT item, any_value(x) AS x, count(*) AS c FROM {source} GROUP BY item"
    chosen = f"SELECT item, x, row_number() OVER (ORDER BY item) - 1 AS k, count(*) OVER () AS m FROM ({cover}) WHERE c >= 0.5 * (SELECT max(c) FROM ({cover}))"
    rows = f"SELECT {keys}, s.item, c.x, s.y, c.m, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} s JOIN ({chosen}) c ON c.item = s.item"
    fits = solved(f"SELECT {keys}, any_value(n) AS n, any_value(m) AS m, {sums('1')}, {right('1')} FROM ({rows}) WHERE n = m OR n >= 24 GROUP BY {keys}", f"{keys}, n, m")
    picks = f"SELECT i, c.item, c.x, count(*) AS w FROM range({iterations}) r(i) CROSS JOIN ({chosen}) s JOIN ({chosen}) c ON c.k = ('0x' || substr(md5('{seed}:' || i || ':' || s.k), 1, 8))::BIGINT % s.m GROUP BY ALL"
    usable = f"SELECT i FROM ({picks}) GROUP BY i HAVING sum(CASE WHEN x > {knot} THEN w ELSE 0 END) >= 3 AND sum(CASE WHEN x < -{knot} THEN w ELSE 0 END) >= 3"
    left = f"SELECT i, {sums('w')} FROM ({picks}) WHERE i IN ({usable}) GROUP BY i"
    drawn = f"SELECT {keys}, i, {right('w')} FROM (SELECT r.*, p.i, p.w FROM ({rows}) r JOIN ({picks}) p ON p.item = r.item WHERE r.n = r.m) GROUP BY {keys}, i"
    draws = solved(f"SELECT * FROM ({drawn}) JOIN ({left}) USING (i)", f"{keys}, i")
    same = f"SELECT {keys}, count(*) FILTER (sign(d.h2) = sign(f.h2)) AS same FROM ({draws}) d JOIN ({fits}) f USING ({keys}) GROUP BY {keys}"
    e = max(evaluate_at - knot, 0)
    return f"""SELECT {keys}, coalesce(f.n, a.n) AS n, h0 AS b0, h1 AS slope, h2 AS warm, h3 AS cold, CASE WHEN abs(h1) > 1e-6 THEN h2 / h1 END AS ratio, h2 * {e} AS excess,
        CASE WHEN abs(h1 * {evaluate_at}) > 1e-6 THEN h2 * {e} / (h1 * {evaluate_at}) END AS excess_frac, (SELECT count(*) FROM ({usable})) AS n_draws, sign(h1) = sign(h2) AS steepening,
        CASE WHEN h2 IS NOT NULL THEN greatest(least(2 * (1 - coalesce(same, 0) / greatest((SELECT count(*) FROM ({usable})), 1)), 1), 0) END AS p_value
        FROM (SELECT {keys}, count(*) FILTER (item IN (SELECT item FROM ({chosen}))) AS n FROM {source} GROUP BY {keys}) a LEFT JOIN ({fits}) f USING ({keys}) LEFT JOIN ({same}) USING ({keys})"""


CTES: dict[str, str] = {
    "o": "SELECT c_nationkey AS cell_id, o_orderpriority AS model, o_orderstatus AS scenario, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS t, round(o_totalprice * 100)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey",
    "cal": "SELECT unnest(range((SELECT min(t) FROM o), (SELECT max(t) + 1 FROM o)))::INT AS t",
    "f": "SELECT cell_id, t, sum(cents) / count(*) / 100 AS value FROM o GROUP BY ALL",
    "fm": "SELECT cell_id, model, t, sum(cents) / count(*) / 100 AS value FROM o GROUP BY ALL",
    "fs": "SELECT cell_id, scenario, t, sum(cents) / count(*) / 100 AS value FROM o GROUP BY ALL",
    "field": filled("cell_id", "f"),
    "mfield": filled("cell_id, model", "fm"),
    "sfield": filled("cell_id, scenario", "fs"),
    "v2": "SELECT cell_id, 'price' AS variable, t, sum(cents) / count(*) / 100 AS value FROM o GROUP BY ALL UNION ALL SELECT cell_id, 'total', t, sum(cents) / 100 FROM o GROUP BY ALL",
    "vfield": filled("cell_id, variable", "v2"),
    "vanom": standardised("vfield", "cell_id, variable"),
    "anom": standardised("field", "cell_id"),
    "manom": standardised("mfield", "cell_id, model"),
    "sanom": standardised("sfield", "cell_id, scenario"),
    "idx": "SELECT t, t // 12 AS year, t % 12 + 1 AS month, sum(cents) / count(*) / 100 AS value FROM o GROUP BY t",
    "z": "SELECT t, (value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0) AS value FROM idx",
    "oni": "SELECT t, value FROM (SELECT t, avg(value) OVER w AS value, count(value) OVER w AS n FROM z WHERE value IS NOT NULL WINDOW w AS (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE n = 3",
    "flags": f"SELECT 'warm' AS phase, t, value, value >= {THRESHOLD} AS f, 1 AS s FROM oni UNION ALL SELECT 'cold', t, value, value <= -{THRESHOLD}, -1 FROM oni",
    "islands": "SELECT *, row_number() OVER (PARTITION BY phase ORDER BY t) - row_number() OVER (PARTITION BY phase, f ORDER BY t) AS run FROM flags",
    "peaks": "SELECT phase, run, t, value, row_number() OVER (PARTITION BY phase, run ORDER BY s * value DESC, t) AS k, count(*) OVER r AS length, min(t) OVER r AS onset_t, max(t) OVER r AS end_t FROM islands WHERE f WINDOW r AS (PARTITION BY phase, run)",
    "found": f"SELECT phase, onset_t, end_t, length, t AS peak_t, value AS peak, CASE WHEN t % 12 + 1 >= 8 THEN t // 12 ELSE t // 12 - 1 END AS event_year FROM peaks WHERE k = 1 AND length >= {MIN_RUN}",
    "catalogue": f"SELECT * EXCLUDE (b), {_CLASS} AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY phase, event_year ORDER BY abs(peak) DESC, onset_t) AS b FROM found) WHERE b = 1",
    "lags": f"SELECT unnest(range({LAG_MIN}, {LAG_MAX + 1}))::INT AS lag",
    # Epochs around the peaks of warm events, by cell; by cell and member; by scenario.
    "epoch": "SELECT a.cell_id, e.event_year, l.lag, a.value FROM catalogue e CROSS JOIN lags l JOIN anom a ON a.t = e.peak_t + l.lag WHERE e.phase = 'warm'",
    "cepoch": "SELECT a.cell_id, e.event_year, l.lag, a.value FROM catalogue e CROSS JOIN lags l JOIN anom a ON a.t = e.peak_t + l.lag WHERE e.phase = 'cold'",
    "mepoch": "SELECT a.cell_id, a.model, e.event_year, l.lag, a.value FROM catalogue e CROSS JOIN lags l JOIN manom a ON a.t = e.peak_t + l.lag WHERE e.phase = 'warm'",
    "sepoch": "SELECT a.cell_id, a.scenario, e.event_year, l.lag, a.value FROM catalogue e CROSS JOIN lags l JOIN sanom a ON a.t = e.peak_t + l.lag WHERE e.phase = 'warm'",
    "comp": "SELECT cell_id, lag, avg(value) AS value, count(value) AS n_events FROM epoch GROUP BY ALL",
    # The response of an event: the mean over lags 0 to 2.
    "resp": "SELECT cell_id, event_year, avg(value) AS value FROM epoch WHERE lag BETWEEN 0 AND 2 GROUP BY ALL",
    "cresp": "SELECT cell_id, event_year, avg(value) AS value FROM cepoch WHERE lag BETWEEN 0 AND 2 GROUP BY ALL",
    "mresp": "SELECT cell_id, model, event_year, avg(value) AS value FROM mepoch WHERE lag BETWEEN 0 AND 2 GROUP BY ALL",
    "sresp": "SELECT cell_id, scenario, event_year, avg(value) AS value FROM sepoch WHERE lag BETWEEN 0 AND 2 GROUP BY ALL",
    "seasons": "SELECT * FROM (VALUES ('SON0', -3), ('SON0', -2), ('SON0', -1), ('DJF01', 0), ('DJF01', 1), ('DJF01', 2), ('MAM1', 3), ('MAM1', 4), ('MAM1', 5)) v(season, lag)",
    "sched": "SELECT a.cell_id, e.event_year, s.season, avg(a.value) AS value FROM catalogue e CROSS JOIN seasons s JOIN anom a ON a.t = e.event_year * 12 + 11 + s.lag WHERE e.phase = 'warm' GROUP BY ALL",
    # Resampling: anchors are months; neutral ones lie further than a month from every peak.
    "warm_t": "SELECT DISTINCT peak_t AS anchor_t FROM catalogue WHERE phase = 'warm'",
    "neutral": "SELECT t AS anchor_t FROM oni WHERE NOT EXISTS (SELECT 1 FROM catalogue e WHERE abs(e.peak_t - oni.t) <= 1)",
    "pool": "SELECT n.t AS anchor_t, a.cell_id, avg(a.value) AS value FROM cal n JOIN anom a ON a.t BETWEEN n.t AND n.t + 2 GROUP BY ALL",
    "n_events": "SELECT count(*) AS n FROM warm_t",
    "draws": f"SELECT i AS iteration, anchor_t FROM (SELECT i, anchor_t, row_number() OVER (PARTITION BY i ORDER BY md5('{SEED}:' || i || ':' || anchor_t)) AS k FROM neutral CROSS JOIN range({ITERATIONS}) r(i)) WHERE k <= (SELECT n FROM n_events)",
    "observed": "SELECT cell_id, avg(value) AS composite FROM pool WHERE anchor_t IN (SELECT anchor_t FROM warm_t) GROUP BY ALL",
    "nulls": "SELECT cell_id, iteration, avg(value) AS null_value FROM pool JOIN draws USING (anchor_t) GROUP BY ALL",
    "mc": "SELECT c.cell_id, any_value(composite) AS composite, (count(*) FILTER (abs(null_value) >= abs(composite) - 1e-12 * top) + 1) / (count(null_value) + 1) AS p_value, avg(null_value) AS null_mean, stddev_pop(null_value) AS null_std FROM (SELECT cell_id, max(abs(value)) AS top FROM pool GROUP BY cell_id) c LEFT JOIN observed o USING (cell_id) LEFT JOIN nulls n USING (cell_id) GROUP BY c.cell_id",
    "bh": "SELECT coalesce(max(CASE WHEN p <= 0.1 * i / n THEN p END), 0) AS threshold FROM (SELECT p_value AS p, count(*) OVER (ORDER BY p_value) AS i, count(*) OVER () AS n FROM mc WHERE p_value IS NOT NULL)",
    "masked": "SELECT mc.*, threshold, p_value <= threshold AND threshold > 0 AS significant FROM mc CROSS JOIN bh",
    "ens": "SELECT cell_id, model, avg(value) AS value FROM mresp GROUP BY ALL",
    "agree": "SELECT cell_id, avg(CASE WHEN value IS NOT NULL THEN (sign(value) = sign(m))::INT END) AS agreement, count(value) AS n_models, any_value(m) AS ensemble_mean FROM (SELECT *, avg(value) OVER (PARTITION BY cell_id) AS m FROM ens) GROUP BY ALL",
    "robust": "SELECT m.*, a.agreement, a.n_models, coalesce(a.n_models >= 3 AND a.agreement >= 0.66 AND m.significant, false) AS robust FROM masked m JOIN agree a USING (cell_id)",
    "cells": "SELECT n_nationkey AS cell_id, -60.0::DOUBLE + 5 * n_nationkey AS lat, -175.0::DOUBLE + 14 * n_nationkey AS lon, n_regionkey AS region, greatest(coalesce(balance, 0), 0) AS population FROM nation LEFT JOIN (SELECT c_nationkey, sum(round(c_acctbal * 100)::BIGINT) / 100 AS balance FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey",
    "geo": "SELECT *, 6371000.0::DOUBLE * 6371000.0 * radians(14) * (sin(radians(lat + 2.5)) - sin(radians(lat - 2.5))) AS area FROM cells",
}


def sql(body: str) -> str:
    """body with all the expressions that it builds on, in their order here."""
    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in re.findall(r"\b(?:FROM|JOIN|IN \(SELECT anchor_t FROM)\s+(\w+)", text):
            if name in CTES and name not in names:
                names.add(name)
                todo.append(CTES[name])
    clauses = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in names)
    return f"WITH {clauses} {body}" if names and not body.lstrip().startswith("WITH") else f"WITH {clauses}, {body.lstrip()[5:]}" if names else body
