"""Plain SQL counterparts of the named queries, for an independent engine over the same tables.

Statistics are computed here straight from sorted rows and from cell values; nothing passes through the
coefficient coding, the histogram or the rank passes that the Spark side uses.
"""

from __future__ import annotations

from latencylab.functions import scalars as S
from latencylab.operators import bootstrap as BS, contrasts as C, distributions as D, effects as E, lognormal as L, models as M, predictive as PR
from latencylab.plans import queries as QU, reports as P
from latencylab.sources import warehouse as WH

DEPS = C.DEPENDENCIES
COHORTS = C.COHORTS

TRIALS = """trials AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'adults' ELSE 'children' END AS "group",
    l_suppkey AS subj, l_partkey % 40 AS stim,
    CASE WHEN l_tax = 0.08 THEN 'both' WHEN l_returnflag = 'A' THEN 'adjacent'
      WHEN l_returnflag = 'R' THEN 'nonadjacent' ELSE 'none' END AS dependency,
    CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0.08 THEN 'both' WHEN l_returnflag = 'A' THEN 'adjacent'
      WHEN l_returnflag = 'R' THEN 'nonadjacent' ELSE 'none' END AS dependency2,
    l_linenumber AS block, CAST(l_orderkey % 60 + 1 AS INTEGER) AS trial_in_block,
    CAST(l_quantity > 2 AS INTEGER) AS acc, l_extendedprice / 10 AS rt
  FROM lineitem)"""
CLEAN = TRIALS + """, clean AS (
  SELECT * FROM trials WHERE acc = 1 AND rt > 100 AND rt < 10000 AND dependency2 IS NOT NULL
    AND dependency <> 'both')"""
JUDGE = f"""judge AS (
  SELECT source AS subj, doc_id AS item, lang AS dependency, quality = 1 AS "isDep",
    n_chars >= {WH.LONG_TEXT} AS "sayDep", CAST((quality = 1) = (n_chars >= {WH.LONG_TEXT}) AS INTEGER) AS acc
  FROM labels JOIN documents USING (doc_id))"""
ALL_CELLS = [(g, d, b) for g in COHORTS for d in DEPS for b in range(1, 8)]


def _bootstrap() -> str:
    """CTEs of the bootstrap draws: ``cell`` (long), ``wide`` (a column for each condition) and ``scale``."""
    sums = []
    for i, (g, d, b) in enumerate(ALL_CELLS):
        mine = f"FILTER (\"group\" = '{g}' AND dependency = '{d}' AND block = {b})"
        sums += [f"CAST(count(*) {mine} AS DOUBLE) AS n{i}", f"coalesce(sum(value) {mine}, 0) AS s{i}"]
    sums += [f"coalesce(sum(value * value) FILTER (\"group\" = '{g}'), 0) AS q{g}" for g in COHORTS]
    names = [f"{x}{i}" for i in range(len(ALL_CELLS)) for x in "ns"] + [f"q{g}" for g in COHORTS]
    weights = ", ".join(
        "CAST(" + " + ".join(f"CAST(substr(h, {4 * k + 1}, 4) >= '{c:04x}' AS INTEGER)" for c in BS.poisson_cuts()) + f" AS DOUBLE) AS w{k}"
        for k in range(BS.PER_DIGEST)
    )
    folded = ", ".join(f"sum(w{k} * {n}) AS {n}_{k}" for k in range(BS.PER_DIGEST) for n in names)
    each = ", ".join(
        "{'k': %d, %s}" % (k, ", ".join(f"'{n}': {n}_{k}" for n in names)) for k in range(BS.PER_DIGEST)
    )
    values = ", ".join(f"{{'group': '{g}', 'dependency': '{d}', 'block': {b}, 'value': t.s{i} / t.n{i}}}" for i, (g, d, b) in enumerate(ALL_CELLS))
    scales = []
    for g in COHORTS:
        mine = [i for i, c in enumerate(ALL_CELLS) if c[0] == g]
        within = " + ".join(f"t.s{i} * t.s{i} / t.n{i}" for i in mine)
        n = " + ".join(f"t.n{i}" for i in mine)
        scales.append(f"SELECT draw, '{g}' AS \"group\", sqrt((t.q{g} - ({within})) / ({n} - {len(mine)})) AS s FROM replicate")
    return f"""
line AS (
  SELECT substr(md5(concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, {BS.SLOT_DIGITS}) AS slot,
    CASE WHEN l_linestatus = 'F' THEN 'adults' ELSE 'children' END AS "group",
    CASE WHEN l_returnflag = 'A' THEN 'adjacent' WHEN l_returnflag = 'R' THEN 'nonadjacent' ELSE 'none' END AS dependency,
    l_linenumber AS block, ln(l_extendedprice / 10) AS value
  FROM lineitem
  WHERE l_quantity > 2 AND l_extendedprice > 1000 AND l_extendedprice < 100000 AND l_discount <> 0 AND l_tax <> 0.08),
slots AS MATERIALIZED (SELECT slot, {", ".join(sums)} FROM line GROUP BY slot),
digest AS (SELECT slots.*, j, md5(slot || '_' || j) AS h FROM slots, range({BS.REPLICATES // BS.PER_DIGEST}) r(j)),
weighted AS (SELECT * EXCLUDE (h), {weights} FROM digest),
folded AS MATERIALIZED (SELECT j, {folded} FROM weighted GROUP BY j),
replicate AS MATERIALIZED (SELECT j * {BS.PER_DIGEST} + t.k AS draw, t FROM (SELECT j, unnest([{each}]) AS t FROM folded)),
cell AS MATERIALIZED (
  SELECT draw, c."group" AS "group", c.dependency AS dependency, c.block AS block, c.value AS value
  FROM (SELECT draw, unnest([{values}]) AS c FROM replicate)),
scale AS ({" UNION ALL ".join(scales)}),
wide AS MATERIALIZED (
  SELECT draw, "group", {", ".join(f"max(value) FILTER (dependency = '{d}' AND block = {b}) AS {d}_{b}" for d in DEPS for b in range(1, 8))}
  FROM cell GROUP BY draw, "group")"""


CELLS = _bootstrap()


def q(key: str) -> str:
    return '"group"' if key == "group" else key


def cols(keys) -> str:
    return ", ".join(q(k) for k in keys)


def on(keys, a="a", b="b") -> str:
    return " AND ".join(f"{a}.{q(k)} = {b}.{q(k)}" for k in keys)


def r(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 4) AS {alias or expr}"


def gap(prob: float, rule: str) -> str:
    if rule == "hdi":
        return f"CAST(ceil(a.n * {prob}::DOUBLE) AS BIGINT)"
    return f"greatest(1, least(a.n - 1, CAST(round_even(a.n * {prob}::DOUBLE, 0) AS BIGINT)))"


def shortest(name: str, src: str, keys, value="value", prob=0.95, rule="hpdi") -> str:
    """CTEs ending in ``name``: the shortest interval ``lo, hi`` per group."""
    k = cols(keys)
    ak = ", ".join(f"a.{q(x)}" for x in keys)
    return f"""{name}_r AS (
  SELECT {k}, {value} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {value}) AS rn,
    count(*) OVER (PARTITION BY {k}) AS n FROM {src}),
{name}_w AS (
  SELECT {ak}, a.v AS lo, b.v AS hi,
    row_number() OVER (PARTITION BY {ak} ORDER BY round(b.v - a.v, {D.WIDTH_DIGITS}), a.rn) AS best
  FROM {name}_r a JOIN {name}_r b ON {on(keys)} AND b.rn = a.rn + {gap(prob, rule)}),
{name} AS (SELECT {k}, lo, hi FROM {name}_w WHERE best = 1)"""


def density(name: str, src: str, keys, value="value") -> str:
    """CTEs with per-group bandwidth (``name_h``) and linear-binned node weights (``name_n``)."""
    k = cols(keys)
    ak = ", ".join(f"a.{q(x)}" for x in keys)
    step = f"((b.mx - b.mn) / {D.BINS - 1})"
    return f"""{name}_s AS (
  SELECT {k}, count(*) AS n, min({value}) AS mn, max({value}) AS mx, stddev_samp({value}) AS sd,
    quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr FROM {src} GROUP BY {k}),
{name}_h AS (
  SELECT *, 0.9 * (CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
    WHEN abs(mn) > 0 THEN abs(mn) ELSE 1 END) * pow(n, -0.2::DOUBLE) AS h FROM {name}_s),
{name}_p AS (
  SELECT {ak}, CASE WHEN {step} > 0 THEN (a.{value} - b.mn) / {step} ELSE 0 END AS p
  FROM {src} a JOIN {name}_h b ON {on(keys)}),
{name}_n AS (
  SELECT {k}, node, sum(w) AS w FROM (
    SELECT {k}, least(floor(p), {D.BINS - 1}) AS node, 1 - (p - least(floor(p), {D.BINS - 1})) AS w FROM {name}_p
    UNION ALL
    SELECT {k}, least(floor(p), {D.BINS - 1}) + 1 AS node, p - least(floor(p), {D.BINS - 1}) AS w FROM {name}_p)
  GROUP BY {k}, node)"""


def mode(name: str, src: str, keys, value="value") -> str:
    """CTEs ending in ``name``: the grid point of the highest kernel density per group."""
    k = cols(keys)
    ak = ", ".join(f"a.{q(x)}" for x in keys)
    x = f"(b.mn - {D.GRID_MARGIN} * b.h + g * ((b.mx - b.mn + {2 * D.GRID_MARGIN} * b.h) / {D.GRID - 1}))"
    node = f"(b.mn + a.node * ((b.mx - b.mn) / {D.BINS - 1}))"
    return density(name, src, keys, value) + f""",
{name}_d AS (
  SELECT {ak}, g, any_value({x}) AS x,
    sum(a.w * exp(-0.5 * pow(({x} - {node}) / b.h, 2))) / any_value(b.n * b.h * sqrt(2 * pi())) AS height
  FROM {name}_n a JOIN {name}_h b ON {on(keys)}, range({D.GRID}) t(g) GROUP BY {ak}, g),
{name} AS (
  SELECT {k}, x AS mode FROM (
    SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY round(height, 12) DESC, g) AS best FROM {name}_d)
  WHERE best = 1)"""


def height(name: str, src: str, keys, at: float, value="value") -> str:
    ak = ", ".join(f"a.{q(x)}" for x in keys)
    node = f"(b.mn + a.node * ((b.mx - b.mn) / {D.BINS - 1}))"
    return density(name, src, keys, value) + f""",
{name} AS (
  SELECT {ak}, sum(a.w * exp(-0.5 * pow(({at} - {node}) / b.h, 2))) / any_value(b.n * b.h * sqrt(2 * pi())) AS height
  FROM {name}_n a JOIN {name}_h b ON {on(keys)} GROUP BY {ak})"""


def number_text(x: str, digits: int = 0) -> str:
    if digits <= 0:
        return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
    return f"regexp_replace(CAST(CAST(round_even({x}, {digits}) AS DECIMAL(30,{digits})) AS VARCHAR), '\\.?0+$', '')"


def probability_text(p: str) -> str:
    rounded = f"round_even({p}, 3)"
    text = f"regexp_replace({number_text(rounded, 3)}, '^0\\.', '.')"
    return f"CASE WHEN {rounded} <= 0.001 THEN '<.001' WHEN {rounded} >= 0.999 THEN '>.999' ELSE {text} END"


def interval_text(lo: str, hi: str, digits: int = 0) -> str:
    return f"'[' || {number_text(lo, digits)} || ', ' || {number_text(hi, digits)} || ']'"


def horner(coefs, x: str) -> str:
    out = f"({coefs[0]!r}::DOUBLE)"
    for c in coefs[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def probit(p: str) -> str:
    t = f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))"
    rr = f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"({horner(S.PROBIT_C, t)} / ({horner(S.PROBIT_D, t)} * {t} + 1.0))"
    centre = f"({horner(S.PROBIT_A, rr)} * ({p} - 0.5) / ({horner(S.PROBIT_B, rr)} * {rr} + 1.0))"
    return (
        f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {S.PROBIT_LOW} THEN {tail} "
        f"WHEN {p} > 1.0 - {S.PROBIT_LOW} THEN -{tail} ELSE {centre} END"
    )


def normal_cdf(x: str) -> str:
    t = f"(1.0 / (1.0 + {S.CDF_P} * abs({x})))"
    upper = f"(exp(-{x} * {x} / 2.0) * {S.NORMAL_HEIGHT_AT_ZERO!r}::DOUBLE * {t} * {horner(tuple(reversed(S.CDF_B)), t)})"
    return f"CASE WHEN {x} >= 0 THEN 1.0 - {upper} ELSE {upper} END"


def weights(d: C.Design) -> str:
    """Hypothesis weights as literal rows; ``"group"`` is empty for ungrouped designs."""
    w = d.weights()
    rows = []
    for i, cell in enumerate(d.cells):
        g = cell[0] if d.grouped else ""
        for j, p in enumerate(d.parameters):
            if w[i, j]:
                rows.append(f"('{g}', '{cell[-2]}', {cell[-1]}, '{p}', {float(w[i, j])!r}::DOUBLE)")
    return f'weights AS (SELECT * FROM (VALUES {", ".join(rows)}) t("group", dependency, block, parameter, w))'


SIGMA = 'sig AS (SELECT draw, "group", s FROM scale)'


def trend(blocks, prefix: str = "") -> str:
    names = [(d, b) for d in DEPS for b in blocks]
    mean = sum(b for _, b in names) / len(names)
    norm = sum((b - mean) ** 2 for _, b in names)
    return f"sum(value * (block - {mean!r}::DOUBLE)) / {norm!r}::DOUBLE"


def params7() -> str:
    """Long coefficient draws of the 7-block model: draw, group, parameter, value."""
    d = C.design("seven_block")
    return CELLS + ", " + weights(d) + f""",
params AS MATERIALIZED (
  SELECT c.draw, c."group", w.parameter, sum(c.value * w.w) AS value
  FROM cell c JOIN weights w ON c.dependency = w.dependency AND c.block = w.block GROUP BY ALL
  UNION ALL SELECT draw, "group", 'b_Intercept', avg(value) FROM cell GROUP BY ALL
  UNION ALL SELECT draw, "group", 'b_ndt_Intercept', min(value) - 1 FROM cell GROUP BY ALL
  UNION ALL SELECT draw, "group", 'b_scaletrial_in_block', {trend(range(1, 8))} FROM cell GROUP BY ALL)"""


def params_group(d: C.Design) -> str:
    """Long coefficient draws of a group model: draw, parameter, value."""
    blocks = ", ".join(map(str, d.blocks))
    return CELLS + ", " + weights(d) + ", " + SIGMA + f""",
params AS MATERIALIZED (
  SELECT c.draw, w.parameter, sum(c.value * w.w) AS value
  FROM cell c JOIN weights w ON c."group" = w."group" AND c.dependency = w.dependency AND c.block = w.block GROUP BY ALL
  UNION ALL SELECT draw, 'b_Intercept', avg(value) FROM cell WHERE block IN ({blocks}) GROUP BY ALL
  UNION ALL SELECT draw, 'b_sigma_group' || "group", ln(s) FROM sig)"""


def log_differences(d: C.Design, scale: str = "x.s") -> str:
    """``diffs``: standardised block differences per draw, group, dependency and effect."""
    parts = [
        f"SELECT w.draw, w.\"group\", '{dep}' AS dependency, '{e}' AS effect, "
        f"w.{dep}_{hi} AS hi, w.{dep}_{lo} AS lo FROM wide w"
        for dep in DEPS
        for e, (hi, lo) in E.BLOCK_EFFECTS[d.name].items()
    ]
    scale_cte = 'SELECT draw, "group", s FROM sig' if scale == "draw" else (
        'SELECT draw, "group", avg(s) OVER (PARTITION BY "group") AS s FROM sig'
    )
    return CELLS + ", " + SIGMA + f""",
scaled AS ({scale_cte}),
pairs AS ({" UNION ALL ".join(parts)}),
diffs AS MATERIALIZED (SELECT p.draw, p."group", dependency, effect, (hi - lo) / s AS value, exp(hi) - exp(lo) AS ms
  FROM pairs p JOIN scaled x ON p.draw = x.draw AND p."group" = x."group")"""


V3D = C.design("group_v3")


def effect_table(d: C.Design, rows: list[tuple[dict, str, str]], scale: str, over_sigma: bool = False) -> str:
    """Rows give the keys and SQL of the two log-scale averages over ``wide`` columns."""
    keys = ["group", *rows[0][0]]
    parts = []
    for extra, plus, minus in rows:
        ks = "".join(f", '{v}' AS {k}" for k, v in extra.items())
        parts.append(f'SELECT draw, "group"{ks}, {plus} AS hi, {minus} AS lo FROM wide')
    scale_cte = 'SELECT draw, "group", s FROM sig' if scale == "draw" else (
        'SELECT draw, "group", avg(s) OVER (PARTITION BY "group") AS s FROM sig'
    )
    ms = "(exp(hi) - exp(lo)) / s" if over_sigma else "exp(hi) - exp(lo)"
    k = cols(keys)
    other = [q(x) for x in keys if x != "group"]
    sel = ", ".join(['p."group"', *other])
    joins = "".join(f"\n  JOIN {t} USING ({k})" for t in ("rt_m", "rt_i", "d_m", "d_i", "rope"))
    body = CELLS + ", " + SIGMA + f""",
scaled AS ({scale_cte}),
pairs AS ({" UNION ALL ".join(parts)}),
diffs AS MATERIALIZED (SELECT p.draw, {sel}, (hi - lo) / s AS d, {ms} AS rt
  FROM pairs p JOIN scaled x ON p.draw = x.draw AND p."group" = x."group"),
{mode("rt_m", "diffs", keys, "rt")}, {shortest("rt_i", "diffs", keys, "rt")},
{mode("d_m", "diffs", keys, "d")}, {shortest("d_i", "diffs", keys, "d")},
{shortest("hdi", "diffs", keys, "d", 0.89, "hdi")},
rope AS (SELECT {", ".join(f"a.{q(x)}" for x in keys)},
    100 * avg(CAST(a.d BETWEEN {E.ROPE_LOW} AND {E.ROPE_HIGH} AS DOUBLE)) AS rope
  FROM diffs a JOIN hdi b ON {on(keys)} AND a.d BETWEEN b.lo AND b.hi GROUP BY ALL),
tail AS (SELECT {k}, avg(CAST(rt < 0 AS DOUBLE)) AS p FROM diffs GROUP BY ALL),
effects AS (SELECT {k}, rt_m.mode AS rt_med, rt_i.lo AS rt_lo, rt_i.hi AS rt_up, p,
    d_m.mode AS d_med, d_i.lo AS d_lo, d_i.hi AS d_up, rope FROM tail{joins})"""
    return body


EFFECT_COLS = ("rt_med", "rt_lo", "rt_up", "p", "d_med", "d_lo", "d_up", "rope")


def effect_select(keys) -> str:
    return f" SELECT {cols(keys)}, {', '.join(r(c) for c in EFFECT_COLS)} FROM effects"


def block_rows(d):
    return [
        ({"dependency": dep, "effect": e}, f"{dep}_{hi}", f"{dep}_{lo}")
        for dep in DEPS for e, (hi, lo) in E.BLOCK_EFFECTS[d.name].items()
    ]


def dependency_rows(d):
    out = []
    for e, (hi, lo) in E.BLOCK_EFFECTS[d.name].items():
        pair = [f"(adjacent_{b} + nonadjacent_{b}) / 2" for b in (hi, lo)]
        out.append(({"dependency": "dependency", "effect": e}, *pair))
        out.append(({"dependency": "none", "effect": e}, f"none_{hi}", f"none_{lo}"))
    return out


def age_dependency_rows(d, compat):
    plus = " + ".join(f"adjacent_{b} + nonadjacent_{b}" for b in d.blocks)
    last = "adjacent_7" if compat else "none_7"
    minus = " + ".join([*(f"none_{b}" for b in d.blocks[:-1]), last])
    return [({}, f"({plus}) / {2 * len(d.blocks)}", f"({minus}) / {len(d.blocks)}")]


def age_block_rows(d):
    def avg(b):
        return f"(adjacent_{b} + nonadjacent_{b} + none_{b}) / 3"

    return [({"effect": e}, avg(hi), avg(lo)) for e, (hi, lo) in E.BLOCK_EFFECTS[d.name].items()]


def rounded(src: str, keys, tail: str = "") -> str:
    """Mode and interval rounded to whole numbers, from CTEs m and i."""
    p = f", round(round_even(p, 3), 4) AS p" if tail else ""
    join = f" JOIN {tail} USING ({cols(keys)})" if tail else ""
    return (
        f" SELECT {cols(keys)}, round_even(m.mode, 0) AS m, round_even(i.lo, 0) AS lo, round_even(i.hi, 0) AS hi{p}"
        f" FROM m JOIN i USING ({cols(keys)}){join}"
    )


def baseline(col="dependency") -> str:
    return f"CASE WHEN {col} = 'none' THEN 'baseline' ELSE {col} END"


def union_of_columns(prefix_to_label: dict[str, str], src: str, keep: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{lab}' AS {key}, {col} AS value FROM {src}" for col, lab in prefix_to_label.items())


def labelled7() -> str:
    """``eff``: labelled 7-block coefficients in ms."""
    d = C.design("seven_block")
    cases = " ".join(f"WHEN '{p}' THEN '{h.report_label}'" for p, h in zip(d.parameters, d.hypotheses))
    cases += f" WHEN 'b_Intercept' THEN '{P.INTERCEPT_LABEL}' WHEN 'b_scaletrial_in_block' THEN '{P.REPETITION_LABEL}'"
    return params7() + f""",
eff AS MATERIALIZED (
  SELECT p.draw, p."group", CASE p.parameter {cases} END AS param,
    CASE WHEN p.parameter = 'b_Intercept' THEN exp(p.value) ELSE exp(i.value + p.value / 4) - exp(i.value) END AS value
  FROM params p JOIN params i ON p.draw = i.draw AND p."group" = i."group" AND i.parameter = 'b_Intercept'
  WHERE p.parameter <> 'b_ndt_Intercept'),
{mode("m", "eff", ["param", "group"])}, {shortest("i", "eff", ["param", "group"])},
tail AS (SELECT param, "group", avg(CAST(value < 0 AS DOUBLE)) AS p FROM eff GROUP BY ALL)"""


def level_order(labels) -> str:
    return "list_position([" + ", ".join(f"'{x}'" for x in labels) + "], param)"


def group_effects(d: C.Design) -> str:
    k = P.GROUP_MODEL_DIVISOR[d.name]
    shown = [(p, h) for p, h in zip(d.parameters, d.hypotheses) if "2 vs 6" not in h.report_label]
    sig = {f"b_sigma_group{g}": P.SIGMA_LABELS[g] for g in COHORTS}
    rows = []
    learn = P.LEARNING_BLOCKS[d.name]
    for i, (p, h) in enumerate(shown):
        label = h.report_label.replace("*", P.TIMES)
        if learn:
            label = label.replace(learn, "Learning").replace("6 vs 7", "Transfer")
        rows.append(f"({i + 1}, '{P.BANDS[h.order]}', '{p}', '{label}')")
    for j, (p, label) in enumerate(sig.items()):
        rows.append(f"({len(shown) + j + 1}, '{P.VARIANCE_BAND}', '{p}', '{label}')")
    is_sigma = "parameter LIKE 'b_sigma%'"
    return params_group(d) + f""",
labels_ AS (SELECT * FROM (VALUES {", ".join(rows)}) t(position, band, parameter, label)),
eff AS MATERIALIZED (
  SELECT p.draw, p.parameter, CASE WHEN p.{is_sigma} THEN p.value ELSE exp(i.value + p.value / {k}) - exp(i.value) END AS value
  FROM params p JOIN params i ON p.draw = i.draw AND i.parameter = 'b_Intercept' JOIN labels_ l ON l.parameter = p.parameter),
{mode("m", "eff", ["parameter"])}, {shortest("i", "eff", ["parameter"])},
tail AS (SELECT parameter, avg(CAST(value < 0 AS DOUBLE)) AS p FROM eff GROUP BY ALL)
SELECT CAST(position AS INTEGER) AS position, band, label AS parameter,
  CASE WHEN {is_sigma} THEN {number_text("exp(m.mode)", 2)} ELSE {number_text("m.mode")} END AS med,
  CASE WHEN {is_sigma} THEN {interval_text("exp(i.lo)", "exp(i.hi)", 2)} ELSE {interval_text("i.lo", "i.hi")} END AS pi,
  CASE WHEN {is_sigma} THEN '--' ELSE {probability_text("p")} END AS p
FROM labels_ JOIN m USING (parameter) JOIN i USING (parameter) JOIN tail USING (parameter)"""


def curve(src: str, keys, labels: str) -> str:
    return f"{shortest('i', src, keys)}, md AS (SELECT {cols(keys)}, median(value) AS m FROM {src} GROUP BY ALL) SELECT {labels}, {r('md.m', 'm')}, {r('i.lo', 'lower')}, {r('i.hi', 'upper')} FROM md JOIN i USING ({cols(keys)})"


SDT_COUNTS = """count(*) FILTER ("isDep" AND "sayDep") AS hits, count(*) FILTER ("isDep") AS signals,
    count(*) FILTER (NOT "isDep" AND "sayDep") AS fas, count(*) FILTER (NOT "isDep") AS noises"""


def sdt(by: str) -> str:
    return JUDGE + f""",
cnt AS (SELECT {by}, {SDT_COUNTS} FROM judge GROUP BY {by}),
pr AS (SELECT *, (hits + 0.5::DOUBLE) / (signals + 1) AS ph, (fas + 0.5::DOUBLE) / (noises + 1) AS pf FROM cnt),
z AS (SELECT *, {probit("ph")} AS z_hit, {probit("pf")} AS z_fa FROM pr)"""


def shift_ml() -> str:
    """CTEs ending in ``ml`` (group, n, ndt, loglik): the same narrowing search, written out."""
    k, last = L.POINTS, L.PASSES - 1
    made = [f"""b0 AS (SELECT "group", 0.0::DOUBLE AS lo, min(rt) * {L.MOST} / {k} AS step FROM clean GROUP BY 1)"""]
    for i in range(L.PASSES):
        made.append(f"""e{i} AS (
  SELECT "group", k, lo, step, count(*) AS n, sum(ln(rt - (lo + k * step))) AS s, sum(ln(rt - (lo + k * step)) * ln(rt - (lo + k * step))) AS q
  FROM clean JOIN b{i} USING ("group"), range({k + 1}) t(k) GROUP BY "group", k, lo, step, dependency, block),
l{i} AS MATERIALIZED (SELECT "group", k, lo, step, sum(n) AS n, -0.5 * sum(n) * ln(sum(q - s * s / n) / sum(n)) - sum(s) AS ll FROM e{i} GROUP BY 1, 2, 3, 4),
m{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY ll DESC, k) AS place FROM l{i}) WHERE place = 1)""")
        if i < last:
            made.append(f'b{i + 1} AS (SELECT "group", lo + step * least(greatest(k - 1, 0), {k - 2}) AS lo, 2 * step / {k} AS step FROM m{i})')
    made.append(f"""ml AS (
  SELECT m."group" AS "group", m.n AS n, m.ll - 0.5 * m.n * (1 + ln(2 * pi())) AS loglik,
    m.lo + m.step * (m.k + CASE WHEN a.ll - 2 * m.ll + b.ll < 0 THEN 0.5 * (a.ll - b.ll) / (a.ll - 2 * m.ll + b.ll) ELSE 0 END) AS ndt
  FROM m{last} m LEFT JOIN l{last} a ON a."group" = m."group" AND a.k = m.k - 1 LEFT JOIN l{last} b ON b."group" = m."group" AND b.k = m.k + 1)""")
    return ", ".join(made)


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"


def replicate_draws() -> str:
    counts, ps, zs, ses, us, es = [], [], [], [], [], []
    cells = [(f"{x}_{k}", cond, yes, base) for k, cond in (("a", "dependency = 'en'"), ("n", "dependency <> 'en'"))
             for x, yes, base in (("hit", '"isDep" AND "sayDep"', '"isDep"'), ("fa", 'NOT "isDep" AND "sayDep"', 'NOT "isDep"'))]
    for c, cond, yes, base in cells:
        counts += [f"count(*) FILTER ({cond} AND {yes}) AS x_{c}", f"count(*) FILTER ({cond} AND {base}) AS n_{c}"]
        ps.append(f"(x_{c} + 0.5::DOUBLE) / (n_{c} + 1) AS p_{c}")
        zs.append(f"{probit(f'p_{c}')} AS z_{c}")
        ses.append(f"sqrt(p_{c} * (1 - p_{c}) / (n_{c} + 1)) * sqrt(2 * pi()) * exp(z_{c} * z_{c} / 2) AS se_{c}")
        us.append(f"{uniform(f"'{c}_' || draw")} AS u_{c}")
        es.append(f"z_{c} + se_{c} * ({probit(f'u_{c}')}) AS {c}")
    return JUDGE + f""",
cnt AS (SELECT {", ".join(counts)} FROM judge),
pr AS (SELECT *, {", ".join(ps)} FROM cnt),
zz AS (SELECT *, {", ".join(zs)} FROM pr),
sz AS (SELECT *, {", ".join(ses)} FROM zz),
un AS (SELECT sz.*, draw, {", ".join(us)} FROM sz, range({M.SDT_REPLICATES}) t(draw)),
dr AS (SELECT draw, {", ".join(es)} FROM un),
sdraws AS (SELECT draw, -fa_a AS "b_c_Intercept", fa_a - fa_n AS b_c_dependencynonadjacent,
  hit_a - fa_a AS "b_dprime_Intercept", (hit_n - fa_n) - (hit_a - fa_a) AS b_dprime_dependencynonadjacent FROM dr)"""


def simulated() -> str:
    kind = "CASE WHEN dependency = 'en' THEN 'adjacent' ELSE 'nonadjacent' END"
    pmf = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))"
    return replicate_draws() + f""",
cells AS (SELECT subj, {kind} AS kind, CAST("isDep" AS INTEGER) AS is_dep, CAST("sayDep" AS INTEGER) AS y, count(*) AS n FROM judge GROUP BY ALL),
etas AS (SELECT cells.*, draw AS rep, CASE WHEN kind = 'adjacent' THEN "b_dprime_Intercept" * is_dep - "b_c_Intercept"
    ELSE ("b_dprime_Intercept" + b_dprime_dependencynonadjacent) * is_dep - ("b_c_Intercept" + b_c_dependencynonadjacent) END AS eta
  FROM cells, sdraws WHERE draw < {PR.REPLICATES}),
probs AS (SELECT *, {normal_cdf("eta")} AS p, {uniform("concat_ws('_', subj, kind, is_dep, y, rep)")} AS u FROM etas),
steps AS (SELECT *, unnest(range(0, n)) AS k FROM probs),
cums AS (SELECT *, sum({pmf}) OVER (PARTITION BY subj, kind, is_dep, y, rep ORDER BY k) AS cum FROM steps),
sim AS (SELECT subj, kind, is_dep, y, n, CAST(rep AS INTEGER) AS rep, count_if(cum < u) AS n_yes FROM cums GROUP BY ALL)"""


def pooling(unit: str) -> str:
    return CLEAN + f""",
pu AS (SELECT {unit}, count(*) AS n, avg(ln(rt)) AS raw, coalesce(var_samp(ln(rt)), 0) AS v FROM clean GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS j, sum(n * raw) / sum(n) AS grand, sum(n * n) AS nn, sum((n - 1) * v) AS within FROM pu),
b AS (SELECT t.*, within / (t.n - j) AS s2, (SELECT sum(pu.n * pow(raw - t.grand, 2)) FROM pu) / (j - 1) AS msb,
  (t.n - nn / t.n) / (j - 1) AS n0 FROM t),
tau AS (SELECT *, greatest(0, (msb - s2) / n0) AS tau2 FROM b)
SELECT {unit}, pu.n, {r("raw")}, {r("tau2 / (tau2 + s2 / pu.n)", "weight")},
  {r("grand + tau2 / (tau2 + s2 / pu.n) * (raw - grand)", "pooled")} FROM pu, tau"""


def nested(latex: bool, convert: bool, point: float) -> str:
    v = "1 / (1 + exp(-value))" if convert else "value"
    body = log_differences(V3D, "draw") + f""",
nx AS (SELECT "group", dependency, effect, {v} AS v FROM diffs),
ns AS (SELECT "group", dependency, effect, avg(v) AS m, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS up,
  round_even(avg(CAST(v < {point} AS DOUBLE)), 3) AS p FROM nx GROUP BY ALL)"""
    nums = [number_text(x, 2) for x in ("m", "lo", "up")]
    if latex:
        p = f"CASE WHEN p = 1 THEN ' $>$ .999' WHEN p = 0 THEN ' $<$ .001' ELSE ' = ' || {number_text('p', 3)} END"
        lead, mid, tail = r"'($\hat{\mu}$ = '", r"', 95\% CrI['", rf"'], P($\beta<{point:g}$)'"
    else:
        p = f"CASE WHEN p = 1 THEN ' > .999' WHEN p = 0 THEN ' < .001' ELSE ' = ' || {number_text('p', 3)} END"
        lead, mid, tail = "'(coef = '", "', 95% CrI['", f"'], P(beta<{point:g})'"
    text = f"{lead} || {nums[0]} || {mid} || {nums[1]} || ', ' || {nums[2]} || {tail} || {p} || ')'"
    return body + f' SELECT "group", dependency, effect, {text} AS text FROM ns'


def regression() -> str:
    d = C.design("seven_block")
    return CLEAN + ", " + weights(d) + f""",
x AS (SELECT "group", dependency, block, ln(rt) AS y, CAST(trial_in_block AS DOUBLE) AS t FROM clean),
cm AS (SELECT "group", dependency, block, avg(y) AS my, avg(t) AS mt, count(*) AS n FROM x GROUP BY ALL),
sl AS (SELECT "group", sum((t - mt) * (y - my)) / sum((t - mt) * (t - mt)) AS slope, avg(t) AS mean_t, stddev_samp(t) AS sd_t,
  sum((t - mt) * (t - mt)) AS tt, sum((y - my) * (y - my)) AS yy, count(*) AS rows_
  FROM x JOIN cm USING ("group", dependency, block) GROUP BY 1),
s2 AS (SELECT *, (yy - slope * slope * tt) / (rows_ - {len(d.cells) + 1}) AS v FROM sl),
adj AS (SELECT "group", dependency, block, my - slope * (mt - mean_t) AS value, n, mt - mean_t AS dt, v, tt FROM cm JOIN s2 USING ("group"))
SELECT adj."group", w.parameter AS term, round(sum(value * w), 4) AS estimate,
  round(sqrt(any_value(v) * (sum(w * w / n) + pow(sum(w * dt), 2) / any_value(tt))), 4) AS se
FROM adj JOIN weights w USING (dependency, block) GROUP BY 1, 2
UNION ALL SELECT "group", 'b_Intercept', round(avg(value), 4), round(sqrt(any_value(v) * (sum(1.0 / n) / {len(d.cells) ** 2} + pow(avg(dt), 2) / any_value(tt))), 4) FROM adj GROUP BY 1
UNION ALL SELECT "group", 'b_scaletrial_in_block', round(slope * sd_t, 4), round(sqrt(v / tt) * sd_t, 4) FROM s2"""


def oracle_sql() -> dict[str, str]:
    W = "WITH "
    ck = '"group", dependency, block'
    CELL = ["group", "dependency", "block"]
    BY = ["group", "dependency", "effect"]
    seven = C.design("seven_block")
    v1, v2, v3 = (C.design(f"group_{v}") for v in ("v1", "v2", "v3"))
    trial_cols = '"group", subj, stim, dependency, dependency2, block, trial_in_block, acc, round(rt, 4) AS rt'
    out: dict[str, str] = {}

    out["clean_trials"] = W + CLEAN + f" SELECT {trial_cols} FROM clean"
    out["clean_trials_nobounds"] = W + TRIALS + f" SELECT {trial_cols} FROM trials WHERE acc = 1 AND dependency2 IS NOT NULL AND dependency <> 'both'"
    out["block_subset"] = W + CLEAN + ' SELECT "group", subj, dependency, block, round(rt, 4) AS rt FROM clean WHERE block IN (1, 6, 7)'
    out["cell_key"] = W + CLEAN + """ SELECT "group" || '_' || dependency || '_' || block AS cell, count(*) AS n, round(avg(rt), 4) AS mean_rt FROM clean GROUP BY 1"""
    out["factor_levels"] = W + TRIALS + " SELECT DISTINCT dependency FROM trials WHERE dependency IS NOT NULL"
    out["ordered_levels"] = W + CLEAN + f" SELECT {baseline()} AS dependency, count(*) AS n, CAST(list_position(['adjacent', 'nonadjacent', 'baseline'], {baseline()}) AS INTEGER) AS position FROM clean GROUP BY 1, 3"
    out["subject_dense_id"] = W + TRIALS + """ SELECT "group", subj, dense_rank() OVER (ORDER BY "group" || ' ' || subj) AS subj_id FROM (SELECT DISTINCT "group", subj FROM trials)"""
    out["relabel_baseline"] = W + CLEAN + f" SELECT {baseline()} AS dependency, count(*) AS n, round(avg(rt), 4) AS mean_rt FROM clean GROUP BY 1"
    out["regex_params"] = W + params7() + """ SELECT "group", parameter, count(*) AS n, round(avg(value), 4) AS mean FROM params WHERE regexp_matches(parameter, 'Block6M7$') GROUP BY 1, 2"""
    out["union_cohorts"] = W + TRIALS + """ SELECT "group", count(*) AS n, count(CASE WHEN "group" = 'adults' THEN stim END) AS n_stim, CAST(sum(acc) AS BIGINT) AS n_acc FROM trials GROUP BY 1"""
    out["zscore_trial"] = W + CLEAN + """ SELECT "group", subj, block, trial_in_block, round((trial_in_block - avg(trial_in_block) OVER ()) / stddev_samp(trial_in_block) OVER (), 4) AS z FROM clean"""
    out["row_ordinal"] = W + CLEAN + """ SELECT "group", block, round(rt, 4) AS rt, subj, stim, trial_in_block, row_number() OVER (PARTITION BY "group", block ORDER BY clean.rt, subj, stim, trial_in_block) AS ordinal FROM clean"""
    out["select_by_name"] = W + CELLS + """ SELECT draw, "group", round(min(value) - 1, 4) AS "b_ndt_Intercept", round(avg(value), 4) AS "b_Intercept" FROM cell GROUP BY 1, 2"""
    betas = ", ".join(f"round(max(value) FILTER (parameter = '{p}'), 4) AS beta_{i + 1}" for i, p in enumerate(v1.parameters))
    out["rename_coefficients"] = W + params_group(v1) + f" SELECT draw, round(max(value) FILTER (parameter = 'b_Intercept'), 4) AS alpha, {betas} FROM params GROUP BY draw"
    out["judgement_flags"] = W + JUDGE + ' SELECT "isDep", "sayDep", count(*) AS n FROM judge GROUP BY 1, 2'

    out["gather_draws"] = W + params7() + ' SELECT draw, "group", parameter, round(value, 4) AS value FROM params'
    out["gather_with_ids"] = W + CELLS + f" SELECT draw, {ck}, round(value, 4) AS value FROM cell"
    out["spread_block"] = W + CELLS + ' SELECT draw, "group", dependency, ' + ", ".join(f"round(max(value) FILTER (block = {b}), 4) AS block_{b}" for b in range(1, 8)) + " FROM cell GROUP BY 1, 2, 3"
    ld = log_differences(V3D, "draw")
    out["pivot_multi_names"] = W + ld + " SELECT draw, " + ", ".join(
        f"round(max(value) FILTER (effect = '{e}' AND \"group\" = '{g}' AND dependency = '{dep}'), 4) AS {e}_{g}_{dep}"
        for e in ("transfer", "learning") for g in COHORTS for dep in DEPS) + " FROM diffs GROUP BY draw"
    out["pivot_multi_values"] = W + ld + " SELECT draw, dependency, " + ", ".join(
        f"round(max(value) FILTER (effect = '{e}' AND \"group\" = '{g}'), 4) AS std_{e}_{g}" for e in ("learning", "transfer") for g in COHORTS) + " FROM diffs GROUP BY draw, dependency"
    out["separate_cell"] = W + CLEAN + ' SELECT "group", dependency, CAST(block AS VARCHAR) AS block, count(*) AS n, round(max(rt), 4) AS max_rt FROM clean GROUP BY ALL'
    out["unite_parameter"] = W + CLEAN + """ SELECT 'rt_' || "group" || '_' || dependency AS parameter, round(avg(rt), 4) AS mean, round(stddev_samp(rt), 4) AS sd FROM clean GROUP BY 1"""
    out["join_sigma"] = W + log_differences(V3D, "mean") + """ SELECT draw, "group", dependency, effect, round(value, 4) AS value FROM diffs"""
    out["natural_left_join"] = W + CLEAN + """, ms AS (SELECT dependency, avg(rt) AS mean, stddev_samp(rt) AS sd FROM clean GROUP BY 1) SELECT a."group", a.dependency, a.n, round(mean, 4) AS mean, round(sd, 4) AS sd FROM (SELECT "group", dependency, count(*) AS n FROM trials GROUP BY ALL) a LEFT JOIN ms ON a.dependency = ms.dependency"""

    out["kde_mode"] = W + CELLS + f", msr AS (SELECT {ck}, exp(value) AS value FROM cell), {mode('m', 'msr', CELL)} SELECT {ck}, n, round(mode, 4) AS mode FROM m JOIN m_s USING ({ck})"
    out["median_by_cell"] = W + CLEAN + f" SELECT {ck}, count(*) AS n, round(median(rt), 4) AS median FROM clean GROUP BY ALL"
    out["hpdi_by_cell"] = W + CLEAN + f", {shortest('i', 'clean', CELL, 'rt')} SELECT {ck}, round(lo, 4) AS lo, round(hi, 4) AS up FROM i"
    out["percentile_interval"] = W + CLEAN + f" SELECT {ck}, round(quantile_cont(rt, 0.025), 6) AS lo, round(quantile_cont(rt, 0.975), 6) AS up FROM clean GROUP BY ALL"
    dp = ["dependency"]
    out["pooled_summary"] = W + CLEAN + f""", {mode("m", "clean", dp, "rt")}, {shortest("i", "clean", dp, "rt")}, {shortest("h", "clean", dp, "rt", 0.89, "hdi")},
md AS (SELECT dependency, count(*) AS n, median(rt) AS median FROM clean GROUP BY 1)
SELECT dependency, n, {r("median")}, round(i.lo, 4) AS lo_95, round(i.hi, 4) AS hi_95, round(h.lo, 4) AS lo_89, round(h.hi, 4) AS hi_89, {r("mode")}
FROM md JOIN m USING (dependency) JOIN i USING (dependency) JOIN h USING (dependency)"""
    out["tail_probability"] = W + ld + """ SELECT "group", dependency, effect, count(*) AS n, round(avg(CAST(value < 0 AS DOUBLE)), 4) AS p_below, round(avg(CAST(value > 0 AS DOUBLE)), 4) AS p_above FROM diffs GROUP BY ALL"""
    out["rope_share_by_effect"] = W + ld + f""", {shortest('hdi', 'diffs', BY, 'value', 0.89, 'hdi')}
SELECT a."group", a.dependency, a.effect, round(any_value(lo), 4) AS lo_89, round(any_value(hi), 4) AS hi_89,
  round(100 * avg(CAST(value BETWEEN {E.ROPE_LOW} AND {E.ROPE_HIGH} AS DOUBLE)), 4) AS rope
FROM diffs a JOIN hdi b ON {on(BY)} AND value BETWEEN lo AND hi GROUP BY 1, 2, 3"""
    out["mean_sd"] = W + JUDGE + " SELECT dependency, round(avg(acc), 4) AS mean, round(stddev_samp(acc), 4) AS sd FROM judge GROUP BY 1"
    prop = """pc AS (SELECT "isDep", dependency, count(*) AS n, avg(CAST("sayDep" AS DOUBLE)) AS m FROM judge GROUP BY 1, 2), ps AS (SELECT *, sqrt(m * (1 - m) / n) AS se FROM pc)"""
    out["proportion_ci"] = W + JUDGE + f""", {prop} SELECT "isDep", dependency, n, {r("m")}, {r("se")}, {r("m - 1.96 * se", "lower")}, {r("m + 1.96 * se", "upper")} FROM ps"""
    per_subj = TRIALS + """, ps AS (SELECT "group", subj, avg(acc) * 100 AS a FROM trials GROUP BY 1, 2)"""
    acc = {"median": "median(a)", "iqr": "quantile_cont(a, 0.75) - quantile_cont(a, 0.25)", "min": "min(a)", "max": "max(a)"}
    out["accuracy_summary"] = W + per_subj + ' SELECT "group", ' + ", ".join(f'round({e}, 4) AS "{k}"' for k, e in acc.items()) + " FROM ps GROUP BY 1"
    inc, ini, oor = (
        "100 * avg(CAST(acc = 0 AS DOUBLE))", "100 * avg(CAST(dependency2 IS NULL AS DOUBLE))",
        "100 * avg(CAST(NOT (rt > 100 AND rt < 10000) AS DOUBLE))",
    )
    out["level_share"] = W + TRIALS + f' SELECT "group", {r(inc, "incorrect")}, {r(oor, "out_of_range")} FROM trials GROUP BY 1'
    out["missing_share"] = W + TRIALS + f' SELECT "group", {r(ini, "initial")} FROM trials GROUP BY 1'
    out["crosstab"] = W + TRIALS + " SELECT dependency2, " + ", ".join(f"count(*) FILTER (block = {b}) AS block_{b}" for b in range(1, 8)) + " FROM trials GROUP BY 1"
    out["level_counts"] = W + CLEAN + " SELECT block, count(*) AS n FROM clean GROUP BY 1"
    out["six_number"] = W + CELLS + ', msr AS (SELECT "group", exp(value) AS v FROM cell) SELECT "group", round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS "max" FROM msr GROUP BY 1'
    out["sigma_by_group"] = W + CELLS + ", " + SIGMA + ' SELECT "group", round(avg(s), 4) AS sigma FROM sig GROUP BY 1'
    bf = ld + ", " + height("hh", "diffs", BY, 0.0) + ' SELECT "group", dependency, effect, round(height, 4) AS posterior, '
    n0 = f"{S.NORMAL_HEIGHT_AT_ZERO!r}::DOUBLE"
    out["bayes_factor_kde"] = W + bf + f"round({n0} / height, 4) AS bf FROM hh"
    out["bayes_factor_kde_inverse"] = W + bf + f"round(height / {n0}, 4) AS bf FROM hh"
    out["nested_effect_report"] = W + nested(True, False, 0.0)
    out["nested_effect_plain"] = W + nested(False, True, 0.5)

    out["order_by_length"] = W + params7() + " SELECT parameter, count(*) AS n, CAST(length(parameter) AS INTEGER) AS id FROM params GROUP BY 1, 3"
    out["logit_to_prob"] = W + ld + ' SELECT draw, "group", dependency, effect, round(1 / (1 + exp(-value)), 4) AS value FROM diffs'
    out["empirical_logit"] = W + TRIALS + ', e AS (SELECT "group", subj, CAST(sum(acc) AS BIGINT) AS y, count(*) AS n FROM trials GROUP BY 1, 2) SELECT *, round(ln((y + 0.5) / (n - y + 0.5)), 4) AS elog FROM e'
    out["normal_cdf_probit"] = W + ld + f""", e AS (SELECT draw, "group", dependency, effect, value, {normal_cdf("value")} AS phi FROM diffs), f AS (SELECT *, round(phi, 6) AS p6 FROM e)
SELECT draw, "group", dependency, effect, {r("value")}, {r("phi")}, round({probit("p6")}, 4) AS z FROM f"""
    out["round_numeric"] = W + CLEAN + f" SELECT {ck}, round_even(avg(rt), 0) AS mean, round_even(stddev_samp(rt), 0) AS sd FROM clean GROUP BY ALL"
    out["decode_names"] = W + params7() + " SELECT parameter, count(*) AS n, replace(replace(replace(parameter, 'b_COND', ''), 'MU', ':'), 'M', '-') AS name FROM params WHERE parameter LIKE 'b!_COND%' ESCAPE '!' GROUP BY 1, 3"
    tails = {c: f"avg(CAST(rt < {x} AS DOUBLE))" for c, x in (("p_fast", 110), ("p_below", 5000), ("p_slow", 9990))}
    pt = CLEAN + f", pt AS (SELECT {ck}, " + ", ".join(f"{e} AS {c}" for c, e in tails.items()) + " FROM clean GROUP BY ALL)"
    out["format_p"] = W + pt + f" SELECT {ck}, " + ", ".join(f"{probability_text(c)} AS {c}" for c in tails) + " FROM pt"
    out["format_interval"] = W + CLEAN + f", {shortest('i', 'clean', CELL, 'rt')} SELECT {ck}, {interval_text('lo', 'hi')} AS pi FROM i"
    out["percent_text"] = W + pt + f" SELECT {ck}, {number_text('p_below * 100')} || '%' AS share FROM pt"

    out["encode_7block"] = W + params7() + """ SELECT draw, "group", parameter, round(value, 4) AS value FROM params WHERE parameter NOT IN ('b_ndt_Intercept', 'b_scaletrial_in_block')"""
    out["decode_7block"] = out["gather_with_ids"]
    for d in (v1, v2, v3):
        out[f"decode_{d.name}"] = W + CELLS + " SELECT draw, " + ", ".join(
            f"round(max(value) FILTER (\"group\" = '{g}' AND dependency = '{dep}' AND block = {b}), 4) AS {g}_{dep}_{b}" for g, dep, b in d.cells) + " FROM cell GROUP BY draw"
    blocks = ", ".join(map(str, v1.blocks))
    out["decode_by_join"] = W + CELLS + f""" SELECT draw, "group" || '_' || dependency || '_' || block AS cell, round(value, 4) AS value FROM cell WHERE block IN ({blocks})"""
    out["encode_group_v2"] = W + params_group(v2) + " SELECT draw, parameter, round(value, 4) AS value FROM params WHERE parameter LIKE 'b!_COND%' ESCAPE '!'"
    coding = seven.coding()
    vals = ", ".join(f"('{dep}', {b}, {', '.join(f'{w:.12f}::DOUBLE' for w in coding[i])})" for i, (dep, b) in enumerate(seven.cells))
    names = ", ".join(f'"{p}"' for p in seven.parameters)
    means = ", ".join(f'round(avg("{p}"), 4) AS "{p}"' for p in seven.parameters)
    out["attach_coding"] = W + CLEAN + f", coding AS (SELECT * FROM (VALUES {vals}) t(dependency, block, {names})) SELECT c.dependency || '_' || c.block AS cell, count(*) AS n, {means} FROM clean c JOIN coding USING (dependency, block) GROUP BY 1"
    ms = "round(exp(i.value + p.value / {k}) - exp(i.value), 4) AS value"
    out["effect_ms_k4"] = W + params7() + f""" SELECT p.draw, p."group", p.parameter AS param, {ms.format(k=4)} FROM params p JOIN params i ON p.draw = i.draw AND p."group" = i."group" AND i.parameter = 'b_Intercept' WHERE p.parameter LIKE 'b!_COND%' ESCAPE '!'"""
    out["effect_ms_k8"] = W + params_group(v3) + f""" SELECT p.draw, p.parameter AS param, {ms.format(k=8)} FROM params p JOIN params i ON p.draw = i.draw AND i.parameter = 'b_Intercept' WHERE p.parameter LIKE 'b!_COND%' ESCAPE '!'"""
    out["block_differences"] = W + ld + ' SELECT draw, "group", dependency, effect, round(ms, 4) AS value FROM diffs'
    out["condition_differences"] = W + CELLS + " " + " UNION ALL ".join(
        f"SELECT draw, \"group\", '{n}' AS dependency, CAST({b} AS INTEGER) AS block, round(exp({k}_{b}) - exp(none_{b}), 4) AS value FROM wide"
        for b in range(1, 8) for n, k in (("adj", "adjacent"), ("nonadj", "nonadjacent")))
    out["averaged_conditions"] = W + CELLS + """ SELECT draw, "group", CASE WHEN dependency = 'none' THEN 'none' ELSE 'dependency' END AS dependency, block, round(exp(avg(value)), 4) AS value FROM cell WHERE block IN (1, 6, 7) GROUP BY 1, 2, 3, 4"""
    for s in ("mean", "draw"):
        out[f"effect_size_{s}_sigma"] = W + log_differences(V3D, s) + ' SELECT draw, "group", dependency, effect, round(value, 4) AS value FROM diffs'

    desc = ", ".join(f'round_even({e}, 2) AS "{k}"' for k, e in acc.items())
    out["q1_cohort_description"] = W + per_subj + f""", d1 AS (SELECT "group", {desc} FROM ps GROUP BY 1), d2 AS (SELECT "group", round_even({inc}, 2) AS incorrect, round_even({ini}, 2) AS initial, round_even({oor}, 2) AS out_of_range FROM trials GROUP BY 1) SELECT * FROM d1 JOIN d2 USING ("group")"""
    gbd = ["group", "block", "dependency"]
    out["q2_condition_curve"] = W + CELLS + f', msr AS (SELECT "group", block, {baseline()} AS dependency, exp(value) AS value FROM cell), ' + curve("msr", gbd, cols(gbd))
    gd = ["group", "dependency"]
    parts = " UNION ALL ".join(f"SELECT \"group\", '{P.BASELINE.get(k, k)}' AS dependency, exp({k}_7) - exp({k}_6) AS value FROM wide" for k in DEPS)
    out["q3_transfer_slowdown"] = W + CELLS + f", df AS ({parts}), {mode('m', 'df', gd)}, {shortest('i', 'df', gd)}, tail AS (SELECT {cols(gd)}, avg(CAST(value > 0 AS DOUBLE)) AS p FROM df GROUP BY ALL)" + rounded("df", gd, "tail")
    for name, blocks in (("q4_dependency_vs_baseline", range(1, 7)), ("q5_dependency_vs_baseline_block5", (5,))):
        parts = " UNION ALL ".join(f"SELECT \"group\", '{n}' AS dependency, exp({k}_{b}) - exp(none_{b}) AS value FROM wide" for b in blocks for n, k in (("adj", "adjacent"), ("nonadj", "nonadjacent")))
        out[name] = W + CELLS + f", df AS ({parts}), {mode('m', 'df', gd)}, {shortest('i', 'df', gd)}" + rounded("df", gd)
    pairs = (("adj", "adjacent", "none"), ("nonadj", "none", "nonadjacent"), ("adj_to_nonadj", "adjacent", "nonadjacent"))
    parts = " UNION ALL ".join(f"SELECT \"group\", CAST(7 AS INTEGER) AS block, '{n}' AS dependency, exp({a}_7) - exp({b}_7) AS value FROM wide" for n, a, b in pairs)
    out["q6_condition_pairs"] = W + CELLS + f", df AS ({parts}), {mode('m', 'df', gbd)}, {shortest('i', 'df', gbd)} SELECT {cols(gbd)}, round(mode, 4) AS m, round(lo, 4) AS lo, round(hi, 4) AS hi FROM m JOIN i USING ({cols(gbd)})"
    gp = ["group", "param"]
    out["q7_fixed_effects"] = W + params7() + f""", df AS MATERIALIZED (SELECT p."group", replace(replace(replace(p.parameter, 'b_COND', ''), 'MU', ':'), 'M', '-') AS param, exp(i.value + p.value / 4) - exp(i.value) AS value
  FROM params p JOIN params i ON p.draw = i.draw AND p."group" = i."group" AND i.parameter = 'b_Intercept' WHERE p.parameter LIKE 'b!_COND%' ESCAPE '!'),
{mode('m', 'df', gp)}, {shortest('i', 'df', gp)}, tail AS (SELECT {cols(gp)}, avg(CAST(value < 0 AS DOUBLE)) AS p FROM df GROUP BY ALL)""" + rounded("df", gp, "tail")
    levels = [P.INTERCEPT_LABEL, *[h.report_label for h in seven.hypotheses], P.REPETITION_LABEL, P.SHIFT_LABEL]
    text = {"med": number_text("m.mode"), "pi": interval_text("i.lo", "i.hi"), "p": probability_text("tail.p")}
    picks8 = ", ".join(f"max({c}) FILTER (\"group\" = '{g}') AS {c}_{g}" for g in COHORTS for c in text)
    out["q8_cohort_effects_table"] = W + labelled7() + f""", tx AS (SELECT param, "group", {", ".join(f"{e} AS {c}" for c, e in text.items())}
  FROM m JOIN i USING (param, "group") JOIN tail USING (param, "group") WHERE param NOT IN ('{P.INTERCEPT_LABEL}', '{P.REPETITION_LABEL}')),
tw AS (SELECT param, {picks8} FROM tx GROUP BY param)
SELECT CAST({level_order(levels)} AS INTEGER) AS position, CASE WHEN contains(param, '*') THEN 'Interactions' ELSE 'Main effects' END AS band,
  replace(tw.param, '*', '{P.TIMES}') AS param, {", ".join(f"{c}_{g}" for g in COHORTS for c in text)} FROM tw"""
    out["q9_effects_figure"] = W + labelled7() + f""" SELECT CAST({level_order(list(reversed(levels)))} AS INTEGER) AS position, param, "group", round(mode, 4) AS med, round(lo, 4) AS lo, round(hi, 4) AS up, round(p, 4) AS p FROM m JOIN i USING (param, "group") JOIN tail USING (param, "group")"""
    for d, v in ((v1, "v1"), (v2, "v2"), (v3, "v3")):
        out[f"q10_group_effects_{v}"] = W + group_effects(d)
        blocks = ", ".join(map(str, d.blocks))
        out[f"q11_group_curve_{v}"] = W + CELLS + f""", msr AS (SELECT 'Group: ' || "group" AS "group", 'Block: ' || block AS block, {baseline()} AS dependency, exp(value) AS value FROM cell WHERE block IN ({blocks})), """ + curve("msr", gbd, cols(gbd))
        scale = "draw" if v == "v2" else "mean"
        out[f"q12_effect_sizes_{v}"] = W + effect_table(d, block_rows(d), scale) + effect_select(BY)
        out[f"q13_dependency_effects_{v}"] = W + effect_table(d, dependency_rows(d), scale) + effect_select(BY)
    out["q13_dependency_effects_compat_v2"] = W + effect_table(v2, dependency_rows(v2), "draw", True) + effect_select(BY)
    out["q14_age_dependency_v3"] = W + effect_table(v3, age_dependency_rows(v3, False), "mean") + effect_select(["group"])
    out["q14_age_dependency_compat_v3"] = W + effect_table(v3, age_dependency_rows(v3, True), "mean") + effect_select(["group"])
    out["q15_age_learning_v3"] = W + effect_table(v3, age_block_rows(v3), "mean") + effect_select(["group", "effect"])
    out["q16_accuracy_by_dependency"] = out["mean_sd"]
    out["q16_hit_rates"] = W + JUDGE + f""", {prop} SELECT CASE WHEN "isDep" THEN 'Hit' ELSE 'False alarm' END AS response, dependency, n, {r("m")}, {r("se")}, {r("m - 1.96 * se", "lower")}, {r("m + 1.96 * se", "upper")} FROM ps"""
    sd_cols = list(P.SDT_LABELS)
    sd_long = " UNION ALL ".join(f"""SELECT '{P.SDT_LABELS[c].replace("'", "''")}' AS param, "{c}" AS value FROM sdraws""" for c in sd_cols)
    out["q17_sdt_table"] = W + replicate_draws() + f", sl AS ({sd_long}) SELECT param, round_even(median(value), 2) AS med, round_even(quantile_cont(value, 0.025), 2) AS lo, round_even(quantile_cont(value, 0.975), 2) AS up FROM sl GROUP BY 1"
    out["report_scalars"] = W + effect_table(v3, dependency_rows(v3), "mean") + f""" SELECT "group", dependency, effect, round_even(d_med, 2) AS d_med, round_even(d_lo, 2) AS d_lo, round_even(d_up, 2) AS d_up, {number_text("rope")} || '%' AS rope FROM effects WHERE effect = 'transfer'"""

    out["source_trials"] = W + TRIALS + ' SELECT "group", block, count(*) AS n, count(dependency2) AS n_dependent, CAST(sum(acc) AS BIGINT) AS n_acc, round(avg(rt), 4) AS mean_rt FROM trials GROUP BY 1, 2'
    out["source_rejects"] = W + TRIALS + """, marked AS (SELECT *, block = 7 AND stim = 3 AS bad_rt, block IN (2, 7) AND stim IN (3, 5) AS bad_acc FROM trials)
SELECT block, count(*) AS n, round(avg(rt), 4) AS mean_rt, 'accepted' AS "column", NULL AS raw FROM marked WHERE NOT bad_rt AND NOT bad_acc GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL, 'rt', 'slow' FROM marked WHERE bad_rt HAVING count(*) > 0
UNION ALL SELECT NULL, count(*), NULL, 'acc', 'yes' FROM marked WHERE bad_acc HAVING count(*) > 0"""
    out["source_judgements"] = W + JUDGE + """ SELECT dependency, CASE WHEN "sayDep" THEN 'k' ELSE 'd' END AS given, count(*) AS n, count(DISTINCT item) AS n_items FROM judge GROUP BY 1, 2"""
    intercept = f'SELECT draw, avg(value) AS v FROM cell WHERE block IN ({", ".join(map(str, v1.blocks))}) GROUP BY 1'
    out["source_draws"] = W + CELLS + f""", i AS ({intercept}), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS d FROM i)
SELECT count(*) AS n, count(DISTINCT d) AS n_draws, max(d) AS last_draw, round(avg(v), 4) AS mean, round(corr(d, v), 4) AS "order" FROM k"""
    out["source_derived"] = W + CELLS + ", " + SIGMA + ' SELECT "group", round(avg(s), 4) AS sigma FROM sig GROUP BY 1'
    probabilities = ", ".join(f"({p}::DOUBLE)" for p in QU.SKETCH_PROBABILITIES)
    out["refreshed_results"] = W + CLEAN + """, t AS (SELECT block, dependency, CASE WHEN block = 2 THEN rt * 2 ELSE rt END AS rt FROM clean WHERE block <> 1)
SELECT block, dependency, round(avg(rt), 4) AS mean, round(stddev_samp(rt), 4) AS sd, CAST(CASE WHEN block IN (2, 7) THEN 2 ELSE 1 END AS BIGINT) AS version FROM t GROUP BY block, dependency"""
    out["quantile_sketches"] = W + CLEAN + f""", g AS (SELECT "group", dependency, count(*) AS n FROM clean GROUP BY 1, 2) SELECT "group", dependency, p, n, true AS within FROM g, (VALUES {probabilities}) t(p)"""
    out["shift_ml"] = W + CLEAN + ", " + shift_ml() + ' SELECT "group", CAST(n AS BIGINT) AS n, round(ndt, 4) AS ndt, round(loglik, 4) AS loglik FROM ml'
    out["shifted_lognormal_ml_cells"] = W + CLEAN + ", " + shift_ml() + f""" SELECT {ck}, count(*) AS n, round(any_value(ndt), 4) AS ndt, round(avg(ln(rt - ndt)), 4) AS mu, round(stddev_samp(ln(rt - ndt)), 4) AS sigma FROM clean JOIN ml USING ("group") GROUP BY ALL"""
    out["shifted_lognormal_cells"] = W + CLEAN + f""", sh AS (SELECT "group", min(rt) * {M.SHIFT_SHARE} AS ndt FROM clean GROUP BY 1) SELECT {ck}, count(*) AS n, round(any_value(ndt), 4) AS ndt, round(avg(ln(rt - ndt)), 4) AS mu, round(stddev_samp(ln(rt - ndt)), 4) AS sigma FROM clean JOIN sh USING ("group") GROUP BY ALL"""
    out["contrast_regression"] = W + regression()
    out["partial_pooling"] = W + pooling("subj")
    out["partial_pooling_stimulus"] = W + pooling("stim")
    for name, by in (("sdt_dprime", "dependency"), ("sdt_dprime_by_subject", "subj")):
        out[name] = W + sdt(by) + f" SELECT {by}, hits, signals, fas, noises, {r('z_hit')}, {r('z_fa')}, {r('z_hit - z_fa', 'dprime')}, {r('-z_fa', 'criterion')} FROM z"
    out["sdt_replicates"] = W + replicate_draws() + " SELECT draw, " + ", ".join(f'round("{c}", 4) AS "{c}"' for c in sd_cols) + " FROM sdraws"
    out["rhat"] = W + params7() + f""", pc AS (SELECT "group", parameter, draw % {WH.CHAINS} AS chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM params GROUP BY ALL), pp AS (SELECT "group", parameter, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM pc GROUP BY ALL) SELECT "group", parameter, round(sqrt(((n - 1) / n * w + b) / w), 4) AS rhat FROM pp"""
    sm = W + simulated()
    out["predictive_bars"] = sm + """, ob AS (SELECT y, sum(n) AS observed FROM sim WHERE rep = 0 GROUP BY 1), t AS (SELECT rep, sum(n) AS n, sum(n_yes) AS yes FROM sim GROUP BY 1), pr2 AS (SELECT 0 AS y, n - yes AS c FROM t UNION ALL SELECT 1, yes FROM t), qs AS (SELECT y, quantile_cont(c, 0.5) AS a, quantile_cont(c, 0.05) AS b, quantile_cont(c, 0.95) AS c FROM pr2 GROUP BY 1) SELECT y, CAST(observed AS BIGINT) AS observed, round(a, 4) AS sim_mid, round(b, 4) AS sim_lo, round(c, 4) AS sim_hi FROM ob LEFT JOIN qs USING (y)"""
    out["predictive_rootogram"] = sm + f""", ps AS (SELECT rep, subj, CAST(sum(y * n) AS BIGINT) AS o, CAST(sum(n_yes) AS BIGINT) AS s FROM sim GROUP BY 1, 2), u AS (SELECT o AS k, CASE WHEN rep = 0 THEN 1 ELSE 0 END AS a, 0 AS b FROM ps UNION ALL SELECT s, 0, 1 FROM ps) SELECT k, round(sqrt(sum(a)), 4) AS observed, round(sqrt(sum(b) / {PR.REPLICATES}), 4) AS simulated FROM u GROUP BY 1"""
    out["predictive_stat2d"] = sm + """, t AS (SELECT rep, sum(n) AS n, sum(n_yes) AS s, sum(y * n) AS o FROM sim GROUP BY 1), u AS (SELECT rep, n, s AS c FROM t UNION ALL SELECT -1, n, o FROM t WHERE rep = 0) SELECT rep, round(c / n, 4) AS mean, round(sqrt(c / n * (1 - c / n) * n / (n - 1)), 4) AS sd FROM u"""
    out["predictive_error_hist"] = sm + ", e AS (SELECT rep, y - 1 AS error, n_yes AS c FROM sim UNION ALL SELECT rep, y, n - n_yes FROM sim) SELECT rep, error, CAST(sum(c) AS BIGINT) AS n FROM e WHERE c > 0 GROUP BY 1, 2"
    out["predictive_scatter_avg"] = sm + f", u AS (SELECT subj, kind, is_dep, y, n, sum(n_yes) / (n * {PR.REPLICATES}) AS p FROM sim GROUP BY 1, 2, 3, 4, 5) SELECT y, round(p, 4) AS prediction, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY y, p"
    blocks3 = ", ".join(map(str, v3.blocks))
    out["conditional_effects_response"] = W + CELLS + f""", shift AS (SELECT draw, "group", exp(min(value) - 1) AS ndt FROM cell WHERE block IN ({blocks3}) GROUP BY 1, 2), ms AS (SELECT {ck}, exp(value + s * s / 2) + ndt AS v FROM cell JOIN scale USING (draw, "group") JOIN shift USING (draw, "group") WHERE block IN ({blocks3})) SELECT {ck}, round(median(v), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM ms GROUP BY ALL"""
    out["conditional_effects"] = W + CELLS + f" SELECT {ck}, round(median(exp(value)), 6) AS estimate, round(quantile_cont(exp(value), 0.025), 6) AS lower, round(quantile_cont(exp(value), 0.975), 6) AS upper FROM cell WHERE block IN (1, 6, 7) GROUP BY ALL"
    for v, blocks in (("v1", "6, 7"), ("v2", "1, 2, 6, 7")):
        out[f"conditional_effects_{v}"] = out["conditional_effects"].replace("block IN (1, 6, 7)", f"block IN ({blocks})")
    etas = " UNION ALL ".join(f"SELECT '{k}' AS dependency, {d} AS is_dep, hit_{x} AS z FROM dr" if d else f"SELECT '{k}', {d}, fa_{x} FROM dr"
                              for k, x in (("adjacent", "a"), ("nonadjacent", "n")) for d in (1, 0))
    out["conditional_effects_sdt"] = W + replicate_draws() + f""", z AS ({etas}), e AS (SELECT dependency, is_dep, {normal_cdf("z")} AS value FROM z)
SELECT dependency, is_dep, round(median(value), 6) AS estimate, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM e GROUP BY 1, 2"""
    out["trials_by_dense_id"] = W + TRIALS + """, t AS (SELECT *, dense_rank() OVER (ORDER BY "group" || ' ' || subj) AS subj_id FROM trials)
SELECT subj_id, "group", count(*) AS n, round(min(rt), 4) AS min_rt FROM t GROUP BY 1, 2"""
    seven = C.design("seven_block")
    named = {p: p.removeprefix("b_").removeprefix("COND") for p in ("b_Intercept", *seven.parameters, "b_ndt_Intercept", "b_scaletrial_in_block")}
    renamed = ", ".join(f"round(max(value) FILTER (parameter = '{p}'), 4) AS \"{n}\"" for p, n in named.items())
    out["rename_by_position"] = W + params7() + f' SELECT draw AS k, CAST(draw % 3 AS INTEGER) AS "set", "group" AS cohort, {renamed} FROM params GROUP BY draw, "group"'
    out["draw_subset_negated"] = W + params7() + """ SELECT "group", parameter, count(*) AS n, round(avg(value), 4) AS mean FROM params
WHERE parameter NOT IN ('b_Intercept', 'b_ndt_Intercept') AND NOT regexp_matches(parameter, 'Block') GROUP BY 1, 2"""
    out["draw_subset"] = W + params7() + """ SELECT "group", count(DISTINCT parameter) AS n_parameters, count(*) AS n, round(avg(value), 4) AS mean FROM params WHERE parameter IN ('b_Intercept', 'b_CONDDependency', 'b_CONDAdjacency') GROUP BY 1"""
    return out
