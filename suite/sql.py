"""Building blocks of the oracle SQL (DuckDB)."""

from __future__ import annotations

from suite.adapters import CLASSIFICATION_SQL, EVENTS_SQL, OPS_SQL, STRATEGIES_SQL

D, DAY, WEEK = 4, 86_400_000_000, 604_800_000_000


def r(expression: str, name: str, digits: int = D) -> str:
    return f'round(cast({expression} as double), {digits}) + 0.0e0 as "{name}"'


def ts(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') as \"{name}\""


def secs(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1e6)"


def _open(t: str) -> str:
    us = f"(epoch_us({t}) - 345600000000)"
    return (
        f"((({us} // {WEEK}) * 5 + least(({us} // {DAY}) % 7, 5)) * 34200000000 + "
        f"case when ({us} // {DAY}) % 7 < 5 then greatest(0, least(34200000000, {us} % {DAY} - 32400000000)) else 0 end)"
    )


def work_hours(start: str, end: str) -> str:
    return f"coalesce(abs({_open(end)} - {_open(start)}) / 3.6e9, 0)"


def hhmm_seconds(x: str) -> str:
    s = f"cast(trunc({x}) as bigint)"
    return (
        f"case when {x} is null then null else (case when {s} < 0 then '-' else '' end) || "
        f"printf('%02d:%02d', abs({s}) // 3600, (abs({s}) % 3600) // 60) end"
    )


def hhmm_hours(x: str) -> str:
    whole = f"cast(floor(abs({x})) as bigint)"
    minutes = f"cast(round_even((abs({x}) - floor(abs({x}))) * 60, 0) as bigint)"
    return (
        f"case when {x} is null then null else (case when {x} < 0 then '-' else '' end) || "
        f"printf('%02d:%02d', {whole} + case when {minutes} = 60 then 1 else 0 end, "
        f"case when {minutes} = 60 then 0 else {minutes} end) end"
    )


def zcat(z: str) -> str:
    return (
        f"case when {z} is null then 'sin_referencia' when {z} > 1.2816 then 'critico' when {z} > 0.5244 then 'mejorable' "
        f"when {z} >= -0.5244 then 'normal' when {z} >= -1.2816 then 'bueno' else 'excelente' end"
    )


LINES = "('Azul','Rojo','Amarillo','Verde','Morado','Naranja')"
ORDER = "(map {'Naranja':1,'Azul':2,'Rojo':3,'Verde':4,'Amarillo':5,'Morado':6,'Pre-Calidad':7,'Calidad':8})"
STATION = """case
    when lower(trim(E)) = 'calidad' then 'Calidad'
    when lower(trim(E)) in ('pre-calidad','pre calidad','precalidad') then 'Pre-Calidad'
    when lower(trim(E)) in ('bg','morado') then 'Morado'
    when lower(trim(E)) = 'azul' then 'Azul' when lower(trim(E)) = 'rojo' then 'Rojo'
    when lower(trim(E)) = 'verde' then 'Verde' when lower(trim(E)) = 'amarillo' then 'Amarillo'
    when regexp_full_match(trim(E), 'Estacion [+-]?[0-9]+') then
      ['Calidad','Azul','Rojo','Verde','Amarillo','Morado'][((cast(substr(trim(E), 10) as bigint) % 6) + 6) % 6 + 1]
    else 'Otro' end"""


def station(column: str) -> str:
    return STATION.replace("E)", f"{column})").replace("trim(E,", f"trim({column},")


OPS = "with " + OPS_SQL
EVENTS = "with " + EVENTS_SQL
STRATEGIES = "with " + STRATEGIES_SQL

BASE = OPS + f""",
base as (select *, cast(year(init_scan) as int) as "año", {secs('init_scan', 'last_scan')} as tiempo_total_seg,
    {secs('init_scan', 'last_scan')} / 60 as tiempo_total_min from ops)"""
CLEAN = BASE + """,
pos as (select * from base where picks > 0),
iq as (select tipo_estacion, quantile_cont(tiempo_total_seg, 0.25) q1, quantile_cont(tiempo_total_seg, 0.75) q3 from pos group by 1),
clean as (select pos.*, tiempo_total_seg / picks as tiempo_por_pick, picks / tiempo_total_min as picks_por_min
  from pos join iq using (tipo_estacion)
  where tiempo_total_seg between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1))"""
MEDIANS = CLEAN + """,
med as (select campana, tipo_estacion, cliente, "año", median(tiempo_por_pick) mediana_tpp from clean group by 1,2,3,4)"""
SCORES = MEDIANS + """,
ctx as (select cliente, tipo_estacion, count(mediana_tpp) n, median(mediana_tpp) mu, stddev_samp(mediana_tpp) sd from med group by 1,2),
scores as (select med.*, case when n >= 2 and sd <> 0 then (mediana_tpp - mu) / sd end z_score from med join ctx using (cliente, tipo_estacion))"""

GAPS = BASE + f""",
lagged as (select *, lag(last_scan) over k pl, lag(tipo_estacion) over k po from base
  window k as (partition by campana, box_id order by init_scan, last_scan, tipo_estacion)),
g0 as (select *, {secs('pl', 'init_scan')} gap, coalesce({ORDER}[po] > {ORDER}[tipo_estacion], false) back from lagged),
lim as (select tipo_estacion, quantile_cont(gap, 0.05) lo, quantile_cont(gap, 0.9) hi from g0 where gap >= 0 and not back group by 1),
gaps as (select g0.*, case when gap >= 0 and not back and gap between lo and hi then gap end muerto,
    case when pl is null then null when gap < 0 then 'negativo' when back then 'retroceso_flujo'
         when gap between lo and hi then null when gap > hi then 'percentil_alto' else 'percentil_bajo' end motivo
  from g0 left join lim using (tipo_estacion))"""
TRANSITIONS = GAPS + """,
rej as (select campana, po, tipo_estacion, count(*) n_out from gaps where motivo is not null group by 1,2,3),
ini as (select campana, min(init_scan) fecha_inicio from gaps group by 1),
val as (select campana, cliente, "año", po, tipo_estacion, median(muerto) med, avg(muerto) prom, count(muerto) n
  from gaps where po is not null group by 1,2,3,4,5),
trans as (select val.*, n + coalesce(n_out, 0) n_total, fecha_inicio from val left join rej using (campana, po, tipo_estacion)
  left join ini using (campana))"""

PAIRED = EVENTS + f""",
paired0 as (select box_id, estacion, campana, id_campana,
    min(case when "type" = 'box_open' then "time" end) init_scan, max(case when "type" = 'box_close' then "time" end) last_scan,
    count(scan) picks from evs group by 1,2,3,4 having init_scan is not null and last_scan is not null),
paired as (select *, case when lower(trim(estacion)) in ('estacion e1','estacion e2','estacion e3','estacion e4','estacion e5','estacion e6')
    and init_scan >= timestamp '2024-01-15' then 'Naranja' else {station('estacion')} end tipo_estacion from paired0)"""
SCANS = EVENTS + """,
sc as (select * from evs where "type" in ('scan','pick_ok')),
chg as (select *, lag("row") over b pr, lag(event_id) over b pe from sc window b as (partition by campana, box_id order by consecutivo, event_id)),
dif as (select campana, box_id, count(distinct sku) n_skus_en_caja, count(distinct categoria) n_categorias_en_caja,
    cast(sum(case when pe is not null and ("row" <> pr or "row" is null or pr is null) then 1 else 0 end) as bigint) cambios_de_row,
    count(distinct "row") n_filas_distintas from chg group by 1,2)"""
BOX_PACE = SCANS + f""",
bx as (select box_id, arg_min(campana, ("time", event_id)) campana, min(case when "type" = 'box_open' then "time" end) t_open,
    max(case when "type" = 'box_close' then "time" end) t_close, count(*) filter (where "type" in ('scan','pick_ok')) n_picks
  from evs group by 1 having t_open is not null and t_close is not null),
pace as (select campana, box_id, {secs('t_open', 't_close')} seg_caja, n_picks,
    case when n_picks > 0 and {secs('t_open', 't_close')} > 0 then {secs('t_open', 't_close')} / n_picks end tiempo_por_pick from bx)"""
SHARES = EVENTS + """,
cnt as (select campana, sku, count(*) n from evs where "type" in ('scan','pick_ok') and sku is not null group by 1,2),
tot as (select campana, sum(n) t from cnt group by 1),
mix as (select campana, case when count(*) = 1 then 0 else -sum((n / t) * log2(n / t)) end entropia_sku, sum((n / t) * (n / t)) hhi_sku
  from cnt join tot using (campana) group by 1)"""

DURATION_ENDS = {
    "duracion_carga_arte": ("min_fecha_arte", "max_fecha_arte"),
    "duracion_carga_preproyectos": ("min_fecha_preproyecto", "max_fecha_preproyecto"),
    "duracion_aprobacion": ("min_fecha_aprobacion", "max_fecha_aprobacion"),
    "duracion_etapa_uno": ("min_fecha_arte", "max_fecha_arte"),
    "duracion_etapa_dos": ("max_fecha_arte", "max_fecha_preproyecto"),
    "duracion_etapa_tres": ("max_fecha_preproyecto", "max_fecha_aprobacion"),
}
NAMES = list(DURATION_ENDS)


def parsed(column: str) -> str:
    return f"try_cast(case when {column} not in ('', 'NaT', 'null') then {column} end as timestamp)"


def shares(prefix: str) -> str:
    parts = []
    for group, total in ((NAMES[:3], "total_tiempo_invertido"), (NAMES[3:], "total_tiempo_campaña")):
        parts += [
            f'case when "{total}" <> 0 then {prefix}{n} / "{total}" * 100 end as porcentaje_{prefix}{n}' for n in group
        ]
    return ", ".join(parts)


CLEANED = STRATEGIES + f""",
cl as (select try_cast("Folio" as bigint) "Folio", "Cliente", "Año", "Campaña", {parsed('fecha_arte')} fecha_arte,
    {parsed('fecha_preproyecto')} fecha_preproyecto,
    greatest({parsed('fecha_aprobado_arte')}, {parsed('"fecha_aprobado_ODT"')}) fecha_aprobacion from st)"""
CAMPAIGNS = CLEANED + f""",
c0 as (select "Cliente", "Año", "Campaña", count(*) total_estrategias, min(fecha_arte) min_fecha_arte, max(fecha_arte) max_fecha_arte,
    min(fecha_preproyecto) min_fecha_preproyecto, max(fecha_preproyecto) max_fecha_preproyecto,
    min(fecha_aprobacion) min_fecha_aprobacion, max(fecha_aprobacion) max_fecha_aprobacion from cl group by 1,2,3),
c1 as (select *, {', '.join(f'{secs(*e)} as {n}_td, {work_hours(*e)} as {n}' for n, e in DURATION_ENDS.items())} from c0),
c2 as (select *, {' + '.join(NAMES[:3])} as total_tiempo_invertido, {' + '.join(NAMES[3:])} as "total_tiempo_campaña" from c1),
camp as (select *, {shares('')} from c2)"""
CLIENTS = CAMPAIGNS + f""",
k0 as (select "Cliente", cast(sum(total_estrategias) as bigint) total_estrategias, count(*) total_campanas,
    {', '.join(f'avg({n}) as promedio_{n}' for n in NAMES)} from camp group by 1),
k1 as (select *, {' + '.join('promedio_' + n for n in NAMES[:3])} as total_tiempo_invertido,
    {' + '.join('promedio_' + n for n in NAMES[3:])} as "total_tiempo_campaña" from k0),
cli as (select *, {shares('promedio_')} from k1)"""
CLASSES = CAMPAIGNS + ", " + CLASSIFICATION_SQL
NESTED = """with raw as (select *, cast(json_extract_string(props, '$.k') as int) k from events),
nes as (select event_id as id, value as valor,
    case when event_id % 11 <> 0 then user_id end user_id, case when event_id % 11 <> 0 then user_id % 7 end zona_id,
    case when event_id % 11 <> 0 then event_type end tipo,
    case when event_id % 3 = 0 then [] when event_id % 5 = 0 then null
      else [{'nombre': 'k', 'peso': k}, {'nombre': 'u', 'peso': cast(user_id % 9 as int)}] end tags from raw)"""


def ridge_leave_one_out(rows: str, order: str, nums: list[str], cats: list[str], target: str, alpha: float = 1.0) -> str:
    """CTEs up to ``pred`` (``i`` and ``y_pred`` beside the columns of ``rows``): the ridge model of each row is refitted from
    the sums over all other rows, with their encodings in that fold, and its system solved by elimination."""
    d, size = len(nums), len(nums) + len(cats)
    f = [f"f{p}" for p in range(size)]
    weight = lambda n: f"(1 / (1 + exp(-(({n}) - 20) / 10e0)))"
    centred = ", ".join([f"{target} - avg({target}) over () y", f"avg({target}) over () y_mean", *[f"{c} - avg({c}) over () x{j}" for j, c in enumerate(nums)]])
    counts = ", ".join(f"count(*) over (partition by {c}) n{k}, sum(y) over (partition by {c}) s{k}" for k, c in enumerate(cats))
    same = lambda k, v: f"case when a.{cats[k]} = b.{cats[k]} then {v} else 0 end"
    encoded = []
    for k in range(len(cats)):
        n, s = f"(b.n{k} - {same(k, 1)})", f"(b.s{k} - {same(k, 'a.y')})"
        encoded.append(f"{weight(n)} * {s} / {n} + (1 - {weight(n)}) * (a.sy - a.y) / (a.n - 1) as f{d + k}")
    own = [f"x{j}" for j in range(d)] + [
        f"case when n{k} > 1 then {weight(f'n{k} - 1')} * (s{k} - y) / (n{k} - 1) + (1 - {weight(f'n{k} - 1')}) * (sy - y) / (n - 1) else (sy - y) / (n - 1) end"
        for k in range(len(cats))
    ]
    upper = [(p, q) for p in range(size) for q in range(p, size)]
    sums = ", ".join([f"sum({x}) s_{x}" for x in f] + [f"sum({x} * y) y_{x}" for x in f] + [f"sum(f{p} * f{q}) g{p}{q}" for p, q in upper])
    scale = ", ".join(f"case when {p} < {d} and sqrt(greatest(g{p}{p} - s_f{p} * s_f{p} / m, 0) / m) > 1e-12 then 1 / sqrt((g{p}{p} - s_f{p} * s_f{p} / m) / m) else 1 end c{p}" for p in range(size))
    start = ", ".join(
        [f"(g{min(p, q)}{max(p, q)} - s_f{p} * s_f{q} / m) * c{p} * c{q}{f' + {alpha}' if p == q else ''} a{p}{q}" for p in range(size) for q in range(size)]
        + [f"(y_f{p} - s_f{p} * s_y / m) * c{p} b{p}" for p in range(size)]
    )
    stages, last = [f"e0 as (select *, {start} from scaled)"], "e0"
    for p in range(size - 1):
        new = ", ".join(
            [f"a{q}{r_} - a{q}{p} / a{p}{p} * a{p}{r_} as a{q}{r_}" for q in range(p + 1, size) for r_ in range(p, size)] + [f"b{q} - a{q}{p} / a{p}{p} * b{p} as b{q}" for q in range(p + 1, size)]
        )
        stages.append(f"e{p + 1} as (select * replace ({new}) from {last})")
        last = f"e{p + 1}"
    for p in reversed(range(size)):
        rest = "".join(f" - a{p}{q} * w{q}" for q in range(p + 1, size))
        stages.append(f"v{p} as (select *, (b{p}{rest}) / a{p}{p} w{p} from {last})")
        last = f"v{p}"
    predicted = " + ".join(f"w{p} * c{p} * ({own[p]} - s_f{p} / m)" for p in range(size))
    return f"""z0 as (select *, row_number() over (order by {order}) i, {centred} from {rows}),
  z as (select *, {counts}, count(*) over () n, sum(y) over () sy from z0),
  pairs as (select a.i, b.y, {', '.join(f'b.x{j} as f{j}' for j in range(d))}, {', '.join(encoded)} from z a join z b on a.i <> b.i),
  moments as (select i, count(*) m, sum(y) s_y, {sums} from pairs group by 1),
  scaled as (select *, {scale} from moments join z using (i)),
  {', '.join(stages)},
  pred as (select *, s_y / m + {predicted} + y_mean y_pred from {last})"""
