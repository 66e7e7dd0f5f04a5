"""Checked queries: picking times, dead time, difficulty (C6-C12, F*, A2-A18, A24, A27, W*, X6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmetrics.functions.labels import client_from_campaign, station_type
from flowmetrics.operators import deadtime, difficulty, order_stats, picking, stats
from flowmetrics.plans.picking_times import clean_operations, station_scores, station_transitions
from flowmetrics.schemas import LINE_STATIONS, station_dimension
from flowmetrics.session import settle
from suite import adapters as A
from suite import sql as S
from suite.registry import query
from suite.sql import r, ts

CUTOFF = "2024-01-15"


def base(spark, d):
    return picking.base_operations(A.ops(spark, d))


def clean(spark, d):
    return clean_operations(A.ops(spark, d))


# ------------------------------------------------------------------ columns

@query("c6_base_operations", S.BASE + f""" select box_id, campana, {ts('init_scan','init_scan')}, "año",
  {r('tiempo_total_seg','tiempo_total_seg')}, {r('tiempo_total_min','tiempo_total_min')} from base""")
def _(spark, d):
    return base(spark, d).select("box_id", "campana", "init_scan", "año", "tiempo_total_seg", "tiempo_total_min")


@query("c7_base_operations_campaign_year", S.OPS + """, named as (
  select cliente || ' JUL' || (20 + cast(box_id as bigint) % 10) campana from ops)
  select campana, cast(case when contains(campana, '26') then 2026 when contains(campana, '25') then 2025 end as int) "año",
    count(*) n from named group by 1, 2""")
def _(spark, d):
    named = F.concat("cliente", F.lit(" JUL"), (20 + F.col("box_id").cast("long") % 10).cast("string"))
    ops = A.ops(spark, d).withColumn("campana", named)
    return picking.base_operations(ops, year_from="campaign").groupBy("campana", "año").agg(F.count("*").alias("n"))


def _numbered(spark, d):
    n = F.col("event_id") % 60 - 7
    name = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), F.upper("estacion"), F.lit(" ")))
        .when(F.col("event_id") % 5 == 0, F.concat(F.lit("estacion "), n.cast("string")))
        .when(F.col("event_id") % 3 == 0, F.element_at(
            F.array(*[F.lit(x) for x in ("Azul", "VERDE", " rojo", "amarillo ", "calidad", "Precalidad", "pre calidad")]),
            (F.col("event_id") % 7).cast("int") + 1))
        .otherwise(F.concat(F.lit("Estacion "), n.cast("string")))
    )
    return A.events(spark, d).withColumn("estacion", name)


NUMBERED = S.EVENTS + """, num as (select case when event_id % 7 = 0 then ' ' || upper(estacion) || ' '
    when event_id % 5 = 0 then 'estacion ' || (event_id % 60 - 7)
    when event_id % 3 = 0 then ['Azul','VERDE',' rojo','amarillo ','calidad','Precalidad','pre calidad'][event_id % 7 + 1]
    else 'Estacion ' || (event_id % 60 - 7) end estacion from evs)"""


@query("c8_station_type", NUMBERED + f" select estacion, {S.station('estacion')} tipo_estacion, count(*) n from num group by 1, 2")
def _(spark, d):
    rows = _numbered(spark, d).withColumn("tipo_estacion", station_type(F.col("estacion")))
    return rows.groupBy("estacion", "tipo_estacion").agg(F.count("*").alias("n"))


@query("c9_extra_station_override", S.PAIRED + f" select box_id, estacion, campana, {ts('init_scan','init_scan')}, tipo_estacion from paired")
def _(spark, d):
    return picking.pair_operations(A.events(spark, d), CUTOFF).select(
        "box_id", "estacion", "campana", "init_scan", "tipo_estacion"
    )


@query("c10_client_from_campaign", S.OPS + """ select campana, nullif(regexp_extract(campana, '^(\\w+)', 1), '') cliente,
  count(*) n from ops group by 1, 2""")
def _(spark, d):
    ops = A.ops(spark, d).select("campana")
    return ops.groupBy("campana").agg(F.count("*").alias("n")).withColumn("cliente", client_from_campaign(F.col("campana")))


@query("c11_client_map", S.EVENTS + """ select campana, min('C' || (cast(box_id as bigint) % 6)) cliente,
  count(distinct 'C' || (cast(box_id as bigint) % 6)) clientes_distintos from evs group by 1""")
def _(spark, d):
    client = F.concat(F.lit("C"), (F.col("box_id").cast("long") % 6).cast("string"))
    return picking.client_map(A.events(spark, d).withColumn("cliente_db", client))


@query("c12_station_dimension", S.OPS + f""" select tipo_estacion, tipo_estacion in {S.LINES} es_linea, {S.ORDER}[tipo_estacion] orden,
  case when tipo_estacion in ('Azul','Rojo') then '5x3' when tipo_estacion in ('Amarillo','Verde') then '9x3'
    when tipo_estacion = 'Naranja' then 'Not defined' else '1x1' end configuracion_estacion,
  case tipo_estacion when 'Pre-Calidad' then 'pct_pc' else 'pct_' || lower(tipo_estacion) end columna_pct,
  count(*) n, cast(sum(picks) as bigint) picks from ops group by 1""")
def _(spark, d):
    sums = A.ops(spark, d).groupBy("tipo_estacion").agg(F.count("*").alias("n"), F.sum("picks").alias("picks"))
    return sums.join(F.broadcast(station_dimension(spark)), "tipo_estacion")


# ------------------------------------------------------------------ filters

@query("f1_exclude_campaigns", S.OPS + " select box_id, campana, tipo_estacion, picks from ops where right(campana, 2) <> '03'")
def _(spark, d):
    ops = A.ops(spark, d)
    excluded = ops.where(F.col("campana").endswith("03")).select("campana")
    return picking.exclude_campaigns(ops, excluded).select("box_id", "campana", "tipo_estacion", "picks")


@query("f2_iqr_filter", S.CLEAN + f" select box_id, campana, tipo_estacion, picks, {r('tiempo_total_seg','tiempo_total_seg')} from clean")
def _(spark, d):
    return stats.iqr_filter(picking.positive_picks(base(spark, d))).select(
        "box_id", "campana", "tipo_estacion", "picks", "tiempo_total_seg"
    )


@query("f3_complete_operations", S.PAIRED + " select box_id, estacion, campana, cast(picks as bigint) picks from paired")
def _(spark, d):
    paired = picking.pair_operations(A.events(spark, d), CUTOFF)
    return paired.select("box_id", "estacion", "campana", F.col("picks").cast("long").alias("picks"))


@query("f4_scan_events", S.EVENTS + """ select event_id, campana, "type" from evs where "type" in ('scan','pick_ok')""")
def _(spark, d):
    return picking.scan_events(A.events(spark, d)).select("event_id", "campana", "type")


@query("f5_station_subset", NUMBERED + f" select estacion, count(*) n from num where {S.station('estacion')} in {S.LINES} group by 1")
def _(spark, d):
    return picking.station_subset(_numbered(spark, d), LINE_STATIONS).groupBy("estacion").agg(F.count("*").alias("n"))


@query("f6_line_stations_only", S.OPS + f" select box_id, campana, tipo_estacion, picks from ops where tipo_estacion in {S.LINES}")
def _(spark, d):
    return picking.line_stations_only(A.ops(spark, d)).select("box_id", "campana", "tipo_estacion", "picks")


@query("f7_bounded_metric", S.CLEAN + f" select box_id, campana, {r('tiempo_por_pick','tiempo_por_pick')} from clean where tiempo_por_pick between 0 and 150")
def _(spark, d):
    return stats.bounded_metric(clean(spark, d), "tiempo_por_pick", 150).select("box_id", "campana", "tiempo_por_pick")


@query("f8_complete_cases", S.OPS + """ select box_id, campana, tipo_estacion, picks from ops
  where nullif(picks, 0) is not null and nullif(cliente, 'BUILDING') is not null""")
def _(spark, d):
    ops = A.ops(spark, d).withColumns({
        "picks": F.nullif(F.col("picks"), F.lit(0)), "cliente": F.nullif(F.col("cliente"), F.lit("BUILDING"))
    })
    return stats.complete_cases(ops, ["picks", "cliente"]).select("box_id", "campana", "tipo_estacion", "picks")


@query("f9_positive_picks", S.OPS + " select box_id, campana, tipo_estacion, picks from ops where picks > 0")
def _(spark, d):
    return picking.positive_picks(A.ops(spark, d)).select("box_id", "campana", "tipo_estacion", "picks")


# ------------------------------------------------------------------ operations and campaigns

@query("a2_iqr_bounds", S.BASE + f""" select tipo_estacion, {r('q1 - 1.5e0 * (q3 - q1)','limite_inferior')}, {r('q3 + 1.5e0 * (q3 - q1)','limite_superior')}
  from (select tipo_estacion, quantile_cont(tiempo_total_seg, 0.25) q1, quantile_cont(tiempo_total_seg, 0.75) q3 from base group by 1)""")
def _(spark, d):
    return stats.iqr_bounds(base(spark, d), "tiempo_total_seg", ["tipo_estacion"])


@query("a3_build_operations", S.PAIRED + f""" select box_id, campana, id_campana, tipo_estacion, {ts('init_scan','init_scan')},
  {ts('last_scan','last_scan')}, picks, regexp_extract(campana, '^(\\w+)', 1) cliente from paired""")
def _(spark, d):
    return picking.build_operations(A.events(spark, d), CUTOFF)


@query("a3_build_operations_recorded_client", S.PAIRED + """,
  m as (select campana, min('C' || (cast(box_id as bigint) % 6)) cliente from evs group by 1)
  select box_id, campana, tipo_estacion, picks, cliente from paired left join m using (campana)""")
def _(spark, d):
    client = F.concat(F.lit("C"), (F.col("box_id").cast("long") % 6).cast("string"))
    ops = picking.build_operations(A.events(spark, d).withColumn("cliente_db", client), CUTOFF)
    return ops.select("box_id", "campana", "tipo_estacion", "picks", "cliente")


@query("a4_unmapped_stations", S.PAIRED + " select estacion, count(*) operaciones from paired where tipo_estacion = 'Otro' group by 1")
def _(spark, d):
    return picking.unmapped_stations(picking.pair_operations(A.events(spark, d), CUTOFF))


@query("a5_efficiency_metrics", S.CLEAN + f""" select box_id, campana, cliente, {r('tiempo_por_pick','tiempo_por_pick')},
  {r('picks_por_min','picks_por_min')} from clean""")
def _(spark, d):
    rows = clean(spark, d).drop("cliente", "tiempo_por_pick", "picks_por_min")
    return picking.efficiency_metrics(rows).select("box_id", "campana", "cliente", "tiempo_por_pick", "picks_por_min")


def _working_days(a, b):
    before = lambda x: f"(({x} - date '1970-01-05') // 7 * 5 + least(({x} - date '1970-01-05') % 7, 5))"
    return f"greatest(1, {before(b)} - {before(a)})"


@query("a6_campaign_summary", S.CLEAN + f""",
  s as (select campana, min(init_scan) inicio, max(last_scan) fin, cast(sum(picks) as bigint) picks_total, median(picks) pm, max(picks) picks_max_op,
    count(picks) ops_total, arg_min(cliente, (init_scan, box_id, tipo_estacion)) cliente, arg_min("año", (init_scan, box_id, tipo_estacion)) "año",
    cast(month(min(init_scan)) as int) mes_inicio, median(hour(init_scan)) hm,
    avg(case when tipo_estacion = 'Morado' then 1 else 0 end) p1, avg(case when tipo_estacion = 'Calidad' then 1 else 0 end) p2,
    avg(case when tipo_estacion = 'Pre-Calidad' then 1 else 0 end) p3, median(picks_por_min) pp, stddev_samp(picks_por_min) ps,
    sum(tiempo_total_seg) / 3600 th from clean group by 1)
  select campana, {ts('inicio','inicio')}, {ts('fin','fin')}, picks_total, {r('pm','picks_por_op_mediana')}, picks_max_op, ops_total, cliente, "año",
    mes_inicio, {r('hm','hora_inicio_mediana')}, {r('p1','pct_estacion_morado')}, {r('p2','pct_estacion_calidad')}, {r('p3','pct_estacion_pc')},
    {r('pp','picks_por_min_mediana')}, {r('ps','picks_por_min_std')}, {r('th','tiempo_total_horas')},
    cast({_working_days('cast(inicio as date)', 'cast(fin as date)')} as bigint) dias_habiles from s""")
def _(spark, d):
    return picking.campaign_summary(clean(spark, d))


@query("a7_campaign_station_median", S.MEDIANS + f""" select campana, tipo_estacion, cliente, "año", {r('mediana_tpp','mediana_tpp')} from med""")
def _(spark, d):
    return picking.campaign_station_median(clean(spark, d))


@query("a8_weighted_median", S.CLEAN + f""",
  c as (select campana, tiempo_por_pick v, sum(picks) over (partition by campana order by tiempo_por_pick range unbounded preceding) s,
    sum(picks) over (partition by campana) t from clean)
  select campana, {r('min(v)','mediana_ponderada')} from c where s * 2 >= t group by 1""")
def _(spark, d):
    return order_stats.weighted_median(clean(spark, d), ["campana"], "tiempo_por_pick", "picks", "mediana_ponderada")


@query("a24_efficiency_summary", S.CLEAN + f""",
  l as (unpivot (select tipo_estacion, tiempo_por_pick, tiempo_total_seg, cast(picks as double) picks, picks_por_min from clean)
    on tiempo_por_pick, tiempo_total_seg, picks, picks_por_min into name metrica value v),
  s as (select tipo_estacion, metrica, avg(v) media, median(v) mediana, stddev_samp(v) sd, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3,
    quantile_cont(v, 0.90) p90, quantile_cont(v, 0.95) p95, count(v) n from l group by 1, 2)
  select tipo_estacion, metrica, {r('media','media')}, {r('mediana','mediana')}, {r('sd','std')}, {r('sd / media * 100','cv')}, {r('q1','q1')}, {r('q3','q3')},
    {r('q3 - q1','iqr')}, {r('p90','p90')}, {r('p95','p95')}, n, case when media > mediana * 1.15e0 then 'asimetrico' else 'simetrico' end sesgo,
    case when sd / media * 100 > 70 then 'alta' when sd / media * 100 > 40 then 'moderada' else 'baja' end variabilidad from s""")
def _(spark, d):
    rows = clean_operations(settle(A.ops(spark, d))).select("tipo_estacion", *stats.EFFICIENCY_METRICS)
    return stats.efficiency_summary(settle(rows), ["tipo_estacion"])


@query("a24_efficiency_text", S.CLEAN + """, s as (select avg(tiempo_por_pick) media, median(tiempo_por_pick) mediana, stddev_samp(tiempo_por_pick) sd,
    quantile_cont(tiempo_por_pick, 0.25) q1, quantile_cont(tiempo_por_pick, 0.75) q3, quantile_cont(tiempo_por_pick, 0.90) p90,
    quantile_cont(tiempo_por_pick, 0.95) p95, count(*) n from clean)
  select 'tiempo_por_pick' metrica, printf('tiempo_por_pick: n=%d, mediana %.1f, media %.1f (%s), IQR %.1f a %.1f, p90 %.1f, p95 %.1f, CV %.0f%% (variabilidad %s)',
    n, mediana, media, case when media > mediana * 1.15e0 then 'asimetrico' else 'simetrico' end, q1, q3, p90, p95, sd / media * 100,
    case when sd / media * 100 > 70 then 'alta' when sd / media * 100 > 40 then 'moderada' else 'baja' end) texto from s""")
def _(spark, d):
    rows = clean_operations(settle(A.ops(spark, d))).select("tiempo_por_pick")
    return stats.efficiency_text(stats.efficiency_summary(settle(rows), metrics=["tiempo_por_pick"]))


PCTS = {"pct_azul": "Azul", "pct_rojo": "Rojo", "pct_verde": "Verde", "pct_amarillo": "Amarillo", "pct_morado": "Morado",
        "pct_calidad": "Calidad", "pct_pc": "Pre-Calidad", "pct_naranja": "Naranja"}


@query("a27_station_shares", S.OPS + " select campana, " + ", ".join(
    r(f"avg(case when tipo_estacion = '{v}' then 1 else 0 end)", k) for k, v in PCTS.items()) + " from ops group by 1")
def _(spark, d):
    return picking.station_shares(A.ops(spark, d))


# ------------------------------------------------------------------ dead time

@query("w1_dead_time", S.GAPS + f""" select box_id, campana, tipo_estacion, {ts('init_scan','init_scan')}, po tipo_estacion_origen,
  {r('muerto','tiempo_muerto_seg')} from gaps""")
def _(spark, d):
    return deadtime.dead_time(base(spark, d))[0].select(
        "box_id", "campana", "tipo_estacion", "init_scan", "tipo_estacion_origen", "tiempo_muerto_seg"
    )


@query("s5_transition_outliers", S.GAPS + f""" select campana, box_id, po tipo_estacion_origen, tipo_estacion, {r('gap','gap_seg')}, motivo
  from gaps where motivo is not null""")
def _(spark, d):
    return deadtime.dead_time(base(spark, d))[1]


A9 = S.TRANSITIONS + f""" select campana, cliente, "año", po tipo_estacion_origen, tipo_estacion, {r('med','mediana_tiempo_muerto_seg')},
  {r('prom','promedio_tiempo_muerto_seg')}, n n_transiciones_validas, n_total n_transiciones_total, {ts('fecha_inicio','fecha_inicio')} from trans"""


@query("a9_transition_summary", A9)
def _(spark, d):
    return station_transitions(base(spark, d))[1]


@query("a9_transition_summary_two_tables", A9)
def _(spark, d):
    return deadtime.transition_summary(*deadtime.dead_time(base(spark, d)))


@query("w2_dead_time_delta", S.TRANSITIONS + f""",
  p as (select *, lag(campana) over k ca, lag(med) over k m0, lag(prom) over k p0, lag(n) over k n0 from trans
    window k as (partition by cliente, po, tipo_estacion order by fecha_inicio, campana, "año"))
  select campana, "año", po tipo_estacion_origen, tipo_estacion, ca campana_anterior, {r('m0','mediana_tiempo_muerto_seg_anterior')},
    {r('med - m0','delta_tiempo_muerto_seg')}, {r('case when m0 <> 0 then (med - m0) / m0 * 100 end','delta_tiempo_muerto_pct')},
    {r('p0','promedio_tiempo_muerto_seg_anterior')}, n0 n_transiciones_validas_anterior, {r('med / 60','mediana_tiempo_muerto_min')},
    {r('m0 / 60','mediana_tiempo_muerto_min_anterior')}, {r('prom / 60','promedio_tiempo_muerto_min')},
    {r('p0 / 60','promedio_tiempo_muerto_min_anterior')}, {r('(med - m0) / 60','delta_tiempo_muerto_min')} from p""")
def _(spark, d):
    return deadtime.dead_time_delta(station_transitions(base(spark, d))[1]).drop(
        "cliente", "fecha_inicio", "mediana_tiempo_muerto_seg", "promedio_tiempo_muerto_seg", "n_transiciones_validas", "n_transiciones_total"
    )


@query("a10_dead_time_by_destination", S.TRANSITIONS + f""" select campana, cliente, "año", {ts('fecha_inicio','fecha_inicio')}, tipo_estacion,
    cast(sum(n) as bigint) n_transiciones_validas, cast(sum(n_total) as bigint) n_transiciones_total,
    {r('coalesce(sum(med * n), 0) / greatest(sum(n), 1)','mediana_tiempo_muerto_seg')},
    {r('coalesce(sum(prom * n), 0) / greatest(sum(n), 1)','promedio_tiempo_muerto_seg')} from trans group by campana, cliente, "año", trans.fecha_inicio, tipo_estacion""")
def _(spark, d):
    return deadtime.dead_time_by_destination(station_transitions(base(spark, d))[1])


# ------------------------------------------------------------------ scores

@query("w4_contextual_zscore", S.SCORES + f""" select campana, tipo_estacion, cliente, "año", {r('mediana_tpp','mediana_tpp')}, {r('z_score','z_score')},
  {S.zcat('z_score')} categoria, cast(list_position(['critico','mejorable','normal','bueno','excelente','sin_referencia'], {S.zcat('z_score')}) - 1 as int) categoria_orden
  from scores""")
def _(spark, d):
    return station_scores(clean(spark, d))


@query("x6_zscore_category", S.SCORES + f" select {S.zcat('z_score')} categoria, tipo_estacion, count(*) n from scores group by 1, 2")
def _(spark, d):
    return station_scores(clean(spark, d)).groupBy("categoria", "tipo_estacion").agg(F.count("*").alias("n"))


@query("w5_residual_zscore", S.MEDIANS + f""",
  g as (select cliente, count(mediana_tpp) n, median(mediana_tpp) mu, stddev_samp(mediana_tpp) sd from med group by 1)
  select campana, tipo_estacion, {r('case when n >= 2 and sd <> 0 then (mediana_tpp - mu) / sd end','z_residuo')} from med join g using (cliente)""")
def _(spark, d):
    medians = settle(picking.campaign_station_median(clean(spark, d)))
    return stats.residual_zscore(medians, ["cliente"], "mediana_tpp", "z_residuo").select("campana", "tipo_estacion", "z_residuo")


@query("w6_rank_quartile", S.OPS + """,
  p as (select campana, tipo_estacion, median(picks) v from ops group by 1, 2),
  q as (select *, row_number() over (order by v, md5(concat_ws(chr(1), campana, tipo_estacion))) k, count(*) over () n from p)
  select campana, tipo_estacion, 'Q' || cast(greatest(1, ceil((k - 1) * 4 / (n - 1))) as bigint) cuartil from q""")
def _(spark, d):
    medians = picking.campaign_station_median(A.ops(spark, d), ["campana", "tipo_estacion"], "picks")
    return stats.rank_quartile(medians, "mediana_tpp", ["campana", "tipo_estacion"]).select("campana", "tipo_estacion", "cuartil")


@query("w7_group_broadcast", S.BASE + f""", m as (select tipo_estacion, avg(tiempo_total_seg) media, count(*) n from base group by 1)
  select box_id, campana, tipo_estacion, {r('tiempo_total_seg - media','desvio')}, n from base join m using (tipo_estacion)""")
def _(spark, d):
    ops = base(spark, d)
    group = ops.groupBy("tipo_estacion").agg(F.avg("tiempo_total_seg").alias("media"), F.count("*").alias("n"))
    joined = stats.attach_group(ops, group, ["tipo_estacion"])
    return joined.select("box_id", "campana", "tipo_estacion", (F.col("tiempo_total_seg") - F.col("media")).alias("desvio"), "n")


@query("w8_average_rank", S.BASE + f""" select box_id, campana, tipo_estacion,
  {r("rank() over (partition by tipo_estacion order by tiempo_total_seg) + (count(*) over (partition by tipo_estacion, tiempo_total_seg) - 1) / 2.0e0", "rango")} from base""")
def _(spark, d):
    rows = base(spark, d).select("box_id", "campana", "tipo_estacion", "tiempo_total_seg")
    return order_stats.average_rank(rows, ["tipo_estacion"], {"tiempo_total_seg": "rango"}).drop("tiempo_total_seg")


# ------------------------------------------------------------------ difficulty

@query("w3_row_changes", S.SCANS + " select campana, box_id, cambios_de_row from dif")
def _(spark, d):
    scans = picking.scan_events(A.events(spark, d))
    return difficulty.row_changes(scans).groupBy("campana", "box_id").agg(F.sum("_change").alias("cambios_de_row"))


@query("a11_box_difficulty", S.SCANS + " select campana, box_id, n_skus_en_caja, n_categorias_en_caja, cambios_de_row, n_filas_distintas from dif")
def _(spark, d):
    return difficulty.box_difficulty(A.events(spark, d))


@query("a12_sku_entropy", S.SHARES + f" select campana, {r('entropia_sku','entropia_sku')} from mix")
def _(spark, d):
    scans = picking.scan_events(A.events(spark, d))
    return difficulty.concentration(scans, ["campana"], "sku", "entropia_sku", "hhi_sku").select("campana", "entropia_sku")


@query("a13_sku_hhi", S.SHARES + f" select campana, {r('hhi_sku','hhi_sku', 6)} from mix", digits=6)
def _(spark, d):
    scans = picking.scan_events(A.events(spark, d))
    return difficulty.concentration(scans, ["campana"], "sku", "entropia_sku", "hhi_sku").select("campana", "hhi_sku")


@query("a14_campaign_complexity", S.SHARES + f""",
  pb as (select campana, median(c) med from (select campana, box_id, count(distinct sku) c from evs where "type" in ('scan','pick_ok') group by 1, 2) group by 1),
  ds as (select campana, count(distinct sku) a, count(distinct material) b, count(distinct categoria) c from evs where "type" in ('scan','pick_ok') group by 1)
  select campana, a n_skus_distintos, b n_materiales_distintos, c n_categorias_distintas, {r('entropia_sku','entropia_sku')}, {r('hhi_sku','hhi_sku')},
    {r('med','skus_por_caja_mediana')} from ds left join mix using (campana) left join pb using (campana)""")
def _(spark, d):
    return difficulty.campaign_complexity(A.events(spark, d))


EVENT_MAP = f"(select distinct box_id, {S.station('estacion')} tipo_estacion from evs)"


def _event_map(spark, d):
    return A.events(spark, d).select("box_id", station_type(F.col("estacion")).alias("tipo_estacion"))


@query("a15_station_features", S.SCANS + f""" select campana, tipo_estacion, {r('median(n_categorias_en_caja)','n_categorias_mediana')},
  {r('median(n_filas_distintas)','n_filas_mediana')} from dif join {EVENT_MAP} m using (box_id) where tipo_estacion in {S.LINES} group by 1, 2""")
def _(spark, d):
    return difficulty.station_features(difficulty.box_difficulty(A.events(spark, d)), _event_map(spark, d))


@query("a16_genuine_time_per_pick", S.CLEAN + f""",
  cp as (select box_id, min(case when tipo_estacion = 'Calidad' then init_scan end) t_cal, min(case when tipo_estacion = 'Pre-Calidad' then init_scan end) t_pc from base group by 1),
  ln as (select box_id, init_scan, picks, t_cal, t_pc from base left join cp using (box_id) where tipo_estacion in {S.LINES}),
  dn as (select box_id, 'Pre-Calidad' tipo_estacion, sum(picks) u from ln where init_scan < t_pc group by 1
    union all select box_id, 'Calidad', sum(picks) from ln where init_scan > coalesce(t_pc, timestamp '1970-01-01') and init_scan < t_cal group by 1)
  select campana, box_id, tipo_estacion, {r('tiempo_total_seg / nullif(u, 0)','tpp_genuino')}, cast(nullif(u, 0) as bigint) denom_tramo
  from clean left join dn using (box_id, tipo_estacion) where tipo_estacion in ('Calidad','Pre-Calidad')""")
def _(spark, d):
    return difficulty.genuine_time_per_pick(base(spark, d), clean(spark, d))


@query("a17_box_time_per_pick", S.BOX_PACE + f" select campana, box_id, {r('tiempo_por_pick','tiempo_por_pick',6)}, {r('seg_caja','seg_caja',6)}, n_picks from pace", digits=6)
def _(spark, d):
    return difficulty.box_time_per_pick(A.events(spark, d))


def _correlation(spark, d):
    events = A.events(spark, d)
    events = events.withColumn("cliente_db", F.substring_index("campana", " ", 1))
    return difficulty.difficulty_correlation(difficulty.box_difficulty(events), events, tpp_max=600_000.0)


RANKS = S.BOX_PACE + """,
  j as (select dif.*, tiempo_por_pick t, split_part(dif.campana, ' ', 1) cliente from dif join pace using (box_id) where tiempo_por_pick between 0 and 600000),
  l as (select 'global' "scope", * from j union all select cliente, * from j),
  u as (unpivot (select "scope", t, cast(n_skus_en_caja as double) n_skus_en_caja, cast(n_categorias_en_caja as double) n_categorias_en_caja,
      cast(cambios_de_row as double) cambios_de_row, cast(n_filas_distintas as double) n_filas_distintas from l)
    on n_skus_en_caja, n_categorias_en_caja, cambios_de_row, n_filas_distintas into name feature value v),
  k as (select "scope", feature, rank() over (partition by "scope", feature order by v) + (count(*) over (partition by "scope", feature, v) - 1) / 2.0e0 a,
    rank() over (partition by "scope", feature order by t) + (count(*) over (partition by "scope", feature, t) - 1) / 2.0e0 b from u)"""


@query("a18_difficulty_correlation", RANKS + """
  select feature, "scope", round_even(corr(a, b), 3) + 0.0e0 r, count(*) n from k group by 1, 2 having count(*) >= 10""")
def _(spark, d):
    return _correlation(spark, d).select("feature", "scope", "r", "n")


# the p value by Simpson's rule over the density of Student's t, with t / sqrt(n - 2) = tan(angle)
@query("x7_significance_stars", RANKS + """,
  c as (select feature, "scope", corr(a, b) r0, count(*) n from k group by 1, 2 having count(*) >= 10),
  g as (select *, n - 2 nu, asin(abs(r0)) lo, (pi() / 2 - asin(abs(r0))) / 4000 h, unnest(range(0, 4001)) i from c),
  w as (select feature, "scope", r0, n, 2 * exp(lgamma((nu + 1) / 2.0e0) - lgamma(nu / 2.0e0)) / sqrt(pi()) * h / 3
      * sum((case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(greatest(cos(lo + i * h), 0), nu - 1)) p from g group by feature, "scope", r0, n, nu, h)
  select feature, "scope", round_even(r0, 3) + 0.0e0 r, round_even(p, 4) + 0.0e0 p_value, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end sig, n from w""")
def _(spark, d):
    return _correlation(spark, d)


# ------------------------------------------------------------------ joins with coverage

@query("j8_join_coverage", S.SCORES + f""",
  ft as (select distinct campana, tipo_estacion from base where picks > 4 and tipo_estacion in {S.LINES}),
  rf as (select distinct campana, cliente, tipo_estacion, mediana_tpp from med where tipo_estacion in {S.LINES})
  select 'universo' paso, count(*) filas from (select distinct campana, cliente, tipo_estacion from rf)
  union all select 'tras_join', count(*) from (select distinct campana, cliente, tipo_estacion from rf join ft using (campana, tipo_estacion))
  union all select 'tras_dropna', count(*) from (select campana, cliente, tipo_estacion from rf join ft using (campana, tipo_estacion) group by 1, 2, 3)""")
def _(spark, d):
    from flowmetrics.operators.adjust import join_coverage

    reference = picking.campaign_station_median(clean(spark, d), ["campana", "cliente", "tipo_estacion"])
    return join_coverage(_coverage_features(spark, d), reference)


def _coverage_features(spark, d):
    busy = picking.line_stations_only(base(spark, d)).where(F.col("picks") > 4)
    return busy.groupBy("campana", "tipo_estacion").agg(
        F.avg("picks").alias("n_categorias_mediana"), F.max("picks").alias("n_filas_mediana")
    )


@query("j8_lost_rows", S.CLEAN + f""",
  ft as (select distinct campana, tipo_estacion from base where picks > 4 and tipo_estacion in {S.LINES})
  select distinct campana, cliente, tipo_estacion from clean anti join ft using (campana, tipo_estacion) where tipo_estacion in {S.LINES}""")
def _(spark, d):
    from flowmetrics.operators.adjust import lost_rows

    reference = picking.campaign_station_median(clean(spark, d), ["campana", "cliente", "tipo_estacion"])
    return lost_rows(_coverage_features(spark, d), reference)
