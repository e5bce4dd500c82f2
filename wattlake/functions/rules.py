"""Business rules of the Silver layer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service types per class and the risky installation types.
CLASS_A_SERVICES = (
    "CORTE", "RELIGACAO", "SUBSTITUICAO_MEDIDOR", "INSTALACAO_MEDIDOR", "REGULARIZACAO_FRAUDE",
)
CLASS_B_SERVICES = (
    "INSPECAO_PROGRAMADA", "VERIFICACAO_MEDIDOR", "ATUALIZACAO_CADASTRAL_COM_MEDICAO", "REVISAO_LEITURA",
)
RISK_INSTALLATIONS = ("SUBESTACAO", "ALTA_TENSAO", "AREA_INDUSTRIAL_RISCO", "ZONA_RURAL_ISOLADA")
EARTH_RADIUS_M = 6_371_000


def _true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def risk_flag(area: Column, incidents: Column, installation: Column, schedule: Column, manual: Column) -> Column:
    """Five independent risk predicates; a NULL never counts as risk."""
    return (
        _true(area)
        | _true(incidents >= 2)
        | _true(installation.isin(*RISK_INSTALLATIONS))
        | _true(~schedule.between("06:00", "18:00"))
        | _true(manual)
    )


def service_class(billing: Column, service: Column, risk: Column) -> Column:
    """PRJ06: ACF_A/ACF_B/ACF_C for billing work, ASF_RISCO/ASF_FORA_RISCO otherwise."""
    billed = _true(billing)
    return (
        F.when(billed & _true(service.isin(*CLASS_A_SERVICES)), "ACF_A")
        .when(billed & _true(service.isin(*CLASS_B_SERVICES)), "ACF_B")
        .when(billed, "ACF_C")
        .when(risk, "ASF_RISCO")
        .otherwise("ASF_FORA_RISCO")
    )


def delay_days(planned: Column, done: Column, reference: Column) -> Column:
    """PRJ07: days late when done late or still open after the plan, else 0."""
    effective = F.coalesce(done, reference)
    return F.coalesce(F.greatest(F.datediff(effective, planned), F.lit(0)), F.lit(0))


def delay_status(planned: Column, done: Column, reference: Column) -> Column:
    """PRJ08: deadline status with its own value for a missing plan."""
    return (
        F.when(planned.isNull(), "SEM_PREVISAO")
        .when(done <= planned, "NO_PRAZO")
        .when(done > planned, "ATRASADO")
        .when(reference <= planned, "PENDENTE_NO_PRAZO")
        .otherwise("PENDENTE_FORA_PRAZO")
    )


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """FN16: great-circle metres; NULL when any coordinate is NULL."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    inner = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(inner))


def target_status(pct: Column) -> Column:
    """PRJ11: four levels over the percentage of the target."""
    return (
        F.when(pct >= 100, "ATINGIDA").when(pct >= 90, "EM_RISCO").when(pct >= 70, "CRITICA").otherwise("NAO_ATINGIDA")
    )


def uf_region(uf: Column) -> Column:
    """PRJ23: staging region of a state code."""
    return (
        F.when(uf.isin("SP", "RJ", "ES", "MG"), "SUDESTE")
        .when(uf.isin("CE", "PE", "BA"), "NORDESTE")
        .when(uf.isin("GO", "DF", "MT"), "CENTRO-OESTE")
        .otherwise("OUTRAS")
    )


def criticality(is_root: Column, rebill: Column) -> Column:
    """PRJ24: high with a root cause and a rebill, medium with a root cause, else low."""
    return F.when(is_root & (rebill == 1.0), "high").when(is_root, "medium").otherwise("low")


def surrogate_key(*parts: Column) -> Column:
    """md5 of the text of the key parts, NULL as blank."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("-", *texts))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """FN22: value held inside the bounds; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def reincidence_bucket(n: Column) -> Column:
    """1, 2, 3-4, 5-9, 10+ as labelled."""
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").when(n <= 9, "5-9").otherwise("10+")


def delay_band(days: Column) -> Column:
    """Six delay bands."""
    return (
        F.when(days <= 0, "Sem atraso")
        .when(days <= 3, "1-3 dias")
        .when(days <= 7, "4-7 dias")
        .when(days <= 15, "8-15 dias")
        .when(days <= 30, "16-30 dias")
        .otherwise("30+ dias")
    )


def aging_band(days_past_plan: Column) -> Column:
    """Aging of open work by days past the plan."""
    return (
        F.when(days_past_plan <= 0, "No prazo")
        .when(days_past_plan <= 7, "1-7 dias vencida")
        .when(days_past_plan <= 15, "8-15 dias vencida")
        .when(days_past_plan <= 30, "16-30 dias vencida")
        .otherwise("30+ dias vencida")
    )


def debt_band(days: Column) -> Column:
    """Aging of unpaid invoices."""
    return (
        F.when(days <= 30, "1-30 dias").when(days <= 60, "31-60 dias").when(days <= 90, "61-90 dias")
        .otherwise("90+ dias")
    )


def debt_profile(months: Column) -> Column:
    """Recurrence profile by unpaid months of the last year."""
    return (
        F.when(months >= 6, "CRONICO").when(months >= 3, "RECORRENTE").when(months >= 1, "EVENTUAL")
        .otherwise("ADIMPLENTE")
    )


def projection_status(pct: Column) -> Column:
    """Risk status of the projected percentage."""
    return F.when(pct >= 100, "NO_CAMINHO").when(pct >= 95, "ATENCAO").when(pct >= 85, "RISCO").otherwise("CRITICO")
