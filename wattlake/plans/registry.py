"""UDF02: named views with their group keys, metrics, filters and arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from wattlake.plans import frame as fr
from wattlake.plans import severity as sv
from wattlake.plans import theme_views as tv
from wattlake.plans import views as vw


@dataclass(frozen=True)
class View:
    id: str
    handler: Callable[..., DataFrame]
    keys: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ("*",)
    filters: tuple[str, ...] = (*fr.FILTER_COLUMNS, "start_date", "end_date")
    arguments: dict[str, Any] = field(default_factory=dict)
    needs_totals: bool = False

    @property
    def parts(self) -> tuple[str, ...]:
        return parts_of(self.id)

    def run(self, frame: DataFrame, **overrides: Any) -> DataFrame:
        return self.handler(frame, **{**self.arguments, **overrides})


VIEWS: dict[str, View] = {}

# Parts of the frame that a view or summary reads besides the columns every frame has; who is not named reads them all.
_READERS = (
    (
        (),
        "by_region top_assuntos refaturamento_summary by_group monthly_volume mis_monthly_mis reincidence_matrix "
        "monthly_assunto_breakdown sazonalidade_reclamacoes reincidencia_por_assunto ce_macro_distribution "
        "ce_monthly_trend_by_tema ce_cruzamento_erro_leitura ce_kpis ce_executive_table ce_subject_pareto ce_cause_drill "
        "ce_theme_heatmap ce_repeat_installations ce_group_radar ce_reincidence_buckets coverage_window monthly_ce_sp "
        "monthly_evaluated_series filter_data_plane preset_last_30_days",
    ),
    (("topic",), "kpis overview topic_distribution"),
    (
        ("cause",),
        "top_causas root_cause_distribution region_cause_matrix refaturamento_by_cause radar_causes_by_region "
        "category_breakdown severity_heatmap mis mis_executive_summary classifier_coverage taxonomy_reference "
        "ce_total_assunto_causa motivos_taxonomia monthly_causa_breakdown playbook_dificuldade_acoes coverage_report "
        "severity_buckets cause_scatter subject_model_summary outcome_split filter_dashboard sp_severidade_alta_categorias "
        "sp_severidade_critica_categorias sp_severidade_demais_categorias",
    ),
    (("cause", "topic"), "classifier_indefinido_tokens governance_health filter_options"),
    (("cause", "text"), "sp_causa_observacoes"),
    (
        ("cause", "outcome"),
        "sp_severidade_distribution cause_ranking sp_severidade_alta_mensal sp_severidade_critica_mensal "
        "sp_severidade_demais_mensal sp_severidade_alta_causas sp_severidade_critica_causas sp_severidade_demais_causas",
    ),
    (("cause", "invoice"), "sp_severidade_alta_ranking sp_severidade_critica_ranking sp_severidade_demais_ranking"),
    (
        ("cause", "outcome", "invoice"),
        "sp_severidade_alta_overview sp_severidade_critica_overview sp_severidade_demais_overview sp_installation_details",
    ),
    (
        ("cause", "outcome", "invoice", "text"),
        "sp_categoria_subcausa_tree sp_categoria_subcausa_tree_alta sp_categoria_subcausa_tree_critica "
        "sp_categoria_subcausa_tree_demais category_tree_nodes",
    ),
    (
        ("cause", "topic", "invoice", "text"),
        "sp_severidade_alta_descricoes sp_severidade_critica_descricoes sp_severidade_demais_descricoes",
    ),
    (("meter",), "top_instalacoes_por_regional sp_tipos_medidor"),
    (("meter", "invoice"), "sp_perfil_assunto_lider"),
    (("meter", "outcome"), "sp_overview_metrics"),
    (("cause", "meter"), "top_instalacoes sp_causas_por_tipo_medidor sp_installations_by_meter_type"),
    (("cause", "meter", "text"), "top_instalacoes_digitacao sp_tipos_medidor_digitacao"),
    (
        ("cause", "meter", "invoice"),
        "sp_faturas_altas sp_fatura_medidor sp_medidores_problema_reclamacao sp_installation_invoices data_cards "
        "weighted_invoice_mean",
    ),
    (("cause", "meter", "invoice", "text"), "sp_digitacao_fatura_medidor"),
    (("cause", "topic", "outcome", "meter", "invoice", "digest"), "wide_frame"),
)
_PARTS = {name: parts for parts, names in _READERS for name in names.split()}


def parts_of(name: str) -> tuple[str, ...]:
    """Parts of the frame that a view or summary needs."""
    return _PARTS.get(name, fr.WHOLE)


def register(view_id: str, handler: Callable[..., DataFrame], keys=(), metrics=("*",), **options: Any) -> View:
    """Add a view; other packages may register their own."""
    view = View(view_id, handler, tuple(keys), tuple(metrics), **options)
    VIEWS[view_id] = view
    return view


def get_view(view_id: str) -> View:
    if view_id not in VIEWS:
        raise KeyError(f"unknown view: {view_id}; known views: {', '.join(sorted(VIEWS))}")
    return VIEWS[view_id]


def aggregate(
    frame: DataFrame,
    view_id: str,
    filters: dict[str, Any] | None = None,
    *,
    include_total: bool = False,
    default_regions: tuple[str, ...] = ("CE", "SP"),
) -> DataFrame:
    """Filters and view as one lazy plan, so the filters reach the scan and only needed columns are read."""
    view = get_view(view_id)
    data = fr.apply_filters(frame, filters, default_regions)
    if not (include_total or view.needs_totals):
        data = fr.training_only(data)
    return view.run(data)


def publish(frame: DataFrame, view_id: str, filters: dict[str, Any] | None = None) -> DataFrame:
    """Expose a view to SQL under its id."""
    out = aggregate(frame, view_id, filters)
    out.createOrReplaceTempView(view_id)
    return out


def _ce(handler: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda frame: handler(tv.prepare(frame))


def _ce_crossing(frame: DataFrame) -> DataFrame:
    return tv.crossing(tv.prepare(frame), frame.filter("_data_type <> 'reclamacao_total'"))


for _id, _handler, _keys in (
    ("kpis", vw.kpis, ()),
    ("overview", vw.kpis, ()),
    ("by_region", vw.by_region, ("regiao",)),
    ("top_assuntos", vw.top_subjects, ("assunto",)),
    ("top_causas", vw.top_causes, ("causa_canonica",)),
    ("refaturamento_summary", vw.rebill_summary, ()),
    ("by_group", vw.by_group, ("grupo",)),
    ("monthly_volume", vw.monthly_volume, ("mes_ingresso", "regiao")),
    ("root_cause_distribution", vw.root_cause_distribution, ("causa_canonica",)),
    ("region_cause_matrix", vw.region_cause_matrix, ("causa_canonica", "regiao")),
    ("topic_distribution", vw.topic_distribution, ("topic_name",)),
    ("refaturamento_by_cause", vw.rebill_by_cause, ("causa_canonica",)),
    ("radar_causes_by_region", vw.cause_radar, ("regiao", "causa_canonica")),
    ("category_breakdown", vw.category_breakdown, ("categoria", "regiao")),
    ("severity_heatmap", vw.severity_heatmap, ("regiao", "severidade")),
    ("mis", vw.executive_summary, ("regiao",)),
    ("mis_executive_summary", vw.executive_summary, ("regiao",)),
    ("mis_monthly_mis", vw.monthly_trend, ("mes_ingresso", "regiao")),
    ("classifier_coverage", vw.classifier_coverage, ("regiao", "causa_canonica_confidence")),
    ("classifier_indefinido_tokens", vw.undefined_tokens, ("token",)),
    ("sp_severidade_distribution", sv.distribution, ("severidade",)),
    ("reincidence_matrix", vw.reincidence_matrix, ("regiao", "faixa")),
    ("taxonomy_reference", vw.taxonomy_reference, ("classe",)),
    ("top_instalacoes", vw.top_installations, ("instalacao",)),
    ("top_instalacoes_por_regional", vw.top_installations_by_region, ("regiao", "instalacao")),
    ("top_instalacoes_digitacao", vw.top_installations_typing, ("regiao", "instalacao")),
    ("sp_tipos_medidor", vw.sp_meter_types, ("tipo_medidor_dominante",)),
    ("sp_tipos_medidor_digitacao", vw.sp_meter_types_typing, ("tipo_medidor_dominante",)),
    ("sp_causas_por_tipo_medidor", vw.sp_causes_by_meter_type, ("tipo_medidor_dominante", "causa_canonica")),
    ("sp_faturas_altas", vw.sp_high_invoices, ("instalacao", "fat_reclamada_top")),
    ("sp_fatura_medidor", vw.sp_invoice_by_meter, ("tipo_medidor_dominante",)),
    ("sp_digitacao_fatura_medidor", vw.sp_invoice_by_meter_typing, ("tipo_medidor_dominante",)),
    ("sp_medidores_problema_reclamacao", vw.sp_problem_meters, ("tipo_medidor_dominante",)),
    ("motivos_taxonomia", vw.taxonomy_reasons, ("regiao", "assunto", "causa_canonica")),
    ("monthly_assunto_breakdown", vw.monthly_subjects, ("mes_ingresso", "assunto")),
    ("monthly_causa_breakdown", vw.monthly_causes, ("mes_ingresso", "causa_canonica")),
    ("sp_causa_observacoes", vw.sp_cause_notes, ("causa_canonica",)),
    ("sp_perfil_assunto_lider", vw.sp_leading_subject, ("assunto",)),
    ("sazonalidade_reclamacoes", vw.seasonality, ("regiao",)),
    ("reincidencia_por_assunto", vw.reincidence_by_subject, ("assunto",)),
    ("playbook_dificuldade_acoes", vw.playbook, ()),
    ("governance_health", vw.governance_health, ()),
):
    register(_id, _handler, _keys)

for _id, _handler in (
    ("ce_total_assunto_causa", vw.ce_subject_causes),
    ("ce_macro_distribution", _ce(tv.distribution)),
    ("ce_monthly_trend_by_tema", _ce(tv.monthly_trend)),
    ("ce_cruzamento_erro_leitura", _ce_crossing),
):
    register(_id, _handler, needs_totals=True)

for _name, _severity in (("alta", "high"), ("critica", "critical"), ("demais", ("medium", "low"))):
    for _part, _handler, _extra in (
        ("overview", sv.overview, {}),
        ("mensal", sv.monthly, {}),
        ("categorias", sv.categories, {}),
        ("causas", sv.causes, {}),
        ("ranking", sv.ranking, {}),
        ("descricoes", sv.descriptions, {"limit": 10}),
    ):
        register(f"sp_severidade_{_name}_{_part}", _handler, arguments={"severity": _severity, **_extra})
    register(f"sp_categoria_subcausa_tree_{_name}", sv.category_tree, arguments={"severity": _severity})
register("sp_categoria_subcausa_tree", sv.category_tree)
