"""Constants that must equal those of the original service-desk reports.

They are defaults only. Every operator that uses one takes it as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Header of the case extract -> column name used here. Headers are
# matched after every character that is not a letter, digit, dot or underscore
# has been replaced by a dot.
CASE_HEADERS = {
    "Caso": "case_id",
    "AREA": "area",
    "GRUPO": "grp",
    "SUBGRUPO": "subgrp",
    "Especialista": "specialist",
    "Servicio": "service",
    "Tipo.de.Servicio": "service_type",
    "Tipo.de.caso": "case_type",
    "Estado": "state",
    "Jerarquía.de.Categorías": "category_path",
    "Categoria": "category",
    "CI": "ci",
    "Sede.Cliente": "site",
    "Incluido.en.los.Indicadores.": "inclusion",
    "Tiempo.Total.Solución..minutos.": "elapsed_minutes",
    "Tiempo.requerido.SLA..minutos.": "sla_minutes",
    "Cumplió.SLA": "met_sla",
    "Fecha.de.registro": "registered_at",
    "Fecha.de.vencimiento": "due_at",
    "Fecha.real.de.solución": "solved_at",
    "Progreso.Individual": "progress_text",
    "Cerrado.en.el..periodo": "closed_in_period",
    "Cerrado.en.el.mes.cumpliendo.SLA": "closed_met_sla",
    "Solucionado.pendiente.cierre": "solved_pending_close",
    "Solucionado.pendiente.cierre.y.cumple.SLA": "solved_pending_close_met_sla",
    "Sigue.pendiente.en.el.mes": "still_pending",
    "Sigue.pendiente.en.el.mes.y.cumple.SLA": "still_pending_met_sla",
    "Se.vence.en.el.mes": "due_in_month",
    "Viene.vencido.de.meses.anteriores": "overdue_prev_months",
    "Cerrado.x.anticipado.del.mes.siguiente": "closed_early_next",
    "Solucionado.anticipado.mes.siguiente..pendiente.cierre": "solved_early_next",
    "Cerrado.x.anticipado.en.el.mes.anterior": "closed_early_prev",
}

CAPACITY_HEADERS = {"AREA": "area", "Dia": "day", "P0": "p0"}

CLIENT_PENDING_HEADERS = {
    "Area": "area",
    "especialista_resp": "specialist",
    "numero_de_caso": "case_id",
    "categoria": "category",
    "servicio": "service",
}

# Text of the case extract -> code used here, per column. Any other
# text is kept as it is.
CASE_CODES = {
    "service_type": {
        "Servicios Usuario Final": "END_USER",
        "Servicios Internos": "INTERNAL",
    },
    "case_type": {"Incidente": "INCIDENT", "Requerimiento": "REQUEST"},
    "state": {"Cerrado": "CLOSED", "Solucionado": "SOLVED", "Denegado": "DENIED"},
    "inclusion": {"Incluido IES,IVS,IC": "INCLUDED"},
}

# Organisation areas of the original reports.
AREAS = (
    "Gestión del Servicio",
    "Infraestructura Informatica",
    "Sistemas de Informacion",
    "Telecomunicaciones",
)

# Units left out of every report.
EXCLUDED_GROUPS = ("Mesas de ayuda",)
EXCLUDED_SUBGROUPS = (
    "Centro de Servicios - SAU No Operativo",
    "Centro de Servicios - MAS No Operativo",
    "Proyectos",
)

# Cases recorded by mistake, left out of every report.
BAD_CASE_IDS = (
    122953, 122973, 122974, 122976, 122977, 122978, 122979, 122980, 122983, 122984,
    122988, 122990, 122991, 122992, 122995, 122996, 122997, 122998, 122999, 123003,
    123004, 123006, 123007, 123009, 123010, 123011, 123012, 123013, 123015, 123018,
    123019, 123020, 123021, 123022, 123023, 123025, 123026, 123027, 123029, 123030,
    123031, 123033, 123034, 123043, 123044, 123046, 123047, 123051, 123052, 123055,
    123056, 123057, 123059, 123060, 123061, 123083, 123088, 123579, 126530, 126719,
    126904, 127093, 127128, 127195, 127200, 127409, 127861, 127895, 128129, 128133,
    128220, 128290, 128639, 129190, 129281,
)

# Public holidays taken out of the business-hour grid (2016).
HOLIDAYS = (
    date(2016, 1, 1),
    date(2016, 1, 4),
    date(2016, 3, 20),
    date(2016, 3, 21),
    date(2016, 3, 24),
    date(2016, 3, 25),
    date(2016, 3, 27),
    date(2016, 5, 1),
    date(2016, 5, 9),
    date(2016, 5, 30),
    date(2016, 6, 6),
    date(2016, 7, 4),
    date(2016, 7, 20),
    date(2016, 8, 7),
    date(2016, 8, 15),
    date(2016, 10, 17),
    date(2016, 11, 7),
    date(2016, 11, 14),
    date(2016, 12, 8),
    date(2016, 12, 25),
)

# Fixed values: (area, kpi, target, tolerance). TOTAL is the whole organisation.
TOTAL = "TOTAL"
TARGETS = (
    (TOTAL, "ics", 0.9398, 0.005),
    ("Infraestructura Informatica", "ics", 0.9362, 0.0339),
    ("Sistemas de Informacion", "ics", 0.9506, 0.0378),
    ("Telecomunicaciones", "ics", 0.9568, 0.0488),
    ("Gestión del Servicio", "ics", 0.8835, 0.005),
    (TOTAL, "ies", 0.9590, 0.0125),
    ("Infraestructura Informatica", "ies", 0.9790, 0.0097),
    ("Sistemas de Informacion", "ies", 0.9070, 0.0281),
    ("Telecomunicaciones", "ies", 0.9495, 0.0364),
    ("Gestión del Servicio", "ies", 0.9160, 0.0882),
)

# Thresholds of the bands that have no target table.
SPEED_FLOOR, SPEED_LOW, SPEED_CEILING = 0.4, 0.5, 1.0
QUOTA_FULL, QUOTA_MARGIN = 100, 5
CAPACITY_MARGIN = 0.1
MISSED_SHARE = 0.05
FREQUENT_SHARE = 0.002
TOP_N = 20
CHART_WINDOW_DAYS = 30

# Characters folded in flow labels, position by position.
ACCENTS_FROM = "áéíóúñ?"
ACCENTS_TO = "aeioun."

# Text formats of the case extract.
STAMP_FORMAT = "d/M/yyyy H:mm:ss"
DAY_FORMAT = "dd-MM-yyyy"


@dataclass(frozen=True)
class Labels:
    """Words written into results."""

    total: str = TOTAL
    no_group_flow: str = "NoGroup"
    no_specialist_flow: str = "NA1a"
    no_state_flow: str = "No_CI"
    no_ci_flow: str = "No_CI"
    no_state_ci_flow: str = "NA1c"
    no_ci: str = "CI not_registered"
    no_group: str = "No_Group"
    missed_message: str = " missed - "
    incidents_message: str = " : Incidents : "


ENGLISH = Labels()
# The words of the original reports.
SPANISH = Labels(
    total="GT",
    no_group_flow="NoGrupo",
    no_ci="CI No_Registrado",
    no_group="No_Grupo",
    missed_message=" Casos Vencidos - ",
    incidents_message=" : Incidentes : ",
)
