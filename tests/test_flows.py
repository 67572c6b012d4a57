from collections import Counter

from caselight import schema
from caselight.functions.fixed_values import SPANISH
from caselight.operators import flows


def edges(df):
    return Counter(tuple(r) for r in df.collect())


def test_category_flow(make_cases):
    cases = make_cases(
        dict(area="Gestión", grp="", category_path="x.x.y", case_type="INCIDENT", met_sla=1),
        dict(area="Gestión", grp="", category_path="x", case_type="INCIDENT"),
        dict(area="A", grp="g?", category_path="x.x.y.z.w", case_type="INCIDENT"),
        dict(area="A", grp=None, category_path=None, case_type="INCIDENT"),
        dict(area="A", grp="g", category_path="q", case_type="REQUEST"),
    )
    got = edges(flows.category_flow(cases, "INCIDENT", tag_level_2=False))
    assert got == Counter(
        {
            ("Gestion", "NoGroup", 2): 1,
            ("A", "g.", 1): 1,
            ("A", None, 1): 1,
            ("NoGroup", "x", 2): 1,
            ("g.", "x", 1): 1,
            ("x", "x", 2): 1,
            ("x", "y", 2): 1,
            ("y", "z", 1): 1,
        }
    )
    tagged = edges(flows.category_flow(cases, "INCIDENT"))
    assert ("x", "x ", 2) in tagged and ("x ", "y", 2) in tagged
    missed = edges(flows.category_flow(cases, "INCIDENT", missed_only=True))
    assert ("Gestion", "NoGroup", 1) in missed
    assert ("Gestion", "NoGrupo", 2) in edges(
        flows.category_flow(cases, "INCIDENT", labels=SPANISH)
    )


def test_same_labels_on_two_steps_stay_two_edges(make_cases):
    cases = make_cases(dict(area="A", grp="g", category_path="a.b.a.b", case_type="INCIDENT"))
    got = edges(flows.category_flow(cases, "INCIDENT", tag_level_2=False))
    assert got[("a", "b", 1)] == 2


def test_open_flow(make_cases):
    cases = make_cases(
        dict(area="A", specialist="", state="OPEN"),
        dict(area="A", specialist="s", state=""),
        dict(area="A", specialist=None, state="OPEN"),
        dict(area="A", specialist="s", state="CLOSED"),
        dict(area="A", specialist="s", state=None, ci="c"),
    )
    assert edges(flows.open_flow(cases)) == Counter(
        {("A", "", 1): 1, ("A", "s", 2): 1, ("NA1a", "OPEN", 1): 1, ("s", "No_CI", 1): 1}
    )
    assert edges(flows.ci_state_flow(cases)) == Counter(
        {("No_CI", "OPEN", 2): 1, ("No_CI", "NA1c", 1): 1, ("c", None, 1): 1}
    )


def test_client_pending_flow(spark):
    rows = [
        ("A", "sp", 1, "Categoría", "svc"), ("A", "sp", 2, "Categoría", "svc"),
        ("B", None, 3, "c", None),
    ]
    pending = spark.createDataFrame(rows, schema.CLIENT_PENDING)
    assert edges(flows.client_pending_flow(pending)) == Counter(
        {
            ("A", "svc", 2): 1,
            ("B", None, 1): 1,
            ("svc", "Categoria.", 2): 1,
            ("Categoria.", "sp", 2): 1,
        }
    )
    assert edges(flows.client_pending_flow(pending, "B")) == Counter({("B", None, 1): 1})
