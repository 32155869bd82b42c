"""The planted labels meet every status that a rule has."""

from collections import defaultdict

from labelspark.plans.planted import CASES
from labelspark.plans.planted_results import PLANTED_RESULTS
from labelspark.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Statuses of each rule's arms.
ARMS = {
    "Brand name present": "fn", "Brand name matches": "pnf", "Class/type present": "fn", "Class/type matches": "pnf",
    "Alcohol content present": "fp", "Alcohol content matches": "pn", "Alcohol content": "pn", "Proof": "p", "Proof present": "n",
    "Proof matches": "pn", "Proof/ABV consistency": "pn", "Net contents present": "fn", "Net contents standard of fill": "n",
    "Net contents matches": "n", "Net contents": "p", "Government warning present": "f", "GOVERNMENT WARNING in caps": "pf",
    "Exact warning wording": "pnf", "Bottler/producer statement": "pnf", "Bottler matches": "n", "Bottler address": "pn",
    "Country of origin": "pnf", "Country of origin matches": "n", "Sulfites statement": "pf", "FD&C Yellow No. 5": "pf",
    "Cochineal/Carmine statement": "pf", "Wood treatment": "pf", "Age statement": "pf", "Neutral spirits / commodity": "pf",
    "Aspartame statement": "pf", "Appellation of origin": "pn", "Varietal designation": "pn",
}


def test_every_arm_is_expected_and_met(spark):
    expected = defaultdict(set)
    for _, rule, status, *_ in PLANTED_RESULTS:
        expected[rule].add(status[0])
    assert {r: "".join(sorted(s)) for r, s in expected.items()} == {r: "".join(sorted(s)) for r, s in ARMS.items()}
    rows = QUERIES["rule_arms"](spark, DATA).collect()
    by_case = defaultdict(set)
    for r in rows:
        by_case[r.case_no].add((r.rule_id, r.status, r.message, r.extracted_value, r.app_value))
    want = defaultdict(set)
    for case, *row in PLANTED_RESULTS:
        want[case].add(tuple(row))
    assert by_case == want
    # cases without rows are those whose statement is not required
    assert [CASES[i][0] for i in set(range(len(CASES))) - set(want)] == ["Other"] * 4
