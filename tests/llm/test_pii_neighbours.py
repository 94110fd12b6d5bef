"""Phone numbers beside other numbers."""

import pytest

from chunkwright.llm import pii

CASES = {
    "call 555-123-4567 555-987-6543": ["555-123-4567", "555-987-6543"],
    "call 555-123-4567/555-987-6543 now": ["555-123-4567", "555-987-6543"],
    "tel. (826) 555-4081 190.137.223.5 and more": ["(826) 555-4081"],
    "phone 12 34 56 555-123-4567 98765": ["555-123-4567"],
    "Telefon 0171 123456 0172 654321": ["0171 123456", "0172 654321"],
    "call 555-123-4567": ["555-123-4567"],
    "order 978-555-123-4567-8901-22": [],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = pii.find_pii(spark.createDataFrame([(t,) for t in CASES], "text string")).collect()
    return {r.text: [x.value for x in r.added if pii.KINDS[x.kind] == "phone"] for r in rows}


@pytest.mark.parametrize("text", CASES)
def test_phones_beside_numbers(found, text):
    assert found[text] == CASES[text]


def test_only_kept_spans_suppress_others(spark, monkeypatch):
    """In the chain A > B > C, in which only neighbours overlap, B goes and C stays."""

    class Trees:
        def sql(self, names):
            return f"CASE {names[pii.FEATURES.index('n_chars')]} WHEN 9 THEN 0.9D WHEN 8 THEN 0.8D ELSE 0.7D END"

    text = "A" * 40
    spans = [(0, 9), (5, 13), (10, 17), (30, 37), (30, 37)]
    f = lambda n: "array(" + ", ".join(str(n if name == "n_chars" else 0) for name in pii.FEATURES) + ")"
    made = "array(" + ", ".join(f"named_struct('kind', 3, 'start', {a}L, 'end', {b}L, 'value', substring(text, {a + 1}, {b - a}), 'generator', 0, 'f', {f(b - a)})" for a, b in spans) + ")"
    monkeypatch.setattr(pii, "fit", lambda spark, p: (Trees(), dict.fromkeys(pii.KINDS, 0.5)))
    monkeypatch.setattr(pii, "candidates", lambda docs, p: docs.selectExpr("*", f"{made} as candidates"))
    row = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()
    assert [(x.start, x.end) for x in row.added] == [(0, 9), (10, 17), (30, 37)]
