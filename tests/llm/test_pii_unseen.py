"""Recall of added spans on shapes that the training sentences do not have, and columns named as the operator's own."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import pii

R = random.Random(5)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def d(n):
    return "".join(R.choice("0123456789") for _ in range(n))


def h(n):
    return "".join(R.choice("0123456789abcdef") for _ in range(n))


def b64(n):
    return "".join(R.choice(LETTERS) for _ in range(n))


SHAPES = {
    "phone": [lambda: f"0{d(2)}-{d(4)}-{d(4)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"{d(3)} {d(2)} {d(2)} {d(2)}", lambda: f"0049 {d(3)} {d(6)}", lambda: f"0{d(3)}-{d(6)}", lambda: f"0{d(3)} {d(3)} {d(3)}", lambda: f"1.{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(4)}"],
    "email": [lambda: f"jo{d(2)} at site{d(1)} dot co dot uk", lambda: f"jo{d(2)} AT site{d(1)} DOT org", lambda: f"jo.x{d(2)} <at> site{d(1)}.com", lambda: f"jo{d(2)}{{at}}site{d(1)}{{dot}}de", lambda: f"jo_x{d(2)}[AT]mail.site{d(1)}.co.uk", lambda: f"jo{d(2)} @ site{d(1)}.com"],
    "ip": [lambda: f"2001:db8::{h(4)}", lambda: f"fe80::{h(4)}:{h(4)}:{h(3)}a:{h(4)}", lambda: ":".join(f"{R.randint(0, 65535):x}" for _ in range(8)), lambda: ":".join(h(4).upper() for _ in range(8))],
    "national_id": [lambda: f"{d(3)}.{d(2)}.{d(4)}", lambda: f"AB {d(2)} {d(2)} {d(2)} {R.choice('ABCD')}", lambda: f"{d(8)}-{R.choice('TRWAG')}"],
    "iban": [lambda: f"DE{d(20)}", lambda: f"GB{d(2)} WEST {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"NL{d(2)} ABNA {d(4)} {d(4)} {d(2)}", lambda: f"IT{d(2)} X{d(3)} {d(4)} {d(4)} {d(4)} {d(4)} {d(3)}"],
    "secret": [lambda: "ghp_" + b64(36), lambda: b64(42) + "==", lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: f"eyJ{b64(20)}.{b64(40)}.{b64(30)}", lambda: f"xoxb-{d(11)}-{d(11)}-{b64(24)}", lambda: b64(24)],
}
HINTS = {
    "phone": ["phone ", "tel. ", "call me: ", "reach them on ", "Telefon "],
    "email": ["mail ", "contact ", "write to ", "send it to "],
    "ip": ["host ", "address ", "logged from ", "server "],
    "national_id": ["ssn ", "social security ", "national id ", "DNI "],
    "iban": ["IBAN ", "account ", "Konto ", "pay to "],
    "secret": ["api_key: ", "token=", '"secret": "', "password = ", "Authorization: Bearer "],
}
#: Look-alikes of other shapes than the training sentences': nothing is to be added in most of them.
CLEAN = [lambda: f"page {d(3)} of {d(3)}", lambda: f"order {d(3)}/{d(5)}", lambda: f"score {d(1)}:{d(1)}, {d(2)} minutes", lambda: f"version {d(1)}.{d(2)}.{d(3)}", lambda: f"he paid 3 @ {d(1)}.{d(2)} each", lambda: f"std::cafe and add::bad {d(2)}", lambda: f"look at {b64(5)} dotted line", lambda: f"sha256: {h(64)}", lambda: f"in {R.randint(1800, 2030)} {R.randint(10, 99)} men came", lambda: f"see /home/{b64(6)}/{b64(9)}/{b64(5)}"]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(kind, v, f"the old house stood {R.choice(HINTS[kind])}{v}{R.choice([' ', '. ', ', '])}and so on") for kind, shapes in SHAPES.items() for make in shapes for v in (make() for _ in range(40))]
    rows += [("clean", None, f"the old house, {make()} and so on") for make in CLEAN for _ in range(40)]
    frame = spark.createDataFrame(rows, "kind string, value string, text string")
    return pii.find_pii(frame).select("kind", "value", F.transform("added", lambda x: F.struct(x.kind, x.value)).alias("found")).collect()


@pytest.mark.parametrize("kind", SHAPES)
def test_recall_on_shapes_not_trained_on(judged, kind):
    own = [r for r in judged if r.kind == kind]
    hits = [any(pii.KINDS[x.kind] == kind and x.value.strip() == r.value for x in r.found) for r in own]
    assert sum(hits) >= 0.9 * len(own)


def test_look_alikes_are_left_alone(judged):
    own = [r for r in judged if r.kind == "clean"]
    assert sum(bool(r.found) for r in own) <= 0.1 * len(own)


def test_columns_named_as_the_operators_own_pass(spark):
    df = spark.createDataFrame([("call (555) 123-4567", "a", "b", "c", "d")], "text string, __text string, __email string, __g0 string, ___x string")
    out = pii.find_pii(df)
    assert out.columns == [*df.columns, "base", "added"]
    row = out.first()
    assert tuple(row[:5]) == tuple(df.first()) and len(row.added) == 1


@pytest.mark.parametrize("text", ["a at " * 20_000, "x (at) y " * 10_000, "ab:" * 30_000, "1::" * 20_000, "AB 12 " * 10_000, "bearer " + "a." * 20_000, "1 @ " * 20_000])
def test_new_patterns_stay_linear(spark, text):
    assert pii.find_pii(spark.createDataFrame([(text,)], "text string")).count() == 1
