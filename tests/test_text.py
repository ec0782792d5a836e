"""Text functions on small cases."""

import pytest
from pyspark.sql import functions as F

from tenetry.functions import numeric, text


def one(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(f(*(F.col(f"a{i}") for i in range(len(args)))).alias("x")).first()["x"]


PAGE = """# Field log of the survey boat

The echo sounder was recalibrated
before the second transect. Did the tide matter?

* The hull draws less than two metres.
* Spare cable drum
"""
LISTED = """## Stations

| buoy | depth |
|------|-------|
| 14   | 40 m  |

~~~
salinity(buoy) returns a plain number here.
~~~

Three things the crew reports every morning:

1. Wind above twelve knots keeps the drone
   on deck all day.
2. __Ballast__ means that [the keel](http://boat.example) sits `deeper` than planned.
"""


def test_abbreviations_do_not_end_a_sentence(spark):
    assert one(spark, text.sentences, "Two gauges, approx. a mile apart, failed. The third one held.") == ["Two gauges, approx. a mile apart, failed.", "The third one held."]
    assert one(spark, text.sentences, "Ask Dr. Quell. She knows!") == ["Ask Dr. Quell.", "She knows!"]


def test_claims_of_a_page(spark):
    assert one(spark, text.claims, PAGE) == ["The echo sounder was recalibrated before the second transect.", "The hull draws less than two metres."]


def test_claims_of_lists(spark):
    assert one(spark, text.claims, LISTED) == ["Wind above twelve knots keeps the drone on deck all day.", "Ballast means that the keel sits deeper than planned."]


@pytest.mark.parametrize("s, kept", [("Lead is soft.", True), ("Compare table 9.", False), ("Tighten the bolt.", False), ("List of charts.", False), ("Two-stage low-noise amplifier", False), ("Is lead soft?", False)])
def test_short_claims_need_a_verb(spark, s, kept):
    assert one(spark, text.claims, s) == ([s] if kept else [])


@pytest.mark.parametrize(
    "s, parts",
    [
        ("The mast is hollow and has no stays.", ["The mast is hollow.", "The mast has no stays."]),
        ("Copper is ductile; glass is brittle.", ["Copper is ductile.", "Glass is brittle."]),
        ("The winch is old but has new brakes.", ["The winch is old.", "The winch has new brakes."]),
        ("The deck is wet and cold.", []),
        ("but", []),
        ("", []),
        ("The deck is wet.", []),
    ],
)
def test_split_claims(spark, s, parts):
    assert one(spark, text.split_claims, s) == parts


def test_tokens_stems_polarity(spark):
    assert one(spark, text.tokens, "A buoy is in the bay of B") == ["buoy", "bay"]
    assert one(spark, text.stems, "Anchors mass campus axis bus anchors") == ["anchor", "mass", "campus", "axis", "bus"]
    assert one(spark, text.normalise, "The KEEL; which is heavy,   is  new!") == "the keel which is heavy is new"
    assert one(spark, text.polarity, "The keel has no bolts") == 1
    assert one(spark, text.polarity, "The keel is not without bolts") == 0


def test_replies_and_passages(spark):
    assert one(spark, text.reply_claims, "* first thing seen.\n\n7) second thing seen\n***") == ["first thing seen.", "second thing seen."]
    source = "Gulls nest early. Terns nest late. Buoys drift with ice. Seals sleep ashore."
    assert one(spark, text.passage_for, "Does ice make buoys drift", source) == "Terns nest late. Buoys drift with ice."
    assert one(spark, text.claims_to_verify, "Where? When?") == ["Where? When?"]
    assert one(spark, text.claims_to_verify, "  ") == []


def test_vocabulary(spark):
    source = "The harbour keeps a tide table without any software."
    assert one(spark, text.grounded_in, "The harbour keeps a tide table.", source) is True
    assert one(spark, text.grounded_in, "Bakers grind their own flour.", source) is False


def test_numbers(spark):
    row = spark.range(1).select(
        numeric.slot(F.lit("qubit")).alias("slot"),
        numeric.shift(F.lit(0.5), F.lit(0.8), F.lit(True)).alias("up"),
        numeric.decayed(F.lit(0.8), F.lit(180.0)).alias("half"),
        numeric.decayed(F.lit(0.8), F.lit(36500.0)).alias("floor"),
        numeric.decayed(F.lit(0.03), F.lit(360.0)).alias("under"),
        numeric.dashed_uuid(F.lit("0123456789abcdef0123456789abcdef")).alias("uuid"),
    ).first()
    assert row["slot"] == 9613145697666387222 % 1024
    assert (row["up"], row["half"], row["floor"], row["under"]) == (0.833333, 0.4, 0.05, 0.03)
    assert row["uuid"] == "01234567-89ab-cdef-0123-456789abcdef"
    with pytest.raises(ValueError):
        numeric.decayed(F.lit(0.8), F.lit(1.0), half_life=0)
