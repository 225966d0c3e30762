from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statuta.functions import regulatory as R
from statuta.functions.text import approx_tokens, squeezed, words


def value(spark, column):
    return spark.range(1).select(column).first()[0]


CASES = [
    (lambda: squeezed(F.lit(" a  b\n")), "a b"),
    (lambda: words(F.lit("Año 21-CFR_x")), ["año", "21", "cfr", "x"]),
    (lambda: words(F.lit(None).cast("string")), []),
    (lambda: approx_tokens(F.lit("")), 1),
    (lambda: approx_tokens(F.lit("a b c")), 4),
    (lambda: R.slug(F.lit(" Direct  Costs! ")), "direct-costs"),
    (lambda: R.label_suffix(F.lit("(a)(1)(i)")), "a-1-i"),
    (lambda: R.snake_to_title(F.lit("health_claim")), "Health Claim"),
    (lambda: R.byte_size(F.lit(2048)), "2.0 KB"),
    (lambda: R.counted(F.lit(2), "citation"), "2 citations"),
    (lambda: R.percent(F.lit(0.875)), 88),
    (lambda: R.clamp(F.lit(1.7)), 1.0),
    (lambda: R.clamp(F.lit(None)), 0.5),
    (lambda: R.sigmoid(F.lit(0.0)), 0.5),
    (lambda: R.topic(F.lit("(a) Scope of part. More.")), "Scope of part"),
    (lambda: R.run_id(F.to_timestamp(F.lit("2024-05-06 07:08:09"))), "20240506T070809Z"),
    (lambda: R.section_number(F.lit("§  101.62 ")), "101.62"),
    (lambda: R.part_heading(F.lit("PART 14A—DRIVER'S FOOD"))["name"], "Driver'S Food"),
    (lambda: R.subpart_heading(F.lit("Subpart B - General"))["key"], "B"),
    (lambda: R.subchapter_heading(F.lit("no heading"))["key"], None),
    (lambda: R.decoded(F.lit(bytearray(b"\xe9"))), "é"),
    (lambda: R.parsed_json(F.lit('see ```json {"a": 1} ``` x'), "a int")["a"], 1),
    (lambda: R.parsed_json(F.lit('{"a": 2}'), "a int")["a"], 2),
    (lambda: R.parsed_json(F.lit("nothing"), "a int"), None),
    (lambda: R.raw_label(F.lit("(ii) x"))["level"], 3),
    (lambda: R.raw_label(F.lit("(A) x"))["level"], 4),
    (lambda: R.raw_label(F.lit("(12) x"))["label"], "(12)"),
    (lambda: R.raw_label(F.lit("(b)(2) x")), None),
    (lambda: R.overflow_parts(F.lit("One. Two."), 1), ["One.", "Two."]),
    (lambda: R.overflow_parts(F.lit(""), 1), [""]),
    (lambda: R.markdown_table(F.array(F.lit("A")), F.array(F.array(F.lit("1")))), "A\n---\n1"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_functions(spark, case):
    make, expected = CASES[case]
    assert value(spark, make()) == expected
