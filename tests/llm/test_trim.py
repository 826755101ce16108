"""Outer white space of lines."""

import re

from pyspark.sql import functions as F

from tidewater.llm import site_lines


def test_lines_are_trimmed_of_ascii_white_space_alone(spark):
    lines = ["", " \t\r ", "\x0b\x0c a b\t ", "a  ", "a \u0085", "  a", " \U0001f600 "]
    found = spark.createDataFrame([(x,) for x in [*lines, None]], "x string").select(site_lines.trimmed(F.col("x")).alias("t"))
    assert [r.t for r in found.collect()] == [re.sub(r"\A[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\Z", "", x) for x in lines] + [None]


def test_hidden_parts_are_found_by_one_branch(spark):
    """The pattern that scans pages takes what the pattern of the SQL takes, and begins with its ``<``."""
    pages = ["", "<", "a<script>b</script>c", "<SCRIPT src=x>\n<!-- </ScRiPt> -->d", "<scripts>e</script>", "<style>f", "<<style\n>g</STYLE>h<!---->i<!-->j-->", "k<!--l<script>--></script>m", "<script>n</style></script >o</script>p", "<\u017ftyle>q</style>", None]
    frame = spark.createDataFrame([(x,) for x in pages], "x string")
    found = frame.select(F.regexp_replace("x", site_lines._HIDDEN_SCAN, " ").alias("a"), F.regexp_replace("x", site_lines._HIDDEN, " ").alias("b"), site_lines.visible_lines(F.col("x")).alias("v"), "x").collect()
    assert all(r.a == r.b for r in found) and {r.x: r.v for r in found}["a<script>b</script>c"] == "a c"
    plan = frame.select(site_lines.visible_lines(F.col("x")))._jdf.queryExecution().toString()
    assert "(?is)<(?:script" in plan and "|<style" not in plan
