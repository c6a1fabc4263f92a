"""Nulls and text that is no value of the type give null; the words around a number's limits."""

from pyspark.sql import functions as F

from nodeloom.functions import jsonxml, text, values


def test_nulls_and_wrong_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",)], "t string")
    c = F.col("t")
    rows = df.select(values.duration(c), values.cast_as(c, "integer"), values.cast_as(c, "boolean"), text.parse_ietf_date(c), jsonxml.json_to_xml(c), jsonxml.xml_to_json(c), values.zoned(c)["local"]).collect()
    assert all(x is None for r in rows for x in r)


def test_number_words(spark):
    df = spark.createDataFrame([(0,), (21,), (100,), (1001,), (-7,)], "n long")
    got = [tuple(r) for r in df.select(text.number_words(F.col("n")), text.number_words(F.col("n"), ordinal=True)).collect()]
    assert got == [("zero", "zeroth"), ("twenty-one", "twenty-first"), ("one hundred", "one hundredth"), ("one thousand one", "one thousand first"), ("-seven", "-seventh")]
