import pytest
from pyspark.sql import types as T

from relspark import types as R


@pytest.mark.parametrize(
    ("text", "name", "spark"),
    [
        ("INT", "integer", T.IntegerType()), ("varchar(50)", "varchar", T.StringType()), ("DECIMAL(10,2)", "decimal", T.DecimalType(10, 2)), ("numeric", "numeric", T.DecimalType(38, 18)),
        ("real", "real", T.FloatType()), ("FLOAT", "float", T.DoubleType()), ("bool", "boolean", T.BooleanType()), ("timestamp", "timestamp", T.TimestampNTZType()),
        ("text[]", "text[]", T.ArrayType(T.StringType())), ("double precision", "double", T.DoubleType()), ("bigserial", "bigserial", T.LongType()), ("time", "time", T.LongType()),
    ],
)
def test_parse(text, name, spark):
    t = R.parse_type(text)
    assert t.info.name == name and t.spark == spark


def test_unknown():
    for bad in ("nope", "int(", "", "varchar(x)"):
        with pytest.raises(ValueError):
            R.parse_type(bad)
    assert R.category("nope") == R.UNKNOWN


def test_families():
    assert R.is_numeric("money") and not R.is_numeric("text") and R.is_string("char") and R.is_datetime("interval") and R.is_array("int[]")
    assert R.element_type("float[]") == "float" and R.element_type("int") is None
    assert R.compatible("int", "decimal") and R.compatible("text", "varchar") and R.compatible("date", "timestamp") and R.compatible("uuid", "uuid")
    assert not R.compatible("int", "text") and not R.compatible("json", "xml")
    assert R.default_value("int") == 0 and R.default_value("text") == "" and R.default_value("bool") is False and R.default_value("json") is None
    assert str(R.parse_type("varchar(5)")) == "varchar(5)" and R.parse_type("varchar(5)").max_length == 5


def test_every_type_has_a_spark_type():
    for t in R.TYPES.values():
        assert isinstance(t.spark, T.DataType)
