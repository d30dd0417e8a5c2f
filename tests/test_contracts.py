import pytest
from pyspark.sql import types as T

from marlstone import contracts as c
from marlstone import registries as r


def test_tables_are_consistent():
    for table in c.CONTRACTS.values():
        assert set(table.primary_key) <= set(table.column_names) and set(table.non_nullable_columns) <= set(table.column_names)
        assert set(table.columns_by_role("key")) == set(table.primary_key)
        assert not set(table.record_columns) & set(table.columns_by_role("provenance"))
        assert table.to_struct().names == list(table.column_names)
    assert c.MARKET_PRICES.spec("adj_close").nullable and c.MACRO_DATA.dtype_map()["value"] == "float"


def test_bad_declarations():
    f = c.Field("a", "int")
    with pytest.raises(ValueError):
        c.TableContract("t", "1", (f, f), ("a",))
    with pytest.raises(ValueError):
        c.TableContract("t", "1", (f,), ("b",))
    with pytest.raises(KeyError):
        c.MARKET_PRICES.spec("nope")
    with pytest.raises(KeyError):
        c.get_contract("nope")
    assert c.get_raw_contract("yahoo", "nope") is None


@pytest.mark.parametrize(("kind", "declared", "fits"), [(T.LongType(), "float", True), (T.DoubleType(), "int", False), (T.TimestampNTZType(), "date", True), (T.TimestampType(), "date", False), (T.TimestampNTZType(), "timestamp", True), (T.DecimalType(10, 2), "float", True), (T.StringType(), "string", True), (T.ArrayType(T.LongType()), "int", False)])
def test_families(kind, declared, fits):
    assert c.family_matches(kind, declared) is fits


def test_raw_contracts_declare_their_required_columns():
    assert all(set(x.required) <= set(x.columns) for x in c.RAW_CONTRACTS.values()) and len(c.RAW_CONTRACTS) == 4


def test_registry(spark):
    (spy,) = r.declared(source="yahoo", symbol=" SPY ")
    assert spy.entity == "SPY" and spy.currency == "USD" and not r.declared(source="fred", symbol="SPY")
    (tnx,) = r.declared(source="yahoo", symbol="^TNX")
    assert (tnx.source_unit, tnx.unit, tnx.factor, tnx.frequency) == ("tenths_of_percent", "percent", 0.1, "B")
    assert r.declared(symbol="CPIAUCSL")[0].frequency == "M" and r.declared(symbol="中国国债收益率30年")[0].entity == "CN_TREASURY_30Y"
    assert [tuple(x) for x in r.observed_by_several(spark).collect()] == [("US_TREASURY_10Y", 3, "akshare,fred,yahoo")]
    assert r.registry(spark, "macro_data").count() == 10 and r.registry(spark, "market_prices").count() == 3 and r.units(spark).count() == 6
    for wrong in (lambda: r.conversion("furlongs"), lambda: r.require_canonical("bp")):
        with pytest.raises(r.UndeclaredUnit):
            wrong()
    assert r.require_canonical("percent") == "percent" and r.conversion("basis_points") == ("percent", 0.01)
