import pytest

from conftest import rows
from snapfold import schema
from snapfold.config import Config
from snapfold.operators import clean, dedup

COLUMNS = "owner string, customer string, total_price double, product_line string, stage string, deal_type string, opty string, model string"


def frame(spark, *records):
    return spark.createDataFrame(list(records), COLUMNS)


def row(owner="A", customer="C", total=1.0, line="NB", stage="Open", deal="Project", opty="O", model="M"):
    return (owner, customer, total, line, stage, deal, opty, model)


def test_reorder_moves_two_columns(spark):
    df = spark.createDataFrame([tuple(range(15))], [f"c{i}" for i in range(15)])
    order = [0, 1, 2, 3, 4, 5, 6, 10, 11, 7, 8, 9, 12, 13, 14]
    assert clean.reorder_columns(df).columns == [f"c{i}" for i in order]
    assert tuple(schema.RAW_COLUMNS[i] for i in (*order, 15)) == schema.SOURCE_COLUMNS


def test_small_generic_customers(spark):
    df = frame(spark, row(customer="Generic x", total=49_999.0), row(customer="Generic x", total=50_000.0),
               row(customer="Generic x", total=None), row(customer="other", total=None))
    assert [r[:3] for r in rows(clean.drop_small_generic(df))] == [("A", "Generic x", 50_000.0), ("A", "other", None)]


def test_blank_product_lines_stay(spark):
    df = frame(spark, row(line="LM"), row(line=None), row(line="NB"))
    assert sorted(r["product_line"] for r in clean.exclude_product_lines(df).collect()) == ["", "NB"]


def test_footer_null_and_excluded_owners(spark):
    df = frame(spark, row(owner="Total"), row(owner=None), row(owner="B"), row(customer=None), row())
    assert len(rows(clean.drop_footer_rows(df))) == 4
    assert len(rows(clean.drop_null_required(df))) == 3
    assert len(rows(clean.exclude_owners(df, ["B"]))) == 4
    assert len(rows(clean.exclude_owners(df, []))) == 5
    listed = spark.range(1_000_000).selectExpr("if(id = 0, 'B', concat('owner ', id)) as owner")
    by_table = clean.exclude_owners(df, listed.unionByName(spark.createDataFrame([(None,)], "owner string")))
    assert rows(by_table) == rows(clean.exclude_owners(df, ["B"])) and by_table.columns == df.columns
    assert "owner 7" not in by_table._jdf.queryExecution().toString()
    assert [r[0] for r in rows(clean.clean(df, Config(excluded_owners=("B",))))] == ["A"]


def test_stages_split_the_rows(spark):
    df = frame(spark, *[row(stage=s) for s in ("Rejected", "Closed Lost", "Open", None)])
    rejected = df.filter("stage = 'Rejected'").count()
    assert clean.open_only(df).count() + clean.closed_lost_subset(df).count() + rejected == df.count()


def test_key_of_missing_parts(spark):
    assert clean.with_key(frame(spark, row(opty=None, model="m"))).first()["key"] == "m"


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert clean.reindex_columns(df, ["b", "z"]).first().asDict() == {"b": 2, "z": None}
    assert clean.missing_columns(df, ["a", "z"]) == ["z"]
    assert rows(clean.required_columns(df, ["a", "z"])) == [("a", True, 1, 1), ("z", False, 1, 0)]
    with pytest.raises(ValueError):
        clean.rename_positional(df, ["x"])
    with pytest.raises(ValueError):
        clean.require(df.limit(0), ["a"])
    assert clean.drop_unnamed(spark.createDataFrame([(1, 2)], ["a", "Unnamed: 1"])).columns == ["a"]


def test_upgrade_only_of_the_old_width(spark):
    old = spark.createDataFrame([tuple("x" * 21)], [f"c{i}" for i in range(21)])
    new = clean.upgrade_v1_v2(old, [1, 2, 3, 4, 5])
    assert len(new.columns) == schema.V2_COLUMN_COUNT and new.first()["Week 3"] == ""
    assert clean.upgrade_v1_v2(new, [1, 2, 3, 4, 5]).columns == new.columns


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("O1", 10.0, 1), ("O1", 10.0, 2), ("O1", 20.0, 3), ("O2", None, 4), ("O2", None, 5)],
                               "opty string, total_price double, seq int")
    for parts in (1, 5):
        assert sorted(r["seq"] for r in dedup.dedup_opty_price(df.repartition(parts)).collect()) == [1, 3, 4]


def test_only_nameless_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, _cost int, _c3 int, `Unnamed: 4` int")
    assert clean.drop_unnamed(df).columns == ["a", "_cost"]
