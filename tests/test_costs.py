"""Cost expressions: each operator, nesting, absent tags, folding and mistakes, by hand."""

import math

import pytest

from trailframe.functions import costs


def value(spark, expression, tags=None, before="", **given):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    found = costs.costs(df, f"---context:way\n{before}\nassign x {expression}", "way", ("x",), given={k: F.lit(v) for k, v in given.items()})
    return found.first().x


CASES = [
    ("add 1 2", 3), ("sub 1 2", -1), ("multiply 3 2.5", 7.5), ("divide 1 4", 0.25), ("max 1 2", 2), ("min 1 2", 1), ("equal 2 2", 1), ("greater 2 2", 0), ("lesser 1 2", 1), ("not 0", 1), ("not 7", 0),
    ("or 0 2", 2), ("and 1 5", 5), ("xor 1 5", 0), ("xor 0 5", 1), ("switch 0 1 2", 2), ("if 3 then 1 else 2", 1), ("( add ( 1 ) ( multiply 2 3 ) )", 7), ("= true", 1),
    ("highway=track", 1), ("highway=path|track", 1), ("highway=path", 0), ("highway=", 0), ("bridge=", 1), ("bridge=yes", 0), ("v:maxspeed", 30), ("v:name", 0), ("v:width", math.nan),
    ("greater v:width 1", 0), ("lesser v:width 1", 0), ("equal v:width v:width", 0), ("max v:width 3", 3), ("switch v:width 1 2", 1), ("add v:maxspeed 0.1", costs.single(costs.single(0.1) + 30)),
    ("if highway=track then if surface=asphalt then 1 else 2 else 3", 2), ("or highway=path bridge=", 1), ("and highway=track not bridge=", 0), ("divide 1 highway=path", None),
]


@pytest.mark.parametrize(("expression", "want"), CASES)
def test_expressions(spark, expression, want):
    got = value(spark, expression, {"highway": "track", "maxspeed": "30", "name": "Way"})
    assert (got is None and want is None) or (math.isnan(got) and math.isnan(want)) or got == want


def test_no_tags_at_all(spark):
    assert value(spark, "highway=") == 1 and value(spark, "highway=track", {}) == 0


PROFILE = """
---context:global  # known everywhere
assign fast = 1
assign base = add 1 0.5
---context:way
assign costfactor = switch highway=track multiply base 2 base
assign costfactor = add costfactor extra
assign unused = add costfactor 100
---context:node
assign initialcost = if barrier=gate then way:costfactor else fast
"""


def test_contexts_and_assigning_again(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([({"highway": "track"}, 1), ({"barrier": "gate"}, 2), (None, 3)], "tags map<string,string>, costfactor int")
    way = costs.costs(df.withColumnRenamed("costfactor", "n"), PROFILE, "way", ("costfactor", "base"), given={"extra": F.col("n")})
    assert [(r.n, r.costfactor, r.base) for r in way.orderBy("n").collect()] == [(1, 4, 1.5), (2, 3.5, 1.5), (3, 4.5, 1.5)]
    node = costs.costs(df, PROFILE, "node", ("initialcost",), given={"way:costfactor": F.col("costfactor")})
    assert sorted((r.costfactor, r.initialcost) for r in node.collect()) == [(1, 1), (2, 2), (3, 1)]
    plan = way._jdf.queryExecution().optimizedPlan().toString()
    assert "100.0" not in plan and "Python" not in plan


@pytest.mark.parametrize("text", ["add 1", "add 1 2 3", "unknown", "divide 1 0", "if 1 then 2 3", "( 1", "add assign y 1", "add 1 x"])
def test_mistakes(text):
    with pytest.raises(costs.ProfileError):
        costs.parse(f"assign x {text}", "way")


def test_folding():
    text = "assign a = add 1 2\nassign b = switch a v:w 3\nassign c = or 0 highway=x\nassign d = and 0 highway=x\nassign e = add 0 b"
    nodes = dict(costs.parse(text, "way"))
    assert nodes["a"].number == 3 and nodes["b"].kind == "value" and nodes["c"].kind == "tag" and nodes["d"].number == 0 and nodes["e"].value == "b"
