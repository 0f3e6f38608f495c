"""Names whose initials leave few grams to share."""

from hexloom.llm import variants as V


def test_initials_on_either_side(spark):
    names = {109: ["Mostafa T. Yaouughu", "M. Thuliri Yawughu"], 150: ["Mohamed T. Buwuyaa", "M. Tudhalu Buwuya"], 170: ["A. Fibaha Wughita", "Alexander F. Wugita"]}
    rows = [(b, b * 10 + i, n) for b, ns in names.items() for i, n in enumerate(ns)]
    al = spark.createDataFrame([("Mostafa", "Sasa"), ("Mohamed", "Hamada"), ("Alexander", "Alex")], "given_name string, alias string")
    got = sorted(map(tuple, V.same_entries(spark.createDataFrame(rows, "block long, entry long, name string"), al).collect()))
    assert got == [(b * 10, b * 10 + 1) for b in names]
