"""Parsers, augmentation and reports on small made-up rows."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import parsing
from gaugeworks.operators import generate, reports


def test_render():
    assert parsing.render_text('{"a": {"b": [1, true]}, "c": null}') == "a:\n  b:\n    - 1\n    - yes\nc: "
    assert parsing.render_text("plain {") == "plain {" and parsing.render_text(None) is None


def test_arrays_within_prose():
    assert parsing.first_array('x [1] y [2]') == "[1]" and parsing.first_array('a [bad] then [{"k": "]"}] z') == '[{"k":"]"}]'
    assert parsing.first_array("no") is None and parsing.first_array("[1, [2") is None and parsing.first_array(None) is None


def test_programs():
    assert parsing.run_program("v1 = add(2, 3)\nsome words\nV2 = DIV(v1, 2)\nANSWER v2\nANSWER v9") == (2.5, None)
    assert parsing.run_program("v1 = add($1,000, 3)")[1] == "no_program" and parsing.run_program("v1 = add($1, 3)\nanswer v01") == (4.0, None)
    assert [parsing.run_program(t)[1] for t in ("v1 = div(1, 0)\nANSWER v1", "ANSWER v9", "v1 = add(1, 2)", "oops", None, "v1 = add(v7, 1)", "v1 = add(x, 1)")] == ["div_by_zero", "undefined_var", "no_answer_line", "no_program", "no_program", "undefined_var", "undefined_var"]


def test_boards_and_diffs(spark):
    fen = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    assert parsing.board(fen).split("\n")[2] == "........" and parsing.board("8/8") is None
    df = spark.createDataFrame([(fen, "a\nb", "a\nc")], "fen string, x string, y string")
    r = df.select(parsing.game_phase(F.col("fen")).alias("p"), parsing.text_diff(F.col("x"), F.col("y")).alias("d"), parsing.chess_board(F.col("fen")).alias("b"), parsing.program_result(F.lit("v1 = add(2, 2)\nANSWER v1")).alias("v")).first()
    assert r["p"] == "opening" and "-b\n+c" in r["d"] and r["b"].startswith("rnbqkbnr") and r["v"]["value"] == 4.0


def test_options(spark):
    df = spark.createDataFrame([("use the Refund now", ["refund", "refund now", "no"]), ("nothing", ["a1", "b1"]), ("ASK: why ", ["ask"])], "t string, n array<string>")
    got = df.select(parsing.named_option(F.col("t"), F.col("n")).alias("x"), parsing.only_option(F.col("t"), F.col("n")).alias("y"), parsing.tagged_line(F.col("t")).alias("z")).collect()
    assert [r["x"] for r in got] == ["refund now", None, "ask"] and [r["y"] for r in got] == [None, None, "ask"]
    assert [tuple(r["z"]) for r in got] == [("malformed", None), ("malformed", None), ("ask", "why")]
    assert df.select(parsing.repeated_sentence(F.lit("A b. C. a b."))).first()[0] is False and df.select(parsing.repeated_sentence(F.lit("A b. C. a b. x"))).first()[0] is True


def test_augmentation(spark):
    df = spark.createDataFrame([(str(k), ["a", "b", "c"][: 2 + k % 2], k % 2) for k in range(400)], "id string, keys array<string>, label int")
    got = generate.augmented(df).join(df.select("id", F.col("keys").alias("was"), F.get("keys", F.col("label")).alias("gold")), "id").collect()
    assert {r["variant"] for r in got} == {"none", "none_distractor", "distractor", "permuted"}
    for r in got:
        said = r["keys"][r["label"]]
        assert said == ("none" if r["variant"] == "none" else r["gold"]) and (r["variant"] != "none" or len(r["was"]) > 2)
    assert sorted(map(tuple, generate.augmented(df).select("id", "label").collect())) == sorted(map(tuple, generate.augmented(df).select("id", "label").collect()))


def test_none_pairs_keep_the_order(spark):
    df = spark.createDataFrame([("1", ["a", "b", "c"], 1)], "id string, keys array<string>, label int")
    a, b = sorted(generate.none_pairs(df).collect(), key=lambda r: r["sibling"])
    assert a["keys"][a["label"]] == "b" and b["keys"][b["label"]] == "none" and [k for k in a["keys"] if k != "b"] == b["keys"]


def test_targets(spark):
    s = "id string, keys array<string>, label int, weights array<double>"
    got = generate.targets(spark.createDataFrame([("1", ["a", "b"], 1, None), ("2", ["a", "b"], 0, [1.0, 3.0])], s)).orderBy("id").collect()
    assert [r["target"] for r in got] == [[0.0, 1.0], [0.25, 0.75]]
    with pytest.raises(Exception, match="no mass"):
        generate.targets(spark.createDataFrame([("1", ["a"], 0, [0.0])], s)).collect()


def test_buried_and_perturbed(spark):
    r = spark.createDataFrame([("1", "s", "NEEDLE")], "id string, source string, state string")
    pool = spark.createDataFrame([("s", "x" * 10), ("s", "y" * 10), ("s", "z" * 1000)], "source string, text string")
    got = generate.buried(r, pool, 40).first()
    assert got["n"] == 2 and got["state"].split("\n\n").count("NEEDLE") == 1
    assert {x["addition"]: x["state"] for x in generate.perturbed(r, {"ad": "buy"}).collect()} == {"none": "NEEDLE", "ad": "NEEDLE\nbuy"}


def test_reports(spark):
    t = spark.createDataFrame([({"lr": "1", "seed": "1"},), ({"seed": "2", "lr": "1"},), ({"lr": "2", "seed": "1"},)], "c map<string,string>")
    assert len({r[0] for r in t.select(reports.recipe(F.col("c"))).collect()}) == 2
    assert [r[0] for r in t.select(reports.changed_settings(F.col("c"), {"lr": "1", "seed": "1"})).collect()] == [{}, {"seed": "2"}, {"lr": "2"}]
    claims = spark.createDataFrame([("a", "x", "0.83"), ("b", "x", "0.84"), ("c", "y", "1"), ("d", "z", "1")], "claim string, path string, printed string")
    facts = spark.createDataFrame([("x", 0.8301), ("y", 1.0), ("y", 1.0)], "path string, value double")
    assert {r["claim"]: r["ok"] for r in reports.checked_claims(claims, facts).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_the_longest_fitting_run_of_paragraphs(spark):
    from gaugeworks.functions import text as T

    texts = ["a b\n\nc d e\n\nf", "a b c d e f", "", None, "a\n\n\n\nb c d\n\ne", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = lambda budget: [r[0] for r in df.orderBy("k").select(T.fitting_prefix(F.col("t"), budget)).collect()]
    assert got(5) == ["a b\n\nc d e", None, "", None, "a\n\n\n\nb c d\n\ne", "\n\n"]
    assert got(4) == ["a b", None, "", None, "a\n\n\n\nb c d", "\n\n"]
    assert got(100)[:2] == texts[:2] and got(0) == [None, None, "", None, None, "\n\n"]
