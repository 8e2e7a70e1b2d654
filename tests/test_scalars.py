"""Small vectors with the traps of the scalar operators."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import lists, logic, text
from brindle.functions.expressions import fold_positions, math_eval
from brindle.functions.selector import selector
from brindle.sources.files import child_folder, free_names, match_folders, page, scan_folder


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("spec, want", [("2:4", "cd"), ("-2:", "ef"), ("9", ""), ("-1", ""), ("x", "abcdef"), ("1:2:3", "abcdef"), (":-4", "ab"), ("3:1", "")])
def test_slice(spark, spec, want):
    assert value(spark, text.slice_text(F.lit("abcdef"), spec)) == want


def test_title_strip_replace(spark):
    assert value(spark, text.title(F.lit("it's a-b x1y éa"))) == "it's a-b x1y éa".title()
    assert value(spark, text.strip(F.lit("  a b\t "))) == "a b"
    assert value(spark, text.literal_replace(F.lit("ab"), "", "-")) == "ab".replace("", "-")
    assert value(spark, text.literal_replace(F.lit("a.b.c"), ".", "$1")) == "a$1b$1c"


@pytest.mark.parametrize("delimiter, cuts, want", [(", ", -1, ["a", "b", ",c"]), ("|", 1, ["a, b, ,c"])])
def test_split(spark, delimiter, cuts, want):
    assert value(spark, text.split_items(F.lit("a, b, ,c"), delimiter, cuts)) == want


def test_split_limit_is_cuts(spark):
    assert value(spark, text.split_items(F.lit("a|b|c"), "|", 1)) == ["a", "b|c"]


def test_regex(spark):
    got = value(spark, text.regex_extract(F.lit("x12y3"), r"(\d+)y(\d+)", "match"))
    assert tuple(got) == ("12y3", True, "12\n3", 1)
    assert tuple(value(spark, text.regex_extract(F.lit("t"), "(", "match"))) == ("t", False, "", 0)
    assert value(spark, text.regex_extract(F.lit("ab ac"), r"a(?P<n>\w)", "replace", r"\g<n>$"))["result"] == "b$ c$"


@pytest.mark.parametrize("condition, mode, want", [("contains:DRESS", "include", ["dress red"]), ("len>=6", "include", ["dress red"]), ("regex:(", "exclude", ["dress red", "Shirt", "img_1"]), ("shirt", "include", ["Shirt"])])
def test_filter_list(spark, condition, mode, want):
    assert value(spark, lists.filter_list(F.array(F.lit("dress red"), F.lit("Shirt"), F.lit("img_1")), condition, mode))["passed"] == want


@pytest.mark.parametrize("index, wrap, want", [(-1, True, "c"), (-1, False, "c"), (-7, True, "c"), (-7, False, "a"), (5, True, "c"), (9, False, "c")])
def test_item(spark, index, wrap, want):
    items = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert value(spark, lists.item_at(items, F.lit(index), wrap))["item"] == want


@pytest.mark.parametrize("index, end, want", [(1, -1, [1]), (1, -2, [1, 2, 3]), (4, 2, [0]), (-1, -1, [4]), (0, 9, [0, 1, 2, 3, 4])])
def test_batch_slice(spark, index, end, want):
    rows = spark.range(5).withColumnRenamed("id", "pos")
    assert sorted(r.pos for r in lists.batch_slice(rows, F.col("pos"), F.lit(5), index, end).collect()) == want


@pytest.mark.parametrize("expression, want", [("a/0+2", 2), ("a//0+2", 0), ("-7//2", -4), ("-7%3", 2), ("round(2.5)", 2), ("2**200", 2.0**100), ("clamp(5,1,3)", 3), ("nope(1)", 0), ("1+", 0), ("sqrt(-1)", 0), ("0**-1", 0)])
def test_math(spark, expression, want):
    assert value(spark, math_eval(expression, {"a": F.lit(3)}))["result"] == want


def test_positions():
    assert fold_positions("10, 20\nx1 + 5, y1 - -2\n") == [(10, 20), (15, 22)]
    with pytest.raises(ValueError):
        fold_positions("x1 * 2, 0", {"x1": 1})


@pytest.mark.parametrize("a, b, op, want", [("1", "1.0", "is", True), ("a", "b", "<", True), (None, None, "is", False), ("2", "10", "<", True), ("x", "1", "?", False)])
def test_compare(spark, a, b, op, want):
    assert value(spark, logic.compare(F.lit(a), F.lit(b), op)) is want


def test_compare_in(spark):
    assert value(spark, logic.contains(F.lit(13), F.lit("1x3"))) is True
    assert value(spark, logic.contains(F.lit("ac"), F.lit("abc"))) is False
    assert value(spark, logic.contains_key(F.lit("k"), F.create_map(F.lit("k"), F.lit(1)))) is True


@pytest.mark.parametrize("kind, want", [("AND", "FFFT"), ("OR", "FTTT"), ("XOR", "FTTF"), ("NAND", "TTTF"), ("NOR", "TFFF")])
def test_gates(spark, kind, want):
    got = [value(spark, logic.gate(F.lit(a), F.lit(b), kind)) for a in (False, True) for b in (False, True)]
    assert "".join("T" if g else "F" for g in got) == want


def test_match_index_and_packing(spark):
    values = [F.lit("red"), F.lit("dress"), F.lit("")]
    assert value(spark, logic.match_index(F.lit("red dress"), values, "in", multi=9)) == 9
    assert value(spark, logic.match_index(F.lit("dress"), values)) == 2
    assert tuple(value(spark, logic.unpack(logic.pack([F.lit("a"), F.lit(None), F.lit("c")]), 3))) == ("a", "c", None)


def test_templates(spark):
    got = value(spark, text.render_template(F.lit("a {color}, {style}"), ["color", "style"], [F.lit("red"), F.lit("")]))
    assert tuple(got) == ("a red", "style")
    ping = [value(spark, text.schedule(F.lit("a\nb\nc"), F.lit(k), F.lit(6), "pingpong"))["index"] for k in range(6)]
    assert ping == [0, 1, 2, 1, 0, 1]
    assert [value(spark, text.schedule(F.lit("a\nb\nc"), F.lit(k), F.lit(10), "sequential"))["index"] for k in (0, 3, 6, 9)] == [0, 1, 2, 2]


def test_counter(spark):
    got = [tuple(value(spark, logic.counter(F.lit(k), 0, 1, 2))) for k in range(4)]
    assert [g[0] for g in got] == [0, 1, 2, 2] and [g[1] for g in got] == [False, False, False, True] and [g[3] for g in got] == [3, 2, 1, 0]


def test_natural_order(spark):
    names = spark.createDataFrame([(x,) for x in ("img10", "img2", "2b", "10b")], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["2b", "10b", "img2", "img10"]


def test_selector_errors():
    with pytest.raises(KeyError):
        selector("nope=1", ["a"])
    with pytest.raises(ValueError):
        selector("a:list=1", ["a"])


def test_file_names(spark, tmp_path):
    assert free_names(spark, ["shot0001.png", "0003.jpg"], 2, "shot") == ["shot0002.png", "shot0004.png"]
    assert free_names(spark, [], 2, "shot", number_suffix=False) == ["shot.png", "shot1.png"]
    with pytest.raises(ValueError):
        child_folder(str(tmp_path), "../out")


def test_scan_and_page(spark, tmp_path):
    for n in ("a10.png", "a2.PNG", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    files = scan_folder(spark, str(tmp_path))
    names = [r.path.rsplit("/", 1)[1] for r in page(files, 1, 3).collect()]
    assert names == ["a10.png", "a2.PNG", "a10.png"]
    deep = tmp_path / "deep"
    (deep / "in").mkdir(parents=True)
    (deep / "in" / "b.jpg").write_bytes(b"1")
    assert scan_folder(spark, str(deep)).count() == 1


def test_match_folders(spark):
    folders = spark.createDataFrame([("/r/shoes/Red_Dress",), ("/r/women/red-dress",), ("/r/women/blue",)], "path string")
    wanted = spark.createDataFrame([("red dress", "/r/women/red-dress/x.png"), ("RED", "")], "text string, context string")
    got = {r.text: r.path for r in match_folders(folders, wanted).collect()}
    assert got["red dress"] == "/r/women/red-dress"
