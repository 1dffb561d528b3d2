import pytest

from prismveil.llm import junk, templates

GOOD = "Heat exchanger\n\nABSTRACT\nThe invention relates to a heat exchanger with an annular sleeve.\n\nDESCRIPTION\n[0001] The sleeve is welded to the outer lid.\n[0002] In one embodiment, the lid is made of glass.\n\nCLAIMS\n1. A heat exchanger, comprising a sleeve and a lid.\n2. The heat exchanger of claim 1, wherein the lid is made of glass."
CASES = {
    "whole notice": "Please enable JavaScript to continue.",
    "title and error": "Heat exchanger\nThe requested document cannot be displayed.\n\n01/09 14:41",
    "section": GOOD.replace("[0001] The sleeve is welded to the outer lid.\n[0002] In one embodiment, the lid is made of glass.", "504 Gateway Timeout\nedge/8.15"),
    "field": GOOD.replace("The sleeve is welded to the outer lid.", "{{description_body}}"),
    "slot in brackets": GOOD.replace("outer lid.", "outer lid. (__DESCRIPTION_BODY__)"),
    "slot before": GOOD.replace("The sleeve is", "[[applicant_name]] The sleeve is"),
    "claim": GOOD.replace("A heat exchanger, comprising a sleeve and a lid.", "[INSERT CLAIM 1 HERE]"),
    "filler": GOOD.replace("The invention relates to a heat exchanger with an annular sleeve.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."),
    "flattened": "<enter title> Abstract [TBD - see draft] Detailed Description [0001] ${agent.address} [0002] __TECHNICALFIELD__ What is claimed is: 1) (to be completed by the applicant) 2) {{title}}",
    "scripts": "このページを表示するにはJavaScriptを有効にしてください。",
}
FINE = {
    "good": GOOD,
    "footer": GOOD + "\n\nSome features need scripts to be switched on.\nThis site uses cookies. Accept all",
    "about placeholders": GOOD.replace("The sleeve is welded to the outer lid.", "A placeholder such as {{name}} is replaced by a stored value before delivery."),
    "about errors": GOOD.replace("The sleeve is welded to the outer lid.", "Internal server errors (code 500) are counted by the watchdog."),
    "about scripts": GOOD.replace("The sleeve is welded to the outer lid.", 'The display shows "please enable JavaScript" when the scripting engine is off.'),
    "formula": GOOD.replace("The sleeve is welded to the outer lid.", "[Math. 3]"),
    "short": "A method for operating the drying chamber is also disclosed.",
    "empty": "",
    "blank": " \n ",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, t) for n, t in (CASES | FINE).items()] + [("null", None)]
    stored = junk.mined(spark.createDataFrame(rows, "k string, t string"), "k", "t").cache()
    merged = junk.merged_templates(stored.filter("_t is not null").select("_text", "_n"))
    return {r._key for r in junk.junk_documents(stored, junk.template_verdicts(merged)).collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(found, name):
    assert name in found


@pytest.mark.parametrize("name", [*sorted(FINE), "null"])
def test_no_case(found, name):
    assert name not in found


def test_templates_share_a_leaf_and_grow_wildcards():
    tree = templates.Tree()
    a, b = tree.add("The outer lid is made of glass."), tree.add("The outer rotor is made of steel.")
    assert a == b and tree.text(a) == "The outer <*> is made of <*> ." and tree.counts[a] == 2
    assert tree.add("Error 404: gone") == tree.add("Error 410: gone")


def test_an_empty_table_has_no_cases(spark):
    df = spark.createDataFrame([], "k string, t string")
    stored = junk.mined(df, "k", "t")
    merged = junk.merged_templates(stored.filter("_t is not null").select("_text", "_n"))
    assert junk.junk_documents(stored, junk.template_verdicts(merged)).collect() == []
