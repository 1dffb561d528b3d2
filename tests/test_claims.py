"""The package claims only what is there."""

import importlib
import pkgutil

import pytest

import prismveil
import prismveil.operators


def test_operators_docstring_names_no_missing_operator():
    have = {m.name for m in pkgutil.iter_modules(prismveil.operators.__path__)}
    said = prismveil.operators.__doc__
    for claim, module in (("detection", "detection"), ("tokenisation", "tokenisation"), ("audit chain", "audit_chain"), ("attestation", "attestation"), ("evaluation", "evaluation")):
        assert claim not in said or module in have


@pytest.mark.parametrize("name", [m.name for m in pkgutil.walk_packages(prismveil.__path__, "prismveil.") if ".llm" not in m.name])
def test_nothing_outside_llm_imports_it(name):
    source = importlib.util.find_spec(name).origin
    assert "prismveil.llm" not in open(source).read()
