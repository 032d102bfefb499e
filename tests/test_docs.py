"""The README's list of registered queries stays in step with the registry."""

import os
import re

import __spark_entry__ as E
from covenant.plans.catalog import REGISTRY

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_lists_every_registered_query():
    text = open(README).read()
    section = text[text.index("## Registered queries"):text.index("These operators are tested")]
    listed = set(re.findall(r"`([a-z_0-9]+)`", section))
    assert set(REGISTRY) <= listed
    assert int(re.search(r"(\d+) queries, each reading", text).group(1)) == len(REGISTRY)


def test_every_registered_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.oracle_sql())
