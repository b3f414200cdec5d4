"""What entry() says it runs is what it runs."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__

from graphloom.plans import catalog


def test_entry_names_its_query():
    assert catalog.FLAGSHIP in __spark_entry__.queries()
    assert catalog.FLAGSHIP in __spark_entry__.entry.__doc__
