import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import docs, scratch, tables  # noqa: E402, F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")  # as in the folder above, whose module has the same name
