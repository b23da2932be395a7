import re
from pathlib import Path

from workload import QUERIES


def test_inventory_names_every_query():
    text = (Path(__file__).parent.parent / "README.md").read_text()
    table = text.split("## Inventory")[1].split("\n## ")[0]
    named = {name for row in table.splitlines() if row.startswith("|") for name in re.findall(r"`(\w+)`", row.split("|")[2])}
    assert named == set(QUERIES)
